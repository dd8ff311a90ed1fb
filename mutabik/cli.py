"""Command line: ingest, run, report, demo, benchmark, verify, realrun, serve, healthcheck."""

from __future__ import annotations

import argparse
import sys
import urllib.request
from pathlib import Path

from mutabik.plans.engine import run
from mutabik.plans.render import discrepancy_csv, panel_html, report_html, summary_dict, summary_json
from mutabik.plans.scored import ORDER, benchmark, realrun
from mutabik.session import local_session
from mutabik.sources.store import ParquetStore


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="mutabik")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), *(c.add_argument(*a, **k) for a, k in args)]
    store = (("--store",), {"default": "store"})
    add("ingest", store, (("--source",), {"required": True}), (("--file",), {"required": True}))
    add("run", store)
    add("report", store, (("--html",), {"default": "report.html"}), (("--csv",), {"default": "discrepancies"}))
    add("demo", store, (("--dir",), {"required": True}))
    add("benchmark", (("--n",), {"type": int, "default": 50_000}), (("--seed",), {"type": int, "default": 1}))
    add("verify", (("--n",), {"type": int, "default": 50_000}), (("--seed",), {"type": int, "default": 1}), (("--html",), {"default": "verification.html"}))
    add("realrun", *(((f"--{n}",), {}) for n in ORDER), (("--truth",), {}), (("--out",), {"default": "out"}))
    add("serve", store, (("--port",), {"type": int, "default": 8080}))
    add("healthcheck", (("--url",), {"default": "http://127.0.0.1:8080/healthz"}))
    a = p.parse_args(argv)
    if a.command == "healthcheck":
        with urllib.request.urlopen(a.url, timeout=3) as r:
            return 0 if r.status == 200 else 1
    spark = local_session()
    if a.command in ("benchmark", "verify"):
        s = benchmark(spark, a.seed, a.n)
        if a.command == "verify":
            Path(a.html).write_text(panel_html(s))
        print(s.text())
        return 0 if s.passed else 1
    if a.command == "realrun":
        files = {n: getattr(a, n) for n in ORDER if getattr(a, n)}
        Path(a.out).mkdir(parents=True, exist_ok=True)
        print(realrun(spark, files, a.truth, a.out))
        return 0
    st = ParquetStore(spark, str(Path(a.store).resolve()))
    if a.command == "ingest":
        print(st.ingest(a.source, a.file))
    elif a.command in ("run", "demo"):
        if a.command == "demo":
            for n in ORDER:
                print(st.ingest(n, f"{a.dir}/{n}.csv"))
        out = run(st.load())
        st.save(out)
        print(summary_dict(st.load(), out))
    elif a.command == "report":
        out = run(st.load())
        Path(a.html).write_text(report_html(st.load(), out))
        discrepancy_csv(out).coalesce(1).write.mode("overwrite").csv(a.csv, header=True)
        print(summary_json(st.load(), out))
    elif a.command == "serve":
        from mutabik.server import make_server

        make_server(st, ("0.0.0.0", a.port)).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
