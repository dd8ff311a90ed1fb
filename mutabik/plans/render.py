"""Report pages and files from collected aggregates."""

from __future__ import annotations

import html
import json
from datetime import datetime

from pyspark.sql import DataFrame

from mutabik.operators import report
from mutabik.operators.score import Score
from mutabik.plans.engine import Output

STYLE = "body{font:15px sans-serif;max-width:52rem;margin:2rem auto}table{border-collapse:collapse;margin:1rem 0}td,th{border-bottom:1px solid #ccc;padding:.3rem .8rem;text-align:right}td:first-child,th:first-child{text-align:left}"


def _table(head: list[str], rows: list[list]) -> str:
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + line("th", head) + "".join(line("td", r) for r in rows) + "</table>"


def _page(title: str, *parts: str) -> str:
    return f"<!doctype html><html lang='en'><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style><h1>{html.escape(title)}</h1>{''.join(parts)}</html>"


def report_html(book: DataFrame, out: Output) -> str:
    """Totals, match rate, matches by kind, discrepancies by type, ages."""
    rate = report.match_rate(book, out.members).first()
    k = [[r["kind"], r["n"]] for r in report.kinds(out.matches).orderBy("pos").collect()]
    t = [[r["type"], r["n"], r["delta_try"]] for r in report.types(out.discrepancies).orderBy("pos").collect()]
    a = [[r["age"], r["n"]] for r in report.ageing(book, out.discrepancies).orderBy("pos").collect()]
    head = f"<p>{rate['total']} transactions, {rate['matched']} matched ({rate['rate_pct']} %)</p>"
    return _page("Reconciliation report", head, _table(["Match", "Count"], k), _table(["Discrepancy", "Count", "Delta TRY"], t), _table(["Age", "Count"], a))


def panel_html(s: Score) -> str:
    """The verification panel of a scored run."""
    rows = [[t, v["emitted"], v["expected"], v["short"], v["surplus"]] for t, v in s.types.items()]
    head = f"<p><b>{'PASS' if s.passed else 'FAIL'}</b>: {s.detected} types, {s.false_matches} false, {s.missed} missed; {s.transactions} transactions in {s.seconds:.3f} s</p>"
    return _page("Verification", head, _table(["Match", "Count"], [[k, n] for k, n in s.kinds.items()]), _table(["Type", "Emitted", "Expected", "Short", "Surplus"], rows))


def discrepancy_csv(out: Output) -> DataFrame:
    """type, tx_id (0 for a whole match), delta_kurus, by type."""
    return out.discrepancies.selectExpr("type", "coalesce(tx_id, 0) as tx_id", "delta as delta_kurus").orderBy("type", "tx_id")


def summary_dict(book: DataFrame, out: Output) -> dict:
    """The run summary as plain values."""
    r = report.summary(book, out.matches, out.members, out.discrepancies).first().asDict()
    return {
        "transactions": r["transactions"], "matched_transactions": r["matched_transactions"], "matches": r["matches"], "discrepancies": r["discrepancies"],
        "by_kind": {k[5:]: v for k, v in r.items() if k.startswith("kind_")}, "by_type": {k[5:]: v for k, v in r.items() if k.startswith("type_")},
    }


def summary_json(book: DataFrame, out: Output) -> str:
    return json.dumps(summary_dict(book, out) | {"at": datetime.now().isoformat(timespec="seconds")}, indent=2)
