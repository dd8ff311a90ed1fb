"""Files, store, report, generator and service around the engine."""

import json
import random
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from mutabik.functions import scalars as S
from mutabik.plans.engine import outcomes, run
from mutabik.plans.render import panel_html, report_html, summary_dict
from mutabik.plans.scored import benchmark, realrun
from mutabik.server import make_server
from mutabik.sources import store
from mutabik.sources.files import HeaderError, parse_file, raw_records, source
from mutabik.sources.store import ParquetStore
from mutabik.streaming.ingest import ingest_folder

PSP = """ref,counterparty,amount_kurus,currency,occurred_at,direction
S-100,shop-a,52300,TRY,2026-03-02,credit
S-101,shop-a,18000,TRY,2026-03-02,credit
S-102,shop-b,64000,TRY,2026-03-03,credit
S-103,shop-b,9000,TRY,2026-03-03,credit
S-103,shop-b,9000,TRY,2026-03-05,debit
S-104,shop-c,30000,TRY,2026-03-05,credit
S-105,shop-c,45000,TRY,2026-03-06,credit
S-106,shop-d,2750,TRY,2026-03-06,credit
S-107,shop-d,4150,TRY,2026-03-08,credit
"""
BANK = """stmt_ref,counterparty,amount_kurus,currency,value_date,direction
S-100,shop-a,52300,TRY,2026-03-03,credit
S-101,shop-a,11000,TRY,2026-03-03,credit
S-101,shop-a,7000,TRY,2026-03-04,credit
S-102,shop-b,63800,TRY,2026-03-05,credit
S-105,shop-c,40500,TRY,2026-03-07,credit
Z-9,shop-d,111,TRY,2026-03-20,credit
"""
MARKET = """payout_ref,counterparty,gross_kurus,commission_kurus,net_kurus,payout_date
P-1,shop-d,6900,690,6210,2026-03-12
"""


@pytest.fixture()
def golden(tmp_path):
    for n, t in (("psp", PSP), ("bank", BANK), ("marketplace", MARKET)):
        (tmp_path / f"{n}.csv").write_text(t)
    return tmp_path


def test_golden_book_through_store_report_and_service(spark, golden):
    st = ParquetStore(spark, str(golden / "store"))
    sums = [st.ingest(n, str(golden / f"{n}.csv")) for n in ("psp", "bank", "marketplace")]
    assert [s.inserted for s in sums] == [9, 6, 1] and not any(s.rejected for s in sums)
    again = st.ingest("psp", str(golden / "psp.csv"))
    assert (again.inserted, again.deduped) == (0, 9)
    book = st.load()
    out = run(book)
    s = summary_dict(book, out)
    assert s["transactions"] == 16
    assert s["by_kind"] == {"exact": 1, "split": 1, "tolerant": 1, "reversal": 1, "group": 1}
    assert {k: v for k, v in s["by_type"].items() if v} == {"commission": 3, "missing": 1, "unknown": 1}
    st.save(out)
    assert st.with_status().where("status = 'matched'").count() == 12
    page = report_html(book, out)
    assert "16 transactions, 12 matched (75 %)" in page
    server = make_server(st, ("127.0.0.1", 0))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda p: urllib.request.urlopen(base + p).read().decode()
    assert json.loads(get("/healthz")) == {"status": "ok"} and json.loads(get("/readyz"))["status"] == "ready"
    post = urllib.request.Request(base + "/api/v1/reconciliation-runs", method="POST")
    assert json.loads(urllib.request.urlopen(post).read())["by_type"]["missing"] == 1
    assert 'reconciliation_runs_total{status="ok"} 1' in get("/metrics")
    with server.busy, pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(post)
    assert e.value.code == 409
    server.shutdown()


def test_rejects_keep_their_numbers_and_equal_lines_survive(spark, tmp_path):
    f = tmp_path / "bank.csv"
    f.write_text('stmt_ref,counterparty,amount_kurus,currency,value_date,direction\n,s1,4000,TRY,2026-07-03,credit\n\nA,s1,x,TRY,2026-07-03,credit\n"two\nlines",s1,5,TRY,2026-07-03,credit\n,s1,4000,TRY,2026-07-03,credit\nA,s1,5\nB,s1,5, TRY,2026-07-03,credit\n')
    tx, bad = parse_file(spark, "bank", str(f))
    got = {r["row_no"]: (r["external_ref"], r["amount"]) for r in tx.collect()}
    assert got == {2: ("", 4000), 4: ("two\nlines", 5), 5: ("", 4000)}
    assert {r["row_no"]: r["reason"] for r in bad.collect()} == {3: "invalid amount", 6: "wrong column count", 7: "unsupported currency"}
    assert tx.select("dedup_key").distinct().count() == 3


def read_strictly(text):
    """Brute force: the first line of every record with whether it is sound, and all of a sound one; one character at a time."""
    lines, out, i = text.split("\n")[:-1], [], 0
    while i < len(lines):
        if not lines[i]:
            i += 1
            continue
        first, rec, state, good, k = i, lines[i], "start", True, 0
        while True:
            if k == len(rec):
                if state != "quoted" or i + 1 == len(lines):
                    break
                i += 1
                rec += "\n" + lines[i]
            c = rec[k]
            if state == "quoted":
                state = "closed" if c == '"' else "quoted"
            elif c == ",":
                state = "start"
            elif c == '"' and state in ("start", "closed"):
                state = "quoted"
            elif c == '"' or state == "closed":
                good = False
                break
            else:
                state = "plain"
            k += 1
        good = good and state != "quoted"
        out.append((rec if good else lines[first], good))
        i += 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_stray_quote_costs_one_record(spark, tmp_path, seed):
    rng = random.Random(seed)
    head = ",".join(source("psp").header)
    text = head + "\n" + "".join("".join(rng.choices(['"', ",", "a", "\n", '""', ',"', '",'], [3, 6, 30, 8, 2, 3, 3], k=1200))) + "\n"
    f = tmp_path / "x.csv"
    f.write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # many splits
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [r["raw_text"] for r in raw_records(spark, source("psp"), str(f), 1).orderBy("row_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [t for t, _ in read_strictly(text)][1:]


def test_a_quote_inside_a_field_rejects_its_row_alone(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("ref,counterparty,amount_kurus,currency,occurred_at,direction\n" + "".join(f'r{k},{"c" + chr(34) + "x" if k == 2 else "c"},{k},TRY,2026-03-01,credit\n' for k in range(1, 6)))
    tx, bad = parse_file(spark, "psp", str(f))
    assert sorted(r["external_ref"] for r in tx.collect()) == ["r1", "r3", "r4", "r5"]
    assert [(r["row_no"], r["reason"]) for r in bad.collect()] == [(3, "broken quoting")]


def test_reasons_come_in_order(spark, tmp_path):
    f = tmp_path / "p.csv"
    rows = ["a,c,-100,USD,2026-03-01,credit", "a,c,x,USD,2026-13-01,sent", "a,c,5,USD,2026-13-01,sent", "a,c,5,USD,2026-03-01,sent", "a,c,-5,TRY,2026-03-01,debit"]
    f.write_text("ref,counterparty,amount_kurus,currency,occurred_at,direction\n" + "\n".join(rows) + "\n")
    bad = parse_file(spark, "psp", str(f))[1].orderBy("row_no").collect()
    assert [r["reason"] for r in bad] == ["unsupported currency", "invalid amount", "invalid date", "invalid direction", "negative amount"]


@pytest.mark.parametrize("step", ["_commit", "new_rows", "conform"])
def test_a_failed_ingest_leaves_nothing(spark, golden, monkeypatch, step):
    st = ParquetStore(spark, str(golden / f"crash{step}"))

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(*((ParquetStore, "_commit") if step == "_commit" else (store, step)), crash)
        with pytest.raises(RuntimeError):
            st.ingest("psp", str(golden / "psp.csv"))
    got = st.ingest("bank", str(golden / "bank.csv"))
    assert (got.parsed, got.inserted, got.deduped) == (6, 6, 0) and st.load().count() == 6
    got = st.ingest("psp", str(golden / "psp.csv"))
    assert (got.inserted, st.load().select("tx_id").distinct().count()) == (9, 15)


def test_wrong_header_and_source(spark, golden):
    with pytest.raises(HeaderError):
        parse_file(spark, "bank", str(golden / "psp.csv"))
    with pytest.raises(KeyError):
        source("paypal")


def test_stream_ingest_adds_each_file_once(spark, golden):
    (golden / "in").mkdir()
    (golden / "in" / "a.csv").write_text(PSP)
    st = ParquetStore(spark, str(golden / "s2"))
    for _ in range(2):
        ingest_folder(spark, st, "psp", str(golden / "in"), str(golden / "cp"))
    assert st.load().count() == 9
    (golden / "in" / "b.csv").write_text(PSP.replace("S-107", "S-108"))
    ingest_folder(spark, st, "psp", str(golden / "in"), str(golden / "cp"))
    assert st.load().count() == 10


@pytest.mark.parametrize("seed", [1, 2])
def test_generated_book_is_fully_detected(spark, seed):
    s = benchmark(spark, seed, 8000)
    assert s.passed, s.text()
    assert s.detected == "8/8" and "PASS" in panel_html(s)


def test_realrun_scores_against_truth(spark, golden):
    (golden / "truth.csv").write_text("source,row,label,type\npsp,1,a,\nbank,1,a,\npsp,3,b,\nbank,4,b,\npsp,8,c,\npsp,2,c,\npsp,6,,missing\npsp,7,,commission\n")
    s = realrun(spark, {n: str(golden / f"{n}.csv") for n in ("psp", "bank", "marketplace")}, str(golden / "truth.csv"), str(golden))
    assert s["labels"]["correct"] == 2 and s["labels"]["missed"] == 1
    assert s["label_rows"] == {"labelled": 6, "unlabelled": 2} and s["missed_by_type"] == {"": 1}
    assert s["false_by_kind"] == {"split": 1, "group": 1} and sorted(map(len, s["false_examples"].values())) == [3, 3]
    assert {"want": "missing", "got": "missing", "n": 1} in s["confusion"]


def test_scalars(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([(12345,), (-5,), (0,), (big,), (-big - 1,)], "a long")
    shown = [r[0] for r in df.select(S.format_try(F.col("a"))).collect()]
    assert shown == ["123,45", "-0,05", "0,00", "92233720368547758,07", "-92233720368547758,08"]
    assert spark.range(1).select(S.basis_points(F.lit(big), F.lit(big))).first()[0] == 10000
    parsed = spark.createDataFrame([(x,) for x in ("12", " 12 ", "+5", "-0", "007", "12.5", "1e3", "1_000", "", None, str(big + 1), "0" * 40 + "7", "٣")], "s string").select(S.parse_kurus(F.col("s"))).collect()
    assert [r[0] for r in parsed] == [12, 12, 5, 0, 7, None, None, None, None, None, None, 7, None]
    days = spark.createDataFrame([(x,) for x in ("2026-07-01", " 2026-07-01 ", "2026-7-1", "2026-02-30", "2026-07-01T00:00", None)], "s string").select(S.parse_day(F.col("s")).isNotNull()).collect()
    assert [r[0] for r in days] == [True, True, False, False, False, False]


def test_outcomes_cover_the_book(spark, golden):
    book = parse_file(spark, "psp", str(golden / "psp.csv"))[0].withColumn("tx_id", F.col("row_no").cast("long"))
    assert outcomes(run(book)).where("outcome = 'missing'").count() == 7
