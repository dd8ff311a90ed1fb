"""Strict load, orphans and copy differences: brute force, edge cases, hot groups."""

import csv
import io
import re
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mutabik.operators.copy_diff import copy_differences
from mutabik.operators.orphans import ChildTable, orphan_counts, orphan_references
from mutabik.operators.strict_load import load_and_reject

RAW = "line_id long, source string, batch_id long, row_no int, raw_text string"
T0 = datetime(2026, 6, 1)


def _fields(t):
    """Fields of one record, by a character automaton; None if it is not sound."""
    out, i, n = [], 0, len(t)
    while True:
        if i < n and t[i] == '"':
            i, f = i + 1, ""
            while True:
                j = t.find('"', i)
                if j < 0:
                    return None
                f += t[i:j]
                if t[j + 1 : j + 2] == '"':
                    f, i = f + '"', j + 2
                else:
                    i = j + 1
                    break
        else:
            m = re.compile('[^,"\r\n]*').match(t, i)
            f, i = m.group(), m.end()
        out.append(f)
        if i == n:
            return out
        if t[i] != ",":
            return None
        i += 1


def _valid(source, t):
    f = None if t is None else _fields(t)
    if f is None or len(f) != 6 or source not in ("psp", "bank", "marketplace"):
        return False
    amount = lambda x: int(x) if re.fullmatch(r" *[+-]?[0-9]+ *", x) and 0 <= int(x) < 2**63 else None

    def day(x):
        if not re.fullmatch(r" *[0-9]{4}-[0-9]{2}-[0-9]{2} *", x):
            return False
        try:
            return bool(datetime.strptime(x.strip(" "), "%Y-%m-%d"))
        except ValueError:
            return False

    if source == "marketplace":
        a = [amount(x) for x in f[2:5]]
        return None not in a and a[0] - a[1] == a[2] and day(f[5])
    return amount(f[2]) is not None and f[3] == "TRY" and day(f[4]) and f[5] in ("credit", "debit")


piece = st.sampled_from(['"', '""', ",", "a", "A,b", "\n", "\r", "\u0001", "\u0001b", "TRY", "credit", "debit", "2026-07-01", " 2026-02-30", "12", " 7 ", "-1", "+3", "9223372036854775808", "00012", "", "₺5", "٣", "EUR"])
record = st.one_of(st.lists(piece, max_size=12).map("".join), st.tuples(*[st.one_of(piece, piece.map(lambda x: '"' + x.replace('"', '""') + '"'))] * 2, st.sampled_from(["12", " 12 ", "x", '"5"', "-0"]), st.sampled_from(["TRY", "try", '"TRY"', "3"]), st.sampled_from(["2026-07-01", "9", "2026-7-1"]), st.sampled_from(["credit", "debit", "2026-07-01", '"debit"'])).map(",".join))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["psp", "bank", "marketplace", "x", None]), st.one_of(st.none(), record)), min_size=60, max_size=120))
def test_strict_load_equals_an_automaton(spark, rows):
    raw = spark.createDataFrame([(i, s, 1, i, t) for i, (s, t) in enumerate(rows)], RAW)
    good, bad = load_and_reject(raw)
    g, b = {r["line_id"]: r for r in good.collect()}, {r["line_id"] for r in bad.collect()}
    want = {i for i, (s, t) in enumerate(rows) if _valid(s, t)}
    assert set(g) == want and b == set(range(len(rows))) - want
    for i, r in g.items():
        f = _fields(rows[i][1])
        assert (r["ref"], r["counterparty"]) == (f[0], f[1])


def test_strict_load_edges(spark):
    long = "A" * 300_000
    rows = [(1, "psp", 1, 2, f'"{long}""{long}",s,1,TRY,2026-07-01,credit'), (1, "psp", 1, 2, "bad"), (1, "psp", 1, 2, "bad"), (None, "psp", None, None, "x"), (None, "bank", 1, 1, ",,0,TRY,2026-07-01,debit"), (3, "psp", 1, 1, ""), (4, None, 1, 1, "a"), (5, "psp", 1, 1, '"' * 100_001)]
    raw = spark.createDataFrame([(*r, "extra") for r in rows], RAW + ", reason string")
    good, bad = load_and_reject(raw)
    assert sorted((r["line_id"] or 0, len(r["ref"])) for r in good.collect()) == [(0, 0), (1, 600_001)]
    assert sorted((r["line_id"] or 0, r["reason"]) for r in bad.collect()) == [(0, "wrong column count"), (1, "wrong column count"), (1, "wrong column count"), (3, "wrong column count"), (4, "unknown source"), (5, "broken quoting")]
    empty = load_and_reject(spark.createDataFrame([], RAW))
    assert empty[0].count() == empty[1].count() == 0


def test_fields_agree_with_the_csv_module():
    for t in ('a,"b ""c""",d', '"",x', "a,,b", '"x\ny",z'):
        assert _fields(t) == next(csv.reader(io.StringIO(t)))


CHILD, DEL = "tx_id long, counterparty string, ref string, ingested_at timestamp", "source string, counterparty string, ref string, deleted_at timestamp"
PAR = "counterparty string, ref string, ingested_at timestamp"


def _orphans(spark, kids, psp, mk, gone):
    tables = [ChildTable("bank", spark.createDataFrame(kids, CHILD), ("psp", "marketplace"))]
    return orphan_references(tables, {"psp": spark.createDataFrame(psp, PAR), "marketplace": spark.createDataFrame(mk, PAR)}, spark.createDataFrame(gone, DEL))


def test_orphans_by_time_and_deletion(spark):
    h = lambda n: T0 + timedelta(hours=n)
    kids = [(1, "s", "A-1", h(0)), (2, "s", "a1", h(0)), (3, "s", "B", h(0)), (4, "s", "C", h(0)), (5, "s", "C", h(100)), (6, "s", " ", h(0)), (7, None, "A1", h(0)), (8, "t", "A1", h(0)), (9, "s", "D", None), (10, "s", "E", h(0)), (11, "s", None, h(0)), (12, "s", "F", h(0)), (12, "s", "F", h(0))]
    psp = [("s", "A1", h(48)), ("s", "B", h(49)), ("s", "C", h(0)), ("s", "D", h(0)), ("s", "E", None), (None, "A1", h(0)), ("s", "F", h(0))]
    mk = [("s", "f", h(1))]
    gone = [("psp", "s", "c", h(50)), ("psp", "s", "F", h(3)), ("psp", "s", "D", None), (None, "s", "A1", h(0))]
    out = _orphans(spark, kids, psp, mk, gone)
    assert sorted((r["tx_id"], r["reason"]) for r in out.collect()) == [(3, "late"), (5, "deleted"), (7, "missing"), (8, "missing"), (9, "late"), (10, "missing")]
    assert {r["n"] for r in orphan_counts(out).collect()} == {1, 3}
    assert _orphans(spark, [], [], [], []).count() == 0


def test_orphans_with_a_hot_key(spark):
    n = 4000
    kids = [(i, "s", "HOT", T0 + timedelta(hours=i % 3)) for i in range(n)] + [(n + i, "s", f"R{i}", T0) for i in range(50)]
    out = _orphans(spark, kids, [("s", "hot", T0 + timedelta(hours=49))] * 500 + [("s", f"R{i}", T0) for i in range(0, 50, 2)], [], [])
    assert out.count() == len([i for i in range(n) if i % 3 < 1]) + 25


SIDE = "tx_id long, source string, a string, b long"


def test_copy_differences(spark):
    left = [(1, "psp", "x", 1), (2, "psp", "y", 2), (3, "bank", "z", None), (4, "bank", "w", 4), (5, "bank", None, 5), (40, "psp", "q", 1), (None, "psp", "n", 1), (7, "psp", "k", 7)]
    right = [(1, "psp", "x", 1), (1, "psp", "x", 1), (2, "psp", "y", 3), (3, "bank", "z", None), (4, "bank", "W", 5), (5, "bank", "v", 5), (41, "psp", "q", 1), (7, "psp", "k", 7), (7, "psp", "k", 8)]
    got = lambda a, b: sorted((r["tx_id"] or 0, r["source"], r["field"]) for r in copy_differences(spark.createDataFrame(a, SIDE), spark.createDataFrame(b, SIDE), "tx_id", ["a", "b"], "source", {"b": ["psp"]}).collect())
    assert got(left, right) == [(0, "psp", "only_in_source"), (2, "psp", "b"), (4, "bank", "a"), (5, "bank", "a"), (7, "psp", "b"), (40, "psp", "only_in_source"), (41, "psp", "only_in_store")]
    assert got([], []) == [] and got(left[:1], []) == [(1, "psp", "only_in_source")] and got(left, left) == [(0, "psp", "only_in_source"), (0, "psp", "only_in_store")]


def test_copy_differences_reads_only_unequal_buckets(spark):
    left = [(i, "psp", f"v{i}", i) for i in range(5000)]
    right = [(i, "psp", f"v{i}", i + (i == 777)) for i in range(5000)] + [(10, "psp", "v10", 10)] * 2000
    out = copy_differences(spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE), "tx_id", ["a", "b"], "source").collect()
    assert [(r["tx_id"], r["field"]) for r in out] == [(777, "b")]
