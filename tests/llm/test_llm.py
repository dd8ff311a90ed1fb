"""Operators on texts and noisy records against brute force, round trips and held-out accuracy."""

import math
import random
import re
import time
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("mutabik.llm")
from mutabik.llm import history_dedup as hd  # noqa: E402
from mutabik.llm import mixing, packing, sentences  # noqa: E402
from mutabik.llm.linkage import link  # noqa: E402
from mutabik.llm.nearest_time import nearest_in_time  # noqa: E402
from mutabik.llm.tokens import count_tokens, token_sizes  # noqa: E402
from mutabik.shared import shared_path  # noqa: E402

T0 = datetime(2026, 6, 1)
SALE = "id long, counterparty string, ref string, amount long, occurred_at timestamp, direction string"


# ---- 3: history deduplication


def brute_repeats(rows):
    taken, out = defaultdict(list), set()
    for i, cp, ref, a, at, d in sorted(rows, key=lambda r: r[0]):
        if None in (cp, ref, a, at, d) or not ref.strip():
            continue
        n = re.sub("[^A-Za-z0-9]", "", ref).upper()
        for j, m, b, t in taken[cp, d]:
            if abs(a - b) * 200 <= b and abs(at - t) <= timedelta(hours=24) and osa(m, n) <= 1:
                out.add((j, i))
                break
        else:
            taken[cp, d].append((i, n, a, at))
    return out


def osa(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1]


@settings(max_examples=300, deadline=None)
@given(st.text("AB1", max_size=6), st.text("AB1", max_size=6))
def test_one_slip_is_the_edit_distance(a, b):
    assert hd.one_slip(a, b) == (osa(a, b) <= 1)


def test_keys_lose_no_pair(spark):
    rng = random.Random(3)
    pairs = []
    for n in range(0, 30):
        for _ in range(12):
            a = "".join(rng.choices("ABC123", k=n))
            b = list(a)
            k = rng.randrange(n + 1)
            what = rng.choice(["sub", "add", "cut", "swap"])
            if what == "sub" and k < n:
                b[k] = "Z"
            elif what == "add":
                b.insert(k, "Z")
            elif what == "cut" and k < n:
                del b[k]
            elif k + 1 < n:
                b[k], b[k + 1] = b[k + 1], b[k]
            pairs.append((a, "".join(b)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(~F.arrays_overlap(hd._keys(F.col("a")), hd._keys(F.col("b")))).count() == 0


def _sales(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        if rows and rng.random() < 0.5:
            _, cp, ref, a, at, d = rng.choice(rows)
            if ref and rng.random() < 0.6:
                k = rng.randrange(len(ref))
                ref = rng.choice([ref, ref.lower(), ref[:k] + ref[k + 1 :], ref[:k] + "9" + ref[k:], ref[:k] + ref[k : k + 2][::-1] + ref[k + 2 :]])
            rows.append((i, cp, ref, max(0, a + rng.choice([0, 0, 1, -1, a // 200, a // 150])), at + timedelta(hours=rng.choice([0, 1, -3, 20, 23, 25])), d))
        else:
            rows.append((i, rng.choice(["s1", "s2"]), rng.choice(["", None, "-", "A", "AB", "#ORD-%04d" % rng.randrange(40), "W%012d" % rng.randrange(30)]), rng.choice([0, 100, 5000, 123456]), T0 + timedelta(hours=rng.randrange(200)), rng.choice(["credit", "debit"])))
    return rows


@pytest.mark.parametrize("seed,driver_pairs", [(1, 1000), (2, 0)])
def test_batches_equal_brute_force(spark, seed, driver_pairs):
    rows = _sales(seed, 260)
    runs = hd.HistoryRuns(spark, shared_path(spark, "t"), max_runs=2, driver_pairs=driver_pairs)
    for k in range(0, 260, 65):
        runs.add(spark.createDataFrame(rows[k : k + 65], SALE))
    got = [(r["id"], r["repeat_id"]) for r in runs.found().collect()]
    assert set(got) == brute_repeats(rows) and len(got) == len(set(got))
    assert len(runs.runs) < 4


def test_a_batch_reads_no_run_out_of_reach(spark, monkeypatch):
    runs, opened = hd.HistoryRuns(spark, shared_path(spark, "t"), max_runs=2), []
    near = hd.HistoryRuns._near
    monkeypatch.setattr(hd.HistoryRuns, "_near", lambda self, fresh, n, lo, hi: opened.append(sum(r.hi >= lo - self.window_us and r.lo <= hi + self.window_us for r in self.runs)) or near(self, fresh, n, lo, hi))
    for k in range(10):  # a day a week; what is near stays the same however long the history
        runs.add(spark.createDataFrame([(10 * k + i, "s", "ORD-%07d" % i, 100, T0 + timedelta(days=7 * k), "credit") for i in range(3)], SALE))
    assert opened[-3:] == [0, 0, 0] and {r.level for r in runs.runs} == {0, 2}


def test_only_near_amounts_of_the_history_are_keyed(spark, monkeypatch):
    runs, passed, shared = hd.HistoryRuns(spark, shared_path(spark, "t")), [], hd.HistoryRuns._shared

    def counted(self, old, asked, key, most):
        out = shared(self, old, asked, key, most)
        passed.append(out.count())
        return out

    amounts = [0, *(s * a for s in (1, -1) for a in [1, 199, 200, 201, *(1000 * 2**k for k in range(30)), 3 * 2**60])]
    old = [(i, "s", "ORD-%07d" % (i * 9973), a, T0 + timedelta(minutes=i), "credit") for i, a in enumerate(amounts)]
    runs.add(spark.createDataFrame(old, SALE))
    monkeypatch.setattr(hd.HistoryRuns, "_shared", counted)
    new = [(1000, "s", old[20][2], amounts[20] + amounts[20] // 250, T0, "credit"), (1001, "s", old[0][2], 0, T0, "credit")]
    runs.add(spark.createDataFrame(new, SALE))
    assert passed[0] == 2  # of a seller's day, before any key is made
    assert {(r["id"], r["repeat_id"]) for r in runs.found().collect()} == brute_repeats(old + new) and len(brute_repeats(old + new)) == 2


def test_a_batch_opens_only_its_files(spark, tmp_path, monkeypatch):
    from mutabik.llm import queries

    rows = [(*r, None if r[0] < 60 else r[0] // 60) for r in _sales(6, 720)]
    for k in range(12):
        df = spark.createDataFrame(rows[60 * k : 60 * k + 60], SALE + ", batch_id long").withColumnsRenamed({"id": "psp_id", "amount": "amount_kurus"})
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "of 1%" / "psp.parquet"))
    tasks, add = [], hd.HistoryRuns.add
    monkeypatch.setattr(hd.HistoryRuns, "add", lambda self, df: tasks.append(df.select("id").rdd.getNumPartitions()) or add(self, df))
    got = queries.p3_found(spark, str(tmp_path / "of 1%")).collect()
    assert tasks == [1] * 12
    assert {tuple(r) for r in got} == brute_repeats(rows := [r[:6] for r in rows]) and len(got) == len(brute_repeats(rows))


def test_batches_leave_nothing_on_the_driver(spark, monkeypatch):
    """Broadcasts of a batch are given back before the next, long before a merge; few verdicts take no job; plans stay short."""
    from pyspark.sql import functions as F

    rows, written, write = _sales(9, 240), [], hd.HistoryRuns._write
    monkeypatch.setattr(hd.HistoryRuns, "_write", lambda self, df, name, **seen: written.append(name) or write(self, df, name, **seen))
    runs = hd.HistoryRuns(spark, shared_path(spark, "t"))
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus
    held = lambda: (m := status().head()._2())._1() - m._2()
    spark.sparkContext._jvm.System.gc()
    time.sleep(3)
    before = held()
    for k in range(0, 240, 40):
        runs.add(spark.createDataFrame(rows[k : k + 40], SALE))
    until = time.time() + 20
    while held() > before + 500_000 and time.time() < until:  # the cleaner runs by itself
        time.sleep(0.2)
    assert held() <= before + 500_000
    assert written == ["run", "pairs"] * 6
    keys = spark.createDataFrame(rows, SALE).select(hd._keys(F.col("ref")).alias("k"))
    assert len(keys._jdf.queryExecution().executedPlan().toString()) < 1500
    assert {(r["id"], r["repeat_id"]) for r in runs.found().collect()} == brute_repeats(rows)


def test_verdicts_of_both_kinds_meet(spark):
    rows = _sales(9, 240)
    runs = hd.HistoryRuns(spark, shared_path(spark, "t"), driver_pairs=60)
    for k in range(0, 240, 40):
        runs.add(spark.createDataFrame(rows[k : k + 40], SALE))
    assert any(r.n_bad and r.verdicts for r in runs.runs) and any(r.n_bad and not r.verdicts for r in runs.runs)
    apart = {(r["id"], r["repeat_id"]) for r in runs.found().collect()}
    runs.compact(0)
    assert apart == {(r["id"], r["repeat_id"]) for r in runs.found().collect()} == brute_repeats(rows)


def test_bit_sets_lose_no_row(spark, monkeypatch):
    rows = _sales(4, 200)
    monkeypatch.setattr(hd, "broadcast_fits", lambda rows, columns: False)
    runs = hd.HistoryRuns(spark, shared_path(spark, "t"))
    for k in range(0, 200, 100):
        runs.add(spark.createDataFrame(rows[k : k + 100], SALE))
    assert {(r["id"], r["repeat_id"]) for r in runs.found().collect()} == brute_repeats(rows)


def test_history_dedup_edges(spark):
    rows = [(1, "s", "ORD-1234567", 100, T0, "credit"), (1, "s", "ORD-1234567", 100, T0, "credit"), (2, None, "ORD-1234567", 100, T0, "credit"), (None, "s", "ORD-1234567", 100, T0, "credit"), (3, "s", "X" * 5000, 1, T0, "credit"), (4, "s", "X" * 5001, 1, T0, "credit"), (5, "s", "  ", 1, T0, "credit"), (6, "s", "ORD1234567", None, T0, "credit")]
    rows += [(10 + i, "s", "HOT/0000001", 700, T0, "debit") for i in range(3000)]
    runs = hd.HistoryRuns(spark, shared_path(spark, "t"))
    df = spark.createDataFrame([(*r, "x") for r in rows], SALE + ", grp string")
    runs.add(df.limit(0))
    assert runs.found().count() == 0
    runs.add(df)
    got = {(r["id"], r["repeat_id"]) for r in runs.found().collect()}
    assert got == {(3, 4)} | {(10, 10 + i) for i in range(1, 3000)}


# ---- 5: nearest in time


def _nearest_input(spark, tmp_path, left, right):
    for n, rows in (("l", left), ("r", right)):
        for k in range(0, max(len(rows), 1), max(1, len(rows) // 4)):
            spark.createDataFrame(rows[k : k + max(1, len(rows) // 4)], "id long, entity string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / n))
    same = lambda df: df
    return (str(tmp_path / "l"), same), (str(tmp_path / "r"), same)


@pytest.mark.parametrize("delay", ["30 days", "2 hours"])
def test_nearest_equals_brute_force_at_any_lateness(spark, tmp_path, delay):
    rng = random.Random(5)
    at = lambda: T0 + timedelta(minutes=rng.randrange(0, 60 * 24 * 6))
    right = [(i, rng.choice(["a", "b"]), at()) for i in range(400)] + [(900, None, T0), (901, "a", None)]
    left = [(1000 + i, rng.choice(["a", "b", "c"]), at()) for i in range(160)] + [(2000, "a", right[0][2])] * 2 + [(None, "a", T0)]
    best = {}
    for i, e, t in left:
        near = [(abs(t - u), j) for j, f, u in right if i is not None and f == e and u is not None and abs(t - u) <= timedelta(hours=4)]
        if near:
            best[i] = min(near)[1]
    out = nearest_in_time(spark, *_nearest_input(spark, tmp_path, left, right), delay=delay, slice_hours=9, lanes=3)
    assert {(r["left_id"], r["right_id"]) for r in out.collect()} == set(best.items())


def test_nearest_of_empty_tables(spark, tmp_path):
    assert nearest_in_time(spark, *_nearest_input(spark, tmp_path, [], []), lanes=2).count() == 0


# ---- 6: linkage


def test_linkage(spark):
    d = lambda n: T0 + timedelta(days=n)
    sellers = [("s1", "Kasalar Mobilya Tic. A.Ş."), ("s2", "Volminar Gıda Ltd. Şti."), ("s3", "Kasalar Optik"), ("s4", None)]
    sales = [(1, "s1", "ORD-AB12CD34", 10000, d(1)), (2, "s1", "ORD-ZZ99YY88", 5000, d(1)), (3, "s2", "W0123456789", 7000, d(2)), (4, "s3", "SP11/2233", 10000, d(1)), (5, "s2", "W0999", 800, d(2)), (6, "s2", "W0998", 800, d(2)), (None, "s2", "W0998", 801, d(2)), (7, "s1", "ORD-PAID0001", 6000, d(1))]
    pay = [(10, "KASALAR MOBILYA", "sip AB12CD", 9900, d(3)), (11, "kasallar mobilya", "HAVALE", 5000, d(2)), (12, "EFT Volmnar Gıda", None, 7000, d(3)), (13, "Volminar Gıda", "", 800, d(3)), (14, "Vergi Dairesi", None, 10000, d(2)), (15, "Volminar Gıda", "", 7000, d(9)), (16, None, "x", 5, d(1)), (17, "KASALAR MOBILYA", "sip PAID0001", 6000, d(2)), (18, "KASALAR MOBILYA", "sip QQ12QQ34", 9950, d(2)), (10, "KASALAR MOBILYA", "sip AB12CD", 9900, d(3))]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    args = lambda p, s: (frame(p, "payment_id long, name string, ref_text string, amount long, at timestamp"), frame(s, "sale_id long, entity string, ref string, amount long, at timestamp"), frame(sellers, "entity string, seller_name string"), frame([("s1", "ord paid0001")], "entity string, ref string"))
    pay += [(100 + i, f"Nobody{i} Ticaret", "sip havale", 1, d(1)) for i in range(30)]
    got = {(r["payment_id"], r["sale_id"]) for r in link(*args(pay, sales)).collect()}
    assert got == {(10, 1), (11, 2), (12, 3)}
    assert link(*args([], [])).count() == 0


# ---- 7: packing


def brute_place(capacity, sizes):
    fill = []
    for s in sizes:
        def cost(k):
            f = fill + [0] if k == len(fill) else list(fill)
            f[k] += s
            n = np.bincount([x for x in f if x < capacity] or [0], minlength=capacity)
            return int((n[1:] ** 2).sum()), -(fill[k] if k < len(fill) else 0)
        best = min((k for k in range(len(fill) + 1) if (fill[k] if k < len(fill) else 0) + s <= capacity and (k == len(fill) or fill[k] < capacity)), key=lambda k: cost(k))
        fill = fill + [s] if best == len(fill) else [x + s * (i == best) for i, x in enumerate(fill)]
    return sorted(fill)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=25))
def test_sum_of_squares_rule(sizes):
    a = packing.LevelArray(12)
    for s in sizes:
        a.place(s)
    assert sorted(a.fill) == brute_place(12, sizes)
    assert sum((a.count[1:] ** 2)) == sum(v * v for v in np.bincount([x for x in a.fill if x < 12] or [0], minlength=13)[1:])


def test_packing_keeps_everything(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, None, 1, 7, 40, 100, 101, 250, 1000])) for i in range(900)] + [(None, 33), (5, 12), (5, 12)]
    packs = spark.createDataFrame([("s", 100), ("l", 512), ("bad", 0), (None, 5)], "pack_name string, capacity_tokens int")
    sizes = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, tokens long, container string")
    for lane in (50, 10_000):
        p = packing.pack_items(sizes, packs, lane).toPandas()
        for name, cap in (("s", 100), ("l", 512)):
            q = p[p.pack_name == name]
            assert q.tokens.sum() == sum(t or 0 for _, t in rows)
            fill = q[q.tokens > 0].groupby("container").tokens.sum()
            assert fill.max() <= cap
            assert ((q.tokens > 0) == q.container.notna()).all()
            pieces = q[q.tokens > 0].groupby(["doc_id", "piece"]).tokens.max()
            assert all(t == cap for (d, k), t in pieces.items() if (d, k + 1) in pieces.index)
            assert q[q.tokens > 0].tokens.sum() / (len(fill) * cap) > 0.93
        assert set(p.pack_name) == {"s", "l"}
        f = packing.container_fill(packing.pack_items(sizes, packs, lane), packs).toPandas()
        assert (f.fill + f.unused == f.pack_name.map({"s": 100, "l": 512})).all()
    none = sizes.limit(0)
    assert packing.pack_items(none, packs).count() == 0


def test_token_sizes(spark):
    long = "çok güzel ürün 很好 " * 20_000
    rows = [(1, None), (2, ""), (3, "merhaba dünya"), (4, long), (5, "<|endoftext|>")]
    got = {r["doc_id"]: r["tokens"] for r in token_sizes(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {i: count_tokens(t) for i, t in rows} and got[1] == got[2] == 0 and got[4] > 100_000


# ---- 8: mixing


def test_exponents():
    q, p = {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 0.2, "b": 0.3, "c": 0.5}
    assert mixing.weights_at(q, p, 1.0) == pytest.approx(p) and mixing.weights_at(q, p, 0.0) == pytest.approx(q)
    most = {"a": 700.0, "b": 400.0, "c": 200.0}
    a = mixing.exponent_for_limits(q, p, 1000, most)
    w = mixing.weights_at(q, p, a)
    assert 0 < a < 1 and all(1000 * w[s] <= most[s] * 1.0001 for s in w) and 1000 * mixing.weights_at(q, p, a + 0.01)["c"] > most["c"]
    assert mixing.exponent_for_limits(q, p, 1000, {**most, "a": 600.0}) > 0 and mixing.exponent_for_limits(q, p, 1000, {s: 1.0 for s in q}) is None
    e = mixing.exponent_for_targets(q, p, 0.01)
    assert 0 < e < 1 and max(abs(v - p[s]) for s, v in mixing.weights_at(q, p, e).items()) == pytest.approx(0.01, abs=1e-9)
    assert mixing.exponent_for_targets(q, q, 0.01) == 0.0
    none = mixing.plan_mix("m", p, {"a": 1, "b": 1, "c": 1}, {"a": 70, "b": 20, "c": 10}, 100, 2.0, 0.002)
    assert not any(x.feasible for x in none) and [x.passes for x in none] == [1, 1, 1] and none[0].wanted == 200
    t = mixing.exponent_for_entropy(q, 1.0)
    r = {s: v**t for s, v in q.items()}
    assert mixing.entropy({s: v / sum(r.values()) for s, v in r.items()}) == pytest.approx(1.0, abs=1e-6)
    assert mixing.entropy(q) < 1.0 < math.log(3)


def test_mixing_meets_shares_and_limits(spark):
    rng = random.Random(4)
    rows = [(i, rng.choices(["big", "mid", "tiny", None], [70, 25, 4, 1])[0], rng.randrange(0, 60)) for i in range(6000)]
    rows += rows[:100]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    goals = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "tiny", 0.2, 5), ("n", "tiny", 0.9, 3), ("n", "none", 0.1, 3), ("n", "big", 0.1, None)]
    targets = spark.createDataFrame(goals, "mix_name string, source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix_sources(sizes, targets)
    c, s = chosen.toPandas(), shares.toPandas()
    limit = {(m, x): r for m, x, _, r in goals}
    assert all(1 <= r.repeats <= limit[r.mix_name, r.source] for r in c.itertuples())
    assert not c.duplicated(["mix_name", "doc_id", "source", "tokens"]).any()
    m = s[s.mix_name == "m"].set_index("source")
    assert m.reached_share.to_dict() == pytest.approx({"big": 0.5, "mid": 0.3, "tiny": 0.2}, abs=0.005)
    have = {x: sum(t for _, y, t in set(rows) if y == x) for x in ("big", "mid", "tiny")}
    assert m.tokens.sum() >= 0.98 * min(have["big"] / 0.5, 2 * have["mid"] / 0.3, 5 * have["tiny"] / 0.2, sum(t for _, _, t in set(rows)))
    assert s[(s.mix_name == "n") & (s.source == "tiny")].reached_share.item() == 1.0
    got = c.assign(t=c.tokens * c.repeats).groupby(["mix_name", "source"]).t.sum()
    assert all(got.get((r.mix_name, r.source), 0) == r.tokens for r in s.itertuples())
    assert 0.9 < m.exponent.iloc[0] < 1 and m.feasible.all()
    tempered = mixing.mix_sources(sizes, targets, 1.2)[1].toPandas()
    assert 0 < tempered[tempered.mix_name == "m"].exponent.iloc[0] < 1 and tempered.feasible.all()
    no_ids = spark.createDataFrame([(None, "big", 5)] * 40 + [(None, "tiny", 5)] * 20, sizes.schema)
    assert mixing.mix_sources(no_ids, targets)[0].where("mix_name = 'm' and source = 'big'").count() == 40
    again = mixing.mix_sources(sizes.repartition(7), targets)[0].toPandas()
    key = ["mix_name", "source", "doc_id", "tokens"]
    assert again.sort_values(key).reset_index(drop=True).equals(c.sort_values(key).reset_index(drop=True))
    assert mixing.mix_sources(sizes.limit(0), targets)[0].count() == 0
    assert mixing.mix_sources(sizes, targets.limit(0))[1].count() == 0


# ---- 9: sentences

UNITS = {
    "tr": ["Dr. Ak Bey bunu önerdi.", "Fiyatı 1.904,90 TL idi!", "“Güzelmiş. Bir tane daha alalım,” dedi eşim.", "Kablo, kılıf vb. parçalar çıktı.", "Bekledim... bekledim ve sonunda geldi.", "Bu ürün iyi… 👍"],
    "en": ["The U.K. plug is missing.", "It arrived at 9 a.m. on the dot.", "See p. 39 of the manual, i.e. the part on cleaning.", "“I love it!” said my daughter and ran off.", "Really?!", "(The courier was kind, too.)", "This pan is heavy."],
    "de": ["Am 3. Tag war er da, d. h. früher als gedacht.", "„Gut so. Wir nehmen noch einen“, sagte mein Mann.", "Der Topf ist gut."],
    "ja": ["店員は「大丈夫です。すぐ届きます。」と言いました。", "この枕は値段以上でした！！", "説明書のp. 44を見てください。"],
    "zh": ["高度是2.4厘米，宽度30厘米。", "女儿说“太漂亮了！”然后就跑开了。", "等了很久……终于到了。"],
    "ru": ["Высота 6,1 см, т. е. чуть больше обычной.", "«Какая красота!» — сказала дочь и убежала.", "Новый стул хорош."],
    "hi": ["यह बैग 49 दिन बाद आया।", "डॉ. वेल्कन ने इसे सुझाया था।"],
    "th": ["กาน้ำใบนี้หนักประมาณ 7.5 กิโลค่ะ", "สูง 57.6 ซม. กว้าง 24 ซม. ครับ", "จะซื้ออีกไหมคะ?"],
}


def _texts(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        lang = rng.choice(list(UNITS))
        units = [rng.choice(UNITS[lang]) for _ in range(rng.randrange(1, 7))]
        text, starts = rng.choice(["", " ", "\t"]), []
        for k, u in enumerate(units):
            starts.append(len(text) + 1)
            text += u + ("" if k + 1 == len(units) else "" if lang in ("ja", "zh") else rng.choice([" ", " ", "  ", "\n", "\n\n"]))
        if rng.random() < 0.2:
            text += "\nIn short:\n- solid box\n- no plug"
            starts += [text.index("In short:") + 1, text.index("- solid") + 1, text.index("- no") + 1]
        out.append((text, starts))
    return out


def test_held_out_sentence_accuracy():
    model = sentences.fit(sentences.training_set([t for t, _ in _texts(1, 400)]))
    tp = fp = fn = 0
    for text, want in _texts(99, 300):
        got = set(sentences.starts_of(text, model))
        tp, fp, fn = tp + len(got & set(want)), fp + len(got - set(want)), fn + len(set(want) - got)
    assert tp / (tp + fp) > 0.97 and tp / (tp + fn) > 0.97


def test_unpunctuated_text_is_cut_by_its_words():
    clauses = ["这个台灯盒子被压扁了", "我妈妈的水壶很值这个价钱", "新买的背包全家都喜欢"]
    rng = random.Random(1)
    model = sentences.fit(sentences.training_set(["。".join(rng.choices(clauses, k=5)) + "。" for _ in range(200)]))
    text = clauses[0] + clauses[1] + clauses[2]
    assert sentences.starts_of(text, model) == [1, 1 + len(clauses[0]), 1 + len(clauses[0]) + len(clauses[1])]


UNMARKED = ["good pan it came early we like it", "çok iyi tava erken geldi beğendik", "अच्छा तवा जल्दी आया हमें पसंद है", "กาน้ำดีมากส่งเร็วชอบมาก", "ឆ្នាំងនេះល្អណាស់មកដល់លឿន"]


@pytest.mark.parametrize("text", UNMARKED)
def test_lines_without_marks_have_places(text):
    assert sentences.gaps(text) and all(0 < g.at < len(text) for g in sentences.gaps(text))


def test_lines_without_marks_are_cut_by_their_words():
    model = sentences.fit(sentences.training_set(t for t, _ in _texts(5, 600)))
    hit = made = true = 0
    for t, starts in _texts(6, 200):
        line, gold = sentences._bare(t, {x - 1 for x in starts[1:]})
        if sentences._MARK.search(line.strip()) or not gold:
            continue
        got = {x - 1 for x in sentences.starts_of(line, model)[1:]}
        hit, made, true = hit + len(got & gold), made + len(got), true + len(gold)
    assert true > 50 and hit / true > 0.8 and hit / max(1, made) > 0.8, (hit, made, true)


def test_a_quotation_of_any_length_is_one_unit():
    model = sentences.fit(sentences.training_set(t for t, _ in _texts(5, 300)))
    long = "“" + "I love it! " * 80 + "It is great,” said my daughter."
    assert sentences.starts_of(f"{long} The pan is heavy.", model) == [1, len(long) + 2]


def test_nearest_tells_large_ids_apart():
    from mutabik.llm.nearest_time import ROW, nearest

    left, right = np.array([(1, 7, 100)], ROW), np.array([(1, 2**60 + 1, 110), (1, 2**60, 90)], ROW)
    assert nearest(left, right, 50)["right_id"].tolist() == [2**60]


def test_viterbi_equals_enumeration():
    rng = random.Random(0)
    for _ in range(50):
        c = sentences.Chain()
        n = rng.randrange(1, 7)
        c.w = {f"f{i}": rng.uniform(-2, 2) for i in range(n)}
        t = [[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)]
        c.t = {False: t, True: t}
        score = lambda t: sum(c.w[f"f{i}"] for i in range(n) if t[i]) + sum(c.t[False][t[i - 1]][t[i]] for i in range(1, n))  # noqa: B023, E731
        best = max(([m >> i & 1 for i in range(n)] for m in range(2**n)), key=score)
        assert c.decode([[f"f{i}"] for i in range(n)]) == best


def test_sentence_edges(spark):
    rows = [(1, None, "tr"), (2, "", "tr"), (3, " \n\t ", None), (4, "Broken kettle", "en"), (5, "One. " * 30_000, "en"), (None, "A. B", "en"), (6, "😍", "x"), (6, "😍", "x"), (7, "”)) … !", None)] + [(10 + i, t, "en") for i, (t, _) in enumerate(_texts(3, 60))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, start_pos string")
    got = sentences.sentence_starts(docs).toPandas()
    assert not got.doc_id.isin([1, 2, 3]).any()
    assert got[got.doc_id == 4].start_pos.tolist() == [1] and (got.doc_id == 6).sum() == 2 and (got.doc_id == 5).sum() > 1000
    units = {r["unit"] for r in sentences.sentence_units(docs.where("doc_id = 4"), sentences.Chain()).collect()}
    assert units == {"Broken kettle"}
    assert sentences.sentence_starts(docs.limit(0)).count() == 0
