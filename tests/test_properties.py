"""Random books: every row placed once, no dependence on load order, no choice between equals."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mutabik.operators.exact import REACH, pair_ranges
from mutabik.operators.group import two_subsets, walk
from mutabik.plans.engine import outcomes, run
from mutabik.schema import TX, conform

T0 = datetime(2026, 6, 1)


def random_book(seed, n):
    """Collision-heavy rows of many small sellers: few amounts, few refs, few days."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        cp = f"s{rng.randrange(n // 8)}"
        src = rng.choice(["psp", "psp", "bank", "bank", "marketplace"])
        amount = rng.choice([1000, 1000, 1004, 2000, 3000])
        row = dict(tx_id=i, source=src, external_ref=rng.choice(["", "", "A", "A", "B", "Z"]), counterparty_ref=cp, amount=amount, currency="TRY", occurred_at=T0 + timedelta(days=rng.randrange(41)), direction=rng.choice(["credit", "credit", "credit", "debit"]))
        if src == "marketplace":
            row |= dict(direction="credit", gross=amount, commission=rng.choice([0, 100]))
            row["amount"] = amount - row["commission"]
        rows.append(row)
    return rows


def frame(spark, rows):
    return conform(spark.createDataFrame([{f.name: r.get(f.name) for f in TX} for r in rows], TX))


@pytest.mark.parametrize("seed", [11, 12])
def test_every_row_once_and_load_order_free(spark, seed):
    rows = random_book(seed, 900)
    out = run(frame(spark, rows))  # raises if a row isn't placed exactly once
    first = {r["tx_id"]: r["outcome"] for r in outcomes(out).collect()}
    assert set(first) == set(range(900))
    order = list(range(900))
    random.Random(seed).shuffle(order)
    moved = [{**r, "tx_id": order[r["tx_id"]]} for r in rows]
    second = {r["tx_id"]: r["outcome"] for r in outcomes(run(frame(spark, moved))).collect()}
    content = lambda r: tuple(str(r.get(c)) for c in ("source", "external_ref", "counterparty_ref", "amount", "occurred_at", "direction", "gross"))
    tally = lambda got, ids: sorted((content(r), got[ids(r["tx_id"])]) for r in rows)
    assert tally(first, lambda i: i) == tally(second, lambda i: order[i])


def test_one_hot_seller(spark):
    rows = [{**r, "counterparty_ref": "hot", "external_ref": r["external_ref"] and f"{r['external_ref']}{r['tx_id'] % 97}", "amount": r["amount"] + r["tx_id"] % 53 if r["source"] != "marketplace" else r["amount"]} for r in random_book(5, 1500)]
    got = {r["tx_id"] for r in outcomes(run(frame(spark, rows))).collect()}
    assert got == set(range(1500))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), max_size=14))
def test_queue_walk_takes_the_first_open_partner(rows):
    unit = REACH // 4
    e, a = sorted(d * unit for d, s in rows if s == 0), sorted(d * unit for d, s in rows if s == 1)
    used, want = set(), 0
    for x in e:
        k = next((k for k, y in enumerate(a) if k not in used and abs(x - y) < REACH), None)
        if k is not None:
            used.add(k)
            want += 1
    counts = {}
    for d, s in rows:
        counts[d * unit, s] = counts.get((d * unit, s), 0) + 1
    ranges = pair_ranges([(u, s, n) for (u, s), n in counts.items()])
    pairs = {0: {}, 1: {}}
    for side, us, at, pair, n in ranges:
        assert at + n <= counts[us, side]
        pairs[side].update({pair + k: us for k in range(n)})
    assert set(pairs[0]) == set(pairs[1]) and len(pairs[0]) == want
    assert all(abs(pairs[0][k] - pairs[1][k]) < REACH for k in pairs[0])
    assert sorted(pairs[1].values()) == sorted(a[k] for k in used)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=11), st.integers(0, 30))
def test_first_two_subsets(amounts, target):
    n = len(amounts)
    fits = [m for m in range(2**n - 1, 0, -1) if sum(a for i, a in enumerate(amounts) if m >> (n - 1 - i) & 1) == target]
    want = [[i for i in range(n) if m >> (n - 1 - i) & 1] for m in fits[:2]]
    assert two_subsets(amounts, target) == want


def test_subsets_of_large_amounts():
    big = 2**62
    assert two_subsets([big, 5, 7], big + 7) == [[0, 2]]
    assert two_subsets([3] * 20, 60) == [list(range(20))] and two_subsets([], 5) == []


def test_walk_counts_contested_but_not_claimed_orders():
    day = 86_400_000_000
    orders = [(k, day, 10 + k) for k in range(21)]
    assert walk(orders, [(99, 2 * day, 33)])[0] == ("overflow", 99, -1)
    got = walk(orders[:20] + [(50, 3 * day, 1000)], [(98, 2 * day, 10), (99, 4 * day, 1000)])
    assert ("member", 98, 0) in got and ("member", 99, 50) in got
