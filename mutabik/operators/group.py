"""Group N:1 pass: one marketplace payout against the set of orders that add up to its gross.

Payouts of one counterparty depend on each other through the orders they claim, so they are walked in
order, but only those that can depend on each other together: payouts whose windows surely hold too
many orders never search, and those left are cut into runs of overlapping windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mutabik.config import DAY_US, GROUP_CAP, GROUP_WINDOW_DAYS
from mutabik.shared import shared_table

WINDOW = GROUP_WINDOW_DAYS * DAY_US


def two_subsets(amounts: list[int], target: int) -> list[list[int]]:
    """The first two index sets with the target sum, in the order that prefers earlier items; amounts are positive.

    Halves are summed up in all ways; a set is a bit mask with item 0 as the highest bit, and the order
    wanted is that of falling masks.
    """
    n = len(amounts)
    if target <= 0 or sum(amounts) < target:
        return []
    h = n // 2

    def sums(part: list[int]) -> np.ndarray:
        out = np.zeros(1, dtype=object if target > 2**62 or sum(part) > 2**62 else np.int64)
        for x in part:  # the first item becomes the highest bit
            out = (out[:, None] + np.array([0, x], dtype=out.dtype)[None, :]).ravel()
        return out

    left, right = sums(amounts[:h]), sums(amounts[h:])
    order = np.argsort(right, kind="stable")
    ordered = right[order]
    need = target - left
    lo, hi = np.searchsorted(ordered, need, "left"), np.searchsorted(ordered, need, "right")
    found: list[int] = []
    for m in np.flatnonzero(hi > lo)[::-1]:
        found += [(int(m) << (n - h)) | int(x) for x in sorted(order[lo[m] : hi[m]], reverse=True)[: 2 - len(found)]]
        if len(found) >= 2:
            break
    return [[i for i in range(n) if f >> (n - 1 - i) & 1] for f in found]


def walk(orders: list[tuple[int, int, int]], payouts: list[tuple[int, int, int]], cap: int = GROUP_CAP) -> list[tuple[str, int, int]]:
    """(what, payout id, order id or -1): 'member', 'overflow', 'unsure payout', 'unsure order'.

    orders: (id, us, amount), payouts: (id, us, gross), both in pool order.
    """
    claimed: set[int] = set()
    doubtful: set[int] = set()
    times = [o[1] for o in orders]
    out: list[tuple[str, int, int]] = []
    for pid, at, gross in payouts:
        lo, hi = np.searchsorted(times, at - WINDOW, "left"), np.searchsorted(times, at, "right")
        near = [k for k in range(lo, hi) if k not in claimed]
        if len(near) > cap:
            out.append(("overflow", pid, -1))
            continue
        sets = two_subsets([orders[k][2] for k in near], gross)
        if not sets:
            continue
        chosen = [near[i] for i in sets[0]]
        if len(sets) > 1 or any(k in doubtful for k in chosen):
            out.append(("unsure payout", pid, -1))
            for k in dict.fromkeys(near[i] for s in sets for i in s):
                if k not in doubtful:
                    doubtful.add(k)
                    out.append(("unsure order", pid, orders[k][0]))
            continue
        claimed.update(chosen)
        out += [("member", pid, orders[k][0]) for k in chosen]
    return out


def _kernel(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        done: list[tuple[str, int, int]] = []
        for orders, payouts in zip(p["orders"], p["payouts"]):
            o = sorted((r["us"], r["ref"], r["amount"], r["tx_id"]) for r in orders)
            q = sorted((r["us"], r["ref"], r["amount"], r["gross0"], r["tx_id"]) for r in payouts)
            done += walk([(i, us, a) for us, _, a, i in o], [(i, us, g) for us, _, _, g, i in q])
        yield pd.DataFrame(done, columns=["what", "payout_id", "order_id"]).astype({"payout_id": "int64", "order_id": "int64"})


def group_outcomes(pool: DataFrame) -> DataFrame:
    """what, payout_id, order_id (-1 for rows about the payout itself); see ``walk``."""
    cols = ["tx_id", "cp", "ref", "side", "us", "amount", "direction", "gross0"]
    orders = pool.where("side = 0 and direction = 'credit' and amount > 0").select(*cols)
    payouts = pool.where("source = 'marketplace' and direction = 'credit' and gross0 > 0").select(*cols)
    orders = orders.join(payouts.select("cp").distinct(), "cp", "left_semi")
    day = lambda c: F.floor(c / F.lit(DAY_US)).cast("int")
    per_day = orders.groupBy("cp", day(F.col("us")).alias("d")).agg(F.count("*").alias("n"))
    at = payouts.groupBy("cp", "us").agg(F.count("*").alias("k"))  # payouts of one instant share their window
    inner = at.withColumn("d", F.explode(F.sequence(day(F.col("us")) - GROUP_WINDOW_DAYS + 1, day(F.col("us")) - 1)))
    least = at.join(inner.join(per_day, ["cp", "d"]).groupBy("cp", "us").agg(F.sum("n").alias("sure")), ["cp", "us"], "left").withColumn("sure", F.coalesce("sure", F.lit(0)))
    # An earlier payout takes at most the cap; whoever holds more than all of them could take never searches.
    earlier = F.sum("k").over(Window.partitionBy("cp").orderBy("us").rangeBetween(-2 * WINDOW, 0))
    least = shared_table(least.withColumn("sure_over", F.col("sure") > GROUP_CAP * earlier), "payout-windows")
    over = payouts.join(least.where("sure_over").select("cp", "us"), ["cp", "us"], "left_semi").select(F.lit("overflow").alias("what"), F.col("tx_id").alias("payout_id"), F.lit(-1).cast("bigint").alias("order_id"))
    w = Window.partitionBy("cp").orderBy("us")
    fresh = (F.col("us") - F.lag("us").over(w) > WINDOW).cast("int")
    runs = least.where("not sure_over").withColumn("run", F.sum(F.coalesce(fresh, F.lit(0))).over(w))
    spans = runs.groupBy("cp", "run").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    mine = payouts.join(runs.select("cp", "us", "run"), ["cp", "us"]).select(*cols, "run")
    cell = lambda c: F.floor(c / F.lit(WINDOW)).cast("int")
    reach = spans.withColumn("c", F.explode(F.sequence(cell(F.col("lo") - WINDOW), cell(F.col("hi")))))
    near = orders.withColumn("c", cell(F.col("us"))).join(reach, ["cp", "c"]).where((F.col("us") >= F.col("lo") - WINDOW) & (F.col("us") <= F.col("hi"))).select(*cols, "run")
    one = F.struct("us", "ref", "amount", "gross0", "tx_id")
    both = mine.unionByName(near).groupBy("cp", "run").agg(*[F.collect_set(F.when(F.col("side") == v, one)).alias(n) for v, n in ((0, "orders"), (1, "payouts"))])  # bounded, see above
    found = both.select("orders", "payouts").mapInPandas(_kernel, "what string, payout_id bigint, order_id bigint")
    return over.unionByName(found)
