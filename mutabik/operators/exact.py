"""Exact 1:1 pass: same counterparty, reference, amount and direction, at most three days apart.

Keys with one row on each side are a plain join. For the others, rows of one instant are counted,
and each key's short list of (instant, side, count) is walked once: both sides are in time order, so
the first open partner in reach is the front of a queue. The walk gives ranges of copies that pair
up; rows find their pair number by their rank among the copies of their instant. Copies are thus
never gathered in one place, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mutabik.config import DAY_US, MATCH_WINDOW_DAYS
from mutabik.operators.features import within
from mutabik.shared import shared_table

GROUP = ["cp", "ref", "amount", "direction"]
REACH = (MATCH_WINDOW_DAYS + 1) * DAY_US
#: Copies of one instant are ranked in slices of so many ids.
SLICE = 100_000


def pair_ranges(events: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(side, us, first rank, first pair, copies) of the copies that pair up; events: (us, side, count)."""
    queues = ([list(x) for x in sorted((u, n) for u, s, n in events if s == 0)], [list(x) for x in sorted((u, n) for u, s, n in events if s == 1)])
    done: dict[tuple[int, int], int] = {}
    out, pair, i, j = [], 0, 0, 0
    e, a = queues
    while i < len(e) and j < len(a):
        if a[j][0] <= e[i][0] - REACH:
            j += 1
        elif a[j][0] >= e[i][0] + REACH:
            i += 1
        else:
            n = min(e[i][1], a[j][1])
            for side, q, k in ((0, e, i), (1, a, j)):
                at = done.get((side, q[k][0]), 0)
                out.append((side, q[k][0], at, pair, n))
                done[(side, q[k][0])] = at + n
                q[k][1] -= n
            pair += n
            i, j = i + (e[i][1] == 0), j + (a[j][1] == 0)
    return out


def _walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for g in p.itertuples(index=False):
            rows += [(*g[:4], *r) for r in pair_ranges([(x["us"], x["side"], x["n"]) for x in g.events])]
        yield pd.DataFrame(rows, columns=[*GROUP, "side", "us", "first_rank", "first_pair", "n"])


def exact_pairs(pool: DataFrame) -> DataFrame:
    """e_id, a_id of the pass."""
    rows = pool.where("ref <> ''").select("tx_id", *GROUP, "side", "us", "source", "gross0")
    sides = rows.groupBy(*GROUP).agg(F.count_if(F.col("side") == 0).alias("n_e"), F.count_if(F.col("side") == 1).alias("n_a"), F.max(F.when(F.col("side") == 0, F.struct("tx_id", "us"))).alias("e"), F.max(F.when(F.col("side") == 1, F.struct("tx_id", "us"))).alias("a")).where("n_e > 0 and n_a > 0")
    single = sides.where("n_e = 1 and n_a = 1").where(within(F.col("e.us"), F.col("a.us"), MATCH_WINDOW_DAYS)).select(F.col("e.tx_id").alias("e_id"), F.col("a.tx_id").alias("a_id"))
    many = shared_table(rows.join(sides.where("n_e > 1 or n_a > 1").select(*GROUP), GROUP, "left_semi"), "many")
    counts = many.groupBy(*GROUP, "us", "side").agg(F.count("*").alias("n"))
    events = counts.groupBy(*GROUP).agg(F.collect_list(F.struct("us", "side", "n")).alias("events"))
    ranges = events.mapInPandas(_walk, "cp string, ref string, amount bigint, direction string, side int, us bigint, first_rank bigint, first_pair bigint, n bigint")
    at = [*GROUP, "side", "us"]
    sliced = many.withColumn("slice", F.struct("source", "gross0", F.floor(F.col("tx_id") / SLICE).alias("s")))
    base = sliced.groupBy(*at, "slice").agg(F.count("*").alias("m"))
    base = base.withColumn("before", F.sum("m").over(Window.partitionBy(*at).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).drop("m")
    ranked = sliced.join(base, [*at, "slice"]).withColumn("r", F.row_number().over(Window.partitionBy(*at, "slice").orderBy("tx_id")) - 1 + F.coalesce("before", F.lit(0)))
    numbered = ranked.join(ranges, at).where((F.col("r") >= F.col("first_rank")) & (F.col("r") < F.col("first_rank") + F.col("n")))
    numbered = numbered.select("tx_id", *GROUP, "side", (F.col("first_pair") + F.col("r") - F.col("first_rank")).alias("pair"))
    e = numbered.where("side = 0").select(F.col("tx_id").alias("e_id"), *GROUP, "pair")
    a = numbered.where("side = 1").select(F.col("tx_id").alias("a_id"), *GROUP, "pair")
    return single.unionByName(e.join(a, [*GROUP, "pair"]).select("e_id", "a_id"))
