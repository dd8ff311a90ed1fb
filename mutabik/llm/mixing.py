"""Problem 8: mixing sources to target weights.

Temperature mixing. The weight of a source is its token share q times (target / q) to the power a:
a = 1 gives the targets, a = 0 the shares as they are. The exponent is bisected

* to the lowest at which every share lies within ``tolerance`` of its target; the budget is then the
  largest that the repetition limits allow, as a lower exponent repeats small sources less, or,
* where a budget is given, to the highest at which no source must be repeated beyond its limit; or
* to a target entropy.

Normalised weights become budgets in tokens. A budget is realised as whole passes over the source
and a part of one more, taken in the order of a hash (a permutation by blocks): the end of that part
is found in two histograms of 4096 blocks each, and only the last small block is sorted. A budget
that the limits don't allow at any exponent is never cut silently: the mix comes out as large as it
can be, marked as not feasible.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutabik.shared import shared_table

BITS = 12
#: Steps in which an exponent is sought before it is bisected.
STEPS = 1000


def weights_at(q: dict[str, float], p: dict[str, float], a: float) -> dict[str, float]:
    """Normalised q * (p / q) ** a; a source without tokens or target has 0."""
    raw = {s: (q[s] * (p[s] / q[s]) ** a if q[s] > 0 and p[s] > 0 else 0.0) for s in p}
    total = sum(raw.values())
    return {s: (v / total if total else 0.0) for s, v in raw.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def _bisect(low_ok, lo: float = 0.0, hi: float = 1.0, steps: int = 60) -> float:
    """The end of the range in which ``low_ok`` holds, going up from ``lo`` where it does."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if low_ok(mid) else (lo, mid)
    return lo


def exponent_for_limits(q: dict[str, float], p: dict[str, float], budget: float, most: dict[str, float]) -> float | None:
    """The largest exponent in 0..1 at which budget * weight <= most for every source; None if there is none."""
    fits = lambda a: all(budget * v <= most[s] * (1 + 1e-12) for s, v in weights_at(q, p, a).items())
    # A weight may rise and fall again with the exponent, so the step in which the bisection runs is sought from above.
    at = next((k for k in range(STEPS, -1, -1) if fits(k / STEPS)), None)
    if at is None or at == STEPS:
        return None if at is None else 1.0
    return _bisect(fits, at / STEPS, (at + 1) / STEPS)


def exponent_for_targets(q: dict[str, float], p: dict[str, float], tolerance: float) -> float:
    """The lowest exponent in 0..1 from which on every weight stays within ``tolerance`` of its target."""
    far = lambda a: any(abs(v - p[s]) > tolerance for s, v in weights_at(q, p, a).items())
    at = next((k for k in range(STEPS, -1, -1) if far(k / STEPS)), None)
    return 0.0 if at is None else 1.0 - _bisect(lambda b: not far(1.0 - b), 1 - (at + 1) / STEPS, 1 - at / STEPS)


def exponent_for_entropy(q: dict[str, float], target: float, steps: int = 60) -> float:
    """The temperature exponent t in 0..1 at which q ** t, normalised, has the target entropy."""
    uniform = {s: 1.0 for s in q}
    lo, hi = 0.0, 1.0  # as the exponent of uniform / q: entropy rises with it
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(weights_at(q, uniform, mid)) < target else (lo, mid)
    return 1.0 - (lo + hi) / 2


@dataclass(frozen=True)
class Plan:
    """What one mix takes from one source."""

    mix_name: str
    source: str
    target: float
    exponent: float
    wanted: int
    feasible: bool
    passes: int
    rest: int


def plan_mix(name: str, target: dict[str, float], limit: dict[str, int], have: dict[str, int], total: int, budget_share: float | None, tolerance: float) -> list[Plan]:
    """Budgets of one mix: ``budget_share`` of the tokens of its own sources, or None for the largest up to ``total``."""
    live = {s: t for s, t in target.items() if t > 0 and have.get(s, 0) > 0 and limit[s] > 0}
    if not live:
        return [Plan(name, s, t, 0.0, 0, False, 0, 0) for s, t in target.items()]
    norm = sum(live.values())
    p = {s: t / norm for s, t in live.items()}
    mine = sum(have[s] for s in live)
    q = {s: have[s] / mine for s in live}
    most = {s: float(limit[s] * have[s]) for s in live}
    largest = lambda a: min([total, *(int(most[s] / w) for s, w in weights_at(q, p, a).items() if w > 0)])
    feasible = True
    if budget_share is None:
        a = exponent_for_targets(q, p, tolerance)
        budget = wanted = largest(a)
    else:
        wanted = budget = int(budget_share * mine)
        a = exponent_for_limits(q, p, budget, most)
        if a is None:
            a, budget, feasible = 0.0, largest(0.0), False
    w = weights_at(q, p, a)
    out = []
    for s in target:
        b = min(int(budget * w[s]), int(most[s])) if s in live else 0  # the min only undoes rounding
        n = have.get(s, 0)
        passes = min(b // n, limit[s]) if n else 0
        out.append(Plan(name, s, target[s], a, wanted, feasible, int(passes), int(b - passes * n) if passes < limit[s] else 0))
    return out


#: Mixes are a short list of settings; more rows are refused.
MOST_GOALS = 10_000


def mix_sources(sizes: DataFrame, targets: DataFrame, budget_share: float | None = None, tolerance: float = 0.002, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(chosen reviews, shares reached).

    sizes: doc_id, source, tokens. targets: mix_name, source, target_share, max_repeats, at most
    ``MOST_GOALS`` rows (else ValueError). budget_share: wanted tokens of each mix as a part of the
    tokens of its sources; None takes the largest budget at which all shares are within ``tolerance``.
    Chosen: mix_name, source, doc_id, repeats, tokens. Shares: mix_name, source, target_share,
    reached_share, tokens, reviews, exponent, wanted_tokens, feasible.

    Defined results: a review given twice (same id, source and size) counts once, reviews with a null id
    each for themselves; a null source is in no mix; a source without tokens reaches 0 and its target
    goes to the others in proportion; a null share or limit counts as 0; a mix without any usable source
    is not feasible; empty tables give empty results.
    """
    spark = sizes.sparkSession
    rows = sizes.where("source is not null").select("doc_id", "source", "tokens")
    of = lambda *what: F.xxhash64(F.lit(seed), *what)
    # The order of a row is drawn once and kept; a row without an id gets one of its own.
    known = rows.where("doc_id is not null").distinct().withColumn("u", of("doc_id", "tokens"))
    docs = shared_table(known.unionByName(rows.where("doc_id is null").withColumn("u", of(F.monotonically_increasing_id()))), "mix-sizes")
    goals = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max("target_share").alias("p"), F.max("max_repeats").alias("r")).orderBy("mix_name", "source").limit(MOST_GOALS + 1).collect()
    if len(goals) > MOST_GOALS:
        raise ValueError(f"more than {MOST_GOALS} rows of mix targets")
    named = sorted({g["source"] for g in goals})
    have = {r["source"]: int(r["t"] or 0) for r in docs.where(F.col("source").isin(named)).groupBy("source").agg(F.sum("tokens").alias("t")).collect()} if named else {}
    all_tokens = int(docs.agg(F.sum("tokens")).first()[0] or 0)
    plans: list[Plan] = []
    for name in dict.fromkeys(g["mix_name"] for g in goals):
        mine = [g for g in goals if g["mix_name"] == name]
        target = {g["source"]: float(g["p"] or 0) for g in mine}
        tokens = {s: have.get(s, 0) for s in target}
        plans += plan_mix(name, target, {g["source"]: int(g["r"] or 0) for g in mine}, tokens, all_tokens, budget_share, tolerance)
    plan = spark.createDataFrame([(x.mix_name, x.source, x.target, x.exponent, x.wanted, x.feasible, x.passes, x.rest) for x in plans], "mix_name string, source string, target_share double, exponent double, wanted_tokens bigint, feasible boolean, passes int, rest bigint")
    drawn = docs.join(F.broadcast(plan.select("mix_name", "source", "passes", "rest")), "source").where("passes > 0 or rest > 0")  # at most MOST_GOALS rows, as all broadcasts here
    drawn = drawn.withColumn("u", F.xxhash64("mix_name", "u")).withColumn("b1", F.shiftrightunsigned("u", 64 - BITS)).withColumn("b2", F.shiftrightunsigned("u", 64 - 2 * BITS).bitwiseAND(F.lit((1 << BITS) - 1)))
    group = ["mix_name", "source"]

    def edge(rows: DataFrame, block: str, room: Column) -> DataFrame:
        """Per mix and source: the block in which the rest ends, and the room left when it begins."""
        h = rows.groupBy(*group, block).agg(F.sum("tokens").alias("t"), F.first("room").alias("room") if "room" in rows.columns else F.first("rest").alias("room"))
        upto = F.sum("t").over(Window.partitionBy(*group).orderBy(block)) - F.col("t")  # at most 4096 rows a group
        over = h.withColumn("before", upto).where("before < room")
        return over.groupBy(*group).agg(F.max(block).alias(f"{block}_edge"), F.max_by(F.col("room") - F.col("before"), block).alias("room"))

    part = drawn.where("rest > 0")
    e1 = edge(part, "b1", F.col("rest"))
    in1 = part.join(F.broadcast(e1), group).where("b1 = b1_edge")
    e2 = edge(in1, "b2", F.col("room"))
    edges = e1.drop("room").join(e2, group)
    marked = drawn.join(F.broadcast(edges), group, "left")
    before = (F.col("rest") > 0) & ((F.col("b1") < F.col("b1_edge")) | ((F.col("b1") == F.col("b1_edge")) & (F.col("b2") < F.col("b2_edge"))))
    at_edge = (F.col("rest") > 0) & (F.col("b1") == F.col("b1_edge")) & (F.col("b2") == F.col("b2_edge"))
    cells = marked.where(at_edge).withColumn("upto", F.sum("tokens").over(Window.partitionBy(*group).orderBy(F.shiftrightunsigned("u", 1), "u", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)))
    last = cells.withColumn("extra", (F.col("upto") - F.col("tokens") / 2 <= F.col("room")).cast("int")).drop("upto")
    whole = marked.where(~F.coalesce(at_edge, F.lit(False))).withColumn("extra", F.coalesce(before, F.lit(False)).cast("int"))
    chosen = whole.unionByName(last).withColumn("repeats", F.col("passes") + F.col("extra")).where("repeats > 0").select(*group, "doc_id", "repeats", "tokens")
    taken = chosen.groupBy(*group).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("reviews"))
    shares = plan.select(*group, "target_share", "exponent", "wanted_tokens", "feasible").join(taken, group, "left")
    whole_mix = F.sum("tokens").over(Window.partitionBy("mix_name"))  # a row per source
    shares = shares.select(*group, "target_share", F.coalesce(F.col("tokens") / whole_mix, F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("reviews", F.lit(0)).alias("reviews"), "exponent", "wanted_tokens", "feasible")
    return chosen, shares
