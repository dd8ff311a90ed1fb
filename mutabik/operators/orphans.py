"""Problem 2: references to records that do not exist, were deleted, or arrive too late.

Parent keys, deletions and child keys are brought into one long form, tagged, and grouped by key
with a flag set per parent table (first arrival, first deletion) and the earliest and latest child.
Only keys whose flags don't cover all their children stay; they are few, are written to the shared
folder, and only their children are looked at one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutabik.functions.scalars import is_blank, micros, norm_ref
from mutabik.shared import shared_table

GRACE_HOURS = 48


@dataclass(frozen=True)
class ChildTable:
    """A referring table: rows (tx_id, counterparty, ref, ingested_at) and the parent tables its refs may name."""

    name: str
    rows: DataFrame
    parents: tuple[str, ...]


def _alive(parent: str, lo: Column, hi: Column) -> Column:
    came, gone = F.col(f"{parent}_came"), F.col(f"{parent}_gone")
    return F.coalesce((came <= lo) & (gone.isNull() | (gone > hi)), F.lit(False))


def orphan_references(children: list[ChildTable], parents: dict[str, DataFrame], deleted: DataFrame, grace_hours: int = GRACE_HOURS) -> DataFrame:
    """One row per referring record without a live target: source, tx_id, period, reason.

    parents: rows (counterparty, ref, ingested_at) by table name. deleted: source (a parent table's
    name), counterparty, ref, deleted_at. A target is live if it came by the referring record's
    ingested_at plus the grace and wasn't deleted by then; a deletion counts for all records of its
    table, counterparty and ref. Refs are equal if their Latin letters and digits are.

    Defined results: a blank ref refers to nothing and is no orphan; a ref without any letter or
    digit is a key of its own that equals only its like; a null counterparty never matches, so such
    a record is an orphan; a null ingested_at of a child makes it an orphan, of a parent makes the
    parent never come, a null deleted_at deletes nothing. Repeated rows come out as often as they
    came in. period is the day of ingestion (null if unknown).
    """
    grace = grace_hours * 3_600_000_000
    names = list(parents)
    nul = F.lit(None).cast("bigint")

    def long(df: DataFrame, came: dict | None = None, gone: dict | None = None, child: bool = False, domain: str | None = None) -> DataFrame:
        cols = [F.col("counterparty").alias("cp"), norm_ref(F.col("ref")).alias("k")]
        for n in names:
            cols.append(micros(F.col("ingested_at")).alias(f"{n}_came") if came and n in came else nul.alias(f"{n}_came"))
            cols.append(F.when(F.col("source") == n, micros(F.col("deleted_at"))).alias(f"{n}_gone") if gone else nul.alias(f"{n}_gone"))
        for c in range(len(children)):
            due = micros(F.col("ingested_at")) + grace
            mine = child and c == domain
            cols += [(due if mine else nul).alias(f"lo{c}"), (due if mine else nul).alias(f"hi{c}")]
            cols.append(F.lit(1 if mine else 0).alias(f"n{c}"))
        return df.select(*cols)

    live_parents = [long(df.where(~is_blank(F.col("ref"))), came={n: 1}) for n, df in parents.items()]
    gone = long(deleted.where(~is_blank(F.col("ref"))), gone={"all": 1})
    kids = [long(c.rows.where(~is_blank(F.col("ref"))), child=True, domain=i) for i, c in enumerate(children)]
    tagged = live_parents[0]
    for df in [*live_parents[1:], gone, *kids]:
        tagged = tagged.unionByName(df)
    aggs = [F.min(f"{n}_{x}").alias(f"{n}_{x}") for n in names for x in ("came", "gone")]
    for c in range(len(children)):
        aggs += [F.min(f"lo{c}").alias(f"lo{c}"), F.max(f"hi{c}").alias(f"hi{c}"), F.sum(f"n{c}").alias(f"n{c}")]
    keys = tagged.groupBy("cp", "k").agg(*aggs)

    def uncovered(i: int, c: ChildTable) -> Column:
        ok = F.lit(False)
        for p in c.parents:
            ok = ok | _alive(p, F.col(f"lo{i}"), F.col(f"hi{i}"))
        return (F.col(f"n{i}") > 0) & (~ok | F.col("cp").isNull())

    any_bad = F.lit(False)
    for i, c in enumerate(children):
        any_bad = any_bad | uncovered(i, c)
    suspects = shared_table(keys.where(any_bad).select("cp", "k", *[f"{n}_{x}" for n in names for x in ("came", "gone")]), "orphan-keys")

    out = None
    for c in children:
        rows = c.rows.where(~is_blank(F.col("ref"))).select(
            F.col("tx_id"), F.col("counterparty").alias("cp"), norm_ref(F.col("ref")).alias("k"),
            (micros(F.col("ingested_at")) + grace).alias("due"), F.to_date("ingested_at").alias("period"),
        )
        s = suspects.withColumnsRenamed({"cp": "s_cp", "k": "s_k"})
        j = rows.join(s, rows["cp"].eqNullSafe(s["s_cp"]) & (rows["k"] == s["s_k"]))
        alive = F.lit(False)
        ever = F.lit(False)
        for p in c.parents:
            alive = alive | _alive(p, F.col("due"), F.col("due"))
            ever = ever | F.col(f"{p}_came").isNotNull()
        known = F.col("cp").isNotNull()
        reason = F.when(~ever | ~known, "missing").when(_any_late(c.parents), "late").otherwise("deleted")
        part = j.where(~(alive & known) | F.col("due").isNull()).select(F.lit(c.name).alias("source"), "tx_id", "period", reason.alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def _any_late(parents: tuple[str, ...]) -> Column:
    """No parent of any table had come by the due moment."""
    late = F.lit(True)
    for p in parents:
        late = late & F.coalesce(F.col(f"{p}_came") > F.col("due"), F.lit(True))
    return late


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table, period and reason."""
    return orphans.groupBy("source", "period", "reason").agg(F.count("*").alias("n"))
