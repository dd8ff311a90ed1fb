"""Three checks that must find nothing, or the run gives no result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class InvariantError(AssertionError):
    """A row is lost, used twice, or typed with a delta that its type forbids."""


def unplaced(rows: DataFrame, members: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """tx_id of rows that aren't placed exactly once (lost, or both matched and typed, or typed twice)."""
    placed = members.select("tx_id").unionByName(discrepancies.where("tx_id is not null").select("tx_id"))
    n = placed.groupBy("tx_id").agg(F.count("*").alias("n"))
    return rows.select("tx_id").join(n, "tx_id", "full_outer").where(F.coalesce("n", F.lit(0)) != 1).select("tx_id")


def matched_twice(members: DataFrame) -> DataFrame:
    return members.groupBy("tx_id").agg(F.count("*").alias("n")).where("n > 1").select("tx_id")


def wrong_delta(rows: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """Row-level discrepancies whose delta doesn't fit their type and amount."""
    j = discrepancies.where("tx_id is not null").join(rows.select("tx_id", "amount"), "tx_id")
    d, a, t = F.col("delta"), F.col("amount"), F.col("type")
    ok = (
        F.when(t == "timing", d == 0)
        .when(t.isin("partial", "commission"), (d >= 0) & (d < a))
        .when(t == "refund", d == -a)
        .when(t.isin("missing", "duplicate", "ambiguous", "unknown"), d == a)
        .otherwise(False)
    )
    return j.where(~ok).select("tx_id", "type", "delta")


def check_result(rows: DataFrame, members: DataFrame, discrepancies: DataFrame) -> None:
    """Raises InvariantError with an example of the first broken invariant; a row matched twice isn't placed once."""
    for name, bad in (
        ("a row is not placed exactly once", unplaced(rows, members, discrepancies)),
        ("a delta does not fit its type", wrong_delta(rows, discrepancies)),
    ):
        first = bad.limit(1).collect()
        if first:
            raise InvariantError(f"{name}: {first[0].asDict()}")
