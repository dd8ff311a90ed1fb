"""Derived columns that the passes and the rules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutabik.config import DAY_US
from mutabik.functions.scalars import micros

KEY = ["cp", "ref"]


def rank(*, side: bool = True) -> Column:
    """Pool order as a comparable struct: content before id, so load order doesn't matter."""
    cols = ["us", "ref", "cp", "amount", "direction", "source", "gross0", "tx_id"]
    return F.struct(*(["side"] if side else []), *cols)


def featured(book: DataFrame) -> DataFrame:
    """tx_id, source, side (0 expected, 1 actual), cp, ref ('' if none), amount, us, direction, gross, gross0,
    commission, flagged: the key occurs on the other side of the book too."""
    base = book.select(
        "tx_id", "source", (F.col("source") != "psp").cast("int").alias("side"),
        F.coalesce("counterparty_ref", F.lit("")).alias("cp"), F.coalesce("external_ref", F.lit("")).alias("ref"),
        "amount", micros(F.col("occurred_at")).alias("us"), "direction", "gross", F.coalesce("gross", F.lit(0)).alias("gross0"),
        F.coalesce("commission", F.lit(0)).alias("commission"),
    )
    both = base.where("ref <> ''").groupBy(*KEY).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo = 0 and hi = 1").select(*KEY, F.lit(True).alias("flagged"))
    return base.join(both, KEY, "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def within(a: Column, b: Column, days: int) -> Column:
    """At most so many whole days apart."""
    return F.abs(a - b) < (days + 1) * DAY_US


def minus(pool: DataFrame, used: DataFrame) -> DataFrame:
    """The pool without the used tx_ids."""
    return pool.join(used.select("tx_id"), "tx_id", "left_anti")


def cells(at: Column, width_us: int, reach_us: int) -> Column:
    """The cells of a width that lie within reach of an instant."""
    cell = lambda c: F.floor(c / F.lit(width_us)).cast("bigint")
    return F.sequence(cell(at - reach_us), cell(at + reach_us))
