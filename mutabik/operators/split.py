"""Split 1:N pass: bank lines under one open order's reference that add up to its amount exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutabik.config import MATCH_WINDOW_DAYS
from mutabik.operators.features import KEY, within


def split_members(pool: DataFrame) -> DataFrame:
    """e_id, a_id: one row per part. The order must be the only open one under its key."""
    e = pool.where("side = 0 and ref <> ''")
    only = e.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.struct("tx_id", "amount", "us", "direction")).alias("e")).where("n = 1").select(*KEY, "e")
    bank = pool.where("source = 'bank' and ref <> ''").select("tx_id", *KEY, "amount", "us", "direction")
    parts = bank.join(only, KEY).where((F.col("direction") == F.col("e.direction")) & within(F.col("us"), F.col("e.us"), MATCH_WINDOW_DAYS))
    parts = parts.select(F.col("e.tx_id").alias("e_id"), F.col("tx_id").alias("a_id"), "amount", F.col("e.amount").alias("due"))
    whole = parts.groupBy("e_id").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(38,0)")).alias("paid"), F.max("due").alias("due")).where("n >= 2 and paid = due")
    return parts.join(whole.select("e_id"), "e_id", "left_semi").select("e_id", "a_id")
