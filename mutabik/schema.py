"""The one row type of a book and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutabik.config import CURRENCY, MAX_LONG

TX = T.StructType(
    [
        T.StructField("tx_id", T.LongType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("external_ref", T.StringType()),
        T.StructField("counterparty_ref", T.StringType()),
        T.StructField("amount", T.LongType()),
        T.StructField("currency", T.StringType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("direction", T.StringType()),
        T.StructField("dedup_key", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("gross", T.LongType()),
        T.StructField("commission", T.LongType()),
    ]
)
SOURCES = ("psp", "bank", "marketplace")


class BookError(ValueError):
    """A book that must not be reconciled."""


def money_fault(amount: Column, currency: Column, gross: Column, commission: Column, payout: Column) -> Column:
    """The first money rule that a row breaks, or null: currency, then sign, then breakdown."""
    negative = (amount < 0) | F.coalesce(gross < 0, F.lit(False)) | F.coalesce(commission < 0, F.lit(False))
    broken = payout & ~F.coalesce((commission <= gross) & (gross - commission == amount), F.lit(False))
    return (
        F.when(F.coalesce(currency != CURRENCY, F.lit(True)), "unsupported currency")
        .when(F.coalesce(negative, F.lit(True)), "negative amount")
        .when(broken, "inconsistent breakdown")
    )


def conform(df: DataFrame) -> DataFrame:
    """The columns of ``TX`` in order; missing ones are null, other columns are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TX])


def check_book(book: DataFrame) -> None:
    """Raises BookError for a null or repeated tx_id, a broken money rule, or totals beyond 64 bits."""
    payout = (F.col("source") == "marketplace") & F.col("gross").isNotNull()
    fault = money_fault(F.col("amount"), F.col("currency"), F.col("gross"), F.col("commission"), payout)
    bad = book.select("tx_id", fault.alias("fault")).where("fault is not null or tx_id is null").limit(1).collect()
    if bad:
        raise BookError(f"transaction {bad[0]['tx_id']}: {bad[0]['fault'] or 'no id'}")
    twice = book.groupBy("tx_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise BookError(f"duplicate transaction id {twice[0]['tx_id']}")
    total = F.sum(F.col("amount").cast("decimal(38,0)") + F.coalesce("commission", F.lit(0)))
    t = book.agg(total.alias("t")).first()["t"]
    if t is not None and t > MAX_LONG:
        raise BookError("book total exceeds 64-bit minor units")
