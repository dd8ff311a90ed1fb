"""Problem 1: rows that fail to parse.

Strict load plus anti-join. Each raw record keeps its offset (line id, source and a hash of its
text). Only records that conform in every respect are loaded, typed. The loaded offsets are
subtracted from the raw offsets with an anti-join, and only the remainder is diagnosed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutabik.config import CURRENCY
from mutabik.functions.scalars import parse_day, parse_kurus

# Field names by source, in file order.
LAYOUTS = {
    "psp": ("ref", "counterparty", "amount_kurus", "currency", "occurred_at", "direction"),
    "bank": ("stmt_ref", "counterparty", "amount_kurus", "currency", "value_date", "direction"),
    "marketplace": ("payout_ref", "counterparty", "gross_kurus", "commission_kurus", "net_kurus", "payout_date"),
}
FIELDS = 6
MARK = "\u0001"


def _segments(raw: Column) -> Column:
    return F.split(raw, '"', -1)


def quotes_ok(raw: Column) -> Column:
    """Quotes pair up, enclose whole fields only, and no line break stands outside them."""
    segs = _segments(raw)
    last = F.size(segs) - 1
    at = F.transform(segs, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def fits(s: Column) -> Column:
        x, i = s["x"], s["i"]
        left = (i == 0) | x.startswith(",")
        right = (i == last) | x.endswith(",")
        return (i % 2 == 1) | (x == "") | (left & right)

    def unbroken(s: Column) -> Column:
        return (s["i"] % 2 == 1) | ~s["x"].rlike("[\\r\\n]")

    plain = ~raw.contains('"')
    return F.when(plain, ~raw.rlike("[\\r\\n]")).otherwise((last % 2 == 0) & F.forall(at, lambda s: fits(s) & unbroken(s)))


def split_record(raw: Column) -> Column:
    """Fields of a record whose quotes are sound."""
    segs = _segments(raw)
    last = F.size(segs) - 1

    def masked(x: Column, i: Column) -> Column:
        inside = F.replace(F.replace(x, F.lit(MARK), F.lit(MARK + "a")), F.lit(","), F.lit(MARK + "b"))
        doubled = (x == "") & (i > 0) & (i < last)
        return F.when(i % 2 == 1, inside).when(doubled, F.lit('"')).otherwise(F.replace(x, F.lit(MARK), F.lit(MARK + "a")))

    def unmasked(x: Column) -> Column:
        return F.replace(F.replace(x, F.lit(MARK + "b"), F.lit(",")), F.lit(MARK + "a"), F.lit(MARK))

    quoted = F.transform(F.split(F.array_join(F.transform(segs, masked), ""), ",", -1), unmasked)
    return F.when(raw.contains('"'), quoted).otherwise(F.split(raw, ",", -1))


def _typed(df: DataFrame) -> DataFrame:
    """Adds f (fields or null), and the typed values, each null where it is not valid."""
    df = df.withColumn("_ok", quotes_ok(F.col("raw_text")))
    df = df.withColumn("_f", F.when(F.col("_ok"), split_record(F.col("raw_text"))))
    f = lambda i: F.get(F.col("_f"), F.lit(i))
    mk = F.col("source") == "marketplace"
    return df.select(
        "*",
        F.size("_f").alias("_n"),
        f(0).alias("_ref"),
        f(1).alias("_cp"),
        parse_kurus(f(2)).alias("_a2"),
        F.when(mk, parse_kurus(f(3))).alias("_a3"),
        F.when(mk, parse_kurus(f(4))).alias("_a4"),
        F.when(mk, F.lit(CURRENCY)).when(f(3) == CURRENCY, f(3)).alias("_cur"),
        parse_day(F.when(mk, f(5)).otherwise(f(4))).alias("_at"),
        F.when(mk, F.lit("credit")).when(f(5).isin("credit", "debit"), f(5)).alias("_dir"),
    )


def _checks() -> list[tuple[str, Column]]:
    """Reasons in order of precedence, each with the condition under which it applies: first what can't be read, then what money must not be."""
    mk = F.col("source") == "marketplace"
    no = lambda c: F.coalesce(~c, F.lit(True))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return [
        ("unknown source", no(F.col("source").isin(*LAYOUTS))),
        ("no text", F.col("raw_text").isNull()),
        ("broken quoting", no(F.col("_ok"))),
        ("wrong column count", no(F.col("_n") == FIELDS)),
        ("invalid amount", F.col("_a2").isNull() | (mk & (F.col("_a3").isNull() | F.col("_a4").isNull()))),
        ("broken breakdown", mk & no(wide("_a2") - wide("_a3") == wide("_a4"))),
        ("invalid date", F.col("_at").isNull()),
        ("invalid direction", F.col("_dir").isNull()),
        ("unsupported currency", F.col("_cur").isNull()),
        ("negative amount", (F.col("_a2") < 0) | (mk & ((F.col("_a3") < 0) | (F.col("_a4") < 0)))),
    ]


def _offset() -> list[Column]:
    return [F.col("line_id").alias("_line"), F.col("source").alias("_src"), F.xxhash64("raw_text").alias("_h")]


def strict_load(raw: DataFrame) -> DataFrame:
    """The records that conform, typed: one row per valid record.

    ``raw`` needs line_id, source, batch_id, row_no, raw_text; other columns are ignored.
    Columns out: line_id, source, batch_id, row_no, ref, counterparty, amount, currency,
    occurred_at, direction, gross, commission (the last two null unless marketplace).
    """
    df = _typed(raw.select("line_id", "source", "batch_id", "row_no", "raw_text"))
    bad = F.lit(False)
    for _, c in _checks():
        bad = bad | F.coalesce(c, F.lit(True))
    mk = F.col("source") == "marketplace"
    return df.where(~bad).select(
        "line_id", "source", "batch_id", "row_no",
        F.col("_ref").alias("ref"), F.col("_cp").alias("counterparty"),
        F.when(mk, F.col("_a4")).otherwise(F.col("_a2")).alias("amount"),
        F.col("_cur").alias("currency"), F.col("_at").alias("occurred_at"), F.col("_dir").alias("direction"),
        F.when(mk, F.col("_a2")).alias("gross"), F.col("_a3").alias("commission"),
        F.xxhash64("raw_text").alias("_h"),
    )


def load_and_reject(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records typed, rejected records with the reason).

    Defined results: a null or unknown source rejects as 'unknown source', a null text as 'no text',
    an empty text as 'wrong column count'. Repeated rows come out as often as they came in. A null
    line_id is an offset like any other (the anti-join is null-safe). An empty table gives two empty
    tables. Texts of any length are handled; the checks split on the quote, they don't backtrack.
    """
    good = strict_load(raw)
    loaded = good.select(*_offset()[:2], F.col("_h"))
    mine = raw.select("line_id", "source", "batch_id", "row_no", "raw_text").withColumn("_rh", F.xxhash64("raw_text"))
    rest = mine.join(
        loaded,
        mine["line_id"].eqNullSafe(loaded["_line"]) & mine["source"].eqNullSafe(loaded["_src"]) & (mine["_rh"] == loaded["_h"]),
        "left_anti",
    ).drop("_rh")
    reason = F.lit(None).cast("string")
    for name, c in reversed(_checks()):
        reason = F.when(F.coalesce(c, F.lit(True)), F.lit(name)).otherwise(reason)
    bad = _typed(rest).select("line_id", "source", "batch_id", "row_no", reason.alias("reason"), "raw_text")
    return good.drop("_h"), bad
