"""The eight discrepancy types: features by aggregates and joins, then one chain of rules.

Lookups are over the whole book. Everything a rule needs of other rows is first reduced to one row
per key, per key and amount, or per counterparty, amount and instant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mutabik.config import DAY_US, HORIZON_DAYS, MATCH_WINDOW_DAYS
from mutabik.functions.scalars import shortfall_type
from mutabik.operators.features import KEY, within
from mutabik.shared import shared_table

CLOSE = (MATCH_WINDOW_DAYS + 1) * DAY_US - 1
FAR = (HORIZON_DAYS + 1) * DAY_US - 1
MONEY = ["cp", "amount", "direction"]


def _order() -> F.Column:
    return F.struct("us", "amount", "direction", "source", "gross0", "tx_id")


def _late_splits(keyed: DataFrame) -> DataFrame:
    """cp, ref, e_id, e_direction of single orders whose bank parts add up but came late in part."""
    only = keyed.where("side = 0").groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.struct("tx_id", "amount", "us", "direction")).alias("e")).where("n = 1")
    parts = keyed.where("source = 'bank'").select(*KEY, "amount", "us", "direction").join(only.select(*KEY, "e"), KEY).where(F.col("direction") == F.col("e.direction"))
    late = ~within(F.col("us"), F.col("e.us"), MATCH_WINDOW_DAYS)
    s = parts.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(38,0)")).alias("paid"), F.max(late).alias("late"), F.max("e").alias("e"))
    return s.where("n >= 2 and late and paid = e.amount").select(*KEY, F.col("e.tx_id").alias("ls_id"), F.col("e.direction").alias("ls_direction"))


def _shortfalls(open_rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """tx_id, short_of (larger order) for open actual credits; tx_id, short_by (smaller payment) for open orders."""
    e = keyed.where("side = 0 and direction = 'credit'").groupBy(*KEY, "amount").agg(F.min(_order()).alias("o"))
    a_open = open_rows.where("side = 1 and direction = 'credit' and ref <> '' and amount > 0")
    pts = a_open.select(*KEY, F.col("amount").alias("mine")).distinct()
    of = pts.join(e, KEY).where("amount > mine").groupBy(*KEY, "mine").agg(F.min_by("amount", "o").alias("short_of"))
    mirror = a_open.join(of, (a_open["cp"] == of["cp"]) & (a_open["ref"] == of["ref"]) & (a_open["amount"] == of["mine"])).select("tx_id", "short_of", F.lit(None).cast("bigint").alias("short_by"))
    a = keyed.where("side = 1 and amount > 0").groupBy(*KEY, "direction", "amount").agg(F.min(_order()).alias("o"))
    e_open = open_rows.where("side = 0 and ref <> ''")
    ept = e_open.select(*KEY, "direction", F.col("amount").alias("mine")).distinct()
    by = ept.join(a, [*KEY, "direction"]).where("amount < mine").groupBy(*KEY, "direction", "mine").agg(F.min_by("amount", "o").alias("short_by"))
    own = e_open.join(by, (e_open["cp"] == by["cp"]) & (e_open["ref"] == by["ref"]) & (e_open["direction"] == by["direction"]) & (e_open["amount"] == by["mine"])).select("tx_id", F.lit(None).cast("bigint").alias("short_of"), "short_by")
    return mirror.unionByName(own)


def _same_money(book: DataFrame, open_rows: DataFrame) -> DataFrame:
    """tx_id, loose_late, loose_near: unflagged rows of the other side with the same money, 3 to 30 or 0 to 30 days away."""
    asked = open_rows.where("not flagged").select(*MONEY).distinct()
    pts = book.where("not flagged").join(asked, MONEY, "left_semi").groupBy(*MONEY, "us").agg(F.count_if(F.col("side") == 0).alias("n_e"), F.count_if(F.col("side") == 1).alias("n_a"))
    w = Window.partitionBy(*MONEY).orderBy("us")
    for s in ("e", "a"):
        pts = pts.withColumn(f"far_{s}", F.sum(f"n_{s}").over(w.rangeBetween(-FAR, FAR))).withColumn(f"close_{s}", F.sum(f"n_{s}").over(w.rangeBetween(-CLOSE, CLOSE)))
    near = open_rows.where("not flagged").select("tx_id", *MONEY, "us", "side").join(pts.drop("n_e", "n_a"), [*MONEY, "us"])
    far, close = (F.when(F.col("side") == 0, F.col(f"{x}_a")).otherwise(F.col(f"{x}_e")) for x in ("far", "close"))
    return near.select("tx_id", (far > close).alias("loose_late"), (far > 0).alias("loose_near"))


def classify_open(book: DataFrame, open_rows: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """tx_id, type, delta for every open row. book is the whole featured book."""
    keys = open_rows.where("ref <> ''").select(*KEY).distinct()
    keyed = shared_table(book.where("ref <> ''").join(keys, KEY, "left_semi"), "keyed")  # read by six aggregates
    opp = lambda s: F.count_if((F.col("side") == 1) & (F.col("direction") == s))
    per_key = keyed.groupBy(*KEY).agg(F.count("*").alias("key_rows"), opp("credit").alias("a_credits"), opp("debit").alias("a_debits"))
    per_copy = keyed.groupBy(*KEY, "source", "direction", "amount").agg(F.min(F.struct("us", "gross0", "tx_id")).alias("first"))
    per_money = keyed.groupBy(*KEY, "direction", "amount").agg(*[f(F.when(F.col("side") == v, F.col("us"))).alias(f"{n}_{s}") for v, s in ((0, "e"), (1, "a")) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    x = (
        open_rows.join(per_key, KEY, "left")
        .join(per_copy, [*KEY, "source", "direction", "amount"], "left")
        .join(per_money, [*KEY, "direction", "amount"], "left")
        .join(_late_splits(keyed), KEY, "left")
        .join(_shortfalls(open_rows, keyed), "tx_id", "left")
        .join(_same_money(book, open_rows), "tx_id", "left")
        .join(ambiguous.select("tx_id", F.lit(True).alias("unsure")), "tx_id", "left")
    )
    c, t = F.col, lambda v: F.coalesce(v, F.lit(False))
    expected, credit = c("side") == 0, c("direction") == "credit"
    far = lambda at: t(~within(c("us"), at, MATCH_WINDOW_DAYS))
    other_lo, other_hi = F.when(expected, c("lo_a")).otherwise(c("lo_e")), F.when(expected, c("hi_a")).otherwise(c("hi_e"))
    late = far(other_lo) | far(other_hi) | t(c("loose_late"))
    in_split = t(c("ls_id").isNotNull() & ((c("tx_id") == c("ls_id")) | ((c("source") == "bank") & (c("direction") == c("ls_direction")))))
    copy = t(F.struct("us", "gross0", "tx_id") > c("first")) & (c("ref") != "")
    refund = ~expected & (c("direction") == "debit") & t(c("key_rows") > 1)
    mirror_short = ~expected & credit & c("short_of").isNotNull()
    own_short = expected & c("short_by").isNotNull()
    answered = t(F.when(credit, c("a_credits")).otherwise(c("a_debits")) > 0) | t(c("loose_near"))
    kind = (
        F.when(in_split, "timing").when(copy, "duplicate").when(t(c("unsure")), "ambiguous").when(refund, "refund")
        .when(mirror_short, shortfall_type(c("short_of") - c("amount"), c("short_of")))
        .when(~expected & credit & late, "timing")
        .when(own_short, shortfall_type(c("amount") - c("short_by"), c("amount")))
        .when(expected & late, "timing").when(expected & ~answered, "missing").otherwise("unknown")
    )
    zero = in_split | (~copy & ~t(c("unsure")) & ~refund & (mirror_short | (~expected & credit & late) | (expected & ~own_short & late)))
    delta = F.when(zero, F.lit(0)).when(~copy & ~t(c("unsure")) & refund, -c("amount")).when(~copy & ~t(c("unsure")) & own_short, c("amount") - c("short_by")).otherwise(c("amount"))
    return x.select("tx_id", kind.alias("type"), delta.cast("bigint").alias("delta"))
