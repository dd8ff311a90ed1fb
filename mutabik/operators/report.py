"""Aggregates of a result: report rows, summaries and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutabik.config import DAY_US, KINDS, TYPES
from mutabik.functions.scalars import div, format_try, micros

# Order of the report and names of its ages.
REPORT_TYPES = ("commission", "refund", "partial", "timing", "duplicate", "missing", "ambiguous", "unknown")
AGES = ("0-7d", "8-30d", "30d+")


def _fixed(spark: SparkSession, names: tuple[str, ...], col: str) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"pos int, {col} string")


def kinds(matches: DataFrame) -> DataFrame:
    """pos, kind, n for every kind, also those that don't occur."""
    got = matches.groupBy("kind").agg(F.count("*").alias("n"))
    return _fixed(matches.sparkSession, KINDS, "kind").join(got, "kind", "left").select("pos", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def types(discrepancies: DataFrame) -> DataFrame:
    """pos, type, n, delta, delta_try for every type."""
    got = discrepancies.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("delta").cast("decimal(38,0)")).cast("bigint").alias("delta"))
    all_types = _fixed(discrepancies.sparkSession, REPORT_TYPES, "type").join(got, "type", "left")
    return all_types.select("pos", "type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("delta", F.lit(0)).alias("delta")).withColumn("delta_try", format_try(F.col("delta")))


def match_rate(book: DataFrame, members: DataFrame) -> DataFrame:
    """total, matched, rate_pct (whole per cent cut off; '' for an empty book)."""
    both = book.select(F.lit(0).alias("m")).unionByName(members.select(F.lit(1).alias("m")))
    n = both.agg(F.count_if(F.col("m") == 0).alias("total"), F.count_if(F.col("m") == 1).alias("matched"))
    return n.withColumn("rate_pct", F.when(F.col("total") > 0, div(F.col("matched") * 100, F.col("total")).cast("string")).otherwise(""))


def ageing(book: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """pos, age, n: row-level discrepancies by age against the newest row of the book."""
    at = book.select("tx_id", micros(F.col("occurred_at")).alias("us"))
    newest = at.agg(F.max("us")).first()[0] or 0
    d = discrepancies.where("tx_id is not null").join(at, "tx_id")
    days = F.floor((F.lit(newest) - F.col("us")) / F.lit(DAY_US))
    age = F.when(days <= 7, AGES[0]).when(days <= 30, AGES[1]).otherwise(AGES[2])
    got = d.groupBy(age.alias("age")).agg(F.count("*").alias("n"))
    return _fixed(book.sparkSession, AGES, "age").join(got, "age", "left").select("pos", "age", F.coalesce("n", F.lit(0)).alias("n"))


def summary(book: DataFrame, matches: DataFrame, members: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """One row: transactions, matched, matches and discrepancies, and a count per kind and type."""
    what = lambda df, name, value: df.select(F.lit(name).alias("what"), value.alias("value"))
    none = F.lit(None).cast("string")
    rows = what(book, "transactions", none).unionByName(what(members, "matched_transactions", none)).unionByName(what(matches, "matches", F.col("kind"))).unionByName(what(discrepancies, "discrepancies", F.col("type")))
    is_ = lambda n: F.col("what") == n
    totals = [F.count_if(is_(n)).alias(n) for n in ("transactions", "matched_transactions", "matches")]
    by_kind = [F.count_if(is_("matches") & (F.col("value") == k)).alias(f"kind_{k}") for k in KINDS]
    by_type = [F.count_if(is_("discrepancies") & (F.col("value") == t)).alias(f"type_{t}") for t in TYPES]
    return rows.agg(*totals, *by_kind, F.count_if(is_("discrepancies")).alias("discrepancies"), *by_type)


def emitted_by_type(truth: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """type, emitted, detected, expected, short, surplus against truth(tx_id, want_type)."""
    rows = discrepancies.where("tx_id is not null").select("tx_id", "type")
    want = truth.where("want_type is not null").select(F.col("tx_id").alias("w_id"), F.col("want_type").alias("type"))
    got = rows.groupBy("type").agg(F.count("*").alias("emitted"))
    hit = rows.join(want.withColumnRenamed("type", "w_type"), (F.col("tx_id") == F.col("w_id")) & (F.col("type") == F.col("w_type"))).groupBy("type").agg(F.count("*").alias("detected"))
    exp = want.groupBy("type").agg(F.count("*").alias("expected"))
    all_types = _fixed(truth.sparkSession, TYPES, "type").join(got, "type", "left").join(hit, "type", "left").join(exp, "type", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    e, d, x = z("emitted"), z("detected"), z("expected")
    return all_types.select("type", e.alias("emitted"), d.alias("detected"), x.alias("expected"), F.greatest(x - d, F.lit(0)).alias("short"), F.greatest(e - d, F.lit(0)).alias("surplus"))


def label_score(truth: DataFrame, matches: DataFrame, members: DataFrame) -> DataFrame:
    """One row: matches, correct, false_matches, unlabelled, intended, whole, missed.

    truth: tx_id, label (null: the row has none). A match is correct if all its rows have one and the
    same label; an intended label has two rows or more and is whole if one match holds all of them.
    """
    j = members.join(truth.select("tx_id", "label"), "tx_id", "left")
    per = j.groupBy("match_id").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.countDistinct("label").alias("labels"), F.min("label").alias("label"))
    good = (F.col("known") == F.col("n")) & (F.col("labels") == 1)
    sums = per.agg(F.count("*").alias("matches"), F.count_if(good).alias("correct"), F.count_if(~good & (F.col("known") > 0)).alias("false_matches"), F.count_if(F.col("known") == 0).alias("unlabelled"))
    size = truth.where("label is not null").groupBy("label").agg(F.count("*").alias("size")).where("size >= 2")
    got = per.where(good).join(size, "label").where("n = size").select("label").distinct()
    whole = size.join(got.withColumn("w", F.lit(1)), "label", "left").agg(F.count("*").alias("intended"), F.count("w").alias("whole"))
    names = [*sums.columns, *whole.columns]
    one = sums.unionByName(whole, allowMissingColumns=True).agg(*[F.max(n).alias(n) for n in names])
    return one.withColumn("missed", F.col("intended") - F.col("whole"))


def confusion(truth: DataFrame, book: DataFrame, members: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """want, got, n over all rows: wanted type against what came out, '(none)' and '(matched)' included."""
    got = members.select("tx_id", F.lit("(matched)").alias("got")).unionByName(discrepancies.where("tx_id is not null").select("tx_id", F.col("type").alias("got")))
    j = book.select("tx_id").join(truth.select("tx_id", "want_type"), "tx_id", "left").join(got, "tx_id", "left")
    return j.groupBy(F.coalesce("want_type", F.lit("(none)")).alias("want"), F.coalesce("got", F.lit("(group-level only)")).alias("got")).agg(F.count("*").alias("n"))


def match_rows(book: DataFrame, matches: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of matches.csv: one per member."""
    b = book.select("tx_id", "source", "external_ref", "counterparty_ref", "amount", "direction", F.date_format("occurred_at", "yyyy-MM-dd").alias("occurred_on"))
    return members.join(matches.select("match_id", "kind", "score_bp"), "match_id").join(b, "tx_id").select("match_id", "kind", "score_bp", "tx_id", "source", "external_ref", "counterparty_ref", "amount", "direction", "occurred_on")


def discrepancy_rows(book: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """Rows of discrepancies.csv; tx_id 0 for those of a whole match."""
    b = book.select("tx_id", "source", "external_ref", "counterparty_ref", "amount", "direction", F.date_format("occurred_at", "yyyy-MM-dd").alias("occurred_on"))
    j = discrepancies.join(b, "tx_id", "left")
    return j.select("type", F.coalesce("tx_id", F.lit(0)).alias("tx_id"), "match_id", "delta", "source", "external_ref", "counterparty_ref", "amount", "direction", "occurred_on")
