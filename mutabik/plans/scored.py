"""Scored runs: of the generated book, and of external files with a truth file."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutabik.functions.scalars import reason_class
from mutabik.operators import report
from mutabik.operators.score import Score, score
from mutabik.plans.engine import run
from mutabik.schema import conform
from mutabik.shared import shared_table
from mutabik.sources.files import HeaderError, parse_file
from mutabik.sources.generate import generate

ORDER = ("psp", "bank", "marketplace")
TRUTH_HEADER = "source,row,label,type"
#: False matches that are shown with their members.
EXAMPLES = 20


def benchmark(spark: SparkSession, seed: int, n: int) -> Score:
    """Generates a book, reconciles it (only that is timed) and scores the result."""
    book, truth = generate(spark, seed, n)
    book, truth = shared_table(book, "bench-book"), shared_table(truth, "bench-truth")
    began = time.perf_counter()
    out = run(book)
    took = time.perf_counter() - began
    return score(out, book, truth, took)


def numbered_book(parts: dict[str, DataFrame]) -> DataFrame:
    """One book of parsed files; ids go by source, then by record number, without gaps per source."""
    offset, out = 0, None
    for name in ORDER:
        if name not in parts:
            continue
        tx = parts[name]
        cut = F.floor(F.col("row_no") / 100_000)
        per = tx.groupBy(cut.alias("_c")).agg(F.count("*").alias("m"))
        before = per.withColumn("_b", F.coalesce(F.sum("m").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")  # a row per 100,000 records
        n = F.row_number().over(Window.partitionBy("_c").orderBy("row_no")) + F.col("_b") + offset
        x = tx.withColumn("_c", cut).join(before, "_c").withColumn("tx_id", n.cast("bigint")).drop("_c", "_b")
        out = x if out is None else out.unionByName(x)
        offset += tx.count()
    return out


def read_truth(spark: SparkSession, path: str, book: DataFrame) -> DataFrame:
    """tx_id, label, want_type from a file source,row,label,type; row is the data record's number from 1.

    Rows of rejected records are skipped; an empty label means that the record must stay unmatched. A
    file with another header is refused.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first or first[0][0].strip() != TRUTH_HEADER:
        raise HeaderError(f"{path}: expected {TRUTH_HEADER!r}")
    t = spark.read.csv(path, header=True, schema="source string, row int, label string, type string")
    at = book.select("tx_id", "source", (F.col("row_no") - 1).alias("row"))
    return at.join(t, ["source", "row"]).select("tx_id", F.when(F.col("label") != "", F.col("label")).alias("label"), F.when(F.col("type") != "", F.col("type")).alias("want_type"))


def realrun(spark: SparkSession, files: dict[str, str], truth_path: str | None, out_dir: str) -> dict:
    """Reconciles files in memory, scores them and writes matches, discrepancies and summary.json."""
    parsed = {n: parse_file(spark, n, p, i + 1) for i, (n, p) in enumerate(files.items())}
    good = shared_table(numbered_book({n: p[0] for n, p in parsed.items()}), "real-book")
    book = shared_table(conform(good), "real-book")
    began = time.perf_counter()
    out = run(book)
    took = time.perf_counter() - began
    s: dict = {"rows": book.count(), "seconds": round(took, 3)}
    s["sources"] = {r["source"]: r["n"] for r in good.groupBy("source").agg(F.count("*").alias("n")).collect()}
    s["rejects"] = {n: {r["c"]: r["n"] for r in p[1].groupBy(reason_class(F.col("reason")).alias("c")).agg(F.count("*").alias("n")).collect()} for n, p in parsed.items()}
    s["kinds"] = {r["kind"]: r["n"] for r in report.kinds(out.matches).collect()}
    s["types"] = {r["type"]: {"n": r["n"], "delta": r["delta"]} for r in report.types(out.discrepancies).collect()}
    if truth_path:
        truth = shared_table(read_truth(spark, truth_path, good), "truth")
        s["labels"] = report.label_score(truth, out.matches, out.members).first().asDict()
        s["confusion"] = [r.asDict() for r in report.confusion(truth, book, out.members, out.discrepancies).orderBy("want", "got").collect()]
        s["label_rows"] = truth.agg(F.count("label").alias("labelled"), F.count_if(F.col("label").isNull()).alias("unlabelled")).first().asDict()
        j = out.members.join(truth, "tx_id", "left").groupBy("match_id").agg(F.countDistinct("label").alias("l"), F.count("label").alias("k"), F.count("*").alias("n"))
        false = j.where("k > 0 and (l > 1 or k < n)").select("match_id")
        s["false_by_kind"] = {r["kind"]: r["n"] for r in out.matches.join(false, "match_id").groupBy("kind").agg(F.count("*").alias("n")).collect()}
        met = out.members.select("tx_id", "match_id")
        groups = truth.where("label is not null").join(met, "tx_id", "left").groupBy("label").agg(F.count("*").alias("n"), F.count("match_id").alias("k"), F.countDistinct("match_id").alias("m"), F.coalesce(F.max("want_type"), F.lit("")).alias("type"))
        s["missed_by_type"] = {r["type"]: r["n"] for r in groups.where("n > 1 and (k < n or m > 1)").groupBy("type").agg(F.count("*").alias("n")).collect()}
        some = false.orderBy("match_id").limit(EXAMPLES)
        text = F.concat_ws(" ", "source", "external_ref", "counterparty_ref", F.col("amount").cast("string"), F.date_format("occurred_at", "yyyy-MM-dd"), "direction")
        shown = out.members.join(some, "match_id", "left_semi").join(book, "tx_id").select("match_id", "pos", "tx_id", text.alias("text")).orderBy("match_id", "pos", "tx_id")
        s["false_examples"] = {}
        for r in shown.collect():  # members of at most EXAMPLES matches, of at most GROUP_CAP or a few lines each
            s["false_examples"].setdefault(r["match_id"], []).append(r["text"])
    report.match_rows(book, out.matches, out.members).write.mode("overwrite").csv(f"{out_dir}/matches", header=True)
    report.discrepancy_rows(book, out.discrepancies).orderBy("type", "tx_id").write.mode("overwrite").csv(f"{out_dir}/discrepancies", header=True)
    Path(out_dir, "summary.json").write_text(json.dumps(s, indent=2, default=str))
    return s
