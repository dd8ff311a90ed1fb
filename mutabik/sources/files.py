"""CSV sources: strict reading, rejects with reasons, content keys and idempotent append."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutabik.functions.scalars import dedup_key, occurrence_key
from mutabik.operators.strict_load import LAYOUTS, load_and_reject, quotes_ok

#: Equal records are numbered in slices of so many, so that a hot key isn't sorted in one task.
SLICE = 100_000


class HeaderError(ValueError):
    """A file whose first record isn't the header of its source."""


@dataclass(frozen=True)
class SourceSpec:
    """A kind of file: its name and header."""

    name: str
    header: tuple[str, ...]


SOURCES: dict[str, SourceSpec] = {n: SourceSpec(n, h) for n, h in LAYOUTS.items()}


def source(name: str) -> SourceSpec:
    """The spec of a source; unknown names are refused."""
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}; known: {', '.join(SOURCES)}")
    return SOURCES[name]


def check_header(spark: SparkSession, spec: SourceSpec, path: str) -> None:
    """Refuses a file whose first line isn't exactly the source's header."""
    first = spark.read.text(path).limit(1).collect()
    got = tuple(next(csv.reader(io.StringIO(first[0][0])), ())) if first else ()
    if got != spec.header:
        raise HeaderError(f"{path}: header is {','.join(got)!r}, expected {','.join(spec.header)!r}")


def _ends_inside(line: Column, inside: bool) -> Column:
    """Whether a quoted field is still open at the end of a line that begins outside or inside one.

    Strict rules: a quote opens a field only at its start, is doubled inside, and after the closing
    one only a comma or the end may follow. A line that breaks them ends its record.
    """
    segs = F.split(line, '"', -1)
    # Before each quote: O outside, Q inside, C after a closing quote, E broken.
    step = lambda s, x: (
        F.when((s["at"] == "Q"), "C")
        .when((s["at"] == "O") & (((x == "") & s["first"]) | x.endswith(",")), "Q")
        .when((s["at"] == "C") & ((x == "") | (x.startswith(",") & x.endswith(","))), "Q")
        .otherwise("E")
    )
    start = F.struct(F.lit("Q" if inside else "O").alias("at"), F.lit(True).alias("first"))
    last = F.aggregate(F.slice(segs, F.lit(1), F.size(segs) - 1), start, lambda s, x: F.struct(step(s, x).alias("at"), F.lit(False).alias("first")))
    return last["at"] == "Q"


def _broken(line: Column, inside: Column) -> Column:
    """Whether a line breaks the rules of quotes, so that its record isn't worth keeping whole."""
    whole = F.when(inside, F.concat(F.lit('"'), line)).otherwise(line)
    return ~quotes_ok(whole) & ~F.when(inside, F.col("_fi")).otherwise(F.col("_fo"))


def _chain(rows: Window, start: Column) -> Column:
    """The state before a row, where each row maps it (_fo from outside, _fi from inside) and ``start`` is the one before the first.

    A row maps both states to one, keeps them, or turns them; so it takes the last that maps to one and the turns since.
    """
    fixed = F.col("_fo") == F.col("_fi")
    turns = F.sum((F.col("_fo") & ~F.col("_fi")).cast("bigint")).over(rows)
    at_fixed = F.last(F.when(fixed, F.struct(F.col("_fo").alias("v"), F.col("_turns").alias("n"))), ignorenulls=True).over(rows)
    since = F.coalesce(turns, F.lit(0)) - F.coalesce(at_fixed["n"], F.lit(0))
    return F.coalesce(at_fixed["v"], start) != (since % 2 == 1)


def raw_records(spark: SparkSession, spec: SourceSpec, path: str, batch_id: int) -> DataFrame:
    """raw_line rows of one file: line_id, source, batch_id, row_no (the header is 1), raw_text.

    A record goes on over line breaks inside a quoted field. A line that breaks the rules of quotes
    ends its record, and the next line begins a new one; a record that is broken so, or never closed,
    keeps its first line only, so however far a stray quote reaches nothing is gathered. Blank lines
    are skipped and not numbered.

    Every line maps the state before it (outside or inside a quoted field) to the one behind it. The
    maps are composed within each split of the file and then over the splits, a row for each.
    """
    lines = spark.read.option("wholetext", False).text(path).withColumn("_i", F.monotonically_increasing_id())
    part = lines.withColumn("_p", F.shiftright("_i", 33)).withColumn("_fo", _ends_inside(F.col("value"), False)).withColumn("_fi", _ends_inside(F.col("value"), True))
    w = Window.partitionBy("_p").orderBy("_i")
    past, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    turn = (F.col("_fo") & ~F.col("_fi")).cast("bigint")
    part = part.withColumn("_turns", F.sum(turn).over(upto))
    part = part.withColumn("_in0", F.coalesce(_chain(past, F.lit(False)), F.lit(False))).withColumn("_in1", F.coalesce(_chain(past, F.lit(True)), F.lit(True)))
    after = lambda s: F.when(F.col(s), F.col("_fi")).otherwise(F.col("_fo"))
    per = part.groupBy("_p").agg(F.max_by(after("_in0"), "_i").alias("_fo"), F.max_by(after("_in1"), "_i").alias("_fi"))  # a row per split
    ws = Window.orderBy("_p")
    per = per.withColumn("_turns", F.sum(turn).over(ws.rowsBetween(Window.unboundedPreceding, 0)))
    per = per.select("_p", F.coalesce(_chain(ws.rowsBetween(Window.unboundedPreceding, -1), F.lit(False)), F.lit(False)).alias("_inside"))
    marked = part.join(per, "_p").withColumn("_in", F.when(F.col("_inside"), F.col("_in1")).otherwise(F.col("_in0"))).withColumn("_starts", (~F.col("_in")).cast("int"))
    used = marked.where((F.col("_starts") == 0) | (F.col("value") != ""))
    starts = used.groupBy("_p").agg(F.sum("_starts").alias("s"))
    base = starts.withColumn("s0", F.coalesce(F.sum("s").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    no = F.sum("_starts").over(upto) + F.col("s0")
    rec = used.join(base, "_p").withColumn("row_no", no.cast("int")).withColumn("_bad", _broken(F.col("value"), F.col("_in"))).withColumn("_open", after("_in")).where("row_no > 1")
    # A record's first line, whether it breaks off, and, of records of more lines, the lines behind it.
    ends = rec.groupBy("row_no").agg(F.count("*").alias("n"), F.max("_bad").alias("bad"), F.max_by("_open", "_i").alias("open"), F.min_by("value", "_i").alias("first"))
    many = ends.where("n > 1 and not bad and not open").select("row_no")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "value"))), lambda x: x["value"]), "\n")  # the lines of one sound record
    texts = rec.join(many, "row_no", "left_semi").groupBy("row_no").agg(text.alias("text"))
    out = ends.join(texts, "row_no", "left").select("row_no", F.coalesce("text", "first").alias("raw_text"))
    return out.select(F.col("row_no").cast("bigint").alias("line_id"), F.lit(spec.name).alias("source"), F.lit(batch_id).cast("bigint").alias("batch_id"), "row_no", "raw_text")


def numbered(keyed: DataFrame, order: str) -> DataFrame:
    """occurrence (from 1, in ``order``) among rows of one dedup_key, and the key made one of its own by it."""
    slice_ = F.floor(F.col(order) / SLICE)
    x = keyed.withColumn("_s", slice_)
    per = x.groupBy("dedup_key", "_s").agg(F.count("*").alias("m"))
    before = per.withColumn("_b", F.coalesce(F.sum("m").over(Window.partitionBy("dedup_key").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    n = F.row_number().over(Window.partitionBy("dedup_key", "_s").orderBy(order)) + F.col("_b")
    out = x.join(before, ["dedup_key", "_s"]).withColumn("occurrence", n)
    return out.withColumn("dedup_key", occurrence_key(F.col("dedup_key"), F.col("occurrence"))).drop("_s", "_b")


def new_rows(have: DataFrame, arriving: DataFrame) -> DataFrame:
    """Rows of ``arriving`` whose dedup_key is new, one per key."""
    return arriving.dropDuplicates(["dedup_key"]).join(have.select("dedup_key"), "dedup_key", "left_anti")


def parse_file(spark: SparkSession, name: str, path: str, batch_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """(transactions without ids, rejected records): the whole file is refused if its header is wrong.

    Equal records of one file get keys of their own, so genuine repeats survive and reading the file
    again adds nothing.
    """
    spec = source(name)
    check_header(spark, spec, path)
    good, bad = load_and_reject(raw_records(spark, spec, path, batch_id))
    key = dedup_key(F.col("source"), F.col("ref"), F.col("amount"), F.col("occurred_at"), F.col("direction"))
    tx = numbered(good.withColumn("dedup_key", key), "row_no").select(
        "batch_id", "row_no", "source", F.col("ref").alias("external_ref"), F.col("counterparty").alias("counterparty_ref"), "amount", "currency",
        "occurred_at", "direction", "dedup_key", F.lit("unmatched").alias("status"), "gross", "commission",
    )
    return tx, bad.select("batch_id", "row_no", "reason", F.col("raw_text").alias("raw_line"))
