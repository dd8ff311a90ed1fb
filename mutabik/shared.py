"""Intermediate tables in the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``. A written table cuts lineage
and survives the loss of an executor. Only where the setting is absent, and only on a local master,
a folder of our own is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a trailing slash."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="mutabik-")
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/mutabik/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a plain scan."""
    return kept_table(df, name)[0]


def kept_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, with the path, for callers that remove the table when they are done with it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def state(spark: SparkSession, path: str) -> tuple[str, int, int, int]:
    """Path, size, number of files and latest change of what lies there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    c = fs.getContentSummary(p)
    return path, c.getLength(), c.getFileCount(), fs.getFileStatus(p).getModificationTime()


#: Bytes up to which a side may be broadcast.
MOST_BYTES = 32 << 20
#: Bytes that a row of fixed-width columns takes in a hash relation, beside its columns.
ROW_BYTES = 24


def if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks ``df`` for broadcast if it takes at most ``MOST_BYTES``; else it joins by shuffle.

    All columns must be of fixed width (hash strings first), so the number of rows proves the size.
    ``rows``: its count or a bound, if known.
    """
    if any(f.dataType.typeName() in ("string", "binary", "array", "map", "struct") for f in df.schema):
        raise TypeError("only columns of fixed width have a provable size")
    n = df.count() if rows is None else rows
    return F.broadcast(df) if broadcast_fits(n, len(df.columns)) else df


def broadcast_fits(rows: int, columns: int) -> bool:
    """Whether so many rows of columns of fixed width take at most ``MOST_BYTES``."""
    return rows * (ROW_BYTES + 8 * columns) <= MOST_BYTES


#: Bits of a key filter: 16 for each key, within these bounds (8 KB to 32 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28


def key_filter(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A bit set of the bigint column ``key``, in chunks of 65,536 bits, and its number of bits.

    It is never larger than 32 MB. With more keys than it was made for it lets more rows pass, so it
    only ever saves a shuffle; the join behind it stays exact.
    """
    bits = LEAST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    h = F.pmod(F.col("key"), F.lit(bits))
    one = F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = keys.where("key is not null").select(h.alias("h")).select(F.shiftright("h", 6).alias("word"), one.alias("b"))
    zeros = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("b"))
    full = words.unionByName(zeros).groupBy("word").agg(F.bit_or("b").alias("b"))
    pos = F.struct(F.col("word").bitwiseAND(F.lit(1023)).alias("i"), F.col("b"))
    chunks = full.groupBy(F.shiftright("word", 10).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(pos)), lambda x: x["b"]).alias("words"))  # 1024 longs each
    return chunks, bits


def may_join(rows: DataFrame, key: str, chosen: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose ``key`` may be among the keys of the filter; none that is gets lost."""
    chunks, bits = chosen
    h = F.pmod(F.col(key), F.lit(bits))
    word = F.get(F.col("words"), F.shiftright(h, 6).bitwiseAND(F.lit(1023)).cast("int"))
    return rows.join(F.broadcast(chunks), (F.shiftright(h, 16) == F.col("chunk")) & (F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1), "left_semi")
