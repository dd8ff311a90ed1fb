"""Problem 4: differences between two copies of a dataset.

A column-by-bucket checksum matrix: each row adds, for every column, a 64-bit hash (kept as two sums
of 32-bit halves, which can't overflow) to its key bucket, with a plus sign on one side and a minus
sign on the other. Where a sum isn't zero, bucket and column are unequal. Only rows of unequal buckets and
columns with an unequal bucket are read again, joined and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutabik.shared import shared_table

BUCKET_WIDTH = 16


def _bucket(key: Column, width: int) -> Column:
    return F.floor(key / F.lit(width)).cast("bigint")


def _halves(h: Column) -> list[Column]:
    return [F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]


def checksum_matrix(left: DataFrame, right: DataFrame, key: str, columns: list[str], width: int = BUCKET_WIDTH) -> DataFrame:
    """bucket and one flag d_<column> per column: true where the two sides' sums differ.

    Column "" stands for the row's presence. The sums are additive, so they are combined on the
    map side; consecutive keys share a bucket, so files in key order shrink to a row per bucket.
    """

    def words(df: DataFrame, sign: int) -> DataFrame:
        cols = [_bucket(F.col(key), width).alias("bucket")]
        for i, c in enumerate(["", *columns]):
            h = F.xxhash64(F.col(key), F.lit(i)) if c == "" else F.xxhash64(F.col(key), F.lit(i), F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")))
            cols += [(w * sign).alias(f"w{i}_{j}") for j, w in enumerate(_halves(h))]
        return df.select(*cols)

    names = [f"w{i}_{j}" for i in range(len(columns) + 1) for j in range(2)]
    sums = words(left, 1).unionByName(words(right, -1)).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
    flags = [((F.col(f"w{i}_0") != 0) | (F.col(f"w{i}_1") != 0)).alias(f"d_{c}") for i, c in enumerate(["", *columns])]
    return sums.select("bucket", *flags)


def copy_differences(left: DataFrame, right: DataFrame, key: str, columns: list[str], carry: str, only: dict[str, list[str]] | None = None, width: int = BUCKET_WIDTH, names: tuple[str, str] = ("only_in_source", "only_in_store")) -> DataFrame:
    """One row per difference: <carry>, <key>, field.

    left and right have ``key``, ``carry`` (a label that isn't compared) and ``columns`` (already
    brought to their compared form; null equals null). only: columns compared only where the left
    label is in the list. field is names[0] or names[1] for rows on one side only, else the column.

    Defined results: copies that are alike on one side are no difference; if one side holds several
    unlike rows of a key, a field is reported if any pair of rows differs in it. A null key can't be
    paired: such rows come out as present on their side only. Empty tables are allowed.
    """
    only = only or {}
    loose = [df.where(F.col(key).isNull()).select(carry, key, F.lit(n).alias("field")) for df, n in ((left, names[0]), (right, names[1]))]
    left, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    matrix = shared_table(checksum_matrix(left, right, key, columns, width).where(" or ".join(f"`d_{c}`" for c in ["", *columns])), "copy-matrix")
    summary = matrix.agg(F.count("*").alias("n"), *[F.max(f"d_{c}").alias(c) for c in columns]).first()
    unequal = [c for c in columns if summary[c]]  # one row of flags, however large the tables
    buckets = matrix.select(F.col("bucket").alias("_b"))

    def read(df: DataFrame, tag: str) -> DataFrame:
        df = df.withColumn("_bk", _bucket(F.col(key), width))
        df = df.join(buckets, F.col("_bk") == F.col("_b"), "left_semi")
        return df.select(F.col(key).alias(f"_{tag}k"), F.col(carry).alias(f"_{tag}c"), *[F.col(c).alias(f"{tag}_{c}") for c in unequal]).distinct()

    a, b = read(left, "l"), read(right, "r")
    j = a.join(b, F.col("_lk") == F.col("_rk"), "full_outer")
    both = F.col("_lk").isNotNull() & F.col("_rk").isNotNull()
    fields = [F.when(F.col("_rk").isNull(), F.lit(names[0])), F.when(F.col("_lk").isNull(), F.lit(names[1]))]
    for c in unequal:
        differs = both & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
        if c in only:
            differs = differs & F.col("_lc").isin(*only[c])
        fields.append(F.when(differs, F.lit(c)))
    out = j.select(F.coalesce("_lc", "_rc").alias(carry), F.coalesce("_lk", "_rk").alias(key), F.explode(F.array_compact(F.array(*fields))).alias("field"))
    return out.unionByName(loose[0]).unionByName(loose[1]).distinct()
