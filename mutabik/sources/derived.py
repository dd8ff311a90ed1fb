"""A reconciliation book derived from ``orders`` and ``lineitem``, as one SQL text for two dialects.

``o_orderkey % 20`` picks the shape of an order: what the processor, the bank and the marketplace report
of it. The shapes cover all match kinds and discrepancy types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Slot, offset of the id, source, reference prefix, suffix, minus, numerator, denominator, days, direction.
SHAPES = [
    *[(s, 0, "psp", "O-", "", 0, 1, 1, 0, "credit") for s in range(20) if s not in (9, 11)],
    (3, 1, "psp", "O-", "", 0, 1, 1, 0, "credit"),
    (8, 1, "psp", "O-", "", 0, 1, 1, 1, "debit"),
    (11, 0, "psp", "O-", "-A", 0, 1, 1, 0, "credit"),
    (11, 1, "psp", "O-", "-B", 0, 1, 1, 0, "credit"),
    (0, 500, "bank", "O-", "", 1, 15, 100, 1, "credit"),
    (1, 500, "bank", "O-", "", 0, 1, 2, 2, "credit"),
    (2, 500, "bank", "O-", "", 0, 1, 1, 6, "credit"),
    (3, 500, "bank", "O-", "", 0, 1, 1, 1, "credit"),
    (5, 500, "bank", "O-", "", 0, 1, 1, 1, "credit"),
    (5, 501, "bank", "O-", "", 0, 1, 1, 3, "debit"),
    (6, 500, "bank", "", "", 0, 1, 1, 1, "credit"),
    (7, 500, "bank", "O-", "", 0, 1, 3, 1, "credit"),
    (7, 501, "bank", "O-", "", 1, 1, 3, 2, "credit"),
    (10, 500, "bank", "O-", "", 1, 1, 400, 1, "credit"),
    (11, 500, "bank", "", "", 0, 1, 1, 1, "credit"),
    (11, 501, "bank", "", "", 0, 1, 1, 1, "credit"),
    (12, 500, "bank", "O-", "", 0, 1, 1, 1, "credit"),
    (12, 501, "bank", "X-", "", 0, 1, 1, 0, "credit"),
    *[(s, 500, "bank", "O-", "", 0, 1, 1, -1, "credit") for s in range(13, 20)],
]

#: What each shape is meant to become: slot, offset, outcome.
EXPECTED = [
    *[(s, o, "exact") for s in (5, 12, *range(13, 20)) for o in (0, 500)],
    (0, 0, "commission"), (0, 500, "commission"), (1, 0, "partial"), (1, 500, "partial"), (2, 0, "timing"), (2, 500, "timing"),
    (3, 0, "exact"), (3, 1, "duplicate"), (3, 500, "exact"), (4, 0, "missing"), (5, 501, "refund"), (6, 0, "tolerant"), (6, 500, "tolerant"),
    (7, 0, "split"), (7, 500, "split"), (7, 501, "split"), (8, 0, "reversal"), (8, 1, "reversal"), (10, 0, "tolerant"), (10, 500, "tolerant"),
    (11, 0, "ambiguous"), (11, 1, "ambiguous"), (11, 500, "ambiguous"), (11, 501, "ambiguous"), (12, 501, "unknown"),
]


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def book_sql(dialect: str) -> str:
    """The derived book: tx_id, source, external_ref, counterparty_ref, amount, currency, occurred_at, direction, gross, commission."""
    spark = dialect == "spark"
    div = (lambda a, b: f"({a} div {b})") if spark else (lambda a, b: f"({a} // {b})")
    part = div("amt * num", "den")
    key = "cast(l_orderkey as string)" if spark else "cast(l_orderkey as varchar)"
    num = "cast(n as string)" if spark else "cast(n as varchar)"
    shapes = f"(VALUES {values(SHAPES)}) AS sh(slot, off, src, pre, suf, minus, num, den, days, dir)"
    return f"""
SELECT k * 1000 + off AS tx_id, src AS source, CASE WHEN pre = '' THEN '' ELSE concat(pre, k, suf) END AS external_ref,
  CASE WHEN pre = 'X-' THEN concat('z-', k) ELSE cp END AS counterparty_ref,
  CASE WHEN minus = 1 THEN amt - {part} ELSE {part} END AS amount, 'TRY' AS currency,
  d + INTERVAL '1' DAY * (CASE WHEN days < 0 THEN k % 4 ELSE days END) AS occurred_at, dir AS direction,
  cast(NULL AS bigint) AS gross, cast(NULL AS bigint) AS commission
FROM (SELECT o_orderkey AS k, concat('c-', o_custkey) AS cp, cast(round(o_totalprice * 100) AS bigint) AS amt, o_orderdate AS d FROM orders) o
JOIN {shapes} ON o.k % 20 = sh.slot
UNION ALL
SELECT l_orderkey * 1000 + n, 'psp', concat('L-', {key}, '-', {num}), concat('s-', {key}), cents, 'TRY', d + INTERVAL '1' DAY * (n % 5), 'credit', NULL, NULL
FROM (SELECT l_orderkey, o_orderdate AS d, cast(round(l_extendedprice * 100) AS bigint) AS cents,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 20 = 9) l
UNION ALL
SELECT k * 1000 + 500, 'marketplace', concat('P-', k), concat('s-', k), g - {div('g * 12', '100')}, 'TRY', d + INTERVAL '1' DAY * 7, 'credit', g, {div('g * 12', '100')}
FROM (SELECT l_orderkey AS k, any_value(o_orderdate) AS d, cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS bigint) AS g
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 20 = 9 GROUP BY l_orderkey) p
"""


def derived_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book of a directory's orders and lineitem tables."""
    for t in ("orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(book_sql("spark")).withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))


def table_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """psp, bank and marketplace as one book; lines of a null or blank counterparty keep it empty."""
    def side(name: str, key: str, ref: str, amount: str, at: str) -> DataFrame:
        m = name == "marketplace"
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(
            F.col(key).alias("tx_id"), "batch_id", F.lit(name).alias("source"), F.trim(F.coalesce(ref, F.lit(""))).alias("external_ref"),
            F.trim(F.coalesce("counterparty", F.lit(""))).alias("counterparty_ref"), F.col(amount).alias("amount"),
            (F.lit("TRY") if m else F.col("currency")).alias("currency"), F.col(at).alias("occurred_at"),
            (F.lit("credit") if m else F.col("direction")).alias("direction"),
            (F.col("gross_kurus") if m else F.lit(None).cast("bigint")).alias("gross"), (F.col("commission_kurus") if m else F.lit(None).cast("bigint")).alias("commission"),
        )

    return (
        side("psp", "psp_id", "ref", "amount_kurus", "occurred_at")
        .unionByName(side("bank", "bank_id", "stmt_ref", "amount_kurus", "value_date"))
        .unionByName(side("marketplace", "payout_id", "payout_ref", "net_kurus", "payout_date"))
    )
