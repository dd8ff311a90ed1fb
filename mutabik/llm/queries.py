"""Queries of the llm operators over the reconciliation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutabik.functions.scalars import is_blank
from mutabik.llm.history_dedup import HistoryRuns
from mutabik.llm.linkage import link
from mutabik.llm.mixing import mix_sources
from mutabik.llm.nearest_time import nearest_in_time
from mutabik.llm.packing import container_fill, pack_items
from mutabik.llm.sentences import sentence_starts, sentence_units
from mutabik.llm.tokens import token_sizes
from mutabik.shared import if_small, shared_path, shared_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _history(spark: SparkSession, sf_dir: str) -> HistoryRuns:
    """All batches of psp, added one after the other in the order of batch_id; rows without a batch come first.

    Of each file the least and the greatest batch_id are read first, so that a batch opens only files that may hold it. psp
    lies in the order of arrival: these are few, and the scan skips their row groups of other batches.
    """
    psp = table(spark, sf_dir, "psp").select(
        F.col("_metadata.file_path").alias("file"), "batch_id", F.col("psp_id").alias("id"), "counterparty", "ref", F.col("amount_kurus").alias("amount"), "occurred_at", "direction"
    )
    batches = [r[0] for r in psp.select("batch_id").distinct().orderBy(F.asc_nulls_first("batch_id")).collect()]  # a row for each delivery
    b = F.col("batch_id")
    files = psp.groupBy("file").agg(F.min(b), F.max(b), F.count_if(b.isNull())).collect()  # a row for each file
    runs = HistoryRuns(spark, shared_path(spark, "history"))
    for k in batches:
        held = [f for f, lo, hi, nulls in files if (nulls if k is None else lo is not None and lo <= k <= hi)]
        runs.add(psp.where(F.col("file").isin(held) & (b.isNull() if k is None else b == k)))
    return runs


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated sales: every batch is checked against all that was accepted before it."""
    return _history(spark, sf_dir).found().select(F.col("id").alias("psp_id"), F.col("repeat_id").alias("repeat_psp_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreferenced bank lines of known sellers with the sale nearest in time."""
    entity = F.concat_ws("\u0001", "counterparty", "direction")
    whole = F.col("counterparty").isNotNull() & F.col("direction").isNotNull()
    lines = lambda df: df.where(is_blank(F.col("stmt_ref")) & whole).select(F.col("bank_id").alias("id"), entity.alias("entity"), F.col("value_date").alias("at"))
    sales = lambda df: df.where(whole).select(F.col("psp_id").alias("id"), entity.alias("entity"), F.col("occurred_at").alias("at"))
    found = nearest_in_time(spark, (f"{sf_dir}/bank.parquet", lines), (f"{sf_dir}/psp.parquet", sales))
    known = table(spark, sf_dir, "seller").select("counterparty").distinct()
    asked = table(spark, sf_dir, "bank").where(is_blank(F.col("stmt_ref"))).select("bank_id", "counterparty").join(known, "counterparty", "left_semi").select(F.col("bank_id").alias("left_id"))
    return found.join(asked, "left_id", "left_semi").select(F.col("right_id").alias("psp_id"), F.col("left_id").alias("bank_id")).distinct()


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, psp, seller = (table(spark, sf_dir, t) for t in ("bank", "psp", "seller"))
    known = if_small(seller.where("counterparty is not null").select(F.xxhash64("counterparty").alias("ent")).distinct())
    free = bank.where(~is_blank(F.col("counterparty"))).withColumn("ent", F.xxhash64("counterparty")).join(known, "ent", "left_anti")
    payments = free.select(F.col("bank_id").alias("payment_id"), F.col("counterparty").alias("name"), F.col("stmt_ref").alias("ref_text"), F.col("amount_kurus").alias("amount"), F.col("value_date").alias("at"))
    sales = psp.where("direction = 'credit'").select(F.col("psp_id").alias("sale_id"), F.col("counterparty").alias("entity"), "ref", F.col("amount_kurus").alias("amount"), F.col("occurred_at").alias("at"))
    settled = bank.where("direction = 'credit'").select(F.col("counterparty").alias("entity"), F.col("stmt_ref").alias("ref"))
    return link(payments, sales, seller.select(F.col("counterparty").alias("entity"), F.col("trade_name").alias("seller_name")), settled)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank lines under a written name with the sale that each pays."""
    return _linked(spark, sf_dir).select(F.col("sale_id").alias("psp_id"), F.col("payment_id").alias("bank_id"))


def p6_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with their confidence."""
    return _linked(spark, sf_dir).select(F.col("sale_id").alias("psp_id"), F.col("payment_id").alias("bank_id"), F.round("confidence", 4).alias("confidence"))


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    packs = table(spark, sf_dir, "pack_size")
    sizes = shared_table(token_sizes(table(spark, sf_dir, "documents"), ["doc_id"]), "sizes")
    return pack_items(sizes, packs), packs


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every review or piece, for each pack size."""
    return _packed(spark, sf_dir)[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill of every container."""
    return container_fill(*_packed(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str, budget_share: float | None) -> tuple[DataFrame, DataFrame]:
    sizes = token_sizes(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return mix_sources(sizes, table(spark, sf_dir, "mix_target"), budget_share)


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen reviews of each mix with their repeats; every share is within 0.002 of its target."""
    return _mixed(spark, sf_dir, None)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of each mix at the largest budget with all shares within 0.002 of their targets."""
    return _mixed(spark, sf_dir, None)[1]


def p8_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached when each mix must have as many tokens as its sources have."""
    return _mixed(spark, sf_dir, 1.0)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sentence units of all reviews begin."""
    return sentence_starts(table(spark, sf_dir, "documents")).distinct()


def p9_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of all reviews."""
    return sentence_units(table(spark, sf_dir, "documents"))


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p6_confidence": p6_confidence, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_mixed": p8_mixed, "p8_shares": p8_shares, "p8_tempered": p8_tempered, "p9_found": p9_found, "p9_units": p9_units}
ORACLES: dict[str, str] = {
    "p5_found": """
SELECT psp_id, bank_id FROM (
  SELECT p.psp_id, b.bank_id, row_number() OVER (PARTITION BY b.bank_id ORDER BY abs(epoch_us(p.occurred_at) - epoch_us(b.value_date)), p.psp_id) rn
  FROM bank b JOIN psp p ON p.counterparty = b.counterparty AND p.direction = b.direction
    AND p.occurred_at BETWEEN b.value_date - INTERVAL 4 HOUR AND b.value_date + INTERVAL 4 HOUR
  WHERE trim(coalesce(b.stmt_ref, '')) = '' AND b.counterparty IN (SELECT counterparty FROM seller)) WHERE rn = 1""",
}
