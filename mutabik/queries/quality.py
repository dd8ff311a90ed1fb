"""Queries of the general training-data operators over the reconciliation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutabik.functions.scalars import trimmed
from mutabik.operators.copy_diff import copy_differences
from mutabik.operators.orphans import ChildTable, orphan_counts, orphan_references
from mutabik.operators.strict_load import load_and_reject


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records that are not valid."""
    return load_and_reject(table(spark, sf_dir, "raw_line"))[1].select("line_id").distinct()


def p1_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected records with the reason."""
    return load_and_reject(table(spark, sf_dir, "raw_line"))[1].select("line_id", "source", "batch_id", "row_no", "reason")


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid records, typed; the day without its midnight."""
    good = load_and_reject(table(spark, sf_dir, "raw_line"))[0]
    return good.withColumn("occurred_on", F.to_date("occurred_at")).drop("occurred_at")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    psp, bank, mk = (table(spark, sf_dir, t) for t in ("psp", "bank", "marketplace"))
    known = table(spark, sf_dir, "seller").select("counterparty").distinct()
    kids = [
        ChildTable("bank", bank.select(F.col("bank_id").alias("tx_id"), "counterparty", F.col("stmt_ref").alias("ref"), "ingested_at").join(known, "counterparty", "left_semi"), ("psp", "marketplace")),
        ChildTable("psp", psp.where("direction = 'debit'").select(F.col("psp_id").alias("tx_id"), "counterparty", "ref", "ingested_at"), ("psp",)),
    ]
    parents = {
        "psp": psp.where("direction = 'credit'").select("counterparty", "ref", "ingested_at"),
        "marketplace": mk.select("counterparty", F.col("payout_ref").alias("ref"), "ingested_at"),
    }
    return orphan_references(kids, parents, table(spark, sf_dir, "deleted_ref"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank lines and voids whose ref names no live record."""
    return _orphans(spark, sf_dir).select("source", "tx_id").distinct()


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per referring table, ingestion day and reason."""
    return orphan_counts(_orphans(spark, sf_dir))


STORE_COLUMNS = ["external_ref", "counterparty_ref", "amount", "currency", "occurred_at", "direction", "gross", "commission"]


def source_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """psp, bank and marketplace in the store's shape and compared form."""
    psp, bank, mk = (table(spark, sf_dir, t) for t in ("psp", "bank", "marketplace"))
    none = F.lit(None).cast("bigint")

    def side(df: DataFrame, name: str, key: str, ref: str, amount: str, at: str) -> DataFrame:
        m = name == "marketplace"
        return df.select(
            F.lit(name).alias("source"), F.col(key).alias("tx_id"), trimmed(F.col(ref)).alias("external_ref"),
            trimmed(F.col("counterparty")).alias("counterparty_ref"), F.col(amount).alias("amount"),
            (F.lit("TRY") if m else F.col("currency")).alias("currency"), F.col(at).alias("occurred_at"),
            (F.lit("credit") if m else F.col("direction")).alias("direction"),
            (F.col("gross_kurus") if m else none).alias("gross"), (F.col("commission_kurus") if m else none).alias("commission"),
        )

    return (
        side(psp, "psp", "psp_id", "ref", "amount_kurus", "occurred_at")
        .unionByName(side(bank, "bank", "bank_id", "stmt_ref", "amount_kurus", "value_date"))
        .unionByName(side(mk, "marketplace", "payout_id", "payout_ref", "net_kurus", "payout_date"))
    )


def store_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_store in compared form; gross and commission count only for payouts."""
    mk = F.col("source") == "marketplace"
    return table(spark, sf_dir, "tx_store").select(
        "source", "tx_id", trimmed(F.col("external_ref")).alias("external_ref"), trimmed(F.col("counterparty_ref")).alias("counterparty_ref"),
        "amount", "currency", "occurred_at", "direction",
        F.when(mk, F.col("gross")).alias("gross"), F.when(mk, F.col("commission")).alias("commission"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every difference between tx_store and its source tables."""
    only = {"gross": ["marketplace"], "commission": ["marketplace"]}
    return copy_differences(source_copy(spark, sf_dir), store_copy(spark, sf_dir), "tx_id", STORE_COLUMNS, "source", only)


QUERIES = {"p1_found": p1_found, "p1_rejects": p1_rejects, "p1_loaded": p1_loaded, "p2_found": p2_found, "p2_counts": p2_counts, "p4_found": p4_found}

_NORM = "upper(regexp_replace(coalesce({}, ''), '[^A-Za-z0-9]', '', 'g'))"
_ORPHANS = f"""
WITH gone AS (SELECT source, counterparty cp, {_NORM.format('ref')} k, min(deleted_at) gone FROM deleted_ref GROUP BY ALL),
target AS (
  SELECT p.cp, p.k, p.src, came, gone FROM (
    SELECT counterparty cp, {_NORM.format('ref')} k, 'psp' src, min(ingested_at) came FROM psp WHERE direction = 'credit' AND trim(coalesce(ref, '')) <> '' GROUP BY ALL
    UNION ALL SELECT counterparty, {_NORM.format('payout_ref')}, 'marketplace', min(ingested_at) FROM marketplace WHERE trim(coalesce(payout_ref, '')) <> '' GROUP BY ALL
  ) p LEFT JOIN gone g ON g.cp = p.cp AND g.k = p.k AND g.source = p.src),
child AS (
  SELECT 'bank' source, bank_id tx_id, b.counterparty cp, {_NORM.format('stmt_ref')} k, ingested_at ts FROM bank b
    WHERE counterparty IN (SELECT counterparty FROM seller) AND trim(coalesce(stmt_ref, '')) <> ''
  UNION ALL SELECT 'psp', psp_id, counterparty, {_NORM.format('ref')}, ingested_at FROM psp WHERE direction = 'debit' AND trim(coalesce(ref, '')) <> ''),
orphan AS (
  SELECT source, tx_id, cast(ts AS date) period,
    CASE WHEN NOT EXISTS (SELECT 1 FROM target t WHERE t.cp = c.cp AND t.k = c.k AND (c.source = 'bank' OR t.src = 'psp')) THEN 'missing'
         WHEN NOT EXISTS (SELECT 1 FROM target t WHERE t.cp = c.cp AND t.k = c.k AND (c.source = 'bank' OR t.src = 'psp') AND came <= ts + INTERVAL 48 HOUR) THEN 'late'
         ELSE 'deleted' END reason
  FROM child c WHERE NOT EXISTS (
    SELECT 1 FROM target t WHERE t.cp = c.cp AND t.k = c.k AND (c.source = 'bank' OR t.src = 'psp')
      AND came <= ts + INTERVAL 48 HOUR AND (gone IS NULL OR gone > ts + INTERVAL 48 HOUR)))
"""
_DIFF = """
WITH s AS (
  SELECT 'psp' source, psp_id tx_id, ref er, counterparty cp, amount_kurus amount, currency, occurred_at ts, direction, NULL::BIGINT gross, NULL::BIGINT commission FROM psp
  UNION ALL SELECT 'bank', bank_id, stmt_ref, counterparty, amount_kurus, currency, value_date, direction, NULL, NULL FROM bank
  UNION ALL SELECT 'marketplace', payout_id, payout_ref, counterparty, net_kurus, 'TRY', payout_date, 'credit', gross_kurus, commission_kurus FROM marketplace),
j AS (SELECT s.*, t.external_ref ter, t.counterparty_ref tcp, t.amount tam, t.currency tcu, t.occurred_at tat, t.direction tdi, t.gross tgr, t.commission tco FROM s JOIN tx_store t USING (tx_id))
SELECT source, tx_id, 'only_in_source' AS field FROM s WHERE tx_id NOT IN (SELECT tx_id FROM tx_store)
UNION SELECT source, tx_id, 'only_in_store' FROM tx_store WHERE tx_id NOT IN (SELECT tx_id FROM s)
UNION SELECT source, tx_id, 'external_ref' FROM j WHERE trim(coalesce(er, '')) <> trim(coalesce(ter, ''))
UNION SELECT source, tx_id, 'counterparty_ref' FROM j WHERE trim(coalesce(cp, '')) <> trim(coalesce(tcp, ''))
UNION SELECT source, tx_id, 'amount' FROM j WHERE amount IS DISTINCT FROM tam
UNION SELECT source, tx_id, 'currency' FROM j WHERE currency IS DISTINCT FROM tcu
UNION SELECT source, tx_id, 'occurred_at' FROM j WHERE ts IS DISTINCT FROM tat
UNION SELECT source, tx_id, 'direction' FROM j WHERE direction IS DISTINCT FROM tdi
UNION SELECT source, tx_id, 'gross' FROM j WHERE source = 'marketplace' AND gross IS DISTINCT FROM tgr
UNION SELECT source, tx_id, 'commission' FROM j WHERE source = 'marketplace' AND commission IS DISTINCT FROM tco
"""
_FIELD = '("([^"]|"")*"|[^",\\n\\r]*)'
_AMOUNT = "(regexp_full_match(trim({0}), '[+-]?[0-9]+') AND coalesce(try_cast(trim({0}) AS HUGEINT) BETWEEN -9223372036854775808 AND 9223372036854775807, false))"
_BIG = "CAST(try_cast(trim({}) AS HUGEINT) AS BIGINT)"


def _field(i: int) -> str:
    skip = f"({_FIELD},){{{i}}}" if i else ""
    raw = f"regexp_extract(raw_text, '^{skip}{_FIELD}(,|$)', {4 if i else 1})"
    return f"CASE WHEN {raw} LIKE '\"%' THEN replace({raw}[2:-2], '\"\"', '\"') ELSE {raw} END"


_PARSED = f"""
WITH r AS (SELECT *, regexp_matches(raw_text, '^{_FIELD}(,{_FIELD})*$') sound, regexp_matches(raw_text, '^{_FIELD}(,{_FIELD}){{5}}$') six, source = 'marketplace' mk, {', '.join(f'{_field(i)} f{i}' for i in range(6))} FROM raw_line),
c AS (SELECT *, CASE WHEN mk THEN f5 ELSE f4 END d FROM r),
j AS (SELECT *, CASE WHEN coalesce(source NOT IN ('psp', 'bank', 'marketplace'), true) THEN 'unknown source' WHEN raw_text IS NULL THEN 'no text' WHEN NOT sound THEN 'broken quoting' WHEN NOT six THEN 'wrong column count'
  WHEN NOT {_AMOUNT.format('f2')} OR (mk AND NOT ({_AMOUNT.format('f3')} AND {_AMOUNT.format('f4')})) THEN 'invalid amount'
  WHEN mk AND try_cast(trim(f2) AS HUGEINT) - try_cast(trim(f3) AS HUGEINT) <> try_cast(trim(f4) AS HUGEINT) THEN 'broken breakdown'
  WHEN NOT (regexp_full_match(trim(d), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(trim(d) AS DATE) IS NOT NULL) THEN 'invalid date'
  WHEN NOT mk AND f5 NOT IN ('credit', 'debit') THEN 'invalid direction' WHEN NOT mk AND f3 <> 'TRY' THEN 'unsupported currency'
  WHEN try_cast(trim(f2) AS HUGEINT) < 0 OR (mk AND (try_cast(trim(f3) AS HUGEINT) < 0 OR try_cast(trim(f4) AS HUGEINT) < 0)) THEN 'negative amount' END reason FROM c)
"""

ORACLES = {
    "p1_found": _PARSED + "SELECT DISTINCT line_id FROM j WHERE reason IS NOT NULL",
    "p1_rejects": _PARSED + "SELECT line_id, source, batch_id, row_no, reason FROM j WHERE reason IS NOT NULL",
    "p1_loaded": _PARSED + f"""SELECT line_id, source, batch_id, row_no, f0 AS ref, f1 AS counterparty, CASE WHEN mk THEN {_BIG.format('f4')} ELSE {_BIG.format('f2')} END AS amount, 'TRY' AS currency,
      CASE WHEN mk THEN 'credit' ELSE f5 END AS direction, CASE WHEN mk THEN {_BIG.format('f2')} END AS gross, CASE WHEN mk THEN {_BIG.format('f3')} END AS commission, CAST(trim(d) AS DATE) AS occurred_on FROM j WHERE reason IS NULL""",
    "p2_found": _ORPHANS + "SELECT DISTINCT source, tx_id FROM orphan",
    "p2_counts": _ORPHANS + "SELECT source, period, reason, count(*) AS n FROM orphan GROUP BY ALL",
    "p4_found": _DIFF,
}
