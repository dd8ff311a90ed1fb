"""Parquet store: batches committed by a manifest, idempotent append, replaced results."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutabik.plans.engine import Output
from mutabik.schema import TX, conform
from mutabik.sources.files import new_rows, parse_file

MANIFEST = "batch_id bigint, source_type string, file_ref string, ingested_at timestamp, status string, row_count int, rejected_count int, attempt string, first_at timestamp, last_at timestamp"
REJECTED = "batch_id bigint, row_no int, reason string, raw_line string"
#: Ids of one batch start here.
BATCH_IDS = 10_000_000_000


class ReconciliationStore(Protocol):
    """What a run needs of a store."""

    def ping(self) -> None: ...

    def load(self) -> DataFrame: ...

    def save(self, out: Output) -> None: ...


@dataclass(frozen=True)
class Summary:
    """Counts of one ingest."""

    batch_id: int
    parsed: int
    inserted: int
    deduped: int
    rejected: int


class ParquetStore:
    """Tables below ``root``, a folder that all executors share. One writer at a time.

    Every attempt to ingest writes to folders of its own, and a batch counts from the moment its manifest
    row, which names the attempt, is there. What a failed attempt left is never read, also not when its
    batch id is given again. The manifest keeps the time range of each batch, so a file is compared with
    those batches only that could hold its keys. Results are written beside the old ones and then pointed at.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def ping(self) -> None:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            fs.mkdirs(p)

    def batches(self) -> DataFrame:
        path = f"{self.root}/source_batch"
        return self.spark.read.schema(MANIFEST).parquet(path) if self._exists(path) else self.spark.createDataFrame([], MANIFEST)

    def _committed(self, table: str, schema, where: str = "true") -> DataFrame:
        attempts = [r[0] for r in self.batches().where(where).select("attempt").collect()]  # a name for each batch
        if not attempts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/{a}" for a in attempts])

    def load(self) -> DataFrame:
        """All transactions of committed batches."""
        return conform(self._committed("transaction", TX))

    def rejected(self) -> DataFrame:
        return self._committed("rejected_row", REJECTED)

    def ingest(self, source: str, path: str) -> Summary:
        """Reads one file; its rows, rejects and counts become visible together or not at all."""
        self.ping()
        batch = (self.batches().agg(F.max("batch_id")).first()[0] or 0) + 1
        attempt = f"{batch}-{uuid.uuid4().hex}"
        tx, bad = parse_file(self.spark, source, path, batch)
        staged = f"{self.root}/_staging/{attempt}"
        tx.write.parquet(staged)
        bad.write.parquet(f"{self.root}/rejected_row/{attempt}")
        tx = self.spark.read.parquet(staged)
        t = tx.agg(F.count("*").alias("n"), F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi")).first()
        # Equal keys are of one day, so only batches whose days overlap can hold them.
        span = f"first_at <= timestamp '{t['hi']}' and last_at >= timestamp '{t['lo']}'" if t["n"] else "false"
        have = self._committed("transaction", TX, span)
        if t["n"]:
            have = have.where(F.col("occurred_at").between(t["lo"], t["hi"]))
        fresh = new_rows(have, tx).withColumn("tx_id", F.lit(batch).cast("bigint") * BATCH_IDS + F.col("row_no"))
        mine = f"{self.root}/transaction/{attempt}"
        conform(fresh).write.parquet(mine)
        inserted, rejected = self.spark.read.schema(TX).parquet(mine).count(), self.spark.read.schema(REJECTED).parquet(f"{self.root}/rejected_row/{attempt}").count()
        self._commit([(batch, source, path, None, "ingested", t["n"], rejected, attempt, t["lo"], t["hi"])])
        fs, p = self._fs(staged)
        fs.delete(p, True)
        return Summary(batch, t["n"], inserted, t["n"] - inserted, rejected)

    def _commit(self, row: list[tuple]) -> None:
        """The one step that makes a batch visible: a file of one row."""
        done = self.spark.createDataFrame(row, MANIFEST).withColumn("ingested_at", F.current_timestamp())
        done.coalesce(1).write.mode("append").parquet(f"{self.root}/source_batch")

    def save(self, out: Output) -> None:
        """Replaces the stored result."""
        run = f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        base = f"{self.root}/results/{run}"
        out.matches.write.parquet(f"{base}/match_group")
        out.members.write.parquet(f"{base}/match_member")
        out.discrepancies.withColumn("status", F.lit("open")).write.parquet(f"{base}/discrepancy")
        self.spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/current")

    def result(self) -> Output | None:
        """The stored result, or None before the first."""
        if not self._exists(f"{self.root}/current"):
            return None
        run = self.spark.read.parquet(f"{self.root}/current").first()[0]
        base = f"{self.root}/results/{run}"
        return Output(*(self.spark.read.parquet(f"{base}/{t}") for t in ("match_group", "match_member", "discrepancy")))

    def with_status(self) -> DataFrame:
        """Transactions with status matched or unmatched, as the stored result has it."""
        r = self.result()
        book = self.load().drop("status")
        if r is None:
            return book.withColumn("status", F.lit("unmatched"))
        hit = r.members.select("tx_id").distinct().withColumn("status", F.lit("matched"))
        return book.join(hit, "tx_id", "left").withColumn("status", F.coalesce("status", F.lit("unmatched")))
