"""Incremental ingest: files that arrive in a folder are appended once, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mutabik.sources.store import ParquetStore


def ingest_folder(spark: SparkSession, store: ParquetStore, source: str, folder: str, checkpoint: str) -> None:
    """Ingests the files of ``folder`` not seen before, in the order of their names, then stops.

    The stream only finds new files; each is read whole, as its header and record numbers count. A
    file ingested again after a failure adds nothing, as its content keys are in the store.
    """

    def take(batch: DataFrame, _: int) -> None:
        for r in batch.select("path").distinct().orderBy("path").toLocalIterator():  # names of files
            store.ingest(source, r["path"])

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.csv").load(folder).select("path")
    files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
