"""Session defaults. On a cluster the session comes from outside and only SQL settings matter."""

from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | None = None, app: str = "mutabik") -> SparkSession:
    """A single-machine session for tests, the bench and the command line."""
    cpus = cpus or os.cpu_count() or 4
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in SQL_CONF.items():
        b = b.config(k, v)
    spark = (
        b.config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("MUTABIK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable for Python workers, once per application, through the shared folder."""
    from mutabik.shared import shared_path

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_path(spark, 'package')}.zip")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path.toString())
    _shipped.add(app)
