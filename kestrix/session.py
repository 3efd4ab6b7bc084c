"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[8]", partitions: int = 8, **more: str) -> SparkSession:
    """A session for a small machine; on a cluster, the settings come from its own configuration."""
    conf = SETTINGS | {"spark.master": master, "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "6g"} | more
    return SparkSession.builder.config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package's code to the executors, once a context: functions that run there import it,
    wherever the driver found it. Spark's file server hands out the archive."""
    context, root = spark.sparkContext, Path(__file__).parent
    if getattr(context, "_kestrix_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="kestrix-code-")) / "kestrix_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("kestrix") / p.relative_to(root))
    context.addPyFile(str(archive))
    context._kestrix_shipped = True
