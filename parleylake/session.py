"""Sessions: settings for local runs, and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local(cores: int = 8, partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own. ``shared``: the folder for scratch tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("parleylake")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that workers need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_parleylake_sent", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"parleylake-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._parleylake_sent = True
