"""Sessions: a local one for tests and benchmarks, and the package's way to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", memory: str = "8g", name: str = "quillmark", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a context: their Python workers import it from a zip."""
    context = spark.sparkContext
    if getattr(context, "_quillmark_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="quillmark-zip-")) / "quillmark_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, os.path.join(PACKAGE.name, p.relative_to(PACKAGE)))
    context.addPyFile(str(path))
    context._quillmark_shipped = True
