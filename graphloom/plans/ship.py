"""Sends this package to Python workers that don't have it on their path, and keeps their batches small."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: the package's sources as a zip, through Spark's own file distribution.

    Rows hold whole texts: unless the session says otherwise, a batch has BATCH_ROWS of them, not Spark's ten thousand.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    at = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)
