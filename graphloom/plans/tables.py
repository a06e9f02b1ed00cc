"""Tables in the folder that the driver and all executors share, where long plans are cut."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a folder of our own, in local sessions only: a cluster's machines don't share theirs."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"/tmp/checkpoints/graphloom-{os.getpid()}"
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing will read any more; whoever calls this has written down all that came of them."""
    for t in tables:
        if path := vars(t).get("stored_at"):
            jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
