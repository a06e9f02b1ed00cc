"""A stream that goes on where the last run ended: each micro-batch leaves out what the table has, and is appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.files import not_done


def resume_stream(rows: DataFrame, path: str, checkpoint: str, key: str, step: Callable[[DataFrame], DataFrame], schema: str) -> StreamingQuery:
    """Applies step to the keys of a stream that path lacks. A batch that is run again finds its rows there and adds nothing."""

    def batch(new: DataFrame, _: int) -> None:
        spark = new.sparkSession
        try:
            done = spark.read.schema(schema).parquet(path)
        except AnalysisException:
            done = spark.createDataFrame([], schema)
        step(not_done(new.dropDuplicates([key]), done, key)).write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
