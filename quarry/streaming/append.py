"""Streaming forms of the resumable logs and of conversation state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.incremental import pending


def append_new(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Append rows of new keys to a Parquet log. A batch that is run again appends nothing twice."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        try:
            done = spark.read.schema(batch.schema).parquet(path)
            rows = pending(rows, done, keys)
        except Exception as error:  # the log doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
        rows.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_windows(stream: DataFrame, time: str, late: str, width: str, *by: str) -> DataFrame:
    """Counts by time window; rows later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
