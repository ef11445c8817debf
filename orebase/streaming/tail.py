"""Following a change log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def tail(spark: SparkSession, path: str, schema, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every new batch of change rows, with their version, to `each`, once; ends when all present versions are read.

    schema names the columns without version, which comes from the folders. Files that Spark has not committed
    lie under hidden names and are passed over.
    """
    rows = spark.readStream.schema(schema).option("basePath", path).parquet(path)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
