"""Streaming form of the history upsert: new draws arrive as files; of a round the last row stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .table import RangeTable


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, fmt: str = "parquet", bits: int = 8) -> StreamingQuery:
    """Starts a query that puts each batch of ``source`` into the ``RangeTable`` at ``target``.

    A batch rewrites the round ranges it touches and no others; repeated after
    a failure it changes nothing.  Within a batch the order of arrival is the
    files' time of change, and the place in the file.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    stream = stream.withColumn("_file", F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start"))

    def put(batch: DataFrame, number: int) -> None:
        came = F.struct("_file", F.monotonically_increasing_id().alias("row"))  # rises inside a file's block
        RangeTable(batch.sparkSession, target, schema, bits).upsert(batch.withColumn("_came", came).drop("_file"), "_came", number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The rows of the table; empty if there is none."""
    return RangeTable(spark, target, schema).read()
