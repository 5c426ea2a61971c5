"""JSON documents in Structured Streaming: typed events from a stream of values, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jsonloom.functions.columns import json_get, json_valid
from jsonloom.operators.codec import json_decode, json_encode
from jsonloom.sources.jsonvalues import register


def read_values_stream(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """New files of the folder as a stream of value, input_offset, ordinal, path."""
    register(spark)
    return spark.readStream.format("jsonvalues").option("mode", mode).load(path)


def decoded(stream: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """The stream's documents as typed columns; documents that do not fit are left out."""
    return stream.select(json_decode(column, schema).alias("doc")).where("doc is not null").select("doc.*")


def windowed_counts(stream: DataFrame, column: str, pointer: str, time: str, width: str, late: str) -> DataFrame:
    """Counts by window and selected value; what comes later than the watermark is dropped."""
    picked = stream.where(json_valid(column)).select(F.col(time).cast("timestamp").alias("time"), json_get(column, pointer).alias("key"))
    return picked.withWatermark("time", late).groupBy(F.window("time", width), "key").agg(F.count("*").alias("n"))


def write_ndjson_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each row as a line of JSON; available input is worked off, then the query ends."""
    lines = stream.select(json_encode(F.struct(*stream.columns), stream.schema).alias("value"))
    return lines.writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def write_batches(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the complete result of an aggregated stream in a folder of Parquet files, written anew by each batch, distributed and
    never through the driver. Available input is worked off, then the query ends. The folder is whole between batches."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
