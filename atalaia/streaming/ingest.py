"""Streams: files as they arrive, counts, and control messages (see ``control``)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_folder


def arrivals(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; each file is read once, however often the query is started."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def run_once(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Give what has arrived to ``work`` batch by batch, then stop."""
    query = stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def event_counts(stream: DataFrame) -> DataFrame:
    """Number and sum of events by type."""
    return stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type, with late ones let in up to a watermark."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("janela"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def streamed_event_counts(spark: SparkSession, path: str, checkpoint: str | None = None) -> DataFrame:
    """event_counts() of a file or of all files of a folder, by way of a stream; equal to the batch result.

    The counts are written beside the checkpoint and read from there, so nothing is held by the driver. With a checkpoint of an
    earlier run only files that have arrived since are read.
    """
    schema = spark.read.parquet(path).schema
    stream = event_counts(arrived(spark, path, schema))
    place = (checkpoint or shared_folder(spark, "stream")).rstrip("/")
    counts = f"{place}/counts"

    def work(batch: DataFrame, number: int) -> None:  # all counts so far: a batch that is repeated writes the same
        batch.write.mode("overwrite").parquet(f"{counts}/{number}")
        spark.createDataFrame([(number,)], "number long").write.mode("overwrite").parquet(f"{counts}/last")

    run_once(stream, work, f"{place}/checkpoint", "complete")
    try:
        last = spark.read.parquet(f"{counts}/last").first()["number"]
    except AnalysisException as e:  # no file, so no batch
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{counts}/{last}")


def arrived(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder as a stream, or a single file by its folder and name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return arrivals(spark, path, schema)
    name = re.sub(r"([*?\[\]{}\\])", r"\\\1", at.getName())
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(at.getParent().toString())


def commands(spark: SparkSession, folder: str) -> DataFrame:
    """Control messages: one JSON file each, state run, running or completed."""
    return spark.readStream.schema("id string, task string, state string, params map<string,string>").json(folder)
