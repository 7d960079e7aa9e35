"""Streams over the job log and the event log, each run to the end of what is there and left as a table in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.sources.shared import shared_dir


def shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table as a stream, with its own schema; a table of one file is read as that file of its folder."""
    rows = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(rows.schema)
    if any(f.endswith(f"/{name}") for f in rows.inputFiles()):
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def to_the_end(stream: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Runs the stream over all that is available. Each batch adds only the rows of the keys that it changed, under its
    number; the table's rows are those of the last batch of each key, the last by `order` where a batch has several. A
    batch that is run again adds the same rows, and what the watermark has closed leaves the state."""
    spark, place = stream.sparkSession, shared(stream.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("append").parquet(f"{place}/table")

    running = stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).foreachBatch(put).start()
    running.awaitTermination()
    rows = spark.read.schema(stream.withColumn("__batch", F.lit(0)).schema).parquet(f"{place}/table")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__batch", order) if order else F.col("__batch")).alias("__row"))
    return last.select(*keys, "__row.*").select(*stream.columns)


def event_windows(events: DataFrame, width: str = "1 day", late: str = "45 minutes") -> DataFrame:
    """Events of each kind in tumbling windows of event time."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    by = timed.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "total")


def job_states(turns: DataFrame) -> DataFrame:
    """The latest state of each job: how many events it has had, the last one, and whether it still waits for an answer."""
    last = F.max_by("role", "turn")
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("events"), F.max("turn").alias("last_turn"), last.alias("last_role"), F.when(last == "user", "RUNNING").otherwise("DONE").alias("status"))
