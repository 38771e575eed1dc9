"""Operators over event streams. Each takes a streaming or a batch DataFrame (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Weight of a new outcome in a route's moving average, and where the average begins.
ALPHA, START = 0.1, 0.5


def stream(spark: SparkSession, path: str, late: str = "10 minutes", **options: str) -> DataFrame:
    """Parquet files as a stream with event time; the schema is that of the files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).options(**options).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


class _Average(StatefulProcessor):
    """A route's moving average of success; state lives per route, rows go in event-time order within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("average", "ema double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        from pyspark.sql import Row

        ema, n = self.state.get() if self.state.exists() else (START, 0)
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            ema, n = ALPHA * (r.event_type != "error") + (1 - ALPHA) * ema, n + 1
        self.state.update((ema, n))
        yield Row(user_id=key[0], ema=ema, n=n)

    def close(self) -> None:
        pass


def moving_average(events: DataFrame) -> DataFrame:
    """(user_id, ema, n) after each batch of a stream, in update mode."""
    schema = StructType().add("user_id", "long").add("ema", "double").add("n", "long")
    return events.groupBy("user_id").transformWithState(_Average(), outputStructType=schema, outputMode="Update", timeMode="None")


def run_once(df: DataFrame, name: str, mode: str, folder: str) -> DataFrame:
    """All that a stream now holds, through a checkpointed query into a memory table."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
