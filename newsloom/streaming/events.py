"""Structured Streaming over events: deduplicated daily counts, and novelty with state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """Events arriving as Parquet files of a folder, with a timestamp that can be watermarked."""
    return spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """``(day, event_type, n, mean_value)`` of events seen once; later ones than ``late`` are dropped by the watermark."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    grouped = once.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return grouped.select(F.to_date("w.start").alias("day"), "event_type", "n", "mean_value")


class Novelty(StatefulProcessor):
    """A user's last ``rows`` event types as list state; a user silent for ``idle`` seconds of event time is forgotten."""

    def __init__(self, rows: int, idle: int):
        self.rows, self.idle = rows, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getListState("past", "event_type string")
        self.seen = handle.getValueState("seen", "n long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        past = [r[0] for r in self.past.get()] if self.past.exists() else []
        seen, last = self.seen.get() if self.seen.exists() else (0, None)
        out = []
        for kind in pdf["event_type"]:
            out.append(1.0 if seen < self.rows else 1 - past.count(kind) / self.rows)
            seen, past = seen + 1, [*past, kind][-self.rows :]
        newest = int(pdf["ts"].max().timestamp() * 1000)
        if last is None or newest > last:
            if last is not None:
                self.handle.deleteTimer(last + self.idle * 1000)
            self.handle.registerTimer(newest + self.idle * 1000)
        self.past.put([(kind,) for kind in past])
        self.seen.update((seen, newest if last is None else max(last, newest)))
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "novelty": out})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.past.clear()
        self.seen.clear()
        yield pd.DataFrame({"user_id": pd.Series([], dtype="int64"), "event_id": pd.Series([], dtype="int64"), "novelty": pd.Series([], dtype="float64")})

    def close(self) -> None:
        pass


def novelty(stream: DataFrame, rows: int = 20, late: str = "2 days", idle_days: int = 60) -> DataFrame:
    """``(user_id, event_id, novelty)`` as events come: 1 - share of the type among the user's last ``rows`` events.

    Events later than ``late`` are dropped. State is bounded by ``rows`` a user, and by the users seen in the last
    ``idle_days``: a user who comes back after that begins anew.
    """
    found = stream.withWatermark("ts", late).groupBy("user_id")
    return found.transformWithStateInPandas(Novelty(rows, idle_days * 86_400), "user_id long, event_id long, novelty double", "append", "eventTime")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """``(user_id, start, last, n)``: a user's events that follow each other within ``gap``; later ones than ``late`` are dropped."""
    grouped = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n")).select("user_id", "start", "last", "n")


#: State that holds lists and timers needs this store; it is set for the streams that ``drain`` starts.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and return what it wrote."""
    spark = stream.sparkSession
    before = spark.conf.get(_STORE[0])
    spark.conf.set(*_STORE)
    try:
        return _drained(stream, folder, mode)
    finally:
        spark.conf.set(_STORE[0], before)


def _drained(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    spark = stream.sparkSession
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch:06d}")  # a repeated epoch writes the same files

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema(f"epoch int, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}").parquet(f"{at}/out")
    last = written.agg(F.max("epoch").alias("epoch"))
    return written.join(F.broadcast(last), "epoch").drop("epoch")
