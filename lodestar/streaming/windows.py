"""Structured Streaming counterparts of the windowed counters, over a directory of files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.sources.shared import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: How late a row may come: rows older than this before the latest one of earlier batches are left out.
LATE = "1 hour"


def _events(spark: SparkSession, path: str, files: str = "events.parquet", files_per_batch: int | None = None, late: str = LATE) -> DataFrame:
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", files)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _appended(rows: DataFrame, at: str | None = None) -> DataFrame:
    """What the stream gives, by the file sink in the shared folder, read back."""
    at = at or _folder(rows)
    rows.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).format("parquet").option("path", f"{at}/rows").start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{at}/rows")


def _folder(rows: DataFrame) -> str:
    return f"{shared_dir(rows.sparkSession)}/streams/{uuid.uuid4().hex}"


def _latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """The last row that the stream gives of each key, in update mode: a batch writes what has changed in it alone, and
    state goes when the watermark passes it. The executors write all batches to one table, a folder for each batch; a
    batch that is run again replaces its own folder."""
    spark, at = rows.sparkSession, _folder(rows)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{at}/rows")

    spark.createDataFrame([], rows.schema).withColumn("batch", F.lit(-1)).write.parquet(f"{at}/rows")
    rows.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    every = spark.read.schema(rows.withColumn("batch", F.lit(0)).schema).parquet(f"{at}/rows")
    return every.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("row")).select("row.*")


def daily_counts(spark: SparkSession, sf_dir: str, **source) -> DataFrame:
    """(day, event_type, n) counted by a stream that takes all files there are and ends; equal to the batch count but for
    late rows."""
    counts = _events(spark, sf_dir, **source).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return _latest(counts, ["window", "event_type"]).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def feedback_means(spark: SparkSession, sf_dir: str, **source) -> DataFrame:
    """(event_type, n, mean): running means as the log grows. The state is a row per type, so it needs no watermark."""
    means = _events(spark, sf_dir, **source).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return _latest(means, ["event_type"]).select("event_type", "n", F.round("mean", 6).alias("mean"))


def _open_state(spark: SparkSession, at: str, **options) -> DataFrame | None:
    """The state that a stream left in its checkpoint, None if no batch ran."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/state/commits/0")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.format("statestore").options(**options).load(f"{at}/state")


def sessions(spark: SparkSession, sf_dir: str, **source) -> DataFrame:
    """(user_id, n) of sessions that end after 30 idle minutes; equal to the batch sessions but for late rows. A session
    is written once, when the watermark passes its end, and its state goes; those that are open when the files end are
    read from the state that the stream leaves."""
    rows = _events(spark, sf_dir, **source).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    at = _folder(rows)
    ended, left = _appended(rows, at).select("user_id", "n"), _open_state(spark, at)
    return ended if left is None else ended.union(left.select("value.user_id", "value.count"))


#: A user's calls count for so long; rows that come later than this are left out, so a user's state spans twice of it.
LIMIT, LIMIT_LATE = 60, "60 seconds"


class Recent(StatefulProcessor):
    """Counts each call among the user's calls of the last LIMIT seconds. The state is a list of the times that a later call
    may still count with; it is cut at each batch, and a timer clears it when the user is quiet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        new = pd.concat(list(rows))
        micros, span = new["micros"].to_numpy(), LIMIT * 1_000_000
        known = np.array([r[0] for r in self.times.get()] if self.times.exists() else [], np.int64)
        every = np.sort(np.concatenate([known, micros]))
        n = np.searchsorted(every, micros, "right") - np.searchsorted(every, micros - span, "left")
        # A row that comes after this batch is no older than the watermark, and counts with rows of LIMIT before it.
        least = timerValues.getCurrentWatermarkInMs() * 1000 - span
        self.times.put([(int(t),) for t in every[every >= least]])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(int(every[-1]) // 1000 + LIMIT * 1000 + 1)
        yield pd.DataFrame({"event_id": new["event_id"], "in_window": n})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


_STORE = "spark.sql.streaming.stateStore.providerClass"


def sliding_counts(spark: SparkSession, sf_dir: str, **source) -> DataFrame:
    """(event_id, in_window): how many calls of its user each call is one of in the last 60 seconds, as a rate limiter
    sees it when the call comes. Equal to the batch count where files come in the order of time; a row that comes late
    counts the rows before it, and does not change the counts that are out. Rows over LIMIT_LATE late are left out."""
    stream = _events(spark, sf_dir, late=LIMIT_LATE, **source).withColumn("micros", F.unix_micros("ts"))
    rows = stream.groupBy("user_id").transformWithStateInPandas(Recent(), "event_id long, in_window long", "Append", "eventTime")
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _appended(rows)
    finally:
        spark.conf.set(_STORE, before)


def distinct_events(spark: SparkSession, sf_dir: str, **source) -> DataFrame:
    """(event_id, event_type), each event once though the stream brings it twice; state is dropped at the watermark."""
    x = _events(spark, sf_dir, **source)
    return _appended(x.union(x).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"))


SESSIONS_SQL = """SELECT user_id, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
 FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s"""
DISTINCT_SQL = "SELECT DISTINCT event_id, event_type FROM events"
DAILY_SQL = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"
FEEDBACK_SQL = "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1"
SLIDING_SQL = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_window FROM events"
