"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from webtel.sources.tables import EVENTS


def events_stream(spark: SparkSession, path: str, lateness: str = "2 minutes", files: int | None = 50, ends: str | None = None) -> DataFrame:
    """A folder of Parquet files of events (or one file) as a stream with a watermark; events later than it are dropped.

    With no number of files, all that is there is one batch, in which nothing is late.
    Events of the folder `ends` come in too; see write_end.
    """
    reader = spark.readStream.schema(EVENTS)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isFile():
        raw = reader.option("pathGlobFilter", jpath.getName()).parquet(str(jpath.getParent().toString()))
    else:
        raw = reader.parquet(path)
    if ends:
        raw = raw.unionByName(spark.readStream.schema(EVENTS).parquet(ends))
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First of equal keys within the watermark; state goes as it passes."""
    return stream.dropDuplicatesWithinWatermark(keys)


def write_end(spark: SparkSession, ends: str, reached: bool) -> None:
    """Add to the folder `ends` no event, or one so late that the watermark passes all others; nothing may follow it."""
    late = spark.range(int(reached)).select(*[(F.lit("9000-01-01") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(EVENTS)])
    late.write.mode("append").parquet(ends)


def sessions(stream: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    g = stream.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))
    return g.select(key, "start", "end", "n")


def sessions_to_end(spark: SparkSession, path: str, key: str, gap: str, root: str, files: int | None = None) -> DataFrame:
    """The sessions of all events in `path`, each appended once when the watermark has passed it, and then gone from state.

    `root` holds the output and the checkpoint, and a restart goes on from
    there. Those that are open when all events are read are closed by an
    event that ends the input; its own session stays open. Rows with a null
    key have sessions too; an empty folder has none.
    """
    ends, out = f"{root}/ends", f"{root}/out"
    write_end(spark, ends, reached=False)
    found = sessions(events_stream(spark, path, files=files, ends=ends), key, gap)
    run_to_end(found, out, f"{root}/checkpoint")
    write_end(spark, ends, reached=True)
    run_to_end(found, out, f"{root}/checkpoint")
    return spark.read.schema(found.schema).parquet(out)


def periods(stream: DataFrame, every: str, *by: str, ts: str = "ts") -> DataFrame:
    g = stream.groupBy(F.window(ts, every).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("period_start"), *by, "n")


def liveness(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """One row for each hour with events."""
    return periods(stream, "1 hour", ts=ts).select(F.date_format("period_start", "yyyyMMddHH").alias("hour"), "n")


class ExpiringSet(StatefulProcessor):
    """Add if absent with a time to live: the first row of a key passes, others until it expires do not."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues):
        held = self.until.get()[0] if self.until.exists() else -1
        for pdf in rows:
            for at in sorted(pdf["at_ms"].tolist()):
                if at >= held:
                    held = at + self.ttl_ms
                    yield pd.DataFrame({"key": [key[0]], "at_ms": [at]})
        self.until.update((held,))
        self.handle.registerTimer(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.until.exists() and self.until.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        return iter(())

    def close(self):
        pass


def add_if_absent(stream: DataFrame, key: str, ttl_ms: int, ts: str = "ts") -> DataFrame:
    """(key, at_ms) of rows that enter an expiring set; needs the RocksDB state store."""
    keyed = stream.select(F.col(key).cast("string").alias("key"), F.unix_millis(ts).alias("at_ms"), ts)
    return keyed.groupBy("key").transformWithStateInPandas(ExpiringSet(ttl_ms), "key string, at_ms long", "append", "EventTime")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start in this block keep their state in RocksDB, as operators with state of their own need it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what is there and stop. Files in `path` are written exactly once; `each` gets whole batches instead."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", path).start()
    q.awaitTermination()
