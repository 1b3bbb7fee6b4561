"""Structured Streaming: windows, incremental views and joins, with the operators' own semantics where they can be kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """A file stream; a broker topic reads with fmt 'kafka' and its own options on spark.readStream."""
    r = spark.readStream.format(fmt).schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path)


def _timed(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Event time with a watermark, which asks for a timestamp with a zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def tumbling(stream: DataFrame, ts: str, size: str, keys: list[str], aggs: list[Column], lateness: str = "0 seconds") -> DataFrame:
    w = _timed(stream, ts, lateness).groupBy(F.window(ts, size), *keys).agg(*aggs)
    return _flat(w)


def sliding(stream: DataFrame, ts: str, size: str, slide: str, keys: list[str], aggs: list[Column], lateness: str = "0 seconds") -> DataFrame:
    """Every window that holds the row, not the latest only."""
    return _flat(_timed(stream, ts, lateness).groupBy(F.window(ts, size, slide), *keys).agg(*aggs))


def session(stream: DataFrame, ts: str, gap: str, keys: list[str], aggs: list[Column], lateness: str = "0 seconds") -> DataFrame:
    """Merged sessions; their end is the last row's time, as max(ts)."""
    w = _timed(stream, ts, lateness).groupBy(F.session_window(ts, gap), *keys).agg(F.max(ts).alias("_last"), *aggs)
    return _flat(w, "session_window").withColumn("_wend", F.col("_last")).drop("_last")


def _flat(df: DataFrame, name: str = "window") -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    ends = [us(F.col("window.end")).alias("_wend_us")] if name == "window" else []
    return df.select(us(F.col(f"{name}.start")).alias("_wstart_us"), *ends, *[c for c in df.columns if c != name])


def view(stream: DataFrame, keys: list[str], aggs: list[Column], where: Column | None = None) -> DataFrame:
    """An incremental view: filter, group, aggregate; state is one row for each group."""
    df = stream.filter(where) if where is not None else stream
    return df.groupBy(*keys).agg(*aggs)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, within: str, lateness: str = "1 hour") -> DataFrame:
    """Rows of two streams with equal keys whose right time is at most `within` after the left one."""
    a = _timed(left, left_ts, lateness).alias("a")
    b = _timed(right, right_ts, lateness).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    t, u = F.col(f"a.{left_ts}"), F.col(f"b.{right_ts}")
    return a.join(b, [*on, u >= t, u <= t + F.expr(f"interval {within}")])


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process all that is there and give the result as a view of files beside the checkpoint. The tasks write them, so that
    nothing of the result passes the driver; a batch done again replaces its files. In complete mode the last batch is the whole."""
    out = f"{checkpoint}-result"
    place = (lambda batch: out) if mode == "complete" else lambda batch: f"{out}/{batch}"
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(place("start"))
    each_batch(stream, lambda df, batch: df.write.mode("overwrite").parquet(place(batch)), checkpoint, mode).awaitTermination()
    df = stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)
    df.createOrReplaceTempView(name)
    return df


def into(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """A stream into Parquet; exactly once, by the checkpoint. Without `every`, what is there now."""
    w = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", every: str | None = None) -> StreamingQuery:
    """Event triggers and refreshes: act on each micro-batch."""
    w = stream.writeStream.foreachBatch(act).outputMode(mode).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
