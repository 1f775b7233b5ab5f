"""Streams: chunk work with durable checkpoints, overlap-owned windows, the event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def owned_windows(events: DataFrame, ts: str = "ts", size: int = 30, overlap: int = 2) -> DataFrame:
    """Each event in the one window that owns it.

    Windows of ``size`` seconds begin every ``size - overlap``; an event in an overlap belongs to the
    earlier window in its first half, to the later one after.  Works on streams and tables alike.
    """
    step = size - overlap
    w = events.withColumn("w", F.window(ts, f"{size} seconds", f"{step} seconds"))
    half = F.expr(f"interval {overlap * 500} milliseconds")
    return w.filter((F.col(ts) >= F.col("w.start") + half) & (F.col(ts) < F.col("w.end") - half)).withColumn("window_start", F.col("w.start")).drop("w")


def event_rates(events: DataFrame, ts: str = "ts", kind: str = "event_type", lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and kind; on a stream a window is final once the watermark has passed it."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Runs of events of a key with at most ``gap`` between them."""
    s = events.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def process_pending(chunks: DataFrame, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Work off a stream of chunks, each once: a batch drops chunks whose result exists, does the rest and appends it.

    A batch that is run again after a failure finds what it had written and adds nothing; a folder in which
    a failed batch left nothing is one without results.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            done = spark.read.schema(rows.select("media_id", "chunk_no").schema).parquet(out)
            rows = rows.join(done, ["media_id", "chunk_no"], "left_anti")
        work(rows.dropDuplicates(["media_id", "chunk_no"])).write.mode("append").parquet(out)

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def carry_context(rows: DataFrame, key: str, order: str, text: str, keep: int = 6) -> DataFrame:
    """Each row (key, order, text) with context: the last ``keep`` texts of its key before it.

    On a table, by ``order``.  On a stream, by ``order`` within a batch and after earlier batches, whose last
    texts are carried as state.  Columns keep their types; rows of a null key are a group like others.
    """
    rows = rows.select(key, order, text)
    if not rows.isStreaming:
        w = Window.partitionBy(key).orderBy(order)
        before = F.collect_list(F.struct(text)).over(w.rowsBetween(-keep, -1)) if keep else F.array()
        return rows.withColumn("context", F.transform(before, lambda x: x[text]) if keep else before.cast("array<string>"))
    from pyspark.sql.streaming.state import GroupStateTimeout

    schema = T.StructType([*rows.schema.fields, T.StructField("context", T.ArrayType(T.StringType()))])

    def run(k, batches, state):
        import pandas as pd

        past = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        seen = []
        for t in pdf[text]:
            seen.append(list(past))
            past = [*past, t][-keep:] if keep else []
        state.update((past,))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], text: pdf[text], "context": seen})

    return rows.groupBy(key).applyInPandasWithState(run, schema, "past array<string>", "append", GroupStateTimeout.NoTimeout)
