"""Structured Streaming forms: routing of arriving reads and running genome scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.classify import classify


def stream_route(spark: SparkSession, in_dir: str, out_dir: str, score: Callable[[Column], Column], t: float, conf: float | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Score and call the reads of FASTA files as they arrive; append them by call."""
    raw = spark.readStream.option("lineSep", "\n>").text(in_dir)
    parts = F.split(F.regexp_replace("value", "^>|\n+$", ""), "\n", 2)
    reads = raw.where(F.trim("value") != "").select(F.element_at(parts, 1).alias("title"), F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"\s", "").alias("seq"))
    called = reads.withColumn("p", score(F.col("seq"))).withColumn("call", classify(F.col("p"), t, conf))
    writer = called.writeStream.outputMode("append").format("parquet").partitionBy("call")
    return writer.option("path", out_dir).option("checkpointLocation", checkpoint or f"{out_dir}/_checkpoint").trigger(availableNow=True).start()


def windowed_pool(scores: DataFrame, window: str, late: str, time: str = "ts", genome: str = "genome", p: str = "p") -> DataFrame:
    """Mean score by time window and genome; works alike on streams (with a watermark) and tables."""
    marked = scores.withWatermark(time, late) if scores.isStreaming else scores
    pooled = marked.groupBy(F.window(time, window), genome).agg(F.avg(p).alias("score"), F.count(p).alias("n"))
    return pooled.select(F.col("window.start").alias("start"), genome, "score", "n")


class _RunningMean(StatefulProcessor):
    """Sum and count of a genome's scores; a timer tells genomes that have gone quiet."""

    def __init__(self, genome: str, p: str, idle_ms: int):
        self.genome, self.p, self.idle_ms = genome, p, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "total double, n long, latest long")

    def _row(self, key: tuple, total: float, n: int, final: bool) -> pd.DataFrame:
        return pd.DataFrame({self.genome: [key[0]], "score": [total / n if n else None], "n": [n], "final": [final]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, n, latest = self.sums.get() if self.sums.exists() else (0.0, 0, 0)
        for part in rows:
            known = part[self.p].dropna()
            total, n, latest = total + float(known.sum()), n + len(known), max(latest, int(part["event_ms"].max()))
        self.sums.update((total, n, latest))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(latest + self.idle_ms)
        yield self._row(key, total, n, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, n, _ = self.sums.get() if self.sums.exists() else (0.0, 0, 0)
        self.sums.clear()
        yield self._row(key, total, n, True)

    def close(self) -> None:
        pass


def running_means(scores: DataFrame, late: str, idle_ms: int, time: str = "ts", genome: str = "genome", p: str = "p") -> DataFrame:
    """``genome, score, n, final``: each genome's mean over all reads so far, after every batch that has some of it.

    The state is a sum and a count a genome.  Reads behind the watermark, ``late`` behind the latest
    time seen, are dropped.  Once the watermark is ``idle_ms`` past a genome's latest read, it gives a
    last row, ``final``, and its state is let go.  Null scores count as no read; a genome of nulls
    alone has a null mean.
    """
    kind = scores.schema[genome].dataType.simpleString()
    marked = scores.select(genome, time, F.col(p).cast("double").alias(p), F.unix_millis(time).alias("event_ms")).withWatermark(time, late)
    return marked.groupBy(genome).transformWithStateInPandas(_RunningMean(genome, p, idle_ms), f"{genome} {kind}, score double, n long, final boolean", "Update", "EventTime")


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def start_means(means: DataFrame, land: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start ``running_means`` over all that has arrived; the session's state store setting is put back."""
    conf = means.sparkSession.conf
    before = conf.get(STATE_STORE[0], None)
    conf.set(*STATE_STORE)
    try:
        return means.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(STATE_STORE[0]) if before is None else conf.set(STATE_STORE[0], before)
