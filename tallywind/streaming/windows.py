"""Windowed aggregates on streams.

The stream side keeps partial aggregates in the state store, keyed by series and, where results
need it, by value or a part of the window: a busy series is spread over all state partitions. When the watermark
closes a window, all of its partial rows come out in one micro-batch, and the same ``finish`` step as in batch turns
them into results. Windows are cut on arrival time, so the watermark only has to cover delays of
the transport.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywind.functions.time import micros
from tallywind.operators import aggregate as A
from tallywind.streaming import stateful


@dataclass(frozen=True)
class Family:
    partial: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]


def counters(interval: float, add_timestamps: bool = True) -> Family:
    return Family(
        lambda s: A.counter_partials(s, interval), lambda p: A.finish_counters(p, interval, add_timestamps)
    )


def gauges(interval: float, add_timestamps: bool = True) -> Family:
    return Family(lambda s: stateful.gauge_parts(s, interval), lambda p: A.finish_gauges(p, add_timestamps))


def sets(interval: float, add_timestamps: bool = True, approx: bool = False) -> Family:
    """``approx`` keeps one sketch per series and window in state instead of one row per value."""
    if approx:
        return Family(lambda s: A.sketched_set_partials(s, interval), lambda p: A.finish_sketched_sets(p, add_timestamps))
    return Family(lambda s: A.set_partials(s, interval), lambda p: A.finish_sets(p, add_timestamps))


def timers(thresholds, interval: float, add_timestamps: bool = True) -> Family:
    return Family(
        lambda s: A.timer_partials(s, interval), lambda p: A.finish_timers(p, thresholds, interval, add_timestamps)
    )


def histograms(bins: Callable[[Column, Column], Column], interval: float, add_timestamps: bool = True) -> Family:
    return Family(
        lambda s: A.histogram_partials(s, bins, interval), lambda p: A.finish_histograms(p, interval, add_timestamps)
    )


def start_windows(
    samples: DataFrame, family: Family, delay: float, checkpoint: str,
    sink: Callable[[DataFrame, int], None], trigger: dict | None = None,
) -> StreamingQuery:
    """Run one family; ``sink(results, batch_id)`` gets the results of closed windows.

    After a failure a batch may come again with the same id, so sinks should replace by id, as
    :func:`parquet_sink` does.
    """
    timed = samples.withWatermark("recv_ts", micros(delay))
    # Reading the time column keeps the filters on kinds and bins above the watermark, so that samples of
    # every kind move the clock and a quiet family still closes its windows.
    timed = timed.withColumns({c: F.when(F.col("recv_ts").isNotNull(), F.col(c)) for c in ("kind", "tags", "value")})
    partials = family.partial(timed)

    def finish(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                sink(family.finish(batch), batch_id)
        finally:
            batch.unpersist()

    writer = partials.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(finish).trigger(**(trigger or {"availableNow": True})).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """One folder per batch, replaced if the batch comes again."""

    def write(results: DataFrame, batch_id: int) -> None:
        results.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def end_marker(rows: DataFrame, end: float, after: float = 10 * 365 * 86400.0) -> DataFrame:
    """One of ``rows`` with an arrival time far beyond ``end`` (epoch seconds).

    As a source's last input it moves the watermark past all open windows, so that they are flushed. Its own window stays open.
    """
    return rows.limit(1).withColumn("recv_ts", F.timestamp_micros(F.lit(round((end + after) * 1000000))))
