"""Tumbling-window aggregates of samples, by series.

Every aggregate comes in two halves. ``partial`` is a plain grouped aggregation that runs on batch
and on streaming frames; ``finish`` turns partial rows of complete windows into results and may use
joins and window functions. ``agg_*`` chains both for batch input; the streaming side runs the same ``finish``
on windows that the watermark has closed (:mod:`tallywind.streaming.windows`).

Windows are cut on arrival time; custom timestamps only label results. All order-dependent parts
use the one BIGINT arrival number ``seq``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywind.functions.maps import put_default
from tallywind.functions.text import float_text
from tallywind.functions.time import emit_ts, micros
from tallywind.operators.ranges import RANGE_ROWS, range_ends, range_of
from tallywind.operators.prefix_stats import SLICES, norm_thresholds, prefix_stats

GROUP = ["win", "series"]


def tumbling(interval: float) -> Column:
    return F.window("recv_ts", micros(interval)).alias("win")


def _last() -> list[Column]:
    """Latest sample of the group: its number and its custom time, which may be missing."""
    return [F.max_by("cust_ts", "seq").alias("cust_ts"), F.max("seq").alias("seq")]


def _labelled(df: DataFrame, add_timestamps: bool, *fields: Column | str) -> DataFrame:
    return df.select(
        F.col("win.start").alias("win_start"), F.col("win.end").alias("win_end"),
        F.map_from_entries("series").alias("tags"),
        emit_ts(F.col("cust_ts"), F.col("win.end"), add_timestamps).alias("ts"), *fields,
    )


# Counters ------------------------------------------------------------------------------------


def counter_partials(samples: DataFrame, interval: float) -> DataFrame:
    rows = samples.where("kind = 'counter'")
    return rows.groupBy(tumbling(interval), "series").agg(
        F.sum(F.col("value") / F.col("rate")).alias("count"), *_last()
    )


def finish_counters(partials: DataFrame, interval: float, add_timestamps: bool = True) -> DataFrame:
    return _labelled(partials, add_timestamps, (F.col("count") / interval).alias("rate"), "count")


def agg_counters(samples: DataFrame, interval: float, add_timestamps: bool = True) -> DataFrame:
    """``count`` = sum of value / sample rate, ``rate`` = count per second."""
    return finish_counters(counter_partials(samples, interval), interval, add_timestamps)


# Gauges --------------------------------------------------------------------------------------


def gauge_rows(samples: DataFrame, interval: float, *more: str) -> DataFrame:
    return samples.where("kind = 'gauge'").select(
        tumbling(interval), "series", "seq", "value", "cust_ts", F.col("raw").rlike("^[+-]").alias("delta"), *more
    )


def gauge_parts(rows: DataFrame, ends: list[int]) -> DataFrame:
    """Each series in ranges of arrival numbers: a range comes down to its last plain value and the sum of the deltas after it.

    Of plain values with one arrival number the largest counts, and deltas with that number come after it.
    """
    cut = rows.withColumn("range", range_of(F.col("seq"), ends))
    plain = F.when(~F.col("delta"), F.struct("seq", "value"))
    local = cut.withColumn("base", F.max(plain).over(W.partitionBy(*GROUP, "range")))
    later = F.col("delta") & (F.col("base").isNull() | (F.col("seq") >= F.col("base.seq")))
    return local.groupBy(*GROUP, "range").agg(
        F.max("base.seq").alias("base_seq"), F.max("base.value").alias("base_value"),
        F.sum(F.when(later, F.col("value"))).alias("deltas"), *_last(),
    )


def finish_gauges(parts: DataFrame, add_timestamps: bool = True) -> DataFrame:
    """Puts the ranges of each series together; it has as many rows, 4,096 at most."""
    newest = F.when(F.col("base_seq").isNotNull(), F.struct("range", "base_value"))
    parts = parts.withColumn("top", F.max(newest).over(W.partitionBy(*GROUP)))
    counted = F.col("top").isNull() | (F.col("range") >= F.col("top.range"))
    joined = parts.groupBy(*GROUP).agg(
        F.max("top.base_value").alias("base"), F.sum(F.when(counted, F.col("deltas"))).alias("deltas"), *_last()
    )
    value = F.coalesce(F.col("base") + F.col("deltas"), "base", "deltas").alias("value")
    return _labelled(joined, add_timestamps, value)


def agg_gauges(
    samples: DataFrame, interval: float, add_timestamps: bool = True, range_rows: int = RANGE_ROWS, ends: list[int] | None = None
) -> DataFrame:
    """Last plain value of the window plus the ``+n`` / ``-n`` deltas that arrived after it.

    Each series is worked off in ranges of about ``range_rows`` samples of all series. Unless ``ends`` are given, the ranges of
    arrival numbers are looked up in ``samples`` when this is called.
    """
    if ends is None:
        ends = range_ends(samples.where("kind = 'gauge'"), "seq", range_rows)
    return finish_gauges(gauge_parts(gauge_rows(samples, interval), ends), add_timestamps)


# Sets ----------------------------------------------------------------------------------------


def set_partials(samples: DataFrame, interval: float) -> DataFrame:
    return samples.where("kind = 'set'").groupBy(tumbling(interval), "series", "raw").agg(*_last())


def finish_sets(partials: DataFrame, add_timestamps: bool = True) -> DataFrame:
    counted = partials.groupBy(*GROUP).agg(F.count("*").alias("count"), *_last())
    return _labelled(counted, add_timestamps, "count")


#: Registers of a sketch, as a power of two: a standard error of 1.04 / sqrt(2^12) = 1.6 %, in 4 kB at most for a series and window.
SKETCH_BITS = 12


def sketched_set_partials(samples: DataFrame, interval: float, bits: int = SKETCH_BITS) -> DataFrame:
    """One HyperLogLog sketch per series and window instead of one row per value; small sets are held as they are."""
    rows = samples.where("kind = 'set'")
    return rows.groupBy(tumbling(interval), "series").agg(F.hll_sketch_agg("raw", bits).alias("sketch"), *_last())


def finish_sketched_sets(partials: DataFrame, add_timestamps: bool = True) -> DataFrame:
    return _labelled(partials, add_timestamps, F.hll_sketch_estimate("sketch").alias("count"))


def agg_sets(samples: DataFrame, interval: float, add_timestamps: bool = True, approx: bool = False) -> DataFrame:
    """Distinct raw values per window; ``approx`` trades exactness (see ``SKETCH_BITS``) for one small shuffle."""
    if approx:
        return finish_sketched_sets(sketched_set_partials(samples, interval), add_timestamps)
    return finish_sets(set_partials(samples, interval), add_timestamps)


# Timers --------------------------------------------------------------------------------------


def timer_partials(samples: DataFrame, interval: float) -> DataFrame:
    return samples.where("kind = 'timer'").groupBy(tumbling(interval), "series", "value").agg(
        F.count("*").alias("weight"), *_last()
    )


def finish_timers(
    rows: DataFrame, thresholds, interval: float, add_timestamps: bool = True, slices: int = SLICES
) -> DataFrame:
    stats = prefix_stats(rows, GROUP, thresholds, slices)
    out = _labelled(
        stats, add_timestamps, "threshold", "count", (F.col("count") / interval).alias("count_ps"),
        "lower", "upper", "mean", "stdev",
    )
    return out.withColumn("tags", put_default(F.col("tags"), "percentile", float_text(F.col("threshold"))))


def agg_timers(
    samples: DataFrame, thresholds, interval: float, add_timestamps: bool = True, slices: int = SLICES
) -> DataFrame:
    """Statistics over the smallest t percent of the values, one row per threshold."""
    if not norm_thresholds(thresholds):  # no threshold, no rows
        rows = timer_partials(samples, interval)
        return finish_timers(rows, [100], interval, add_timestamps, slices).where(F.lit(False))
    rows = samples.where("kind = 'timer'").select(
        tumbling(interval), "series", "value", "seq", "cust_ts"
    )
    return finish_timers(rows, thresholds, interval, add_timestamps, slices)


# Histograms ----------------------------------------------------------------------------------


def histogram_partials(samples: DataFrame, bins: Callable[[Column, Column], Column], interval: float) -> DataFrame:
    binned = samples.where("kind = 'timer'").withColumn("bin", bins(F.col("tags"), F.col("value")))
    return binned.where("bin IS NOT NULL AND bin != ''").groupBy(tumbling(interval), "series", "bin").agg(
        F.count("*").alias("count"), F.min("value").alias("lower"), F.max("value").alias("upper"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("stdev"), *_last(),
    )


def finish_histograms(partials: DataFrame, interval: float, add_timestamps: bool = True) -> DataFrame:
    # The custom time is that of the latest binned sample of the series, shared by its bins.
    group = W.partitionBy(*GROUP)
    shared = partials.withColumn("cust_ts", F.max_by("cust_ts", "seq").over(group))
    out = _labelled(
        shared, add_timestamps, "bin", "count", (F.col("count") / interval).alias("count_ps"),
        "lower", "upper", "mean", "stdev",
    )
    return out.withColumn("tags", put_default(F.col("tags"), "histogram", F.col("bin")))


def agg_histograms(
    samples: DataFrame, bins: Callable[[Column, Column], Column], interval: float, add_timestamps: bool = True
) -> DataFrame:
    """Count, range, mean and deviation per bin; see :mod:`tallywind.operators.bins`."""
    return finish_histograms(histogram_partials(samples, bins, interval), interval, add_timestamps)
