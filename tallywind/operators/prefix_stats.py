"""Statistics over the smallest t percent of every group.

For a group of n values sorted upwards and a threshold t, the statistics cover the first
``n_t = max(1, floor(t * n / 100))`` values (all n for t = 100). That is not a quantile, so the
approximate percentile aggregates do not apply.

Groups of every size take one way. Equal values of a group are folded to one row with a weight. Fixed value ranges (slices), the same for every input, cut
the groups: values are ranked inside their slice, and a slice's offset is the running sum of the
smaller slices' weights. A group has 17,000 slices at most, whatever the input, and its rows never meet in one task. Small groups
have few rows to a slice, so slices are no finer than large ones need; ``slices`` makes them finer.
Conditional sums with partial results on the map side make the statistics. Two hashes stand for the keys inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Slices per doubling of the absolute value, as a power of two.
SLICES = 2
_KEY = ["h1", "h2"]


def norm_thresholds(thresholds) -> list[float]:
    """Keep 0 < t <= 100, two decimals, distinct, ascending."""
    return sorted({round(float(t), 2) for t in thresholds if 0 < t <= 100})


def _prefix_size(t: float, total: Column) -> Column:
    if t == 100:
        return total
    return F.greatest(F.lit(1), F.floor(F.lit(t) * total / F.lit(100.0))).cast("bigint")


def value_slice(value: Column, bits: int = SLICES) -> Column:
    """BIGINT that never falls as ``value`` grows: the signed logarithm in steps; infinities and NaN have their own."""
    # Logarithms of doubles lie above -1100, so the shifted one is positive.
    steps = F.floor((F.log2(F.abs(value)) + 1100) * 2**bits)
    slices = (
        F.when(F.isnan(value), F.lit(2**60)).when(value == float("inf"), F.lit(2**59)).when(value == float("-inf"), F.lit(-(2**59)))
        .when(value == 0, F.lit(0)).when(value > 0, steps).otherwise(-steps)
    )
    # Known not to be null, so that joins on it need no filters.
    return F.coalesce(slices.cast("bigint"), F.lit(0).cast("bigint"))


def _offsets(folded: DataFrame) -> DataFrame:
    """``h1, h2, slice, before, total, least``: the weight of the smaller slices, and weight and least value of the whole group."""
    parts = folded.groupBy(*_KEY, "slice").agg(
        F.sum("weight").alias("n"), F.min("value").alias("low"), F.max("seq").alias("last"), F.count("cust_ts").alias("timed")
    )
    group = W.partitionBy(*_KEY)
    upto = group.orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    # The test is always true. It makes this branch need the columns of the other one, so that both read one exchange.
    return parts.where((F.col("timed") >= 0) & ~F.isnull(F.coalesce("last", "n"))).select(
        *_KEY, "slice", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(group).alias("total"), F.min("low").over(group).alias("least")
    )


def prefix_stats(rows: DataFrame, keys: list[str], thresholds, slices: int = SLICES) -> DataFrame:
    """``keys, threshold, count, lower, upper, mean, stdev, seq, cust_ts`` per group and threshold.

    ``rows``: ``keys, value DOUBLE, seq BIGINT, cust_ts DOUBLE`` and, where equal values were
    counted beforehand, ``weight BIGINT``. Keys are not null. ``slices`` sets how fine the value ranges are; the result
    doesn't depend on it.
    """
    thresholds = norm_thresholds(thresholds)
    if not thresholds:
        raise ValueError("at least one threshold in (0, 100] is needed")
    weight = F.sum("weight") if "weight" in rows.columns else F.count(F.lit(1))
    folded = rows.withColumn("slice", value_slice(F.col("value"), slices)).groupBy(*keys, "slice", "value").agg(
        weight.alias("weight"), F.max_by("cust_ts", "seq").alias("cust_ts"), F.max("seq").alias("seq")
    )
    folded = folded.withColumns({"h1": F.xxhash64(*keys), "h2": F.xxhash64(F.lit("second"), *keys)})
    inside = W.partitionBy(*_KEY, "slice").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = folded.withColumn("end", F.sum("weight").over(inside)).join(_offsets(folded), [*_KEY, "slice"])
    start = F.col("before") + F.col("end") - F.col("weight")

    aggs: list[Column] = [
        F.max_by("cust_ts", "seq").alias("cust_ts"), F.max("seq").alias("seq"), F.min("value").alias("lower"),
        F.max("total").alias("total"),
    ]
    stats = []
    # Squares are taken from the least value, which every prefix contains: that keeps the digits of narrow prefixes.
    off = F.when(F.col("value") == F.col("least"), F.lit(0.0)).otherwise(F.col("value") - F.col("least"))
    for i, t in enumerate(thresholds):
        size = _prefix_size(t, F.col("total"))
        taken = F.least("weight", size - start)  # how many of the equal values of this row belong to the prefix
        some = taken > 0
        aggs += [
            F.max(F.when(some, F.col("value"))).alias(f"upper{i}"), F.sum(F.when(some, taken * F.col("value"))).alias(f"sum{i}"),
            F.sum(F.when(some, taken * off)).alias(f"off{i}"), F.sum(F.when(some, taken * off * off)).alias(f"squares{i}"),
        ]
        spread = F.col(f"squares{i}") - F.col(f"off{i}") * F.col(f"off{i}") / size
        variance = F.when(spread < 0, F.lit(0.0)).otherwise(spread) / (size - 1)
        stats.append(
            F.struct(
                F.lit(t).alias("threshold"), size.alias("count"), F.col("lower"), F.col(f"upper{i}").alias("upper"),
                (F.col(f"sum{i}") / size).alias("mean"), F.when(size > 1, F.sqrt(variance)).alias("stdev"),
            )
        )
    found = placed.groupBy(*keys).agg(*aggs)
    return found.select(*keys, "seq", "cust_ts", F.inline(F.array(*stats)))
