"""Bounded outputs: newest rows, rows per flush, chunks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywind.operators.ranges import RANGE_ROWS, range_ends, range_of


def cap_newest(df: DataFrame, limit: int = 10_000, order: str = "seq") -> DataFrame:
    """All rows if there are at most ``limit``; otherwise the newest ``limit / 2``. A limit below 100 counts as 100.

    One top-k over the input decides both: the window sees ``limit + 1`` rows at most.
    """
    limit = max(limit, 100)
    top = df.orderBy(F.desc(order)).limit(limit + 1)
    ranked = top.withColumns(
        {"_rank": F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(order))),
         "_rows": F.count("*").over(W.partitionBy(F.lit(0)))}
    )
    return ranked.where((F.col("_rows") <= limit) | (F.col("_rank") <= limit // 2)).drop("_rank", "_rows")


def push_limit(df: DataFrame, limit: int, order: str = "seq") -> DataFrame:
    """At most ``limit`` rows per flush, oldest first."""
    return df.orderBy(order).limit(limit)


def pack_chunks(
    df: DataFrame, flush: list[str], n: int = 300, line: Column | str = "line", range_rows: int = RANGE_ROWS, ends: list[int] | None = None
) -> DataFrame:
    """``flush, chunk, rows, payload``: up to ``n`` consecutive lines by arrival number, joined by newlines.

    Chunks never cross a flush; only the last one of a flush is short. Lines with one number follow each other by their text. A
    flush of any size is numbered in ranges of about ``range_rows`` lines (places within a range, plus the counts of the
    ranges before it), however arrival numbers are spread; ``ends`` cuts them elsewhere.
    """
    text = F.col(line) if isinstance(line, str) else line
    ends = range_ends(df, "seq", range_rows) if ends is None else ends
    cut = df.select(*flush, "seq", text.alias("line")).withColumn("range", range_of(F.col("seq"), ends))
    keys = [*flush, "range"]
    counts = cut.groupBy(*keys).agg(F.count("*").alias("n_range"))
    # One row per range: 4,096 to a flush at most.
    earlier = W.partitionBy(*flush).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(c).alias(f"start_{c}") for c in keys], F.coalesce(F.sum("n_range").over(earlier), F.lit(0)).alias("start")
    )
    placed = cut.join(starts, [F.col(c).eqNullSafe(F.col(f"start_{c}")) for c in keys])
    place = F.row_number().over(W.partitionBy(*keys).orderBy("seq", "line")) + F.col("start")
    packed = placed.withColumn("chunk", F.floor((place - 1) / n).cast("bigint")).groupBy(*flush, "chunk").agg(
        F.count("*").alias("rows"), F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("lines")
    )
    return packed.select(*flush, "chunk", "rows", F.array_join(F.col("lines.line"), "\n").alias("payload"))
