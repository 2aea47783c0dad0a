"""Sharding by proportional stratified interleaving.

Rows are put in a seeded random order within their source; row r of n gets the fraction (2 r - 1) / 2 n. Sorted by that
fraction, any stretch holds the sources in the proportions of the whole, so equal cuts give shards that match the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.llm.tables import land


def with_position(frame: DataFrame, order: list[str]) -> DataFrame:
    """Adds `position`, from 0 in that order over all rows, and `total`, the number of rows.

    A range shuffle sorts the rows over many tasks, their places are landed, and a table with one row per task, as small
    as the number of tasks, holds how many rows come before each.
    """
    sorted_rows = frame.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    numbered = land(sorted_rows.withColumn("id", F.monotonically_increasing_id()))
    placed = numbered.withColumn("part", F.shiftright("id", 33)).withColumn("place", F.col("id").bitwiseAND((1 << 33) - 1)).drop("id")
    counts = placed.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"), F.sum("count").over(whole).alias("total"))
    return placed.join(F.broadcast(starts), "part").withColumn("position", F.col("start") + F.col("place")).drop("part", "place", "start")


def assign_shards(documents: DataFrame, shards: int = 24, seed: int = 17, stratum: str = "source") -> DataFrame:
    """`doc_id, stratum, size, text_crc32, shard, slot` for every row: shards differ by one row at most.

    `size` is the UTF-8 bytes of the text plus 8. Null sources are a source of their own, null text counts as empty, and
    equal rows are interchangeable: each has its own place. An empty table gives no rows. Ties in the fraction are
    settled by source and shuffle order.
    """
    text = F.coalesce(documents["text"], F.lit(""))
    rows = documents.select(
        documents["doc_id"].alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), documents[stratum].cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), documents["doc_id"], text).alias("shuffle"), F.monotonically_increasing_id().alias("tie"),
    )
    placed = with_position(rows, ["stratum", "shuffle", "tie"]).drop("total")
    sources = placed.groupBy("stratum").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
    ranked = placed.join(sources, "stratum").withColumn(
        "fraction", (2 * (F.col("position") - F.col("first")) + 1).cast("double") / (2 * F.col("n")).cast("double")
    )
    mixed = with_position(ranked.drop("position", "first", "n"), ["fraction", "stratum", "shuffle", "tie"])
    shard = F.expr(f"cast(position * {shards} div total AS int)")
    return mixed.withColumn("shard", shard).select(
        "doc_id", "stratum", "size", "text_crc32", "shard",
        F.expr(f"position - (shard * total + {shards - 1}) div {shards}").alias("slot"),
    )
