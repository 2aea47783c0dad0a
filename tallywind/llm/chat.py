"""Chat formatting by multi-party perspective rotation.

A dialogue is rendered once for every participant: that speaker is the assistant, the others are users with their names, and
the loss mask covers what the speaker says. System messages are context in all renderings and no participant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.llm.tables import land, small

#: Messages a part holds besides its context; longer dialogues are rendered in consecutive parts.
PART_TURNS = 512


def _placed(messages: DataFrame, part_turns: int) -> DataFrame:
    """`messages` with their `part`: their position in the ordered dialogue div `part_turns`.

    Rows are sorted and landed in ranges; positions are running counts over the ranges, so no dialogue lies in one task.
    """
    order = ["conv_id", "turn", "role", "text"]
    ranges = land(messages.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("n")))
    counts = ranges.groupBy("conv_id", "range").agg(F.min("n").alias("first"), F.count("*").alias("n_rows"))
    # One row per range of a dialogue.
    past = F.coalesce(F.sum("n_rows").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(F.col("conv_id").alias("base_id"), F.col("range").alias("base_range"), (past - F.col("first")).alias("base"))
    placed = ranges.join(small(bases), F.col("conv_id").eqNullSafe(F.col("base_id")) & (F.col("range") == F.col("base_range")))
    return placed.select(*order, F.floor((F.col("base") + F.col("n")) / part_turns).cast("bigint").alias("part"))


def _long_views(messages: DataFrame, part_turns: int, system: str) -> DataFrame:
    """`conv_id, part, messages, speaker` of dialogues of any length."""
    placed = land(_placed(messages, part_turns))
    message = F.struct("turn", "role", "text")
    parts = placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(message)).alias("own"))
    # One row per part, one per participant.
    numbers = placed.select(F.col("conv_id").alias("id"), F.col("part").alias("later")).distinct()
    speakers = placed.filter(F.col("role") != system).select(F.col("conv_id").alias("id"), F.col("role").alias("speaker")).distinct()
    said = placed.filter(F.col("role") == system).join(small(numbers), F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("part") < F.col("later")))
    context = said.groupBy("id", "later").agg(F.array_sort(F.collect_list(message)).alias("context"))
    parts = parts.join(context, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("part") == F.col("later")), "left").drop("id", "later")
    messages = F.when(F.col("context").isNull(), F.col("own")).otherwise(F.concat("context", "own"))
    parts = parts.select("conv_id", "part", messages.alias("messages"))
    return parts.join(small(speakers), F.col("conv_id").eqNullSafe(F.col("id"))).select("conv_id", "part", "messages", "speaker")


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS, system: str = "system") -> DataFrame:
    """`conv_id, part, speaker, n_turns, n_own, text, masks` for every participant and every part of a dialogue.

    `conversations` has `conv_id, turn, role, text`. Messages go by turn, then role, then text; repeated rows count once.
    A part holds the next `part_turns` messages, after the system messages of the parts before as its context; every
    participant of the dialogue has a view of every part. `n_turns` counts all messages of the rendering. A null conversation is
    one of its own, null turns come first, a null role is the participant "", null text is empty.
    A dialogue with system messages only, and an empty table, give no rows. `masks` are `start, end` of the speaker's
    texts with their end marks, in code points of `text`, end exclusive.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # One row per `part_turns` rows at most.
    long = small(rows.groupBy("conv_id").count().filter(F.col("count") > part_turns).select(F.col("conv_id").alias("long_id")))
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = rows.join(long, is_long, "left_anti").distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    speakers = F.array_distinct(F.filter(F.transform("messages", lambda m: m["role"]), lambda r: r != system))
    views = short.select("conv_id", F.lit(0).cast("bigint").alias("part"), "messages", F.explode(speakers).alias("speaker"))
    views = views.unionByName(_long_views(rows.join(long, is_long, "left_semi").distinct(), part_turns, system))
    views = views.withColumn(
        "pieces",
        F.expr(
            f"""transform(messages, m -> struct(
                CASE WHEN m.role = speaker THEN '<|assistant|>\\n' WHEN m.role = '{system}' THEN '<|system|>\\n'
                     ELSE concat('<|user name="', m.role, '"|>\\n') END AS head,
                concat(m.text, '<|end|>\\n') AS body, m.role = speaker AS own))"""
        ),
    )
    masks = F.expr(
        """aggregate(pieces, struct(0 AS past, cast(array() AS array<struct<start:int, end:int>>) AS masks), (a, p) -> struct(
            a.past + length(p.head) + length(p.body) AS past,
            CASE WHEN p.own THEN concat(a.masks, array(struct(a.past + length(p.head) AS start,
                a.past + length(p.head) + length(p.body) AS end))) ELSE a.masks END AS masks), a -> a.masks)"""
    )
    return views.select(
        "conv_id", "part", "speaker", F.size("messages").cast("long").alias("n_turns"), F.expr("cast(size(filter(pieces, p -> p.own)) AS bigint)").alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"), masks.alias("masks"),
    )
