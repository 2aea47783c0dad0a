"""Counters of the pipeline itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallywind.functions.maps import literal_map
from tallywind.functions.time import epoch
from tallywind.operators.aggregate import tumbling
from tallywind.operators.enrich import typed_value

_ITEM = "struct<status:int>"
RESPONSE_SCHEMA = (
    f"errors boolean, items array<struct<status:int,index:{_ITEM},create:{_ITEM},update:{_ITEM},delete:{_ITEM}>>"
)


def line_report(classified: DataFrame) -> DataFrame:
    """Received, rejected and produced lines by outcome, from classified lines."""
    outcome = F.coalesce("reject_reason", F.lit("accepted"))
    return classified.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("lines"))


def counter_rows(df: DataFrame, interval: float, bucket: str = "pipeline", tags: dict[str, Column] | None = None, **conditions: Column) -> DataFrame:
    """The pipeline's own counters as metric rows that any sink takes: one per window of arrival and combination of ``tags``.

    ``received`` counts all rows, each further field the rows that meet its condition (null: does not), as
    ``rejected=reject_reason.isNotNull()``. One pass, and only partial counts are shuffled.
    """
    keys = [value.cast("string").alias(f"tag_{k}") for k, value in (tags or {}).items()]
    counts = {"received": F.count(F.lit(1)), **{name: F.count_if(F.coalesce(c, F.lit(False))) for name, c in conditions.items()}}
    counted = df.groupBy(tumbling(interval), *keys).agg(*[c.alias(f"n_{name}") for name, c in counts.items()])
    names = [x for k in tags or {} for x in (F.lit(k), F.col(f"tag_{k}"))]
    own = F.create_map(*names) if names else literal_map({})
    return counted.select(
        F.lit(bucket).alias("bucket"),
        F.create_map(*[x for name in counts for x in (F.lit(name), typed_value(F.col(f"n_{name}"), "bigint"))]).alias("values"),
        epoch(F.col("win.end")).alias("ts"), F.map_filter(own, lambda k, v: v.isNotNull()).alias("tags"), F.col("win.end").alias("recv_ts"),
    )


def observed(df: DataFrame, name: str, **conditions) -> tuple[DataFrame, Observation]:
    """Count rows, and rows that meet each condition, while they pass by; no extra job.

    On a stream the counts arrive with every progress event under the same name.
    """
    watch = Observation(name)
    counts = [F.count("*").alias("rows")] + [F.count_if(c).alias(k) for k, c in conditions.items()]
    if df.isStreaming:
        return df.observe(name, *counts), watch
    return df.observe(watch, *counts), watch


def bulk_rejects(responses: DataFrame) -> DataFrame:
    """Per response (column ``body``): documents with a status outside 200-299, if it has errors.

    The status stands inside the action; one at the top of the item counts as well.
    """
    parsed = responses.withColumn("answer", F.from_json("body", RESPONSE_SCHEMA))
    status = lambda i: F.coalesce(
        i["status"], i["index"]["status"], i["create"]["status"], i["update"]["status"], i["delete"]["status"], F.lit(200)
    )
    bad = F.size(F.filter("answer.items", lambda i: (status(i) < 200) | (status(i) >= 300)))
    rejected = F.when(F.coalesce("answer.errors", F.lit(False)), F.greatest(bad, F.lit(0))).otherwise(F.lit(0))
    return parsed.withColumn("rejected", rejected).drop("answer", "body")
