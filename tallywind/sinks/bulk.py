"""Bulk documents: an action line and a document line per row, with an id made of the content.

The same row always gets the same id, so delivering twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.functions.maps import literal_map, series
from tallywind.functions.text import json_string, name_uuid
from tallywind.functions.time import epoch, micros


def json_value(typed: Column) -> Column:
    """JSON text of a typed value."""
    return (
        F.when(typed["t"] == "str", json_string(typed["v"]))
        .when(typed["t"] == "null", F.lit("null"))
        .when(typed["t"] == "bool", F.lower(typed["v"]))
        .when(typed["v"] == "nan", F.lit("NaN"))
        .when(typed["v"] == "inf", F.lit("Infinity"))
        .when(typed["v"] == "-inf", F.lit("-Infinity"))
        .otherwise(typed["v"])
    )


def _as_strings(tags: Column) -> Column:
    return F.transform_values(tags, lambda k, v: F.struct(F.lit("str").alias("t"), v.alias("v")))


def with_index(rows: DataFrame, index: str | Callable[[Column, Column, Column], Column] | None) -> DataFrame:
    """Index per row: fixed, computed from (bucket, values, ts), or the bucket. Rows without one go."""
    if callable(index):
        name = index(F.col("bucket"), F.col("values"), F.col("ts"))
    else:
        name = F.lit(index) if index else F.col("bucket")
    return rows.withColumn("index", name).where("index IS NOT NULL AND index != ''")


def daily_index(prefix: str) -> Callable[[Column, Column, Column], Column]:
    """``prefix-2024-01-31``, by UTC day of the row."""
    def day(ts: Column) -> Column:
        return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86400).cast("int")).cast("string")

    return lambda bucket, values, ts: F.concat(F.lit(prefix + "-"), day(ts))


def to_bulk(
    rows: DataFrame,
    index: str | Callable[[Column, Column, Column], Column] | None = None,
    static: dict[str, str] | None = None,
    bucket_field: str | None = "bucket",
    timestamp_field: str | None = "timestamp",
    add_type: bool = False,
    type_name: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``index, id, doc, action``. Values win over tags, tags over static tags; the time is in ms.

    Rows need ``recv_ts`` where ``ts`` may be missing. ``keep`` names columns of ``rows`` to hand on.
    """
    arrival = [epoch(F.col("recv_ts"))] if "recv_ts" in rows.columns else []
    rows = rows.withColumn("ts", F.coalesce(F.nullif("ts", F.lit(0.0)), *arrival))
    rows = rows.withColumn("tags", F.coalesce("tags", literal_map({})))
    # Values first, then what tags and static tags add; the index rule sees all of them.
    layers = [_as_strings(F.col("tags"))] + ([_as_strings(literal_map(static))] if static else [])
    for layer in layers:
        added = F.map_filter(layer, lambda k, v: ~F.map_contains_key("values", k))
        rows = rows.withColumn("values", F.map_concat("values", added))
    rows = with_index(rows, index)
    extra = {}
    if timestamp_field:
        millis = F.bround(F.col("ts") * 1000).cast("bigint").cast("string")
        extra[timestamp_field] = F.struct(F.lit("int").alias("t"), millis.alias("v"))
    if bucket_field:
        extra[bucket_field] = F.struct(F.lit("str").alias("t"), F.col("bucket").alias("v"))
    parts = [F.map_filter("values", lambda k, v: ~k.isin(list(extra)))] if extra else [F.col("values")]
    parts += [F.create_map(F.lit(name), value) for name, value in extra.items()]
    entries = F.array_join(
        F.transform(
            series(F.map_concat(*parts)), lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_value(e["value"]))
        ),
        ",",
    )
    doc = F.concat(F.lit("{"), entries, F.lit("}"))
    kind = F.coalesce(F.lit(type_name), F.col("bucket"))
    typed = [F.lit(',"_type":'), json_string(kind)] if add_type else []
    action = F.concat(
        F.lit('{"index":{"_index":'), json_string(F.col("index")), *typed,
        F.lit(',"_id":"'), F.col("id"), F.lit('"}}'),
    )
    out = rows.withColumn("doc", doc).withColumn("id", name_uuid(F.col("doc")))
    return out.withColumn("action", action).select("index", "id", "doc", "action", *(keep or []))


def dedupe_bulk(docs: DataFrame, delay: float | None = None) -> DataFrame:
    """Repeated deliveries of a document fold into one.

    On a stream ``docs`` have their arrival time in ``recv_ts`` (see ``keep`` of :func:`to_bulk`), and a document that comes again up
    to ``delay`` seconds after it first came is dropped, in whatever batch; only ids are held, and for so long.
    """
    if not docs.isStreaming:
        return docs.dropDuplicates(["index", "id"])
    if delay is None:
        raise ValueError("a stream needs a delay")
    return docs.withWatermark("recv_ts", micros(delay)).dropDuplicatesWithinWatermark(["index", "id"])


def write_bulk(docs: DataFrame, path: str, compression: str | None = None) -> None:
    """Newline-delimited action and document lines."""
    text = docs.select(F.concat_ws("\n", "action", "doc").alias("value"))
    text.write.mode("overwrite").text(path, compression=compression)
