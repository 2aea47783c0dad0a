"""Log events: JSON messages, the level threshold at the output, and metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.functions.maps import literal_map
from tallywind.functions.text import lstrip
from tallywind.operators.enrich import typed_value
from tallywind.sources.journal import FIELDS, level_name, threshold
from tallywind.sources.json_events import flat_values, is_flat_object

# Process and user ids are numbers in the journal.
_NUMERIC = ("pid", "uid", "gid")


def _event_fields(df: DataFrame) -> list[str]:
    return [f for f in [*FIELDS.values(), "level", "facility"] if f in df.columns]


def _named(df: DataFrame, names: dict[str, str | None] | None) -> dict[str, str]:
    """Event fields and what they are called in results; those renamed to None aren't there."""
    called = {f: (names or {}).get(f, f) for f in _event_fields(df)}
    return {f: name for f, name in called.items() if name is not None}


def decode_json_message(df: DataFrame, names: dict[str, str | None] | None = None) -> DataFrame:
    """Adds ``is_json`` and ``extra``: members of a JSON message that the event does not have.

    The message itself goes. Anything but one flat object leaves the event as it was. ``names``: see :func:`log_rows`.
    """
    called = {f: name for f, name in _named(df, names).items() if f != "message"}
    present = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(name)) for f, name in called.items()]))
    text = lstrip(F.col("message"))
    marked = df.withColumns({"is_json": is_flat_object(text), "present": present})
    added = F.map_filter(flat_values(text), lambda k, v: ~F.array_contains("present", k))
    return marked.withColumns(
        {
            "extra": F.when(F.col("is_json"), added),
            "message": F.when(~F.col("is_json"), F.col("message")),
        }
    ).drop("present")


def at_level(df: DataFrame, level: str) -> DataFrame:
    """Keep events at or above the threshold; lower numbers are more severe."""
    return df.where(F.col("level").isNull() | (F.col("level") <= threshold(level)))


def with_level_words(df: DataFrame) -> DataFrame:
    return df.withColumn("level", level_name(F.col("level")))


def _entry(field: str, kind: str, name: str) -> Column:
    value = F.col(field)
    if field in _NUMERIC and kind == "string":
        number = F.struct(F.lit("int").alias("t"), value.alias("v"))
        typed = F.when(value.rlike("^(0|-?[1-9][0-9]*)$"), number).otherwise(typed_value(value, kind))
    else:
        typed = typed_value(value, kind)
    return F.struct(F.lit(name).alias("key"), typed.alias("value"))


def log_rows(df: DataFrame, bucket: str = "logs", level: str = "INFO", names: dict[str, str | None] | None = None) -> DataFrame:
    """Output step: threshold again, words for levels, then metric rows in ``bucket``.

    ``names`` maps event fields, as ``level`` and ``facility``, to other names, or to None to leave them out.
    """
    events = with_level_words(at_level(df, level))
    kinds = dict(events.dtypes)
    own = F.filter(
        F.array(*[_entry(f, kinds[f], name) for f, name in _named(events, names).items()]), lambda e: e["value"]["t"] != "null"
    )
    values = F.map_from_entries(own)
    if "extra" in events.columns:
        values = F.when(F.col("extra").isNull(), values).otherwise(F.map_concat(values, "extra"))
    extra = [c for c in ("recv_ts", "seq") if c in events.columns]
    return events.select(F.lit(bucket).alias("bucket"), values.alias("values"), "ts", literal_map({}).alias("tags"), *extra)
