"""Flat JSON objects, one per line, checked strictly and typed per value.

Spark's JSON functions accept text after the object and nested values. An object of scalars is a
regular language, so one expression decides validity; ``from_json`` then only decodes strings.
All quantifiers are possessive: long lines neither backtrack nor recurse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.functions.maps import last_wins
from tallywind.functions.text import float_text, let, parse_float
from tallywind.functions.time import epoch, norm_epoch

_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_SCALAR = rf"(?:{_STRING}|{_NUMBER}|true|false|null|NaN|-?Infinity)"
_BLANK = r"[ \t]*+"
_MEMBER = rf"{_BLANK}{_STRING}{_BLANK}:{_BLANK}{_SCALAR}{_BLANK}"
FLAT_OBJECT = rf"^\{{{_MEMBER}(?:,{_MEMBER})*+\}}$"
_TOKEN = rf"{_STRING}{_BLANK}:{_BLANK}({_SCALAR})"


def is_flat_object(text: Column) -> Column:
    """Wholly one non-empty object whose values are all scalars or null."""
    return text.rlike(FLAT_OBJECT)


def _typed(token: Column, decoded: Column) -> Column:
    """``STRUCT<t, v>`` of a raw value token; ``decoded`` is the text if it is a string."""
    tag = (
        F.when(token.startswith('"'), "str").when(token.isin("true", "false"), "bool")
        .when(token == "null", "null").when(token.rlike("^-?[0-9]+$"), "int").otherwise("float")
    )

    def value(kind: Column) -> Column:
        number = F.when(token == "NaN", F.lit("nan")).when(token == "Infinity", F.lit("inf")).when(
            token == "-Infinity", F.lit("-inf")
        ).otherwise(float_text(token.try_cast("double")))
        text = (
            F.when(kind == "str", decoded).when(kind == "int", F.when(token == "-0", F.lit("0")).otherwise(token))
            .when(kind == "bool", F.initcap(token)).when(kind == "float", number)
        )
        return F.struct(kind.alias("t"), text.alias("v"))

    return let(tag, value)


def flat_values(text: Column) -> Column:
    """``MAP<STRING, STRUCT<t, v>>`` of a flat object; the last of repeated keys wins."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))
    decoded = F.map_entries(F.from_json(text, "map<string,string>"))
    typed = F.zip_with(
        decoded, tokens, lambda e, t: F.struct(e["key"].alias("key"), _typed(t, e["value"]).alias("value"))
    )
    # Spark may evaluate this on lines that a filter beside it rejects; those have no pairs.
    return last_wins(F.filter(typed, lambda e: e["key"].isNotNull()))


def read_json_events(lines: DataFrame) -> DataFrame:
    """Lines that are one flat object, with their typed ``values``."""
    good = lines.where(is_flat_object(F.col("line")))
    return good.withColumn("values", flat_values(F.col("line"))).drop("line")


def parse_json_events(lines: DataFrame, timestamp_window: float = 600.0) -> DataFrame:
    """Metric rows in the bucket ``metrics``: time is the member ``timestamp`` if it is near the
    arrival, and the arrival if there is none. A member that is no time drops the event.
    """
    received = F.round(epoch(F.col("recv_ts")), 3)

    def stamp(given: Column) -> Column:
        truth = (given["v"] == "True").cast("double")
        number = F.when(given["t"] == "bool", truth).otherwise(parse_float(given["v"]))
        return F.when(given.isNotNull(), F.struct(norm_epoch(number, None).alias("at")))

    # Most events carry no time, which a look at the text tells before the object is taken apart.
    worth_a_look = F.col("line").contains("timestamp") | F.col("line").contains("\\u")
    events = lines.where(is_flat_object(F.col("line"))).withColumn("values", flat_values(F.col("line")))
    stamped = events.withColumn(
        "own", F.when(worth_a_look, let(F.try_element_at("values", F.lit("timestamp")), stamp))
    )
    near = let(
        F.col("own"),
        lambda own: own.isNull()
        | F.coalesce(~F.isnan(own["at"]) & (F.abs(received - own["at"]) <= timestamp_window), F.lit(False)),
    )
    # Through a generator, so that the filter is not moved below the values and computes them again.
    kept = stamped.select("recv_ts", "seq", F.inline(F.array(F.struct("values", "own")))).where(near)
    return kept.select(
        F.lit("metrics").alias("bucket"),
        F.map_filter("values", lambda k, v: k != "timestamp").alias("values"),
        F.coalesce(F.nullif(F.col("own.at"), F.lit(0.0)), received).alias("ts"),
        F.from_json(F.lit("{}"), "map<string,string>").alias("tags"), "recv_ts", "seq",
    )
