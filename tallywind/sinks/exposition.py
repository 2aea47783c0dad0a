"""Exposition text: one line per series and numeric field, newest value only, with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.functions.maps import put, series
from tallywind.functions.time import epoch


def explode_fields(rows: DataFrame) -> DataFrame:
    """One row per numeric field; the tag ``value`` names the field. Booleans count as 0 and 1."""
    named = rows.select("*", F.explode("values").alias("field", "typed")).where(F.col("typed.t").isin("int", "float", "bool"))
    number = F.when(F.col("typed.t") == "bool", F.when(F.col("typed.v") == "True", F.lit("1")).otherwise(F.lit("0")))
    return named.withColumns(
        {"number": number.otherwise(F.col("typed.v")), "tags": put(F.coalesce("tags", F.from_json(F.lit("{}"), "map<string,string>")), "value", F.col("field"))}
    ).drop("values", "typed", "field")


def series_text(bucket: Column, tags: Column) -> Column:
    """``bucket{k="v",...}`` with sorted keys."""

    def quoted(e: Column) -> Column:
        value = F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(e["key"], F.lit('="'), value, F.lit('"'))

    body = F.array_join(F.transform(series(tags), quoted), ",")
    return F.when(F.size(tags) > 0, F.concat(bucket, F.lit("{"), body, F.lit("}"))).otherwise(bucket)


def exposition_lines(rows: DataFrame) -> DataFrame:
    """Metric rows to ``series, line`` plus the arrival columns ``recv_ts, seq``."""
    fields = explode_fields(rows)
    name = series_text(F.col("bucket"), F.col("tags"))
    millis = (F.col("ts") * 1000).cast("bigint").cast("string")
    named = fields.withColumn("series", name)
    line = F.concat_ws(" ", "series", "number", millis)
    return named.select("series", line.alias("line"), "recv_ts", "seq")


def latest_series(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Newest row per series by arrival ``(recv_ts, seq)``, with map-side partial maxima."""
    keys = keys or ["series"]
    rest = [c for c in lines.columns if c not in keys]
    newest = lines.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("recv_ts", "seq")).alias("newest"))
    return newest.select(*keys, "newest.*")


def expire(lines: DataFrame, now: Column, ttl: float) -> DataFrame:
    """Drop what arrived more than ``ttl`` seconds before ``now`` (epoch seconds)."""
    return lines.where(now - epoch(F.col("recv_ts")) <= ttl)


def to_exposition(rows: DataFrame, now: Column | None = None, ttl: float | None = None) -> DataFrame:
    """``series, line``. Expired rows go first: a series lives on its newest row, so the result is
    the same and the aggregate reads only recent rows.
    """
    lines = exposition_lines(rows)
    if ttl is not None:
        lines = expire(lines, now, ttl)
    return latest_series(lines).select("series", "line")


def write_exposition(rows: DataFrame, path: str, compression: str | None = None, **options) -> None:
    """Text files, every line ended by a newline."""
    to_exposition(rows, **options).select("line").write.mode("overwrite").text(path, compression=compression)
