"""Metric rows and what happens to them between an aggregate and a sink.

A metric row is ``bucket STRING, values MAP<STRING, STRUCT<t, v>>, ts DOUBLE, tags MAP<STRING, STRING>``
where ``t`` names the scalar type (int, float, bool, str, null) and ``v`` is its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.functions.maps import drop, literal_map, merge
from tallywind.functions.text import float_text

METRIC_SCHEMA = "bucket string, values map<string,struct<t:string,v:string>>, ts double, tags map<string,string>"


def typed_value(value: Column, kind: str) -> Column:
    """Scalar column to its ``STRUCT<t, v>``; ``kind`` is the Spark type name."""
    if kind == "boolean":
        tag, text = "bool", F.when(value, F.lit("True")).otherwise(F.lit("False"))
    elif kind in ("double", "float"):
        tag, text = "float", float_text(value)
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        tag, text = "int", value.cast("string")
    else:
        tag, text = "str", value.cast("string")
    return F.struct(
        F.when(value.isNull(), F.lit("null")).otherwise(F.lit(tag)).alias("t"), text.alias("v")
    )


def to_metric_rows(df: DataFrame, bucket: str, fields: list[str], keep_null: bool = False) -> DataFrame:
    """Flat columns to metric rows; a NULL field is left out unless ``keep_null``."""
    kinds = dict(df.dtypes)
    entries = F.array(*[F.struct(F.lit(f).alias("key"), typed_value(F.col(f), kinds[f]).alias("value")) for f in fields])
    extra = [c for c in ("recv_ts", "seq") if c in df.columns]
    if not keep_null:
        # Entries come out of a generator, so that they are made by compiled code and only then filtered.
        df = df.select("ts", "tags", *extra, F.explode_outer(F.array(entries)).alias("entries"))
        entries = F.filter("entries", lambda e: e["value"]["t"] != "null")
    return df.select(F.lit(bucket).alias("bucket"), F.map_from_entries(entries).alias("values"), "ts", "tags", *extra)


def union_all(*frames: DataFrame) -> DataFrame:
    """All families, or all sources, in one flow."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_static_tags(df: DataFrame, static: dict[str, str]) -> DataFrame:
    """Add tags; what a row already has wins."""
    return df.withColumn("tags", merge(literal_map(static), F.coalesce("tags", literal_map({}))))


def apply_bucket_redirect(df: DataFrame) -> DataFrame:
    """A ``bucket`` tag, own or static, replaces the bucket and leaves the tags."""
    target = F.try_element_at("tags", F.lit("bucket"))
    return df.withColumn("bucket", F.coalesce(target, "bucket")).withColumn("tags", drop(F.col("tags"), "bucket"))


def postprocess(df: DataFrame, hook: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """User hook as a DataFrame transform; rows it filters out are dropped."""
    return df if hook is None else df.transform(hook)


def finish_rows(
    df: DataFrame, static: dict[str, str] | None = None, hook: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Static tags, then redirect, then the hook."""
    return postprocess(apply_bucket_redirect(with_static_tags(df, static or {})), hook)


_READ = {
    "int": int, "float": float, "str": str, "bool": lambda v: v == "True", "null": lambda v: None,
}


def _write(value):
    if value is None:
        return {"t": "null", "v": None}
    if isinstance(value, bool):
        return {"t": "bool", "v": str(value)}
    if isinstance(value, int):
        return {"t": "int", "v": str(value)}
    return {"t": "float", "v": repr(value)} if isinstance(value, float) else {"t": "str", "v": str(value)}


def row_hook(function: Callable) -> Callable[[DataFrame], DataFrame]:
    """A Python ``function(bucket, values, ts, tags) -> tuple or None`` as a hook, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            other = [batch[c] for c in batch.columns if c not in ("bucket", "values", "ts", "tags")]
            for bucket, values, ts, tags, *rest in zip(batch["bucket"], batch["values"], batch["ts"], batch["tags"], *other):
                plain = {k: _READ[x["t"]](x["v"]) for k, x in dict(values).items()}
                out = function(bucket, plain, None if pd.isna(ts) else ts, dict(tags))
                if out is not None:
                    kept.append((out[0], {k: _write(v) for k, v in out[1].items()}, out[2], dict(out[3] or {}), *rest))
            yield pd.DataFrame(kept, columns=batch.columns)

    def hook(df: DataFrame) -> DataFrame:
        # The arrival columns go through, as sinks need them.
        arrival = [c for c in ("recv_ts", "seq") if c in df.columns]
        schema = ", ".join([METRIC_SCHEMA, *[f"{c} {df.schema[c].dataType.simpleString()}" for c in arrival]])
        return df.select("bucket", "values", "ts", "tags", *arrival).mapInPandas(run, schema)

    return hook


def routes(sources: dict[str, list[str] | None], destinations: list[str]) -> dict[str, list[str]]:
    """Checked routing table; a source without a list goes everywhere."""
    out = {}
    for source, wanted in sources.items():
        for name in wanted or []:
            if name not in destinations:
                raise ValueError(f"no destination {name!r} for source {source!r}")
        out[source] = list(wanted) if wanted else list(destinations)
    return out


def route(df: DataFrame, table: dict[str, list[str]], destinations: list[str], source: str = "source") -> DataFrame:
    """One row per destination of its source; a source that the table doesn't list, or null, goes to all ``destinations``.

    The table is configuration, so it is a literal.
    """
    everywhere = F.array(*[F.lit(t) for t in destinations])
    known = F.create_map(*[
        x for name, targets in table.items() for x in (F.lit(name), F.array(*[F.lit(t) for t in targets]))
    ])
    return df.withColumn("destination", F.explode(F.coalesce(F.try_element_at(known, F.col(source)), everywhere)))
