"""String maps as tags: merging, sorting, last-wins construction.

Map building never relies on ``spark.sql.mapKeyDedupPolicy``: duplicates are resolved before
the map is made, so the operators behave alike in any session.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywind.functions.text import let


def literal_map(items: dict[str, str]) -> Column:
    if not items:
        return F.from_json(F.lit("{}"), "map<string,string>")
    return F.create_map(*[F.lit(x) for pair in items.items() for x in pair])


def last_wins(entries: Column) -> Column:
    """Map from an array of (key, value) structs in which later entries replace earlier ones."""

    def build(entries: Column, keys: Column) -> Column:
        kept = F.filter(
            entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])
        )
        unique = F.size(F.array_distinct(keys)) == F.size(keys)
        return F.when(unique, F.map_from_entries(entries)).otherwise(F.map_from_entries(kept))

    return let(entries, lambda e: let(F.transform(e, lambda x: x["key"]), lambda keys: build(e, keys)))


def merge(base: Column, over: Column) -> Column:
    """Union of two maps; ``over`` wins. NULL maps count as empty."""
    rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k))
    return (
        F.when(base.isNull() | (F.size(base) == 0), over)
        .when(over.isNull() | (F.size(over) == 0), base)
        .otherwise(F.map_concat(rest, over))
    )


def put(tags: Column, key: str, value: Column) -> Column:
    """Set one key, replacing what was there."""
    entry = F.create_map(F.lit(key), value)
    return F.when(
        F.map_contains_key(tags, key), F.map_concat(F.map_filter(tags, lambda k, v: k != key), entry)
    ).otherwise(F.map_concat(tags, entry))


def put_default(tags: Column, key: str, value: Column) -> Column:
    """Set one key unless it is there already."""
    return F.when(F.map_contains_key(tags, key), tags).otherwise(
        F.map_concat(tags, F.create_map(F.lit(key), value))
    )


def drop(tags: Column, key: str) -> Column:
    return F.when(F.map_contains_key(tags, key), F.map_filter(tags, lambda k, v: k != key)).otherwise(tags)


def series(tags: Column) -> Column:
    """Sorted entries: an orderable, joinable form of a tag map, used as the grouping key."""
    return F.sort_array(F.map_entries(tags))


def tag_text(tags: Column) -> Column:
    """``k=v,k=v`` with sorted keys; for reports and for comparing results."""
    return F.array_join(F.transform(series(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
