"""Histogram bins as column expressions: ``(tags, value) -> bin name or NULL``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BinSpec:
    """``bins``: (name, exclusive upper bound), ascending; a bound of None takes the rest.

    ``match``: tag values that a series must have for this spec to apply.
    """

    bins: list[tuple[str, float | None]]
    match: dict[str, str] = field(default_factory=dict)

    def applies(self, tags: Column) -> Column:
        tests = [F.coalesce(F.try_element_at(tags, F.lit(k)) == v, F.lit(False)) for k, v in self.match.items()]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def pick(self, value: Column) -> Column:
        out = None
        for name, upper in self.bins:
            test = F.lit(True) if upper is None else value < upper
            out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
        return out


def binned_by(*specs: BinSpec) -> Callable[[Column, Column], Column]:
    """The first spec that applies to the series decides."""

    def bins(tags: Column, value: Column) -> Column:
        out = None
        for spec in specs:
            test, name = spec.applies(tags), spec.pick(value)
            out = F.when(test, name) if out is None else out.when(test, name)
        return out

    return bins


def binned_by_function(selector: Callable) -> Callable[[Column, Column], Column]:
    """A Python ``selector(tags) -> (value -> bin) or None``, in Arrow batches.

    For rules that no expression covers. The selector is asked once per series and task.
    """

    @F.pandas_udf("string")
    def choose(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict = {}
        for tags, values in batches:
            names = []
            for tag_map, value in zip(tags, values):
                key = tuple(sorted(dict(tag_map).items()))
                if key not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    known[key] = selector(dict(key))
                name = known[key](value) if known[key] is not None else None
                names.append(str(name) if name else None)
            yield pd.Series(names, dtype=object)

    # Else a filter on the bin is moved below the projection, with a second call that Spark can't evaluate there.
    return choose.asNondeterministic()
