"""Captured host files, ``(host, ts DOUBLE, path, content)``, as token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.functions.text import strip


def plain(content: Column) -> Column:
    """Blanks in place of the other white space that separates words, so that words are found without a pattern."""
    for mark in "\t\x0b\x0c\r":
        content = F.replace(content, F.lit(mark), F.lit(" "))
    return content


def tokens(line: Column) -> Column:
    """The words of a line of `plain` text; a blank line has none."""
    return F.array_remove(F.split(strip(line), " "), "")


def snapshot_lines(snapshots: DataFrame, *paths: str) -> DataFrame:
    """``host, ts, path, pos, tokens`` of the non-blank lines; ``paths`` limits the files read.

    Lines and words come out of outer generators: no filter on them, or that Spark infers, moves below one and cuts each line again.
    """
    chosen = snapshots.where(F.col("path").isin(*paths)) if paths else snapshots
    keep = [c for c in chosen.columns if c != "content"]
    lines = chosen.select(*keep, F.posexplode_outer(F.split(plain(F.col("content")), "\n")).alias("pos", "line"))
    return lines.select(*keep, "pos", F.explode_outer(F.array(tokens(F.col("line")))).alias("tokens")).where(F.size("tokens") > 0)
