"""Helpers that the operators of this folder share."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywind.session import shared_folder

#: Separators of `alnum_words`: every ASCII character but digits and lower-case letters.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Separators of `space_words`.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def land(frame: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The rows of `frame`, written once as Parquet to the shared folder and read back.

    Cuts lineage: later jobs, and tasks that run anew after an executor is lost, read the same rows.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = frame.write
    if keys:
        writer = writer.partitionBy(*keys)
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, rows: int = 500_000) -> DataFrame:
    """`frame` marked for broadcast if a count shows that it has at most so many (narrow) rows; else Spark joins as it likes."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else; `lower` does just that where the text has one byte per character."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _pieces(text: Column, separators: str) -> Column:
    return F.coalesce(F.array_remove(F.split(text, separators), ""), F.array().cast("array<string>"))


def alnum_words(text: Column) -> Column:
    """Words of digits, letters and all non-ASCII characters, A-Z lowered; null text has none."""
    return _pieces(lower_ascii(text), NOT_ALNUM)


def space_words(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return _pieces(text, SPACE)


def row_key(*columns: Column) -> list[Column]:
    """Two 64-bit hashes that tell rows apart by these columns, nulls included."""
    flags = [F.isnull(c) for c in columns]
    return [
        F.xxhash64(F.lit(1), *columns, *flags).alias("key_a"),
        F.xxhash64(F.lit(2), *reversed(flags), *reversed(columns)).alias("key_b"),
    ]
