"""The corpus pipeline over `documents`: quality rules, near-duplicates, benchmark passages, secrets, packing.

Every stage takes (spark, docs, folder) and works on all rows that its predecessor kept; all but the last return the
columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallywind.llm import decontaminate, neardup, packing, quality, secrets
from tallywind.llm.tables import land, table


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return neardup.drop_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, folder, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    special = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", pack),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)


#: SQL has no MinHash, odd sketches or tokenizer; the tests compare the stages with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
