"""Packing by power-of-two decomposition.

A document of N tokens becomes N div 1024 pieces of 1024 and one piece for each binary digit of the rest. Every piece is
a sequence of its own, so no sequence crosses documents, and as all lengths are powers of two, none needs padding.
Equal lengths form a bucket; sequences are numbered bucket by bucket.
"""

from __future__ import annotations

import base64
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.llm.tables import land, small

#: Tokens after which a batch of pieces is passed on.
BATCH_TOKENS = 2_000_000
#: White space of the pattern's `\s` in runs too long for the stack of tiktoken's regex, which ends at some 10^6 characters.
LONG_BLANK = re.compile(r"[\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]{50000,}")


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON, which its rank file doesn't list."""
    with open(path, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def byte_bpe(path: str, pattern: str, special: dict[str, int] | None = None) -> Callable[[str], list[int]]:
    """An encoder from a rank file of a byte-level BPE; literals of `special` in a text are those ids, others ordinary text.

    `pattern` must take a run of white space as GPT-2's does: all of it at the end of a text or before a special token, else
    all but the last character.
    """
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})

    literals = re.compile("|".join(map(re.escape, sorted(special or {}, key=len, reverse=True))) or r"(?!)")

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for run in LONG_BLANK.finditer(text):
            # One token piece, which the regex would find but for its stack.
            last = run.end() == len(text) or literals.match(text, run.end())
            stop = run.end() if last else run.end() - 1
            ids += encoding.encode(text[at : run.start()], allowed_special="all")
            ids += encoding._encode_single_piece(text[run.start() : stop])
            at = stop
        return ids + encoding.encode(text[at:], allowed_special="all")

    return encode


def binary_lengths(n: int, longest: int) -> list[int]:
    """Pieces of `n` tokens, longest first; `longest` is a power of two."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in reversed(range(longest.bit_length() - 1)) if rest >> k & 1]


def cut(documents: DataFrame, vocabulary: str, pattern: str, longest: int = 1024, end: int | None = 0, special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: `doc_id, start, length, tokens, doc_tokens, part, place`, not yet numbered.

    `tokens` holds little-endian unsigned 32-bit ids. `end` is the id after each document, None for none. Null text
    counts as empty: its only id is `end`, or it has no piece. `place` counts the pieces of that length in the
    task's `part` of the input.
    """
    schema = "doc_id bigint, start bigint, length bigint, tokens binary, doc_tokens bigint, part bigint, place bigint"
    fields = [(name, pa.binary() if kind == "binary" else pa.int64()) for name, kind in (x.split() for x in schema.split(", "))]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, places = byte_bpe(vocabulary, pattern, special), TaskContext.get().partitionId(), Counter()
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

        for frame in frames:
            for doc_id, text in zip(frame.column("doc_id").to_pylist(), frame.column("text")):
                ids = encode(text.as_py() or "")
                if end is not None:
                    ids.append(end)
                data, at = np.asarray(ids, dtype="<u4").tobytes(), 0
                for length in binary_lengths(len(ids), longest):
                    rows.append((doc_id, at, length, data[4 * at : 4 * (at + length)], len(ids), part, places[length]))
                    places[length] += 1
                    at += length
                held += len(ids)
                if held > BATCH_TOKENS:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, schema)


def pack(documents: DataFrame, vocabulary: str, pattern: str, longest: int = 1024, end: int | None = 0, special: dict[str, int] | None = None) -> DataFrame:
    """`doc_id, start, length, tokens, doc_tokens, bucket, sequence_id, offset` for each piece of `documents`.

    `bucket` is the length, `sequence_id` runs without gaps from 0 through the buckets in order of length, `offset` is 0.
    Pieces are landed once, then numbered by counts per task and length, so nothing but counts is shuffled. Repeated
    rows and ids, and null ids, are cut like others; an empty table gives no rows. `special`: see `byte_bpe`.
    """
    pieces = land(cut(documents, vocabulary, pattern, longest, end, special))
    counts = pieces.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # One row per length: at most log2(longest) + 1.
    lengths = counts.groupBy("length").agg(F.sum("count").alias("all"))
    first = F.sum("all").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1))
    lengths = lengths.select("length", F.coalesce(first, F.lit(0)).alias("first"))
    numbers = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(lengths), "length")
    numbers = numbers.select("length", "part", (F.col("first") + F.col("before")).alias("base"))
    numbered = pieces.join(small(numbers), ["length", "part"])  # one row per task and length
    return numbered.select(
        "doc_id", "start", "length", "tokens", "doc_tokens", F.col("length").alias("bucket"),
        (F.col("base") + F.col("place")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )
