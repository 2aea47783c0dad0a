"""Phrase collocations from weighted acyclic automata.

Each shard of the corpus counts its word paths (a word and the two after it) and builds automata from them, cut into chunks of
sorted paths. Chunks are cut at the borders of prefix ranges; the automata of one range are united and their weights summed, and the
weight of a phrase is the sum over the paths below it. Phrases are composed with their parts by joining on the parts' paths.
"""

from __future__ import annotations

import string
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.llm.count_automata import Automaton, count_paths, prefix_weights, union
from tallywind.llm.tables import land

#: Words, and distinct words, after which a shard is closed.
SHARD_WORDS, SHARD_VOCABULARY = 1_000_000, 500_000
#: Paths of one chunk, between two samples of the order, and of one range.
CHUNK_PATHS, SAMPLE_PATHS, RANGE_PATHS = 1 << 17, 1 << 13, 500_000
_SEPARATORS = ".,;:!?\n\x0b\x0c\r"
#: A-Z lowered, every separator a full stop, the tab a blank.
_BYTES = bytes.maketrans((string.ascii_uppercase + _SEPARATORS + "\t").encode(), (string.ascii_lowercase + "." * len(_SEPARATORS) + " ").encode())


class _Numbers(dict):
    """Numbers words in order of appearance; the full stop, which no word holds, is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def shard_automata(documents: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`lang, n, samples, automaton`: chunks of sorted paths, with the words that begin there and paths that sample their order."""
    fields = [("lang", pa.string()), ("n", pa.int64()), ("samples", pa.list_(pa.binary())), ("automaton", pa.binary())]

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        held = 0

        def chunks() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, tokens) in shards.items():
                paths = count_paths(list(numbers)[1:], np.concatenate(tokens))
                tokens.clear()
                for start in range(0, len(paths.first), CHUNK_PATHS):
                    part = paths.part(start, min(len(paths.first), start + CHUNK_PATHS))
                    samples = [b" ".join(part.name(k)) for k in range(0, len(part.first), SAMPLE_PATHS)]
                    row = [[lang], [int(part.weights.sum())], [samples], [Automaton.build(part).pack()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(row, fields)], names=[n for n, _ in fields])

        for frame in frames:
            for lang, text in zip(frame.column("lang").to_pylist(), frame.column("text")):
                if lang not in shards:
                    shards[lang] = (_Numbers({b".": 0}), [])
                numbers, tokens = shards[lang]
                words = (text.as_py() or b"").translate(_BYTES).replace(b".", b" . ").split()
                words.append(b".")
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                held += len(words)
                if held >= shard_words or len(numbers) >= SHARD_VOCABULARY:
                    yield from chunks()
                    shards, held = {}, 0
        yield from chunks()

    rows = documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text")
    )
    return rows.mapInArrow(count, "lang string, n bigint, samples array<binary>, automaton binary")


def _borders(chunks: DataFrame, range_paths: int) -> dict[str, list[list[bytes]]]:
    """By language the paths at which ranges of about `range_paths` paths begin, in order."""
    samples = chunks.select("lang", F.explode("samples").alias("path"))
    ranges = max(1, samples.count() * SAMPLE_PATHS // range_paths)
    firsts = samples.repartitionByRange(ranges, "lang", "path").groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("lang", "path")).alias("at"))
    borders: dict[str, list[list[bytes]]] = {}
    for row in firsts.collect():  # one row per range
        borders.setdefault(row["at"].lang, []).append(bytes(row["at"].path).split(b" "))
    return {lang: sorted(found) for lang, found in borders.items()}


def _cut(chunks: DataFrame, borders: dict[str, list[list[bytes]]]) -> DataFrame:
    """`lang, range, automaton`: each chunk cut at the borders."""
    fields = [("lang", pa.string()), ("range", pa.int64()), ("automaton", pa.binary())]

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for lang, data in zip(frame.column("lang").to_pylist(), frame.column("automaton")):
                paths, own = Automaton.unpack(data.as_py()).paths(), borders.get(lang, [])
                first, last = paths.name(0), paths.name(len(paths.first) - 1)
                low, high = bisect_left(own, first), bisect_left(own, last)
                low += low < len(own) and own[low] == first
                high += high < len(own) and own[high] == last
                places = [0, *(paths.place(b) for b in own[low:high]), len(paths.first)]
                for k, (start, stop) in enumerate(zip(places, places[1:])):
                    if stop > start:
                        # A chunk within one range goes on as it is.
                        packed = data.as_py() if stop - start == len(paths.first) else Automaton.build(paths.part(start, stop)).pack()
                        row = [[lang], [low + k], [packed]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(row, fields)], names=[n for n, _ in fields])

    return chunks.select("lang", "automaton").mapInArrow(cut, "lang string, range bigint, automaton binary")


def _unite(pieces: DataFrame, borders: dict[str, list[list[bytes]]], least: int) -> DataFrame:
    """`lang, phrase, count`: what each range has of phrases of 1 to 3 words; below `least` only where a border may cut a phrase."""
    def unite(group: pa.Table) -> pa.Table:
        lang, number = group.column("lang")[0].as_py(), group.column("range")[0].as_py()
        paths = union(Automaton.unpack(a.as_py()).paths() for a in group.column("automaton"))
        near = borders.get(lang, [])[max(0, number - 1) : number + 1]
        places = {word: k + 1 for k, word in enumerate(paths.words) if any(word in border for border in near)}
        phrases, counts = [], []
        for size in (1, 2, 3):
            columns, sums = prefix_weights(paths, size)
            keep = sums >= least
            for border in near:
                cut = np.ones(len(sums), bool)
                for column, word in zip(columns, border):
                    cut &= column == places.get(word, -1)
                keep |= cut
            found = [[paths.words[s - 1] for s in c[keep].tolist()] for c in columns]
            phrases += map(b" ".join, zip(*found))
            counts.append(sums[keep])
        return pa.table([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.concatenate(counts), pa.int64())], names=["lang", "phrase", "count"])

    return pieces.groupBy("lang", "range").applyInArrow(unite, "lang string, phrase string, count bigint")



def mine(documents: DataFrame, least: int = 10, best: int = 2000, shard_words: int = SHARD_WORDS, range_paths: int = RANGE_PATHS) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: the `best` phrases of 2 or 3 words of each language that occur `least` times or more.

    `documents` needs `lang, text`; other columns are left out. Words are split at blanks and tabs within pieces between
    `.,;:!?` and line ends, A-Z lowered. Null text counts as empty, null `lang` is `und`; a text counts as often as it occurs. The
    score of a phrase is the lowest of its cuts, 1000000 * a * a div (l * r) in decimals of 37 digits (counts up to 10^14); phrases of which
    a longer one has half the occurrences or more are left out. Ties rank by `a`, then by the phrase's bytes. An empty table
    gives no rows.

    Shards are landed, so texts are read once. A range holds about `range_paths` paths; how often words or phrases occur doesn't matter
    for that, as a shard folds equal paths and borders may lie anywhere in the order of paths.
    """
    chunks = land(shard_automata(documents, shard_words))
    borders = _borders(chunks, range_paths)
    found = _unite(_cut(chunks, borders), borders, least)
    counts = land(found.groupBy("lang", "phrase").agg(F.sum("count").alias("a")).filter(F.col("a") >= least))
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))

    words = F.split("phrase", " ", -1)
    phrases = counts.withColumn("words", words).filter(F.size("words") > 1)
    parts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.expr("slice(words, 1, k)"), " ").alias("head"),
        F.array_join(F.expr("slice(words, k + 1, size(words))"), " ").alias("tail"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    scored = parts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr("cast((cast(a as decimal(14,0)) * cast(a as decimal(14,0)) * 1000000) div (cast(l as decimal(14,0)) * cast(r as decimal(14,0))) as bigint)")
    # A longer phrase covers what stands at either end of it.
    longer = phrases.filter(F.size("words") > 2).select("lang", "a", F.explode(F.array(F.expr("slice(words, 1, 2)"), F.expr("slice(words, 2, 2)"))).alias("inner"))
    longer = longer.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("most"))
    cuts = scored.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = cuts.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("most") < 50 * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for keys in (["lang", "salt"], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= best)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
