"""Ranked lexical search by exact inner products over sparse ball trees.

A document is a sparse vector of integer term weights, an item the vector of its terms' integer weights, and the score their
inner product. Documents are gathered into ball trees: a ball's members lie within `radius` of its `centroid`, so no member
scores above `q * centroid + |q| * radius`. Bounds are floating-point numbers rounded up by more than their error; what a
search opens, best bound first, it scores in exact integers, and it stops where no bound reaches the worst of the best.
"""

from __future__ import annotations

import heapq
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywind.llm.tables import alnum_words, land

#: Distinct terms of the items that one pass serves; further items go into further passes.
BLOCK_TERMS = 32_768
#: Documents of one tree, and of a leaf.
TREE_DOCUMENTS, LEAF_DOCUMENTS = 8_192, 64
#: Doubles that the centroids of one tree may hold.
CENTROID_CELLS = 8_000_000
#: Doubles hold integers up to here exactly.
EXACT = 2**53
#: A bound's relative error is some 1e-11; this is far above.
SLACK = 1e-9
NO_ID = 2**63 - 1
#: Bytes of words as such, A-Z lowered; all others become blanks. Every byte of a non-ASCII character belongs to a word.
_BYTES = bytes(
    b + 32 if chr(b) in string.ascii_uppercase else b if b >= 0x80 or chr(b) in string.ascii_lowercase + string.digits else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def vectors(documents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """`doc_id, n, terms, counts`: of each text its number of words, and the places in `vocabulary` of those that are there."""
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {word.encode(): k for k, word in enumerate(vocabulary)}
        for frame in frames:
            lengths, ends, terms, counts = [], [0], [], []
            for text in frame.column("text"):
                words = words_of(text.as_py() or b"")
                found = Counter(filter(None.__ne__, map(places.get, words)))
                lengths.append(len(words))
                terms.extend(found.keys())
                counts.extend(found.values())
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [frame.column("doc_id"), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], names=["doc_id", "n", "terms", "counts"],
            )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(batches, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


@dataclass
class Postings:
    """Sparse rows one after the other: row r has the entries `ends[r]` to `ends[r + 1]` of `terms` and `values`."""

    ids: np.ndarray
    ends: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Postings:
        sizes = self.ends[rows + 1] - self.ends[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends[:-1], sizes)
        return Postings(self.ids[rows], ends, self.terms[at], self.values[at])

    def part(self, start: int, stop: int) -> Postings:
        a, b = self.ends[start], self.ends[stop]
        return Postings(self.ids[start:stop], self.ends[start : stop + 1] - a, self.terms[a:b], self.values[a:b])

    def sums(self, entries: np.ndarray) -> np.ndarray:
        """The sum of `entries` by row; integers stay exact below `EXACT`, and exact in any case where entries are integers."""
        rows = np.repeat(np.arange(len(self.ids)), np.diff(self.ends))
        if entries.dtype == np.float64:
            return np.bincount(rows, entries, len(self.ids))
        out = np.zeros(len(self.ids), entries.dtype)
        np.add.at(out, rows, entries)
        return out


class BallTree:
    """Balls of rows, the root first; leaves hold at most `leaf` rows, or equal ones."""

    def __init__(self, rows: Postings, terms: int, leaf: int = LEAF_DOCUMENTS):
        self.rows, self.spans, self.children, centroids, self.radii = rows, [], [], [], []
        open_balls = [(0, len(rows.ids), -1)]
        while open_balls:
            start, stop, parent = open_balls.pop()
            ball, node = self.rows.part(start, stop), len(self.spans)
            values = ball.values.astype(np.float64)
            centroid = np.bincount(ball.terms, values, terms) / (stop - start)
            squares, middle = ball.sums(values * values), float(centroid @ centroid)
            away = squares - 2 * ball.sums(values * centroid[ball.terms]) + middle
            # The difference of large squares loses digits, so the radius is rounded up by what it can lose.
            self.radii.append(float(np.sqrt(np.maximum(0, away) + SLACK * (squares + middle)).max()))
            self.spans.append((start, stop))
            self.children.append([])
            centroids.append(centroid)
            if parent >= 0:
                self.children[parent].append(node)
            if stop - start <= leaf or away.max() <= SLACK * (squares.max() + middle):
                continue
            first = self._dense(ball, int(away.argmax()), terms)
            second = self._dense(ball, int((squares - 2 * ball.sums(values * first[ball.terms])).argmax()), terms)
            along = ball.sums(values * (first - second)[ball.terms])
            order = np.argsort(along, kind="stable")
            moved = ball.take(order)
            a, b = self.rows.ends[start], self.rows.ends[stop]
            self.rows.ids[start:stop], self.rows.ends[start : stop + 1] = moved.ids, moved.ends + a
            self.rows.terms[a:b], self.rows.values[a:b] = moved.terms, moved.values
            # Rows go with the nearer of both; where that leaves one alone with few, halves keep the tree shallow.
            cut = int(np.searchsorted(along[order], (first @ first - second @ second) / 2))
            if not (stop - start) // 16 < cut < (stop - start) * 15 // 16:
                cut = (stop - start) // 2
            open_balls += [(start, start + cut, node), (start + cut, stop, node)]
        self.centroids = np.vstack(centroids)

    @staticmethod
    def _dense(ball: Postings, row: int, terms: int) -> np.ndarray:
        one = ball.part(row, row + 1)
        return np.bincount(one.terms, one.values.astype(np.float64), terms)

    def search(self, query: np.ndarray, weights: np.ndarray, best: Best, scores: np.ndarray) -> None:
        """Puts the rows that belong there into `best`. `scores` holds a zero for each term and is left so."""
        q = weights.astype(np.float64)
        bounds = self.centroids[:, query] @ q + np.sqrt(q @ q) * np.array(self.radii)
        bounds = bounds * (1 + SLACK) + 1
        scores[query] = weights
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < best.least():
                break  # and so are all others
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= best.least():
                        heapq.heappush(heap, (-bounds[child], child))
            else:
                ball = self.rows.part(*self.spans[node])
                found = ball.sums(scores[ball.terms] * ball.values.astype(scores.dtype))
                for row in np.flatnonzero(found >= best.least()):
                    best.add(int(found[row]), int(ball.ids[row]))
        scores[query] = 0


class Best:
    """The `size` highest scores above 0, equal ones by ascending id."""

    def __init__(self, size: int):
        self.size, self.heap = size, []

    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.size else 1

    def add(self, score: int, doc_id: int) -> None:
        entry = (score, -doc_id)
        if len(self.heap) < self.size:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def _searches(spark: SparkSession, found: DataFrame, queries: list[np.ndarray], vocabulary: list[str], best: int) -> DataFrame:
    """`query, doc_id, score`: the `best` documents of each query, by its place in `queries` (places in `vocabulary`)."""
    totals = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, occurrences = int(totals[0]), int(totals[1])
    # One row per term of the block at most.
    frequent = {r.term: r["count"] for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array(
        [np.floor(1000 * np.log((2 * documents + 2) / (2 * frequent.get(k, 0) + 1))) for k in range(len(vocabulary))], np.int64
    )
    # Where sums could pass what doubles hold, scores are summed as integers.
    largest = max((int(weights[q].sum()) for q in queries), default=0) * 10**6
    kind = np.float64 if largest < EXACT else np.int64
    limit = max(LEAF_DOCUMENTS, min(TREE_DOCUMENTS, CENTROID_CELLS * LEAF_DOCUMENTS // (4 * max(1, len(vocabulary)))))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [Best(best) for _ in queries]
        scores = np.zeros(len(vocabulary), kind)

        def search(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts).combine_chunks()
            terms, counts = rows.column("terms").chunk(0), rows.column("counts").chunk(0)
            ends = terms.offsets.to_numpy().astype(np.int64)
            n, tf = rows.column("n").to_numpy(), counts.flatten().to_numpy()
            m = 50 + np.array([50 * int(x) * documents // occurrences for x in n], np.int64)
            values = 10**9 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(ends)))
            ids = rows.column("doc_id").fill_null(NO_ID).to_numpy()
            tree = BallTree(Postings(ids.copy(), ends - ends[0], terms.flatten().to_numpy().astype(np.int64), values), len(vocabulary))
            for query, own in zip(queries, top):
                tree.search(query, weights[query], own, scores)

        held, size = [], 0
        for frame in frames:
            frame = frame.filter(pa.compute.greater(pa.compute.list_value_length(frame.column("terms")), 0))
            while frame.num_rows:
                part = frame.slice(0, limit - size)
                frame = frame.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == limit:
                    search(held)
                    held, size = [], 0
        if size:
            search(held)
        rows = [(k, None if -i == NO_ID else -i, s) for k, own in enumerate(top) for s, i in own.heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], names=["query", "doc_id", "score"]
        )

    return found.select("doc_id", "n", "terms", "counts").mapInArrow(batches, "query bigint, doc_id bigint, score bigint")


def _blocks(items: DataFrame, terms: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The items with their distinct words, in blocks of so many distinct words, or of one item with more."""
    block, known = [], set()
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.array_distinct(alnum_words(F.col("text").cast("string"))).alias("words"))
    for row in rows.filter(F.size("words") > 0).toLocalIterator():
        if block and len(known.union(row.words)) > terms:
            yield block
            block, known = [], set()
        block.append((row.item_id, row.words))
        known.update(row.words)
    if block:
        yield block


def search(documents: DataFrame, items: DataFrame, best: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """`item_id, rank, doc_id, score`: for each row of `items` the `best` rows of `documents` with the highest scores above 0.

    `documents` needs `doc_id, text`, `items` needs `item_id, text`; other columns of any name are left out. Items come block by
    block to the driver and from there to all tasks (a block has at most `block_terms` distinct words, or is one item);
    documents stay where they are: each task searches its own trees and passes on its best, which are ranked in two steps.
    Repeated rows of either table count and rank each for itself; equal scores rank by ascending `doc_id`, nulls last. Null
    and empty texts have no terms and rank nowhere, but count as what they are in the statistics; an item without terms, or an
    empty table, gives no rows. Tokens are read from whole texts; a text must fit into a task's memory, a tree is bounded.
    """
    spark = documents.sparkSession
    parts = []
    for block in _blocks(items, block_terms):
        vocabulary = sorted({word for _, words in block for word in words})
        places = {word: k for k, word in enumerate(vocabulary)}
        queries = [np.array(sorted(places[w] for w in words), np.int64) for _, words in block]
        found = _searches(spark, land(vectors(documents, vocabulary)), queries, vocabulary, best)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        for keys in (["query", "salt"], ["query"]):
            ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
            salted = salted.withColumn("rank", ranked).filter(F.col("rank") <= best)
        ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "query bigint, item_id bigint")
        parts.append(salted.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
