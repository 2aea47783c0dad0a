"""MinHash near-duplicates with odd sketches.

Each text is a set of word shingles. MinHash samples of the set serve twice: bands of samples propose candidate pairs, and an
odd sketch (a bitmap in which every sample flips one bit) tells from the population count of the XOR of two sketches how many
samples differ, precisely where similarity is high. Only candidates that pass this are verified on the full sets.

Texts with equal sets form a class with one representative. In each band bucket representatives are first compared with the
bucket's smallest one, its hub: a star instead of all pairs, and first of all one hub for each representative; what is then
connected needs no further comparison. Only pairs of one bucket that are still in different components are looked at in a
second step, filtered by set size and sketch and linked within the bucket, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.llm.tables import land

BANDS, SKETCH_BITS = 40, 512
#: Words whose hashes a task remembers before it starts afresh.
REMEMBERED_WORDS = 500_000
#: Rows of one bucket that a task compares with each other, or with as many others.
BLOCK = 2_000
_WORDS = SKETCH_BITS // 64


def band_rows(similarity: float, bands: int = BANDS, miss: float = 1e-5) -> int:
    """The most samples a band may have if a pair of that similarity is to be missed with a chance of `miss` at most."""
    rows = 1
    while (1 - similarity ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def most_odd_bits(similarity: float, samples: int, sigmas: float = 4.5) -> int:
    """The population count above which two sketches are less similar than that, `sigmas` standard deviations allowed."""
    def expected(j: float) -> float:
        return SKETCH_BITS / 2 * (1 - math.exp(-4 * samples * (1 - j) / SKETCH_BITS))

    p = expected(similarity) / SKETCH_BITS
    per_bit = 2 * samples * (1 - 2 * p)  # d similarity = d bits / per_bit
    spread = math.hypot(math.sqrt(similarity * (1 - similarity) / samples), math.sqrt(SKETCH_BITS * p * (1 - p)) / per_bit)
    return math.ceil(expected(max(0.0, similarity - sigmas * spread)))


class Shingles:
    """64-bit hashes of the distinct shingles of a text; A-Z are lowered, words lie between ASCII white space."""

    def __init__(self, size: int) -> None:
        self.size, self.seen = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: ASCII only, both in case and in white space
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        if len(self.seen) > REMEMBERED_WORDS:
            self.seen = {}
        seen, hashed = self.seen, xxhash.xxh3_64_intdigest
        for word in set(words).difference(seen):
            seen[word] = hashed(word)
        w = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        n = len(w) - self.size + 1
        h = np.zeros(n, np.uint64)
        for k in range(self.size):
            h = (h + w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h * np.uint64(0xBF58476D1CE4E5B9))


class Signer:
    """Set fingerprint, odd sketch and band hashes of a set of shingle hashes."""

    def __init__(self, rows: int, bands: int = BANDS, seed: int = 5) -> None:
        random = np.random.default_rng(seed)
        n = rows * bands
        self.shape = (bands, rows)
        self.a = random.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)
        self.b = random.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)
        self.band = random.integers(0, 1 << 62, (bands, rows), np.uint64) | np.uint64(1)
        self.bit = random.integers(0, 1 << 62, n, np.uint64)

    def __call__(self, shingles: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        high, low = (shingles >> np.uint64(32)).astype(np.uint32), shingles.astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(shingles), 256):
            values = high[at : at + 256, None] * self.a
            values += low[at : at + 256, None] * self.b
            np.minimum(least, values.min(axis=0), out=least)
        samples = least.astype(np.uint64)
        bits = ((samples + self.bit) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(math.log2(SKETCH_BITS)))
        odd = (np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
        sketch = np.packbits(odd, bitorder="little").view(np.int64)
        mixed = (samples.reshape(self.shape) + np.uint64(1)) * self.band
        mixed = (mixed ^ (mixed >> np.uint64(31))).sum(axis=1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
        bands = (mixed ^ (mixed >> np.uint64(30)) ^ self.band[:, 0]).view(np.int64)
        whole = xxhash.xxh3_128_intdigest(shingles.tobytes())
        return whole >> 64, whole & (1 << 64) - 1, sketch, bands


def signatures(rows: DataFrame, size: int, per_band: int) -> DataFrame:
    """`row, n_shingles, set_a, set_b, sketch, bands` of `row, text`; empty sets have no sketch and no bands."""
    schema = "row bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch array<bigint>, bands array<bigint>"
    names = [x.split()[0] for x in schema.split(", ")]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sign = Shingles(size), Signer(per_band)
        for frame in frames:
            n, first, second, sketches, bands = [], [], [], [], []
            for text in frame.column("text"):
                found = shingles(text.as_py())
                n.append(len(found))
                a, b, sketch, band = sign(found) if len(found) else (0, 0, None, None)
                first.append(a - (a >> 63 << 64))
                second.append(b - (b >> 63 << 64))
                sketches.append(sketch)
                bands.append(band)
            yield pa.RecordBatch.from_arrays(
                [frame.column("row"), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                 pa.array(sketches, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names=names,
            )

    return rows.select("row", F.col("text").cast("string").alias("text")).mapInArrow(batches, schema)


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of `a, b` whose full sets are similar enough; `texts` has `row, text`."""
    left = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for frame in frames:
            keep, last, held = [], None, None
            for a, b in zip(frame.column("text_a"), frame.column("text_b")):
                a, b = a.as_py(), b.as_py()
                if b != last:
                    last, held = b, shingles(b)
                own = shingles(a)
                both = len(np.intersect1d(own, held, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(held) - both))
            yield frame.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(batches, "a bigint, b bigint")


def link_buckets(near: DataFrame, signed: DataFrame, texts: DataFrame, size: int, percent: int, most: int, block: int = BLOCK) -> DataFrame:
    """Links `a, b` between different components within buckets of `near` (`bucket, band, row, component`).

    Full sets come to the buckets, and what is linked there already isn't compared again, so no task passes on more links
    than rows. A bucket of more than `block` rows is dealt into blocks, and each two blocks meet in a group of their own; so a
    group's size is bounded and all pairs are still looked at. A pair that shares several buckets is compared in the first.
    """
    sizes = near.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sets = texts.join(near.select("row").distinct(), "row", "left_semi").select("row", F.col("text").cast("string").alias("text"))

    def as_sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for frame in frames:
            found = [shingles(text.as_py()).tobytes() for text in frame.column("text")]
            yield pa.RecordBatch.from_arrays([frame.column("row"), pa.array(found, pa.binary())], names=["row", "shingles"])

    whole = sets.mapInArrow(as_sets, "row bigint, shingles binary").join(signed, "row")
    dealt = near.join(sizes, "bucket").withColumn("own", F.expr("cast(pmod(xxhash64(row), blocks) AS int)"))
    dealt = dealt.withColumn("other", F.explode_outer(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("bucket", "band", "row", "component", "own", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))

    def linked(key: tuple, group: pa.Table) -> pa.Table:
        band, first, second = group.column("band")[0].as_py(), key[1].as_py(), key[2].as_py()
        rows, comps, own = (group.column(c).to_numpy() for c in ("row", "component", "own"))
        held = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
        n = np.array([len(x) for x in held])
        sketches = np.array(group.column("sketch").to_pylist(), np.int64).view(np.uint64)  # of signed numbers, magnitudes would be counted
        earlier = np.array(group.column("bands").to_pylist(), np.int64)[:, :band]
        _, comps = np.unique(comps, return_inverse=True)
        out_a, out_b = [], []
        for i in range(len(rows)):
            later = np.arange(i + 1, len(rows)) if first == second else np.flatnonzero((own != own[i]) & (np.arange(len(rows)) > i))
            later = later[comps[later] != comps[i]]
            later = later[100 * np.minimum(n[later], n[i]) >= percent * np.maximum(n[later], n[i])]
            later = later[np.bitwise_count(sketches[later] ^ sketches[i]).sum(axis=1) <= most]
            later = later[~(earlier[later] == earlier[i]).any(axis=1)]
            for j in later:
                if comps[i] != comps[j]:
                    both = len(np.intersect1d(held[i], held[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        out_a.append(rows[i])
                        out_b.append(rows[j])
                        comps[comps == comps[j]] = comps[i]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return dealt.join(whole, "row").groupBy("bucket", "first", "second").applyInArrow(linked, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """`node, component` (the smallest node reachable) for all nodes of the undirected `a, b` that aren't it themselves.

    Alternates large and small stars: each node's larger neighbours, then its smaller ones, move to its smallest
    neighbour, until nothing changes. Every round is landed; a node with very many neighbours is only ever aggregated.
    """
    stars = land(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).filter("node <> component").distinct())

    def moved(links: DataFrame) -> DataFrame:
        least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return links.join(least, "u")

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first())

    seen = mark(stars)
    while seen[0]:
        both = stars.select(F.col("node").alias("u"), F.col("component").alias("v"))
        both = both.unionAll(stars.select(F.col("component").alias("u"), F.col("node").alias("v")))
        large = moved(both).filter("v > u").select(F.col("v").alias("node"), F.col("m").alias("component"))
        large = large.filter("node <> component").distinct()
        down = large.select(F.col("node").alias("u"), F.col("component").alias("v"))
        small = moved(down)
        small = small.select(F.col("v").alias("node"), F.col("m").alias("component")).unionAll(
            small.select(F.col("u").alias("node"), F.col("m").alias("component"))
        )
        stars = land(small.filter("node <> component").distinct())
        now = mark(stars)
        if now == seen:
            break
        seen = now
    return stars


def _sketch_columns(sketch: Column, prefix: str) -> list[Column]:
    return [sketch[k].alias(f"{prefix}{k}") for k in range(_WORDS)]


def _odd_bits(left: str, right: str) -> Column:
    return sum((F.bit_count(F.col(f"{left}{k}").bitwiseXOR(F.col(f"{right}{k}"))) for k in range(1, _WORDS)), F.bit_count(F.col(f"{left}0").bitwiseXOR(F.col(f"{right}0"))))


def cluster(documents: DataFrame, shingle_words: int = 5, percent: int = 80, keep: list[str] | None = None) -> DataFrame:
    """`row, doc, n_shingles, component_id, kept` for every row of `documents`.

    Rows are linked if 100 * intersection >= `percent` * union of their sets. A text with fewer words than a shingle
    is one shingle; null, empty and blank texts have no set and are linked with nothing. `component_id` is the smallest
    `doc_id` reachable, its own included; null ids are never the smallest, but a component of nulls alone has a null id. `kept`
    marks one row per component: the smallest id, of repeated rows the first. `doc` holds the columns in `keep` (default: all).
    A pair at the very threshold is missed by all bands with a chance of at most one in 100,000.
    """
    keep = documents.columns if keep is None else keep
    per_band = band_rows(percent / 100)
    most = most_odd_bits(percent / 100, per_band * BANDS)
    rows = land(
        documents.select(
            F.monotonically_increasing_id().alias("row"), documents["doc_id"].alias("id"), documents["text"].alias("text"),
            F.struct(*[documents[c] for c in keep if c != "text"] or [F.lit(0).alias("none")]).alias("rest"),
        )
    )
    signed = land(signatures(rows, shingle_words, per_band))
    sets = signed.filter("n_shingles > 0")
    # One row for each distinct set; of a set that very many rows share, tasks pass on one row each.
    nodes = land(
        sets.groupBy("set_a", "set_b").agg(F.min(F.struct("row", "n_shingles", "sketch", "bands")).alias("first")).select(
            "set_a", "set_b", "first.row", "first.n_shingles", F.col("first.sketch").alias("sketch"), F.col("first.bands").alias("bands")
        )
    )
    banded = nodes.select("row", F.posexplode("bands").alias("band", "bucket"))
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowds = land(banded.join(crowded, "bucket"))
    # A hub is the bucket's row with the most company in all its buckets: in a group of near copies that is their original.
    scored = crowds.join(crowds.groupBy("row").agg(F.sum("n").alias("score")), "row")
    hubs = scored.groupBy("bucket").agg(F.max(F.struct("score", -F.col("row"))).alias("top"))
    hubs = hubs.select("bucket", F.col("top.score").alias("hub_score"), (-F.col("top")["col2"]).alias("hub"))
    busy = land(crowds.select("bucket", "band", "row").join(hubs, "bucket"))

    left = nodes.select(F.col("row").alias("a"), F.col("n_shingles").alias("n_a"), *_sketch_columns(F.col("sketch"), "x"))
    right = nodes.select(F.col("row").alias("b"), F.col("n_shingles").alias("n_b"), *_sketch_columns(F.col("sketch"), "y"))
    alike = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (_odd_bits("x", "y") <= most)

    def compared(pairs: DataFrame) -> DataFrame:
        close = pairs.join(left, "a").join(right, "b").filter(alike).select("a", "b")
        return land(verify(close, texts, shingle_words, percent))

    # Texts that are in a busy bucket at all; of these, only the ones in pairs are shuffled again.
    texts = land(rows.select("row", "text").join(busy.select("row").distinct(), "row", "left_semi"))
    # One comparison for each row, with the best of its hubs. In a large group most rows are linked by this already.
    best = busy.filter("row <> hub").groupBy("row").agg(F.max(F.struct("hub_score", "hub")).alias("top"))
    best = best.select(F.col("row").alias("a"), F.col("top.hub").alias("b"))
    linked = compared(best)
    joined = components(linked)
    # Then with those other hubs that are still in another component.
    of_row = joined.select(F.col("node").alias("row"), F.col("component").alias("c_row"))
    of_hub = joined.select(F.col("node").alias("hub"), F.col("component").alias("c_hub"))
    apart = busy.filter("row <> hub").select("row", "hub").distinct().join(of_row, "row", "left").join(of_hub, "hub", "left")
    apart = apart.filter("coalesce(c_row, row) <> coalesce(c_hub, hub)").select(F.col("row").alias("a"), F.col("hub").alias("b"))
    linked = land(linked.unionAll(compared(apart.join(best, ["a", "b"], "left_anti"))))
    joined = components(linked)

    # Second step: pairs of one bucket in different components. Rows without any such partner that looks alike drop out.
    placed = busy.join(joined, busy["row"] == joined["node"], "left").select("bucket", "band", "row", F.coalesce("component", "row").alias("component"))
    open_buckets = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    still = land(placed.join(open_buckets, "bucket").join(left.withColumnRenamed("a", "row"), "row"))
    other = still.select(
        F.col("bucket").alias("bucket_b"), F.col("component").alias("c_b"), F.col("n_a").alias("n_b"), *[F.col(f"x{k}").alias(f"y{k}") for k in range(_WORDS)]
    )
    near = land(still.join(other, (F.col("bucket") == F.col("bucket_b")) & (F.col("component") != F.col("c_b")) & alike, "left_semi").select("bucket", "band", "row", "component"))
    found = land(link_buckets(near, nodes.select("row", "sketch", "bands"), texts, shingle_words, percent, most))
    joined = components(linked.unionAll(found))

    # Rows to their set's node, nodes to their component, components to the smallest id.
    placed = nodes.join(joined, nodes["row"] == joined["node"], "left").select("set_a", "set_b", F.coalesce("component", "row").alias("component"))
    grouped = signed.join(placed, ["set_a", "set_b"], "left").select(
        "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("row")).alias("component")
    )
    numbered = land(grouped.join(rows.select("row", "id"), "row"))
    names = numbered.groupBy("component").agg(
        F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull(), "id", "row")).getField("row").alias("kept_row")
    )
    judged = numbered.join(names, "component").select("row", "n_shingles", "component_id", (F.col("row") == F.col("kept_row")).alias("kept"))
    whole = F.struct(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in keep])
    return rows.select("row", whole.alias("doc")).join(judged, "row")


def drop_copies(documents: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all columns; see `cluster`."""
    return cluster(documents, shingle_words, percent).filter("kept").select("doc.*")
