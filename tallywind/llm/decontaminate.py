"""Benchmark decontamination: windows of benchmark words that occur in training documents.

A benchmark item of at least `n` words gives all its windows of `n` consecutive words, a shorter one a single window of
all its words. Scanning does not test a window at every document word. A window of L words holds, wherever it starts,
exactly one run of g = ceil(L / 2) words that begins at a multiple of L - g + 1; so one hash per L - g + 1 document words
is looked up in a broadcast hash set of the windows' runs, and only the few hits are verified word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.llm.tables import NOT_ALNUM, alnum_words, lower_ascii, row_key

#: Benchmark windows up to which their hash sets are broadcast (about 100 bytes each); beyond it Spark shuffles both sides.
BROADCAST_WINDOWS = 400_000


def _run(length: Column | int):
    """Words in the hashed run of a window, and the step between runs of a document."""
    if isinstance(length, int):
        run = (length + 1) // 2
    else:
        run = F.floor((length + 1) / 2).cast("int")
    return run, length - run + 1


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Distinct `item_id, length, window` (words joined by blanks). Items without words or text have none."""
    words = benchmark.select(F.col("item_id"), alnum_words(F.col("text")).alias("words"))
    words = words.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(n)))
    starts = words.select("item_id", "words", "length", F.explode(F.expr("sequence(1, size(words) - length + 1)")).alias("start"))
    return starts.select(
        "item_id", "length", F.array_join(F.slice("words", F.col("start"), F.col("length")), " ").alias("window")
    ).distinct()


def find_spans(documents: DataFrame, benchmark: DataFrame, n: int = 13, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per distinct `(doc_id, text)` of `documents`, with what of it occurs in `benchmark`.

    Returns `key_a, key_b` (see `row_key`), `doc_id`, `copies` (rows with that id and text), `n_words`, `n_hit` (words in
    any occurring window), `items` (sorted ids of items with occurring windows) and `spans` (sorted, merged
    `first, last` word numbers from 0). Null or empty text: no words, no hits. Null ids are ids like others. An empty
    benchmark, or one without words, hits nothing. Other columns of either table are not looked at.
    """
    windows = benchmark_windows(benchmark, n)
    counts = {r["length"]: r["count"] for r in windows.groupBy("length").count().collect()}  # at most n rows
    small = sum(counts.values()) <= broadcast_windows
    held = F.broadcast if small else (lambda frame: frame)

    runs = windows.select("length", F.split("window", " ").alias("words")).withColumns(
        dict(zip(("run", "step"), _run(F.col("length"))))
    )
    runs = runs.select(
        F.col("length").alias("run_length"),
        F.explode(F.expr("transform(sequence(1, step), i -> xxhash64(slice(words, i, run)))")).alias("run_hash"),
    ).distinct()

    scan = documents.select(
        *row_key(F.col("doc_id"), F.col("text")), F.col("doc_id"), alnum_words(F.col("text")).alias("words")
    )
    scan = scan.withColumn("n_words", F.size("words"))
    # The first entry stands for the document itself, so that those without hits stay.
    probes = [F.expr("array(struct(0 AS length, 0 AS at, key_a AS hash))")]
    for length in sorted(counts):
        run, step = _run(length)
        probes.append(
            F.expr(
                f"""CASE WHEN n_words >= {length} THEN transform(sequence(1, n_words - {run} + 1, {step}),
                    i -> struct({length} AS length, i AS at, xxhash64(slice(words, i, {run})) AS hash))
                    ELSE array() END"""
            )
        )
    scan = scan.withColumn("probes", F.concat(*probes) if len(probes) > 1 else probes[0])
    # The outer form: for `explode` Spark adds a filter on the array's size and computes the words anew for each probe in it.
    probed = scan.select("key_a", "key_b", "doc_id", "n_words", "words", F.explode_outer("probes").alias("probe")).select(
        "key_a", "key_b", "doc_id", "n_words", "words", "probe.length", "probe.at", "probe.hash"
    )
    # What the windows around a run can hold. Cut out after the lookup if that needs no shuffle; else before it, so that
    # no task passes on whole texts for each of their probes.
    spanned = ["key_a", "key_b", "doc_id", "n_words", "length", "at", "step"]
    base = F.expr("greatest(1, at - step + 1)")
    around = F.slice("words", base, F.col("length") + F.col("step") - 1).alias("around")
    probed = probed.withColumn("step", _run(F.col("length"))[1])
    if not small:
        probed = probed.select(*spanned, "hash", around)
    near = probed.join(
        held(runs), (F.col("hash") == F.col("run_hash")) & (F.col("length") == F.col("run_length")), "left"
    ).filter("length = 0 OR run_hash IS NOT NULL")
    # Each run that hits lies in at most `step` windows; these are compared in full.
    near = near.select(*spanned, around if small else "around", base.alias("base"))
    tried = near.select(
        "key_a", "key_b", "doc_id", "n_words", "length",
        F.explode_outer(
            F.expr(
                """CASE WHEN length = 0 THEN array(struct(0 AS start, cast(NULL AS string) AS text)) ELSE transform(
                    sequence(greatest(1, at - step + 1), greatest(1, least(at, n_words - length + 1))),
                    s -> struct(s AS start, array_join(slice(around, s - base + 1, length), ' ') AS text)) END"""
            )
        ).alias("tried"),
    ).select("key_a", "key_b", "doc_id", "n_words", "length", "tried.start", F.coalesce("tried.text", F.lit("")).alias("text"))
    found = tried.join(
        held(windows.select("item_id", F.col("length").alias("window_length"), "window")),
        (F.col("text") == F.col("window")) & (F.col("length") == F.col("window_length")),
        "left",
    ).filter("length = 0 OR window IS NOT NULL")
    grouped = found.groupBy("key_a", "key_b").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.sum(F.when(F.col("length") == 0, 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("length") > 0, F.coalesce(F.col("item_id").cast("string"), F.lit(""))))).alias("items"),
        F.array_sort(F.collect_set(F.expr("CASE WHEN length > 0 THEN struct(start - 1 AS first, start + length - 2 AS last) END"))).alias("spans"),
    )
    merged = F.expr(
        """aggregate(spans, cast(array() AS array<struct<first:int, last:int>>), (done, s) -> CASE
            WHEN size(done) > 0 AND s.first <= done[size(done) - 1].last + 1
            THEN concat(slice(done, 1, size(done) - 1),
                        array(struct(done[size(done) - 1].first AS first, greatest(done[size(done) - 1].last, s.last) AS last)))
            ELSE concat(done, array(struct(s.first AS first, s.last AS last))) END)"""
    )
    hit = F.expr("aggregate(spans, 0L, (sum, s) -> sum + s.last - s.first + 1)")
    return grouped.withColumn("spans", merged).select(
        "key_a", "key_b", "doc_id", "copies", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), "items", "spans"
    )


def is_contaminated(share: int = 20) -> Column:
    """At least one word of `share` words is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """`documents` without those of which one word in `share` or more is hit; all columns and all other rows stay.

    Rows are told apart by `doc_id` and `text`, nulls included; repeated rows all stay or all go.
    """
    bad = find_spans(documents.select("doc_id", "text"), benchmark, n).filter(is_contaminated(share)).select("key_a", "key_b")
    rows = documents.select(F.struct("*").alias("doc"), *row_key(F.col("doc_id"), F.col("text")))
    return rows.join(bad, ["key_a", "key_b"], "left_anti").select("doc.*")


def remove_spans(documents: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """`documents` with the hit words cut out of `text`, each together with the separators after it.

    All rows and columns stay; texts without hits stay as they are, null stays null.
    """
    spans = find_spans(documents.select("doc_id", "text"), benchmark, n).filter(F.size("spans") > 0).select("key_a", "key_b", "spans")
    rows = documents.select(F.struct("*").alias("doc"), *row_key(F.col("doc_id"), F.col("text")))
    joined = rows.join(spans, ["key_a", "key_b"], "left").withColumn("text", F.col("doc.text"))
    # Pieces: the separators before the first word, then each word with the separators after it.
    word, gap = "[0-9A-Za-z\\x80-\\x{10FFFF}]+", NOT_ALNUM.replace("\\x60", "\\x40\\x5B-\\x60")
    pieces = joined.withColumn("head", F.regexp_extract("text", f"^(?:{gap})?", 0)).withColumn(
        "pieces", F.regexp_extract_all(F.col("text"), F.lit(f"{word}(?:{gap})?"), F.lit(0))
    )
    kept = F.expr(
        """concat(head, array_join(transform(sequence(0, size(spans)), k -> array_join(slice(pieces,
            CASE WHEN k = 0 THEN 1 ELSE spans[k - 1].last + 2 END,
            greatest(0, (CASE WHEN k = size(spans) THEN size(pieces) ELSE spans[k].first END)
                - (CASE WHEN k = 0 THEN 0 ELSE spans[k - 1].last + 1 END))), '')), ''))"""
    )
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept)
    names = documents.columns
    return pieces.select(*[clean.alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in names])
