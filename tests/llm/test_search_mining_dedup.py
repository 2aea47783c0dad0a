"""Ball-tree search, collocations and suffix-array dedup against brute force on small tables."""

from __future__ import annotations

import collections
import math
import random
import re
import sys

import numpy as np
import pytest
import zstandard

from tallywind.llm import ball_tree, collocations, count_automata, suffix_array, suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# Search ------------------------------------------------------------------------------------------


def ranked(rows, items, best=50):
    texts = [[w.translate(LOWER) for w in TERM.findall(t or "")] for _, t in rows]
    n_all, l_all = sum(1 for t in texts if t), sum(map(len, texts))
    df = collections.Counter(w for t in texts for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for (doc_id, _), words in zip(rows, texts):
            tf = collections.Counter(words)
            m = 50 + (50 * len(words) * n_all) // l_all if l_all else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
                for t in {w.translate(LOWER) for w in TERM.findall(text or "")} if tf[t]
            )
            if score > 0:
                scores.append((-score, math.inf if doc_id is None else doc_id, doc_id))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2])[:best])]
    return sorted(out, key=repr)


def search_rows(seed, n):
    r = random.Random(seed)
    words = ["River", "stone", "É", "漢字", "a1", "the", "THE", "of"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(words[: r.randrange(3, 68)]) + r.choice(["", ",", ". "]) for _ in range(r.randrange(0, 60)))) for i in range(n)]
    rows += [(7, rows[3][1]), (None, rows[5][1]), (1000, None), (1001, " ,; ")] + [(2000 + i, "river stone the of w1") for i in range(80)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))) for i in range(12)] + [(20, None), (21, "..."), (22, "unknown"), (0, "river")]
    return rows, items


@pytest.mark.parametrize("tree, leaf, block", [(8192, 64, 32768), (50, 4, 10)])
def test_search_matches_brute_force(spark, monkeypatch, tree, leaf, block):
    monkeypatch.setattr(ball_tree, "TREE_DOCUMENTS", tree)
    monkeypatch.setattr(ball_tree.BallTree.__init__, "__defaults__", (leaf,))
    rows, items = search_rows(4, 300)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, score int").repartition(3)
    got = ball_tree.search(docs, spark.createDataFrame(items, "item_id bigint, text string"), best=9, block_terms=block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == ranked(rows, items, 9)


def test_search_empty(spark):
    none, some = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert ball_tree.search(none, some).collect() == []
    assert ball_tree.search(spark.createDataFrame([(1, "a")], none.schema), some.limit(0)).collect() == []


def test_bounds_hold_and_prune():
    """No member of a ball scores above the ball's bound, and on clustered rows most leaves stay closed."""
    rng = np.random.default_rng(1)
    n, terms = 2000, 40
    dense = np.zeros((n, terms), np.int64)
    for i in range(n):
        at = 4 * (i % 10)
        dense[i, at : at + 4] = rng.integers(99 * 10**4, 10**6, 4)
    rows = ball_tree.Postings(np.arange(n), np.arange(n + 1) * 4, np.nonzero(dense)[1], dense[dense > 0])
    tree = ball_tree.BallTree(rows, terms, 16)
    query, weights = np.array([0, 1, 9]), np.array([5000, 7000, 300])
    q = np.zeros(terms)
    q[query] = weights
    for (start, stop), centroid, radius in zip(tree.spans, tree.centroids, tree.radii):
        exact = (dense[tree.rows.ids[start:stop]] @ q).max()
        assert exact <= (centroid @ q + np.sqrt(q @ q) * radius) * (1 + ball_tree.SLACK) + 1
    opened = []
    part = ball_tree.Postings.part
    best = ball_tree.Best(5)
    ball_tree.Postings.part = lambda self, a, b: opened.append((a, b)) or part(self, a, b)
    try:
        tree.search(query, weights, best, np.zeros(terms))
    finally:
        ball_tree.Postings.part = part
    want = sorted(((int(s), -i) for i, s in enumerate(dense @ q)), reverse=True)[:5]
    assert sorted(best.heap, reverse=True) == want
    assert len(opened) < sum(not c for c in tree.children) / 2


# Collocations --------------------------------------------------------------------------------------


def mined(rows, least, best):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(100 * b >= 50 * a for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, totals[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:best])]
    return sorted(out)


@pytest.mark.parametrize("words, paths", [(10**6, 10**6), (200, 40)])
def test_collocations_match_brute_force(spark, monkeypatch, words, paths):
    monkeypatch.setattr(collocations, "SAMPLE_PATHS", 8)
    monkeypatch.setattr(collocations, "CHUNK_PATHS", 100)
    r = random.Random(9)
    pool = ["New", "york", "times", "É", "of", "the", "a\x01b", "\x1f", "漢字"] + [f"w{i}" for i in range(12)]
    rows = [(r.choice(["en", "en", "en", None, "de"]), "".join(r.choice(pool[: r.randrange(2, 21)]) + r.choice([" ", " ", " ", "\t", ". ", "\n", ";"]) for _ in range(r.randrange(0, 90)))) for _ in range(150)]
    rows += [("en", "new york times. " * 40), (None, None), ("xx", ""), ("hot", "again and " * 300)]
    docs = spark.createDataFrame([(*row, 1) for row in rows], "lang string, text string, rank int").repartition(3)
    got = sorted(tuple(x) for x in collocations.mine(docs, 3, 25, shard_words=words, range_paths=paths).collect())
    assert got == mined(rows, 3, 25)
    assert collocations.mine(docs.limit(0)).collect() == []


def test_automata():
    for seed in range(60):
        r = random.Random(seed)
        words = [b"w%d" % i for i in range(r.randrange(1, 6))]
        r.shuffle(words)
        tokens = [r.randrange(0, len(words) + 1) for _ in range(r.randrange(1, 80))]
        paths = count_automata.count_paths(words, np.array(tokens, np.int32))
        want = collections.Counter()
        for i, token in enumerate(tokens):
            path = []
            for x in tokens[i : i + 3]:
                if not x:
                    break
                path.append(words[x - 1])
            if path:
                want[tuple(path)] += 1
        names = [tuple(paths.name(k)) for k in range(len(paths.first))]
        assert names == sorted(want) and [want[n] for n in names] == list(paths.weights)
        if not names:
            continue
        machine = count_automata.Automaton.build(paths)
        again = count_automata.Automaton.unpack(machine.pack()).paths()
        assert [tuple(again.name(k)) for k in range(len(again.first))] == names and list(again.weights) == list(paths.weights)
        for probe in [*names, (b"w1", b"w0"), (b"a",), (b"w2", b"zz", b"a")]:
            assert paths.place(list(probe)) == sum(n < probe for n in names)
        a, b = sorted([r.randrange(len(names) + 1), r.randrange(len(names) + 1)])
        parts = [paths.part(x, y) for x, y in ((0, a), (a, b), (b, len(names)), (0, len(names))) if y > x]
        whole = count_automata.union(parts)
        assert {tuple(whole.name(k)): int(whole.weights[k]) for k in range(len(whole.first))} == {n: 2 * want[n] for n in names}


def test_register_shares_states():
    tokens = np.array([k for first in range(1, 31) for k in (first, 31, 32, 0)], np.int32)
    machine = count_automata.Automaton.build(count_automata.count_paths([b"w%02d" % i for i in range(32)], tokens))
    # Thirty pairs (first, 31) lead to the one state "then 32, once", as does none of the others.
    assert len(machine.targets) == 32 and len(machine.state_arcs) == 2


# Suffix arrays and repeats ---------------------------------------------------------------------------


def test_suffix_array_and_common_prefixes():
    for seed in range(150):
        r = random.Random(seed)
        n = r.randrange(1, 60)
        text = np.array([r.randrange(1, r.choice([2, 3, 5, 9])) for _ in range(n)] + [0], np.uint16)
        order = suffix_array.suffix_array(text, 10)
        assert list(order) == sorted(range(n + 1), key=lambda i: list(text[i:]))
        common = suffix_array.permuted_lcp(text, order, np.array([], int), 64)
        for k in range(1, n + 1):
            a, b = list(text[order[k - 1] :]), list(text[order[k] :])
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[order[k]] == same


def test_long_runs_of_one_byte():
    text = np.array([3] * 5000 + [1] + [3] * 5000 + [0], np.uint16)
    order = suffix_array.suffix_array(text, 4)
    assert order[0] == 10001 and order[1] == 5000 and set(order.tolist()) == set(range(10002))


def removed(rows, window=50):
    none, owner, out = 2**63 - 1, {}, []
    texts = [(none if d is None else d, (t or "").encode()) for d, t in rows]
    for d, data in texts:
        for p in range(len(data) - window + 1):
            owner[data[p : p + window]] = min(owner.get(data[p : p + window], none), d)
    for d, data in texts:
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            if owner[data[p : p + window]] < d:
                gone[p : p + window] = b"\x01" * window
        spans = [m.span() for m in re.finditer(b"\x01+", bytes(gone))]
        out.append((d, len(data), spans, bytes(x for x, g in zip(data, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"hot_strings": 2}, {"hot_strings": 0, "shard_bytes": 500}, {"shard_bytes": 300}])
def test_repeats_match_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    r = random.Random(1)

    def noise(n):
        return "".join(r.choice("ab é\n") for _ in range(n))

    base, rows = [noise(70) for _ in range(5)], []
    for i in range(120):
        parts = [r.choice([r.choice(base), r.choice(base)[: r.randrange(1, 70)], noise(r.randrange(0, 30)), " " * r.randrange(0, 120)]) for _ in range(r.randrange(0, 6))]
        rows.append((r.choice([i, i, i, 7, None]), r.choice(["".join(parts)] * 9 + [None, ""])))
    rows += [(500, base[0][:49]), (501, base[0][:50]), (502, base[0][:50] + "x")]
    docs = spark.createDataFrame([(*row, b"k") for row in rows], "doc_id bigint, text string, kept binary").repartition(3)
    got = suffix_dedup.remove_repeats(docs, **options).collect()
    none = 2**63 - 1
    assert sorted((none if x.doc_id is None else x.doc_id, x.n_bytes, [(s.start, s.end) for s in x.spans], bytes(x.kept)) for x in got) == removed(rows)


def test_repeats_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.remove_repeats(docs).collect() == []
    short = spark.createDataFrame([(1, "x"), (2, None), (3, "x")], docs.schema)
    assert sorted((x.doc_id, x.n_bytes, x.spans) for x in suffix_dedup.remove_repeats(short).collect()) == [(1, 1, []), (2, 0, []), (3, 1, [])]


def test_work_in_a_shard_does_not_grow_with_batches(monkeypatch):
    """Strings of all batches lie side by side: a batch more costs a few calls, not some for each of a shard's cells."""
    r = random.Random(3)
    texts = [bytes(r.choices(b"abcd", k=60)) for _ in range(64)]

    def packed(n):
        return zstandard.compress(bytes([60] * n) + np.full(n, 5).tobytes() + b"".join(texts[:n]))

    cells = np.full(suffix_dedup.CELLS, 64 // suffix_dedup.CELLS, "<i4").tobytes()
    counts = []
    for batches in (10, 60):
        calls = []
        sys.setprofile(lambda frame, event, what: calls.append(event) if event in ("call", "c_call") else None)
        try:
            found = suffix_dedup._find_in_shard([cells] * batches, [packed(64)] * batches, 50)
        finally:
            sys.setprofile(None)
        # Not counted: the table of strings, two calls for each.
        counts.append(len(calls) - 2 * 64 * batches)
        assert found == []
    assert (counts[1] - counts[0]) / 50 <= 2 * suffix_dedup.CELLS
    later = zstandard.compress(bytes([60] * 64) + np.arange(100, 164).tobytes() + b"".join(texts))
    (found,) = suffix_dedup._find_in_shard([cells, cells], [packed(64), later], 50)
    assert found[0] == 1 and np.frombuffer(found[1], "<i4").tolist() == list(range(64))
    assert np.frombuffer(zstandard.decompress(found[2]), np.int64).tolist() == [5] * (64 * 11)
