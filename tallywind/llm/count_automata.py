"""Weighted acyclic automata over word paths of up to three words.

A path is three symbols, 0 where a piece of text ended before; its weight is how often it occurs. An automaton is built from
sorted paths: one state for each first word, one for each pair, and a register in which pairs with the same arcs (third word and weight)
share one state. The weight of a prefix is the sum over the range of paths below it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import zstandard

#: Bits of a symbol in a packed path.
BITS = 21
_MASK = (1 << BITS) - 1


@dataclass
class Paths:
    """Sorted distinct paths with weights. Symbol k stands for `words[k - 1]`; words are sorted by their bytes."""

    words: list[bytes]
    first: np.ndarray
    second: np.ndarray
    third: np.ndarray
    weights: np.ndarray

    def part(self, start: int, stop: int) -> Paths:
        """The paths from `start` to `stop`, with those words only."""
        columns = [c[start:stop] for c in (self.first, self.second, self.third)]
        used = np.unique(np.concatenate([*columns, [0]]))
        return Paths([self.words[k - 1] for k in used[1:].tolist()], *[np.searchsorted(used, c) for c in columns], self.weights[start:stop])

    def name(self, k: int) -> list[bytes]:
        return [self.words[s - 1] for s in (int(self.first[k]), int(self.second[k]), int(self.third[k])) if s]

    def place(self, path: list[bytes]) -> int:
        """How many paths come before `path`."""
        start, stop = 0, len(self.first)
        for column, word in zip((self.first, self.second, self.third), path):
            k = bisect_left(self.words, word)
            if k == len(self.words) or self.words[k] != word:
                return start + int(np.searchsorted(column[start:stop], k + 1))
            start, stop = (start + int(np.searchsorted(column[start:stop], k + 1, side=s)) for s in ("left", "right"))
        return start


def count_paths(words: list[bytes], tokens: np.ndarray) -> Paths:
    """The paths from each token on. Token 0 ends a piece, token k stands for `words[k - 1]`, in any order; below 2^21 words."""
    order = sorted(range(len(words)), key=words.__getitem__)
    ranks = np.zeros(len(words) + 1, np.int64)
    ranks[np.array(order, np.int64) + 1] = np.arange(1, len(words) + 1)
    symbols = np.append(ranks[tokens], [0, 0])
    first, second, third = symbols[:-2], symbols[1:-1], symbols[2:]
    keys = (first << 2 * BITS | second << BITS | np.where(second == 0, 0, third))[first != 0]
    keys.sort()
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    weights = np.diff(np.append(starts, len(keys)))
    keys = keys[starts]
    return Paths([words[k] for k in order], keys >> 2 * BITS, keys >> BITS & _MASK, keys & _MASK, weights)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for column in columns:
        fresh[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(fresh)


def _registered(labels: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each state, whose arcs begin at `starts`, the first state with the same arcs."""
    sizes = np.diff(np.append(starts, len(labels)))
    inside = np.arange(len(labels)) - np.repeat(starts, sizes)
    arcs = labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ weights.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    arcs = (arcs ^ arcs >> np.uint64(29)) * (2 * inside.astype(np.uint64) + np.uint64(0xBF58476D1CE4E5B9))
    _, first, place = np.unique(np.add.reduceat(arcs, starts), return_index=True, return_inverse=True)
    states = first[place]
    # Equal hashes only propose.
    other = np.minimum(np.repeat(starts[states], sizes) + inside, len(labels) - 1)
    equal = (labels == labels[other]) & (weights == weights[other]) & np.repeat(sizes == sizes[states], sizes)
    return np.where(np.logical_and.reduceat(equal, starts), states, np.arange(len(starts)))


@dataclass
class Automaton:
    """Arcs level by level: labels and numbers of arcs of the first states, labels and targets, and the arcs of the shared states."""

    words: list[bytes]
    first: np.ndarray
    first_arcs: np.ndarray
    second: np.ndarray
    targets: np.ndarray
    state_arcs: np.ndarray
    third: np.ndarray
    weights: np.ndarray

    @staticmethod
    def build(paths: Paths) -> Automaton:
        pairs = _starts(paths.first, paths.second)
        heads = _starts(paths.first[pairs])
        sizes = np.diff(np.append(pairs, len(paths.first)))
        states = _registered(paths.third, paths.weights, pairs)
        kept, targets = np.unique(states, return_inverse=True)
        arcs = np.repeat(pairs[kept] - np.cumsum(sizes[kept]) + sizes[kept], sizes[kept]) + np.arange(sizes[kept].sum())
        return Automaton(
            paths.words, paths.first[pairs][heads], np.diff(np.append(heads, len(pairs))), paths.second[pairs], targets, sizes[kept],
            paths.third[arcs], paths.weights[arcs],
        )

    def paths(self) -> Paths:
        begins = np.cumsum(self.state_arcs) - self.state_arcs
        sizes = self.state_arcs[self.targets]
        arcs = np.repeat(begins[self.targets] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return Paths(
            self.words, np.repeat(np.repeat(self.first, self.first_arcs), sizes), np.repeat(self.second, sizes), self.third[arcs], self.weights[arcs]
        )

    def pack(self) -> bytes:
        arrays = [self.first, self.first_arcs, self.second, self.targets, self.state_arcs, self.third]
        words = b" ".join(self.words)
        head = np.array([len(words), len(self.weights), *map(len, arrays)], "<i8").tobytes()
        return zstandard.compress(head + words + self.weights.astype("<i8").tobytes() + b"".join(a.astype("<i4").tobytes() for a in arrays), 1)

    @staticmethod
    def unpack(data: bytes) -> Automaton:
        data = zstandard.decompress(data)
        n_words, n_weights, *sizes = np.frombuffer(data, "<i8", 8).tolist()
        at = 64 + n_words
        words, weights = data[64:at].split(b" ") if n_words else [], np.frombuffer(data[at : at + 8 * n_weights], "<i8")
        at += 8 * n_weights
        arrays = []
        for size in sizes:
            arrays.append(np.frombuffer(data[at : at + 4 * size], "<i4").astype(np.int64))
            at += 4 * size
        return Automaton(words, *arrays, weights)


def union(parts: Iterable[Paths]) -> Paths:
    """All paths, with the sums of their weights; in order of symbols, but `words` in order of appearance. Parts are taken one by one."""
    table: dict[bytes, int] = {}
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for part in parts:
        own = np.array([0] + [table.setdefault(w, len(table) + 1) for w in part.words], np.int32)
        for known, column in zip(columns, (own[part.first], own[part.second], own[part.third], part.weights)):
            known.append(column)
    first, second, third, weights = map(np.concatenate, columns)
    columns.clear()
    if len(table) < _MASK:
        order = np.argsort(first.astype(np.int64) << 2 * BITS | second.astype(np.int64) << BITS | third)
    else:
        order = np.lexsort((third, second, first))
    first, second, third, weights = first[order], second[order], third[order], weights[order]
    starts = _starts(first, second, third)
    return Paths(list(table), first[starts], second[starts], third[starts], np.add.reduceat(weights, starts))


def prefix_weights(paths: Paths, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The prefixes of so many words, as columns of symbols, and the sums of the weights below them."""
    columns = [paths.first, paths.second, paths.third][:words]
    starts = _starts(*columns)
    sums = np.add.reduceat(paths.weights, starts) if len(starts) else paths.weights
    whole = columns[-1][starts] != 0
    return [c[starts][whole] for c in columns], sums[whole]
