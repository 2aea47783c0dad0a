"""Multi-line stack traces in log streams, stitched to one event each.

A trace grammar is a small automaton over lines. It runs per stream (the process that logged), in
arrival order, and only joins lines that are at most one second apart.

Scale. A stream does not have to pass through one task. It is cut into pieces at ranges of arrival numbers that hold about equally many
lines. What a piece does to the automaton comes down to a table, from every state it may be entered in to the state it leaves behind;
the tables of a stream are composed in order, which tells each piece the state that it really is entered in. Then all pieces are worked
off at once. Up to three lines that are still pending at a border, which may yet turn out to be no trace, are read again by the next piece; a
longer trace that crosses borders leaves a fragment in each piece, and its fragments are joined. Pieces are sorted partitions that are
read batch by batch in constant memory, and lines that start nothing while the automaton is idle pass in bulk.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywind.operators.ranges import RANGE_ROWS, range_ends, range_of
from tallywind.session import land

STREAM_KEY = ["boot_id", "uid", "gid", "pid", "command", "systemd_unit", "container_id"]


@dataclass(frozen=True)
class State:
    """``moves``: (pattern, next state); ``weak``: moves that ordinary text can make, too."""

    moves: list[tuple[str, str]]
    weak: list[tuple[str, str]] = field(default_factory=list)
    otherwise: str = "end"  # or "cancel": it was no trace after all


@dataclass(frozen=True)
class Grammar:
    starts: list[tuple[str, str]]
    states: dict[str, State]

    def start(self, line: str) -> str | None:
        return next((to for pattern, to in self.starts if re.match(pattern, line)), None)

    def step(self, state: str, line: str) -> str:
        here = self.states[state]
        return next((to for pattern, to in here.moves + here.weak if re.match(pattern, line)), here.otherwise)


# How the traces of three languages look, line by line.
_FRAME = r"  File|    "
_TRACEBACK = r"Traceback \(most recent call last\):\Z"
PYTHON = Grammar(
    starts=[(_TRACEBACK, "head")],
    states={
        "head": State([(_FRAME, "frames")], otherwise="cancel"),
        "frames": State([(_FRAME, "frames")], weak=[("[a-zA-Z]", "raised")], otherwise="cancel"),
        "raised": State([("During handling of the above exception", "again")]),
        "again": State([(_TRACEBACK, "head")], otherwise="cancel"),
    },
)
_AT = r"\s+at "
_CAUSE = r"\s*(?:Caused by|Suppressed):"
JAVA = Grammar(
    starts=[("Exception in thread ", "head"), (r"[a-zA-Z][_a-zA-Z0-9]*(?:\.[a-zA-Z][_a-zA-Z0-9$]*)+:", "head")],
    states={
        "head": State([(_AT, "frames")], otherwise="cancel"),
        "frames": State([(_AT, "frames"), (r"\s+\.\.\.\s+\d+\s+more", "rest"), (_CAUSE, "head")]),
        "rest": State([(_CAUSE, "head")]),
    },
)
_NAME = r"[a-zA-Z][_a-zA-Z0-9]*:"
NODE = Grammar(
    starts=[(r"/.+:\d+$", "source"), (_NAME, "frames")],
    states={
        "source": State([], weak=[(r"[\s\S]", "marker")], otherwise="cancel"),
        "marker": State([(r"\s*\^\s*\Z", "head")], otherwise="cancel"),
        "head": State([(_NAME, "frames")], otherwise="cancel"),
        "frames": State([(_AT, "frames")]),
    },
)
GRAMMARS = (PYTHON, JAVA, NODE)


class Stitcher:
    """The automaton of one stream. Lines are ``(ts, message, payload)``; what comes out is
    ``(payload of the first line, message)``.

    A trace may have begun elsewhere: then ``before`` of its lines, the last one at ``last``, are not held here, and what
    comes out has the payload ``CARRIED``.
    """

    CARRIED = object()

    def __init__(
        self, grammars: Iterable[Grammar], grammar: int = -1, state: str = "", lines: list | None = None, max_lines: int | None = None,
        before: int = 0, last: float = 0.0,
    ):
        self.grammars, self.max_lines = list(grammars), max_lines
        self.grammar, self.state, self.lines = grammar, state, lines or []
        self.before, self.last = before, last

    @property
    def size(self) -> int:
        return self.before + len(self.lines)

    def close(self) -> Iterator[tuple]:
        if self.lines:
            yield self.CARRIED if self.before else self.lines[0][2], "\n".join(message for _, message, _ in self.lines)
        self.lines, self.before = [], 0

    def feed(self, line: tuple) -> Iterator[tuple]:
        waiting = deque([line])
        while waiting:
            line = waiting.popleft()
            ts, message, payload = line
            if self.size:
                verdict, last = "end", self.lines[-1][0] if self.lines else self.last
                if ts is not None and last is not None and last <= ts <= last + 1:
                    verdict = self.grammars[self.grammar].step(self.state, message)
                if verdict == "cancel" and self.size <= 3:
                    # A false start: let its first line go and look at the others again, in order.
                    first, *others = self.lines
                    self.lines = []
                    yield first[2], first[1]
                    waiting.extendleft(reversed([*others, line]))
                    continue
                if verdict not in ("end", "cancel"):
                    self.state = verdict
                    self.lines.append(line)
                    if self.max_lines and len(self.lines) > self.max_lines:
                        self.lines = self.lines[-(self.max_lines // 2):]
                    continue
                yield from self.close()
            for i, grammar in enumerate(self.grammars):
                state = None if message is None else grammar.start(message)
                if state is not None:
                    self.grammar, self.state, self.lines = i, state, [line]
                    break
            else:
                yield payload, message


def _any(patterns: Iterable[str], message: Column) -> Column:
    """Column test that is true at least where one of the Python patterns matches."""
    wide = [p.replace(r"\s", r"[\s\x1c-\x1f]") for p in dict.fromkeys(patterns)]
    joined = "|".join(f"(?:{p})" for p in wide)
    return message.rlike(rf"(?Us)\A(?:{joined})") if joined else F.lit(False)


# Pieces ----------------------------------------------------------------------------------------

#: Lines from which on a trace is never taken back.
_FIRM = 4
_KEY = ["_h1", "_h2", "_piece"]
_TABLE_SCHEMA = "_h1 bigint, _h2 bigint, _piece int, head string, table string"
_ENTRY_SCHEMA = "_h1 bigint, _h2 bigint, _piece int, seq bigint, _entry string"


def _state(machine: Stitcher, first: int | None) -> list | None:
    """What is to be known of an automaton to go on elsewhere; None if it is idle. ``first`` is where a carried trace began."""
    if not machine.size:
        return None
    if machine.size < _FIRM:
        return [machine.grammar, machine.state, machine.lines]
    last = machine.lines[-1][0] if machine.lines else machine.last
    return [machine.grammar, machine.state, None, first if machine.before else machine.lines[0][2], last]


def _resumed(grammars: tuple, state: list | None) -> tuple[Stitcher, int | None]:
    if state is None:
        return Stitcher(grammars), None
    if state[2] is not None:
        return Stitcher(grammars, state[0], state[1], [tuple(line) for line in state[2]]), None
    return Stitcher(grammars, state[0], state[1], before=_FIRM, last=state[4]), state[3]


class _Table:
    """What the lines of one piece after its first ``_FIRM`` do to the automaton.

    At that point it is idle, holds at most three of those lines, or has a firm trace in one of all states; it runs from all of
    these at once. Automata that have come to the same state go on as one.
    """

    def __init__(self, grammars: tuple):
        self.grammars, self.head, self.runs = grammars, [], {}

    def add(self, line: tuple, starts: bool) -> None:
        if len(self.head) < _FIRM:
            self.head.append(line)
            if len(self.head) == _FIRM:
                self._open()
            return
        merged = {}
        for machine, labels in self.runs.values():
            if machine.size or starts:
                for _ in machine.feed(line):
                    pass
                if machine.size > _FIRM:
                    self._shorten(machine)
            _, known = merged.setdefault(self._name(machine), (machine, []))
            known += labels
        self.runs = merged

    def _open(self) -> None:
        for held in range(_FIRM):
            machine = Stitcher(self.grammars)
            for line in self.head[_FIRM - held:]:
                for _ in machine.feed(line):
                    pass
            if machine.size == held:
                self._put(machine, str(held))
        for i, grammar in enumerate(self.grammars):
            for state in grammar.states:
                self._put(Stitcher(self.grammars, i, state, before=_FIRM, last=self.head[-1][0]), f"{i}:{state}")

    def _put(self, machine: Stitcher, label: str) -> None:
        _, known = self.runs.setdefault(self._name(machine), (machine, []))
        known.append(label)

    @staticmethod
    def _shorten(machine: Stitcher) -> None:
        """Of a firm trace only its first and last lines matter."""
        if not machine.before:
            machine.lines = [machine.lines[0]] + machine.lines[1 - _FIRM:]
        else:
            machine.last, machine.lines = machine.lines[-1][0], []

    @staticmethod
    def _name(machine: Stitcher) -> tuple:
        if not machine.size:
            return ()
        first = None if machine.before else machine.lines[0][2]
        return machine.grammar, machine.state, first, min(machine.size, _FIRM)

    def row(self) -> tuple[str, str]:
        found = {label: _state(machine, None) for machine, labels in self.runs.values() for label in labels}
        return json.dumps(self.head), json.dumps(found)


def _compose(grammars: tuple, pieces: list[tuple[int, list, dict]]) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
    """For the pieces of one stream the states that they are entered in, and the lines that are still pending there.

    Entries are ``(piece, JSON of [state or None, whether pieces follow])``, pending lines ``(seq, piece)``.
    """
    state, entries, pending = None, [], []
    for k, (piece, head, table) in enumerate(pieces):
        firm = state is not None and state[2] is None
        entries.append((piece, json.dumps([state if firm else None, k + 1 < len(pieces)])))
        machine, first = _resumed(grammars, state)
        for line in head:
            for _ in machine.feed(tuple(line)):
                pass
            first = first if machine.before else None
        if table:
            if not machine.size:
                label = "0"
            elif machine.size < _FIRM:
                label = str(machine.size)
            else:
                label = f"{machine.grammar}:{machine.state}"
                first = first if machine.before else machine.lines[0][2]
            state = table[label]
            if state is not None and state[2] is None and state[3] is None:
                state[3] = first
        else:
            state = _state(machine, first)
        if state is not None and state[2] is not None and k + 1 < len(pieces):
            pending += [(line[2], pieces[k + 1][0]) for line in state[2]]
    return entries, pending


def _groups(columns: list[np.ndarray], last: tuple | None) -> np.ndarray:
    """Which rows begin another group than the row before them; ``last`` is the key before the first row."""
    fresh = np.zeros(len(columns[0]), bool)
    for column, before in zip(columns, last or (None,) * len(columns)):
        fresh[1:] |= column[1:] != column[:-1]
        fresh[0] |= before is None or column[0] != before
    return fresh


def _keys(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY]


def _tables(lines: DataFrame, grammars: tuple) -> DataFrame:
    """One row per piece: its first lines and its table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, key = _Table(grammars), None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip([*_KEY, "head", "table"], [*map(int, key), *table.row()]))], schema=pa.schema(
                [("_h1", pa.int64()), ("_h2", pa.int64()), ("_piece", pa.int32()), ("head", pa.string()), ("table", pa.string())]
            ))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(batch)
            fresh = _groups(keys, key)
            rows = zip(fresh, batch.column("ts").to_pylist(), batch.column("message").to_pylist(), batch.column("seq").to_pylist(), batch.column("_starts").to_pylist())
            for i, (new, ts, message, seq, starts) in enumerate(rows):
                if new:
                    if key is not None:
                        yield done()
                    table, key = _Table(grammars), tuple(c[i] for c in keys)
                table.add((ts, message, seq), starts)
        if key is not None:
            yield done()

    narrow = lines.where("_piece >= 0").select(*_KEY, "seq", "ts", "message", "_starts")
    return narrow.repartition(*_KEY).sortWithinPartitions(*_KEY, "seq").mapInArrow(run, _TABLE_SCHEMA)


def _composed(tables: DataFrame, grammars: tuple) -> DataFrame:
    """Entries (``seq`` is null) and pending lines of all streams; a stream has 4,096 pieces at most."""
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["_piece"])
        entries, pending = _compose(grammars, [(r["_piece"], json.loads(r["head"]), json.loads(r["table"])) for r in rows])
        key = {c: rows[0][c] for c in ("_h1", "_h2")}
        out = [key | {"_piece": p, "seq": None, "_entry": e} for p, e in entries] if len(rows) > 1 else []
        out += [key | {"_piece": p, "seq": s, "_entry": None} for s, p in pending]
        return pa.Table.from_pylist(out, schema=pa.schema(
            [("_h1", pa.int64()), ("_h2", pa.int64()), ("_piece", pa.int32()), ("seq", pa.int64()), ("_entry", pa.string())]
        ))

    return tables.groupBy("_h1", "_h2").applyInArrow(run, _ENTRY_SCHEMA)


class _Worker:
    """Works off sorted pieces; what comes out are places of rows, new messages, and where a fragment's trace began."""

    def __init__(self, grammars: tuple, max_lines: int | None):
        self.grammars, self.max_lines = grammars, max_lines
        self.machine, self.first, self.more = Stitcher(grammars, max_lines=max_lines), None, False
        self.whole: list[np.ndarray] = []
        self.joined: list[tuple[int, str, int | None]] = []

    def leave(self, seq_of) -> None:
        """The piece ends: what is open closes, or goes on in the next piece."""
        if self.more and self.machine.size < _FIRM:
            pass  # the next piece has these lines, too
        elif self.more and not self.machine.before:
            self.first = seq_of(self.machine.lines[0][2])
            for payload, message in self.machine.close():
                self.joined.append((payload, message, self.first))
        else:
            self.out(self.machine.close())
        self.machine, self.first, self.more = Stitcher(self.grammars, max_lines=self.max_lines), None, False

    def enter(self, entry: str) -> None:
        state, self.more = json.loads(entry)
        self.machine, self.first = _resumed(self.grammars, state)

    def out(self, done: Iterator[tuple]) -> None:
        for payload, message in done:
            if payload is Stitcher.CARRIED:
                self.joined.append((-1, message, self.first))
            else:
                self.joined.append((payload, message, None))


def _emit(lines: DataFrame, fields: list[str], grammars: tuple, max_lines: int | None, level: int | None) -> DataFrame:
    """The events of sorted pieces, with ``_first`` (the trace's first line) and ``_piece`` where a row is a fragment."""
    known = lines.select(*fields, F.col("_h1").alias("_first"), "_h1", "_h2", "_piece").schema
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, key, held = _Worker(grammars, max_lines), None, None

        def finish(table: pa.Table) -> pa.RecordBatch:
            """What has come out, as rows of ``table``."""
            rows = np.concatenate([*worker.whole, np.array([r for r, _, _ in worker.joined], np.int64)]).astype(np.int64)
            n = len(rows) - len(worker.joined)
            taken = table.take(pa.array(rows, pa.int64(), mask=rows < 0))
            message = pa.chunked_array([*taken.column("message").slice(0, n).chunks, pa.array([m for _, m, _ in worker.joined], pa.string())])
            first = [f for _, _, f in worker.joined]
            columns = {name: taken.column(name) for name in fields} | {"message": message}
            if level is not None:
                old = taken.column("message").to_pylist()[n:]
                own = columns["level"].to_pylist()
                own[n:] = [level if (m != o or f is not None) else v for (_, m, f), o, v in zip(worker.joined, old, own[n:])]
                columns["level"] = pa.array(own, taken.schema.field("level").type)
            columns["_first"] = pa.array([None] * n + first, pa.int64())
            at = np.where(rows < 0, 0, rows)
            for name in _KEY:
                columns[name] = table.column(name).take(pa.array(at))
            # A fragment without its first line only has the key of where it is.
            own_keys = worker.keys
            for k, name in enumerate(_KEY):
                values = columns[name].to_pylist()
                for i in np.flatnonzero(rows < 0):
                    values[i] = own_keys[i - n][k]
                columns[name] = pa.array(values, table.schema.field(name).type) if (rows < 0).any() else columns[name]
            out = pa.table(columns).combine_chunks()
            worker.whole, worker.joined, worker.keys = [], [], []
            return out

        worker.keys = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            shift = 0
            if held is not None:
                table, shift = pa.concat_tables([held, table]), held.num_rows
            keys, n = _keys(batch), batch.num_rows
            fresh = _groups(keys, key)
            starts = np.array(batch.column("_starts").fill_null(False).to_numpy(zero_copy_only=False))
            stops = np.flatnonzero(fresh | starts)
            ts, message, entry, seq = batch.column("ts"), batch.column("message"), batch.column("_entry"), table.column("seq")
            aside = keys[2] < 0

            def seq_of(row: int) -> int:
                return seq[row].as_py()

            def note() -> None:
                worker.keys += [key] * (len(worker.joined) - len(worker.keys))

            i = 0
            while i < n:
                if fresh[i]:
                    worker.leave(seq_of)
                    note()
                    key = tuple(int(c[i]) for c in keys)
                    if entry[i].is_valid:
                        worker.enter(entry[i].as_py())
                        i += 1
                        continue
                    fresh[i] = False
                if not worker.machine.size and (aside[i] or not starts[i]):
                    # Nothing begins before the next stop.
                    k = int(np.searchsorted(stops, i, side="right"))
                    stop = int(stops[k]) if k < len(stops) else n
                    worker.whole.append(np.arange(i + shift, stop + shift))
                    i = stop
                    continue
                worker.out(worker.machine.feed((ts[i].as_py(), message[i].as_py(), i + shift)))
                note()
                i += 1
            pending = worker.machine.lines
            done = finish(table) if worker.whole or worker.joined else None
            # Rows that may still come out: all lines of a short trace, or of one that may be cut, else the first.
            keep = pending if len(pending) < _FIRM or max_lines else pending[:1]
            places = {line[2]: k for k, line in enumerate(keep)}
            held = table.take(pa.array([line[2] for line in keep], pa.int64())) if keep else None
            worker.machine.lines = [(t, m, places.get(p, -2)) for t, m, p in pending]
            if done is not None:
                yield from done.to_batches()
        worker.leave(lambda row: held.column("seq")[row].as_py())
        worker.keys += [key] * (len(worker.joined) - len(worker.keys))
        if worker.joined:
            yield from finish(held if held is not None else table).to_batches()

    return lines.repartition(*_KEY).sortWithinPartitions(*_KEY, F.asc_nulls_first("seq")).mapInArrow(run, schema)


def stitch(
    events: DataFrame, key: list[str] | None = None, grammars: Iterable[Grammar] = GRAMMARS, trace_level: int | None = None,
    range_rows: int = RANGE_ROWS, max_lines: int | None = None, bypass: str | None = None, ends: list[int] | None = None,
) -> DataFrame:
    """Events with ``message, ts DOUBLE, seq`` to one event per trace, with the first line's fields.

    ``seq`` tells the lines of a stream apart. ``trace_level`` replaces the level of stitched traces. Traces are whole; with
    ``max_lines``, one that grows beyond it keeps the newer half and goes on (streams then stay in one piece, as lines count from a
    trace's start). Events whose boolean column ``bypass`` is true go through as they are, as if they were in no stream.

    Streams are cut into pieces of about ``range_rows`` lines of all streams; unless ``ends`` are given, the ranges of arrival numbers
    are looked up when this is called. Where there is more than one, tables and fragments are landed in the shared folder.
    """
    grammars = tuple(grammars)
    key = [c for c in (key or STREAM_KEY) if c in events.columns]
    fields = events.columns
    if max_lines:
        ends = []
    ends = range_ends(events, "seq", range_rows) if ends is None else ends
    aside = F.lit(False) if bypass is None else F.coalesce(F.col(bypass), F.lit(False))
    # Two hashes stand for the stream; what is in no stream is spread over negative pieces.
    stream = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key] or [F.lit("")]
    spread = -1 - F.pmod(F.xxhash64("seq"), F.lit(4096)).cast("int")
    lines = events.withColumns({
        "_h1": F.when(aside, 0).otherwise(F.xxhash64(*stream)), "_h2": F.when(aside, 0).otherwise(F.xxhash64(F.lit("second"), *stream)),
        "_piece": F.when(aside, spread).otherwise(range_of(F.col("seq"), ends)),
        "_starts": ~aside & F.coalesce(_any([p for g in grammars for p, _ in g.starts], F.col("message")), F.lit(False)),
        "_entry": F.lit(None).cast("string"),
    })
    level = trace_level if "level" in fields else None
    if not ends:
        return _emit(lines, fields, grammars, max_lines, level).select(*fields)

    composed = land(_composed(_tables(lines, grammars), grammars))
    pending = composed.where("seq IS NOT NULL").groupBy("_h1", "_h2", "seq").agg(F.collect_list("_piece").alias("_later"))
    pieces = F.concat(F.array("_piece"), F.coalesce("_later", F.array().cast("array<int>")))
    lines = lines.join(pending, ["_h1", "_h2", "seq"], "left").withColumn("_piece", F.explode(pieces)).drop("_later")
    entries = composed.where("seq IS NULL").withColumn("seq", F.lit(None).cast("bigint"))
    found = land(_emit(lines.unionByName(entries, allowMissingColumns=True), fields, grammars, max_lines, level))
    own = F.struct(*[c for c in fields if c != "message"])
    traces = found.where("_first IS NOT NULL").groupBy("_h1", "_h2", "_first").agg(
        # Only the fragment with the first line has the fields.
        F.max_by(own, F.when(F.col("seq").isNotNull(), 1).otherwise(0)).alias("own"),
        F.array_join(F.sort_array(F.collect_list(F.struct("_piece", "message")))["message"], "\n").alias("message"),
    )
    joined = traces.select(*[F.col("message") if c == "message" else F.col("own").getField(c).alias(c) for c in fields])
    return found.where("_first IS NULL").select(*fields).unionByName(joined)
