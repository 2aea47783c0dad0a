"""Keyed state on streams: newest line per series with a time to live, and open stack traces.

Both need the RocksDB state store (see :mod:`tallywind.session`). State is one small value per
key; the rows of a key come as an iterator of batches, so a busy key takes time but no memory.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallywind.functions.time import epoch, micros
from tallywind.operators.aggregate import gauge_rows
from tallywind.operators.stitch import GRAMMARS, STREAM_KEY, Stitcher

#: Arrival numbers of one block of held lines, and the most events of one batch that goes out.
BLOCK, OUT = 1024, 1000
LATEST_SCHEMA = "series string, line string, event string"


#: Buckets of series; those of a bucket share one value of state and one timer.
BUCKETS = 16384


class LatestLine(StatefulProcessor):
    """Emits ``set`` with the newest line of a series and ``drop`` when it has outlived its time, for all series of a bucket."""

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "lines string")

    def _load(self) -> dict:
        saved = self.newest.get()
        return {series: (recv, seq, line) for series, recv, seq, line in json.loads(saved[0])} if saved else {}

    def _due(self, recv: float) -> int:
        return int((recv + self.ttl) * 1000) + 1

    def _save(self, best: dict) -> None:
        """Keeps ``best``, with a timer for the series that ends first."""
        if best:
            self.newest.update((json.dumps([(series, *last) for series, last in best.items()]),))
        else:
            self.newest.clear()
        first = min((self._due(last[0]) for last in best.values()), default=None)
        timers = list(self.handle.listTimers())
        for timer in timers:
            if timer != first:
                self.handle.deleteTimer(timer)
        if first is not None and first not in timers:
            self.handle.registerTimer(first)

    @staticmethod
    def _changes(best: dict, names: list, event: str) -> pd.DataFrame:
        return pd.DataFrame([(name, best[name][2], event) for name in names], columns=["series", "line", "event"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self._load()
        changed = {}
        for batch in rows:
            for series, line, recv, seq in zip(batch["series"], batch["line"], batch["recv"].tolist(), batch["seq"].tolist()):
                had = best.get(series)
                if had is None or (recv, seq) > had[:2]:
                    best[series] = (recv, int(seq), line)
                    changed[series] = True
        if changed:
            self._save(best)
            yield self._changes(best, list(changed), "set")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        best = self._load()
        over = [series for series, last in best.items() if self._due(last[0]) <= now]
        self._save({series: last for series, last in best.items() if self._due(last[0]) > now})
        if over:
            yield self._changes(best, over, "drop")

    def close(self) -> None:
        pass


def latest_lines(lines: DataFrame, ttl: float, delay: float = 0.0, buckets: int = BUCKETS) -> DataFrame:
    """Changes of the exposition page: ``series, line, event`` from ``series, line, recv_ts, seq``.

    The clock is arrival time, so replays give the same page as the live stream did. Series are dealt to ``buckets`` by hash: a call
    of the processor costs as much as a thousand lines, so there is one for a bucket and not for each series.
    """
    timed = lines.withWatermark("recv_ts", f"{round(delay * 1000)} milliseconds")
    bucket = F.pmod(F.xxhash64("series"), F.lit(buckets)).alias("bucket")
    rows = timed.select(bucket, "series", "line", "recv_ts", epoch(F.col("recv_ts")).alias("recv"), "seq")
    return rows.groupBy("bucket").transformWithStateInPandas(
        LatestLine(ttl), outputStructType=LATEST_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


#: Parts of a window, which fold apart from each other, and arrival numbers that fold together.
WINDOW_PARTS, GAUGE_BLOCK = 16, 1 << 16


def _fold(samples: Column) -> Column:
    """Samples sorted by arrival number, plain ones first: the last plain value, the sum of the deltas after it, and the last sample."""
    base = F.array_max(F.filter(samples, lambda s: ~s["delta"]))
    later = F.filter(samples, lambda s: s["delta"] & (base.isNull() | (s["seq"] >= base["seq"])))
    deltas = F.aggregate(later, F.lit(0.0), lambda total, s: total + s["value"])
    last = F.get(samples, F.size(samples) - 1)
    return F.struct(
        base["seq"].alias("base_seq"), base["value"].alias("base_value"), F.when(F.size(later) > 0, deltas).alias("deltas"),
        last["seq"].alias("seq"), last["cust_ts"].alias("cust_ts"),
    )


def gauge_parts(samples: DataFrame, interval: float, parts: int = WINDOW_PARTS, block: int = GAUGE_BLOCK) -> DataFrame:
    """Streaming counterpart of the batch one: ``win, series, range`` and what the range comes down to, once the window closes.

    ``samples`` have a watermark on ``recv_ts``. Two aggregates, both of built-in expressions: samples of a series wait in blocks of
    arrival numbers until the watermark has passed their part of the window, so that late ones still find their place; then a block is
    folded, and only its fold waits for the end of the window. Parts are equal (``parts`` of them, or the next smaller number that cuts
    the window into whole microseconds); arrival numbers grow with arrival times from part to part.
    """
    rows = gauge_rows(samples, interval, "recv_ts")
    part = F.window("recv_ts", micros(interval / math.gcd(round(interval * 1000000), parts))).alias("part")
    one = F.when(F.col("seq").isNotNull(), F.struct("seq", "delta", "value", "cust_ts"))
    held = rows.groupBy(part, "series", F.floor(F.col("seq") / block).alias("block")).agg(F.collect_list(one).alias("samples"))
    fold = F.transform(F.array(F.sort_array("samples")), _fold)[0]
    folded = held.withColumn("at", F.window_time("part")).select(
        "at", "series", F.struct(F.col("part.start").alias("start"), "block", fold.alias("fold")).alias("one")
    )
    whole = folded.groupBy(F.window("at", micros(interval)).alias("win"), "series").agg(F.collect_list("one").alias("folds"))
    out = whole.select("win", "series", F.posexplode(F.sort_array("folds")).alias("range", "one"))
    return out.where("one.fold.seq IS NOT NULL").select("win", "series", F.col("range").cast("bigint").alias("range"), "one.fold.*")


class OpenTrace(StatefulProcessor):
    """One automaton per stream; an open trace is let go when its stream is silent for a second.

    Lines are held in blocks of arrival numbers and worked off in order, block by block: with ``arrival`` when the watermark of
    arrival times has passed them, so that lines which arrive late or in another batch still find their place; else, by the
    machine's clock, at the end of each micro-batch. Neither a micro-batch nor a backlog is ever in memory as a whole. Rows that are
    ``aside`` pass at once.
    """

    def __init__(self, grammars, idle_ms: int = 1000, arrival: bool = False):
        self.grammars, self.idle_ms, self.arrival = grammars, idle_ms, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "grammar int, state string, lines string, recv double")
        self.blocks = handle.getMapState("blocks", "block bigint", "lines string")

    @staticmethod
    def _frame(done: list) -> pd.DataFrame:
        return pd.DataFrame(done, columns=["event", "message"])

    def _hold(self, batch: pd.DataFrame) -> None:
        for block, own in batch.groupby(batch["seq"] // BLOCK):
            known = self.blocks.getValue((int(block),)) if self.blocks.containsKey((int(block),)) else None
            lines = json.loads(known[0]) if known else []
            lines += [[int(a), float(b), None if pd.isna(c) else float(c), d, e] for a, b, c, d, e in zip(own["seq"], own["recv"], own["ts"], own["message"], own["event"])]
            self.blocks.updateValue((int(block),), (json.dumps(lines),))

    def _work(self, due: float | None, clock: float) -> Iterator[pd.DataFrame]:
        """Feeds held lines in order up to the first one after ``due`` (ms; None: all), and sets the timer for what is left."""
        saved = self.open.get()
        machine, recv = Stitcher(self.grammars), 0.0
        if saved is not None:
            machine, recv = Stitcher(self.grammars, saved[0], saved[1], [tuple(x) for x in json.loads(saved[2])]), saved[3]
        done, wait = [], None
        for block in sorted(key[0] for key in self.blocks.keys()):
            lines = sorted(json.loads(self.blocks.getValue((block,))[0]), key=lambda line: line[0])
            for i, (_, at, ts, message, event) in enumerate(lines):
                if due is not None and at * 1000 > due:
                    wait = max(line[1] for line in lines[i:]) * 1000
                    self.blocks.updateValue((block,), (json.dumps(lines[i:]),))
                    break
                done += machine.feed((ts, message, event))
                recv = max(recv, at)
                if len(done) >= OUT:
                    yield self._frame(done)
                    done = []
            if wait is not None:
                break
            self.blocks.removeKey((block,))
        silent = (recv * 1000 if self.arrival else clock) + self.idle_ms
        if machine.size and due is not None and due > silent:
            done += machine.close()
        if machine.size:
            self.open.update((machine.grammar, machine.state, json.dumps(machine.lines), recv))
            wait = silent if wait is None else min(wait, silent)
        else:
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if wait is not None:
            self.handle.registerTimer(int(wait) + 1)
        if done:
            yield self._frame(done)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for batch in rows:
            beside = batch[batch["aside"]]
            if len(beside):
                yield self._frame([(event, message) for event, message in zip(beside["event"], beside["message"])])
            batch = batch[~batch["aside"]]
            if len(batch):
                self._hold(batch)
                newest = max(newest or 0.0, float(batch["recv"].max()))
        if newest is None:
            return
        if not self.arrival:
            yield from self._work(None, timerValues.getCurrentProcessingTimeInMs())
        elif not list(self.handle.listTimers()):
            self.handle.registerTimer(int(newest * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.arrival:
            yield from self._work(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), 0.0)
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
            yield from self._work(float(now) + self.idle_ms, now - 1)

    def close(self) -> None:
        pass


#: Times keep their microseconds in a line's state.
_JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def stitch_stream(
    events: DataFrame, key: list[str] | None = None, grammars=GRAMMARS, trace_level: int | None = None, delay: float = 0.0,
    bypass: str | None = None,
) -> DataFrame:
    """Streaming counterpart of ``stitch``: same columns, each trace as one event; ``trace_level`` replaces a trace's level.

    Events with ``recv_ts`` run on arrival time, ``delay`` seconds late at most: they come out when the watermark has passed them,
    replays give the same traces, and an end marker far ahead lets the open ones go. Others run on the machine's clock. Events
    whose boolean column ``bypass`` is true pass as they are, in the same scan.
    """
    key = [c for c in (key or STREAM_KEY) if c in events.columns]
    arrival = "recv_ts" in events.columns
    timed = events.withWatermark("recv_ts", f"{round(delay * 1000)} milliseconds") if arrival else events
    stream = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    clock = ["recv_ts", epoch(F.col("recv_ts")).alias("recv")] if arrival else [F.lit(0.0).alias("recv")]
    aside = F.lit(False) if bypass is None else F.coalesce(F.col(bypass), F.lit(False))
    event = F.to_json(F.struct(*events.columns), _JSON_TIMES).alias("event")
    rows = timed.select(stream.alias("stream"), "seq", "ts", "message", aside.alias("aside"), event, *clock)
    out = rows.groupBy("stream").transformWithStateInPandas(
        OpenTrace(tuple(grammars), arrival=arrival), outputStructType="event string, message string", outputMode="Append",
        timeMode="EventTime" if arrival else "ProcessingTime",
    )
    out = out.select(F.from_json("event", events.schema, _JSON_TIMES).alias("e"), "message")
    columns = {c: F.col("e").getField(c) for c in events.columns} | {"message": F.col("message")}
    if trace_level is not None and "level" in columns:
        columns["level"] = F.when(F.col("message") != F.col("e.message"), F.lit(trace_level)).otherwise(F.col("e.level"))
    return out.select(*[value.alias(c) for c, value in columns.items()])
