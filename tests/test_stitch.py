import random

import pytest
from pyspark.sql import functions as F

from tallywind.operators.stitch import GRAMMARS, Grammar, State, Stitcher, stitch

# A queue worker that fails while it handles a timeout; a web server with a suppressed error and a cause; a script that stops.
PY = ["Traceback (most recent call last):"]
PY += [f'  File "/srv/queue/{name}.py", line {line}, in {name}' for name, line in (("take", 88), ("lease", 41))]
PY += ["TimeoutError: no lease within 30 s", "During handling of the above exception, another exception occurred:"]
PY += ["Traceback (most recent call last):", '  File "/srv/queue/main.py", line 7, in main', "    worker.run(forever=True)", "queue.Closed: stop"]
JAVA = ['Exception in thread "pool-3" shop.cart.TotalException: negative total -4']
JAVA += [f"\tat shop.cart.{call}" for call in ("Total.check(Total.java:61)", "Cart$Lines.sum(Cart.java:207)", "Server.lambda$0(Server.java)")]
JAVA += ["\tSuppressed: java.io.IOException: audit log is full", "\t\tat shop.audit.Log.write(Log.java:19)", "\t\t... 12 more"]
JAVA += ["Caused by: shop.rate.MissingRate: EUR to CHF", "\tat shop.rate.Table.find(Table.java:5)", "\t... 9 more"]
NODE = ["/opt/feed/lib/merge.js:132", "  return left.items.concat(right.items);", "              ^"]
NODE += ["TypeError: left.items is undefined"] + [f"    at {call}" for call in ("merge (/opt/feed/lib/merge.js:132:15)", "async Promise.all (index 2)")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, pid string, ts double, message string, level int")


def run(spark, rows, **kw):
    out = stitch(frame(spark, rows), **kw).collect()
    return sorted((r["pid"], r["seq"], r["message"]) for r in out)


def sequential(rows):
    """The whole stream through one automaton, no islands."""
    machines, out = {}, []
    for row in sorted(rows):
        machine = machines.setdefault(row[1], Stitcher(GRAMMARS))
        out += machine.feed((row[2], row[3], row))
    for machine in machines.values():
        out += machine.close()
    return sorted((row[1], row[0], message) for row, message in out)


def feed_all(lines, step=0.1):
    return sequential([(i, "1", i * step, m, 6) for i, m in enumerate(lines)])


@pytest.mark.parametrize("trace", [PY, JAVA, NODE])
def test_one_trace(spark, trace):
    lines = ["before", *trace, "after it", "more"]
    if trace is PY:
        lines.insert(-2, "plain after the error line")
    rows = [(i, "1", i * 0.1, m, 6) for i, m in enumerate(lines)]
    messages = [m for _, _, m in run(spark, rows)]
    assert "\n".join(trace) in messages
    assert messages == [m for _, _, m in sequential(rows)]


def test_gap_splits(spark):
    rows = [(i, "1", float(i) if i < 2 else i + 5.0, m, 6) for i, m in enumerate(PY)]
    messages = [m for _, _, m in run(spark, rows)]
    assert messages[0] == "\n".join(PY[:2]) and messages[1] == PY[2]


def test_interleaved_streams_and_level(spark):
    rows = []
    for i, (a, b) in enumerate(zip(PY, JAVA)):
        rows += [(2 * i, "a", i * 0.1, a, 6), (2 * i + 1, "b", i * 0.1, b, 6)]
    out = {r["pid"]: r for r in stitch(frame(spark, rows), trace_level=3).collect()}
    assert out["a"]["message"] == "\n".join(PY) and out["b"]["message"] == "\n".join(JAVA[: len(PY)])
    assert out["a"]["level"] == 3 and out["a"]["seq"] == 0


@pytest.mark.parametrize("range_rows", [3, 1 << 20])
def test_bypass(spark, range_rows):
    rows = [(2 * i, "p", i * 0.1, m, 6) for i, m in enumerate([*PY, "plain", *NODE])]
    aside = [(2 * i + 1, "p", 500.0, None if i % 2 else PY[0], 6) for i in range(len(rows))]
    df = frame(spark, rows + aside).withColumn("aside", F.col("seq") % 2 == 1).withColumn("extra", F.create_map(F.lit("k"), F.lit("v")))
    out = stitch(df, range_rows=range_rows, bypass="aside").collect()
    assert sorted((r["pid"], r["seq"], r["message"]) for r in out if not r["aside"]) == sequential(rows)
    assert sorted((r["seq"], r["message"] or "") for r in out if r["aside"]) == [(r[0], r[3] or "") for r in aside]
    assert all(r["extra"] == {"k": "v"} for r in out)


def test_false_starts():
    assert [m for _, _, m in feed_all(["Traceback (most recent call last):", "nothing", "x"])] == [
        "Traceback (most recent call last):", "nothing", "x"]
    # A false start of two lines, the second of which starts a real trace.
    got = feed_all(["/a/b:1", "/c/d:2", "    code", "    ^", "Err: x", "    at y"])
    assert [m for _, _, m in got] == ["/a/b:1", "/c/d:2\n    code\n    ^\nErr: x\n    at y"]
    # Cancelled with more than three lines: one event, the odd line apart.
    got = feed_all([*PY[:2], PY[1], PY[1], "\tnot a frame"])
    assert [m for _, _, m in got] == ["\n".join([*PY[:2], PY[1], PY[1]]), "\tnot a frame"]


def test_long_trace_keeps_newest(spark):
    lines = ["A.b: x"] + [f"\tat f{i}" for i in range(1200)]
    rows = [(i, "1", i * 1e-4, m, 6) for i, m in enumerate(lines)]
    (whole,) = run(spark, rows)
    assert whole[2].split("\n") == lines
    (got,) = run(spark, rows, max_lines=1000)
    # 1001 lines shrink to 500, then 200 more arrive.
    assert got[2].split("\n") == lines[501:]


POOL = PY + JAVA + NODE + ["plain", "plain text", "2024 numbers", "Name: value", "  indented", "", "    four", "\t^", "a.b.C: y", "/x:1"]


@pytest.mark.parametrize("range_rows", [1 << 20, 40, 2])
def test_islands_and_slices_equal_one_automaton(spark, range_rows):
    rng = random.Random(11)
    rows, seq = [], 0
    clock = {"hot": 0.0, "b": 0.0, "c": 0.0}
    for _ in range(900):
        pid = rng.choice(["hot", "hot", "hot", "b", "c"])
        block = rng.choice([PY, JAVA, NODE, ["plain"] * rng.randint(1, 6), [rng.choice(POOL) for _ in range(rng.randint(1, 6))]])
        for m in block:
            if rng.random() < 0.97 and m:
                clock[pid] += rng.choice([0.0, 0.1, 0.9, 1.0, 1.0 if rng.random() < 0.9 else 3.0]) if rng.random() < 0.99 else -0.5
                rows.append((seq, pid, round(clock[pid], 3), m, 6))
                seq += rng.randint(1, 3)
    assert run(spark, rows, range_rows=range_rows) == sequential(rows)
