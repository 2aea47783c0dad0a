import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from helpers import at, lines
from test_stitch import JAVA, PY, sequential
from tallywind.operators import aggregate as A
from tallywind.operators.bins import BinSpec, binned_by
from tallywind.operators.statsd import parse_statsd
from tallywind.operators import report
from tallywind.sinks import bulk
from tallywind.sinks.line_protocol import to_line_protocol
from tallywind.streaming import fanout, progress, stateful, windows


def as_stream(spark, batches):
    """Each frame becomes one file, read in order, one per micro-batch."""
    import os

    folder = tempfile.mkdtemp(prefix="stream-")
    schema = batches[0].schema
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.startswith("part-") and not name.startswith("part-used"):
                path = os.path.join(folder, name)
                os.utime(path, (1_600_000_000 + i * 10, 1_600_000_000 + i * 10)) if os.stat(path).st_mtime > 1_700_000_000 else None
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_family(spark, samples, family, delay=5.0):
    out = tempfile.mkdtemp(prefix="out-")
    query = windows.start_windows(samples, family, delay, tempfile.mkdtemp(prefix="cp-"), windows.parquet_sink(out))
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def canonical(df):
    cols = sorted(df.columns)
    rows = []
    for r in df.select(*cols).collect():
        rows.append(tuple(
            tuple(sorted(r[c].items())) if c == "tags" else round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols
        ))
    return sorted(rows, key=repr)


def text_lines(n, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = rng.choice(["hot", "hot", "a", "b"])
        kind = rng.choice(["c", "c|@0.5", "g", "s", "ms", "h"])
        sign = rng.choice(["", "+", "-"]) if kind == "g" else ""
        tag = rng.choice(["", "|#t=x", "|#t=y,timestamp=%d" % (1000 + i // 20)])
        out.append(f"{name}:{sign}{rng.randint(1, 30)}|{kind}{tag}")
    return out


def test_stream_equals_batch(spark):
    parts = [lines(spark, text_lines(400, i), ts=1000.0 + 20 * i, step=0.05).withColumn("seq", F.col("seq") + 1000 * i) for i in range(3)]
    closing = spark.createDataFrame([(99999, at(5000.0), "z:1|c"), (99999, at(5000.0), "z:1|g")], "seq bigint, recv_ts timestamp, line string")
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    batch = parse_statsd(everything).cache()
    bins = binned_by(BinSpec([("low", 10), ("high", None)]))
    pairs = [
        (windows.counters(10), A.agg_counters(batch, 10)),
        (windows.gauges(10), A.agg_gauges(batch, 10)),
        (windows.sets(10), A.agg_sets(batch, 10)),
        (windows.timers([50, 90, 100], 10), A.agg_timers(batch, [50, 90, 100], 10)),
        (windows.histograms(bins, 10), A.agg_histograms(batch, bins, 10)),
    ]
    for family, want in pairs:
        samples = parse_statsd(as_stream(spark, [*parts, closing]))
        assert canonical(run_family(spark, samples, family)) == canonical(want)


def collect_stream(df, name):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", tempfile.mkdtemp(prefix="cp-")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_latest_with_ttl(spark):
    schema = "series string, line string, recv_ts timestamp, seq bigint"
    batches = [
        spark.createDataFrame([("a", "a 1", at(1.0), 1), ("a", "a 2", at(2.0), 2), ("b", "b 1", at(1.0), 3)], schema),
        spark.createDataFrame([("a", "a late", at(1.5), 4), ("c", "c 1", at(3.5), 5)], schema),
        spark.createDataFrame([("d", "d 1", at(100.0), 6)], schema),
    ]
    out = collect_stream(stateful.latest_lines(as_stream(spark, batches), ttl=2.0, delay=0.0), "latest_page").collect()
    got = [(r["series"], r["line"], r["event"]) for r in out]
    assert ("a", "a 2", "set") in got and ("b", "b 1", "set") in got and ("d", "d 1", "set") in got
    assert ("a", "a late", "set") not in got
    assert {("a", "a 2", "drop"), ("b", "b 1", "drop"), ("c", "c 1", "drop")} <= set(got)
    assert ("d", "d 1", "drop") not in got


def test_stitch_stream(spark):
    rows = [(i, "p", i * 0.1, m, 6) for i, m in enumerate(["x", *PY, "plain", "plain", *JAVA, "done", "done"])]
    df = spark.createDataFrame(rows, "seq bigint, pid string, ts double, message string, level int")
    stream = as_stream(spark, [df.where("seq < 4"), df.where("seq >= 4 and seq < 15"), df.where("seq >= 15")])
    # Timers on processing time keep the query busy for ever, so it is stopped once all is out.
    query = (
        stateful.stitch_stream(stream).writeStream.format("memory").queryName("stitched")
        .option("checkpointLocation", tempfile.mkdtemp(prefix="cp-")).start()
    )
    want = sequential(rows)
    try:
        deadline = time.time() + 90
        while spark.table("stitched").count() < len(want) and time.time() < deadline and query.isActive:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted((r["pid"], r["seq"], r["message"]) for r in spark.table("stitched").collect()) == want


def test_stitch_stream_on_arrival_time(spark):
    rows = [(i, "p", i * 0.1, m, 6, at(i * 0.1 + 0.000001)) for i, m in enumerate(["x", *PY, "plain", *JAVA])]
    end = spark.createDataFrame([(99, "end", 1e6, "end", 6, at(1e6))], "seq bigint, pid string, ts double, message string, level int, recv_ts timestamp")
    df = spark.createDataFrame(rows, end.schema)
    stream = as_stream(spark, [df.where("seq < 4"), df.where("seq >= 4"), end])
    out = collect_stream(stateful.stitch_stream(stream, trace_level=3), "stitched_by_arrival").where("pid = 'p'").collect()
    assert sorted((r["pid"], r["seq"], r["message"]) for r in out) == sequential([r[:5] for r in rows])
    assert {r["level"] for r in out if "\n" in r["message"]} == {3} and {r["level"] for r in out if "\n" not in r["message"]} == {6}
    assert {r["recv_ts"].microsecond % 10 for r in out} == {1}


def test_fanout(spark):
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "source string, v int")
    got = {"d1": [], "d2": []}
    sinks = {name: (lambda rows, _, name=name: got[name].extend(r["v"] for r in rows.collect())) for name in got}
    query = fanout.start_fanout(as_stream(spark, [df]), {"s1": ["d1"], "s2": ["d1", "d2"]}, sinks, tempfile.mkdtemp(prefix="cp-"))
    query.awaitTermination()
    assert sorted(got["d1"]) == [1, 2] and got["d2"] == [2]
    with pytest.raises(ValueError):
        fanout.start_fanout(df, {"s1": ["nope"]}, sinks, "x")


def test_lines_that_come_late_or_in_other_batches(spark, monkeypatch):
    """Lines of one stream shuffled over micro-batches come out as from one automaton, with blocks of a few lines in state."""
    monkeypatch.setattr(stateful, "BLOCK", 4)
    rows = [(i, "p", i * 0.1, m, 6, at(i * 0.1 + 1)) for i, m in enumerate(["x", *PY, "plain", *JAVA, "y", *PY, "z"])]
    end = spark.createDataFrame([(999, "end", 1e6, "end", 6, at(1e6))], "seq bigint, pid string, ts double, message string, level int, recv_ts timestamp")
    near = rows[:]
    rng = random.Random(4)
    for i in range(0, len(near) - 5, 5):
        part = near[i : i + 5]
        rng.shuffle(part)
        near[i : i + 5] = part
    batches = [spark.createDataFrame(near[i : i + 7], end.schema) for i in range(0, len(near), 7)]
    out = collect_stream(stateful.stitch_stream(as_stream(spark, [*batches, end]), delay=1.0), "stitched_late").where("pid = 'p'").collect()
    assert sorted((r["pid"], r["seq"], r["message"]) for r in out) == sequential([r[:5] for r in rows])


def test_stream_lines_pass_beside_the_automaton(spark):
    rows = [(i, "p", i * 0.1, m, i % 3 == 1, at(i * 0.1 + 1)) for i, m in enumerate(["x", *PY, "y"])] + [(99, "end", 1e6, "end", False, at(1e6))]
    df = spark.createDataFrame(rows, "seq bigint, pid string, ts double, message string, aside boolean, recv_ts timestamp")
    out = collect_stream(stateful.stitch_stream(as_stream(spark, [df.where("seq < 99"), df.where("seq = 99")]), bypass="aside"), "stitched_beside")
    got = sorted((r["pid"], r["seq"], r["message"]) for r in out.where("pid = 'p'").collect())
    want = sequential([(*r[:4], 6) for r in rows if not r[4] and r[1] == "p"]) + [(r[1], r[0], r[3]) for r in rows if r[4]]
    assert got == sorted(want)


def test_gauges_that_come_late(spark, monkeypatch):
    """Within the delay order of arrival in the source counts, not the batch that a sample came in."""
    monkeypatch.setattr(stateful, "BLOCK", 8)
    rng = random.Random(6)
    texts = [f"{rng.choice('ab')}:{rng.choice(['', '+', '-'])}{rng.randint(1, 50)}|g" for _ in range(120)]
    everything = lines(spark, texts, ts=1000.0, step=0.2)
    order = list(range(120))
    for i in range(0, 120, 6):
        part = order[i : i + 6]
        rng.shuffle(part)
        order[i : i + 6] = part
    rows = {r["seq"]: r for r in everything.collect()}
    batches = [spark.createDataFrame([rows[k] for k in order[i : i + 25]], everything.schema) for i in range(0, 120, 25)]
    closing = spark.createDataFrame([(99999, at(5000.0), "z:1|g")], "seq bigint, recv_ts timestamp, line string")
    got = run_family(spark, parse_statsd(as_stream(spark, [*batches, closing])), windows.gauges(10))
    assert canonical(got) == canonical(A.agg_gauges(parse_statsd(everything), 10))


def test_sketched_sets(spark):
    texts = [f"users:u{i}|s" for i in range(20000)] + ["few:a|s", "few:b|s", "few:a|s"]
    samples = parse_statsd(lines(spark, texts))
    got = {r["tags"]["name"]: r["count"] for r in A.agg_sets(samples, 10, approx=True).collect()}
    assert got["few"] == 2
    # Four standard errors of 1.04 / sqrt(2^12).
    assert abs(got["users"] - 20000) < 4 * 1.04 / 64 * 20000
    closing = spark.createDataFrame([(99999, at(5000.0), "z:1|s")], "seq bigint, recv_ts timestamp, line string")
    parts = [lines(spark, texts[:9000]), lines(spark, texts[8000:])]
    stream = run_family(spark, parse_statsd(as_stream(spark, [*parts, closing])), windows.sets(10, approx=True))
    found = {r["tags"]["name"]: r["count"] for r in stream.collect()}
    assert found["few"] == 2 and abs(found["users"] - 20000) < 4 * 1.04 / 64 * 20000


def test_bulk_delivered_twice(spark):
    schema = "index string, id string, doc string, action string, recv_ts timestamp"
    rows = [("i", str(k), "d", "a", at(100.0 + k)) for k in range(6)]
    batches = [spark.createDataFrame(rows[:4], schema), spark.createDataFrame(rows[2:] + rows[:1], schema), spark.createDataFrame(rows, schema)]
    out = collect_stream(bulk.dedupe_bulk(as_stream(spark, batches), 60.0), "bulk_once").collect()
    assert sorted(r["id"] for r in out) == ["0", "1", "2", "3", "4", "5"]
    with pytest.raises(ValueError):
        bulk.dedupe_bulk(as_stream(spark, batches))


def test_counts_of_batches_while_they_run(spark):
    seen = []
    listener = progress.BatchCounters("rows", lambda *counts: seen.append(counts))
    spark.streams.addListener(listener)
    try:
        batches = [spark.range(10).withColumn("n", F.lit(1)), spark.range(7).withColumn("n", F.lit(2))]
        counted, _ = report.observed(as_stream(spark, batches), "rows", dropped=F.col("id") < 3, failed=F.lit(False))
        collect_stream(counted, "counted")
        deadline = time.time() + 30
        while len(seen) < 2 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [(query, batch, counts) for query, batch, _, counts in seen] == [
        ("counted", 0, {"rows": 10, "dropped": 3, "failed": 0}), ("counted", 1, {"rows": 7, "dropped": 3, "failed": 0})]
    texts = [r["line"] for r in to_line_protocol(progress.count_rows(spark, seen)).collect()]
    assert any(t.startswith("pipeline,batch=1,query=counted dropped=3,failed=0,rows=7 ") for t in texts)


def test_gauges_on_streams_are_native_and_series_share_a_bucket(spark):
    """Nothing of a gauge stream runs in Python, parts and blocks of any size give the batch result; many series go through one call."""
    texts = [f"g{i % 3}:{['', '+', '-'][i % 7 % 3]}{i}|g" for i in range(90)]
    everything = lines(spark, texts, ts=1000.0, step=0.3).repartition(3)
    closing = spark.createDataFrame([(99999, at(5000.0), "z:1|g"), (None, at(5000.0), "z:1|g")], "seq bigint, recv_ts timestamp, line string")
    want = canonical(A.agg_gauges(parse_statsd(everything), 10))
    for parts, block in ((16, 1 << 16), (3, 4), (1, 1)):
        family = windows.Family(lambda s: stateful.gauge_parts(s, 10, parts, block), lambda p: A.finish_gauges(p))
        assert canonical(run_family(spark, parse_statsd(as_stream(spark, [everything, closing])), family)) == want
    keyed = [(f"s{i}", f"s{i} {i}", at(1.0 + i % 5), i) for i in range(50)]
    batches = [spark.createDataFrame(r, "series string, line string, recv_ts timestamp, seq bigint") for r in (keyed, [("end", "end", at(4.5 + 5), 99)])]
    changes = collect_stream(stateful.latest_lines(as_stream(spark, batches), ttl=6.0, buckets=2), "latest_buckets").collect()
    assert sorted(r["series"] for r in changes if r["event"] == "set") == sorted([k[0] for k in keyed] + ["end"])
    assert sorted(r["series"] for r in changes if r["event"] == "drop") == sorted(k[0] for k in keyed if k[3] % 5 < 3)
