import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import at, lines
from tallywind.operators import logs, report
from tallywind.operators.enrich import _READ
from tallywind.plans import flows
from tallywind.sources import journal
from tallywind.sources.json_events import is_flat_object, parse_json_events


def plain(values):
    return {k: _READ[v["t"]](v["v"]) for k, v in values.items()}


def scalar(rng):
    return rng.choice([
        None, True, False, rng.randint(-(10**20), 10**20), rng.uniform(-1e6, 1e6), 10 ** rng.uniform(-30, 30), 0, -0.0,
        "".join(rng.choice("ab\"\\/\n\té😀{}[]:, ") for _ in range(rng.randint(0, 12))), float("inf"), float("-inf"),
    ])


def test_random_objects_against_stdlib(spark):
    rng = random.Random(5)
    texts = []
    for i in range(1500):
        obj = {"".join(rng.choice('abcé"') for _ in range(rng.randint(0, 3))): scalar(rng) for _ in range(rng.randint(0, 6))}
        t = json.dumps(obj, ensure_ascii=rng.random() < 0.5, separators=rng.choice([(",", ":"), (", ", ": "), (" ,\t", " : ")]))
        if rng.random() < 0.4 and t:  # damage some
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(['"', "{", "}", ",", "\\", "x", "1", "", "[1]"]) + t[k + rng.randint(0, 1):]
        if "\n" not in t:
            texts.append(t.strip())
    texts += ['{"a":1,"a":"x"}', '{"a":1} x', '{"a":[1]}', '{"a":{"b":1}}', "{}", "[1]", "word", '{"a":01}', '{"a":1.}', '{"a":-0}',
              '{"a":"' + "x" * 60000 + '"}', '{"a":"' + "\\n" * 20000 + '"}']
    got = {r["seq"]: plain(r["values"]) for r in parse_json_events(lines(spark, texts)).collect()}
    for i, t in enumerate(texts):
        try:
            obj = json.loads(t)
        except ValueError:
            obj = None
        if not isinstance(obj, dict) or not obj or any(isinstance(v, (dict, list)) for v in obj.values()):
            assert i not in got, t[:200]
        elif "timestamp" not in obj and not any("\ud800" <= c <= "\udfff" for v in obj.values() for c in str(v)):
            assert {k: repr(v) for k, v in got[i].items()} == {k: repr(v) for k, v in obj.items()}, t[:200]


def test_event_times(spark):
    values = ["1000", "999.5", '"1600"', "1601", "399", "null", '"x"', "true", "NaN", "0"]
    df = parse_json_events(lines(spark, [f'{{"a":1,"timestamp":{v}}}' for v in values] + ['{"a":1}'], ts=1000.0))
    got = {r["seq"]: r for r in df.collect()}
    assert sorted(got) == [0, 1, 2, 10]
    assert [got[i]["ts"] for i in (0, 1, 2, 10)] == [1000.0, 999.5, 1600.0, 1000.0]
    assert got[0]["bucket"] == "metrics" and plain(got[0]["values"]) == {"a": 1}
    millis = parse_json_events(lines(spark, ['{"timestamp":3000000123,"a":1}', '{"timestamp":0,"a":1}'], ts=3000000.0)).collect()
    assert [r["ts"] for r in millis] == [3000000.123]
    zero = parse_json_events(lines(spark, ['{"timestamp":0,"a":1}'], ts=5.0)).first()
    assert zero["ts"] == 5.0


def raw_journal(spark, rows):
    names = [c.split("`")[1] for c in journal.JOURNAL_SCHEMA.split(", ")]
    data = [tuple(r.get(n) for n in names) + (at(1000.0), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, journal.JOURNAL_SCHEMA + ", recv_ts timestamp, seq bigint")


def test_journal_fields(spark):
    rows = [
        {"MESSAGE": "hello  \n", "PRIORITY": "3", "SYSLOG_FACILITY": "3", "_PID": "12", "_EXE": "/bin/x",
         "_SOURCE_REALTIME_TIMESTAMP": "5000000", "__REALTIME_TIMESTAMP": "6000000"},
        {"MESSAGE": " \t", "PRIORITY": "3"},
        {"MESSAGE": "debug", "PRIORITY": "7"},
        {"MESSAGE": "none", "SYSLOG_FACILITY": "DHCP4", "__REALTIME_TIMESTAMP": "6000000"},
        {"MESSAGE": "bare"},
    ]
    got = {r["seq"]: r for r in journal.map_journal_fields(raw_journal(spark, rows)).collect()}
    assert sorted(got) == [0, 3, 4]
    assert (got[0]["message"], got[0]["level"], got[0]["facility"], got[0]["ts"]) == ("hello", 3, "daemon", 5.0)
    assert (got[3]["level"], got[3]["facility"], got[3]["ts"]) == (6, "user", 6.0)
    assert (got[4]["facility"], got[4]["ts"]) == (None, 1000.0)
    out = {r["seq"]: r for r in logs.log_rows(journal.map_journal_fields(raw_journal(spark, rows))).collect()}
    assert plain(out[0]["values"]) == {"message": "hello", "command": "/bin/x", "pid": 12, "level": "error", "facility": "daemon"}
    assert out[0]["bucket"] == "logs"


def test_levels_and_facilities(spark):
    df = spark.range(0, 12).select("id", journal.level_name(F.col("id").cast("int")).alias("l"))
    words = {r["id"]: r["l"] for r in df.collect()}
    assert [words[i] for i in range(8)] == ["critical"] * 3 + ["error", "warning", "info", "info", "debug"]
    codes = [None, "0", "3", "4", "5", "6", "9", "10", "1", "x", "24", "80"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    row = [(r["a"], r["b"]) for r in df.select(
        journal.facility_name(F.col("c")).alias("a"), journal.facility_name(F.col("c"), literal=True).alias("b")).collect()]
    assert [a for a, _ in row] == [None, "kernel", "daemon", "auth", "daemon", "daemon", "daemon", "auth", "user", "user", "user", "user"]
    assert [b for _, b in row] == [None, "kernel"] + ["user"] * 8 + ["daemon", "auth"]


def test_json_messages(spark):
    rows = [
        {"MESSAGE": ' {"pid":5,"new":1.5,"message":"inner"}', "_PID": "12"}, {"MESSAGE": '{"a":[1]}'}, {"MESSAGE": "{}"},
        {"MESSAGE": "text"}, {"MESSAGE": '{"level":"x","b":null}'},
    ]
    df = logs.decode_json_message(journal.map_journal_fields(raw_journal(spark, rows)))
    out = {r["seq"]: plain(r["values"]) for r in logs.log_rows(df).collect()}
    assert out[0] == {"pid": 12, "new": 1.5, "message": "inner", "level": "info"}
    assert out[1]["message"] == '{"a":[1]}' and out[2]["message"] == "{}" and out[3]["message"] == "text"
    assert out[4] == {"level": "info", "b": None}


def test_names_of_fields(spark):
    rows = [("hello", "3", "4"), ('{"level": 1, "severity": 2, "facility": "x"}', "6", None)]
    raw = spark.createDataFrame(rows, "MESSAGE string, PRIORITY string, SYSLOG_FACILITY string")
    for name in set(journal.FIELDS) | {"_SOURCE_REALTIME_TIMESTAMP", "__REALTIME_TIMESTAMP"}:
        raw = raw if name in raw.columns else raw.withColumn(name, F.lit(None).cast("string"))
    raw = raw.withColumn("seq", F.monotonically_increasing_id()).withColumn("recv_ts", F.lit(at(5.0)))
    got = flows.journal_rows(raw, decode_json=True, names={"level": "severity", "facility": None}).collect()
    values = sorted(({k: v["v"] for k, v in r["values"].items()} for r in got), key=len)
    assert values == [{"message": "hello", "severity": "error"}, {"level": "1", "facility": "x", "severity": "info"}]


def test_counter_rows(spark):
    df = spark.createDataFrame([(at(1.0), "a", True), (at(2.0), "a", None), (at(11.0), None, False)], "recv_ts timestamp, host string, bad boolean")
    rows = report.counter_rows(df, 10.0, tags={"host": F.col("host")}, rejected=F.col("bad")).collect()
    got = sorted((r["ts"], r["tags"], {k: v["v"] for k, v in r["values"].items()}) for r in rows)
    assert got == [(10.0, {"host": "a"}, {"received": "2", "rejected": "1"}), (20.0, {}, {"received": "1", "rejected": "0"})]
    assert report.counter_rows(df.limit(0), 10.0).count() == 0


def test_since(spark):
    df = spark.createDataFrame([(at(t),) for t in (900.0, 940.0, 1000.0, 1001.0)], "ts timestamp")
    now = F.lit(at(1000.0))
    assert journal.since(df, now, 60).count() == 3
    assert journal.since(df, now, 0).count() == 2


def test_journal_files(spark, tmp_path):
    path = tmp_path / "j.json"
    path.write_text(json.dumps({"MESSAGE": "m", "PRIORITY": "3", "_PID": "1", "OTHER": "x"}) + "\n")
    raw = journal.read_journal(spark, str(path)).withColumn("seq", F.lit(1)).withColumn("recv_ts", F.lit(at(5.0)))
    assert journal.map_journal_fields(raw).first()["message"] == "m"
