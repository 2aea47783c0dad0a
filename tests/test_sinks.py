import json
import math
import random
import struct
import uuid

from pyspark.sql import functions as F

from helpers import at, lines
from tallywind.functions import maps, text
from tallywind.operators import enrich
from tallywind.sinks import bulk, exposition, line_protocol


def metric_rows(spark, rows):
    """(recv, bucket, values, ts, tags) with Python scalars."""
    data = [
        (b, {k: enrich._write(v) for k, v in values.items()}, ts, tags, at(recv), i)
        for i, (recv, b, values, ts, tags) in enumerate(rows)
    ]
    return spark.createDataFrame(data, enrich.METRIC_SCHEMA + ", recv_ts timestamp, seq bigint")


def test_float_text_equals_repr(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, 100.0, 1e7, 1e15, 1e16, 1e-4, 1e-5, 123456789.125, 1e22, 1.7976931348623157e308, 0.1, -2.5e-7]
    values += [rng.choice([-1, 1]) * 10 ** rng.uniform(-20, 20) for _ in range(1000)]
    values += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(500)]
    values = [v for v in values if not math.isnan(v)] + [float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["t"] for r in df.select("i", text.float_text(F.col("v")).alias("t")).collect()}
    assert [got[i] for i in range(len(values))] == [repr(v) for v in values]


def test_parse_float_equals_python(spark):
    texts = ["1", "+1", "-1.5", ".5", "5.", "1e5", "1E-5", "1_0", "1__0", "_1", "1_", "1_.5", "inf", "-Infinity", "nan", "+nan", "-NaN",
             "1d", "1.0f", "0x10", "", " 1 ", "１", "1e", "e5", ".", "+-1", "1 2", "infinit", "1_0.2_5e1_0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", text.parse_float(F.col("t")).alias("v")).collect():
        try:
            want = float(r["t"])
        except ValueError:
            want = None
        if r["t"] == "１":  # other digits than ASCII are not accepted
            want = None
        assert (r["v"] is None) == (want is None), r
        assert want is None or r["v"] == want or (math.isnan(r["v"]) and math.isnan(want)), r


def test_json_string_and_uuid(spark):
    texts = ["plain", 'q"uo\\te', "é", "日本", "😀", "\n\r\t\b\f\x01\x1f\x7f", "mixed é \"\\ \n", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", text.json_string(F.col("t")).alias("j"), text.name_uuid(F.col("t")).alias("u")).collect():
        assert r["j"] == json.dumps(r["t"])
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["t"]))


def test_static_tags_and_redirect(spark):
    df = metric_rows(spark, [(1, "b", {"x": 1}, None, {"a": "own", "bucket": "other"}), (1, "b", {"x": 1}, 1.0, None)])
    got = enrich.finish_rows(df, {"a": "static", "host": "h"}).orderBy("seq").collect()
    assert (got[0]["bucket"], got[0]["tags"]) == ("other", {"a": "own", "host": "h"})
    assert (got[1]["bucket"], got[1]["tags"]) == ("b", {"a": "static", "host": "h"})
    got = enrich.finish_rows(df, {"bucket": "conf"}).orderBy("seq").collect()
    assert [r["bucket"] for r in got] == ["other", "conf"] and got[1]["tags"] == {}


def test_hooks(spark):
    df = metric_rows(spark, [(1, "b", {"x": 1, "f": 2.5, "s": "t", "n": None, "o": True}, None, {"a": "1"}), (1, "drop", {"x": 1}, 1.0, {})])

    def hook(bucket, values, ts, tags):
        if bucket == "drop":
            return None
        assert values == {"x": 1, "f": 2.5, "s": "t", "n": None, "o": True} and ts is None
        return bucket + "2", {"x": values["x"] + 1, "f": 1e16}, 5.0, {**tags, "new": "y"}

    (row,) = enrich.finish_rows(df, {"host": "h"}, enrich.row_hook(hook)).collect()
    assert (row["bucket"], row["ts"], row["tags"]) == ("b2", 5.0, {"a": "1", "host": "h", "new": "y"})
    assert {k: (v["t"], v["v"]) for k, v in row["values"].items()} == {"x": ("int", "2"), "f": ("float", "1e+16")}
    assert enrich.finish_rows(df, hook=lambda d: d.where("bucket != 'drop'")).count() == 1


def test_routes(spark):
    import pytest

    table = enrich.routes({"s1": ["d2"], "s2": None}, ["d1", "d2"])
    df = spark.createDataFrame([("s1",), ("s2",), ("s3",), (None,)], "source string")
    got = sorted((str(r["source"]), r["destination"]) for r in enrich.route(df, table, ["d1", "d2"]).collect())
    assert got == [("None", "d1"), ("None", "d2"), ("s1", "d2"), ("s2", "d1"), ("s2", "d2"), ("s3", "d1"), ("s3", "d2")]
    with pytest.raises(ValueError):
        enrich.routes({"s1": ["nope"]}, ["d1"])


def test_exposition_ttl(spark):
    # Series of one bucket age on their own: a row renews only the fields and tags that it has.
    rows = [
        (10, "disk", {"free": 70, "used": 30}, None, {"path": "/"}), (10, "disk", {"free": 5}, None, {"path": "/tmp"}),
        (16, "disk", {"used": 31, "inodes": 9}, None, {"path": "/"}), (13, "up", {"seconds": 400}, None, {}),
    ]
    df = metric_rows(spark, rows)
    last_seen = {
        'disk{path="/",value="free"} 70': 10, 'disk{path="/",value="used"} 31': 16, 'disk{path="/",value="inodes"} 9': 16,
        'disk{path="/tmp",value="free"} 5': 10, 'up{value="seconds"} 400': 13,
    }
    for now in (16, 17, 18, 20, 23, 24):
        got = {r["line"] for r in exposition.to_exposition(df, F.lit(float(now)), 7.0).collect()}
        assert got == {line for line, seen in last_seen.items() if now - seen <= 7}, now


def test_exposition_text(spark, tmp_path):
    rows = [
        (1, "b", {"f": 100.0, "t": True, "s": "no", "n": None}, 1.5, {"value": "gone", "q": 'a"b\\c'}),
        (1, "b", {"f": 1e16}, 2.0005, {"q": 'a"b\\c'}),
    ]
    df = metric_rows(spark, rows)
    assert {r["line"] for r in exposition.to_exposition(df).collect()} == {
        r'b{q="a\"b\\c",value="f"} 1e+16 2000', r'b{q="a\"b\\c",value="t"} 1 1500',
    }
    path = str(tmp_path / "out")
    exposition.write_exposition(df, path, compression="gzip")
    assert spark.read.text(path).count() == 2


def test_line_protocol(spark):
    # Per row: time, fields, tags, and the line.
    cases = [
        (0.5, {"used": 31, "free": 0.25}, {}, "disk free=0.25,used=31 500000000"),
        (2.0, {"n": -1}, {"zone": "eu", "path": "/var/log", "Host": "h1"}, "disk,Host=h1,path=/var/log,zone=eu n=-1 2000000000"),
        (None, {"ok": False, "why": 'a "full" disk', "gone": None}, {"empty": "", "mark": "x=1, y", "lost": None}, None),
        (3.0, {"gone": None}, {"zone": "eu"}, ""),
        (1650000000.625, {"n": 1}, {}, "disk n=1 " + str(int(1650000000.625 * 1000000000))),  # the product is a double
    ]
    rows = [(1, "disk", fields, ts, tags) for ts, fields, tags, _ in cases]
    got = [r["line"] for r in line_protocol.to_line_protocol(metric_rows(spark, rows)).orderBy("seq").collect()]
    quoted = r'disk,mark=x\=1\,\ y ok=False,why="a \"full\" disk"'  # no time; blanks, commas and equals signs of tags are escaped
    assert got == [quoted if line is None else line for *_, line in cases if line != ""]


def expected_doc(recv, bucket, values, ts, tags, static):
    doc = {**static, **tags, **values, "timestamp": round((ts or recv) * 1000), "bucket": bucket}
    return json.dumps(doc, sort_keys=True, separators=(",", ":"))


def test_bulk(spark):
    static = {"dc": "x", "a": "static"}
    rows = [
        (7, "b", {"x": 1, "f": 0.1, "s": 'é"😀', "n": None, "o": False, "bucket": "lost"}, 1.5, {"a": "tag", "x": "hidden"}),
        (7, "b", {"x": float("inf"), "big": 1e16}, None, {}),
        (7, "b", {"x": 1}, 86400.0, {}), (8, "b", {"x": 1}, 86400.0, {}), (9, "", {"x": 1}, 1.0, {}),
    ]
    docs = bulk.to_bulk(metric_rows(spark, rows), static=static)
    got = docs.collect()
    assert len(got) == 4
    want = [expected_doc(*r, static) for r in rows[:4]]
    assert sorted(r["doc"] for r in got) == sorted(want)
    for r in got:
        assert r["id"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["doc"]))
        assert json.loads(r["action"]) == {"index": {"_index": "b", "_id": r["id"]}}
    assert bulk.dedupe_bulk(docs).count() == 3
    typed = bulk.to_bulk(metric_rows(spark, rows), bulk.daily_index("m"), add_type=True, bucket_field=None).collect()
    assert len(typed) == 5 and {json.loads(r["action"])["index"]["_index"] for r in typed} == {"m-1970-01-01", "m-1970-01-02"}
    assert {json.loads(r["action"])["index"]["_type"] for r in typed} == {"b", ""}


def test_maps(spark):
    df = spark.sql("select map('a','1','b','2') a, map('b','3') b, cast(null as map<string,string>) n")
    row = df.select(
        maps.merge(F.col("a"), F.col("b")).alias("m"), maps.merge(F.col("a"), F.col("n")).alias("n"),
        maps.put(F.col("a"), "a", F.lit("9")).alias("p"), maps.put_default(F.col("a"), "a", F.lit("9")).alias("d"),
        maps.tag_text(F.col("a")).alias("t"),
    ).first()
    assert (row["m"], row["n"]) == ({"a": "1", "b": "3"}, {"a": "1", "b": "2"})
    assert (row["p"]["a"], row["d"]["a"], row["t"]) == ("9", "1", "a=1,b=2")
