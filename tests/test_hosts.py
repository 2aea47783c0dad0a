import json

from pyspark.sql import functions as F

from helpers import lines
from tallywind.operators.ranges import range_ends, range_of
from tallywind.operators import containers as C
from tallywind.operators import hosts as H
from tallywind.operators import enrich, limits, report
from tallywind.operators.statsd import classify_statsd
from tallywind.sources.containers import container_facts
from tallywind.sinks.line_protocol import to_line_protocol
from tallywind.sources.hosts import snapshot_lines

NET = """Inter-|   Receive                                                |  Transmit
 face |bytes    packets errs drop fifo frame compressed multicast|bytes    packets errs drop fifo colls carrier compressed
    lo:  100 2 3 4 5 6 7 8 900 10 11 12 13 14 15 16
  eth0: 200 2 3 4 5 6 7 8 901 10 11 12 13 14 15 16
"""
FILES = {
    "/proc/net/dev": NET,
    "/proc/meminfo": "MemTotal:  100 kB\nMemFree: 50 kB\nHugePages_Total: 5\nCached: 7 kB\nBuffers: 9 kB\n",
    "/proc/stat": "cpu  9 9 9 9\ncpu0 1 2 3 4 5 6 7 8 9 10\ncpu1 10 20 30\nintr 77 1 2 3\nctxt 88\nprocesses 99\nprocs_running 2\n",
    "/proc/loadavg": "0.25 0.1 0.2 1/100 12345\n",
    "/proc/diskstats": "8 0 sda 1 2 3 4 5 6 7 8 9 10 11\n8 1 sdb 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18\n bad\n",
    "/proc/net/snmp": "Ip: Forwarding InReceives InDiscards\nIp: 1 500 6\nTcp: ActiveOpens InSegs\nTcp: 3 4\n",
    "/proc/net/netstat": "IpExt: InOctets OutOctets\nIpExt: 1000 2000\nTcpExt: Other TCPTimeouts\nTcpExt: 1 9\n",
}


def snapshots(spark):
    return spark.createDataFrame(
        [(h, 10.0, p, c) for h in ("h1", "h2") for p, c in FILES.items()], "host string, ts double, path string, content string"
    )


def first(df, host="h1"):
    return [r.asDict() for r in df.where(F.col("host") == host).orderBy("name" if "name" in df.columns else "ts").collect()]


def test_host_files(spark):
    df = snapshots(spark)
    eth, lo = first(H.host_interfaces(df))
    assert (eth["name"], eth["rx_bytes"], eth["tx_bytes"], eth["tx_dropped"]) == ("eth0", 200, 901, 12)
    assert [r["name"] for r in first(H.host_interfaces(df, allow=["eth.*"]))] == ["eth0"]
    assert [r["name"] for r in first(H.host_interfaces(df, deny=["eth"]))] == ["eth0", "lo"]
    assert [r["name"] for r in first(H.host_interfaces(df, allow=["lo"], deny=["lo"]))] == ["lo"]
    (mem,) = first(H.host_memory(df))
    assert (mem["total_bytes"], mem["free_bytes"], mem["cached_bytes"], mem["slab_bytes"]) == (102400, 51200, 7168, None)
    cpu0, cpu1 = first(H.host_cpu(df))
    assert (cpu0["user"], cpu0["steal"], cpu1["system"], cpu1["idle"]) == (1, 8, 30, None)
    (act,) = first(H.host_activity(df))
    assert {k: act[k] for k in ("switches", "forks", "running", "interrupts", "load")} == {
        "switches": 88, "forks": 99, "running": 2, "interrupts": 77, "load": 0.25}
    sda, sdb = first(H.host_disks(df))
    assert (sda["read_sectors"], sda["read_bytes"], sda["weighted_time"], sda["discard_bytes"]) == (3, 1536, 11, None)
    assert (sdb["discard_bytes"], sdb["flush_time"]) == (14 * 512, 17)
    ip, tcp = first(H.host_protocols(df))
    assert (ip["rx_packets"], ip["rx_dropped"], ip["rx_bytes"], ip["tx_bytes"]) == (500, 6, 1000, 2000)
    assert (tcp["tx_opens"], tcp["rx_packets"], tcp["timeouts"]) == (3, 4, 9)


def test_filesystems(spark):
    rows = [("h", 1.0, "/dev/a", "/", "ext4", 4096, 10, 5, 100, 50), ("h", 1.0, "proc", "/proc", "proc", 4096, 0, 0, 0, 0),
            ("h", 1.0, "x", "none", "ext4", 1, 1, 1, 1, 1), ("h", 1.0, "t", "/t", "tmpfs", 1, 1, 1, 1, 1)]
    df = spark.createDataFrame(
        rows, "host string, ts double, device string, path string, fstype string, bsize bigint, blocks bigint, bavail bigint, files bigint, favail bigint")
    got = H.host_filesystems(df, deny=["tmp.*"]).collect()
    assert [(r["name"], r["free_bytes"], r["total_bytes"], r["total_inodes"]) for r in got] == [("/", 20480, 40960, 100)]


def test_containers(spark):
    info = {
        "a" * 20: {"SizeRootFs": 10, "SizeRw": 3, "HostConfig": {"NanoCpus": 0, "CpuPeriod": 300000, "CpuQuota": 100000, "Memory": 0},
                   "State": {"Pid": 5}, "Config": {"Env": ["APP=web", "BAD=a b", "X=1"], "Labels": {"team": "t", "app": "label", "b.c": "no"}}},
        "b" * 20: {"SizeRootFs": 20, "HostConfig": {"NanoCpus": 5, "Memory": 77}, "State": {"Pid": 6}, "Config": {}},
        "c" * 20: {"SizeRootFs": 20, "HostConfig": {}, "State": {"Pid": 6}, "Config": {}},
    }
    containers = spark.createDataFrame([("h", 1.0, i, ["bad name", "/n" + i[0]]) for i in info], "host string, ts double, id string, names array<string>")
    inspect = spark.createDataFrame([("h", 1.0, i, json.dumps(v)) for i, v in info.items()], "host string, ts double, id string, json string")
    cgroup = spark.createDataFrame(
        [("h", 1.0, i, "11 22 \n", "500\n", NET if i[0] != "c" else None) for i in info],
        "host string, ts double, id string, usage_percpu string, memory_usage string, net_dev string")
    facts = C.container_tags(container_facts(containers, inspect, cgroup), {"APP": "app", "BAD": "bad"}).cache()
    assert facts.count() == 2
    tags = {r["id"][0]: r["tags"] for r in facts.collect()}
    assert tags["a"] == {"app": "label", "team": "t", "docker_name": "/na", "docker_id": "a" * 12}
    assert tags["b"] == {"docker_name": "/nb", "docker_id": "b" * 12}
    fs = {r["id"][0]: (r["total_bytes"], r["used_bytes"]) for r in C.container_fs(facts).collect()}
    assert fs == {"a": (10, 3), "b": (20, 0)}
    cpu = C.container_cpu(facts).collect()
    assert sorted((r["id"][0], r["tags"].get("name"), r["usage"]) for r in cpu if r["usage"]) == [
        ("a", "cpu0", 11), ("a", "cpu1", 22), ("b", "cpu0", 11), ("b", "cpu1", 22)]
    assert {r["id"][0]: r["limit_ps"] for r in cpu if r["limit_ps"]} == {"a": 333333333, "b": 5}
    memory = spark.createDataFrame([("h", 1.0, 1000)], "host string, ts double, total_bytes bigint")
    assert {r["id"][0]: (r["used_bytes"], r["limit_bytes"]) for r in C.container_memory(facts, memory).collect()} == {
        "a": (500, 1000), "b": (500, 77)}
    assert {(r["id"][0], r["tags"]["name"], r["rx_bytes"]) for r in C.container_interfaces(facts).collect()} == {
        (i, n, b) for i in "ab" for n, b in (("lo", 100), ("eth0", 200))}


def test_cap_and_push(spark):
    df = spark.range(1000).withColumnRenamed("id", "seq")
    assert limits.cap_newest(df, 1000).count() == 1000
    kept = sorted(r["seq"] for r in limits.cap_newest(df, 999).collect())
    assert kept == list(range(501, 1000))
    assert [r["seq"] for r in limits.push_limit(df, 3).collect()] == [0, 1, 2]


def test_chunks(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") % 10 == 0).alias("f"), F.concat(F.lit("l"), "id").alias("line"))
    want = {f: [f"l{i}" for i in range(1000) if (i % 10 == 0) == f] for f in (True, False)}
    for width in (1, 13, 300, 1 << 17):
        rows = limits.pack_chunks(df, ["f"], 7, range_rows=width).orderBy("f", "chunk").collect()
        assert [r["rows"] for r in rows if r["f"]] == [7] * 14 + [2] and [r["chunk"] for r in rows if not r["f"]] == list(range(129))
        for f in (True, False):
            assert "\n".join(r["payload"] for r in rows if r["f"] == f).split("\n") == want[f]


def test_chunks_of_packet_numbers_and_ties(spark):
    """Numbers 2^20 apart, and lines that share one: every range bounds its rows, and chunks are the same however they are cut."""
    rows = [((i // 3) << 20, f"l{i:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "seq bigint, line string").withColumn("f", F.lit(1))
    ends = range_ends(df, "seq", 100)
    sizes = [r["count"] for r in df.groupBy(range_of(F.col("seq"), ends)).count().collect()]
    assert len(ends) == 8 and sum(sizes) == 900 and max(sizes) <= 110
    for width in (10, 100, 10_000):
        got = limits.pack_chunks(df.repartition(5), ["f"], 50, range_rows=width).orderBy("chunk").collect()
        assert [r["payload"].split("\n") for r in got] == [[f"l{i:04d}" for i in range(50 * k, 50 * k + 50)] for k in range(18)]
    assert range_ends(df.limit(0)) == []
    numbers = spark.createDataFrame([(x,) for x in (-5, 3, 4, 10, 11, None)], "n bigint")
    assert [r[0] for r in numbers.select(range_of(F.col("n"), [3, 10])).collect()] == [0, 0, 1, 1, 2, 0]


def test_reports(spark):
    df = classify_statsd(lines(spark, ["a:1|c", "b:x|c", "sc|x"]))
    assert {r["outcome"]: r["lines"] for r in report.line_report(df).collect()} == {"accepted": 1, "value": 1, "service": 1}
    watched, counts = report.observed(df, "stage", rejected=F.col("reject_reason").isNotNull())
    watched.collect()
    assert counts.get == {"rows": 3, "rejected": 2}
    bodies = [
        json.dumps({"errors": True, "items": [{"index": {"status": 400}}, {"create": {"status": 201}}, {"status": 500}, {}]}),
        json.dumps({"errors": False, "items": [{"index": {"status": 400}}]}), "{}",
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    assert [r["rejected"] for r in report.bulk_rejects(df).orderBy("id").collect()] == [2, 0, 0]


def test_facts_are_not_broadcast(spark):
    """Tables with a row per container never go through the driver, however small their files look; JSON is parsed once, after the shuffle."""
    rows = [("h", 1.0, f"c{i}") for i in range(20)]
    ids = spark.createDataFrame(rows, "host string, ts double, id string")
    containers = ids.withColumn("names", F.array(F.lit("/n")))
    inspect = ids.withColumn("json", F.concat(F.lit('{"SizeRootFs":'), F.substring("id", 2, 9), F.lit("}")))
    cgroup = ids.withColumns({"usage_percpu": F.lit("1"), "memory_usage": F.lit("2"), "net_dev": F.lit(NET)})
    facts = C.container_tags(container_facts(containers, inspect, cgroup))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2 and plan.count("from_json(") == 1
    memory = spark.createDataFrame([("h", 1.0, 9)], "host string, ts double, total_bytes bigint")
    whole = C.container_rows(facts, memory)
    assert "from_json(" not in whole._jdf.queryExecution().executedPlan().toString()
    assert whole.where("bucket = 'docker_memory'").count() == 20


def test_captures_are_dealt_out_before_they_are_grouped(spark):
    snapshots = spark.createDataFrame(
        [("h", 1.0, p, c) for p, c in (("/proc/meminfo", "MemTotal: 1 kB\n"), ("/proc/stat", "ctxt 5\n"), ("/proc/loadavg", "0.5 0.1 0.2 1/9 7\n"), ("/proc/net/snmp", "Ip: InReceives\nIp: 4\n"))],
        "host string, ts double, path string, content string")
    for rows, value in ((H.host_memory(snapshots), "total_bytes"), (H.host_activity(snapshots), "switches"), (H.host_protocols(snapshots), "rx_packets")):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("Aggregate")
        assert [r[value] for r in rows.collect()] == [{"total_bytes": 1024, "switches": 5, "rx_packets": 4}[value]]
    assert [r["load"] for r in H.host_activity(snapshots).collect()] == [0.5]


def test_lines_are_cut_once(spark):
    """What follows a capture's words, filters included, uses the cut ones: the plan holds each cut once, not once for every field."""
    df = snapshots(spark)
    rows = H.snapshot_rows(H.host_disks(df, allow=["sd.*"]), "system_disk")
    made = to_line_protocol(enrich.finish_rows(rows, {"dc": "x"})).select("line")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 2
    assert plan.count("map_from_entries(filter(") == 1
    assert sorted(r["line"] for r in made.collect())[0] == (
        "system_disk,dc=x,host=h1,name=sda in_progress=9,io_time=10,read_bytes=1536,read_merged=2,read_ops=1,read_sectors=3,read_time=4,"
        "weighted_time=11,write_bytes=3584,write_merged=6,write_ops=5,write_sectors=7,write_time=8 10000000000")


def test_words_between_any_white_space(spark):
    content = "\t8\x0b0 \x0csda\r1 \xa0 2\xa0\n \u2003\n\n\x1c9 0  sdb\x1d x\x1f"
    df = spark.createDataFrame([("h", 1.0, "p", content), ("h", 2.0, "p", None), ("h", 3.0, "p", "")], "host string, ts double, path string, content string")
    got = [(r["ts"], r["pos"], r["tokens"]) for r in snapshot_lines(df).collect()]
    assert got == [(1.0, 0, ["8", "0", "sda", "1", "\xa0", "2"]), (1.0, 3, ["9", "0", "sdb\x1d", "x"])]
    tabbed = spark.createDataFrame([("h", 1.0, "/proc/net/snmp", "Ip:\tInReceives  InDiscards\n\nIp: 4\t5 \n")], "host string, ts double, path string, content string")
    assert [(r["name"], r["rx_packets"], r["rx_dropped"]) for r in H.host_protocols(tabbed).collect()] == [("ip", 4, 5)]


def test_lines_without_fields(spark):
    """A row whose fields are all NULL, or that has none, gives no line; a field without text gives none of its own."""
    kind = "bucket string, values map<string,struct<t:string,v:string>>, ts double, tags map<string,string>, line string"
    rows = [("a", {"x": ("null", None)}, 1.0, {}, "old"), ("b", {}, 1.0, {}, "old"), ("c", None, 1.0, {}, "old"),
            ("d", {"z": ("str", 'q"'), "a": ("int", "1"), "n": ("null", None)}, 2.0, {"t": "a b", "e": "", "n": None}, "old"),
            ("e", {"x": ("int", None)}, None, None, "old")]
    got = to_line_protocol(spark.createDataFrame(rows, kind))
    assert got.columns == ["bucket", "values", "ts", "tags", "line"]
    assert sorted(r["line"] for r in got.collect()) == ['d,t=a\\ b a=1,z="q\\"" 2000000000', "e "]
