"""Operator inputs derived from the test tables: protocol text, packets, journals, host files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywind.functions.time import epoch, utc
from tallywind.operators.enrich import typed_value, union_all

DAY = 86400.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` with arrival time and number."""
    df = table(spark, folder, "events")
    return df.withColumns({"recv_ts": utc(F.col("ts")), "seq": F.col("event_id")}).drop("ts")


def as_lines(df: DataFrame, line: Column) -> DataFrame:
    return df.select("seq", "recv_ts", line.alias("line"))


def statsd_lines(df: DataFrame, kind: str) -> DataFrame:
    """``type:value|kind|#user=uN``; counters of odd events are sampled, some gauges are deltas."""
    value = F.col("value").cast("string")
    rate = F.when((F.col("event_id") % 2 == 1) & F.lit(kind == "c"), F.lit("|@0.5")).otherwise(F.lit(""))
    sign = F.when((F.col("event_id") % 3 == 0) & F.lit(kind == "g"), F.lit("+")).otherwise(F.lit(""))
    if kind == "s":
        value = F.concat(F.lit("v"), F.col("event_id") % 7)
    return as_lines(
        df, F.concat("event_type", F.lit(":"), sign, value, F.lit("|" + kind), rate, F.lit("|#user=u"), "user_id")
    )


def metric_events(df: DataFrame) -> DataFrame:
    """One metric row per event, with a field of every type."""
    fields = {
        "value": typed_value(F.col("value"), "double"), "id": typed_value(F.col("event_id"), "bigint"),
        "even": typed_value(F.col("event_id") % 2 == 0, "boolean"),
        "note": typed_value(F.concat(F.lit('say "'), "event_type", F.lit('"')), "string"),
        "none": typed_value(F.lit(None).cast("string"), "string"),
    }
    values = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    tags = F.create_map(
        F.lit("user"), F.concat(F.lit("u"), "user_id"), F.lit("kind"), F.concat("event_type", F.lit(' a,b=c"')), F.lit("blank"), F.lit("")
    )
    return df.select(
        F.col("event_type").alias("bucket"), values.alias("values"), epoch(F.col("recv_ts")).alias("ts"), tags.alias("tags"), "recv_ts", "seq"
    )


def journal(df: DataFrame) -> DataFrame:
    """Journal rows: one block of seven lines per process and burst, three of them a trace."""
    place = F.col("event_id") % 7
    message = (
        F.when(place == 0, F.lit("Traceback (most recent call last):"))
        .when(place == 1, F.lit('  File "job.py", line 1, in run'))
        .when(place == 2, F.concat(F.lit("ValueError: v"), "event_id", F.lit("  ")))
        .when(place == 3, F.concat(F.lit('{"code":'), "event_id", F.lit(',"_PID":1,"pid":7}')))
        .when(place == 4, F.lit("  "))
        .otherwise(F.concat(F.lit("info "), "event_id"))
    )
    return df.select(
        message.alias("MESSAGE"), F.lit("/bin/job").alias("_EXE"), F.concat(F.lit("h"), F.col("user_id") % 3).alias("_HOSTNAME"),
        F.lit("m").alias("_MACHINE_ID"), F.lit("b").alias("_BOOT_ID"),
        (F.floor(F.col("event_id") / 7) % 50).cast("string").alias("_PID"), F.lit("0").alias("_UID"), F.lit("0").alias("_GID"),
        F.lit("job.service").alias("_SYSTEMD_UNIT"), F.lit(None).cast("string").alias("CONTAINER_NAME"),
        F.lit(None).cast("string").alias("CONTAINER_ID"),
        F.when(F.col("event_id") % 11 != 0, (F.floor(F.col("event_id") / 7) % 7).cast("string")).alias("PRIORITY"),
        F.when(F.col("event_id") % 5 == 1, F.lit("DHCP4")).when(F.col("event_id") % 5 != 0, (F.col("event_id") % 12).cast("string")).alias("SYSLOG_FACILITY"),
        (F.col("event_id") * 100000 + 1000000).cast("string").alias("_SOURCE_REALTIME_TIMESTAMP"),
        F.lit(None).cast("string").alias("__REALTIME_TIMESTAMP"), "recv_ts", "seq",
    )


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """One set of captured files per order; the numbers come from its key and price."""
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("h"), "o_custkey").alias("host"), F.col("o_orderkey").cast("double").alias("ts"),
        F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("p"),
    )
    k, p = F.col("k").cast("string"), F.col("p").cast("string")

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    files = {
        "/proc/net/dev": text(
            "Inter-| Receive | Transmit\n face |bytes packets\n  eth0: ", p, " ", k, " 1 2 0 0 0 0 ", k, " 5 6 7 0 0 0 0\n",
            "    lo: 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16\n",
        ),
        "/proc/meminfo": text("MemTotal:  ", p, " kB\nMemFree: ", k, " kB\nHugePages_Total: 5\nCached: 7 kB\n"),
        "/proc/stat": text(
            "cpu  9 9 9 9\ncpu0 ", p, " 2 3 4 5 6 7 8 9 10\ncpu1 10 ", k, " 30\nintr ", p, " 1 2 3\nctxt ", k, "\nprocesses 99\nprocs_running 2\n"
        ),
        "/proc/loadavg": text("0.25 0.1 0.2 1/100 ", k, "\n"),
        "/proc/diskstats": text("8 0 sda 1 2 ", p, " 4 5 6 7 8 9 10 11\n8 1 loop0 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17\n"),
        "/proc/net/snmp": text("Ip: Forwarding InReceives InDiscards\nIp: 1 ", p, " 6\nTcp: ActiveOpens InSegs\nTcp: ", k, " 4\n"),
        "/proc/net/netstat": text("IpExt: InOctets OutOctets\nIpExt: ", k, " 2000\nTcpExt: Other TCPTimeouts\nTcpExt: 1 9\n"),
    }
    # One branch for each file: whoever reads some paths only has no others made.
    return union_all(*[orders.select("host", "ts", F.lit(path).alias("path"), content.alias("content")) for path, content in files.items()])


def mounts(spark: SparkSession, folder: str) -> DataFrame:
    """One mount per line item."""
    item = table(spark, folder, "lineitem")
    return item.select(
        F.concat(F.lit("h"), "l_suppkey").alias("host"), F.col("l_orderkey").cast("double").alias("ts"),
        F.concat(F.lit("/dev/d"), "l_linenumber").alias("device"),
        F.when(F.col("l_linenumber") % 4 == 0, F.lit("none")).otherwise(F.concat(F.lit("/mnt/"), "l_partkey")).alias("path"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit("tmpfs")).otherwise(F.lit("ext4")).alias("fstype"),
        F.lit(4096).cast("bigint").alias("bsize"), F.col("l_partkey").alias("blocks"), F.col("l_suppkey").alias("bavail"),
        (F.col("l_orderkey") % 5).alias("files"), F.col("l_linenumber").cast("bigint").alias("favail"),
    )


def container_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``containers, inspect, cgroup, host memory``: one container per part, ten hosts."""
    part = table(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    base = part.select(
        F.concat(F.lit("h"), F.col("p_partkey") % 10).alias("host"), F.lit(1.0).alias("ts"), F.md5(key.cast("binary")).alias("id"),
        "p_partkey", key.alias("key"), size.alias("size"),
    )
    ids = ["host", "ts", "id"]
    containers = base.select(*ids, F.array(F.lit("bad name"), F.concat(F.lit("/part"), "key")).alias("names"))
    limits = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('"NanoCpus":'), "key", F.lit("000,"))).otherwise(
        F.concat(F.lit('"CpuPeriod":300000,"CpuQuota":'), "size", F.lit("000,"))
    )
    info = F.concat(
        F.lit('{"SizeRootFs":'), "key", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(',"SizeRw":'), "size")).otherwise(F.lit("")),
        F.lit(',"HostConfig":{'), limits, F.lit('"Memory":'), F.when(F.col("p_partkey") % 4 == 0, F.lit("0")).otherwise(F.col("key")),
        F.lit('},"State":{"Pid":1},"Config":{"Env":["APP=app'), "size", F.lit('","BAD=a b"],"Labels":{"team":"t'), "size",
        F.lit('","not.ok":"x"}}}'),
    )
    inspect = base.select(*ids, info.alias("json"))
    net = F.concat(F.lit("face |bytes\n eth0: "), "key", F.lit(" 1 2 3 0 0 0 0 "), "size", F.lit(" 5 6 7 0 0 0 0\n"))
    cgroup = base.select(
        *ids, F.concat("key", F.lit(" "), "size", F.lit("\n")).alias("usage_percpu"), F.concat("key", F.lit("\n")).alias("memory_usage"),
        F.when(F.col("p_partkey") % 5 != 0, net).alias("net_dev"),
    )
    memory = base.groupBy("host", "ts").agg((F.count("*") * 1000).alias("total_bytes"))
    return containers, inspect, cgroup, memory
