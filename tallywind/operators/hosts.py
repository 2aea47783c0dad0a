"""Host snapshots to metrics: interfaces, memory, processors, activity, disks, protocols, mounts.

Input rows are captured files of many hosts; one file is one row, so nothing larger than a file
meets in a task; the files of one (host, ts) meet after a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.functions.maps import merge
from tallywind.operators.enrich import to_metric_rows, union_all
from tallywind.sources.hosts import plain, snapshot_lines, tokens

# Positions and names in the kernel's files.
INTERFACE_FIELDS = {
    "rx_bytes": 1, "rx_packets": 2, "rx_errors": 3, "rx_dropped": 4,
    "tx_bytes": 9, "tx_packets": 10, "tx_errors": 11, "tx_dropped": 12,
}
MEMORY_FIELDS = {
    "MemTotal:": "total_bytes",
    "MemFree:": "free_bytes",
    "MemAvailable:": "available_bytes",
    "Shmem:": "shared_bytes",
    "Cached:": "cached_bytes",
    "Slab:": "slab_bytes",
    "Mapped:": "mapped_bytes",
    "SwapTotal:": "swap_total_bytes",
    "SwapFree:": "swap_free_bytes",
    "SwapCached:": "swap_cached_bytes",
}
CPU_FIELDS = ["user", "nice", "system", "idle", "wait", "interrupt", "softirq", "steal"]
ACTIVITY_FIELDS = {"ctxt": "switches", "processes": "forks", "procs_running": "running", "intr": "interrupts"}
DISK_FIELDS = [
    "read_ops", "read_merged", "read_sectors", "read_time",
    "write_ops", "write_merged", "write_sectors", "write_time",
    "in_progress", "io_time", "weighted_time",
    "discard_ops", "discard_merged", "discard_sectors", "discard_time",
    "flush_ops", "flush_time",
]
PROTOCOL_FIELDS = {
    "Ip:InReceives": ("ip", "rx_packets"),
    "Ip:InDiscards": ("ip", "rx_dropped"),
    "IpExt:InOctets": ("ip", "rx_bytes"),
    "Ip:OutRequests": ("ip", "tx_packets"),
    "Ip:OutDiscards": ("ip", "tx_dropped"),
    "IpExt:OutOctets": ("ip", "tx_bytes"),
    "Icmp:InMsgs": ("icmp", "rx_packets"),
    "Icmp:InErrors": ("icmp", "rx_errors"),
    "Icmp:OutMsgs": ("icmp", "tx_packets"),
    "Icmp:OutErrors": ("icmp", "tx_errors"),
    "Udp:InDatagrams": ("udp", "rx_packets"),
    "Udp:InErrors": ("udp", "rx_errors"),
    "Udp:OutDatagrams": ("udp", "tx_packets"),
    "Udp:RcvbufErrors": ("udp", "rcvbuf_errors"),
    "Udp:SndbufErrors": ("udp", "sndbuf_errors"),
    "Tcp:OutSegs": ("tcp", "tx_packets"),
    "Tcp:InSegs": ("tcp", "rx_packets"),
    "Tcp:RetransSegs": ("tcp", "retr_packets"),
    "Tcp:ActiveOpens": ("tcp", "tx_opens"),
    "Tcp:PassiveOpens": ("tcp", "rx_opens"),
    "Tcp:EstabResets": ("tcp", "conn_resets"),
    "Tcp:CurrEstab": ("tcp", "conn_count"),
    "Tcp:OutRsts": ("tcp", "rx_resets"),
    "TcpExt:ListenOverflows": ("tcp", "listen_overflows"),
    "TcpExt:ListenDrops": ("tcp", "listen_drops"),
    "TcpExt:TCPTimeouts": ("tcp", "timeouts"),
    "TcpExt:TCPBacklogDrop": ("tcp", "backlog_drops"),
    "TcpExt:TCPKeepAlive": ("tcp", "keep_alives"),
    "TcpExt:SyncookiesRecv": ("tcp", "rx_syncookies"),
    "TcpExt:SyncookiesSent": ("tcp", "tx_syncookies"),
}
SECTOR_BYTES = 512


def _token(index: int) -> Column:
    return F.get("tokens", F.lit(index))


def _count(index: int) -> Column:
    return _token(index).try_cast("bigint")


def listed(value: Column, allow: list[str] | None = None, deny: list[str] | None = None) -> Column:
    """Whole-value patterns. With an allow list nothing else passes and ``deny`` is not consulted."""
    if allow:
        return value.rlike("^(?:" + "|".join(f"(?:{p})" for p in allow) + r")\z")
    if deny:
        return ~value.rlike("^(?:" + "|".join(f"(?:{p})" for p in deny) + r")\z")
    return F.lit(True)


def interface_rows(lines: DataFrame, keep: list[str]) -> DataFrame:
    rows = lines.where((F.size("tokens") == 17) & _token(0).endswith(":"))
    name = F.expr("substr(tokens[0], 1, length(tokens[0]) - 1)")
    return rows.select(*keep, name.alias("name"), *[_count(i).alias(f) for f, i in INTERFACE_FIELDS.items()])


def host_interfaces(snapshots: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    rows = interface_rows(snapshot_lines(snapshots, "/proc/net/dev"), ["host", "ts"])
    return rows.where(listed(F.col("name"), allow, deny))


def _dealt(rows: DataFrame) -> DataFrame:
    """Captures are grouped after they are dealt out: nearly all differ, so partial results of whole input splits would take memory and fold nothing."""
    return rows.repartition("host", "ts")


def host_memory(snapshots: DataFrame) -> DataFrame:
    lines = snapshot_lines(snapshots, "/proc/meminfo")
    rows = lines.where(
        (F.size("tokens") == 3) & (F.lower(_token(2)) == "kb") & _token(0).isin(list(MEMORY_FIELDS))
    )
    named = _dealt(rows.select("host", "ts", _token(0).alias("name"), (_count(1) * 1024).alias("value")))
    return named.groupBy("host", "ts").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(f) for name, f in MEMORY_FIELDS.items()])


def host_cpu(snapshots: DataFrame) -> DataFrame:
    lines = snapshot_lines(snapshots, "/proc/stat")
    rows = lines.where(_token(0).startswith("cpu") & (F.length(_token(0)) > 3))
    return rows.select(
        "host", "ts", _token(0).alias("name"), *[_count(i + 1).alias(f) for i, f in enumerate(CPU_FIELDS)]
    )


def host_activity(snapshots: DataFrame) -> DataFrame:
    lines = snapshot_lines(snapshots, "/proc/stat", "/proc/loadavg")
    stat = F.col("path") == "/proc/stat"
    load = (F.col("path") == "/proc/loadavg") & (F.size("tokens") == 5)
    rows = lines.where((stat & _token(0).isin(list(ACTIVITY_FIELDS))) | load)
    named = _dealt(rows.select(
        "host", "ts", F.when(stat, _token(0)).alias("name"), F.when(stat, _count(1)).alias("value"),
        F.when(load, _token(0).try_cast("double")).alias("load"), F.when(load, F.col("pos")).alias("pos"),
    ))
    return named.groupBy("host", "ts").agg(
        *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(f) for name, f in ACTIVITY_FIELDS.items()],
        F.min_by("load", "pos").alias("load"),
    )


def host_disks(snapshots: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    lines = snapshot_lines(snapshots, "/proc/diskstats").where(F.size("tokens") >= 3)
    rows = lines.where(listed(_token(2), allow, deny)).select(
        "host", "ts", _token(2).alias("name"), *[_count(i + 3).alias(f) for i, f in enumerate(DISK_FIELDS)]
    )
    return rows.withColumns(
        {f.replace("_sectors", "_bytes"): F.col(f) * SECTOR_BYTES for f in DISK_FIELDS if f.endswith("_sectors")}
    )


def host_protocols(snapshots: DataFrame) -> DataFrame:
    """A prefix names fields on its first line and gives values on the later ones.

    The two files of a capture meet once; what follows keeps that partitioning.
    """
    files = snapshots.where(F.col("path").isin("/proc/net/snmp", "/proc/net/netstat"))
    both = _dealt(files).groupBy("host", "ts").agg(
        F.sort_array(F.collect_list(F.struct((F.col("path") != "/proc/net/snmp").alias("file"), "content"))).alias("files")
    )
    lines = F.flatten(F.transform("files", lambda f: F.transform(F.split(plain(f["content"]), "\n"), tokens)))
    known = list(dict.fromkeys(k.split(":")[0] + ":" for k in PROTOCOL_FIELDS))

    def found(prefix: str) -> Column:
        return F.filter("lines", lambda words: F.get(words, F.lit(0)) == prefix)

    each = F.array(*[F.struct(F.lit(k).alias("prefix"), found(k).alias("found")) for k in known])
    paired = (
        both.select("host", "ts", lines.alias("lines")).select("host", "ts", F.inline(each))
        .select("host", "ts", "prefix", F.get("found", F.lit(0)).alias("names"), F.posexplode("found").alias("line", "tokens"))
        .where("line > 0")
        .select("host", "ts", "prefix", "line", F.explode(F.arrays_zip("names", "tokens")).alias("pair"))
        .select("host", "ts", "line", F.concat("prefix", "pair.names").alias("field"), F.col("pair.tokens").try_cast("bigint").alias("value"))
    )
    proto = F.create_map(*[x for k, (p, _) in PROTOCOL_FIELDS.items() for x in (F.lit(k), F.lit(p))])
    rows = paired.where(F.col("field").isin(list(PROTOCOL_FIELDS)) & F.col("value").isNotNull())
    rows = rows.withColumn("name", F.try_element_at(proto, F.col("field")))
    columns = list(dict.fromkeys(f for _, f in PROTOCOL_FIELDS.values()))
    return rows.groupBy("host", "ts", "name").agg(*[
        F.max_by(
            "value", F.when(F.col("field").isin([k for k, (_, f) in PROTOCOL_FIELDS.items() if f == column]), F.col("line"))
        ).alias(column)
        for column in columns
    ])


def host_filesystems(mounts: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """``mounts``: ``host, ts, device, path, fstype, bsize, blocks, bavail, files, favail``."""
    real = mounts.where(F.col("path").startswith("/") & (F.col("files") != 0) & listed(F.col("fstype"), allow, deny))
    return real.select(
        "host", "ts", "device", F.col("path").alias("name"), F.col("fstype").alias("type"),
        (F.col("bavail") * F.col("bsize")).alias("free_bytes"), (F.col("blocks") * F.col("bsize")).alias("total_bytes"),
        F.col("favail").alias("free_inodes"), F.col("files").alias("total_inodes"),
    )


# The buckets of metric rows, and which columns are tags.
TAG_COLUMNS = ("host", "device", "name", "type")


def host_rows(
    snapshots: DataFrame, mounts: DataFrame | None = None, add_timestamps: bool = True, interfaces: dict | None = None,
    disks: dict | None = None, filesystems: dict | None = None,
) -> DataFrame:
    """All metrics of the captures as metric rows; the dicts hold ``allow`` and ``deny`` lists."""
    parts = {
        "system_cpu": host_cpu(snapshots), "system_activity": host_activity(snapshots), "system_memory": host_memory(snapshots),
        "system_interface": host_interfaces(snapshots, **(interfaces or {})), "system_disk": host_disks(snapshots, **(disks or {})),
        "system_protocol": host_protocols(snapshots),
    }
    if mounts is not None:
        parts["system_filesystem"] = host_filesystems(mounts, **(filesystems or {}))
    return union_all(*[snapshot_rows(df, bucket, add_timestamps) for bucket, df in parts.items()])


def snapshot_rows(df: DataFrame, bucket: str, add_timestamps: bool = True) -> DataFrame:
    """Flat metrics of a capture as metric rows that arrived when it was taken. Fields without a value are left out."""
    tags = [c for c in TAG_COLUMNS if c in df.columns]
    own = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in tags]))
    fields = [c for c in df.columns if c not in (*TAG_COLUMNS, "ts", "id", "tags")]
    rows = df.withColumns({
        "tags": merge(own, F.col("tags")) if "tags" in df.columns else own,
        "recv_ts": F.timestamp_micros(F.round(F.col("ts") * 1000000).cast("bigint")),
        "ts": F.col("ts") if add_timestamps else F.lit(None).cast("double"),
    })
    return to_metric_rows(rows, bucket, fields)
