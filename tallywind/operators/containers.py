"""Container metrics: tags, processor use and limits, memory, disk and interfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.functions.maps import last_wins, literal_map, put, tag_text
from tallywind.functions.text import strip
from tallywind.operators.enrich import union_all
from tallywind.operators.hosts import interface_rows, snapshot_rows
from tallywind.session import land

# What container tags may look like.
META_NAME = r"[a-zA-Z][a-zA-Z0-9_]*"
META_VALUE = r"[a-zA-Z0-9_:=\-+@?#./%<>*;&\[\]]+"
DEFAULT_PERIOD = 1_000_000

FACT = ["host", "ts", "id", "tags"]


def container_tags(facts: DataFrame, env_map: dict[str, str] | None = None) -> DataFrame:
    """Adds ``tags``: mapped environment, then labels, then the first valid name, then the short id."""
    env, labels = F.col("info.Config.Env"), F.col("info.Config.Labels")
    layers = []
    if env_map:
        mapping = literal_map(env_map)
        usable = F.filter(env, lambda e: e.rlike(f"^{META_NAME}={META_VALUE}\\z"))
        pairs = F.transform(
            usable,
            lambda e: F.struct(
                F.try_element_at(mapping, F.substring_index(e, "=", 1)).alias("key"),
                F.regexp_extract(e, r"^[^=]*=(.*)$", 1).alias("value"),
            ),
        )
        layers.append(F.filter(pairs, lambda p: p["key"].isNotNull()))
    good = F.filter(
        F.map_entries(labels), lambda e: e["key"].rlike(f"^{META_NAME}\\z") & e["value"].rlike(f"^{META_VALUE}\\z")
    )
    layers.append(good)
    name = F.get(F.filter("names", lambda n: n.rlike(f"^{META_VALUE}\\z")), F.lit(0))
    layers.append(
        F.when(name.isNotNull(), F.array(F.struct(F.lit("docker_name").alias("key"), name.alias("value"))))
    )
    layers.append(F.array(F.struct(F.lit("docker_id").alias("key"), F.substring("id", 1, 12).alias("value"))))
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.concat(*[F.coalesce(layer.cast("array<struct<key:string,value:string>>"), none) for layer in layers])
    return facts.withColumn("tags", last_wins(entries))


def container_fs(facts: DataFrame) -> DataFrame:
    return facts.select(
        *FACT, F.col("info.SizeRootFs").alias("total_bytes"), F.coalesce("info.SizeRw", F.lit(0)).alias("used_bytes")
    )


def _or_none(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(0))


def container_cpu(facts: DataFrame) -> DataFrame:
    """``usage`` per processor (tag ``name``) and one ``limit_ps`` row, in nanoseconds per second."""
    rows = facts.withColumn("ticks", F.split(strip(F.col("usage_percpu")), r"\s+"))
    usage = rows.select(*FACT, F.posexplode("ticks").alias("cpu", "text")).select(
        "host", "ts", "id", put(F.col("tags"), "name", F.concat(F.lit("cpu"), "cpu")).alias("tags"),
        F.col("text").try_cast("bigint").alias("usage"), F.lit(None).cast("bigint").alias("limit_ps"),
    )
    period = F.coalesce(_or_none("info.HostConfig.CpuPeriod"), F.lit(DEFAULT_PERIOD))
    quota = F.coalesce(_or_none("info.HostConfig.CpuQuota"), period * F.size("ticks"))
    share = F.bround(F.lit(1000000000.0) * quota / period).cast("bigint")
    limit = rows.select(
        *FACT, F.lit(None).cast("bigint").alias("usage"),
        F.coalesce(_or_none("info.HostConfig.NanoCpus"), share).alias("limit_ps"),
    )
    return usage.unionByName(limit)


def container_memory(facts: DataFrame, host_memory: DataFrame) -> DataFrame:
    """A container without a limit has that of its host: ``host_memory(host, ts, total_bytes)``."""
    joined = facts.join(host_memory.select("host", "ts", "total_bytes"), ["host", "ts"], "left")
    return joined.select(
        *FACT, strip(F.col("memory_usage")).try_cast("bigint").alias("used_bytes"),
        F.coalesce(_or_none("info.HostConfig.Memory"), F.col("total_bytes")).alias("limit_bytes"),
    )


def container_interfaces(facts: DataFrame) -> DataFrame:
    lines = facts.select(*FACT, F.posexplode(F.split("net_dev", "\n")).alias("pos", "line")).select(
        *FACT, F.split(strip(F.col("line")), r"\s+").alias("tokens")
    )
    rows = interface_rows(lines, FACT)
    return rows.withColumn("tags", put(F.col("tags"), "name", F.col("name")))


def with_tag_text(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", tag_text(F.col("tags")))


def container_rows(facts: DataFrame, host_memory: DataFrame, add_timestamps: bool = True) -> DataFrame:
    """All metrics of the containers as metric rows, with the containers' tags and that of the host. The facts are landed when this is called, so they are joined and parsed once."""
    facts = land(facts)
    parts = {
        "docker_filesystem": container_fs(facts), "docker_cpu": container_cpu(facts),
        "docker_interface": container_interfaces(facts).drop("name"), "docker_memory": container_memory(facts, host_memory),
    }
    return union_all(*[snapshot_rows(df, bucket, add_timestamps) for bucket, df in parts.items()])
