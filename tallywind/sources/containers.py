"""Container facts from captured tables.

``containers(host, ts, id, names ARRAY<STRING>)``, ``inspect(host, ts, id, json)`` and
``cgroup(host, ts, id, usage_percpu, memory_usage, net_dev)`` hold one row per container and scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["host", "ts", "id"]

INSPECT_SCHEMA = (
    "SizeRootFs bigint, SizeRw bigint, "
    "HostConfig struct<NanoCpus:bigint,CpuPeriod:bigint,CpuQuota:bigint,Memory:bigint>, "
    "State struct<Pid:bigint>, Config struct<Env:array<string>,Labels:map<string,string>>"
)


def container_facts(containers: DataFrame, inspect: DataFrame, cgroup: DataFrame) -> DataFrame:
    """One row per container of which all parts could be read; others are left out wholly."""
    # Dealt out first and parsed behind a generator, which holds filters back: once per row, and by many tasks even from one small file.
    parsed = inspect.repartition(*KEY).select(*KEY, F.explode(F.array(F.from_json("json", INSPECT_SCHEMA))).alias("info")).where("info IS NOT NULL")
    complete = cgroup.where(
        F.col("usage_percpu").isNotNull() & F.col("memory_usage").isNotNull() & F.col("net_dev").isNotNull()
    )
    # All three hold a row per container: by file size alone Spark would send whole tables through the driver.
    return containers.join(parsed.hint("merge"), KEY).join(complete.hint("merge"), KEY)
