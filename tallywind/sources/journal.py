"""Journal exports to log events: field names, clean messages, levels, facilities and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywind.functions.text import rstrip
from tallywind.functions.time import epoch

# Journal field -> event field.
FIELDS = {
    "MESSAGE": "message",
    "_EXE": "command",
    "_HOSTNAME": "host",
    "_MACHINE_ID": "machine_id",
    "_BOOT_ID": "boot_id",
    "_PID": "pid",
    "_UID": "uid",
    "_GID": "gid",
    "_SYSTEMD_UNIT": "systemd_unit",
    "CONTAINER_NAME": "container_name",
    "CONTAINER_ID": "container_id",
}

# Threshold names as syslog severities.
THRESHOLDS = {"CRITICAL": 2, "ERROR": 3, "WARNING": 4, "INFO": 6, "DEBUG": 7}

# Syslog facility codes that are not plain user messages.
FACILITIES = {0: "kernel", 3: "daemon", 4: "auth", 5: "daemon", 6: "daemon", 9: "daemon", 10: "auth"}

JOURNAL_SCHEMA = ", ".join(
    f"`{name}` string"
    for name in [*FIELDS, "PRIORITY", "SYSLOG_FACILITY", "_SOURCE_REALTIME_TIMESTAMP", "__REALTIME_TIMESTAMP"]
)


def read_journal(spark: SparkSession, path: str, stream: bool = False, schema: str = JOURNAL_SCHEMA) -> DataFrame:
    """JSON exports of the journal (one object per line), explicit schema."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(path)


def since(df: DataFrame, now: Column, seconds: float, column: str = "ts") -> DataFrame:
    """Back-fill horizon: rows of the last ``seconds`` before ``now``; 0 reads no history."""
    if seconds <= 0:
        return df.where(F.col(column) >= now)
    return df.where(F.col(column) >= now - F.make_dt_interval(secs=F.lit(float(seconds))))


def threshold(level: str) -> int:
    return THRESHOLDS[level]


def level_name(level: Column) -> Column:
    """Severity number to word."""
    return (
        F.when(level.between(0, 2), "critical").when(level == 3, "error").when(level == 4, "warning")
        .when(level == 7, "debug").when(level.isNotNull(), "info")
    )


def facility_name(facility: Column, literal: bool = False) -> Column:
    """Facility code to group; what is no number is ``user``, a missing one stays NULL.

    ``literal`` compares with the codes as the C header writes them (shifted left by three).
    """
    code = facility.try_cast("int")
    out = F.when(facility.isNull(), F.lit(None).cast("string"))
    for number, group in FACILITIES.items():
        out = out.when(code == (number << 3 if literal else number), group)
    return out.otherwise("user")


def _realtime(name: str) -> Column:
    return F.nullif(F.col(name).try_cast("double"), F.lit(0.0)) / 1000000


def map_journal_fields(raw: DataFrame, level: str = "INFO", facility: bool = True, literal_facility: bool = False) -> DataFrame:
    """Events at or above the threshold with a non-empty message.

    ``raw``: journal columns (strings or scalars; times in microseconds), ``recv_ts``, ``seq``.
    A missing priority counts as the threshold itself.
    """
    limit = threshold(level)
    priority = F.col("PRIORITY").try_cast("int")
    events = raw.where(priority.isNull() | (priority <= limit)).withColumn("MESSAGE", rstrip(F.col("MESSAGE").cast("string")))
    events = events.where("MESSAGE != ''")
    received = [epoch(F.col("recv_ts"))] if "recv_ts" in raw.columns else []
    extra = [c for c in ("recv_ts", "seq") if c in raw.columns]
    group = facility_name(F.col("SYSLOG_FACILITY").cast("string"), literal_facility)
    return events.select(
        *[F.col(f"`{name}`").cast("string").alias(alias) for name, alias in FIELDS.items()],
        F.coalesce(priority, F.lit(limit)).alias("level"),
        *([group.alias("facility")] if facility else []),
        F.coalesce(_realtime("_SOURCE_REALTIME_TIMESTAMP"), _realtime("__REALTIME_TIMESTAMP"), *received).alias("ts"),
        *extra,
    )
