"""Small builders for literal inputs."""

import datetime as dt

from pyspark.sql import functions as F

EPOCH = dt.datetime(1970, 1, 1)


def at(seconds):
    """Epoch seconds as a naive UTC datetime for literal frames (session time zone is UTC)."""
    return dt.datetime.fromtimestamp(seconds, dt.timezone.utc)


def packets(spark, payloads, ts=1000.0, step=0.0):
    rows = [
        (i, at(ts + i * step), bytearray(p if isinstance(p, bytes) else p.encode("utf-8")))
        for i, p in enumerate(payloads)
    ]
    return spark.createDataFrame(rows, "packet_id bigint, recv_ts timestamp, data binary")


def lines(spark, texts, ts=1000.0, step=0.0):
    rows = [(i, at(ts + i * step), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "seq bigint, recv_ts timestamp, line string")


def tags_of(row):
    return dict(row["tags"])
