"""What became of each micro-batch, as metric rows that any sink takes.

Rows are counted while they pass (:func:`tallywind.operators.report.observed`); the counts come with the progress of the query, batch by
batch. :class:`BatchCounters` hands them on while the query runs.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tallywind.operators.enrich import typed_value


def batch_counts(progress: dict, stage: str) -> tuple[str, int, float, dict[str, int]] | None:
    """``query, batch, ts, counts`` of one progress report (as a dict), or None if the batch did not pass ``stage``."""
    counts = (progress.get("observedMetrics") or {}).get(stage)
    if counts is None or not progress.get("numInputRows"):
        return None
    counts = counts if isinstance(counts, dict) else counts.asDict()
    at = dt.datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00")).timestamp()
    return progress.get("name") or progress["id"], int(progress["batchId"]), at, {k: int(v or 0) for k, v in counts.items()}


def count_rows(spark: SparkSession, reports: Iterable[tuple[str, int, float, dict[str, int]]], bucket: str = "pipeline") -> DataFrame:
    """Metric rows ``bucket, values, ts, tags, recv_ts``, one per batch: its counts as values, query and batch as tags."""
    rows = [(query, str(batch), at, list(counts.items())) for query, batch, at, counts in reports]
    frame = spark.createDataFrame(rows, "query string, batch string, ts double, counts array<struct<name: string, n: bigint>>")
    values = F.map_from_entries(F.transform("counts", lambda c: F.struct(c["name"], typed_value(c["n"], "bigint"))))
    return frame.select(
        F.lit(bucket).alias("bucket"), values.alias("values"), "ts",
        F.create_map(F.lit("query"), F.col("query"), F.lit("batch"), F.col("batch")).alias("tags"),
        F.timestamp_micros((F.col("ts") * 1000000).cast("bigint")).alias("recv_ts"),
    )


class BatchCounters(StreamingQueryListener):
    """Gives the counts of ``stage`` of every finished batch to ``report``, as ``query, batch, ts, counts``.

    A batch that runs again after a failure reports again under the same number, so its row replaces the earlier one.
    """

    def __init__(self, stage: str, report: Callable[[str, int, float, dict[str, int]], None]):
        self.stage, self.report = stage, report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = batch_counts(json.loads(event.progress.json), self.stage)
        if found is not None:
            self.report(*found)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
