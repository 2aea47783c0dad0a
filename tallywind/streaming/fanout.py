"""One stream into several destinations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallywind.operators.enrich import route


def write_routed(rows: DataFrame, path: str) -> None:
    """All destinations in one write: one folder per destination, from one pass over the rows."""
    rows.write.mode("overwrite").partitionBy("destination").parquet(path)


def start_fanout(
    rows: DataFrame, table: dict[str, list[str]], sinks: dict[str, Callable[[DataFrame, int], None]],
    checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Routed rows of every micro-batch to the sink of their destination.

    ``rows`` has a ``source`` column; sources that the table doesn't list go to all sinks. The batch is kept while its sinks write, so it is computed once.
    """
    missing = {d for targets in table.values() for d in targets} - set(sinks)
    if missing:
        raise ValueError(f"no sink for {sorted(missing)}")

    def deliver(batch: DataFrame, batch_id: int) -> None:
        routed = route(batch, table, list(sinks)).persist()
        try:
            for name, sink in sinks.items():
                sink(routed.where(routed.destination == name).drop("destination"), batch_id)
        finally:
            routed.unpersist()

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
