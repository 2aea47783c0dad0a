"""Session settings that suit these operators. Every operator is correct without them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Keyed streaming state with timers needs this store; it also keeps large state off the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch writes its changes instead of whole state files, and doesn't look up every key only to count them.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names in ``spark.checkpoint.dir``.

    Local sessions, as in tests, may do without that setting; theirs is in the warehouse folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is not None:
        return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared/{uuid.uuid4().hex}"


def land(frame: DataFrame) -> DataFrame:
    """The rows of ``frame``, written now as Parquet to the shared folder and read back: later jobs read the same rows."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
