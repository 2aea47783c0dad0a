"""Payload scans: files, Kafka or a table of captured packets to numbered text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywind.functions.text import LINE_BREAK, strip

LINE_BITS = 20  # room for 2^20 lines per packet, and 2^43 packets, in one BIGINT arrival number


def arrival_number(packet: Column, line: Column, line_bits: int = LINE_BITS) -> Column:
    """One BIGINT for packet and line. Numbers that don't fit fail the query, so that no two lines ever share one."""
    fits = (line < 1 << line_bits) & (packet >= 0) & (packet < 1 << 63 - line_bits)
    number = F.shiftleft(packet, line_bits) + line
    return F.when(fits, number).otherwise(
        F.raise_error(F.concat(F.lit("no arrival number for line "), line.cast("string"), F.lit(" of packet "), packet.cast("string"))).cast("bigint")
    )


def read_lines(packets: DataFrame, line_bits: int = LINE_BITS) -> DataFrame:
    """Split packets ``(packet_id, recv_ts, data)`` in stripped, non-blank lines.

    A payload that is not UTF-8 is dropped whole. ``seq`` numbers the lines in arrival order, given
    that packet ids grow with arrival and no two packets share one; it stays one BIGINT so that "latest" aggregates on it keep
    a fixed-width buffer and run as hash aggregates. A packet of more than ``2 ** line_bits`` lines fails the query.
    """
    text = F.col("data").cast("string")
    lines = (
        packets.where(F.is_valid_utf8(text))
        .select("packet_id", "recv_ts", F.posexplode(F.split(text, LINE_BREAK)).alias("pos", "raw"))
        .select("packet_id", "pos", "recv_ts", strip(F.col("raw")).alias("line"))
    )
    return lines.where("line != ''").withColumn("seq", arrival_number(F.col("packet_id").cast("bigint"), F.col("pos"), line_bits))


def read_packet_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Packets captured in Parquet as ``(packet_id BIGINT, recv_ts TIMESTAMP, data BINARY)``."""
    reader = spark.readStream if stream else spark.read
    return reader.schema("packet_id bigint, recv_ts timestamp, data binary").parquet(path)


def kafka_packets(records: DataFrame, partitions: int) -> DataFrame:
    """Kafka records (``partition, offset, timestamp, value``) as packets.

    Offsets only grow, and are only unique, within a partition. ``packet_id`` is ``offset * partitions + partition``: unique over all
    ``partitions`` of the topic (which must not grow while numbers are compared), in order within each of them, and among
    partitions in order of their offsets. A partition number beyond that fails the query.
    """
    known = F.when(F.col("partition") < partitions, F.col("partition")).otherwise(
        F.raise_error(F.concat(F.lit("unexpected partition "), F.col("partition").cast("string"))).cast("int")
    )
    return records.select(
        (F.col("offset") * partitions + known).alias("packet_id"), F.col("timestamp").alias("recv_ts"), F.col("value").alias("data")
    )


def read_packets_kafka(spark: SparkSession, options: dict[str, str], partitions: int, stream: bool = True) -> DataFrame:
    """A Kafka topic as packets, see :func:`kafka_packets`. Needs the Spark Kafka connector on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka").options(**options)
    return kafka_packets(reader.load(), partitions)
