"""Line protocol: ``bucket,tag=v field=v ns`` with sorted tags and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.functions.maps import series


def to_line_protocol(rows: DataFrame) -> DataFrame:
    """Adds ``line``. Empty tags and NULL fields are left out; a row without fields gives no line."""

    def tag(e):
        value = e["value"]
        for mark in (",", " ", "="):
            value = F.replace(value, F.lit(mark), F.lit("\\" + mark))
        return F.when(e["value"] != "", F.concat(F.lit(","), e["key"], F.lit("="), value))

    def field(e):
        text = F.concat(F.lit('"'), F.replace(e["value"]["v"], F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.when(e["value"]["t"] != "null", F.concat(e["key"], F.lit("="), F.when(e["value"]["t"] == "str", text).otherwise(e["value"]["v"])))

    # Joined texts skip those that are NULL.
    tags = F.array_join(F.transform(series(F.col("tags")), tag), "")
    fields = F.array_join(F.transform(series(F.col("values")), field), ",")
    head = F.concat("bucket", F.coalesce(tags, F.lit("")))
    # The product is taken in floating point, as every producer of this format does.
    nanos = (F.col("ts") * 1000000000).cast("bigint").cast("string")
    # The line comes out of an outer generator: a filter on the fields would move down to the source and work them out there once more.
    some = F.exists(F.map_values("values"), lambda v: v["t"] != "null")
    made = rows.withColumn("line", F.when(some, F.array(F.concat_ws(" ", head, fields, nanos))))
    return made.withColumn("line", F.explode_outer("line")).where(F.col("line").isNotNull())


def write_line_protocol(rows: DataFrame, path: str, compression: str | None = None) -> None:
    to_line_protocol(rows).select("line").write.mode("overwrite").text(path, compression=compression)
