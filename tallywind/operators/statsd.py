"""Tagged StatsD lines to typed samples, with built-in expressions only.

``name:value|type[|@rate][|#tag=value,...]``. One pass of projections computes every part and a
``reject_reason``; :func:`parse_statsd` keeps the valid rows, :func:`rejected_lines` the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.functions.maps import last_wins
from tallywind.functions.text import is_identifier, parse_float
from tallywind.functions.time import epoch, norm_epoch

# Tag names are words that are identifiers too. One grammar serves both tag forms: a value is a
# run of escaped characters and of anything but a comma, and one trailing comma is allowed.
_TAG = r"([\p{L}\p{Nl}][\p{L}\p{Nl}\p{Nd}_]*+)[=:]((?:\\.|[^,])*+),?"
_TAGS = rf"^(?:{_TAG})++$"


def _unescape(value: Column) -> Column:
    r"""``\n \r \t`` become control characters, any other ``\x`` becomes ``x``."""
    pieces = F.regexp_extract_all(value, F.lit(r"(?s)(\\.|[^\\]++|\\)"), F.lit(1))
    plain = F.transform(
        pieces,
        lambda p: F.when(p == "\\n", F.lit("\n"))
        .when(p == "\\r", F.lit("\r"))
        .when(p == "\\t", F.lit("\t"))
        .when(p.startswith("\\") & (F.length(p) > 1), F.substring(p, 2, 2))
        .otherwise(p),
    )
    return F.when(value.contains("\\"), F.array_join(plain, "")).otherwise(value)


def classify_statsd(lines: DataFrame, timestamp_window: float = 600.0) -> DataFrame:
    """All parsed parts of ``(line, recv_ts, seq)`` plus ``reject_reason`` (NULL = valid)."""
    line = F.col("line")
    cut = F.locate("|#", line)
    df = lines.withColumns(
        {
            "head": F.when(cut > 0, line.substr(F.lit(1), cut - 1)).otherwise(line),
            "tag_part": F.when(cut > 0, line.substr(cut + 2, F.length(line))).otherwise(F.lit("")),
        }
    )
    df = df.withColumn("bits", F.split("head", r"\|"))
    first = F.get("bits", F.lit(0))
    colon = F.locate(":", first)
    code = F.get("bits", F.lit(1))
    df = df.withColumns(
        {
            "name": F.when(colon > 0, first.substr(F.lit(1), colon - 1)).otherwise(first),
            "raw": F.when(colon > 0, first.substr(colon + 1, F.length(first))).otherwise(F.lit("")),
            "kind": F.when(code.isin("ms", "h"), "timer").when(code == "g", "gauge")
            .when(code == "s", "set").otherwise("counter"),
            "rate_part": F.get("bits", F.lit(2)),
        }
    )
    sampled = (F.col("kind") == "counter") & F.col("rate_part").startswith("@")
    df = df.withColumns(
        {
            "value": F.when(F.col("kind") != "set", parse_float(F.col("raw"))),
            "rate": F.when(sampled, parse_float(F.expr("substr(rate_part, 2)"))).otherwise(F.lit(1.0)),
            "tags_ok": (F.col("tag_part") == "") | F.col("tag_part").rlike(_TAGS),
        }
    )
    # Tags are only taken apart where the whole tag text is known to be good.
    tagged = F.col("tags_ok") & (F.col("tag_part") != "")
    df = df.withColumns(
        {
            "keys": F.when(tagged, F.regexp_extract_all("tag_part", F.lit(_TAG), F.lit(1))),
            "texts": F.when(tagged, F.regexp_extract_all("tag_part", F.lit(_TAG), F.lit(2))),
        }
    )
    plain = F.arrays_zip(F.col("keys").alias("key"), F.col("texts").alias("value"))
    escaped = F.arrays_zip(F.col("keys").alias("key"), F.transform("texts", _unescape).alias("value"))
    df = df.withColumn("entries", F.when(F.col("tag_part").contains("\\"), escaped).otherwise(plain))
    special = F.col("tag_part").contains("timestamp") | F.col("tag_part").contains("bucket")
    times = F.transform(
        F.filter("entries", lambda e: e["key"] == "timestamp"), lambda e: norm_epoch(parse_float(e["value"]), None)
    )
    df = df.withColumn("times", F.when(special, times))
    received = epoch(F.col("recv_ts"))
    time_ok = F.forall(
        "times", lambda t: F.coalesce(~F.isnan(t) & (F.abs(received - t) <= timestamp_window), F.lit(False))
    )
    bucket_ok = F.forall(
        "entries", lambda e: (e["key"] != "bucket") | is_identifier(e["value"])
    )
    rate_ok = F.coalesce((F.col("rate") > 0) & (F.col("rate") <= 1), F.lit(False))
    reason = (
        F.when(line.startswith("sc|") | line.startswith("_e{"), "service")
        .when(~F.col("tags_ok"), "tags")
        .when(F.coalesce(special & ~time_ok, F.lit(False)), "timestamp")
        .when(F.coalesce(special & ~bucket_ok, F.lit(False)), "bucket")
        .when(~F.size("bits").isin(2, 3), "format")
        .when(~is_identifier(F.col("name")), "name")
        .when(F.col("raw") == "", "value")
        .when((F.col("kind") != "set") & F.col("value").isNull(), "value")
        .when(~rate_ok, "rate")
    )
    parts = ["kind", "name", "raw", "value", "rate", "keys", "entries", "times", "reject_reason"]
    # Through a generator, as filters on what comes out of one stay above it: moved down to the scan,
    # they would drag a second evaluation of the whole parse along.
    df = df.withColumn("reject_reason", reason)
    return df.select("line", "recv_ts", "seq", F.inline(F.array(F.struct(*parts))))


def parse_statsd(lines: DataFrame, timestamp_window: float = 600.0) -> DataFrame:
    """Valid samples: ``kind, name, raw, value, rate, tags, series, cust_ts, recv_ts, seq``.

    ``tags`` holds ``name`` (the metric name wins over a tag of that name) and, if given,
    ``bucket``; ``timestamp`` goes to ``cust_ts``. Landed as Parquet partitioned by ``kind``, the
    text is parsed once and every aggregate reads its own partition only.
    """
    df = classify_statsd(lines, timestamp_window).where("reject_reason IS NULL")
    own = F.array(F.struct(F.lit("name").alias("key"), F.col("name").alias("value")))
    others = F.when(
        F.array_contains("keys", "name") | F.array_contains("keys", "timestamp"),
        F.filter("entries", lambda e: ~e["key"].isin("name", "timestamp")),
    ).otherwise(F.col("entries"))
    repeats = F.size(F.array_distinct("keys")) < F.size("keys")
    given = F.when(repeats, F.map_entries(last_wins(others))).otherwise(others)
    key = F.when(F.col("entries").isNull(), own).otherwise(F.sort_array(F.concat(given, own)))
    last_time = F.round(F.try_element_at("times", F.lit(-1)), 3)
    samples = df.select(
        "kind", "name", "raw", "value", "rate", key.alias("series"), last_time.alias("cust_ts"), "recv_ts", "seq"
    )
    return samples.withColumn("tags", F.map_from_entries("series"))


def rejected_lines(lines: DataFrame, timestamp_window: float = 600.0) -> DataFrame:
    """The lines that :func:`parse_statsd` drops, with the reason."""
    return classify_statsd(lines, timestamp_window).where("reject_reason IS NOT NULL").select(
        "line", "recv_ts", "seq", "reject_reason"
    )
