"""Every operator as a query over the test tables, and the same result in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywind.functions.maps import tag_text
from tallywind.functions.time import epoch, utc
from tallywind.operators import aggregate as A
from tallywind.operators import containers as C
from tallywind.operators import enrich, hosts, limits, logs, report
from tallywind.operators.bins import BinSpec, binned_by, binned_by_function
from tallywind.operators.stitch import GRAMMARS, Grammar, State, stitch
from tallywind.operators.statsd import classify_statsd, parse_statsd
from tallywind.plans import flows
from tallywind.plans import inputs as I
from tallywind.plans.inputs import DAY
from tallywind.session import shared_folder
from tallywind.sinks import bulk, exposition, line_protocol
from tallywind.sources import journal as J
from tallywind.sources.containers import container_facts
from tallywind.sources.json_events import parse_json_events
from tallywind.sources.packets import kafka_packets, read_lines
from tallywind.streaming import fanout, progress, stateful, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def _tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name)).alias(name)


def _start() -> Column:
    return F.unix_seconds("win_start").alias("win_start")


def _r(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def _total() -> Column:
    """Mean as a sum: sums of two-decimal values round alike in any order of addition, means may not."""
    return F.round(F.col("mean") * F.col("count"), 4).alias("total")


def _samples(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return parse_statsd(I.statsd_lines(I.events(spark, folder), kind))


_DAY = "CAST(epoch(date_trunc('day', ts)) AS BIGINT)"

# Samples and their aggregates ------------------------------------------------------------------

_COUNTERS = f"""
SELECT event_type AS name, 'u' || user_id AS user, {_DAY} AS win_start,
  round(sum(value / CASE WHEN event_id % 2 = 1 THEN 0.5 ELSE 1 END), 4) AS per_day,
  round(sum(value / CASE WHEN event_id % 2 = 1 THEN 0.5 ELSE 1 END), 4) AS count,
  CAST({_DAY} + 86400 AS DOUBLE) AS ts
FROM events GROUP BY ALL"""


def _counter_columns(df: DataFrame) -> DataFrame:
    per_day = F.round(F.col("rate") * DAY, 4).alias("per_day")
    return df.select(_tag("name"), _tag("user"), _start(), per_day, F.round("count", 4).alias("count"), "ts")


@query(_COUNTERS)
def counters(spark, folder):
    return _counter_columns(A.agg_counters(_samples(spark, folder, "c"), DAY))


_GAUGES = f"""
WITH e AS (SELECT *, {_DAY} AS win_start, event_id % 3 = 0 AS delta FROM events),
s AS (SELECT *, sum(CASE WHEN delta THEN 0 ELSE 1 END) OVER (PARTITION BY event_type, user_id, win_start ORDER BY event_id) AS seg FROM e),
m AS (SELECT *, max(seg) OVER (PARTITION BY event_type, user_id, win_start) AS last_seg FROM s)
SELECT event_type AS name, 'u' || user_id AS user, win_start, round(sum(value), 6) AS value FROM m WHERE seg = last_seg GROUP BY ALL"""


@query(_GAUGES)
def gauges(spark, folder):
    return A.agg_gauges(_samples(spark, folder, "g"), DAY).select(_tag("name"), _tag("user"), _start(), _r("value"))


_SETS = f"""
SELECT event_type AS name, 'u' || user_id AS user, {_DAY} AS win_start, count(DISTINCT event_id % 7) AS count
FROM events GROUP BY ALL"""


@query(_SETS)
def sets(spark, folder):
    return A.agg_sets(_samples(spark, folder, "s"), DAY).select(_tag("name"), _tag("user"), _start(), "count")


@query(_SETS)
def sketched_sets(spark, folder):
    """Sets as sketches, which hold the few values of these sets as they are."""
    return A.agg_sets(_samples(spark, folder, "s"), DAY, approx=True).select(_tag("name"), _tag("user"), _start(), "count")


@query(f"""
WITH e AS (SELECT event_type AS name, {_DAY} AS win_start, count(*) AS count, max(event_id) AS last FROM events GROUP BY ALL)
SELECT name, win_start, CAST(count AS DOUBLE) AS count,
  CASE WHEN last % 3 = 0 THEN round(epoch(ts), 3) - 60 ELSE CAST(win_start + 86400 AS DOUBLE) END AS ts
FROM e JOIN events ON event_id = last""")
def counters_with_times(spark, folder):
    """Every third sample has a time of its own: it labels the window if that sample is the last one, and is forgotten with the next."""
    df = I.events(spark, folder)
    own = (F.round(epoch(F.col("recv_ts")), 3) - 60).cast("decimal(18,3)").cast("string")
    tag = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("|#timestamp="), own)).otherwise(F.lit(""))
    samples = parse_statsd(I.as_lines(df, F.concat("event_type", F.lit(":1|c"), tag)))
    return A.agg_counters(samples, DAY).select(_tag("name"), _start(), "count", F.round("ts", 3).alias("ts"))


_TIMERS = f"""
WITH e AS (SELECT event_type, value, {_DAY} AS win_start FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, win_start ORDER BY value) AS rn,
        count(*) OVER (PARTITION BY event_type, win_start) AS n FROM e),
t AS (SELECT unnest([50.0, 90.0, 99.5, 100.0]) AS threshold),
x AS (SELECT *, CASE WHEN threshold = 100 THEN n ELSE greatest(1, CAST(floor(CAST(threshold AS DOUBLE) * n / 100) AS BIGINT)) END AS nt FROM r, t)
SELECT event_type AS name, win_start, CAST(CAST(threshold AS DOUBLE) AS VARCHAR) AS percentile, count(*) AS count,
  round(count(*) / 86400, 6) AS count_ps, min(value) AS lower, max(value) AS upper, round(avg(value) * count(*), 4) AS total,
  round(stddev_samp(value), 6) AS stdev
FROM x WHERE rn <= nt GROUP BY event_type, win_start, threshold"""


def _timer_lines(spark, folder):
    df = I.events(spark, folder)
    return I.as_lines(df, F.concat("event_type", F.lit(":"), F.col("value").cast("string"), F.lit("|ms")))


def _timer_columns(df: DataFrame) -> DataFrame:
    return df.select(
        _tag("name"), _start(), _tag("percentile"), "count", _r("count_ps"), "lower", "upper", _total(), _r("stdev")
    )


@query(_TIMERS)
def timers(spark, folder):
    samples = parse_statsd(_timer_lines(spark, folder))
    return _timer_columns(A.agg_timers(samples, [50, 90, 99.5, 100, 101], DAY))


@query(_TIMERS)
def timers_large_groups(spark, folder):
    """The same with finer value slices, 64 to a doubling."""
    samples = parse_statsd(_timer_lines(spark, folder))
    return _timer_columns(A.agg_timers(samples, [50, 90, 99.5, 100], DAY, slices=6))


_HISTOGRAMS = f"""
SELECT event_type AS name, 'u' || user_id AS user, {_DAY} AS win_start,
  CASE WHEN event_type = 'click' THEN 'all' WHEN value < 10 THEN 'low' ELSE 'mid' END AS histogram,
  count(*) AS count, round(count(*) / 86400, 6) AS count_ps, min(value) AS lower, max(value) AS upper,
  round(avg(value) * count(*), 4) AS total, round(stddev_samp(value), 6) AS stdev
FROM events WHERE event_type = 'click' OR (event_type != 'error' AND value < 50) GROUP BY ALL"""


def _histogram_columns(df: DataFrame) -> DataFrame:
    return df.select(
        _tag("name"), _tag("user"), _start(), _tag("histogram"), "count", _r("count_ps"), "lower", "upper", _total(), _r("stdev")
    )


@query(_HISTOGRAMS)
def histograms(spark, folder):
    bins = binned_by(
        BinSpec([("all", None)], {"name": "click"}), BinSpec([("", None)], {"name": "error"}), BinSpec([("low", 10.0), ("mid", 50.0)])
    )
    return _histogram_columns(A.agg_histograms(_samples(spark, folder, "h"), bins, DAY))


@query(_HISTOGRAMS)
def histograms_by_function(spark, folder):
    def selector(tags):
        if tags["name"] == "click":
            return lambda v: "all"
        if tags["name"] == "error":
            return None
        return lambda v: "low" if v < 10 else "mid" if v < 50 else None

    return _histogram_columns(A.agg_histograms(_samples(spark, folder, "ms"), binned_by_function(selector), DAY))


def _odd_lines(spark, folder):
    """Well and badly formed lines, by event number."""
    n = F.col("event_id") % 10
    value = F.col("value").cast("string")
    line = (
        F.when(n == 0, F.concat(F.lit("m:"), value, F.lit("|g|#user:u"), "user_id"))
        .when(n == 1, F.concat(F.lit("m:"), value, F.lit("|g|#a=b\\,c\\\\d,user=u"), "user_id", F.lit(",")))
        .when(n == 2, F.concat(F.lit("m:"), value, F.lit("|c|@1.5")))
        .when(n == 3, F.concat(F.lit("1m:"), value, F.lit("|c")))
        .when(n == 4, F.concat(F.lit("m:"), value, F.lit("|c|#a=b,,c=d")))
        .when(n == 5, F.lit("m:x|ms"))
        .when(n == 6, F.concat(F.lit("sc|m:"), value, F.lit("|c")))
        .when(n == 7, F.concat(F.lit("m:"), value))
        .when(n == 8, F.concat(F.lit("m:"), value, F.lit("|c|#bucket=not-ok")))
        .otherwise(F.concat(F.lit("m:"), value, F.lit("|s|#user=a,user=b,bucket=own")))
    )
    return I.as_lines(I.events(spark, folder), line)


@query("""
SELECT event_id AS seq, CASE event_id % 10 WHEN 9 THEN 'set' ELSE 'gauge' END AS kind,
  CASE event_id % 10 WHEN 9 THEN NULL ELSE value END AS value,
  CASE event_id % 10 WHEN 0 THEN 'name=m,user=u' || user_id WHEN 1 THEN 'a=b,c\\d,name=m,user=u' || user_id
    ELSE 'bucket=own,name=m,user=b' END AS tags
FROM events WHERE event_id % 10 IN (0, 1, 9)""")
def parse_tags(spark, folder):
    return parse_statsd(_odd_lines(spark, folder)).select("seq", "kind", "value", tag_text(F.col("tags")).alias("tags"))


@query("""
SELECT CASE event_id % 10 WHEN 2 THEN 'rate' WHEN 3 THEN 'name' WHEN 4 THEN 'tags' WHEN 5 THEN 'value' WHEN 6 THEN 'service'
  WHEN 7 THEN 'format' WHEN 8 THEN 'bucket' ELSE 'accepted' END AS outcome, count(*) AS lines FROM events GROUP BY ALL""")
def line_outcomes(spark, folder):
    return report.line_report(classify_statsd(_odd_lines(spark, folder)))


@query(f"""
SELECT 'pipeline,dc=x,host=' || h || ' received=' || count(*) || ',rejected=' || count(*) FILTER (event_id % 10 NOT IN (0, 1, 9)) || ',sets='
  || count(*) FILTER (event_id % 10 = 9) || ' ' || {_DAY} + 86400 || '000000000' AS line
FROM (SELECT *, 'h' || event_id % 3 AS h FROM events) GROUP BY h, {_DAY}""")
def pipeline_counters(spark, folder):
    """What became of each host's lines in a day, as line protocol."""
    lines = classify_statsd(_odd_lines(spark, folder))
    rejected = F.col("reject_reason").isNotNull()
    host = F.concat(F.lit("h"), F.col("seq") % 3)
    rows = report.counter_rows(lines, DAY, tags={"host": host}, rejected=rejected, sets=~rejected & (F.col("kind") == "set"))
    return line_protocol.to_line_protocol(enrich.finish_rows(rows, {"dc": "x"})).select("line")


@query("""
WITH e AS (SELECT *, round(epoch(ts) + (event_id % 5 - 2) * 400, 3) AS cust FROM events)
SELECT event_id AS seq, cust AS cust_ts FROM e WHERE abs(epoch(ts) - cust) <= 600""")
def custom_times(spark, folder):
    df = I.events(spark, folder)
    cust = F.round(epoch(F.col("recv_ts")) + (F.col("event_id") % 5 - 2) * 400, 3)
    text = F.when(F.col("event_id") % 2 == 0, cust.cast("decimal(18,3)")).otherwise((cust * 1000).cast("decimal(18,0)"))
    lines = I.as_lines(df, F.concat(F.lit("m:1|c|#timestamp="), text.cast("string")))
    return parse_statsd(lines).select("seq", "cust_ts")


@query("""
SELECT event_id AS packet_id, i AS pos, CASE i WHEN 0 THEN event_type || ':' || user_id || '|c' ELSE 'second:1|c' END AS line
FROM events, (SELECT unnest([0, 2]) AS i) WHERE event_id % 4 != 3""")
def packet_lines(spark, folder):
    """Packets of three lines; every fourth is no UTF-8."""
    return read_lines(_packets(spark, folder, (F.col("event_id") % 4) == 3)).select("packet_id", "pos", "line")


def _packets(spark, folder, odd: Column) -> DataFrame:
    """A packet per event, with two lines that aren't blank; ``odd`` ones are no UTF-8."""
    text = F.concat(F.lit(" "), "event_type", F.lit(":"), "user_id", F.lit("|c\r\n \nsecond:1|c\n"))
    data = F.when(odd, F.unhex(F.lit("61FFFE"))).otherwise(F.encode(text, "UTF-8"))
    return I.events(spark, folder).select(F.col("event_id").alias("packet_id"), "recv_ts", data.alias("data"))


_PACKET_CHUNKS = f"""
WITH l AS (SELECT {_DAY} AS day, event_id, i, CASE i WHEN 0 THEN event_type || ':' || user_id || '|c' ELSE 'second:1|c' END AS line
  FROM events, (SELECT unnest([0, 2]) AS i)),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY event_id, i) AS rn FROM l)
SELECT day, (rn - 1) // 50 AS chunk, count(*) AS rows, string_agg(line, chr(10) ORDER BY rn) AS payload FROM r GROUP BY ALL"""


def _day_chunks(lines: DataFrame, **options) -> DataFrame:
    lines = lines.withColumn("day", F.unix_seconds(F.date_trunc("day", "recv_ts")))
    return limits.pack_chunks(lines, ["day"], 50, **options).select("day", "chunk", "rows", "payload")


@query(_PACKET_CHUNKS)
def packet_chunks(spark, folder):
    """Chunks of the lines of packets, whose arrival numbers lie 2^20 apart, in ranges of about 1,000 lines."""
    return _day_chunks(read_lines(_packets(spark, folder, F.lit(False))), range_rows=1000)


@query(_PACKET_CHUNKS)
def kafka_chunks(spark, folder):
    """The same from records of four partitions with offsets of their own, in ranges of about 5,000 lines."""
    records = _packets(spark, folder, F.lit(False)).select(
        F.pmod("packet_id", F.lit(4)).cast("int").alias("partition"), F.floor(F.col("packet_id") / 4).alias("offset"),
        F.col("recv_ts").alias("timestamp"), F.col("data").alias("value"),
    )
    return _day_chunks(read_lines(kafka_packets(records, 4)), range_rows=5000)


# Events and logs -------------------------------------------------------------------------------


@query("""
SELECT event_id AS seq, 'bool,float,int,null,str' AS types,
  CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_type AS name,
  CASE WHEN event_id % 6 = 0 THEN round(epoch(ts)) - 10 ELSE round(epoch(ts), 3) END AS ts
FROM events WHERE event_id % 6 IN (0, 1, 5)""")
def json_events(spark, folder):
    n = F.col("event_id") % 6
    base = F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "name":"'), "event_type", F.lit('","f":1.5,"n":null,"b":true'))
    line = (
        F.when(n == 0, F.concat(base, F.lit(',"timestamp":'), (F.round(epoch(F.col("recv_ts"))) - 10).cast("bigint").cast("string"), F.lit("}")))
        .when(n == 2, F.concat(base, F.lit("} x"))).when(n == 3, F.concat(base, F.lit(',"list":[1]}')))
        .when(n == 4, F.concat(base, F.lit(',"timestamp":1000}'))).otherwise(F.concat(base, F.lit("}")))
    )
    rows = parse_json_events(I.as_lines(I.events(spark, folder), line))
    types = F.array_join(F.sort_array(F.array_distinct(F.transform(F.map_values("values"), lambda v: v["t"]))), ",")
    return rows.select(
        "seq", types.alias("types"), F.try_element_at("values", F.lit("k"))["v"].alias("k"),
        F.try_element_at("values", F.lit("name"))["v"].alias("name"), "ts",
    )


_JOURNAL = """
WITH j AS (SELECT *, event_id % 7 AS place, event_id // 7 AS block,
  CASE WHEN event_id % 11 != 0 THEN (event_id // 7) % 7 END AS priority FROM events),
k AS (SELECT *, coalesce(priority, 6) AS level FROM j WHERE place != 4 AND coalesce(priority, 6) <= 6)"""
_MESSAGE = """CASE place WHEN 0 THEN 'Traceback (most recent call last):' WHEN 1 THEN '  File "job.py", line 1, in run'
  WHEN 2 THEN 'ValueError: v' || event_id WHEN 3 THEN '{"code":' || event_id || ',"_PID":1,"pid":7}' ELSE 'info ' || event_id END"""
_LEVEL = "CASE WHEN level <= 2 THEN 'critical' WHEN level = 3 THEN 'error' WHEN level = 4 THEN 'warning' WHEN level = 7 THEN 'debug' ELSE 'info' END"


@query(f"""{_JOURNAL}
SELECT event_id AS seq, {_MESSAGE} AS message, CAST(block % 50 AS VARCHAR) AS pid, {_LEVEL} AS level,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'user'
    WHEN event_id % 12 = 0 THEN 'kernel' WHEN event_id % 12 IN (4, 10) THEN 'auth' WHEN event_id % 12 IN (3, 5, 6, 9) THEN 'daemon' ELSE 'user' END AS facility,
  event_id / 10.0 + 1 AS ts FROM k""")
def journal_fields(spark, folder):
    df = logs.with_level_words(J.map_journal_fields(I.journal(I.events(spark, folder))))
    return df.select("seq", "message", "pid", "level", "facility", "ts")


@query(SQL["journal_fields"])
def journal_exports(spark, folder):
    """The same from exported files of one JSON object per line, in which missing fields are left out."""
    work = shared_folder(spark)
    raw = I.journal(I.events(spark, folder))
    raw.withColumn("CURSOR", F.col("seq")).withColumn("__SEQNUM", F.col("seq").cast("string")).drop("recv_ts").write.json(work)
    schema = f"{J.JOURNAL_SCHEMA}, seq bigint"
    df = logs.with_level_words(J.map_journal_fields(J.read_journal(spark, work, schema=schema).withColumn("recv_ts", F.current_timestamp())))
    return df.select("seq", "message", "pid", "level", "facility", "ts")


@query(f"""{_JOURNAL}
SELECT event_id AS seq, place = 3 AS is_json, CASE WHEN place = 3 THEN '_PID=1,code=' || event_id END AS extra FROM k""")
def json_messages(spark, folder):
    df = logs.decode_json_message(J.map_journal_fields(I.journal(I.events(spark, folder))))
    extra = tag_text(F.transform_values("extra", lambda k, v: v["v"]))
    return df.select("seq", "is_json", extra.alias("extra"))


@query("SELECT event_id, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def backfill(spark, folder):
    df = I.events(spark, folder)
    (newest,) = df.agg(F.unix_micros(F.max("recv_ts"))).first()
    return J.since(df, F.timestamp_micros(F.lit(newest)), 3 * DAY, "recv_ts").select("event_id", "value")


_STITCH = f"""
WITH j AS (SELECT event_id, event_id % 7 AS place, event_id // 7 AS block FROM events),
m AS (SELECT *, {_MESSAGE} AS message FROM j WHERE place != 4)
SELECT CAST(block % 50 AS VARCHAR) AS pid, min(event_id) AS seq, string_agg(message, chr(10) ORDER BY event_id) AS message
FROM m GROUP BY block, CASE WHEN place <= 2 THEN 0 ELSE place END"""


def _stitch_input(spark, folder):
    raw = I.journal(I.events(spark, folder)).withColumn("PRIORITY", F.lit("6"))
    return J.map_journal_fields(raw)


@query(_STITCH)
def stitched_traces(spark, folder):
    return stitch(_stitch_input(spark, folder)).select("pid", "seq", "message")


@query(_STITCH)
def stitched_large_streams(spark, folder):
    """The same in pieces of about 50 lines."""
    return stitch(_stitch_input(spark, folder), range_rows=50).select("pid", "seq", "message")


_GRAMMARS = """
WITH j AS (SELECT event_id, event_id % 7 AS place, event_id // 7 AS block, event_id // 7 % 3 AS k FROM events),
m AS (SELECT *, CASE WHEN place > 4 THEN 'info ' || event_id WHEN k = 0 THEN CASE place WHEN 0 THEN 'Exception in thread "w": e' || event_id
    WHEN 3 THEN chr(9) || '... 2 more' WHEN 4 THEN 'done' ELSE chr(9) || 'at app.Job.run(Job.java:7)' END
  WHEN k = 1 THEN CASE place WHEN 0 THEN '/srv/job.js:12' WHEN 1 THEN '  run(x)' WHEN 2 THEN '  ^' WHEN 3 THEN 'TypeError: e' || event_id
    ELSE '    at run (/srv/job.js:12)' END
  ELSE CASE place WHEN 0 THEN 'BEGIN e' || event_id WHEN 3 THEN 'END' WHEN 4 THEN 'done' ELSE 'STEP' END END AS message FROM j)
SELECT CAST(block % 50 AS VARCHAR) AS pid, min(event_id) AS seq, string_agg(message, chr(10) ORDER BY event_id) AS message
FROM m GROUP BY block, CASE WHEN place <= CASE k WHEN 1 THEN 4 ELSE 3 END THEN 0 ELSE place END"""


@query(_GRAMMARS)
def stitched_grammars(spark, folder):
    """Traces of two more languages and of an own grammar."""
    own = Grammar([("BEGIN ", "open")], {"open": State([("STEP", "open"), ("END", "closed")]), "closed": State([])})
    n, place, kind = F.col("seq"), F.col("seq") % 7, F.floor(F.col("seq") / 7) % 3
    traces = [
        [F.concat(F.lit('Exception in thread "w": e'), n), "\tat app.Job.run(Job.java:7)", "\tat app.Job.run(Job.java:7)", "\t... 2 more", "done"],
        ["/srv/job.js:12", "  run(x)", "  ^", F.concat(F.lit("TypeError: e"), n), "    at run (/srv/job.js:12)"],
        [F.concat(F.lit("BEGIN e"), n), "STEP", "STEP", "END", "done"],
    ]
    texts = F.array(*[F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines]) for lines in traces])
    message = F.coalesce(F.get(F.get(texts, kind.cast("int")), place.cast("int")), F.concat(F.lit("info "), n))
    raw = I.journal(I.events(spark, folder)).withColumns({"PRIORITY": F.lit("6"), "MESSAGE": message})
    return stitch(J.map_journal_fields(raw), grammars=(*GRAMMARS, own)).select("pid", "seq", "message")


_JOURNAL_LOGS = f"""{_STITCH.replace("place != 4", "place NOT IN (3, 4)")}
UNION ALL SELECT CAST(event_id // 7 % 50 AS VARCHAR), event_id, NULL FROM events WHERE event_id % 7 = 3"""


@query(_JOURNAL_LOGS)
def journal_logs(spark, folder):
    """Journal to finished log rows, JSON messages decoded."""
    raw = I.journal(I.events(spark, folder)).withColumn("PRIORITY", F.lit("6"))
    rows = flows.journal_rows(raw, decode_json=True, trace_level="ERROR")
    field = lambda name: F.try_element_at("values", F.lit(name))["v"].alias(name)
    return rows.select(field("pid"), "seq", field("message"))


# Enrichment and routing ------------------------------------------------------------------------


@query("""
SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'moved' ELSE event_type END AS bucket,
  'blank=,dc=' || CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'static' END || ',kind=' || event_type || ' a,b=c",user=u' || user_id AS tags
FROM events WHERE value >= 1""")
def enriched(spark, folder):
    df = I.metric_events(I.events(spark, folder))
    own = F.when(F.col("seq") % 2 == 0, F.map_concat("tags", F.create_map(F.lit("dc"), F.lit("own")))).otherwise(F.col("tags"))
    df = df.withColumn("tags", own)
    move = F.when(F.col("seq") % 3 == 0, F.map_concat("tags", F.create_map(F.lit("bucket"), F.lit("moved")))).otherwise(F.col("tags"))
    df = df.withColumn("tags", move)
    big = F.try_element_at("values", F.lit("value"))["v"].cast("double") >= 1
    return enrich.finish_rows(df, {"dc": "static"}, lambda rows: rows.where(big)).select("seq", "bucket", tag_text(F.col("tags")).alias("tags"))


@query("SELECT 'hooked_' || event_type AS bucket, CAST(event_id AS VARCHAR) AS id, value * 2 AS value FROM events WHERE event_id % 2 = 0")
def row_hooks(spark, folder):
    def hook(bucket, values, ts, tags):
        if not values["even"]:
            return None
        return "hooked_" + bucket, {"id": values["id"], "value": values["value"] * 2}, ts, tags

    rows = enrich.finish_rows(I.metric_events(I.events(spark, folder)), None, enrich.row_hook(hook))
    field = lambda name: F.try_element_at("values", F.lit(name))["v"]
    return rows.select("bucket", field("id").alias("id"), field("value").cast("double").alias("value"))


@query("""
SELECT destination, event_type AS source, count(*) AS rows FROM events,
  (SELECT unnest(['d1', 'd2']) AS destination) WHERE NOT (event_type = 'click' AND destination = 'd1') GROUP BY ALL""")
def routed(spark, folder):
    df = I.events(spark, folder).withColumn("source", F.col("event_type"))
    plan = enrich.routes({"click": ["d2"], "view": None}, ["d1", "d2"])  # the other types aren't listed
    return enrich.route(df, plan, ["d1", "d2"]).groupBy("destination", "source").agg(F.count("*").alias("rows"))


_FAMILIES = f"""
WITH e AS (SELECT *, {_DAY} AS d FROM events)
SELECT 'stats_counters' AS bucket, event_type AS name, d AS day, round(sum(value), 6) AS value FROM e GROUP BY ALL
UNION ALL SELECT 'stats_gauges', event_type, d, max_by(value, event_id) FROM e GROUP BY ALL
UNION ALL SELECT 'stats_sets', event_type, d, count(DISTINCT value) FROM e GROUP BY ALL
UNION ALL SELECT 'stats_timers', event_type, d, count(*) FROM e GROUP BY ALL
UNION ALL SELECT 'stats_histograms', event_type, d, count(*) FROM e GROUP BY ALL"""


@query(_FAMILIES)
def families(spark, folder):
    """All five families of one flush, as metric rows."""
    df = I.events(spark, folder)
    kinds = F.array(*[F.lit(k) for k in ("c", "g", "s", "ms")])
    each = df.withColumn("code", F.explode(kinds))
    lines = I.as_lines(each, F.concat("event_type", F.lit(":"), F.col("value").cast("string"), F.lit("|"), "code"))
    settings = flows.StatsdSettings(
        interval=DAY, percentile_thresholds=(100.0,), histogram_bins=binned_by(BinSpec([("all", None)])), add_timestamps=True
    )
    rows = flows.statsd_flush(flows.landed(parse_statsd(lines)), settings)
    field = lambda name: F.try_element_at("values", F.lit(name))["v"].cast("double")
    return rows.select(
        "bucket", _tag("name"), (F.col("ts") - DAY).cast("bigint").alias("day"),
        F.round(F.coalesce(field("count"), field("value")), 6).alias("value"),
    )


# Sinks -----------------------------------------------------------------------------------------

_SERIES = """event_type || '{blank="",kind="' || event_type || ' a,b=c\\"",user="u' || user_id || '",value="' || f || '"}'"""
_EXPOSED = f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS rn FROM events),
x AS (SELECT *, unnest(['value', 'id', 'even']) AS f FROM e WHERE rn = 1)
SELECT {_SERIES} AS series, {_SERIES} || ' ' ||
  CASE f WHEN 'value' THEN CAST(value AS VARCHAR) WHEN 'id' THEN CAST(event_id AS VARCHAR) ELSE CAST((event_id % 2 = 0)::INT AS VARCHAR) END
  || ' ' || CAST(trunc(epoch(ts) * 1000) AS BIGINT) AS line
FROM x"""


@query(_EXPOSED)
def exposed(spark, folder):
    return exposition.to_exposition(I.metric_events(I.events(spark, folder)))


@query(f"{_EXPOSED} WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) <= 172800")
def exposed_with_ttl(spark, folder):
    df = I.events(spark, folder)
    (newest,) = df.agg(F.max(epoch(F.col("recv_ts")))).first()
    lines = exposition.exposition_lines(I.metric_events(df))
    return exposition.latest_series(exposition.expire(lines, F.lit(newest), 2 * DAY)).select("series", "line")


@query("""
SELECT event_type, user_id, max(event_id) AS seq, max_by(value, event_id) AS value FROM events GROUP BY ALL""")
def latest_values(spark, folder):
    df = I.events(spark, folder).select("event_type", "user_id", "recv_ts", "seq", "value")
    return exposition.latest_series(df, ["event_type", "user_id"]).select("event_type", "user_id", "seq", "value")


@query("""
SELECT event_id AS seq, event_type || ',kind=' || event_type || '\\ a\\,b\\=c",user=u' || user_id || ' even='
  || CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END || ',id=' || event_id || ',note="say \\"' || event_type || '\\"",value='
  || CAST(value AS VARCHAR) || ' ' || CAST(trunc(epoch(ts) * 1000000000) AS BIGINT) AS line
FROM events""")
def line_texts(spark, folder):
    return line_protocol.to_line_protocol(I.metric_events(I.events(spark, folder))).select("seq", "line")


_DOCS = """
WITH d AS (SELECT *, '{"blank":"","bucket":"' || event_type || '","even":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
  || ',"id":' || event_id || ',"kind":"' || event_type || ' a,b=c\\"","none":null,"note":"say \\"' || event_type || '\\"","timestamp":'
  || CAST(round_even(epoch(ts) * 1000, 0) AS BIGINT) || ',"user":"u' || user_id || '","value":' || CAST(value AS VARCHAR) || '}' AS doc FROM events),
h AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc)) AS x FROM d)
SELECT 'm-' || strftime(ts, '%Y-%m-%d') AS index, doc, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-'
  || translate(substr(x, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS id
FROM h"""


@query(_DOCS)
def bulk_documents(spark, folder):
    """Every event is delivered twice and stored once."""
    rows = I.metric_events(I.events(spark, folder))
    docs = bulk.to_bulk(rows.unionByName(rows), bulk.daily_index("m"))
    return bulk.dedupe_bulk(docs).select("index", "doc", "id")


_DOC_TEXTS = r"""
WITH d AS (SELECT source, lang, n_chars, CAST(CASE doc_id WHEN 0 THEN 1704067200000 ELSE doc_id * 1000 END AS VARCHAR) AS millis,
  array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE WHEN c IN ('"', '\') THEN '\' || c
    WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN c = chr(8) THEN '\b' WHEN c = chr(12) THEN '\f'
    WHEN ord(c) BETWEEN 32 AND 126 THEN c WHEN ord(c) < 65536 THEN '\u' || lpad(lower(hex(ord(c))), 4, '0')
    ELSE '\u' || lower(hex(55296 + (ord(c) - 65536) // 1024)) || '\u' || lower(hex(56320 + (ord(c) - 65536) % 1024)) END), '') AS t FROM documents),
h AS (SELECT source AS index, '{"bucket":"' || source || '","lang":"' || lang || '","n":' || n_chars || ',"text":"' || t || '","timestamp":' || millis || '}' AS doc FROM d),
s AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc)) AS x FROM h),
i AS (SELECT index, doc, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-'
  || translate(substr(x, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS id FROM s)
SELECT *, '{"index":{"_index":"' || index || '","_id":"' || id || '"}}' AS action FROM i"""


@query(_DOC_TEXTS)
def bulk_texts(spark, folder):
    """Whole documents in four languages as bulk documents with ASCII JSON and content ids."""
    df = I.table(spark, folder, "documents")
    values = F.create_map(F.lit("text"), enrich.typed_value(F.col("text"), "string"), F.lit("n"), enrich.typed_value(F.col("n_chars"), "bigint"))
    rows = df.select(
        F.col("source").alias("bucket"), values.alias("values"), F.col("doc_id").cast("double").alias("ts"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("tags"), utc(F.lit("2024-01-01").cast("timestamp_ntz")).alias("recv_ts"),
    )
    return bulk.to_bulk(rows)


@query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS rn, count(*) OVER () AS n FROM events)
SELECT event_id, value FROM r WHERE n <= 1000 OR rn <= 500""")
def newest_rows(spark, folder):
    return limits.cap_newest(I.events(spark, folder).select("seq", "event_id", "value"), 1000).select("event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 300")
def pushed_rows(spark, folder):
    return limits.push_limit(I.events(spark, folder), 300).select("event_id", "value")


@query(f"""
WITH r AS (SELECT *, {_DAY} AS day, row_number() OVER (PARTITION BY {_DAY} ORDER BY event_id) AS rn FROM events)
SELECT day, (rn - 1) // 50 AS chunk, count(*) AS rows, string_agg(event_type || ':' || event_id, chr(10) ORDER BY event_id) AS payload
FROM r GROUP BY ALL""")
def chunks(spark, folder):
    df = I.events(spark, folder).withColumn("day", F.unix_seconds(F.date_trunc("day", "recv_ts")))
    packed = limits.pack_chunks(df, ["day"], 50, F.concat("event_type", F.lit(":"), "event_id"))
    return packed.select("day", "chunk", "rows", "payload")


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT ELSE 0 END AS rejected FROM events""")
def bulk_responses(spark, folder):
    status = lambda n: F.when(F.col("event_id") % n == 0, F.lit("400")).otherwise(F.lit("201"))
    body = F.concat(
        F.lit('{"errors":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit(',"items":[{"index":{"status":'), status(3),
        F.lit('}},{"create":{"status":'), status(5), F.lit("}}]}"),
    )
    return report.bulk_rejects(I.events(spark, folder).select("event_id", body.alias("body"))).select("event_id", "rejected")


# Hosts and containers --------------------------------------------------------------------------

_ORDERS = "(SELECT 'h' || o_custkey AS host, CAST(o_orderkey AS DOUBLE) AS ts, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders)"


@query(f"""SELECT host, ts, 'eth0' AS name, p AS rx_bytes, k AS rx_packets, 1::BIGINT AS rx_errors, 2::BIGINT AS rx_dropped,
  k AS tx_bytes, 5::BIGINT AS tx_packets, 6::BIGINT AS tx_errors, 7::BIGINT AS tx_dropped FROM {_ORDERS}""")
def host_interfaces(spark, folder):
    return hosts.host_interfaces(I.snapshots(spark, folder), deny=["lo"])


@query(f"SELECT host, ts, p * 1024 AS total_bytes, k * 1024 AS free_bytes, 7168::BIGINT AS cached_bytes FROM {_ORDERS}")
def host_memory(spark, folder):
    return hosts.host_memory(I.snapshots(spark, folder)).select("host", "ts", "total_bytes", "free_bytes", "cached_bytes")


@query(f"""SELECT host, ts, 'cpu0' AS name, p AS "user", 2::BIGINT AS nice, 8::BIGINT AS steal FROM {_ORDERS}
UNION ALL SELECT host, ts, 'cpu1', 10, k, NULL FROM {_ORDERS}""")
def host_cpu(spark, folder):
    return hosts.host_cpu(I.snapshots(spark, folder)).select("host", "ts", "name", "user", "nice", "steal")


@query(f"""SELECT host, ts, k AS switches, 99::BIGINT AS forks, 2::BIGINT AS running, p AS interrupts, 0.25::DOUBLE AS load FROM {_ORDERS}""")
def host_activity(spark, folder):
    return hosts.host_activity(I.snapshots(spark, folder))


@query(f"""SELECT host, ts, 'sda' AS name, p AS read_sectors, p * 512 AS read_bytes, 11::BIGINT AS weighted_time,
  NULL::BIGINT AS discard_bytes FROM {_ORDERS}""")
def host_disks(spark, folder):
    rows = hosts.host_disks(I.snapshots(spark, folder), allow=["sd.*"])
    return rows.select("host", "ts", "name", "read_sectors", "read_bytes", "weighted_time", "discard_bytes")


@query(f"""
WITH m AS (SELECT *, 'dc=x,host=' || host AS t, ' ' || (k * 1000000000) AS z FROM {_ORDERS})
SELECT 'system_cpu,dc=x,host=' || host || ',name=cpu0 idle=4,interrupt=6,nice=2,softirq=7,steal=8,system=3,user=' || p || ',wait=5' || z AS line FROM m
UNION ALL SELECT 'system_cpu,dc=x,host=' || host || ',name=cpu1 nice=' || k || ',system=30,user=10' || z FROM m
UNION ALL SELECT 'system_activity,' || t || ' forks=99,interrupts=' || p || ',load=0.25,running=2,switches=' || k || z FROM m
UNION ALL SELECT 'system_memory,' || t || ' cached_bytes=7168,free_bytes=' || (k * 1024) || ',total_bytes=' || (p * 1024) || z FROM m
UNION ALL SELECT 'system_interface,' || t || ',name=eth0 rx_bytes=' || p || ',rx_dropped=2,rx_errors=1,rx_packets=' || k || ',tx_bytes=' || k
  || ',tx_dropped=7,tx_errors=6,tx_packets=5' || z FROM m
UNION ALL SELECT 'system_disk,' || t || ',name=sda in_progress=9,io_time=10,read_bytes=' || (p * 512) || ',read_merged=2,read_ops=1,read_sectors=' || p
  || ',read_time=4,weighted_time=11,write_bytes=3584,write_merged=6,write_ops=5,write_sectors=7,write_time=8' || z FROM m
UNION ALL SELECT 'system_protocol,' || t || ',name=ip rx_bytes=' || k || ',rx_dropped=6,rx_packets=' || p || ',tx_bytes=2000' || z FROM m
UNION ALL SELECT 'system_protocol,' || t || ',name=tcp rx_packets=4,timeouts=9,tx_opens=' || k || z FROM m
UNION ALL SELECT 'system_filesystem,dc=x,device=/dev/d' || l_linenumber || ',host=h' || l_suppkey || ',name=/mnt/' || l_partkey || ',type=ext4 free_bytes='
  || (l_suppkey * 4096) || ',free_inodes=' || l_linenumber || ',total_bytes=' || (l_partkey * 4096) || ',total_inodes=' || (l_orderkey % 5) || ' '
  || (l_orderkey * 1000000000)
FROM lineitem WHERE l_linenumber % 4 != 0 AND l_linenumber % 3 != 0 AND l_orderkey % 5 != 0""")
def host_rows(spark, folder):
    """Captures of hosts to line protocol, through metric rows and static tags."""
    rows = hosts.host_rows(
        I.snapshots(spark, folder), I.mounts(spark, folder), interfaces={"deny": ["lo"]}, disks={"allow": ["sd.*"]}, filesystems={"deny": ["tmpfs", "proc"]}
    )
    return line_protocol.to_line_protocol(enrich.finish_rows(rows, {"dc": "x"})).select("line")


@query(f"""SELECT host, ts, 'ip' AS name, p AS rx_packets, 6::BIGINT AS rx_dropped, k AS rx_bytes, NULL::BIGINT AS tx_opens, NULL::BIGINT AS timeouts FROM {_ORDERS}
UNION ALL SELECT host, ts, 'tcp', 4, NULL, NULL, k, 9 FROM {_ORDERS}""")
def host_protocols(spark, folder):
    rows = hosts.host_protocols(I.snapshots(spark, folder))
    return rows.select("host", "ts", "name", "rx_packets", "rx_dropped", "rx_bytes", "tx_opens", "timeouts")


@query("""SELECT 'h' || l_suppkey AS host, CAST(l_orderkey AS DOUBLE) AS ts, '/dev/d' || l_linenumber AS device, '/mnt/' || l_partkey AS name,
  l_suppkey * 4096 AS free_bytes, l_partkey * 4096 AS total_bytes, CAST(l_linenumber AS BIGINT) AS free_inodes, l_orderkey % 5 AS total_inodes
FROM lineitem WHERE l_linenumber % 4 != 0 AND l_linenumber % 3 != 0 AND l_orderkey % 5 != 0""")
def host_filesystems(spark, folder):
    return hosts.host_filesystems(I.mounts(spark, folder), deny=["tmpfs", "proc"]).drop("type")


def _facts(spark, folder):
    containers, inspect, cgroup, memory = I.container_tables(spark, folder)
    return C.container_tags(container_facts(containers, inspect, cgroup), {"APP": "app", "BAD": "bad"}), memory


_PARTS = """(SELECT *, md5(CAST(p_partkey AS VARCHAR)) AS id, 'h' || (p_partkey % 10) AS host FROM part WHERE p_partkey % 5 != 0)"""
_CTAGS = "'app=app' || p_size || ',docker_id=' || substr(id, 1, 12) || ',docker_name=/part' || p_partkey"


@query(f"SELECT host, id, {_CTAGS} || ',team=t' || p_size AS tags FROM {_PARTS}")
def container_tags(spark, folder):
    return C.with_tag_text(_facts(spark, folder)[0]).select("host", "id", "tags")


@query(f"SELECT host, id, p_partkey AS total_bytes, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) ELSE 0 END AS used_bytes FROM {_PARTS}")
def container_filesystems(spark, folder):
    return C.container_fs(_facts(spark, folder)[0]).select("host", "id", "total_bytes", "used_bytes")


@query(f"""SELECT host, id, {_CTAGS} || ',name=cpu' || i || ',team=t' || p_size AS tags,
  CASE i WHEN 0 THEN p_partkey ELSE CAST(p_size AS BIGINT) END AS usage, NULL::BIGINT AS limit_ps FROM {_PARTS}, (SELECT unnest([0, 1]) AS i)
UNION ALL SELECT host, id, {_CTAGS} || ',team=t' || p_size, NULL,
  CASE WHEN p_partkey % 3 = 0 AND p_partkey > 0 THEN p_partkey * 1000 WHEN p_partkey % 3 = 0 THEN 2000000000
    ELSE CAST(round_even(1000000000.0::DOUBLE * p_size * 1000 / 300000, 0) AS BIGINT) END FROM {_PARTS}""")
def container_processors(spark, folder):
    return C.with_tag_text(C.container_cpu(_facts(spark, folder)[0])).select("host", "id", "tags", "usage", "limit_ps")


@query(f"""SELECT q.host, id, p_partkey AS used_bytes, CASE WHEN p_partkey % 4 = 0 OR p_partkey = 0 THEN m.total ELSE p_partkey END AS limit_bytes
FROM {_PARTS} q JOIN (SELECT 'h' || (p_partkey % 10) AS host, count(*) * 1000 AS total FROM part GROUP BY ALL) m ON q.host = m.host""")
def container_memory(spark, folder):
    facts, memory = _facts(spark, folder)
    return C.container_memory(facts, memory).select("host", "id", "used_bytes", "limit_bytes")


@query(f"SELECT host, id, 'eth0' AS name, p_partkey AS rx_bytes, CAST(p_size AS BIGINT) AS tx_bytes FROM {_PARTS}")
def container_interfaces(spark, folder):
    return C.container_interfaces(_facts(spark, folder)[0]).select("host", "id", "name", "rx_bytes", "tx_bytes")


@query(f"""
WITH c AS (SELECT *, 'app=app' || p_size || ',dc=x,docker_id=' || substr(id, 1, 12) || ',docker_name=/part' || p_partkey || ',host=' || host AS t,
  ',team=t' || p_size AS e, ' 1000000000' AS z FROM {_PARTS})
SELECT 'docker_filesystem,' || t || e || ' total_bytes=' || p_partkey || ',used_bytes=' || CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END || z AS line FROM c
UNION ALL SELECT 'docker_cpu,' || t || ',name=cpu' || i || e || ' usage=' || CASE i WHEN 0 THEN p_partkey ELSE p_size END || z FROM c, (SELECT unnest([0, 1]) AS i)
UNION ALL SELECT 'docker_cpu,' || t || e || ' limit_ps=' || CASE WHEN p_partkey % 3 = 0 AND p_partkey > 0 THEN p_partkey * 1000
  WHEN p_partkey % 3 = 0 THEN 2000000000 ELSE CAST(round_even(1000000000.0::DOUBLE * p_size * 1000 / 300000, 0) AS BIGINT) END || z FROM c
UNION ALL SELECT 'docker_interface,' || t || ',name=eth0' || e || ' rx_bytes=' || p_partkey || ',rx_dropped=3,rx_errors=2,rx_packets=1,tx_bytes=' || p_size
  || ',tx_dropped=7,tx_errors=6,tx_packets=5' || z FROM c
UNION ALL SELECT 'docker_memory,' || t || e || ' limit_bytes=' || CASE WHEN p_partkey % 4 = 0 OR p_partkey = 0 THEN m.total ELSE p_partkey END
  || ',used_bytes=' || p_partkey || z
FROM c JOIN (SELECT 'h' || (p_partkey % 10) AS host, count(*) * 1000 AS total FROM part GROUP BY ALL) m ON c.host = m.host""")
def container_rows(spark, folder):
    """Captures of containers to line protocol, through metric rows and static tags."""
    rows = C.container_rows(*_facts(spark, folder))
    return line_protocol.to_line_protocol(enrich.finish_rows(rows, {"dc": "x"})).select("line")


# Streams ---------------------------------------------------------------------------------------


def _run_stream(spark: SparkSession, folder: str, kind: str, family: windows.Family) -> DataFrame:
    """The events table as a stream of two halves and an end marker, with a restart before each; results of all its windows."""
    work = shared_folder(spark)
    events = I.events(spark, folder)
    at = epoch(F.col("recv_ts"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    early = F.coalesce(at < F.lit((first + last) / 2), F.lit(False))
    for part in (events.where(early), events.where(~early), windows.end_marker(events, last)):
        part.write.mode("append").parquet(f"{work}/events")
        samples = parse_statsd(I.statsd_lines(spark.readStream.schema(events.schema).parquet(f"{work}/events"), kind))
        windows.start_windows(samples, family, 3600.0, f"{work}/checkpoint", windows.parquet_sink(f"{work}/out")).awaitTermination()
    return spark.read.parquet(f"{work}/out")


@query(_COUNTERS)
def stream_counters(spark, folder):
    return _counter_columns(_run_stream(spark, folder, "c", windows.counters(DAY)))


@query(_GAUGES)
def stream_gauges(spark, folder):
    return _run_stream(spark, folder, "g", windows.gauges(DAY)).select(_tag("name"), _tag("user"), _start(), _r("value"))


@query(_SETS)
def stream_sets(spark, folder):
    return _run_stream(spark, folder, "s", windows.sets(DAY)).select(_tag("name"), _tag("user"), _start(), "count")


@query(_SETS)
def stream_sketched_sets(spark, folder):
    return _run_stream(spark, folder, "s", windows.sets(DAY, approx=True)).select(_tag("name"), _tag("user"), _start(), "count")


@query(
    _TIMERS.replace("SELECT event_type, value", "SELECT event_type || ',u' || user_id AS event_type, value")
    .replace("event_type AS name, win_start", "split_part(event_type, ',', 1) AS name, split_part(event_type, ',', 2) AS user, win_start")
)
def stream_timers(spark, folder):
    out = _run_stream(spark, folder, "ms", windows.timers([50, 90, 99.5, 100], DAY))
    return out.select(
        _tag("name"), _tag("user"), _start(), _tag("percentile"), "count", _r("count_ps"), "lower", "upper", _total(), _r("stdev")
    )


@query(_HISTOGRAMS)
def stream_histograms(spark, folder):
    bins = binned_by(
        BinSpec([("all", None)], {"name": "click"}), BinSpec([("", None)], {"name": "error"}), BinSpec([("low", 10.0), ("mid", 50.0)])
    )
    return _histogram_columns(_run_stream(spark, folder, "h", windows.histograms(bins, DAY)))


def _in_parts(spark: SparkSession, work: str, parts: list[DataFrame], start: Callable[[DataFrame], object]) -> None:
    """Each of ``parts`` arrives as new files of one stream; the query is started anew for each and runs until it has read them."""
    for part in parts:
        part.write.mode("append").parquet(f"{work}/in")
        start(spark.readStream.schema(part.schema).parquet(f"{work}/in")).awaitTermination()


def _halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows up to the middle arrival number, and the others."""
    (last,) = df.agg(F.max("seq")).first()
    early = F.col("seq") <= F.lit((last or 0) // 2)
    return df.where(early), df.where(~early)


@query(f"{_EXPOSED} WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) <= 172800")
def stream_latest(spark, folder):
    """Newest lines with a time to live: what is left on the page after all changes that the stream sent."""
    work = shared_folder(spark)

    def start(events: DataFrame):
        changes = stateful.latest_lines(exposition.exposition_lines(I.metric_events(events)), 2 * DAY)
        writer = changes.writeStream.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True)
        return writer.foreachBatch(windows.parquet_sink(f"{work}/out")).start()

    _in_parts(spark, work, list(_halves(I.events(spark, folder))), start)
    order = F.struct("batch", (F.col("event") == "drop"))
    page = spark.read.parquet(f"{work}/out").groupBy("series").agg(F.max_by(F.struct("line", "event"), order).alias("last"))
    return page.where("last.event = 'set'").select("series", "last.line")


@query(f"""SELECT *, CASE WHEN message LIKE 'Trace%' THEN 'error' ELSE 'info' END AS level
FROM ({_JOURNAL_LOGS})""")
def stream_journal(spark, folder):
    """Journal to log rows on a stream whose first half ends within traces; an end marker lets the open ones go."""
    work = shared_folder(spark)
    raw = I.journal(I.events(spark, folder)).withColumn("PRIORITY", F.lit("6"))
    raw = raw.withColumn("recv_ts", F.timestamp_micros(F.col("seq") * 100000 + 1000000))
    early, late = _halves(raw)
    end = windows.end_marker(raw, 0.0, after=1e8).withColumns({"seq": F.lit(-1).cast("bigint"), "MESSAGE": F.lit("end"), "_PID": F.lit("end")})

    def start(lines: DataFrame):
        rows = flows.journal_rows(lines, decode_json=True, trace_level="ERROR")
        writer = rows.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint")
        return writer.trigger(availableNow=True).start()

    _in_parts(spark, work, [early, late, end], start)
    field = lambda name: F.try_element_at("values", F.lit(name))["v"].alias(name)
    return spark.read.parquet(f"{work}/out").where("seq >= 0").select(field("pid"), "seq", field("message"), field("level"))


@query(SQL["routed"])
def stream_routed(spark, folder):
    """The events as a stream into two destinations."""
    work = shared_folder(spark)
    sinks = {name: windows.parquet_sink(f"{work}/out/destination={name}") for name in ("d1", "d2")}

    def start(events: DataFrame):
        rows = events.withColumn("source", F.col("event_type"))
        return fanout.start_fanout(rows, enrich.routes({"click": ["d2"], "view": None}, list(sinks)), sinks, f"{work}/checkpoint")

    _in_parts(spark, work, list(_halves(I.events(spark, folder))), start)
    return spark.read.parquet(f"{work}/out").groupBy("destination", "source").agg(F.count("*").alias("rows"))


@query(_DOCS)
def stream_bulk(spark, folder):
    """Events as bulk documents on a stream; the first half is delivered again together with the second, and stored once."""
    work = shared_folder(spark)
    early, late = _halves(I.events(spark, folder))

    def start(events: DataFrame):
        docs = bulk.dedupe_bulk(bulk.to_bulk(I.metric_events(events), bulk.daily_index("m"), keep=["recv_ts"]), 60 * DAY)
        writer = docs.writeStream.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True)
        return writer.foreachBatch(windows.parquet_sink(f"{work}/out")).start()

    _in_parts(spark, work, [early, early.unionByName(late)], start)
    return spark.read.parquet(f"{work}/out").select("index", "doc", "id")


@query("""
WITH e AS (SELECT *, (event_id > (SELECT max(event_id) FROM events) // 2)::INT AS late, event_id % 10 AS n FROM events)
SELECT CAST(late AS VARCHAR) AS batch, count(*) AS rows, count(*) FILTER (n NOT IN (0, 1, 9)) AS dropped,
  count(*) FILTER (n IN (0, 1, 9)) AS sent, count(*) FILTER (n = 9) AS sets
FROM e GROUP BY late""")
def stream_counts(spark, folder):
    """What became of the lines of each micro-batch, as metric rows from the progress of the query."""
    work, reports = shared_folder(spark), []

    def start(lines: DataFrame):
        rejected = F.col("reject_reason").isNotNull()
        seen, _ = report.observed(classify_statsd(lines), "lines", dropped=rejected, sent=~rejected, sets=~rejected & (F.col("kind") == "set"))
        writer = seen.where(~rejected).select("seq").writeStream.format("parquet").option("path", f"{work}/out")
        query = writer.queryName("lines").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        reports.extend(filter(None, (progress.batch_counts(json.loads(p.json), "lines") for p in query.recentProgress)))
        return query

    _in_parts(spark, work, list(_halves(_odd_lines(spark, folder))), start)
    rows = progress.count_rows(spark, reports)
    field = lambda name: F.try_element_at("values", F.lit(name))["v"].cast("bigint").alias(name)
    return rows.select(F.col("tags")["batch"].alias("batch"), *[field(n) for n in ("rows", "dropped", "sent", "sets")])
