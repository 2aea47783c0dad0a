"""The three flows from raw input to encoded output, composed of the operators.

All of them are plain DataFrame transforms. Only :func:`statsd_exposition` runs a job when it is called: it lands the samples.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.operators import aggregate as A
from tallywind.operators import logs
from tallywind.operators.enrich import finish_rows, to_metric_rows, union_all
from tallywind.operators.stitch import GRAMMARS, stitch
from tallywind.operators.statsd import parse_statsd
from tallywind.session import shared_folder
from tallywind.sinks.bulk import to_bulk
from tallywind.sinks.exposition import to_exposition
from tallywind.sources.journal import map_journal_fields, threshold
from tallywind.sources.json_events import parse_json_events
from tallywind.streaming.stateful import stitch_stream

# Value fields per family, in metric rows.
FIELDS = {
    "counters": ["rate", "count"],
    "gauges": ["value"],
    "sets": ["count"],
    "timers": ["count", "count_ps", "lower", "upper", "mean", "stdev"],
    "histograms": ["count", "count_ps", "lower", "upper", "mean", "stdev"],
}


@dataclass(frozen=True)
class StatsdSettings:
    interval: float = 10.0
    percentile_thresholds: tuple[float, ...] = ()
    histogram_bins: Callable[[Column, Column], Column] | None = None
    add_timestamps: bool = False
    timestamp_window: float = 600.0
    buckets: dict[str, str] = field(
        default_factory=lambda: {
            "counters": "stats_counters", "gauges": "stats_gauges", "sets": "stats_sets",
            "timers": "stats_timers", "histograms": "stats_histograms",
        }
    )
    static_tags: dict[str, str] = field(default_factory=dict)
    hook: Callable[[DataFrame], DataFrame] | None = None


def statsd_families(samples: DataFrame, settings: StatsdSettings) -> dict[str, DataFrame]:
    s = settings
    out = {
        "counters": A.agg_counters(samples, s.interval, s.add_timestamps),
        "gauges": A.agg_gauges(samples, s.interval, s.add_timestamps),
        "sets": A.agg_sets(samples, s.interval, s.add_timestamps),
    }
    if s.percentile_thresholds:
        out["timers"] = A.agg_timers(samples, s.percentile_thresholds, s.interval, s.add_timestamps)
    if s.histogram_bins is not None:
        out["histograms"] = A.agg_histograms(samples, s.histogram_bins, s.interval, s.add_timestamps)
    return out


def family_rows(flat: DataFrame, family: str, settings: StatsdSettings) -> DataFrame:
    """Flat results of one family as finished metric rows; they arrive when their window ends."""
    stamped = flat.withColumn("recv_ts", F.col("win_end"))
    rows = to_metric_rows(stamped, settings.buckets[family], FIELDS[family])
    return finish_rows(rows, settings.static_tags, settings.hook)


def statsd_flush(samples: DataFrame, settings: StatsdSettings) -> DataFrame:
    """Samples to metric rows of all families.

    Every family filters on ``kind``: on samples landed as Parquet partitioned by it, each reads its own part.
    """
    families = statsd_families(samples, settings)
    return union_all(*[family_rows(flat, name, settings) for name, flat in families.items()])


#: Families in the order in which a flush hands them on: of two lines for one series, the later family's is the newer.
FLUSH_ORDER = ("timers", "histograms", "counters", "gauges", "sets")


def landed(samples: DataFrame, folder: str | None = None) -> DataFrame:
    """The samples, written now as Parquet by kind (default: a new shared folder): parsed once, and each family reads its part."""
    folder = folder or shared_folder(samples.sparkSession)
    samples.write.partitionBy("kind").parquet(folder)
    return samples.sparkSession.read.schema(samples.schema).parquet(folder)


def statsd_exposition(
    lines: DataFrame, settings: StatsdSettings, now: Column | None = None, ttl: float | None = None, folder: str | None = None
) -> DataFrame:
    """Text lines to exposition text. The parsed samples are landed in ``folder`` when this is called."""
    families = statsd_families(landed(parse_statsd(lines, settings.timestamp_window), folder), settings)
    rows = union_all(*[
        family_rows(flat, name, settings).withColumn("seq", F.lit(FLUSH_ORDER.index(name))) for name, flat in families.items()
    ])
    return to_exposition(rows, now, ttl)


def json_bulk(
    lines: DataFrame, static_tags: dict[str, str] | None = None, hook: Callable[[DataFrame], DataFrame] | None = None,
    timestamp_window: float = 600.0, **bulk_options,
) -> DataFrame:
    """JSON lines to bulk documents."""
    return to_bulk(finish_rows(parse_json_events(lines, timestamp_window), static_tags, hook), **bulk_options)


def journal_rows(
    raw: DataFrame, level: str = "INFO", trace_level: str | None = None, decode_json: bool = False,
    bucket: str = "logs", static_tags: dict[str, str] | None = None, grammars=GRAMMARS, names: dict[str, str | None] | None = None,
    delay: float = 0.0,
) -> DataFrame:
    """Journal rows to finished log rows, on batches and streams; JSON messages bypass the trace automaton.

    ``names`` renames fields of the result, as ``{"level": "severity", "facility": None}``; None leaves one out. On a stream, lines
    arrive ``delay`` seconds late at most.
    """
    events = map_journal_fields(raw, level)
    number = None if trace_level is None else threshold(trace_level)
    if decode_json:
        events = logs.decode_json_message(events, names)
    bypass = "is_json" if decode_json else None
    if raw.isStreaming:
        events = stitch_stream(events, grammars=grammars, trace_level=number, delay=delay, bypass=bypass)
    else:
        events = stitch(events, grammars=grammars, trace_level=number, bypass=bypass)
    return finish_rows(logs.log_rows(events.drop("is_json"), bucket, level, names), static_tags)
