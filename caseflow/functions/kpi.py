"""KPI segment expressions. `segments` is array<struct<start_time,end_time,value,pattern>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.variants import get, path_of

SEGMENTS = "array<struct<start_time double, end_time double, value array<double>, pattern string>>"
TIMED_VALUES = "array<struct<start_time double, end_time double, value array<double>>>"


def segments_of(sem: Column, kpi: str) -> Column:
    """Segments of one KPI; null when any level has an unexpected shape."""
    raw = get(sem, path_of("anomaly_kpi", kpi, "abnormal_timing_segments"), SEGMENTS)
    return F.transform(
        raw,
        lambda s: F.struct(
            s["start_time"].alias("start_time"),
            s["end_time"].alias("end_time"),
            F.coalesce(s["value"], F.array().cast("array<double>")).alias("value"),
            s["pattern"].alias("pattern"),
        ),
    )


def timed_values(sem: Column, kpi: str) -> Column:
    """Times and values of the segments of one KPI, as the document has them: what the statistics need of `segments_of`."""
    return get(sem, path_of("anomaly_kpi", kpi, "abnormal_timing_segments"), TIMED_VALUES)


def overall_duration(segments: Column) -> Column:
    """Minutes from the first start to the last end over segments that have both; 0 if none."""
    whole = F.filter(segments, lambda s: s["start_time"].isNotNull() & s["end_time"].isNotNull())
    first = F.array_min(F.transform(whole, lambda s: s["start_time"]))
    last = F.array_max(F.transform(whole, lambda s: s["end_time"]))
    return F.coalesce((last - first) / 60.0, F.lit(0.0))


def alarm_seconds(alarm_time: Column) -> Column:
    """Epoch seconds from an epoch in milliseconds or seconds."""
    return F.when(alarm_time > vocab.MILLISECONDS_ABOVE, alarm_time / 1000.0).otherwise(alarm_time)


def nearest_segment(segments: Column, alarm_time: Column) -> Column:
    """Segment nearest to the alarm: distance 0 inside, else to the closer edge; first one on ties.

    Without an alarm time the segment with the latest end is taken.
    """
    at = alarm_seconds(alarm_time)

    def order(s: Column) -> Column:
        inside = (s["start_time"] <= at) & (at <= s["end_time"])
        edge = F.least(F.abs(at - s["start_time"]), F.abs(at - s["end_time"]))
        gap = F.when(inside, F.lit(0.0)).otherwise(F.coalesce(edge, F.lit(float("inf"))))
        return F.when(at.isNull(), -F.coalesce(s["end_time"], F.lit(-1.0))).otherwise(gap)

    best = F.array_min(F.transform(segments, lambda s, i: F.struct(order(s).alias("o"), i.alias("i"))))
    return F.when(F.size(segments) > 0, F.get(segments, best["i"]))


def segment_minutes(segment: Column) -> Column:
    return F.coalesce((segment["end_time"] - segment["start_time"]) / 60.0, F.lit(0.0))


def all_values(segments: Column) -> Column:
    """Values of all segments; a segment without values has none."""
    return F.flatten(F.transform(segments, lambda s: F.coalesce(s["value"], F.array().cast("array<double>"))))


def value_stats(values: Column) -> dict[str, Column]:
    """max / min / mean of an array of doubles, 0 when it is empty or null."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    zero = F.lit(0.0)
    return {
        "max": F.coalesce(F.array_max(values), zero),
        "min": F.coalesce(F.array_min(values), zero),
        "mean": F.when(F.size(values) > 0, total / F.size(values)).otherwise(zero),
    }


def signed_log(value: Column) -> Column:
    """Sign-preserving log1p; 0 for a missing value."""
    x = F.coalesce(value.cast("double"), F.lit(0.0))
    return F.signum(x) * F.log1p(F.abs(x))
