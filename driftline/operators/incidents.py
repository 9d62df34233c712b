"""Incidents from the points of segments: gates, score, profiles, debounce.

Everything is computed on flat points: one window numbers the samples of a
code, one group per segment evaluates all gates.  Keys always include the
aircraft, so points that are partitioned by it are not shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import DIAL_EXCLUDED, DIAL_PREFIX, EMERGENCY_CODES, Gates, Profile


def samples(points: DataFrame, scope: Sequence[str] = (), gates: Gates = Gates(), tie: Sequence[str] = ()) -> DataFrame:
    """Per segment and emergency code: sample_count, first, fifth and last time, ground_count.
    ``fifth`` is the time of sample number ``min_samples``, null if there are fewer."""
    keys = [*scope, "icao24", "segment_id"]
    own = points.filter(F.col("squawk").isin(*EMERGENCY_CODES))
    n = F.row_number().over(Window.partitionBy(*keys, "squawk").orderBy("time", *tie))
    return (
        own.withColumn("sample_no", n)
        .groupBy(*keys, F.col("squawk").alias("emergency_type"))
        .agg(
            F.count("*").alias("sample_count"),
            F.min("time").alias("incident_start"),
            F.min(F.when(F.col("sample_no") == gates.min_samples, F.col("time"))).alias("fifth"),
            F.max("time").alias("incident_end"),
            F.count_if("onground").alias("ground_count"),
        )
    )


def temporal_gate(counted: DataFrame, scope: Sequence[str] = (), gates: Gates = Gates()) -> DataFrame:
    """Per segment the first code, by priority, whose first ``min_samples`` samples lie within the
    window.  Codes sort by priority."""
    valid = counted.filter((F.col("sample_count") >= gates.min_samples) & (F.col("fifth") - F.col("incident_start") <= gates.window_s))
    rest = [F.col(c) for c in ("sample_count", "incident_start", "incident_end", "ground_count")]
    best = F.min(F.struct("emergency_type", *rest)).alias("best")
    return valid.groupBy(*scope, "icao24", "segment_id").agg(best).select(*scope, "icao24", "segment_id", "best.*").withColumn("persistence_seconds", F.col("incident_end") - F.col("incident_start"))


def persistence_gate(found: DataFrame, gates: Gates = Gates()) -> DataFrame:
    return found.filter(F.col("persistence_seconds") > gates.persistence_s)


def airborne_gate(found: DataFrame, gates: Gates = Gates()) -> DataFrame:
    share = F.col("ground_count").cast("double") / F.col("sample_count")
    return found.withColumn("ground_percentage", F.round(share * 100, 2)).filter(share < gates.ground_ratio)


def dial_codes(points: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per segment the sorted codes that were dialled through on the way to an emergency code."""
    passing = points.filter(F.col("squawk").startswith(DIAL_PREFIX) & ~F.col("squawk").isin(*DIAL_EXCLUDED))
    return passing.groupBy(*scope, "icao24", "segment_id").agg(F.array_sort(F.collect_set("squawk")).alias("roller_dial_codes"))


def start_positions(found: DataFrame, points: DataFrame, scope: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Add start_lat, start_lon: the first point of the segment at the incident's start time."""
    keys = [*scope, "icao24", "segment_id"]
    at = found.select(*keys, F.col("incident_start").alias("time"))
    first = F.min_by(F.struct("lat", "lon"), F.struct("time", *tie)).alias("p")
    where = points.select(*keys, "time", *tie, "lat", "lon").join(at, [*keys, "time"]).groupBy(*keys).agg(first)
    return found.join(where, keys, "left").withColumns({"start_lat": F.col("p.lat"), "start_lon": F.col("p.lon")}).drop("p")


def confidence(gates: Gates = Gates()) -> tuple[Column, Column]:
    """(score, level) from sample_count, persistence_seconds, ground_percentage, roller_dial_codes."""
    low, middle, high = gates.tiers_s
    n, held, ground = F.col("sample_count"), F.col("persistence_seconds"), F.col("ground_percentage")
    dialled = F.coalesce(F.size("roller_dial_codes"), F.lit(0)) > 0
    score = F.least(n * 2, F.lit(40)) + F.when(held > high, 30).when(held > middle, 20).when(held > low, 10).otherwise(5) + F.when(ground < 10, 20).otherwise(10) + F.when(dialled, -10).otherwise(10)
    level = F.when((n >= 10) & (held > middle) & (ground < 10), "HIGH").when((n >= 5) & (held > low) & (ground < 20), "MEDIUM").otherwise("LOW")
    return score.cast("int"), level


def scored(points: DataFrame, gates: Gates = Gates(), scope: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Segments that pass all gates, with score and level."""
    passed = airborne_gate(persistence_gate(temporal_gate(samples(points, scope, gates, tie), scope, gates), gates), gates)
    keys = [*scope, "icao24", "segment_id"]
    passed = start_positions(passed, points, scope, tie).join(dial_codes(points, scope), keys, "left")
    score, level = confidence(gates)
    return passed.withColumns({"confidence_score": score, "confidence_level": level})


def apply_profile(found: DataFrame, profile: Profile) -> DataFrame:
    in_bounds = F.lit(False)
    for code in EMERGENCY_CODES:
        least, most = profile.bounds(code)
        in_bounds = in_bounds | ((F.col("emergency_type") == code) & F.col("sample_count").between(least, most))
    return found.filter((F.col("confidence_score") >= profile.min_confidence) & (F.col("persistence_seconds") >= profile.min_duration_s) & in_bounds)


def records(found: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Incident rows before merging."""
    return found.select(
        *scope,
        F.concat_ws("_", "icao24", F.col("incident_start").cast("string")).alias("incident_id"),
        "segment_id",
        "icao24",
        "emergency_type",
        F.col("incident_start").alias("start_time"),
        F.col("incident_end").alias("end_time"),
        "sample_count",
        "ground_percentage",
        "confidence_score",
        "confidence_level",
        (F.coalesce(F.size("roller_dial_codes"), F.lit(0)) > 0).alias("has_roller_dial"),
        F.coalesce("roller_dial_codes", F.array().cast("array<string>")).alias("roller_dial_codes"),
        "start_lat",
        "start_lon",
    )


def debounce(incidents: DataFrame, gates: Gates = Gates(), scope: Sequence[str] = ()) -> DataFrame:
    """Merge incidents of one aircraft and code that start at most ``debounce_s`` after the previous
    one's end.  Descriptive columns come from the earliest member."""
    keys = [*scope, "icao24", "emergency_type"]
    w = Window.partitionBy(*keys).orderBy("start_time", "incident_id")
    gap = F.col("start_time") - F.lag("end_time").over(w)
    grouped = incidents.withColumn("gap", gap).withColumn("group_id", F.sum((F.col("gap").isNull() | (F.col("gap") > gates.debounce_s)).cast("int")).over(w))
    early = ["incident_id", "segment_id", "confidence_level", "roller_dial_codes", "start_lat", "start_lon"]
    first = F.min_by(F.struct(*early), F.struct("start_time", "incident_id")).alias("first")
    merged = grouped.groupBy(*keys, "group_id").agg(
        first,
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.sum("sample_count").alias("total_samples"),
        F.avg(F.col("ground_percentage").cast("decimal(10,2)")).alias("ground"),  # exact, so that rounding is
        F.max("confidence_score").alias("confidence_score"),
        F.bool_or("has_roller_dial").alias("has_roller_dial"),
    )
    return merged.select(
        *scope,
        "first.incident_id",
        "first.segment_id",
        "icao24",
        "emergency_type",
        "start_time",
        "end_time",
        F.least(F.col("end_time") - F.col("start_time"), F.lit(gates.cap_s)).cast("long").alias("duration_seconds"),
        "total_samples",
        F.round("ground", 2).cast("double").alias("ground_percentage"),
        "confidence_score",
        "first.confidence_level",
        "has_roller_dial",
        "first.roller_dial_codes",
        "first.start_lat",
        "first.start_lon",
    )


def detect(points: DataFrame, profile: Profile = Profile(), gates: Gates = Gates(), scope: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Incidents of flat segment points: gates, profile, debounce, cap."""
    return debounce(records(apply_profile(scored(points, gates, scope, tie), profile), scope), gates, scope)


def stamp(incidents: DataFrame, processing_date: str) -> DataFrame:
    return incidents.withColumns({"processing_date": F.lit(processing_date).cast("date"), "detected_at": F.current_timestamp()})


def statistics(incidents: DataFrame) -> DataFrame:
    """One row of totals over incidents; all zero or null for none."""
    by_code = [F.count_if(F.col("emergency_type") == c).alias(f"count_{c}") for c in EMERGENCY_CODES]
    by_level = [F.count_if(F.col("confidence_level") == x).alias(f"{x.lower()}_confidence") for x in ("HIGH", "MEDIUM", "LOW")]
    return incidents.agg(F.count("*").alias("total_incidents"), F.count_distinct("icao24").alias("unique_aircraft"), *by_code, *by_level, F.round(F.avg("confidence_score"), 6).alias("avg_confidence"), F.round(F.avg("duration_seconds"), 6).alias("avg_duration"), F.count_if("has_roller_dial").alias("roller_dial_count"))
