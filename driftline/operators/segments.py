"""Trips from position reports: gap sessions, track length, summaries.

All windows and groups are keyed by (scope, aircraft), so one exchange of the
reports by aircraft serves sessions, distances and summaries alike.  A key's
rows are bounded by the reports one aircraft sends in the scope (a day).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import SegmentRules
from driftline.functions.geo import haversine_km

#: Characters of an aircraft address that name its part (hexadecimal: 4096 parts).
LEADING = 3
POINT_FIELDS = ("time", "lat", "lon", "squawk", "onground", "alert")


def sessions(states: DataFrame, gap_s: float = 1200, scope: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Add segment_num, segment_id and distance_to_prev to reports with aircraft and position.

    A report starts a segment if it is its aircraft's first in the scope or follows the previous
    one by at least ``gap_s``.  ``tie`` names columns that order reports of equal time."""
    keys = [*scope, "icao24"]
    w = Window.partitionBy(*keys).orderBy("time", *tie)
    known = states.filter("icao24 is not null and lat is not null and lon is not null and time is not null")
    lagged = known.withColumns({"prev_time": F.lag("time").over(w), "prev_lat": F.lag("lat").over(w), "prev_lon": F.lag("lon").over(w)})
    starts = F.col("prev_time").isNull() | (F.col("time") - F.col("prev_time") >= gap_s)
    step = F.when(F.col("new_segment_flag") == 1, F.lit(0.0)).otherwise(haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")))
    numbered = lagged.withColumn("new_segment_flag", starts.cast("int")).withColumn("segment_num", F.sum("new_segment_flag").over(w))
    return numbered.withColumns({"segment_id": F.concat_ws("_", "icao24", F.col("segment_num").cast("string")), "distance_to_prev": step}).drop("prev_time", "prev_lat", "prev_lon")


def keep_reason(rules: SegmentRules) -> Column:
    long, far = F.col("duration_seconds") >= rules.min_duration_s, F.col("distance_km") >= rules.min_distance_km
    return F.when(long & far, "both").when(long, "duration").when(far, "distance")


def summarise(points: DataFrame, rules: SegmentRules = SegmentRules(), scope: Sequence[str] = (), with_points: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """One row per kept segment.  ``with_points`` adds the time-ordered trajectory array; it costs
    memory per segment, so analyses run on the flat points instead."""
    has_code = F.col("squawk").isNotNull() & (F.col("squawk") != "")
    aggs = [
        F.min("time").alias("start_time"),
        F.max("time").alias("end_time"),
        (F.max("time") - F.min("time")).alias("duration_seconds"),
        F.sum("distance_to_prev").alias("distance_km"),
        F.count("*").alias("point_count"),
        F.count_if(has_code).alias("squawk_count"),
    ]
    if with_points:
        fields = [c for c in POINT_FIELDS if c in points.columns]
        ordered = F.array_sort(F.collect_list(F.struct("time", *tie, *(F.col(c) for c in fields if c != "time"))))
        aggs.append(F.transform(ordered, lambda p: F.struct(*(p[c].alias(c) for c in fields))).alias("points"))
    out = points.groupBy(*scope, "icao24", "segment_id").agg(*aggs)
    out = out.withColumns({"squawk_coverage_ratio": F.col("squawk_count").cast("double") / F.col("point_count"), "keep_reason": keep_reason(rules)}).filter("keep_reason is not null")
    columns = ["segment_id", "icao24", "start_time", "end_time", "duration_seconds", "distance_km", "point_count", "squawk_count", "squawk_coverage_ratio", "keep_reason"]
    return out.select(*scope, *columns, *(["points"] if with_points else []))


def kept_points(points: DataFrame, rules: SegmentRules = SegmentRules(), scope: Sequence[str] = ()) -> DataFrame:
    """The reports of kept segments, with point_count.  Windows over the segment reuse the
    partitioning by aircraft, so no segment is joined back."""
    w = Window.partitionBy(*scope, "icao24", "segment_id")
    marked = points.withColumns({"duration_seconds": F.max("time").over(w) - F.min("time").over(w), "distance_km": F.sum("distance_to_prev").over(w), "point_count": F.count("*").over(w)})
    return marked.filter(keep_reason(rules).isNotNull()).drop("duration_seconds", "distance_km")


def flatten(segments: DataFrame, keep: Sequence[str] = ("segment_id", "icao24", "point_count")) -> DataFrame:
    """Flat points of segments that carry trajectory arrays, with their place in the array."""
    pos = segments.select(*keep, F.posexplode("points").alias("point_no", "p"))
    return pos.select(*keep, "point_no", "p.*")


def volume_batches(states: DataFrame, batch_size: int) -> DataFrame:
    """(icao24, point_count, batch_id): aircraft dealt by running volume, in the order of their
    addresses, into ceil(n / batch_size) batches.  The running sum is one over the few leading parts
    of addresses plus one within each part, so no task orders all aircraft.  Plans rely on hash
    partitioning and use this only to size work."""
    counts = states.filter("lat is not null and lon is not null").groupBy("icao24").agg(F.count("*").alias("point_count")).withColumn("part", F.substring("icao24", 1, LEADING))
    totals = counts.agg(F.count("*").alias("aircraft"), F.sum("point_count").alias("points")).withColumn("batches", F.greatest(F.lit(1), F.ceil(F.col("aircraft").cast("double") / batch_size)))
    parts = counts.groupBy("part").agg(F.sum("point_count").alias("volume"))
    before = F.sum("volume").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("volume")  # one row per leading part
    own = F.sum("point_count").over(Window.partitionBy("part").orderBy("icao24").rowsBetween(Window.unboundedPreceding, 0))
    dealt = counts.withColumn("own", own).join(parts.select("part", before.alias("before")), "part").crossJoin(F.broadcast(totals))  # one row
    batch = F.least(F.floor((F.col("before") + F.col("own") - 1) / (F.col("points").cast("double") / F.col("batches"))), F.col("batches") - 1)
    return dealt.select("icao24", "point_count", batch.cast("long").alias("batch_id"))
