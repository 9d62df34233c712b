"""Cell metrics of points: coverage, quality, incidents, mapping.

Points are first reduced to one row per cell, aircraft and segment; counts of
distinct segments and aircraft are then plain sums, so no distinct aggregate
expands the rows, and all shuffles carry pre-aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import EMERGENCY_CODES
from driftline.functions.geo import CellFunction, grid_cell

RESOLUTIONS = (3, 4, 5, 6)


def check_resolution(resolution: int) -> int:
    if resolution not in RESOLUTIONS:
        raise ValueError(f"resolution must be one of {RESOLUTIONS}, not {resolution}")
    return resolution


def _segment_cells(points: DataFrame, resolution: int, cell: CellFunction, by: Sequence[str]) -> DataFrame:
    """(*by, h3_cell, icao24, segment_id, points): points with a position, one row per segment and cell."""
    placed = points.filter("lat is not null and lon is not null").select(*by, cell(F.col("lat"), F.col("lon"), resolution).alias("h3_cell"), "icao24", "segment_id")
    return placed.groupBy(*by, "h3_cell", "icao24", "segment_id").agg(F.count("*").alias("points"))


def coverage(points: DataFrame, resolution: int, cell: CellFunction = grid_cell, by: Sequence[str] = ()) -> DataFrame:
    """Segments, aircraft and points per cell (and day, if ``by`` names it), over segments of at
    least two points."""
    check_resolution(resolution)
    by_segment = _segment_cells(points.filter("point_count >= 2"), resolution, cell, by)
    by_aircraft = by_segment.groupBy(*by, "h3_cell", "icao24").agg(F.count("*").alias("segments"), F.sum("points").alias("points"))
    summed = by_aircraft.groupBy(*by, "h3_cell").agg(F.sum("segments").alias("unique_segments"), F.count("*").alias("unique_aircraft"), F.sum("points").alias("total_points"))
    return summed.select(*by, "h3_cell", F.lit(resolution).alias("h3_res"), "unique_segments", "unique_aircraft", "total_points")


def coverage_levels(points: DataFrame, resolutions: Sequence[int] = RESOLUTIONS, cell: CellFunction = grid_cell, by: Sequence[str] = ()) -> DataFrame:
    """Coverage at several resolutions from one scan of the points; every level is computed from the
    points, never rolled up from a finer one."""
    for r in resolutions:
        check_resolution(r)
    own = points.filter("point_count >= 2 and lat is not null and lon is not null")
    levels = F.explode(F.array(*(F.struct(cell(F.col("lat"), F.col("lon"), r).alias("h3_cell"), F.lit(r).alias("h3_res")) for r in resolutions)))
    placed = own.select(*by, "icao24", "segment_id", levels.alias("c")).select(*by, "icao24", "segment_id", "c.*")
    keys = [*by, "h3_cell", "h3_res"]
    by_segment = placed.groupBy(*keys, "icao24", "segment_id").agg(F.count("*").alias("points"))
    by_aircraft = by_segment.groupBy(*keys, "icao24").agg(F.count("*").alias("segments"), F.sum("points").alias("points"))
    return by_aircraft.groupBy(*keys).agg(F.sum("segments").alias("unique_segments"), F.count("*").alias("unique_aircraft"), F.sum("points").alias("total_points"))


def category(median: Column) -> Column:
    return F.when(median >= 10, "excellent").when(median >= 6, "good").when(median >= 3, "limited").otherwise("poor")


def quality(points: DataFrame, resolution: int, cell: CellFunction = grid_cell) -> DataFrame:
    """Median and mean of a segment's points per visited cell, by cell, and a category.  A segment's
    points are spread evenly over its cells; point_count includes points without position."""
    check_resolution(resolution)
    own = points.filter("point_count >= 2")
    visited = own.filter("lat is not null and lon is not null").select("icao24", "segment_id", "point_count", cell(F.col("lat"), F.col("lon"), resolution).alias("h3_cell")).distinct()
    spread = visited.groupBy("icao24", "segment_id", "point_count").agg(F.collect_set("h3_cell").alias("cells"))  # bounded by a trip's cells
    each = spread.select((F.col("point_count").cast("double") / F.size("cells")).alias("ppc"), F.explode("cells").alias("h3_cell"))
    out = each.groupBy("h3_cell").agg(F.count("*").alias("unique_segments"), F.percentile("ppc", F.lit(0.5)).alias("median_points_per_cell"), F.avg("ppc").alias("avg_points_per_cell"))
    return out.withColumn("coverage_category", category(F.col("median_points_per_cell")))


def incident_cells(incidents: DataFrame, points: DataFrame, resolution: int, cell: CellFunction = grid_cell, by: Sequence[str] = ()) -> DataFrame:
    """(*by, h3_cell, incident_id, icao24, emergency_type, points) for all points of incidents'
    segments.  The points are reduced per segment and cell before incidents are joined.  Segment
    ids restart every day, so ``by`` must name the day where points span several."""
    by_segment = _segment_cells(points, check_resolution(resolution), cell, by)
    own = incidents.select(*by, "incident_id", "segment_id", "icao24", "emergency_type")
    joined = by_segment.drop("icao24").join(own, [*by, "segment_id"])
    return joined.groupBy(*by, "h3_cell", "incident_id", "icao24", "emergency_type").agg(F.sum("points").alias("points"))


def _type_counts() -> list[Column]:
    """Incidents per code; rows are one per cell and incident."""
    return [F.count_if(F.col("emergency_type") == c).alias(f"incidents_{c}") for c in EMERGENCY_CODES]


def _rate() -> Column:
    return F.when(F.col("unique_segments") > 0, F.col("incidents_unique").cast("double") / F.col("unique_segments"))


def dual_metrics(incidents: DataFrame, points: DataFrame, resolution: int, cell: CellFunction = grid_cell, by: Sequence[str] = ()) -> DataFrame:
    """Per cell with traffic: incidents (distinct, by code, points), types, segments and rate.
    The predominant type has most points; the lowest code wins ties."""
    keys = [*by, "h3_cell"]
    per_incident = incident_cells(incidents, points, resolution, cell, by)
    votes = per_incident.groupBy(*keys, "emergency_type").agg(F.sum("points").alias("points"), F.count_distinct("incident_id").alias("n"))
    by_code = votes.groupBy(*keys).agg(
        F.sum("points").alias("incidents_coverage"),
        F.array_sort(F.collect_set("emergency_type")).alias("emergency_types_list"),
        F.min(F.struct(-F.col("points"), "emergency_type")).alias("top"),
        *(F.coalesce(F.sum(F.when(F.col("emergency_type") == c, F.col("n"))), F.lit(0)).alias(f"incidents_{c}") for c in EMERGENCY_CODES),
    )
    unique = per_incident.groupBy(*keys).agg(F.count_distinct("incident_id").alias("incidents_unique"), F.count_distinct("icao24").alias("aircraft_with_incidents"))
    flights = _segment_cells(points, resolution, cell, by).groupBy(*keys).agg(F.count("*").alias("unique_segments"))
    joined = by_code.join(unique, keys).join(flights, keys, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counted = joined.select(
        *keys,
        F.lit(resolution).alias("h3_res"),
        zero("incidents_unique"),
        zero("aircraft_with_incidents"),
        zero("incidents_coverage"),
        zero("unique_segments"),
        F.coalesce("unique_segments", F.lit(0)).alias("total_segments"),
        "emergency_types_list",
        F.coalesce(F.size("emergency_types_list"), F.lit(0)).alias("emergency_type_diversity"),
        F.col("top.emergency_type").alias("predominant_emergency_type"),
        *(zero(f"incidents_{c}") for c in EMERGENCY_CODES),
    )
    return counted.withColumn("incident_rate", _rate())


def mapping(incidents: DataFrame, points: DataFrame, resolution: int, cell: CellFunction = grid_cell, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (incident_id, h3_cell, h3_res)."""
    return incident_cells(incidents, points, resolution, cell, by).select(*by, "incident_id", "h3_cell", F.lit(resolution).alias("h3_res")).distinct()


def by_type(incidents: DataFrame, points: DataFrame, resolution: int, cell: CellFunction = grid_cell, by: Sequence[str] = ()) -> DataFrame:
    """Distinct incidents per cell and code."""
    each = incident_cells(incidents, points, resolution, cell, by).select(*by, "h3_cell", "incident_id", "emergency_type").distinct()
    return each.groupBy(*by, "h3_cell").agg(*_type_counts(), F.count_distinct("incident_id").alias("incidents_all"))


def visible(cells: DataFrame, min_segments: int) -> DataFrame:
    """Cells with enough segments."""
    return cells.filter(F.col("unique_segments") >= min_segments)


def merge_coverage(daily: DataFrame, resolution: int) -> DataFrame:
    """Sums of daily coverage; aircraft seen on several days count once a day."""
    own = daily.filter(F.col("h3_res") == resolution)
    return own.groupBy("h3_cell", "h3_res").agg(*(F.sum(c).alias(c) for c in ("unique_segments", "unique_aircraft", "total_points")))


def merge_incidents(daily: DataFrame, resolution: int) -> DataFrame:
    """Sums of daily cell metrics.  Each day votes once for each of its types; the lowest code wins
    ties.  A cell without incidents gets an empty list."""
    own = daily.filter(F.col("h3_res") == resolution)
    keys = ["h3_cell", "h3_res"]
    sums = ["incidents_unique", "aircraft_with_incidents", "incidents_coverage", "unique_segments", "total_segments", *(f"incidents_{c}" for c in EMERGENCY_CODES)]
    totals = own.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
    votes = own.select(*keys, F.explode("emergency_types_list").alias("type")).groupBy(*keys, "type").agg(F.count("*").alias("days"))
    types = votes.groupBy(*keys).agg(F.array_sort(F.collect_set("type")).alias("emergency_types_list"), F.min(F.struct(-F.col("days"), "type")).alias("top"))
    joined = totals.join(types, keys, "left")
    return joined.select(*keys, *sums[:5], F.coalesce("emergency_types_list", F.array().cast("array<string>")).alias("emergency_types_list"), F.coalesce(F.size("emergency_types_list"), F.lit(0)).alias("emergency_type_diversity"), F.col("top.type").alias("predominant_emergency_type"), *sums[5:]).withColumn("incident_rate", _rate())


def merge_mapping(daily: DataFrame, resolution: int) -> DataFrame:
    """Distinct pairs of all days."""
    return daily.filter(F.col("h3_res") == resolution).select("incident_id", "h3_cell", "h3_res").distinct()
