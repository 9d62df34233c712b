"""Drill-down lookups by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.config import EMERGENCY_CODES
from driftline.functions.geo import replay_url
from driftline.operators.cells import RESOLUTIONS

# Columns of the answers.
SUMMARY_COLUMNS = ("h3_cell", "h3_res", "incidents_unique", "incidents_coverage", "unique_segments", "incident_rate", "emergency_types_list", "emergency_type_diversity", "predominant_emergency_type")
PAGE_COLUMNS = ("incident_id", "start_time", "end_time", "emergency_type", "icao24", "confidence_score", "duration_seconds", "start_lat", "start_lon")
DEFAULT_LIMIT = 200
MAX_LIMIT = 1000


def cell_number(cell: str | int) -> int | None:
    """A decimal cell id; anything else (hex ids too) is none."""
    try:
        return int(cell)
    except (TypeError, ValueError):
        return None


def summary(cells: DataFrame, cell: int, emergency_type: str | None = None) -> DataFrame:
    """The cell's row, if it holds incidents of the type.  Cells are written sorted, so the equality
    prunes row groups."""
    found = cells.filter(F.col("h3_cell") == cell)
    if emergency_type:
        found = found.filter(F.array_contains("emergency_types_list", emergency_type))
    return found.select(*SUMMARY_COLUMNS)


def incident_page(mapping: DataFrame, incidents: DataFrame, cell: int, emergency_type: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Incidents of a cell, latest first, ties by id; a top-k page."""
    if not 0 < limit <= MAX_LIMIT or offset < 0:
        raise ValueError(f"limit must be 1..{MAX_LIMIT} and offset not negative")
    ids = mapping.filter(F.col("h3_cell") == cell).select("incident_id")
    own = incidents.filter(F.col("emergency_type") == emergency_type) if emergency_type else incidents
    page = own.join(ids, "incident_id", "left_semi").select(*PAGE_COLUMNS)
    return page.orderBy(F.desc("start_time"), "incident_id").offset(offset).limit(limit)


def with_replay(page: DataFrame, base: str) -> DataFrame:
    return page.withColumn("replay_url", replay_url(base, F.col("icao24"), F.col("start_time"), F.col("start_lat"), F.col("start_lon")))


def checked(resolution: int, emergency_type: str | None) -> bool:
    """Whether a request's resolution and type are valid."""
    return resolution in RESOLUTIONS and (emergency_type is None or emergency_type in EMERGENCY_CODES)
