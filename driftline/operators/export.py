"""GeoJSON lines, CSV rows, tile commands."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import EMERGENCY_CODES
from driftline.functions.geo import grid_ring

# Properties of a feature, in order.
INCIDENT_PROPERTIES = ("incidents_unique", "aircraft_with_incidents", "incidents_coverage", "total_segments", "emergency_types_list", "emergency_type_diversity", "predominant_emergency_type", "incident_rate", *(f"incidents_{c}" for c in EMERGENCY_CODES))
PROPERTIES = ("h3_cell", "h3_res", "unique_segments", "unique_aircraft", "total_points", *INCIDENT_PROPERTIES)

# CSV header and the incident columns behind it; None stays blank.
CSV_COLUMNS = {
    "incident_id": "incident_id",
    "start_time": "start_time",
    "end_time": "end_time",
    "emergency_type": "emergency_type",
    "icao24": "icao24",
    "callsign": None,
    "confidence_score": "confidence_score",
    "confidence_category": None,
    "samples_in_emergency": None,
    "emergency_duration_s": "duration_seconds",
    "ground_ratio": None,
}

# Zoom ranges of tile sets by resolution.
ZOOMS = {3: (3, 7), 4: (4, 8), 5: (5, 9), 6: (6, 10)}


def features(coverage: DataFrame, incidents: DataFrame | None, resolution: int, ring: Callable[[Column, int], Column] = grid_ring) -> DataFrame:
    """One (type, geometry, properties) row per coverage cell; without incidents their properties
    are null.  Segment counts come from the coverage side."""
    if incidents is None:
        joined = coverage.withColumns({c: F.lit(None).cast("array<string>" if c == "emergency_types_list" else "string" if c.startswith("predominant") else "double" if c == "incident_rate" else "long") for c in INCIDENT_PROPERTIES})
    else:
        joined = coverage.join(incidents.select("h3_cell", *INCIDENT_PROPERTIES), "h3_cell", "left")
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring(F.col("h3_cell"), resolution)).alias("coordinates"))
    named = [F.col("h3_cell").cast("string").alias("h3_cell"), *(F.col(c) for c in PROPERTIES[1:])]
    return joined.select(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*named).alias("properties"))


def geojson_lines(coverage: DataFrame, incidents: DataFrame | None, resolution: int, ring: Callable[[Column, int], Column] = grid_ring) -> DataFrame:
    """One JSON document per line, nulls kept, in column json_text."""
    whole = F.struct("type", "geometry", "properties")
    return features(coverage, incidents, resolution, ring).select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("json_text"))


def csv_rows(page: DataFrame) -> DataFrame:
    """The CSV columns of incident rows; fields that rows do not carry are empty."""
    return page.select(*((F.col(source) if source else F.lit("")).alias(name) for name, source in CSV_COLUMNS.items()))


def zoom_range(resolution: int) -> tuple[int, int]:
    return ZOOMS.get(resolution, (resolution, resolution + 4))


# Options of the tile builder.
TILE_OPTIONS = "--layer=h3_cells --minimum-zoom={low} --maximum-zoom={high} --maximum-tile-features=10000 --simplification=10 --force --drop-densest-as-needed --extend-zooms-if-still-dropping -P"
TILE_BUILDER = "tippecanoe"


def tile_command(sources: str | Sequence[str], target: str, resolution: int, attributes: Sequence[str] = PROPERTIES) -> list[str]:
    """Command line that builds a tile set from files of GeoJSON lines; no ``attributes`` keeps all."""
    files = [sources] if isinstance(sources, str) else sources
    low, high = zoom_range(resolution)
    kept = [word for name in attributes for word in ("--include", name)]
    return [TILE_BUILDER, "-o", target, *TILE_OPTIONS.format(low=low, high=high).split(), *kept, *files]


def build_tiles(command: Sequence[str], run: Callable[..., subprocess.CompletedProcess] = subprocess.run) -> str:
    """Run a command of :func:`tile_command`; the path of the tile set.  A missing tool, an exit code
    other than zero and a tile set that is not there afterwards are errors."""
    target = command[command.index("-o") + 1]
    try:
        done = run(list(command), capture_output=True, text=True, check=False)
    except FileNotFoundError as e:
        raise RuntimeError(f"{command[0]} is not installed") from e
    if done.returncode:
        raise RuntimeError(f"{command[0]} ended with {done.returncode}: {done.stderr}")
    if not os.path.exists(target):
        raise RuntimeError(f"{command[0]} left no {target}")
    return target
