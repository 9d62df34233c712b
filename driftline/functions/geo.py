"""Column expressions for positions: distances, grid cells, outlines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371

#: (lat, lon, resolution) -> cell id (long); null coordinates give null.
CellFunction = Callable[[Column, Column, int], Column]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the root is clamped so that antipodes never leave asin's domain."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def grid_degrees(resolution: int) -> float:
    """Edge of a grid cell: 8 degrees at resolution 3, halved per step."""
    return 8.0 / 2 ** (resolution - 3)


def grid_cell(lat: Column, lon: Column, resolution: int) -> Column:
    """Cell of a latitude/longitude grid, inside whole-stage codegen:
    resolution, row and column as decimal fields of one long."""
    step = grid_degrees(resolution)
    row, column = F.floor((lat + 90.0) / step).cast("long"), F.floor((lon + 180.0) / step).cast("long")
    return F.lit(resolution * 10**12) + row * F.lit(10**6) + column


def grid_ring(cell: Column, resolution: int) -> Column:
    """Closed outline [[lon, lat], ...] of a grid cell, counter-clockwise."""
    step = grid_degrees(resolution)
    row, column = F.floor(F.pmod(cell, F.lit(10**12)) / 10**6), F.pmod(cell, F.lit(10**6))
    south, west = row * step - 90.0, column * step - 180.0
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    return F.array(corner(west, south), corner(west + step, south), corner(west + step, south + step), corner(west, south + step), corner(west, south))


def h3_cell(lat: Column, lon: Column, resolution: int) -> Column:
    """H3 cell ids through the h3 library, where it is installed (Arrow batches)."""
    import h3  # noqa: F401  fails here, on the driver, where the library is missing

    @F.pandas_udf("long")
    def cell(lats, lons):  # noqa: ANN001, ANN202
        import h3
        import pandas as pd

        found = [None if a is None or b is None or a != a or b != b else h3.str_to_int(h3.latlng_to_cell(a, b, resolution)) for a, b in zip(lats, lons, strict=True)]
        return pd.Series(found, dtype="Int64")

    return cell(lat, lon)


def h3_ring(cell: Column, resolution: int) -> Column:
    """Closed outline [[lon, lat], ...] of an H3 cell through the h3 library, where it is installed."""
    import h3  # noqa: F401  fails here, on the driver, where the library is missing

    @F.pandas_udf("array<array<double>>")
    def ring(cells):  # noqa: ANN001, ANN202
        import h3

        def one(c):  # noqa: ANN001, ANN202
            corners = [[lon, lat] for lat, lon in h3.cell_to_boundary(h3.int_to_str(int(c)))]
            return [*corners, corners[0]]

        return cells.map(one, na_action="ignore")

    return ring(cell)


@dataclass(frozen=True)
class CellSystem:
    """Cells and their outlines belong together."""

    cell: CellFunction
    ring: Callable[[Column, int], Column]


CELL_SYSTEMS = {"grid": CellSystem(grid_cell, grid_ring), "h3": CellSystem(h3_cell, h3_ring)}


def replay_url(base: str, icao24: Column, time: Column, lat: Column, lon: Column, zoom: int = 10) -> Column:
    """Link to a replay of a trip around a time."""
    day = F.date_format(F.timestamp_seconds(time), "yyyy-MM-dd")
    return F.concat(F.lit(f"{base}?icao="), icao24, F.lit("&showTrace="), day, F.lit("&timestamp="), time.cast("string"), F.lit("&lat="), lat.cast("string"), F.lit("&lon="), lon.cast("string"), F.lit(f"&zoom={zoom}"))
