"""Queries that SQL cannot mirror, or that go through files: layout, cells, streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import Config
from driftline.operators import cells, incidents
from driftline.plans import domain, pipeline
from driftline.sources import sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share, which the session names; only a
    local session may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="driftline-")
    return f"{named}/plan-{uuid.uuid4().hex}"


def k1_partitioned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily coverage written as date partitions, then read back."""
    path = _scratch(spark)
    _, pts = domain.by_period(spark, sf_dir)
    sinks.write(cells.coverage(pts, domain.RESOLUTION, by=("period",)), path, partition="period")
    return spark.read.parquet(path).groupBy("period").agg(F.count("*").alias("cells"), F.sum("total_points").alias("points"))


def k2_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzip text lines, counted after reading them back."""
    path = _scratch(spark)
    lines = cells.coverage(domain.kept(spark, sf_dir), domain.RESOLUTION).select(F.to_json(F.struct("h3_cell", "total_points")).alias("json_text"))
    sinks.write_lines(lines, path)
    return spark.read.text(path).agg(F.count("*").alias("lines"), F.sum(F.get_json_object("value", "$.total_points").cast("long")).alias("points"))


def k4_empty_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty table keeps its schema on disk."""
    path = _scratch(spark)
    sinks.write(domain.kept(spark, sf_dir).filter("false"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


SQL["k4_empty_result"] = "SELECT CAST(0 AS BIGINT) AS n"
SQL["k2_lines_roundtrip"] = f"WITH {domain._points()}, c AS (SELECT {domain._CELL} AS h3_cell, COUNT(*) AS p FROM kp WHERE point_count >= 2 GROUP BY 1) SELECT COUNT(*) AS lines, CAST(SUM(p) AS BIGINT) AS points FROM c"
SQL["k1_partitioned_roundtrip"] = f"WITH {domain._points('period, ')}, c AS (SELECT period, {domain._CELL} AS h3_cell, COUNT(*) AS p FROM kp WHERE point_count >= 2 GROUP BY ALL) SELECT period, COUNT(*) AS cells, CAST(SUM(p) AS BIGINT) AS points FROM c GROUP BY period"


def s10_named_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named views over tables, joined in SQL text."""
    tables.register({"view_nation": tables.parquet(spark, f"{sf_dir}/nation.parquet"), "view_region": tables.parquet(spark, f"{sf_dir}/region.parquet")})
    return spark.sql("SELECT r_name, COUNT(*) AS nations FROM view_nation JOIN view_region ON n_regionkey = r_regionkey GROUP BY r_name")


SQL["s10_named_views"] = "SELECT r_name, COUNT(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


def d10_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with processing date; the detection time is left out, as it changes."""
    found = incidents.detect(domain.kept(spark, sf_dir), domain.SCALED["none"], domain.GATES, (), domain.TIE)
    return incidents.stamp(found, "2024-01-31").select("incident_id", F.col("processing_date").cast("string").alias("processing_date"))


SQL["d10_stamped"] = f"WITH {domain._incidents()} SELECT incident_id, '2024-01-31' AS processing_date FROM merged"

def s4_explicit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files in one scan."""
    both = tables.parquet(spark, f"{sf_dir}/nation.parquet", f"{sf_dir}/nation.parquet")
    return both.groupBy("n_regionkey").agg(F.count("*").alias("n"))


SQL["s4_explicit_list"] = "SELECT n_regionkey, 2 * COUNT(*) AS n FROM nation GROUP BY n_regionkey"


def s7_hour_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hour of reports, pushed to the scan as a time range, with positions only."""
    states = domain.states(spark, sf_dir).filter((F.col("time") >= 1704157200) & (F.col("time") < 1704160800))
    return states.filter("lat is not null and lon is not null").select("time", "icao24", "lat", "lon", "squawk", "onground").sortWithinPartitions("time")


SQL["s7_hour_extraction"] = f"WITH {domain._SV} SELECT time, icao24, lat, lon, squawk, onground FROM sv WHERE time >= 1704157200 AND time < 1704160800"


def s8_arrow_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An in-memory Arrow table joined with a stored one."""
    wanted = tables.from_arrow(spark, pa.table({"key": pa.array([0, 2, 4], pa.int32()), "tag": ["a", "b", None]}))
    regions = tables.parquet(spark, f"{sf_dir}/region.parquet")
    return regions.join(wanted, regions["r_regionkey"] == wanted["key"]).select("r_name", "tag")


SQL["s8_arrow_scan"] = "SELECT r_name, tag FROM region JOIN (VALUES (0, 'a'), (2, 'b'), (4, NULL)) AS w(key, tag) ON r_regionkey = key"


def s9_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inline relation."""
    return spark.sql("SELECT code, COUNT(*) AS n FROM VALUES ('7500', 1), ('7600', 2), ('7500', 3) AS v(code, x) GROUP BY code")


SQL["s9_values"] = "SELECT code, COUNT(*) AS n FROM (VALUES ('7500', 1), ('7600', 2), ('7500', 3)) AS v(code, x) GROUP BY code"


def d11_coverage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All resolutions from one scan."""
    return cells.coverage_levels(domain.kept(spark, sf_dir))


_LEVEL = "SELECT CAST({r}000000000000 + floor((lat + 90.0) / {d}) * 1000000 + floor((lon + 180.0) / {d}) AS BIGINT) AS h3_cell, {r} AS h3_res, COUNT(DISTINCT segment_id) AS unique_segments, COUNT(DISTINCT icao24) AS unique_aircraft, COUNT(*) AS total_points FROM kp WHERE point_count >= 2 GROUP BY 1"
SQL["d11_coverage_levels"] = f"WITH {domain._points()} " + " UNION ALL ".join(_LEVEL.format(r=r, d=d) for r, d in ((3, "8.0"), (4, "4.0"), (5, "2.0"), (6, "1.0")))


@dataclass
class _Surrogate:
    """The surrogate reports as a source of hours."""

    sf_dir: str

    def hour(self, spark: SparkSession, when: date, hour: int) -> DataFrame:
        start = 86400 * (when - date(1970, 1, 1)).days + 3600 * hour
        return domain.states(spark, self.sf_dir).filter((F.col("time") >= start) & (F.col("time") < start + 3600))


def d25_hours_to_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day extracted hour by hour, read back from its hour files."""
    store = pipeline.Store(spark, Config(data_dir=_scratch(spark)))
    day = date(2024, 1, 2)
    pipeline.extract(store, _Surrogate(sf_dir), [day])
    return store.read("states", day).groupBy("icao24").agg(F.count("*").alias("reports"))


def d26_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days aggregated one by one; the merged tables hold all of them."""
    store = pipeline.Store(spark, Config(data_dir=_scratch(spark)))
    found, pts = domain.by_period(spark, sf_dir)
    for period in range(4):
        day = date(2024, 1, 1 + period)
        for name, rows in (("points", pts), ("incidents", found)):
            sinks.write(rows.filter(F.col("period") == period).drop("period"), store.path(name, day))
        if pipeline.aggregate(store, [day], [domain.RESOLUTION]):
            raise RuntimeError("incident metrics failed")
    incident = store.read("cell_incidents", None, domain.RESOLUTION).select("h3_cell", "incidents_unique", "incidents_coverage")
    return store.read("coverage", None, domain.RESOLUTION).join(incident, "h3_cell").drop("h3_res")


SQL["d26_merged_days"] = f"""WITH {domain._PERIODS}, i AS (SELECT h3_cell, CAST(SUM(incidents_unique) AS BIGINT) AS incidents_unique, CAST(SUM(incidents_coverage) AS BIGINT) AS incidents_coverage FROM dual GROUP BY h3_cell),
d AS (SELECT period, h3_cell, COUNT(DISTINCT segment_id) AS a, COUNT(DISTINCT icao24) AS b, COUNT(*) AS c FROM cp WHERE point_count >= 2 GROUP BY 1, 2)
SELECT h3_cell, CAST(SUM(a) AS BIGINT) AS unique_segments, CAST(SUM(b) AS BIGINT) AS unique_aircraft, CAST(SUM(c) AS BIGINT) AS total_points, ANY_VALUE(incidents_unique) AS incidents_unique, ANY_VALUE(incidents_coverage) AS incidents_coverage
FROM d JOIN i USING (h3_cell) GROUP BY h3_cell"""
SQL["d25_hours_to_day"] = f"WITH {domain._SV} SELECT icao24, COUNT(*) AS reports FROM sv WHERE time >= 1704153600 AND time < 1704240000 GROUP BY icao24"

for _f in (s4_explicit_list, s7_hour_extraction, s8_arrow_scan, s9_values, d11_coverage_levels, d25_hours_to_day, d26_merged_days, k1_partitioned_roundtrip, k2_lines_roundtrip, k4_empty_result, s10_named_views, d10_stamped):
    QUERIES[_f.__name__] = _f
