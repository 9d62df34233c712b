"""Table schemas as DDL; nothing is inferred when a plan reads or writes."""

from __future__ import annotations

from pyspark.sql.types import StructType


def parse(ddl: str) -> StructType:
    """The schema of a DDL string; needs a session."""
    return StructType.fromDDL(ddl)


POINT = "struct<time:long,lat:double,lon:double,squawk:string,onground:boolean,alert:boolean>"
STATES = "time long, icao24 string, callsign string, lat double, lon double, squawk string, onground boolean, alert boolean"
SEGMENTS = f"segment_id string, icao24 string, start_time long, end_time long, duration_seconds long, distance_km double, point_count long, squawk_count long, squawk_coverage_ratio double, keep_reason string, points array<{POINT}>"
INCIDENTS = (
    "incident_id string, segment_id string, icao24 string, emergency_type string, start_time long, end_time long, duration_seconds long, total_samples long, ground_percentage double, confidence_score int, confidence_level string, has_roller_dial boolean, roller_dial_codes array<string>, start_lat double, start_lon double, processing_date date, detected_at timestamp"
)
COVERAGE = "h3_cell long, h3_res int, unique_segments long, unique_aircraft long, total_points long"
CELL_INCIDENTS = (
    "h3_cell long, h3_res int, incidents_unique long, aircraft_with_incidents long, incidents_coverage long, unique_segments long, total_segments long, emergency_types_list array<string>, emergency_type_diversity int, predominant_emergency_type string, incidents_7500 long, incidents_7600 long, incidents_7700 long, incident_rate double"
)
MAPPING = "incident_id string, h3_cell long, h3_res int"
