import json

import pytest
from pyspark.sql import functions as F

from driftline.functions import geo
from driftline.operators import cells as C
from driftline.operators import export, serving

POINTS = "segment_id string, icao24 string, point_count long, lat double, lon double"
INC = "incident_id string, segment_id string, icao24 string, emergency_type string"


def points(spark, rows):
    return spark.createDataFrame(rows, POINTS)


def seg(sid, icao, places, count=None):
    return [(sid, icao, count or len(places), a, b) for a, b in places]


def test_coverage_counts(spark):
    rows = seg("a_1", "a", [(1.0, 1.0)] * 10) + seg("a_2", "a", [(1.5, 1.5)] * 2) + seg("b_1", "b", [(1.0, 1.0)]) + seg("c_1", "c", [(1.0, 1.0)] * 7 + [(None, 1.0)] * 3)
    r = C.coverage(points(spark, rows), 3).collect()
    assert len(r) == 1
    assert (r[0].unique_segments, r[0].unique_aircraft, r[0].total_points, r[0].h3_res) == (3, 2, 19, 3)
    with pytest.raises(ValueError, match="resolution"):
        C.coverage(points(spark, rows), 7)


def test_quality_spreads_evenly(spark):
    rows = seg("a_1", "a", [(1.0, 1.0)] * 9 + [(20.0, 20.0)]) + seg("b_1", "b", [(1.0, 1.0)] * 30)
    got = {r.h3_cell: r for r in C.quality(points(spark, rows), 3).collect()}
    near = got[3 * 10**12 + 11 * 10**6 + 22]
    assert (near.unique_segments, near.median_points_per_cell, near.coverage_category) == (2, 17.5, "excellent")
    assert [r.coverage_category for r in got.values() if r.unique_segments == 1] == ["limited"]


def dual(spark, inc, pts):
    return C.dual_metrics(spark.createDataFrame(inc, INC), points(spark, pts), 3)


def test_dual_metrics(spark):
    pts = sum([seg(f"a_{i}", "a", [(1.0, 1.0)] * 4) for i in range(5)], []) + seg("b_1", "b", [(1.0, 1.0)] * 2 + [(50.0, 50.0)]) + seg("c_1", "c", [(70.0, 70.0)])
    got = {r.h3_cell: r for r in dual(spark, [("i1", "a_0", "a", "7700"), ("i2", "b_1", "b", "7500")], pts).collect()}
    assert len(got) == 3
    near = got[3 * 10**12 + 11 * 10**6 + 22]
    assert (near.incidents_unique, near.aircraft_with_incidents, near.incidents_coverage, near.unique_segments) == (2, 2, 6, 6)
    assert (near.emergency_types_list, near.predominant_emergency_type, near.emergency_type_diversity) == (["7500", "7700"], "7700", 2)
    assert near.incidents_7500 + near.incidents_7600 + near.incidents_7700 == near.incidents_unique
    assert near.incident_rate == pytest.approx(2 / 6)
    empty = [r for r in got.values() if not r.incidents_unique]
    assert len(empty) == 1 and empty[0].emergency_types_list is None and empty[0].incident_rate == 0


def test_rate_counts_segments(spark):
    pts = sum([seg(f"a_{i}", "a", [(1.0, 1.0)] * 2) for i in range(5)], [])
    assert dual(spark, [("i1", "a_0", "a", "7700")], pts).first().incident_rate == 0.2


def test_no_incidents_and_no_points(spark):
    assert dual(spark, [], seg("a_1", "a", [(1.0, 1.0)])).first().incidents_unique == 0
    assert dual(spark, [], []).count() == 0


def test_mapping_and_by_type(spark):
    pts = points(spark, seg("a_1", "a", [(1.0, 1.0), (1.0, 1.0), (50.0, 50.0)]))
    inc = spark.createDataFrame([("i1", "a_1", "a", "7600")], INC)
    assert C.mapping(inc, pts, 4).count() == 2
    assert {(r.incidents_7600, r.incidents_all) for r in C.by_type(inc, pts, 4).collect()} == {(1, 1)}


CELL = "h3_cell long, h3_res int, incidents_unique long, aircraft_with_incidents long, incidents_coverage long, unique_segments long, total_segments long, emergency_types_list array<string>, incidents_7500 long, incidents_7600 long, incidents_7700 long"


def test_merges(spark):
    cov = spark.createDataFrame([(1, 3, 10, 8, 100), (1, 3, 15, 12, 150), (2, 3, 1, 1, 1), (1, 4, 9, 9, 9)], "h3_cell long, h3_res int, unique_segments long, unique_aircraft long, total_points long")
    assert sorted(map(tuple, C.merge_coverage(cov, 3).collect())) == [(1, 3, 25, 20, 250), (2, 3, 1, 1, 1)]
    days = spark.createDataFrame([(1, 3, 3, 3, 4, 100, 100, ["7700"], 0, 0, 3), (1, 3, 4, 4, 4, 150, 150, ["7500", "7700"], 1, 0, 3), (2, 3, 0, 0, 0, 5, 5, None, 0, 0, 0)], CELL)
    a, b = C.merge_incidents(days, 3).orderBy("h3_cell").collect()
    assert (a.incidents_unique, a.aircraft_with_incidents, a.incidents_coverage, a.unique_segments) == (7, 7, 8, 250)
    assert (a.emergency_types_list, a.predominant_emergency_type, a.emergency_type_diversity) == (["7500", "7700"], "7700", 2)
    assert a.incident_rate == pytest.approx(7 / 250)
    assert (b.emergency_types_list, b.emergency_type_diversity, b.predominant_emergency_type) == ([], 0, None)
    pairs = spark.createDataFrame([("i1", 1, 3), ("i1", 1, 3), ("i1", 2, 3), ("i2", 1, 3), ("i2", 9, 4)], "incident_id string, h3_cell long, h3_res int")
    assert C.merge_mapping(pairs, 3).count() == 3
    assert C.visible(cov, 10).count() == 2


def test_geojson(spark):
    cov = C.coverage(points(spark, seg("a_1", "a", [(1.0, 1.0)] * 3)), 3)
    line = json.loads(export.geojson_lines(cov, None, 3).first().json_text)
    assert line["properties"]["h3_cell"] == "3000011000022"
    assert list(line["properties"]) == list(export.PROPERTIES)
    assert line["properties"]["incident_rate"] is None
    ring = line["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and len(ring) == 5
    joined = export.geojson_lines(cov, dual(spark, [("i", "a_1", "a", "7700")], seg("a_1", "a", [(1.0, 1.0)] * 3)), 3)
    assert json.loads(joined.first().json_text)["properties"]["emergency_types_list"] == ["7700"]


def test_grid_ids_carry_the_resolution(spark):
    r = spark.range(1).select(*(geo.grid_cell(F.lit(-90.0), F.lit(-180.0), n).alias(f"r{n}") for n in (3, 6)), geo.grid_cell(F.lit(None).cast("double"), F.lit(1.0), 3).alias("none")).first()
    assert (r.r3, r.r6, r.none) == (3 * 10**12, 6 * 10**12, None)


def test_serving(spark):
    inc = spark.createDataFrame([(f"i{k}", 100 + k % 3, 200, "7700" if k % 2 else "7500", "a", 60, 50, 1.0, 2.0) for k in range(10)], "incident_id string, start_time long, end_time long, emergency_type string, icao24 string, confidence_score int, duration_seconds long, start_lat double, start_lon double")
    mapping = spark.createDataFrame([(f"i{k}", 5, 3) for k in list(range(8)) * 2], "incident_id string, h3_cell long, h3_res int")
    page = serving.incident_page(mapping, inc, 5, limit=3, offset=1).collect()
    assert [r.incident_id for r in page] == ["i5", "i1", "i4"]
    assert serving.incident_page(mapping, inc, 5, "7500").count() == 4
    assert serving.incident_page(mapping, inc, 6).count() == 0
    with pytest.raises(ValueError, match="limit"):
        serving.incident_page(mapping, inc, 5, limit=1001)
    assert serving.cell_number("0x85283473fffffff") is None and serving.cell_number("12") == 12
    url = serving.with_replay(serving.incident_page(mapping, inc, 5, limit=1), "https://x/").first().replay_url
    assert url == "https://x/?icao=a&showTrace=1970-01-01&timestamp=102&lat=1.0&lon=2.0&zoom=10"
    rows = export.csv_rows(serving.incident_page(mapping, inc, 5, limit=1))
    assert rows.columns == list(export.CSV_COLUMNS)


def test_tile_command():
    c = export.tile_command("x.geojsonl.gz", "y.pmtiles", 5)
    assert c[0] == "tippecanoe" and "--minimum-zoom=5" in c and "--maximum-zoom=9" in c and "-P" in c and c[-1] == "x.geojsonl.gz"
    assert export.zoom_range(8) == (8, 12)
