import pytest
from pyspark.sql import functions as F

from driftline.config import PROFILES, Config, Gates, Profile
from driftline.operators import incidents as I

SCHEMA = "segment_id string, icao24 string, time long, lat double, lon double, squawk string, onground boolean"


def trip(spark, samples, sid="abc_1", icao="abc", calm=200, ground=0.0, start=1000, extra=()):
    """Emergency samples (time offset, code) followed by calm reports."""
    n = len(samples)
    rows = [(sid, icao, start + t, 40 + i * 0.01, -100 + i * 0.01, c, i < round(n * ground)) for i, (t, c) in enumerate(samples)]
    end = start + max(t for t, _ in samples) if samples else start
    rows += [(sid, icao, end + 10 * k, 41.0, -99.0, "1200", False) for k in range(1, calm // 10)]
    rows += [(sid, icao, start + t, 39.0, -98.0, c, False) for t, c in extra]
    return spark.createDataFrame(rows, SCHEMA)


def even(n, span, code="7700"):
    return [(round(i * span / (n - 1)), code) for i in range(n)]


@pytest.mark.parametrize(("n", "span", "found"), [(4, 60, 0), (5, 60, 0), (6, 60, 0), (8, 60, 1), (5, 61, 0), (10, 59, 1), (10, 44, 0), (10, 45, 0), (10, 46, 1), (10, 100, 1)])
def test_temporal_and_persistence_gates(spark, n, span, found):
    assert I.detect(trip(spark, even(n, span))).count() == found


@pytest.mark.parametrize(("ground", "found"), [(0, 1), (0.25, 1), (0.3, 0), (0.5, 0), (1.0, 0)])
def test_airborne_gate(spark, ground, found):
    assert I.detect(trip(spark, even(20, 90), ground=ground)).count() == found


@pytest.mark.parametrize(("n", "span", "level", "low", "high"), [(50, 130, "HIGH", 80, 100), (15, 70, "MEDIUM", 60, 79), (10, 60, "LOW", 50, 59)])
def test_levels(spark, n, span, level, low, high):
    r = I.detect(trip(spark, even(n, span))).first()
    assert r.confidence_level == level
    assert low <= r.confidence_score <= high


def test_scores_of_the_lower_edge(spark):
    assert I.scored(trip(spark, even(8, 60))).first().confidence_score == 51
    assert I.scored(trip(spark, even(6, 60))).first().confidence_score == 47


def test_priority_and_one_incident_per_segment(spark):
    both = even(20, 90, "7700") + [(t + 1, "7500") for t, _ in even(20, 90)]
    rows = I.detect(trip(spark, sorted(both))).collect()
    assert [r.emergency_type for r in rows] == ["7500"]


def test_dialled_codes_lower_the_score(spark):
    clean = I.detect(trip(spark, even(30, 90))).first()
    rolled = I.detect(trip(spark, even(30, 90), extra=[(-6, "7701"), (-4, "7702"), (-2, "7777")])).first()
    assert rolled.has_roller_dial and list(rolled.roller_dial_codes) == ["7701", "7702"]
    assert clean.confidence_score - rolled.confidence_score == 20
    assert not clean.has_roller_dial and list(clean.roller_dial_codes) == []


def records(spark, rows):
    schema = "incident_id string, segment_id string, icao24 string, emergency_type string, start_time long, end_time long, sample_count long, ground_percentage double, confidence_score int, confidence_level string, has_roller_dial boolean, roller_dial_codes array<string>, start_lat double, start_lon double"
    return spark.createDataFrame(rows, schema)


def rec(i, start, end, code="7700", icao="a", n=10):
    return (f"{icao}_{start}", f"{icao}_{i}", icao, code, start, end, n, 5.0 * i, 60 + i, "LOW", False, [], 40.0 + i, -100.0)


@pytest.mark.parametrize(("gap", "count"), [(899, 1), (900, 1), (901, 2)])
def test_debounce_boundary(spark, gap, count):
    rows = I.debounce(records(spark, [rec(1, 0, 100), rec(2, 100 + gap, 200 + gap)])).collect()
    assert len(rows) == count
    if count == 1:
        r = rows[0]
        assert (r.incident_id, r.start_lat, r.total_samples, r.confidence_score, r.ground_percentage) == ("a_0", 41.0, 20, 62, 7.5)


def test_debounce_keeps_codes_and_aircraft_apart_and_caps(spark):
    rows = I.debounce(records(spark, [rec(1, 0, 9000), rec(2, 9100, 9200, "7600"), rec(3, 9100, 9200, icao="b")])).collect()
    assert len(rows) == 3
    assert max(r.duration_seconds for r in rows) == 5400
    assert max(r.end_time for r in rows if r.icao24 == "a") == 9200


def test_position_is_that_of_the_start_or_null(spark):
    r = I.detect(trip(spark, even(20, 90))).first()
    assert (r.start_lat, r.start_lon, r.start_time) == (40.0, -100.0, 1000)
    found = I.scored(trip(spark, even(20, 90))).drop("start_lat", "start_lon")
    lost = I.start_positions(found, trip(spark, [], calm=50)).first()
    assert lost.start_lat is None


def test_calm_and_empty_trips(spark):
    assert I.detect(trip(spark, [])).count() == 0
    assert I.detect(trip(spark, even(10, 100)).limit(0)).count() == 0
    nulls = trip(spark, even(10, 100)).withColumn("squawk", F.lit(None).cast("string"))
    assert I.detect(nulls).count() == 0


def test_profiles_order(spark):
    trips = [trip(spark, even(n, 200, "7500"), f"s{n}_1", f"s{n}", start=1000 * n) for n in (10, 50, 100, 200, 300, 500, 1000)]
    pts = trips[0]
    for t in trips[1:]:
        pts = pts.union(t)
    got = {name: I.detect(pts, p, Gates()).count() for name, p in PROFILES.items()}
    assert got["none"] > got["research"] > got["production"] >= got["high_security"]
    assert got["high_security"] <= 2


def test_unknown_profile():
    with pytest.raises(ValueError, match="Unknown filter profile"):
        Config().profile("nope")
    assert Profile().bounds("7500") == (5, 99999)


def test_statistics(spark):
    r = I.statistics(I.debounce(records(spark, [rec(1, 0, 100), rec(2, 5000, 5100, "7600"), rec(3, 0, 10, icao="b")]))).first()
    assert (r.total_incidents, r.unique_aircraft, r.count_7700, r.count_7600, r.low_confidence) == (3, 2, 2, 1, 3)
    assert I.statistics(I.debounce(records(spark, []))).first().total_incidents == 0
