import pytest
from pyspark.sql import functions as F

from driftline.config import SegmentRules
from driftline.operators import segments as S

SCHEMA = "icao24 string, time long, lat double, lon double, squawk string, onground boolean, alert boolean"


def flight(spark, times, icao="abc123", step=0.01, squawk=None, shuffle=False):
    rows = [(icao, t, 40 + i * step, -100.0, squawk(i) if squawk else "1200", False, False) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows[::-1] if shuffle else rows, SCHEMA)
    return df


def every(n, gap=60, start=1000):
    return [start + i * gap for i in range(n)]


@pytest.mark.parametrize(("gap", "count"), [(1199, 1), (1200, 2), (1201, 2)])
def test_gap_boundary(spark, gap, count):
    first = every(5)
    df = flight(spark, first + every(5, start=first[-1] + gap), shuffle=True)
    assert S.sessions(df).select("segment_id").distinct().count() == count


@pytest.mark.parametrize(("duration", "km", "reason"), [(599, 29.9, None), (599, 30.1, "distance"), (601, 29.9, "duration"), (601, 30.1, "both"), (600, 29.9, "duration"), (599, 30.0, "distance"), (600, 30.0, "both")])
def test_keep_rule(spark, duration, km, reason):
    df = spark.createDataFrame([("a", "a_1", 0, 0.0, None), ("a", "a_1", duration, km, None)], "icao24 string, segment_id string, time long, distance_to_prev double, squawk string")
    rows = S.summarise(df).collect()
    assert [r.keep_reason for r in rows] == ([reason] if reason else [])
    marked = df.withColumns({"lat": F.lit(1.0), "lon": F.lit(1.0)})
    assert S.kept_points(marked).count() == (2 if reason else 0)


@pytest.mark.parametrize(("squawk", "count"), [(lambda i: None, 0), (lambda i: "7000" if i % 3 == 0 else None, 5), (lambda i: "7000" if i % 2 else "", 7), (lambda i: "7000", 15)])
def test_squawk_counts(spark, squawk, count):
    row = S.summarise(S.sessions(flight(spark, every(15), squawk=squawk))).first()
    assert row.squawk_count == count
    assert row.squawk_coverage_ratio == pytest.approx(count / 15)


def test_distance_is_great_circle(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0, None, False, False), ("a", 700, 0.0, 1.0, None, False, False), ("a", 800, 0.0, -179.0, None, False, False)], SCHEMA)
    d = [r.distance_to_prev for r in S.sessions(df).orderBy("time").collect()]
    assert d[0] == 0
    assert d[1] == pytest.approx(111.1949, abs=1e-3)
    assert d[2] == pytest.approx(3.141592653589793 * 6371, abs=1e-3)


def test_missing_positions_ids_and_empty_input(spark):
    df = spark.createDataFrame([("a", 0, None, 1.0, None, False, False), (None, 5, 1.0, 1.0, None, False, False), ("b", 9, 1.0, 1.0, None, False, False)], SCHEMA)
    assert [r.icao24 for r in S.sessions(df).collect()] == ["b"]
    assert S.summarise(S.sessions(df.limit(0))).count() == 0


def test_fractional_times_and_two_aircraft(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, 1.0), ("a", 1199.5, 1.0, 1.0), ("a", 2400.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0)], "icao24 string, time double, lat double, lon double")
    assert {r.segment_id for r in S.sessions(df).collect()} == {"a_1", "a_2", "b_1"}


def test_trajectory_is_ordered_and_nested(spark):
    nested = S.summarise(S.sessions(flight(spark, every(15), shuffle=True)), with_points=True)
    row = nested.first()
    assert [p.time for p in row.points] == every(15)
    assert S.flatten(nested).count() == 15


def test_scope_restarts_numbering(spark):
    df = flight(spark, every(4)).withColumn("date", F.when(F.col("time") < 1100, "d1").otherwise("d2"))
    assert {(r.date, r.segment_id) for r in S.sessions(df, scope=("date",)).collect()} == {("d1", "abc123_1"), ("d2", "abc123_1")}


@pytest.mark.parametrize("size", [1, 3, 10])
def test_batches_cover_all_aircraft(spark, size):
    df = spark.createDataFrame([(f"a{i}", t, 1.0, 1.0) for i in range(7) for t in range(i + 1)], "icao24 string, time long, lat double, lon double")
    rows = S.volume_batches(df, size).collect()
    assert len(rows) == 7
    assert {r.batch_id for r in rows} <= set(range(max(1, -(-7 // size))))


def test_one_exchange_serves_sessions_and_summaries(spark):
    plan = S.summarise(S.sessions(flight(spark, every(5))), SegmentRules())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
