"""The domain operators as queries over the surrogate reports, each with its SQL twin.

The reports derived from ``events`` are sparse, so every threshold is scaled
from minutes to days; the operators' defaults stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import EMERGENCY_CODES, Gates, Profile, SegmentRules
from driftline.operators import cells, export, incidents, segments, serving
from driftline.sources import tables

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}

RULES = SegmentRules(gap_s=86400, min_duration_s=43200, min_distance_km=60000, batch_size=40)
GATES = Gates(window_s=432000, persistence_s=288000, tiers_s=(360000, 504000, 720000), debounce_s=259200, cap_s=600000)
TIE = ("event_id",)
RESOLUTION = 3
_by_code = lambda *n: dict(zip(EMERGENCY_CODES, n, strict=True))
SCALED = {
    "none": Profile("none", 50, 288000),
    "research": Profile("research", 50, 300000, _by_code(40, 7, 6), _by_code(5, 6, 5)),
    "production": Profile("production", 60, 360000, _by_code(6, 12, 8), _by_code(6, 5, 7)),
    "high_security": Profile("high_security", 62, 360000, _by_code(9, 9, 7), _by_code(7, 6, 7)),
}


def query(sql: str, register: bool = True) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if register:
            SQL[f.__name__] = sql
        return f

    return add


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.surrogate_states(spark.read.parquet(f"{sf_dir}/events.parquet"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.sessions(states(spark, sf_dir), RULES.gap_s, tie=TIE)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.kept_points(points(spark, sf_dir), RULES)


def relaxed(pts: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """One ungated incident record per segment and code."""
    found = incidents.samples(pts, scope, GATES, TIE).withColumns(
        {
            "persistence_seconds": F.col("incident_end") - F.col("incident_start"),
            "ground_percentage": F.round(F.col("ground_count").cast("double") / F.col("sample_count") * 100, 2),
            "roller_dial_codes": F.lit(None).cast("array<string>"),
            "start_lat": F.lit(None).cast("double"),
            "start_lon": F.lit(None).cast("double"),
        }
    )
    score, level = incidents.confidence(GATES)
    return incidents.records(found.withColumns({"confidence_score": score, "confidence_level": level}), scope)


def by_period(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(incidents, points) of kept segments, sessions starting anew each period of ten days."""
    scoped = states(spark, sf_dir).withColumn("period", F.floor((F.dayofmonth(F.col("day").cast("date")) - 1) / 10).cast("int"))
    pts = segments.kept_points(segments.sessions(scoped, RULES.gap_s, ("period",), TIE), RULES, ("period",))
    return relaxed(pts, ("period",)), pts


# --- SQL building blocks --------------------------------------------------

_SV = """sv AS (SELECT CAST(user_id AS VARCHAR) AS icao24, CAST(floor(epoch(ts)) AS BIGINT) AS time, event_id,
CAST((event_id * 7919) % 18000 AS DOUBLE) / 100 - 90 AS lat, CAST((event_id * 104729) % 36000 AS DOUBLE) / 100 - 180 AS lon,
CASE event_type WHEN 'error' THEN '7700' WHEN 'purchase' THEN '7600' WHEN 'signup' THEN '7500' WHEN 'view' THEN '1200' END AS squawk,
value < 20 AS onground, CAST(floor((day(ts) - 1) / 10) AS INTEGER) AS period FROM events)"""


def _points(scope: str = "") -> str:
    k = f"{scope}icao24"
    return f"""{_SV},
lagged AS (SELECT *, LAG(time) OVER w AS pt, LAG(lat) OVER w AS plat, LAG(lon) OVER w AS plon FROM sv WINDOW w AS (PARTITION BY {k} ORDER BY time, event_id)),
flagged AS (SELECT *, CASE WHEN pt IS NULL OR time - pt >= 86400 THEN 1 ELSE 0 END AS flag FROM lagged),
pts AS (SELECT *, CAST(SUM(flag) OVER (PARTITION BY {k} ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_num,
CASE WHEN flag = 1 THEN 0.0 ELSE 2 * 6371 * ASIN(LEAST(1.0, SQRT(POWER(SIN(RADIANS(lat - plat) / 2), 2) + COS(RADIANS(plat)) * COS(RADIANS(lat)) * POWER(SIN(RADIANS(lon - plon) / 2), 2)))) END AS dist FROM flagged),
points AS (SELECT *, icao24 || '_' || CAST(segment_num AS VARCHAR) AS segment_id FROM pts),
metrics AS (SELECT {scope}icao24, segment_id, MIN(time) AS start_time, MAX(time) AS end_time, MAX(time) - MIN(time) AS duration_seconds, SUM(dist) AS distance_km, COUNT(*) AS point_count,
COUNT(*) FILTER (WHERE squawk IS NOT NULL AND squawk <> '') AS squawk_count FROM points GROUP BY {scope}icao24, segment_id),
segs AS (SELECT *, CASE WHEN duration_seconds >= 43200 AND distance_km >= 60000 THEN 'both' WHEN duration_seconds >= 43200 THEN 'duration' WHEN distance_km >= 60000 THEN 'distance' END AS keep_reason
FROM metrics WHERE duration_seconds >= 43200 OR distance_km >= 60000),
kp AS (SELECT p.*, s.point_count FROM points p JOIN segs s USING ({scope}icao24, segment_id))"""


_SAMPLES = f""", numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY icao24, segment_id, squawk ORDER BY time, event_id) AS rn FROM kp WHERE squawk IN ('7500', '7600', '7700')),
samples AS (SELECT icao24, segment_id, squawk AS emergency_type, COUNT(*) AS sample_count, MIN(time) AS incident_start, MAX(CASE WHEN rn = {GATES.min_samples} THEN time END) AS fifth, MAX(time) AS incident_end,
COUNT(*) FILTER (WHERE onground) AS ground_count FROM numbered GROUP BY ALL),
temporal AS (SELECT *, incident_end - incident_start AS persistence_seconds FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY icao24, segment_id ORDER BY emergency_type) AS pick FROM samples
WHERE sample_count >= {GATES.min_samples} AND fifth - incident_start <= {GATES.window_s}) WHERE pick = 1),
persistent AS (SELECT * FROM temporal WHERE persistence_seconds > {GATES.persistence_s}),
airborne AS (SELECT *, ROUND(CAST(ground_count AS DOUBLE) / sample_count * 100, 2) AS ground_percentage FROM persistent WHERE CAST(ground_count AS DOUBLE) / sample_count < {GATES.ground_ratio}),
placed AS (SELECT a.*, (SELECT arg_min(k.lat, k.event_id) FROM kp k WHERE k.icao24 = a.icao24 AND k.segment_id = a.segment_id AND k.time = a.incident_start) AS start_lat,
(SELECT arg_min(k.lon, k.event_id) FROM kp k WHERE k.icao24 = a.icao24 AND k.segment_id = a.segment_id AND k.time = a.incident_start) AS start_lon FROM airborne a)"""

_LOW, _MIDDLE, _HIGH = GATES.tiers_s
#: {DIAL}: what codes dialled through add.
_SCORE_OF = f"""CAST(LEAST(sample_count * 2, 40) + CASE WHEN persistence_seconds > {_HIGH} THEN 30 WHEN persistence_seconds > {_MIDDLE} THEN 20 WHEN persistence_seconds > {_LOW} THEN 10 ELSE 5 END
+ CASE WHEN ground_percentage < 10 THEN 20 ELSE 10 END + {{DIAL}} AS INTEGER) AS confidence_score,
CASE WHEN sample_count >= 10 AND persistence_seconds > {_MIDDLE} AND ground_percentage < 10 THEN 'HIGH' WHEN sample_count >= 5 AND persistence_seconds > {_LOW} AND ground_percentage < 20 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level"""
_SCORE = _SCORE_OF.format(DIAL=10)

_SCORED = f"{_SAMPLES}, scored AS (SELECT *, {_SCORE} FROM placed)"

_DEBOUNCE = """, gaps AS (SELECT *, start_time - LAG(end_time) OVER (PARTITION BY icao24, emergency_type ORDER BY start_time, incident_id) AS gap FROM inc),
groups AS (SELECT *, SUM(CASE WHEN gap IS NULL OR gap > 259200 THEN 1 ELSE 0 END) OVER (PARTITION BY icao24, emergency_type ORDER BY start_time, incident_id ROWS UNBOUNDED PRECEDING) AS g FROM gaps),
merged AS (SELECT icao24, emergency_type, g, arg_min(incident_id, (start_time, incident_id)) AS incident_id, arg_min(segment_id, (start_time, incident_id)) AS segment_id, MIN(start_time) AS start_time, MAX(end_time) AS end_time,
LEAST(MAX(end_time) - MIN(start_time), 600000) AS duration_seconds, CAST(SUM(sample_count) AS BIGINT) AS total_samples, ((2 * CAST(SUM(CAST(ROUND(ground_percentage * 100) AS BIGINT)) AS BIGINT) + COUNT(*)) // (2 * COUNT(*))) / 100 AS ground_percentage, MAX(confidence_score) AS confidence_score,
arg_min(confidence_level, (start_time, incident_id)) AS confidence_level, arg_min(start_lat, (start_time, incident_id)) AS start_lat, arg_min(start_lon, (start_time, incident_id)) AS start_lon FROM groups GROUP BY icao24, emergency_type, g)"""


def _profile_sql(p: Profile) -> str:
    fits = " OR ".join(f"emergency_type = '{c}' AND sample_count BETWEEN {p.bounds(c)[0]} AND {p.bounds(c)[1]}" for c in EMERGENCY_CODES)
    return f"confidence_score >= {p.min_confidence} AND persistence_seconds >= {p.min_duration_s} AND ({fits})"


def _incidents(profile: str = "none") -> str:
    return f"""{_points()}{_SCORED}, inc AS (SELECT icao24 || '_' || CAST(incident_start AS VARCHAR) AS incident_id, segment_id, icao24, emergency_type, incident_start AS start_time, incident_end AS end_time,
sample_count, ground_percentage, confidence_score, confidence_level, start_lat, start_lon FROM scored WHERE {_profile_sql(SCALED[profile])}){_DEBOUNCE}"""


def _relaxed(scope: str = "") -> str:
    return f"""{_points(scope)}, inc AS (SELECT *, 0 AS unused, {_SCORE} FROM (SELECT {scope}icao24 || '_' || CAST(MIN(time) AS VARCHAR) AS incident_id, segment_id, icao24, squawk AS emergency_type, MIN(time) AS start_time, MAX(time) AS end_time,
MAX(time) - MIN(time) AS persistence_seconds, COUNT(*) AS sample_count, ROUND(CAST(COUNT(*) FILTER (WHERE onground) AS DOUBLE) / COUNT(*) * 100, 2) AS ground_percentage, CAST(NULL AS DOUBLE) AS start_lat, CAST(NULL AS DOUBLE) AS start_lon
FROM kp WHERE squawk IN ('7500', '7600', '7700') GROUP BY {scope}icao24, segment_id, squawk))"""


_CELL = "CAST(3000000000000 + floor((lat + 90.0) / 8.0) * 1000000 + floor((lon + 180.0) / 8.0) AS BIGINT)"


def _dual(by: str = "") -> str:
    k = f"{by}h3_cell"
    return f""", cp AS (SELECT *, {_CELL} AS h3_cell FROM kp), ic AS (SELECT {"c.period, " if by else ""}c.h3_cell, i.incident_id, i.icao24, i.emergency_type FROM cp c JOIN inc i USING ({by}segment_id)),
iu AS (SELECT {k}, COUNT(DISTINCT incident_id) AS incidents_unique, COUNT(DISTINCT icao24) AS aircraft_with_incidents, COUNT(*) AS incidents_coverage, list_sort(list_distinct(list(emergency_type))) AS types,
COUNT(DISTINCT CASE WHEN emergency_type = '7500' THEN incident_id END) AS incidents_7500, COUNT(DISTINCT CASE WHEN emergency_type = '7600' THEN incident_id END) AS incidents_7600,
COUNT(DISTINCT CASE WHEN emergency_type = '7700' THEN incident_id END) AS incidents_7700 FROM ic GROUP BY {k}),
tops AS (SELECT {k}, arg_min(emergency_type, (-n, emergency_type)) AS top FROM (SELECT {k}, emergency_type, COUNT(*) AS n FROM ic GROUP BY ALL) GROUP BY {k}),
fl AS (SELECT {k}, COUNT(DISTINCT segment_id) AS unique_segments FROM cp GROUP BY {k}),
dual AS (SELECT {k}, 3 AS h3_res, COALESCE(incidents_unique, 0) AS incidents_unique, COALESCE(aircraft_with_incidents, 0) AS aircraft_with_incidents, COALESCE(incidents_coverage, 0) AS incidents_coverage, COALESCE(unique_segments, 0) AS unique_segments,
COALESCE(unique_segments, 0) AS total_segments, types, CAST(COALESCE(len(types), 0) AS INTEGER) AS emergency_type_diversity, top AS predominant_emergency_type, COALESCE(incidents_7500, 0) AS incidents_7500, COALESCE(incidents_7600, 0) AS incidents_7600,
COALESCE(incidents_7700, 0) AS incidents_7700, CASE WHEN unique_segments > 0 THEN CAST(COALESCE(incidents_unique, 0) AS DOUBLE) / unique_segments END AS incident_rate
FROM iu JOIN tops USING ({k}) FULL OUTER JOIN fl USING ({k}))"""


_DUAL_COLUMNS = "h3_cell, h3_res, incidents_unique, aircraft_with_incidents, incidents_coverage, unique_segments, total_segments, emergency_type_diversity, predominant_emergency_type, incidents_7500, incidents_7600, incidents_7700, incident_rate"
_JOINED = ", array_to_string(types, ',') AS types"


def _listed(df: DataFrame) -> DataFrame:
    """The list of types as a string, as the comparison needs flat columns."""
    return df.withColumn("types", F.array_join("emergency_types_list", ",")).drop("emergency_types_list")


# --- segments -------------------------------------------------------------


@query(f"""WITH {_SV}, c AS (SELECT icao24, COUNT(*) AS point_count FROM sv GROUP BY icao24),
p AS (SELECT GREATEST(1, CAST(CEIL(CAST(COUNT(*) AS DOUBLE) / 40) AS INTEGER)) AS nb, SUM(point_count) AS total FROM c),
r AS (SELECT icao24, point_count, SUM(point_count) OVER (ORDER BY icao24 ROWS UNBOUNDED PRECEDING) AS cum FROM c)
SELECT icao24, point_count, CAST(LEAST(FLOOR((cum - 1) / (CAST(total AS DOUBLE) / nb)), nb - 1) AS BIGINT) AS batch_id FROM r CROSS JOIN p""")
def d0_volume_batches(spark, sf_dir):
    return segments.volume_batches(states(spark, sf_dir), RULES.batch_size)


@query(f"WITH {_points()} SELECT event_id, segment_id, segment_num FROM points")
def d1_gap_sessions(spark, sf_dir):
    return points(spark, sf_dir).select("event_id", "segment_id", "segment_num")


@query(f"WITH {_points()} SELECT icao24, segment_id, ROUND(distance_km, 6) AS distance_km FROM metrics")
def d2_track_length(spark, sf_dir):
    return points(spark, sf_dir).groupBy("icao24", "segment_id").agg(F.round(F.sum("distance_to_prev"), 6).alias("distance_km"))


@query(f"""WITH {_points()} SELECT segment_id, icao24, start_time, end_time, duration_seconds, ROUND(distance_km, 6) AS distance_km, point_count, squawk_count,
CAST(squawk_count AS DOUBLE) / point_count AS squawk_coverage_ratio, keep_reason FROM segs""")
def d3_segments(spark, sf_dir):
    return segments.summarise(points(spark, sf_dir), RULES).withColumn("distance_km", F.round("distance_km", 6))


@query(f"""WITH {_points()} SELECT segment_id, len(list(time)) AS n, array_to_string(list(CAST(time AS VARCHAR) ORDER BY time, event_id), ',') AS times FROM kp GROUP BY segment_id""")
def d3_trajectories(spark, sf_dir):
    nested = segments.summarise(points(spark, sf_dir), RULES, with_points=True, tie=TIE)
    return nested.select("segment_id", F.size("points").cast("long").alias("n"), F.array_join(F.transform("points", lambda p: p["time"].cast("string")), ",").alias("times"))


# --- incidents ------------------------------------------------------------

_GATED = "icao24, segment_id, emergency_type, sample_count, incident_start, incident_end, persistence_seconds, ground_count"


@query(f"WITH {_points()}{_SAMPLES} SELECT icao24, segment_id, emergency_type, sample_count, incident_start, fifth, incident_end, ground_count FROM samples")
def d4_samples(spark, sf_dir):
    return incidents.samples(kept(spark, sf_dir), (), GATES, TIE)


def _gate(spark, sf_dir):
    return incidents.temporal_gate(incidents.samples(kept(spark, sf_dir), (), GATES, TIE), (), GATES)


@query(f"WITH {_points()}{_SAMPLES} SELECT {_GATED} FROM temporal")
def d4_temporal_gate(spark, sf_dir):
    return _gate(spark, sf_dir)


@query(f"WITH {_points()}{_SAMPLES} SELECT {_GATED} FROM persistent")
def d5_persistence_gate(spark, sf_dir):
    return incidents.persistence_gate(_gate(spark, sf_dir), GATES)


@query(f"WITH {_points()}{_SAMPLES} SELECT {_GATED}, ground_percentage, start_lat, start_lon FROM placed")
def d6_airborne_gate(spark, sf_dir):
    passed = incidents.airborne_gate(incidents.persistence_gate(_gate(spark, sf_dir), GATES), GATES)
    return incidents.start_positions(passed, kept(spark, sf_dir), (), TIE)


@query(f"WITH {_points()}{_SCORED} SELECT segment_id, emergency_type, confidence_score, confidence_level FROM scored")
def d7_confidence(spark, sf_dir):
    return incidents.scored(kept(spark, sf_dir), GATES, (), TIE).select("segment_id", "emergency_type", "confidence_score", "confidence_level")


@query(f"""WITH {_points()} SELECT icao24, segment_id, array_to_string(list_sort(list_distinct(list(squawk))), ',') AS codes FROM
(SELECT icao24, segment_id, CASE WHEN squawk = '7600' THEN '7701' WHEN squawk = '7500' THEN '7777' ELSE squawk END AS squawk FROM kp) WHERE squawk LIKE '77%' AND squawk NOT IN ('7700', '7777') GROUP BY ALL""")
def d7_dial_codes(spark, sf_dir):
    coded = kept(spark, sf_dir).replace({"7600": "7701", "7500": "7777"}, subset=["squawk"])
    return incidents.dial_codes(coded).select("icao24", "segment_id", F.array_join("roller_dial_codes", ",").alias("codes"))


#: Every third ordinary report carries a code that is dialled through.
_DIALLED = _points().replace("WHEN 'view' THEN '1200'", "WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN '7712' ELSE '1200' END")


@query(f"""WITH {_DIALLED}{_SAMPLES}, dialled AS (SELECT DISTINCT icao24, segment_id, true AS dial FROM kp WHERE squawk = '7712')
SELECT segment_id, emergency_type, COALESCE(dial, false) AS dialled, {_SCORE_OF.format(DIAL="CASE WHEN dial THEN -10 ELSE 10 END")} FROM placed LEFT JOIN dialled USING (icao24, segment_id)""")
def d7_confidence_dialled(spark, sf_dir):
    pts = kept(spark, sf_dir).withColumn("squawk", F.when((F.col("squawk") == "1200") & (F.col("event_id") % 3 == 0), "7712").otherwise(F.col("squawk")))
    found = incidents.scored(pts, GATES, (), TIE)
    return found.select("segment_id", "emergency_type", F.col("roller_dial_codes").isNotNull().alias("dialled"), "confidence_score", "confidence_level")


def _profile_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = incidents.apply_profile(incidents.scored(kept(spark, sf_dir), GATES, (), TIE), SCALED[name])
        return found.select("segment_id", "emergency_type", "sample_count", "confidence_score")

    run.__name__ = f"d8_profile_{name}"
    query(f"WITH {_points()}{_SCORED} SELECT segment_id, emergency_type, sample_count, confidence_score FROM scored WHERE {_profile_sql(SCALED[name])}")(run)


for _name in SCALED:
    _profile_query(_name)

_MERGED = "incident_id, segment_id, icao24, emergency_type, start_time, end_time, duration_seconds, total_samples, ground_percentage, confidence_score, confidence_level"


@query(f"WITH {_relaxed()}{_DEBOUNCE} SELECT {_MERGED} FROM merged")
def d9_debounce(spark, sf_dir):
    return incidents.debounce(relaxed(kept(spark, sf_dir)), GATES).select(*_MERGED.split(", "))


@query(f"WITH {_incidents()} SELECT {_MERGED}, start_lat, start_lon, false AS has_roller_dial, '' AS codes FROM merged")
def d10_incidents(spark, sf_dir):
    found = incidents.detect(kept(spark, sf_dir), SCALED["none"], GATES, (), TIE)
    return found.select(*_MERGED.split(", "), "start_lat", "start_lon", "has_roller_dial", F.array_join("roller_dial_codes", ",").alias("codes"))


@query(f"""WITH {_relaxed()}{_DEBOUNCE} SELECT COUNT(*) AS total_incidents, COUNT(DISTINCT icao24) AS unique_aircraft, COUNT(*) FILTER (WHERE emergency_type = '7500') AS count_7500, COUNT(*) FILTER (WHERE emergency_type = '7600') AS count_7600,
COUNT(*) FILTER (WHERE emergency_type = '7700') AS count_7700, COUNT(*) FILTER (WHERE confidence_level = 'HIGH') AS high_confidence, COUNT(*) FILTER (WHERE confidence_level = 'MEDIUM') AS medium_confidence,
COUNT(*) FILTER (WHERE confidence_level = 'LOW') AS low_confidence, ROUND(AVG(confidence_score), 6) AS avg_confidence, ROUND(AVG(duration_seconds), 6) AS avg_duration, CAST(0 AS BIGINT) AS roller_dial_count FROM merged""")
def d21_stats(spark, sf_dir):
    return incidents.statistics(incidents.debounce(relaxed(kept(spark, sf_dir)), GATES))


# --- cells ----------------------------------------------------------------


@query(f"""WITH {_points()} SELECT {_CELL} AS h3_cell, 3 AS h3_res, COUNT(DISTINCT segment_id) AS unique_segments, COUNT(DISTINCT icao24) AS unique_aircraft, COUNT(*) AS total_points FROM kp WHERE point_count >= 2 GROUP BY 1""")
def d11_coverage(spark, sf_dir):
    return cells.coverage(kept(spark, sf_dir), RESOLUTION)


@query(f"""WITH {_points()}, v AS (SELECT DISTINCT segment_id, point_count, {_CELL} AS h3_cell FROM kp WHERE point_count >= 2), e AS (SELECT h3_cell, CAST(point_count AS DOUBLE) / COUNT(*) OVER (PARTITION BY segment_id) AS ppc FROM v)
SELECT h3_cell, COUNT(*) AS unique_segments, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY ppc), 9) AS median_points_per_cell, ROUND(AVG(ppc), 9) AS avg_points_per_cell,
CASE WHEN PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY ppc) >= 10 THEN 'excellent' WHEN PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY ppc) >= 6 THEN 'good' WHEN PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY ppc) >= 3 THEN 'limited' ELSE 'poor' END AS coverage_category
FROM e GROUP BY h3_cell""")
def d12_quality(spark, sf_dir):
    found = cells.quality(kept(spark, sf_dir), RESOLUTION)
    return found.withColumns({"median_points_per_cell": F.round("median_points_per_cell", 9), "avg_points_per_cell": F.round("avg_points_per_cell", 9)})


@query(f"WITH {_relaxed()}{_dual()} SELECT {_DUAL_COLUMNS}{_JOINED} FROM dual")
def d13_dual_metrics(spark, sf_dir):
    pts = kept(spark, sf_dir)
    return _listed(cells.dual_metrics(relaxed(pts), pts, RESOLUTION))


@query(f"WITH {_relaxed()}{_dual()} SELECT DISTINCT incident_id, h3_cell, 3 AS h3_res FROM ic")
def d16_mapping(spark, sf_dir):
    pts = kept(spark, sf_dir)
    return cells.mapping(relaxed(pts), pts, RESOLUTION)


@query(f"""WITH {_relaxed()}{_dual()} SELECT h3_cell, COUNT(DISTINCT CASE WHEN emergency_type = '7500' THEN incident_id END) AS incidents_7500, COUNT(DISTINCT CASE WHEN emergency_type = '7600' THEN incident_id END) AS incidents_7600,
COUNT(DISTINCT CASE WHEN emergency_type = '7700' THEN incident_id END) AS incidents_7700, COUNT(DISTINCT incident_id) AS incidents_all FROM ic GROUP BY h3_cell""")
def d18_by_type(spark, sf_dir):
    pts = kept(spark, sf_dir)
    return cells.by_type(relaxed(pts), pts, RESOLUTION)


_PERIODS = f"{_relaxed('period, ')}{_dual('period, ')}"


@query(f"""WITH {_PERIODS}, votes AS (SELECT h3_cell, unnest(types) AS type FROM dual), top2 AS (SELECT h3_cell, arg_min(type, (-n, type)) AS top, string_agg(type, ',' ORDER BY type) AS types, COUNT(*) AS diversity FROM (SELECT h3_cell, type, COUNT(*) AS n FROM votes GROUP BY ALL) GROUP BY h3_cell),
s AS (SELECT h3_cell, h3_res, CAST(SUM(incidents_unique) AS BIGINT) AS incidents_unique, CAST(SUM(aircraft_with_incidents) AS BIGINT) AS aircraft_with_incidents, CAST(SUM(incidents_coverage) AS BIGINT) AS incidents_coverage, CAST(SUM(unique_segments) AS BIGINT) AS unique_segments,
CAST(SUM(total_segments) AS BIGINT) AS total_segments, CAST(SUM(incidents_7500) AS BIGINT) AS incidents_7500, CAST(SUM(incidents_7600) AS BIGINT) AS incidents_7600, CAST(SUM(incidents_7700) AS BIGINT) AS incidents_7700 FROM dual GROUP BY ALL)
SELECT s.*, CAST(COALESCE(diversity, 0) AS INTEGER) AS emergency_type_diversity, top AS predominant_emergency_type, COALESCE(types, '') AS types, CASE WHEN unique_segments > 0 THEN CAST(incidents_unique AS DOUBLE) / unique_segments END AS incident_rate FROM s LEFT JOIN top2 USING (h3_cell)""")
def d14_merge_incidents(spark, sf_dir):
    found, pts = by_period(spark, sf_dir)
    daily = cells.dual_metrics(found, pts, RESOLUTION, by=("period",))
    return _listed(cells.merge_incidents(daily, RESOLUTION))


@query(f"""WITH {_points('period, ')}, d AS (SELECT period, {_CELL} AS h3_cell, COUNT(DISTINCT segment_id) AS a, COUNT(DISTINCT icao24) AS b, COUNT(*) AS c FROM kp WHERE point_count >= 2 GROUP BY 1, 2)
SELECT h3_cell, 3 AS h3_res, CAST(SUM(a) AS BIGINT) AS unique_segments, CAST(SUM(b) AS BIGINT) AS unique_aircraft, CAST(SUM(c) AS BIGINT) AS total_points FROM d GROUP BY h3_cell""")
def d15_merge_coverage(spark, sf_dir):
    _, pts = by_period(spark, sf_dir)
    return cells.merge_coverage(cells.coverage(pts, RESOLUTION, by=("period",)), RESOLUTION)


@query(f"WITH {_PERIODS} SELECT DISTINCT incident_id, h3_cell, 3 AS h3_res FROM ic")
def d17_merge_mapping(spark, sf_dir):
    found, pts = by_period(spark, sf_dir)
    return cells.merge_mapping(cells.mapping(found, pts, RESOLUTION, by=("period",)), RESOLUTION)


@query(f"""WITH {_points()} SELECT * FROM (SELECT {_CELL} AS h3_cell, 3 AS h3_res, COUNT(DISTINCT segment_id) AS unique_segments, COUNT(DISTINCT icao24) AS unique_aircraft, COUNT(*) AS total_points FROM kp WHERE point_count >= 2 GROUP BY 1) WHERE unique_segments >= 4""")
def d19_visibility(spark, sf_dir):
    return cells.visible(cells.coverage(kept(spark, sf_dir), RESOLUTION), 4)


# --- export and serving ---------------------------------------------------


@query(f"""WITH {_relaxed()}{_dual()}, cov AS (SELECT h3_cell, COUNT(DISTINCT segment_id) AS unique_segments, COUNT(DISTINCT icao24) AS unique_aircraft, COUNT(*) AS total_points FROM cp WHERE point_count >= 2 GROUP BY 1)
SELECT CAST(c.h3_cell AS VARCHAR) AS h3_cell, c.unique_segments, c.unique_aircraft, c.total_points, d.incidents_unique, d.incident_rate, 5 AS corners,
floor((c.h3_cell % 1000000000000) / 1000000) * 8 - 90 AS south, CAST((c.h3_cell % 1000000) * 8 - 180 AS DOUBLE) AS west FROM cov c LEFT JOIN dual d ON c.h3_cell = d.h3_cell""")
def d20_geojson(spark, sf_dir):
    pts = kept(spark, sf_dir)
    lines = export.geojson_lines(cells.coverage(pts, RESOLUTION), cells.dual_metrics(relaxed(pts), pts, RESOLUTION), RESOLUTION)
    schema = "struct<type:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<h3_cell:string,unique_segments:long,unique_aircraft:long,total_points:long,incidents_unique:long,incident_rate:double>>"
    f = lines.select(F.from_json("json_text", schema).alias("f")).select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("ring"))
    return f.select("h3_cell", "unique_segments", "unique_aircraft", "total_points", "incidents_unique", "incident_rate", F.size("ring").alias("corners"), F.col("ring")[0][1].alias("south"), F.col("ring")[0][0].alias("west"))


@query(f"WITH {_relaxed()}{_dual()} SELECT h3_cell, h3_res, incidents_unique, incidents_coverage, unique_segments, incident_rate, emergency_type_diversity, predominant_emergency_type{_JOINED} FROM dual WHERE h3_cell = 3000010000022 AND list_contains(types, '7700')")
def d22_summary(spark, sf_dir):
    pts = kept(spark, sf_dir)
    return _listed(serving.summary(cells.dual_metrics(relaxed(pts), pts, RESOLUTION), 3000010000022, "7700"))


_PAGE = f"""WITH {_relaxed()}{_DEBOUNCE}{_dual()}, ids AS (SELECT DISTINCT incident_id FROM ic WHERE h3_cell = 3000010000022)
SELECT incident_id, start_time, end_time, emergency_type, icao24, confidence_score, duration_seconds, start_lat, start_lon FROM merged WHERE incident_id IN (SELECT incident_id FROM ids) ORDER BY start_time DESC, incident_id LIMIT 50 OFFSET 1"""


def _page(spark, sf_dir):
    pts = kept(spark, sf_dir)
    raw = relaxed(pts)
    return serving.incident_page(cells.mapping(raw, pts, RESOLUTION), incidents.debounce(raw, GATES), 3000010000022, limit=50, offset=1)


@query(_PAGE)
def d23_page(spark, sf_dir):
    return _page(spark, sf_dir)


@query(f"""SELECT incident_id, start_time, end_time, emergency_type, icao24, '' AS callsign, confidence_score, '' AS confidence_category, '' AS samples_in_emergency, duration_seconds AS emergency_duration_s, '' AS ground_ratio FROM ({_PAGE})""")
def d24_csv_rows(spark, sf_dir):
    return export.csv_rows(_page(spark, sf_dir))
