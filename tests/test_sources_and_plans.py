import json
import re
from datetime import date

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline import config
from driftline.plans import catalog, cli, domain, pipeline, server
from driftline.sources import remote, sinks, tables

DATA = "/root/testdata/sf0.001"


def oracle(sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con.sql(sql).df()


def normal(df):
    df = df.astype(object).where(df.notna(), None)
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if x is None else round(float(x), 6) if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind in "fiu" else int(x) if isinstance(x, bool) else float(x) if isinstance(x, int) else str(x) for x in row))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    exp = oracle(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(exp.columns)
    assert normal(got) == normal(exp)


def test_gates_accept_and_reject(spark):
    n = {k: domain.QUERIES[k](spark, DATA).count() for k in ("d4_temporal_gate", "d5_persistence_gate", "d6_airborne_gate")}
    assert n["d4_temporal_gate"] > n["d5_persistence_gate"] > n["d6_airborne_gate"] > 0


def test_unions_and_arrow(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert sorted(tuple(r) for r in tables.union_by_name([a, b]).collect()) == [(1, 2), (3, None)]
    assert tables.from_arrow(spark, pa.table({"x": [1, 2]})).count() == 2
    assert tables.dated(["d/states_2025-07-02.parquet", "d/states.parquet", "d/x_2025-07-03"]) == {"2025-07-02": "d/states_2025-07-02.parquet", "2025-07-03": "d/x_2025-07-03"}


def test_lists_globs_and_missing(spark, tmp_path):
    for i in range(3):
        spark.range(i + 1).write.parquet(f"{tmp_path}/day_{i}.parquet")
    assert tables.parquet(spark, *(f"{tmp_path}/day_{i}.parquet" for i in (0, 2))).count() == 4
    assert tables.parquet(spark, f"{tmp_path}/day_*.parquet").count() == 6
    assert len(tables.list_paths(spark, str(tmp_path))) == 3
    assert tables.list_paths(spark, f"{tmp_path}/none") == [] and tables.modified(spark, f"{tmp_path}/none") is None


def test_only_the_written_partition_is_replaced(spark, tmp_path):
    path = f"{tmp_path}/t"
    frame = lambda d, n: spark.range(n).withColumn("date", F.lit(d))
    sinks.write(frame("a", 3), path, partition="date")
    sinks.write(frame("b", 2), path, partition="date")
    sinks.write(frame("a", 1), path, partition="date")
    assert {r["date"]: r["count"] for r in spark.read.parquet(path).groupBy("date").count().collect()} == {"a": 1, "b": 2}


def test_cells_are_written_sorted_for_pruning(spark, tmp_path):
    sinks.write_cells(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("h3_cell")), f"{tmp_path}/c")
    ids = [r.h3_cell for r in spark.read.parquet(f"{tmp_path}/c").withColumn("f", F.input_file_name()).orderBy("f", F.monotonically_increasing_id()).collect()]
    assert ids == sorted(ids)
    plan = spark.read.parquet(f"{tmp_path}/c").filter("h3_cell = 5")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*EqualTo\(h3_cell,5\)", plan)


def test_retry_only_when_the_queue_is_full():
    calls, waits = [], []

    def run():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("QUERY_QUEUE_FULL")
        return "ok"

    assert remote.with_retry(run, sleep=waits.append) == "ok" and waits == [5.0, 10.0]
    with pytest.raises(ValueError):
        remote.with_retry(lambda: (_ for _ in ()).throw(ValueError("other")), sleep=waits.append)
    assert len(waits) == 2
    with pytest.raises(ValueError, match="date"):
        remote.check_date(date(2015, 12, 31))
    assert len(remote.hour_predicates(date(2025, 7, 2))) == 24


def test_config_file(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('data_dir = "d"\n[segments]\ngap_minutes = 10\n[incidents]\ndefault_profile = "mine"\n[incidents.profiles.mine]\nmin_confidence = 60\nmax_samples_7500 = 9\n')
    c = config.load(f)
    assert (c.data_dir, c.segments.gap_s, c.segments.min_duration_s, c.profile().min_confidence) == ("d", 600, 600, 60)
    assert c.profile().bounds("7500") == (5, 9) and c.profile().bounds("7700") == (5, 99999)
    f.write_text("[segments]\ngap_minutes = -1\n")
    with pytest.raises(ValueError, match="positive"):
        config.load(f)
    assert config.check_size("8GB") == "8GB"
    with pytest.raises(ValueError, match="size"):
        config.check_size("8 gigs")


def test_days_cli_and_missing_config(capsys):
    p = cli.parser()
    assert cli.chosen_days(p.parse_args(["segment", "--from-date", "2025-01-30", "--to-date", "2025-02-01"])) == [date(2025, 1, 30), date(2025, 1, 31), date(2025, 2, 1)]
    for bad in (["segment"], ["segment", "--date", "2025-01-01", "--to-date", "2025-01-02"], ["segment", "--from-date", "2025-01-01"]):
        with pytest.raises(SystemExit):
            cli.chosen_days(p.parse_args(bad))
    assert cli.main(["--config", "/nowhere.toml", "segment", "--date", "2025-01-01"]) == 1
    assert cli.main(["detect", "--list-profiles"]) == 0 and "production" in capsys.readouterr().out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Two days of one flight with an emergency and one calm flight, run through every stage."""
    base = tmp_path_factory.mktemp("stored")
    rows = []
    for day in (date(2025, 7, 2), date(2025, 7, 3)):
        t0 = int(remote.datetime(day.year, day.month, day.day, 1, tzinfo=remote.UTC).timestamp())
        rows += [(t0 + 5 * i, "abc", None, 40 + i * 0.01, -100.0, "7700" if 20 <= i < 60 else "1200", False, False) for i in range(200)]
        rows += [(t0 + 5 * i, "calm", None, 41 + i * 0.01, -100.0, "1200", False, False) for i in range(200)]
    spark.createDataFrame(rows, "time long, icao24 string, callsign string, lat double, lon double, squawk string, onground boolean, alert boolean").write.parquet(f"{base}/raw")
    s = pipeline.Store(spark, config.Config(data_dir=f"{base}/data", resolutions=(3,)))
    when = pipeline.days(date(2025, 7, 2), date(2025, 7, 3))
    assert pipeline.extract(s, remote.TableStates(f"{base}/raw"), when) == when
    assert pipeline.segment(s, when) == when and pipeline.detect(s, when) == when
    pipeline.aggregate(s, when)
    return base, when


@pytest.fixture
def store(spark, stored, tmp_path):
    """A copy of the stored days that a test may change."""
    import shutil

    base, when = stored
    shutil.copytree(f"{base}/data", f"{tmp_path}/data")
    return pipeline.Store(spark, config.Config(data_dir=f"{tmp_path}/data", resolutions=(3,))), when


def test_stages_skip_fresh_output_and_serve(store):
    s, when = store
    assert pipeline.extract(s, None, when) == [] and pipeline.segment(s, when) == [] and pipeline.detect(s, when) == []
    assert s.read("incidents").count() == 2
    merged = s.read("cell_incidents", None, 3).filter("incidents_unique > 0").collect()
    assert merged and all(r.incidents_unique == 2 and r.incidents_7700 == 2 for r in merged)
    commands = pipeline.tiles(s)
    assert commands[0][0] == "tippecanoe"
    lines = [json.loads(r.value) for r in s.spark.read.text(s.path("tiles", None, 3)).collect()]
    assert len(lines) == s.read("coverage", None, 3).count()
    api = server.Api(s)
    assert api.get("/health")[0] == 200
    cell = merged[0].h3_cell
    status, _, body = api.get(f"/api/h3/summary?resolution=3&cell={cell}")
    assert status == 200 and json.loads(body)["incidents_unique"] == 2
    assert api.get("/api/h3/summary?resolution=3&cell=1")[0] == 404
    assert api.get(f"/api/h3/summary?resolution=7&cell={cell}")[0] == 422
    rows = json.loads(api.get(f"/api/h3/incidents?resolution=3&cell={cell}&type=7700")[2])
    assert rows["meta"]["count"] == 2 and "replay_url" in rows["rows"][0]
    assert json.loads(api.get("/api/h3/incidents?resolution=3&cell=0xff")[2])["rows"] == []
    text = api.get(f"/api/h3/incidents.csv?resolution=3&cell={cell}")[2]
    assert text.startswith("incident_id,start_time") and len(text.strip().splitlines()) == 3
    assert api.get("/api/h3/incidents?resolution=3&cell=1&limit=5000")[0] in (200, 422)


def totals(s):
    c, i = s.read("coverage", None, 3).collect(), s.read("cell_incidents", None, 3).collect()
    return sum(r.total_points for r in c), sum(r.incidents_unique for r in i), s.read("mapping", None, 3).count()


def test_merged_tables_hold_every_stored_day(store):
    s, when = store
    both = totals(s)
    assert pipeline.aggregate(s, when[1:]) == [] and totals(s) == both
    assert pipeline.aggregate(s, when[1:], force=True) == [] and totals(s) == both


def test_missing_second_outputs_are_made_again(store):
    import shutil

    s, when = store
    both = totals(s)
    shutil.rmtree(s.path("segments", when[0]))
    shutil.rmtree(s.path("mapping_daily", when[0], 3))
    assert pipeline.segment(s, when) == when[:1] and s.read("segments", when[0]).count() == 2
    assert pipeline.aggregate(s, when) == [] and totals(s) == both
    assert pipeline.detect(s, when, "high_security") == when and pipeline.detect(s, when, "high_security") == []


def test_failing_incident_metrics_fail_the_command(store, monkeypatch, capsys):
    s, when = store
    monkeypatch.setattr(pipeline.cells, "merge_mapping", lambda *a: 1 / 0)
    monkeypatch.setattr(cli.session, "build", lambda **k: s.spark)
    monkeypatch.setattr(cli.config, "load", lambda p: s.config)
    monkeypatch.setattr(cli.logs, "configure", lambda: None)
    f = s.config.data_dir + ".toml"
    open(f, "w").close()
    assert cli.main(["--config", f, "aggregate", "--date", "2025-07-02"]) == 1
    assert "failed at 3" in capsys.readouterr().err


def test_extraction_goes_on_with_missing_hours(spark, tmp_path):
    day, asked = date(2025, 7, 2), []

    class Source:
        def __init__(self, broken):
            self.broken = broken

        def hour(self, spark, when, hour):
            if hour in self.broken:
                raise RuntimeError("gone")
            asked.append(hour)
            return spark.createDataFrame([(hour,)], "time long")

    s = pipeline.Store(spark, config.Config(data_dir=f"{tmp_path}/d"))
    with pytest.raises(RuntimeError, match="gone"):
        pipeline.extract(s, Source({5}), [day])
    first = len(asked)
    assert pipeline.extract(s, Source(()), [day]) == [day] and sorted(asked) == list(range(24)) and 0 < first < 24
    assert sorted(r.time for r in s.read("states", day).collect()) == list(range(24))
    assert pipeline.extract(s, Source(()), [day]) == []


def test_a_failing_write_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.write(spark.range(3), path)
    bad = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.write(bad, path)
    assert spark.read.parquet(path).count() == 3
    sinks.write(spark.read.parquet(path).filter("id > 0"), path, made_with={"a": 1})  # a table may be read while it is replaced
    assert spark.read.parquet(path).count() == 2 and sinks.note(spark, path) == {"a": 1}
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_tiles_are_built_from_the_files_that_are_named(store, tmp_path, monkeypatch):
    import gzip
    import os

    s, _ = store
    command = pipeline.tiles(s)[0]
    files = [x for x in command if x.endswith(".geojsonl.gz")]
    assert files and sum(len(gzip.open(f).read().splitlines()) for f in files) == s.read("coverage", None, 3).count()
    tool = tmp_path / "bin" / "tippecanoe"
    tool.parent.mkdir()
    monkeypatch.setenv("PATH", f"{tool.parent}:{os.environ['PATH']}")
    with pytest.raises(RuntimeError, match="not installed"):
        pipeline.tiles(s, build=True)
    for script, fails in (("exit 3", "ended with 3"), ("exit 0", "left no"), ('echo > "$2"', None)):
        tool.write_text(f"#!/bin/sh\n{script}\n")
        tool.chmod(0o755)
        if fails:
            with pytest.raises(RuntimeError, match=fails):
                pipeline.tiles(s, build=True)
        else:
            assert os.path.exists(pipeline.tiles(s, build=True)[0][2])


def test_cells_and_outlines_belong_together(store):
    from driftline.functions import geo

    s, _ = store
    half = lambda c, r: F.array(F.array(F.lit(float(r)), F.lit(0.5)))
    s.cells = geo.CellSystem(geo.grid_cell, half)
    pipeline.tiles(s)
    line = json.loads(s.spark.read.text(s.path("tiles", None, 3)).first().value)
    assert line["geometry"]["coordinates"] == [[[3.0, 0.5]]]


def test_tokens_are_cached_refreshed_and_asked_for(tmp_path):
    from driftline.sources.login import Tokens

    now, sent, answers = [1000.0], [], []

    def post(url, fields):
        sent.append(fields["grant_type"])
        return answers.pop(0)

    t = Tokens("http://x", "c", "me", lambda: "pw", tmp_path / "t.json", post, lambda: now[0])
    answers[:] = [{"access_token": "a", "refresh_token": "r", "expires_in": 900}]
    assert t() == "a" and t() == "a" and sent == ["password"]
    assert (tmp_path / "t.json").stat().st_mode & 0o077 == 0
    now[0] += 700  # within the margin
    answers[:] = [{"access_token": "b", "refresh_token": "r", "expires_in": 900}]
    assert t() == "b" and sent[-1] == "refresh_token"
    now[0] += 5000
    answers[:] = [None, {"access_token": "c", "expires_in": 900}]
    assert t() == "c" and sent[-2:] == ["refresh_token", "password"]
    (tmp_path / "t.json").write_text("{broken")
    answers[:] = [None]
    with pytest.raises(RuntimeError, match="no token"):
        t()


def test_log_records_are_json_lines(capsys):
    import logging

    from driftline import logs

    log = logs.configure("driftline-test")
    with logs.timed(log, "step"):
        pass
    with pytest.raises(ValueError), logs.timed(log, "bad"):
        raise ValueError("why")
    rows = [json.loads(x) for x in capsys.readouterr().err.splitlines()]
    assert [(r["level"], r.get("operation"), r.get("error")) for r in rows] == [("INFO", "step", None), ("INFO", "step", None), ("INFO", "bad", None), ("ERROR", "bad", "why")]
    assert all(r["duration_ms"] >= 0 for r in rows[1::2])
    assert len(logging.getLogger("driftline-test").handlers) == 1


def test_csv_answers_are_attachments():
    api = server.Api(None)
    assert api.attachment("/api/h3/incidents.csv?cell=12&resolution=4") == "incidents_h3_12_r4.csv"
    assert api.attachment("/api/h3/incidents?cell=12&resolution=4") is None and api.attachment("/x.csv?cell=a") is None


def test_gated_queries_tell_codes_and_dials_apart(spark):
    rows = domain.QUERIES["d7_confidence_dialled"](spark, DATA).collect()
    assert {r.dialled for r in rows} == {True, False}
    kinds = [{r.emergency_type for r in domain.QUERIES[f"d8_profile_{n}"](spark, "/root/testdata/sf0.01").collect()} for n in ("none", "research", "production")]
    assert all(kinds) and len(kinds[0]) > 1


def test_stream_closes_segments_like_the_batch(spark, tmp_path):
    from driftline.streaming.sessions import closed_segments

    times = [t + 100_000 for t in (0, 600, 1799, 2999, 3000, 9000, 9100, 90_000)]
    spark.createDataFrame([("a", t) for t in times], "icao24 string, time long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("icao24 string, time long").parquet(f"{tmp_path}/in")
    q = closed_segments(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.start_time, r.end_time, r.point_count) for r in spark.table("closed").collect())
    assert got[:3] == [(100_000, 101_799, 3), (102_999, 103_000, 2), (109_000, 109_100, 2)]


def test_entry_point_survives_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "driftline", tmp_path / "driftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, op, pipe, known = out.stdout.split()
    assert int(n) > 70 and (op, pipe, known) == ("False", "False", "True")
