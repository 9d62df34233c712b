"""Day-by-day production runs: extract, segment, detect, aggregate, tiles.

Every stage writes one ``date=`` partition of its table, so reruns replace only
that day.  A stage is skipped while all its outputs are newer than its input and
made with the same settings, unless forced.  Merged tables are sums over the
daily partitions of all stored days, whichever days a run names.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import Config
from driftline.functions.geo import CELL_SYSTEMS, CellFunction
from driftline.logs import timed
from driftline.operators import cells, export, incidents, segments
from driftline.sources import sinks, tables
from driftline.sources.remote import HOURS, StateSource, check_date, with_retry

log = logging.getLogger(__name__)


def days(first: date, last: date) -> list[date]:
    if last < first:
        raise ValueError("the last date lies before the first")
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


class Store:
    """Where the tables of a data folder lie."""

    def __init__(self, spark: SparkSession, config: Config) -> None:
        self.spark, self.config = spark, config
        self.cells = CELL_SYSTEMS[config.cells]

    def path(self, table: str, day: date | None = None, resolution: int | None = None) -> str:
        parts = [self.config.data_dir, table, *([f"res={resolution}"] if resolution is not None else []), *([f"date={day}"] if day else [])]
        return "/".join(parts)

    def read(self, table: str, day: date | None = None, resolution: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.path(table, day, resolution))

    def days(self, table: str, resolution: int) -> DataFrame:
        """All stored days of a daily table of cells."""
        found = [p for p in tables.list_paths(self.spark, self.path(table, None, resolution)) if "/date=" in p and tables.modified(self.spark, f"{p}/_SUCCESS")]
        return tables.parquet(self.spark, *found)

    def stale(self, output: str, *inputs: str, made_with: object = None) -> bool:
        """Whether the output is missing, older than an input, or made with something else."""
        made = tables.modified(self.spark, f"{output}/_SUCCESS")
        if made is None or sinks.note(self.spark, output) != made_with:
            return True
        return any((t := tables.modified(self.spark, i)) is None or t > made for i in inputs)


def extract(store: Store, source: StateSource, when: Sequence[date], force: bool = False, at_once: int = 4) -> list[date]:
    """Store the reports of the hours that are not stored yet; returns the days written to.

    An hour is a partition of its day and complete once it is there, so a broken run goes on with
    the hours that it lacks.  ``at_once`` hours are asked for side by side."""
    done = []
    for day in when:
        folder = store.path("states", check_date(day))
        hours = [(h, f"{folder}/hour={h:02d}") for h in range(HOURS)]
        missing = [(h, path) for h, path in hours if force or store.stale(path)]

        def one(task: tuple[int, str], day: date = day) -> None:
            hour, path = task
            with_retry(lambda: sinks.write(source.hour(store.spark, day, hour), path))

        if missing:
            with timed(log, f"extract {day}"), ThreadPoolExecutor(at_once) as pool:
                list(pool.map(one, missing))
            done.append(day)
    return done


def segment(store: Store, when: Sequence[date], force: bool = False) -> list[date]:
    """Flat points of kept segments and the segments' summaries, per day."""
    done = []
    rules = store.config.segments
    for day in when:
        source, outputs = store.path("states", day), [store.path(t, day) for t in ("points", "segments")]
        if not force and not any(store.stale(o, source, made_with=asdict(rules)) for o in outputs):
            continue
        with timed(log, f"segment {day}"):
            pts = segments.sessions(store.read("states", day).drop("hour"), rules.gap_s)
            sinks.write(segments.kept_points(pts, rules).drop("new_segment_flag"), outputs[0], made_with=asdict(rules))
            sinks.write(segments.summarise(pts, rules), outputs[1], made_with=asdict(rules))
        done.append(day)
    return done


def detect(store: Store, when: Sequence[date], profile: str | None = None, force: bool = False) -> list[date]:
    """Incidents per day under a filter profile; another profile makes stored ones stale."""
    chosen = store.config.profile(profile)
    made_with = json.loads(json.dumps([asdict(chosen), asdict(store.config.gates)]))
    done = []
    for day in when:
        path = store.path("incidents", day)
        if force or store.stale(path, store.path("points", day), made_with=made_with):
            with timed(log, f"detect {day}"):
                found = incidents.detect(store.read("points", day), chosen, store.config.gates)
                sinks.write(incidents.stamp(found, str(day)), path, made_with=made_with)
            done.append(day)
    return done


def aggregate(store: Store, when: Sequence[date], resolutions: Sequence[int] | None = None, force: bool = False, cell: CellFunction | None = None) -> list[int]:
    """Daily cell tables of the days, then the merged ones over every stored day.

    A resolution whose incident metrics fail is logged, the others go on, and the failed ones are
    returned; a failing coverage stops the run."""
    cell = cell or store.cells.cell
    failed = []
    for resolution in resolutions or store.config.resolutions:
        cells.check_resolution(resolution)
        with timed(log, f"coverage at {resolution}"):
            for day in when:
                pts = store.path("points", day)
                out = store.path("coverage_daily", day, resolution)
                if force or store.stale(out, pts):
                    sinks.write_cells(cells.coverage(store.read("points", day), resolution, cell), out)
            sinks.write_cells(cells.merge_coverage(store.days("coverage_daily", resolution), resolution), store.path("coverage", None, resolution))
        try:
            with timed(log, f"incident metrics at {resolution}"):
                _incident_cells(store, when, resolution, force, cell)
        except Exception:
            log.exception("incident metrics failed at resolution %s", resolution)
            failed.append(resolution)
    return failed


def _incident_cells(store: Store, when: Sequence[date], resolution: int, force: bool, cell: CellFunction) -> None:
    for day in when:
        found, pts = store.path("incidents", day), store.path("points", day)
        outputs = [store.path(t, day, resolution) for t in ("cell_incidents_daily", "mapping_daily")]
        if force or any(store.stale(o, found, pts) for o in outputs):
            own, points = store.read("incidents", day), store.read("points", day)
            sinks.write_cells(cells.dual_metrics(own, points, resolution, cell), outputs[0])
            sinks.write_cells(cells.mapping(own, points, resolution, cell), outputs[1])
    sinks.write_cells(cells.merge_incidents(store.days("cell_incidents_daily", resolution), resolution), store.path("cell_incidents", None, resolution))
    sinks.write_cells(cells.merge_mapping(store.days("mapping_daily", resolution), resolution), store.path("mapping", None, resolution))


def tiles(store: Store, resolutions: Sequence[int] | None = None, min_segments: int = 1, build: bool = False) -> list[list[str]]:
    """GeoJSON lines per resolution; returns the commands that build tile sets from their files, and
    runs them if asked.  A resolution without coverage is left out."""
    commands = []
    for resolution in resolutions or store.config.resolutions:
        if tables.modified(store.spark, f"{store.path('coverage', None, resolution)}/_SUCCESS") is None:
            log.warning("no coverage at resolution %s", resolution)
            continue
        coverage = cells.visible(store.read("coverage", None, resolution), min_segments)
        path = store.path("cell_incidents", None, resolution)
        found = store.spark.read.parquet(path) if tables.modified(store.spark, f"{path}/_SUCCESS") else None
        target = store.path("tiles", None, resolution)
        files = sinks.write_lines(export.geojson_lines(coverage, found, resolution, store.cells.ring), target, name="cells", kind="geojsonl")
        commands.append(export.tile_command(files, f"{target}.pmtiles", resolution))
    if build:
        for command in commands:
            with timed(log, f"tiles {command[command.index('-o') + 1]}"):
                export.build_tiles(command)
    return commands


def summary(store: Store, when: Sequence[date]) -> DataFrame:
    """Incident statistics over days."""
    return incidents.statistics(tables.union_by_name([store.read("incidents", d).withColumn("date", F.lit(str(d))) for d in when]))
