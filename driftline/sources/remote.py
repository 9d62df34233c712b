"""State reports from a remote SQL service, by hour, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.schemas import STATES, parse

EARLIEST = date(2016, 1, 1)
HOURS = 24


class StateSource(Protocol):
    """Whatever yields the reports of one hour of a UTC day."""

    def hour(self, spark: SparkSession, when: date, hour: int) -> DataFrame: ...


def check_date(when: date, today: date | None = None) -> date:
    today = today or datetime.now(tz=UTC).date()
    if not EARLIEST <= when <= today:
        raise ValueError(f"date must be within {EARLIEST}..{today}, not {when}")
    return when


def hour_predicates(when: date, column: str = "hour") -> list[str]:
    """One partition predicate per hour, so the remote side prunes and Spark reads hours in parallel."""
    start = int(datetime(when.year, when.month, when.day, tzinfo=UTC).timestamp())
    return [f"{column} = {start + 3600 * h}" for h in range(HOURS)]


@dataclass
class JdbcStates:
    """Reports through JDBC; ``properties`` hold driver, user and the like.  ``token`` gives the
    access token of each connection anew, as one can expire during a long extraction."""

    url: str
    table: str
    properties: dict[str, str] = field(default_factory=dict)
    hour_column: str = "hour"
    token: Callable[[], str] | None = None

    def _read(self, spark: SparkSession, predicates: list[str]) -> DataFrame:
        login = {"accessToken": self.token()} if self.token else {}
        return shape(spark.read.jdbc(self.url, self.table, predicates=predicates, properties=self.properties | login))

    def hour(self, spark: SparkSession, when: date, hour: int) -> DataFrame:
        return self._read(spark, [hour_predicates(check_date(when), self.hour_column)[hour]])

    def day(self, spark: SparkSession, when: date) -> DataFrame:
        return self._read(spark, hour_predicates(check_date(when), self.hour_column))


@dataclass
class TableStates:
    """Reports from a Parquet table with an epoch column ``time``."""

    path: str

    def _span(self, spark: SparkSession, when: date, first: int, hours: int) -> DataFrame:
        start = int(datetime(check_date(when).year, when.month, when.day, tzinfo=UTC).timestamp()) + 3600 * first
        return shape(spark.read.parquet(self.path).filter((F.col("time") >= start) & (F.col("time") < start + 3600 * hours)))

    def hour(self, spark: SparkSession, when: date, hour: int) -> DataFrame:
        return self._span(spark, when, hour, 1)

    def day(self, spark: SparkSession, when: date) -> DataFrame:
        return self._span(spark, when, 0, HOURS)


def shape(raw: DataFrame) -> DataFrame:
    """The schema's columns, rows with a position, ordered by time within partitions."""
    columns = [F.col(f.name).cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in parse(STATES).fields]
    return raw.filter("lat is not null and lon is not null").select(*columns).sortWithinPartitions("time")


def with_retry(run: Callable[[], object], attempts: int = 3, wait_s: float = 5.0, busy: Callable[[Exception], bool] | None = None, sleep: Callable[[float], None] = time.sleep) -> object:
    """Run again, with doubled waits, only while the service says that its queue is full."""
    busy = busy or (lambda e: "QUERY_QUEUE_FULL" in str(e) or "queue full" in str(e).lower())
    for attempt in range(1, attempts + 1):
        try:
            return run()
        except Exception as e:
            if attempt == attempts or not busy(e):
                raise
            sleep(wait_s * 2 ** (attempt - 1))
    raise AssertionError("unreachable")
