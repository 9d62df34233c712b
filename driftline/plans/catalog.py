"""All queries of the package outside the optional subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.plans import domain, extensions, primitives


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**primitives.QUERIES, **domain.QUERIES, **extensions.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**primitives.SQL, **domain.SQL, **extensions.SQL}
