"""Every query of the library by name, with its SQL statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from confluo.plans import cleaning, estimates, files, joins, networks, panels, relational, text  # noqa: F401  (they register their queries)
from confluo.plans.registry import QUERIES, SQL

FLAGSHIP = "upstream_bucket_assembly"


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[FLAGSHIP](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
