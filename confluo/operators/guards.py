"""Checks on schemas and keys, and choices among columns and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{what} lacks {', '.join(missing)}")
    return df


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """The table, if no two rows have the same keys; null keys count as equal."""
    again = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{what} has {again[0]['count']} rows with {', '.join(f'{k}={again[0][k]!r}' for k in keys)}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_many") -> DataFrame:
    """A join on equal keys that raises if ``one`` side has repeated ones."""
    one_left, one_right = (side == "one" for side in validate.split("_to_"))
    if one_left:
        assert_unique(left, on, "the left table")
    if one_right:
        assert_unique(right, on, "the right table")
    return left.join(right, list(on), how)


def first_present(candidates: Sequence[str], available: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in available), None)


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def first_table(spark: SparkSession, names: Sequence[str]) -> DataFrame | None:
    """The first of the named tables that exists."""
    name = next((n for n in names if spark.catalog.tableExists(n)), None)
    return None if name is None else spark.table(name)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns in which at least one value is a number, found in one pass."""
    kinds = dict(df.dtypes)
    some = [c for c in df.columns if c not in exclude and not kinds[c].startswith(("array", "map", "struct", "binary"))]
    if not some:
        return []
    row = df.agg(*[F.count(F.col(c).cast("string").try_cast("double")).alias(c) for c in some]).first()
    return [c for c in some if row[c]]


def dense_columns(df: DataFrame, most_null: float = 0.5) -> list[str]:
    """Columns of which less than ``most_null`` is null, found in one pass."""
    if not df.columns:
        return []
    row = df.agg(F.count("*").alias("__n"), *[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row["__n"] and 1 - row[c] / row["__n"] < most_null]


def varies(df: DataFrame, column: str) -> bool:
    """Whether a column has at least two values that aren't null."""
    return df.select(column).dropna().distinct().limit(2).count() == 2
