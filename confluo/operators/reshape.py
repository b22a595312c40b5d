"""Wide and long tables, grids and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(ids), list(values), name, value)


def month_to_daily(df: DataFrame, prefix: str = "discharge_", suffix: str = "_status", date: str = "date") -> DataFrame:
    """One row a day of rows that hold a month in columns ``<prefix>1`` to ``<prefix>31``; days that the month lacks are dropped."""
    days = [d for d in range(1, 32) if f"{prefix}{d}" in df.columns]
    if not days:
        raise ValueError(f"no columns {prefix}1 to {prefix}31")
    each = [
        F.struct(F.lit(d).alias("day"), F.col(f"{prefix}{d}").cast("string").try_cast("double").alias("value"), (F.col(f"{prefix}{d}{suffix}") if f"{prefix}{d}{suffix}" in df.columns else F.lit(None)).cast("string").alias("quality_flag"))
        for d in days
    ]
    keep = [c for c in df.columns if not (c.startswith(prefix) and c[len(prefix) :].split("_")[0].isdigit()) and c != date]
    start = F.trunc(F.to_date(F.col(date)), "MM")
    long = df.select(*keep, start.alias("__start"), F.explode(F.array(*each)).alias("__d"))
    day = F.date_add("__start", F.col("__d.day") - 1)
    return long.where(F.month(day) == F.month("__start")).select(*keep, day.alias("date"), "__d.value", "__d.quality_flag")


def pivot_sum(df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence[str], fill: float | None = 0) -> DataFrame:
    """Sums by name in columns, one for each of ``names``: the names are given, so no pass looks for them."""
    wide = df.groupBy(*ids).pivot(name, list(names)).agg(F.sum(value))
    return wide if fill is None else wide.fillna(fill, list(names))


def complete_grid(df: DataFrame, unit: str, periods: DataFrame, period: str) -> DataFrame:
    """Every unit at every period, with the row of ``df`` or nulls. The periods are few and are broadcast if Spark finds them so."""
    return df.select(unit).distinct().crossJoin(periods.select(period).distinct()).join(df, [unit, period], "left")


def year_range(df: DataFrame, year: str) -> DataFrame:
    """All years from the first to the last of ``df``."""
    ends = df.agg(F.min(year).alias("a"), F.max(year).alias("b"))
    return ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias(year))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables by column name; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def explode_lists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each place of lists that belong together; shorter ones are filled with nulls."""
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.explode(F.arrays_zip(*columns)).alias("__z")).select(*keep, *[F.col("__z")[c].alias(c) for c in columns])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order, which should have no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def rename_known(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed as far as they are there."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})
