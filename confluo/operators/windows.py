"""Window operators. Each takes the unit and an order without ties, and leaves the partitioning by unit to Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from confluo.functions.numeric import col
from confluo.session import free_name


def over(unit: Sequence[str] | str, order: Sequence[str | Column] | str) -> WindowSpec:
    unit, order = ([x] if isinstance(x, str) else list(x) for x in (unit, order))
    return Window.partitionBy(*unit).orderBy(*order)


def rolling_mean(value: Column | str, w: WindowSpec, rows: int) -> Column:
    """Mean of the last ``rows`` rows, nulls skipped. Rows are counted, not days."""
    return F.avg(col(value)).over(w.rowsBetween(-(rows - 1), 0))


def rolling_sum_full(value: Column | str, w: WindowSpec, rows: int) -> Column:
    """Sum of the last ``rows`` rows, null until there are so many and where one of them is null."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(col(value)).over(frame) == rows, F.sum(col(value)).over(frame))


def difference(value: Column | str, w: WindowSpec) -> Column:
    """Change from the row before, however far that is in time."""
    return col(value) - F.lag(col(value)).over(w)


def cumulative_mean(value: Column | str, w: WindowSpec) -> Column:
    """Mean so far of what isn't null; null before the first."""
    return F.avg(col(value)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def cumulative_sum(value: Column | str, w: WindowSpec) -> Column:
    """Sum so far; null from the first null on."""
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count_if(col(value).isNull()).over(frame) == 0, F.sum(col(value)).over(frame))


def forward_fill(value: Column | str, w: WindowSpec) -> Column:
    return F.last(col(value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def run_lengths(df: DataFrame, unit: str, order: Sequence[str | Column], value: str, length: str = "run_length", run: str = "run_id") -> DataFrame:
    """Number and length of the run of equal values that each row is in. Each null is a run of its own."""
    w = over(unit, order)
    fresh = F.lag(value).over(w).eqNullSafe(F.col(value)) & F.col(value).isNotNull()
    marked = df.withColumn(run, F.sum(F.when(fresh, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn(length, F.count("*").over(Window.partitionBy(unit, run)))


def interpolate(df: DataFrame, unit: str, order: str, value: str, out: str, extend: bool = True) -> DataFrame:
    """Nulls between two values filled in a straight line by row position. ``extend`` repeats the last value after it; leading nulls stay."""
    w = over(unit, order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    some = F.col(value).isNotNull()
    k, a, i, b, j = (free_name(df.withColumn(out, F.lit(0)), f"__confluo_{x}") for x in "kaibj")
    placed = df.withColumn(k, F.row_number().over(w))
    placed = placed.select(
        "*",
        F.last(value, ignorenulls=True).over(before).alias(a), F.last(F.when(some, F.col(k)), ignorenulls=True).over(before).alias(i),
        F.first(value, ignorenulls=True).over(after).alias(b), F.first(F.when(some, F.col(k)), ignorenulls=True).over(after).alias(j),
    )
    line = F.col(a) + (F.col(b) - F.col(a)) * (F.col(k) - F.col(i)) / (F.col(j) - F.col(i))
    filled = F.when(some, F.col(value)).when(F.col(i).isNotNull() & F.col(j).isNotNull(), line)
    if extend:
        filled = filled.when(F.col(j).isNull(), F.col(a))
    return placed.withColumn(out, filled).drop(k, a, i, b, j)


def demean(value: Column | str, unit: Sequence[str]) -> Column:
    return col(value) - F.avg(col(value)).over(Window.partitionBy(*unit))


def zscore(df: DataFrame, value: str, out: str) -> DataFrame:
    """Distance from the mean in sample deviations over the whole table. One small aggregate is joined back; no window gathers all rows."""
    m, s = (free_name(df.withColumn(out, F.lit(0)), f"__confluo_{x}") for x in "ms")
    total = df.agg(F.avg(value).alias(m), F.stddev_samp(value).alias(s))
    return df.crossJoin(F.broadcast(total)).withColumn(out, F.try_divide(F.col(value) - F.col(m), F.col(s))).drop(m, s)


def outlier(value: Column | str, unit: Sequence[str], factor: float = 1.5) -> Column:
    """Whether a value is further from the median of its group than ``factor`` interquartile ranges."""
    p = F.percentile(col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(Window.partitionBy(*unit))
    return F.abs(col(value) - p[1]) > factor * (p[2] - p[0])


def first_event(period: Column | str, value: Column | str, unit: Sequence[str]) -> Column:
    """First period in which a value is over 0; 0 if there is none."""
    return F.coalesce(F.min(F.when(col(value) > 0, col(period))).over(Window.partitionBy(*unit)), F.lit(0))


def rank_thirds(w: WindowSpec, unit: Sequence[str], names: Sequence[str] = ("low", "medium", "high")) -> Column:
    """Which of equal parts of its group a row is in by rank."""
    part = F.floor((F.row_number().over(w) - 1) * len(names) / F.count("*").over(Window.partitionBy(*unit))).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in names]), part + 1)


def keep_groups(df: DataFrame, unit: Sequence[str], condition: Column) -> DataFrame:
    """Rows of the groups for which an aggregate condition holds."""
    ok = free_name(df, "__confluo_ok")
    return df.withColumn(ok, condition.over(Window.partitionBy(*unit))).where(F.col(ok)).drop(ok)


def share_null(value: Column | str) -> Column:
    return F.avg(col(value).isNull().cast("double"))


def all_zero_or_null(value: Column | str) -> Column:
    return F.max(F.coalesce(col(value) != 0, F.lit(False)).cast("int")) == 0


def sliding_ols(df: DataFrame, unit: str, order: str, value: str, x: str, *, multiplier: float = 1.5) -> DataFrame:
    """Lines fitted over sliding windows of half a unit's rows; their median line replaces values whose residual is an outlier.

    Adds ``fitted`` and ``adjusted``. Units are small (a series each), so each is a pandas frame. A unit of fewer
    than four values keeps them all.
    """
    import numpy as np
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="mergesort")
        xs, ys = frame[x].to_numpy(float), frame[value].to_numpy(float)
        size, fits = max(len(frame) // 2, 2), []
        for k in range(len(frame) - size + 1):
            a, b = xs[k : k + size], ys[k : k + size]
            ok = np.isfinite(a) & np.isfinite(b)
            if ok.sum() >= 2 and np.ptp(a[ok]) > 0:
                fits.append(np.polyfit(a[ok], b[ok], 1))
        if len(frame) < 4 or not fits:
            return frame.assign(fitted=np.nan, adjusted=ys)
        slope, start = np.median(np.array(fits), axis=0)
        fitted = start + slope * xs
        rest = ys - fitted
        q1, q3 = np.nanpercentile(rest, [25, 75]) if np.isfinite(rest).any() else (np.nan, np.nan)
        far = (rest < q1 - multiplier * (q3 - q1)) | (rest > q3 + multiplier * (q3 - q1))
        return frame.assign(fitted=fitted, adjusted=np.where(far, fitted, ys))

    typed = df.withColumn(x, F.col(x).cast("double")).withColumn(value, F.col(value).cast("double"))
    schema = ", ".join(f"`{n}` {t}" for n, t in typed.dtypes) + ", fitted double, adjusted double"
    return typed.groupBy(unit).applyInPandas(run, schema)
