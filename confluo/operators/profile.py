"""Profiles of variables and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.numeric import col, ratio

PROFILE = ("n", "n_sensors", "mean", "std", "skew", "min", "q1", "median", "q3", "iqr", "upper_iqr", "p99", "max", "share_zero", "share_negative")


def skewness(value: Column | str) -> Column:
    """Sample skewness with the correction for bias; null for under three values and 0 for equal ones."""
    n = F.count(col(value)).cast("double")
    return F.when(n >= 3, F.when(F.stddev_samp(col(value)) == 0, 0.0).otherwise(F.try_divide(F.skewness(col(value)) * F.sqrt(n * (n - 1)), n - 2)))


def variable_profile(long: DataFrame, variable: str = "variable", value: str = "value", sensor: str = "station_code", iqr_multiplier: float = 3.0) -> DataFrame:
    """One row a variable: counts, exact quantiles with linear interpolation, moments and shares, all from one grouping."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.99)]))
    v = F.col(value)
    out = long.groupBy(variable).agg(
        F.count(value).alias("n"), F.countDistinct(F.col(sensor).cast("string")).alias("n_sensors"), F.min(value).alias("min"), p.alias("__p"), F.max(value).alias("max"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), skewness(value).alias("skew"),
        F.avg(F.coalesce(v == 0, F.lit(False)).cast("double")).alias("share_zero"), F.avg(F.coalesce(v < 0, F.lit(False)).cast("double")).alias("share_negative"),
    )
    iqr = F.col("__p")[2] - F.col("__p")[0]
    out = out.select("*", *[F.col("__p")[k].alias(n) for k, n in enumerate(("q1", "median", "q3", "p99"))], iqr.alias("iqr"), (F.col("__p")[2] + iqr_multiplier * iqr).alias("upper_iqr"))
    return out.select(variable, *PROFILE)


def recommend_transform(profile: DataFrame, *, least: int = 20, skew: float = 1.0, tail: float = 10.0) -> DataFrame:
    """``recommended_transform`` for each row of a profile; ``log10`` needs positive values, ``log10_1p`` none below 0."""
    long_tail = lambda low: (F.col("skew") >= skew) | (ratio("p99", low) >= tail)
    name = (
        F.when(F.col("n") < least, "identity")
        .when((F.col("min") > 0) & long_tail("median"), "log10")
        .when((F.col("min") >= 0) & long_tail("q1"), "log10_1p")
        .otherwise("identity")
    )
    return profile.withColumn("recommended_transform", name)


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Mean of what isn't null by weight; null where the weights of these aren't over 0."""
    v, w = col(value), col(weight)
    total = F.sum(F.when(v.isNotNull(), w))
    return F.when(total > 0, F.try_divide(F.sum(v * w), total))


def weighted_share(condition: Column, weight: Column | str) -> Column:
    """Share by weight of the rows in which a condition holds, of those in which it is known."""
    return weighted_mean(condition.cast("double"), weight)
