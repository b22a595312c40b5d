"""Panels of units and periods."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.functions.numeric import finite, ratio, row_mean
from confluo.operators.windows import over, rolling_sum_full


def is_balanced(df: DataFrame, unit: str, period: str) -> bool:
    """Whether every unit is there in every period."""
    r = df.agg(F.countDistinct(unit).alias("u"), F.countDistinct(period).alias("p"), F.countDistinct(unit, period).alias("c")).first()
    return r["u"] * r["p"] == r["c"]


def balanced_units(df: DataFrame, unit: str, variables: Sequence[str]) -> DataFrame:
    """Rows of the units that have, in every variable, at least as many finite values as the least of the variables' medians."""
    counts = df.groupBy(unit).agg(*[F.count(finite(v)).alias(v) for v in variables])
    medians = counts.agg(*[F.median(v).alias(f"__{v}") for v in variables])
    least = F.least(*[F.col(f"__{v}") for v in variables]) if len(variables) > 1 else F.col(f"__{variables[0]}")
    # One row of medians.
    good = counts.crossJoin(F.broadcast(medians)).where(reduce(lambda a, b: a & b, [F.col(v) >= least for v in variables]))
    return df.join(good.select(unit), unit, "left_semi")


def splice(old: DataFrame, new: DataFrame, unit: str, period: str, value: str, link: int, direction: str = "old_over_new") -> DataFrame:
    """A new series continued by an old one scaled at the period in which they are linked.

    ``old_over_new`` multiplies old values by old/new at the link; ``new_over_old`` puts the old ones on the new level. Only units and periods that the new series lacks are taken.
    """
    if direction not in ("old_over_new", "new_over_old"):
        raise ValueError(f"unknown direction {direction!r}")
    at = lambda df, name: df.where(F.col(period) == link).select(unit, F.col(value).alias(name))
    factors = at(old, "__o").join(at(new, "__n"), unit).select(unit, (ratio("__o", "__n") if direction == "old_over_new" else ratio("__n", "__o")).alias("__f"))
    scaled = old.join(factors, unit).join(new.select(unit, period), [unit, period], "left_anti").select(unit, period, (F.col(value) * F.col("__f")).alias(value))
    return new.select(unit, period, F.col(value).cast("double").alias(value)).unionByName(scaled)


def mortality(deaths: DataFrame, population: DataFrame, *, unit: str = "mun_id", years: int = 5, per: float = 1000.0) -> DataFrame:
    """Deaths per ``per`` people and year, and sums of deaths over ``years`` by that year's population. Rows are put in order of years first."""
    joined = population.join(deaths, [unit, "year"], "full").fillna(0, ["deaths"])
    total = rolling_sum_full("deaths", over(unit, "year"), years)
    return joined.withColumn("mortality_rate", ratio(F.col("deaths") * per, "population")).withColumn(f"mortality_rate_{years}y", ratio(total * per, "population"))


def index_mean(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, row_mean(columns))


def transitions(pixels: DataFrame, *, pixel: str = "pixel_id", period: str = "year", code: str = "class_code", start: Sequence[int] = (1,), groups: dict[str, Sequence[int]] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Pixels that were of ``start`` in the period before and no longer are, and of these those that went to each group of classes, by ``by`` and period."""
    before = pixels.select(pixel, (F.col(period) + 1).alias(period), F.col(code).alias("__before"))
    both = pixels.join(before, [pixel, period])
    left = F.col("__before").isin(list(start)) & ~F.col(code).isin(list(start))
    each = [F.count_if(left & F.col(code).isin(list(codes))).alias(f"to_{name}") for name, codes in (groups or {}).items()]
    return both.groupBy(*by, period).agg(F.count_if(left).alias("left"), *each)


def zonal_histogram(pixels: DataFrame, zone: str, period: str, code: str, classes: Sequence[int]) -> DataFrame:
    """Pixels (``n``) of each class in each zone and period, in columns, and their total."""
    each = [F.sum(F.when(F.col(code) == c, F.col("n")).otherwise(0)).alias(f"land_cover_class_{c}") for c in classes]
    return pixels.groupBy(zone, period).agg(F.sum("n").alias("land_cover_total"), *each)


def period_mean(df: DataFrame, unit: str, stamp: str, value: str) -> DataFrame:
    return df.groupBy(unit, F.year(stamp).alias("year")).agg(F.avg(value).alias(value))


def census_municipality(state: str = "state", municipality: str = "municipality", year: str = "year"):
    """Seven-digit code; in 2010 the state is a column of its own."""
    return F.when(F.col(year) == 2010, F.col(state).cast("long") * 100_000 + F.col(municipality).cast("long")).otherwise(F.col(municipality).cast("long"))


def census_rows(rows: DataFrame, *, labels: dict[str, tuple[str, dict, str]], came_from: dict[str, str], unknown: Sequence[int] = (9_999_999, 999_999, 0), **names: str) -> DataFrame:
    """Census rows with seven-digit municipalities, codes of places that people came from, and labels instead of codes.

    ``labels`` says for a coded column the new column, the label of each code, and the label of all others; ``came_from`` the new
    column of a code of origin, in which the codes of ``unknown`` are null.
    """
    from confluo.functions.text import lookup

    out = rows.withColumn(names.get("municipality", "municipality"), census_municipality(**names))
    out = out.withColumns({new: F.when(~F.col(c).isin(list(unknown)), F.col(c).cast("long")) for c, new in came_from.items()})
    return out.withColumns({new: lookup(F.col(c).cast("int"), table, other) for c, (new, table, other) in labels.items()})


def zonal_mean(pixels: DataFrame, zones: DataFrame, value: str, *, zone: str = "zone", x: str = "x", y: str = "y", step: float = 1.0) -> DataFrame:
    """Mean of a value over the pixels of each zone (``pixels`` has ``zone``); a zone without any takes the pixel nearest to its centre.

    ``zones`` has a row a zone with the centre ``x`` and ``y``. Nearest pixels are searched for zones without pixels alone, by grid rings of ``step``.
    """
    from confluo.operators.matching import nearest_point

    means = pixels.where(F.col(zone).isNotNull()).groupBy(zone).agg(F.avg(value).alias("__mean"))
    joined = zones.select(zone, x, y).join(means, zone, "left")
    lacking = joined.where("__mean is null").select(zone, x, y)
    points = pixels.where(F.col(value).isNotNull()).withColumn("__p", F.xxhash64(x, y)).groupBy("__p", x, y).agg(F.avg(value).alias("__v"))
    near = nearest_point(lacking, points, left_id=zone, right_id="__p", x=x, y=y, step=step).join(points.select(F.col("__p").alias("right_id"), "__v"), "right_id").select(F.col("left_id").alias(zone), "__v")
    return joined.join(near, zone, "left").select(zone, F.coalesce("__mean", "__v").alias(value))


def grid_boxes(spark, box: tuple[float, float, float, float], size: float) -> DataFrame:
    """Boxes of ``size`` that cover (least x, least y, most x, most y), with their place in the grid."""
    import math

    nx, ny = (math.ceil((box[k + 2] - box[k]) / size) for k in (0, 1))
    g = spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy"))
    x, y = F.lit(box[0]) + F.col("ix") * size, F.lit(box[1]) + F.col("iy") * size
    return g.select("ix", "iy", x.alias("min_x"), y.alias("min_y"), (x + size).alias("max_x"), (y + size).alias("max_y"))
