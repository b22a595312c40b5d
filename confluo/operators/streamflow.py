"""Daily streamflow: station rules, constant runs, jumps, and one row a station and day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from confluo.functions.numeric import quality_rank
from confluo.operators.guards import require_columns
from confluo.operators.reshape import first_by, month_to_daily
from confluo.operators.windows import over, rolling_mean, run_lengths


@dataclass(frozen=True)
class StreamflowRules:
    sentinel: float = 100_000.0
    bad_station_share: float = 0.05
    suspicious_run: int = 31
    longest_run: int = 365
    small_before: float = 0.01
    jump_ratio: float = 10_000.0
    most: float = 1_000_000.0
    sentinels: tuple[float, ...] = (9999.0, 99999.0, 999999.0)


DEFAULT_RULES = StreamflowRules()

#: Months that a task makes into days. Those compress so well that Spark, which counts compressed bytes, would put too many of them in a task.
MONTHS_A_TASK = 20_000


def apply_rules(daily: DataFrame, rules: StreamflowRules = DEFAULT_RULES, tie: tuple[str, ...] = ()) -> DataFrame:
    """Flags for bad stations, constant runs and jumps; sentinels and runs that are too long become null.

    ``daily`` has ``station_code``, ``date`` and ``discharge``; ``tie`` orders rows of one day. The jump looks at the row before, after long runs are gone.
    """
    station = Window.partitionBy("station_code")
    x = F.col("discharge")
    order = ["date", *tie]
    sentinel = F.coalesce(x == rules.sentinel, F.lit(False))
    share = F.try_divide(F.count_if(sentinel).over(station).cast("double"), F.count("discharge").over(station).cast("double"))
    marked = daily.withColumn("flag_bad_station", F.coalesce(share > rules.bad_station_share, F.lit(False))).withColumn("discharge", F.when(~sentinel, x))
    runs = run_lengths(marked, "station_code", order, "discharge", "__length", "__run")
    n, there = F.col("__length"), x.isNotNull()
    runs = runs.withColumn("flag_constant_run_suspicious", there & F.coalesce(x != 0, F.lit(False)) & n.between(rules.suspicious_run, rules.longest_run))
    runs = runs.withColumn("discharge", F.when(n <= rules.longest_run, x)).drop("__length", "__run")
    before = F.lag("discharge").over(over("station_code", order))
    jump = ((before > 0) & (before < rules.small_before) & (F.try_divide(x, before) > rules.jump_ratio)) | ((before == 0) & (x > 0))
    return runs.withColumn("flag_jump_suspicious", F.coalesce(jump, F.lit(False)))


def best_rows(daily: DataFrame, rules: StreamflowRules = DEFAULT_RULES, tie: tuple[str, ...] = ()) -> DataFrame:
    """One row a station and day: most consistent, with a discharge, of the best quality, least flagged, newest; then by ``tie``."""
    x = F.col("discharge")
    wrong = (x < 0) | (x > rules.most) | x.isin(list(rules.sentinels))
    valid = daily.withColumn("discharge", F.when(~F.coalesce(wrong, F.lit(False)), x))
    flags = sum((F.col(c).cast("int") for c in ("flag_bad_station", "flag_constant_run_suspicious", "flag_jump_suspicious")), F.lit(0))
    order = [F.coalesce(F.col("consistency_level").cast("string").try_cast("double"), F.lit(-1.0)).desc(), F.col("discharge").isNotNull().desc(), quality_rank("quality_flag").desc(), flags.asc(), F.col("updated_at").desc_nulls_last()]
    return first_by(valid, ["station_code", "date"], [*order, *[F.col(c) for c in tie]])


def build_clean_streamflow_daily(monthly: DataFrame, rules: StreamflowRules = DEFAULT_RULES) -> DataFrame:
    """Nine columns, one row a station and day, from rows of a month each with ``discharge_1`` to ``discharge_31``.

    The months are dealt out by station to as many tasks as they need; the days are made after that and aren't sent on.
    """
    require_columns(monthly, ["station_code", "date"], "streamflow")
    for c in ("consistency_level", "streamflow_acquisition_method", "updated_at"):
        if c not in monthly.columns:
            monthly = monthly.withColumn(c, F.lit(None).cast("string"))
    tasks = max(monthly.sparkSession.sparkContext.defaultParallelism, -(-monthly.count() // MONTHS_A_TASK))
    daily = month_to_daily(monthly.repartition(tasks, "station_code")).withColumnRenamed("value", "discharge").withColumn("updated_at", F.try_to_timestamp(F.col("updated_at").cast("string")))
    tie = ("consistency_level", "updated_at", "quality_flag", "discharge")
    best = best_rows(apply_rules(daily, rules, tie), rules, ("discharge",))
    return best.select("station_code", "date", "discharge", "quality_flag", "consistency_level", "streamflow_acquisition_method", "flag_constant_run_suspicious", "flag_jump_suspicious", "flag_bad_station")


def streamflow_features(daily: DataFrame, windows: tuple[int, ...] = (7, 31)) -> DataFrame:
    """The discharge of the day and means over the last rows of the station."""
    w = over("station_code", "date")
    return daily.where("station_code is not null and date is not null").select(
        "station_code", "date", F.col("discharge").alias("streamflow_discharge_day"), *[rolling_mean("discharge", w, k).alias(f"streamflow_discharge_mean_{k}d") for k in windows]
    )
