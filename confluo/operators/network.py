"""Aggregation along a network: land cover by distance, kernel sums, station matches and upstream weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from confluo.functions.numeric import BUCKETS, cutoff_weight, distance_bucket, kernel_weight, ratio, triangular_weight
from confluo.operators.profile import weighted_mean
from confluo.operators.reshape import first_by


def sensor_targets(observations: DataFrame, station_trench: DataFrame) -> DataFrame:
    """Distinct trenches and years in which a station on them has observations (``station_code``, ``date``)."""
    return observations.where("station_code is not null and date is not null").join(station_trench, "station_code").select("trench_id", F.year("date").alias("year")).dropna().distinct()


def upstream_by_bucket(targets: DataFrame, pairs: DataFrame, cover: DataFrame, classes: Sequence[str], buckets: Sequence[tuple[str, float | None]] = BUCKETS, total: str = "land_cover_total") -> DataFrame:
    """Land cover upstream of each target and year in each bucket of distance.

    ``pairs`` has ``target``, ``source``, ``distance``; ``cover`` a row a ``trench_id`` and ``year`` (others are summed first). For a bucket ``b``
    there are ``lc_b_tot``, ``lc_b_n`` (trenches) and, for each class column, ``lc_b_c_cnt`` and ``lc_b_c_shr``. Without cover, counts
    are 0 and shares null.
    """
    # One row a source and year here, and one a pair below, so a count of rows is one of trenches.
    yearly = cover.groupBy(F.col("trench_id").alias("source"), "year").agg(*[F.sum(c).alias(c) for c in (total, *classes)])
    keys = targets.select(F.col("trench_id").alias("target"), "year").distinct()
    near = pairs.groupBy("target", "source").agg(F.min("distance").alias("distance")).select("target", "source", distance_bucket("distance", buckets).alias("__b")).where("__b is not null")
    # Pairs meet the years at the source alone and are summed by bucket before they are spread over columns, so that few and narrow rows are sent.
    joined = near.join(yearly.join(keys.select("year").distinct(), "year", "left_semi"), "source")
    summed = joined.groupBy("target", "year", "__b").agg(F.count("source").alias("__n"), *[F.sum(c).alias(c) for c in (total, *classes)])
    each = []
    for name, _ in buckets:
        here = F.col("__b") == name
        each += [F.sum(F.when(here, F.col(total))).alias(f"lc_{name}_tot"), F.sum(F.when(here, F.col("__n"))).alias(f"lc_{name}_n")]
        each += [F.sum(F.when(here, F.col(c))).alias(f"lc_{name}_{c}_cnt") for c in classes]
    wide = keys.join(summed.groupBy("target", "year").agg(*each), ["target", "year"], "left").fillna(0)
    shares = [ratio(f"lc_{name}_{c}_cnt", f"lc_{name}_tot").alias(f"lc_{name}_{c}_shr") for name, _ in buckets for c in classes]
    return wide.select(F.col("target").alias("trench_id"), "year", *[c for c in wide.columns if c not in ("target", "year")], *shares)


def kernel_sums(pairs: DataFrame, seeds: DataFrame, cover: DataFrame, columns: Sequence[str], *, bandwidth: float, kernel: str, unit: str = "adm2_id") -> DataFrame:
    """Sums of cover by weight over the trenches upstream of a unit's seeds (``trench_id``, unit), at their least distance from any of them.

    ``cover`` has a row a ``trench_id`` and ``year``, so that rows count trenches.
    """
    nearest = pairs.join(seeds.select(F.col("trench_id").alias("target"), unit).distinct(), "target").groupBy(unit, "source").agg(F.min("distance").alias("distance"))
    weighted = nearest.withColumn("__w", kernel_weight("distance", bandwidth, kernel)).join(cover.withColumnRenamed("trench_id", "source"), "source")
    return weighted.groupBy(unit, "year").agg(*[F.sum(F.col("__w") * F.col(c)).alias(c) for c in columns], F.count("*").alias("reachable_trench_count"), F.sum("__w").alias("total_weight"))


def match_stations(pairs: DataFrame, quality: DataFrame, flow: DataFrame, radius: float) -> DataFrame:
    """Streamflow stations up- or downstream of each water-quality station within ``radius``, with a triangular weight over 0.

    ``pairs`` are upstream pairs of trenches with themselves at 0; both ways count, at the lesser distance. ``quality`` and ``flow``
    have ``station_code`` and ``trench_id``. Of several trenches of two stations the nearest counts.
    """
    both = pairs.select("target", "source", F.abs("distance").alias("distance"))
    both = both.unionByName(both.select(F.col("source").alias("target"), F.col("target").alias("source"), "distance")).where(F.col("distance") < radius)
    a = quality.select(F.col("station_code").cast("string").alias("wq_station_code"), F.col("trench_id").alias("target"))
    b = flow.select(F.col("station_code").cast("string").alias("streamflow_station_code"), F.col("trench_id").alias("source"))
    found = a.join(both, "target").join(b, "source").groupBy("wq_station_code", "streamflow_station_code").agg(F.min("distance").alias("streamflow_distance"))
    return found.withColumn("streamflow_weight", triangular_weight("streamflow_distance", radius)).where("streamflow_weight > 0")


FLOWS = ("streamflow_discharge_day", "streamflow_discharge_mean_7d", "streamflow_discharge_mean_31d")


def aggregate_matches(keys: DataFrame, matches: DataFrame, features: DataFrame, flows: Sequence[str] = FLOWS) -> DataFrame:
    """Weighted flows of the stations matched to each water-quality station and date, with diagnostics of the match."""
    m = matches.join(features.withColumnRenamed("station_code", "streamflow_station_code"), "streamflow_station_code").join(keys.select("wq_station_code", "date").distinct(), ["wq_station_code", "date"])
    # A station counts once in the total weight, however many rows it has that day, so rows are summed by station and day first. That needs no other order of the rows.
    there = lambda c: F.col(c).isNotNull()
    w = F.col("streamflow_weight")
    sums = [s for k, c in enumerate(flows) for s in (F.sum(F.col(c) * w).alias(f"__v{k}"), F.sum(F.when(there(c), w)).alias(f"__w{k}"))]
    one = m.groupBy("wq_station_code", "date", "streamflow_station_code").agg(*sums, F.bool_or(there(flows[0])).alias("__there"), F.min(w).alias("__w"), F.min("streamflow_distance").alias("__d"))
    means = [F.when(F.sum(f"__w{k}") > 0, F.try_divide(F.sum(f"__v{k}"), F.sum(f"__w{k}"))).alias(c) for k, c in enumerate(flows)]
    return one.groupBy("wq_station_code", "date").agg(
        *means, F.count("streamflow_station_code").alias("streamflow_match_count"), F.count_if(F.col("__there") & there("streamflow_station_code")).alias("streamflow_nonnull_day_count"),
        F.sum("__w").alias("streamflow_total_weight"), F.min("__d").alias("streamflow_nearest_distance"),
    )


def assemble_sensor_data(quality: DataFrame, streamflow: DataFrame, station_trench: DataFrame, pairs: DataFrame, radius: float) -> DataFrame:
    """Water-quality rows with the first trench of their station and the flows matched to station and date."""
    from confluo.operators.streamflow import streamflow_features

    typed = quality.withColumn("station_code", F.col("station_code").cast("string")).withColumn("date", F.to_date("date"))
    located = station_trench.select(F.col("station_code").cast("string").alias("station_code"), "trench_id").dropna()
    one = first_by(located, ["station_code"], [F.col("trench_id")])
    flow_stations = located.join(streamflow.select(F.col("station_code").cast("string").alias("station_code")).distinct(), "station_code", "left_semi")
    wq_stations = located.join(typed.select("station_code").distinct(), "station_code", "left_semi")
    matches = match_stations(pairs, wq_stations, flow_stations, radius)
    keys = typed.select(F.col("station_code").alias("wq_station_code"), "date")
    flows = aggregate_matches(keys, matches, streamflow_features(streamflow)).withColumnRenamed("wq_station_code", "station_code")
    return typed.join(one, "station_code", "left").join(flows, ["station_code", "date"], "left").fillna(0, ["streamflow_match_count", "streamflow_nonnull_day_count"])


def unit_distances(pairs: DataFrame, units: DataFrame, *, unit: str = "adm2", agg: str = "max") -> DataFrame:
    """Distance between units over the network: the ``max`` (or ``min``) over their trenches, other units only."""
    a = units.select(F.col("trench_id").alias("target"), F.col(unit).alias("target_unit"))
    b = units.select(F.col("trench_id").alias("source"), F.col(unit).alias("source_unit"))
    joined = pairs.join(a, "target").join(b, "source").where("target_unit <> source_unit")
    return joined.groupBy("target_unit", "source_unit").agg((F.max if agg == "max" else F.min)("distance").alias("distance"))


def upstream_weights(distances: DataFrame, reach: float, kind: str = "exponential", *, target: str = "target_unit", source: str = "source_unit", digits: int | None = None) -> DataFrame:
    """``weight`` of each source over 0, adding up to 1 for a target. Targets whose weights are all 0 have no rows."""
    w = distances.select(target, source, cutoff_weight("distance", reach, kind).alias("__w")).where("__w > 0")
    share = ratio("__w", F.sum("__w").over(Window.partitionBy(target)))
    return w.select(target, source, (share if digits is None else F.round(share, digits)).alias("weight"))


def upstream_mean(weights: DataFrame, panel: DataFrame, value: str, *, unit: str, period: str, target: str = "target_unit", source: str = "source_unit") -> DataFrame:
    """Mean of a value over a target's sources in each period, by weight, nulls skipped."""
    joined = weights.where("weight > 0").join(panel.select(F.col(unit).alias(source), period, value), source)
    return joined.groupBy(F.col(target).alias(unit), period).agg(weighted_mean(value, "weight").alias(f"{value}_upstream"))
