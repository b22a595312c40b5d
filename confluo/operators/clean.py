"""Cleaning of measurements: labels for coded and impossible values, review flags, and a clean table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.numeric import number
from confluo.operators.profile import PROFILE, variable_profile

LABELS = ("OK", "REMOVE_CODED", "REMOVE_INVALID")
_MICROBES = ("escherichia", "fecal_coliforms", "thermotolerant_coliforms", "total_coliforms")


@dataclass(frozen=True)
class CleaningRules:
    sentinels: Sequence[float] = (9999.0, 99999.0, 999999.0)
    sentinel_ranges: Sequence[tuple[float, float]] = ((44000.0, 46000.0),)
    may_be_negative: Sequence[str] = ("air_temperature", "ph", "sample_temperature", "temperature")
    limits: Mapping[str, tuple[float, float]] = field(
        default_factory=lambda: {"ph": (0.0, 14.0), "air_temperature": (-10.0, 60.0), "sample_temperature": (0.0, 60.0), "oxygen_saturation": (0.0, 200.0), "dissolved_oxygen": (0.0, 40.0), "water_quality_index": (0.0, 100.0)}
    )
    variable_ranges: Mapping[str, Sequence[tuple[float, float]]] = field(default_factory=dict)
    very_large: Mapping[str, float] = field(default_factory=lambda: {"total_chromium": 100.0} | dict.fromkeys(("arsenic", "cadmium", "manganese", "zinc"), 1000.0))
    giant_over_p99: float = 1000.0
    review_over_p99: float = 10.0
    review_iqr: float = 3.0
    microbes: Sequence[str] = _MICROBES
    microbes_high: float = 1e7
    never_giant: Sequence[str] = (*_MICROBES, "liquid_discharge")


DEFAULT_RULES = CleaningRules()


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def classify_value(variable: Column, value: Column, rules: CleaningRules = DEFAULT_RULES) -> Column:
    """``OK``, ``REMOVE_CODED`` or ``REMOVE_INVALID``, by the first rule that fits. A null is ``OK``."""
    v = variable
    return (
        F.when(value.isNull(), "OK")
        .when(value.isin(list(rules.sentinels)) | _any([value.between(a, b) for a, b in rules.sentinel_ranges]), "REMOVE_CODED")
        .when(~v.isin(list(rules.may_be_negative)) & (value < 0), "REMOVE_INVALID")
        .when(_any([(v == k) & ((value < a) | (value > b)) for k, (a, b) in rules.limits.items()]), "REMOVE_INVALID")
        .when(_any([(v == k) & value.between(a, b) for k, spans in rules.variable_ranges.items() for a, b in spans]), "REMOVE_CODED")
        .when(_any([(v == k) & (value >= a) for k, a in rules.very_large.items()]), "REMOVE_CODED")
        .otherwise("OK")
    )


def mark_giants(flags: DataFrame, rules: CleaningRules = DEFAULT_RULES) -> DataFrame:
    """``OK`` values over ``giant_over_p99`` times the 99th percentile of the ``OK`` ones become ``REMOVE_CODED``."""
    p99 = flags.where("cleaning_label = 'OK'").groupBy("variable").agg(F.percentile("value", F.lit(0.99)).alias("__p99"))
    giant = (F.col("cleaning_label") == "OK") & ~F.col("variable").isin(list(rules.never_giant)) & (F.col("__p99") > 0) & (F.col("value") > rules.giant_over_p99 * F.col("__p99"))
    # A row a variable: the names of columns, so small enough to broadcast.
    joined = flags.join(F.broadcast(p99), "variable", "left")
    return joined.withColumn("cleaning_label", F.when(F.coalesce(giant, F.lit(False)), "REMOVE_CODED").otherwise(F.col("cleaning_label"))).drop("__p99")


def build_cleaning_flags(frame: DataFrame, columns: Sequence[str], *, row_id: str = "row_id", station: str = "station_code", rules: CleaningRules = DEFAULT_RULES) -> DataFrame:
    """A row for each finite value of ``columns``: its label, the profile of the ``OK`` values of its variable, and review flags."""
    stationed = frame.withColumn("station_code", (F.col(station) if station in frame.columns else F.lit(None)).cast("string"))
    long = stationed.select(row_id, "station_code", *[number(c).alias(c) for c in columns]).unpivot([row_id, "station_code"], list(columns), "variable", "value").where("value is not null")
    flags = mark_giants(long.withColumn("cleaning_label", classify_value(F.col("variable"), F.col("value"), rules)), rules)
    profile = variable_profile(flags.where("cleaning_label = 'OK'"), iqr_multiplier=rules.review_iqr)
    ok = F.col("cleaning_label") == "OK"
    far = (F.col("value") > F.col("upper_iqr")) | ((F.col("p99") > 0) & (F.col("value") > rules.review_over_p99 * F.col("p99")))
    return flags.join(F.broadcast(profile), "variable", "left").select(
        "*", F.coalesce(ok & far, F.lit(False)).alias("flag_extreme_review"), (ok & F.col("variable").isin(list(rules.microbes)) & (F.col("value") > rules.microbes_high)).alias("flag_microbio_high"), F.col("variable").alias("source_column")
    )


def clean_measurement_values(frame: DataFrame, columns: Sequence[str], *, row_id: str = "row_id", station: str = "station_code", rules: CleaningRules = DEFAULT_RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table with removed values null, the flags, and a summary of each variable with counts of flags and labels."""
    flags = build_cleaning_flags(frame, columns, row_id=row_id, station=station, rules=rules)
    gone = flags.where("cleaning_label <> 'OK'").groupBy(row_id).agg(F.collect_set("variable").alias("__gone"))
    joined = frame.join(gone, row_id, "left")
    clean = joined.select(*[F.when(F.coalesce(F.array_contains("__gone", c), F.lit(False)), None).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in frame.columns])
    counts = flags.groupBy("variable").agg(
        *[F.first(c).alias(c) for c in PROFILE],
        F.count_if("flag_extreme_review").alias("extreme_review"), F.count_if("flag_microbio_high").alias("microbio_high"),
        *[F.count_if(F.col("cleaning_label") == x).alias(x) for x in LABELS],
    )
    return clean, flags, counts
