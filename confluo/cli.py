"""Command line over Parquet tables: ``river-network generate``, ``water-quality preprocess`` and ``assemble``, ``land-cover assemble``, ``analysis``.

Fetching from the network isn't part of it: inputs are tables that are there.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from confluo.operators import clean, graph, network, profile, streamflow, suite
from confluo.operators.guards import numeric_columns, with_prefix
from confluo.operators.matching import in_box

#: Columns of water-quality rows that hold no measurement.
NOT_MEASURED = tuple(
    "row_id record_id station_code date datetime time year quarter trench_id system_id imported temporary removed duplicate_imported consistency_level measurement_number horizontal_sampling_position vertical_sampling_position"
    " source_archive_name source_mdb_name source_table_name updated_at created_at updated_by".split()
)


def generate_network(spark: SparkSession, trenches: str, out: str, areas: str | None = None, box: Sequence[float | None] = (None,) * 4, inside: str | None = None) -> None:
    """Systems, indexes and order of a network's trenches, those of a box of ``x`` and ``y`` if bounds are given."""
    t = spark.read.parquet(trenches)
    if any(b is not None for b in box):
        t = t.where(in_box("x", "y", tuple(box)))
    n = graph.Network(t, spark.read.parquet(areas) if areas else None).compute_subsystems().compute_indexes()
    if inside:
        n = n.annotate_areas(inside=spark.read.parquet(inside))
    n.save(out)


def preprocess_quality(spark: SparkSession, raw: str, out: str) -> dict:
    """Clean rows, flags, summary and recommended transformations of water-quality rows that have a ``row_id``."""
    frame = spark.read.parquet(raw)
    columns = numeric_columns(frame, NOT_MEASURED)
    cleaned, flags, summary = clean.clean_measurement_values(frame, columns)
    for name, df in (("clean", cleaned), ("flags", flags), ("summary", summary)):
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    told = profile.recommend_transform(spark.read.parquet(f"{out}/summary.parquet")).select("variable", "recommended_transform").collect()
    names = {"identity": "x", "log10": "log10(x)", "log10_1p": "log10(1 + x)"}
    found = {r.variable: {"column": r.variable, "recommended_transform": r.recommended_transform, "expression": names[r.recommended_transform]} for r in told}
    with open(f"{out}/transformations.json", "w") as f:
        json.dump({"schema_version": 1, "recommendations": found}, f, indent=2)
    return found


def assemble_quality(spark: SparkSession, quality: str, monthly: str, stations: str, trenches: str, out: str, radius: float) -> None:
    """Water-quality rows with flows of the stations within ``radius`` along the network, in the units of its distances."""
    daily = streamflow.build_clean_streamflow_daily(spark.read.parquet(monthly))
    where = spark.read.parquet(stations)
    pairs = graph.upstream_pairs(spark.read.parquet(trenches))
    network.assemble_sensor_data(spark.read.parquet(quality), daily, where, pairs, radius).write.mode("overwrite").parquet(out)


def assemble_cover(spark: SparkSession, quality: str, stations: str, trenches: str, cover: str, out: str) -> None:
    """Land cover upstream of the trenches and years with observations, by bucket of distance."""
    where = spark.read.parquet(stations).select(F.col("station_code").cast("string").alias("station_code"), "trench_id")
    seen = spark.read.parquet(quality).withColumn("station_code", F.col("station_code").cast("string"))
    targets = network.sensor_targets(seen, where)
    c = spark.read.parquet(cover)
    pairs = graph.upstream_pairs(spark.read.parquet(trenches), targets=targets)
    network.upstream_by_bucket(targets, pairs, c, with_prefix(c, "land_cover_class_")).write.mode("overwrite").parquet(out)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="confluo")
    top = parser.add_subparsers(dest="area", required=True)

    def command(area, name: str, required: str, optional: str = "") -> argparse.ArgumentParser:
        p = area.add_parser(name)
        for o in required.split():
            p.add_argument(f"--{o}", required=True)
        for o in optional.split():
            p.add_argument(f"--{o}")
        return p

    rivers = top.add_parser("river-network").add_subparsers(dest="command", required=True)
    p = command(rivers, "generate", "trenches out", "areas inside")
    for b in ("min-x", "min-y", "max-x", "max-y"):
        p.add_argument(f"--{b}", type=float)
    quality = top.add_parser("water-quality").add_subparsers(dest="command", required=True)
    command(quality, "preprocess", "raw out")
    command(quality, "assemble", "quality monthly stations trenches out").add_argument("--radius", type=float, default=10.0)
    command(top.add_parser("land-cover").add_subparsers(dest="command", required=True), "assemble", "quality stations trenches cover out")
    top.add_parser("analysis", add_help=False).add_argument("rest", nargs=argparse.REMAINDER)
    a = parser.parse_args(args)
    if spark is None:
        from confluo.session import build_session

        spark = build_session()
    if a.area == "analysis":
        return suite.main(a.rest, spark)
    if a.area == "river-network":
        generate_network(spark, a.trenches, a.out, a.areas, (a.min_x, a.min_y, a.max_x, a.max_y), a.inside)
    elif a.area == "land-cover":
        assemble_cover(spark, a.quality, a.stations, a.trenches, a.cover, a.out)
    elif a.command == "preprocess":
        preprocess_quality(spark, a.raw, a.out)
    else:
        assemble_quality(spark, a.quality, a.monthly, a.stations, a.trenches, a.out, a.radius)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
