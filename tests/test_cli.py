"""The command line from raw tables to models."""

import datetime as dt
import json

from confluo.cli import main


def test_whole_way(spark, tmp_path):
    d = str(tmp_path)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}")
    put("trenches_raw", [(1, 1, 3, 5.0, 10.0, 0.0, 0.0), (2, 2, 3, 7.0, 10.0, 1.0, 0.0), (3, 3, 4, 10.0, 0.0, 2.0, 0.0), (4, 8, 9, 1.0, 0.0, 99.0, 0.0)], "trench_id long, upstream_node long, downstream_node long, distance double, estuary_distance double, x double, y double")
    put("areas", [(1, 3.0), (2, 4.0)], "trench_id long, drainage_area double")
    put("inside", [(2,)], "trench_id long")
    assert main(["river-network", "generate", "--trenches", f"{d}/trenches_raw", "--areas", f"{d}/areas", "--inside", f"{d}/inside", "--min-x", "0", "--max-x", "50", "--out", f"{d}/net"], spark) == 0
    net = spark.read.parquet(f"{d}/net/river_trenches.parquet")
    assert net.count() == 3 and {r.system_id for r in net.collect()} == {0}

    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(30)]
    put("raw", [(k, "w", day, 7.0 + k % 3 * 0.1, 9999.0 if k == 3 else float(k * k)) for k, day in enumerate(days)], "row_id long, station_code string, date date, ph double, turbidity double")
    assert main(["water-quality", "preprocess", "--raw", f"{d}/raw", "--out", f"{d}/wq"], spark) == 0
    cleaned = {r.row_id: r.turbidity for r in spark.read.parquet(f"{d}/wq/clean.parquet").collect()}
    assert cleaned[3] is None and cleaned[4] == 16.0
    told = json.load(open(f"{d}/wq/transformations.json"))["recommendations"]
    assert told["ph"]["recommended_transform"] == "identity" and set(told) == {"ph", "turbidity"}

    put("monthly", [("f", dt.date(2020, 1, 1), 1.0, 5.0)], "station_code string, date date, discharge_1 double, discharge_2 double")
    put("stations", [("w", 3), ("f", 1)], "station_code string, trench_id long")
    assert main(["water-quality", "assemble", "--quality", f"{d}/wq/clean.parquet", "--monthly", f"{d}/monthly", "--stations", f"{d}/stations", "--trenches", f"{d}/net/river_trenches.parquet", "--radius", "20", "--out", f"{d}/assembled"], spark) == 0
    flows = {r.date: (r.streamflow_discharge_day, r.streamflow_discharge_mean_7d, r.trench_id) for r in spark.read.parquet(f"{d}/assembled").collect()}
    assert flows[days[0]] == (1.0, 1.0, 3) and flows[days[1]] == (5.0, 3.0, 3) and flows[days[2]] == (None, None, 3)

    put("cover", [(1, 2020, 4.0, 1.0), (3, 2020, 6.0, 6.0)], "trench_id long, year int, land_cover_total double, land_cover_class_3 double")
    assert main(["land-cover", "assemble", "--quality", f"{d}/raw", "--stations", f"{d}/stations", "--trenches", f"{d}/net/river_trenches.parquet", "--cover", f"{d}/cover", "--out", f"{d}/lc"], spark) == 0
    (row,) = spark.read.parquet(f"{d}/lc").collect()
    assert (row["trench_id"], row["year"], row["lc_0_10km_tot"], row["lc_0_10km_land_cover_class_3_shr"]) == (3, 2020, 10.0, 0.7)
