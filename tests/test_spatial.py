"""Nearest points, many polygons and zonal means against brute force; polygons as text and points as binary."""

import math
import random
import struct

from pyspark.sql import functions as F

from confluo.operators import matching, panel
from confluo.sources import files


def _points(spark, rng, n, key, spread=100.0):
    rows = [(k, rng.uniform(-spread, spread), rng.uniform(-spread, spread)) for k in range(n)]
    return rows, spark.createDataFrame([*rows, (-1, None, 1.0), (-2, 1.0, None)], f"{key} long, x double, y double")


def test_nearest_point_against_brute_force(spark):
    rng = random.Random(4)
    for spread, step in ((100.0, 1.0), (100.0, 500.0), (0.5, 3.0)):
        a, left = _points(spark, rng, 40, "a", spread)
        b, right = _points(spark, rng, 30, "b", 20.0)
        got = {r.left_id: (r.right_id, r.distance) for r in matching.nearest_point(left, right, left_id="a", right_id="b", step=step).collect()}
        assert set(got) == {r[0] for r in a}
        for i, x, y in a:
            d, j = min((math.hypot(x - u, y - v), j) for j, u, v in b)
            assert got[i][0] == j and abs(got[i][1] - d) < 1e-9
    none = spark.createDataFrame([], "b long, x double, y double")
    assert matching.nearest_point(left, none, left_id="a", right_id="b", step=1.0).count() == 0
    far = spark.createDataFrame([(1, 1e6, 1e6)], "a long, x double, y double")
    assert matching.nearest_point(far, right, left_id="a", right_id="b", step=1.0).count() == 1


def test_ties_go_to_the_least_id(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0)], "a long, x double, y double")
    b = spark.createDataFrame([(7, 1.0, 0.0), (3, -1.0, 0.0), (5, 0.0, 1.0)], "b long, x double, y double")
    assert [tuple(r) for r in matching.nearest_point(a, b, left_id="a", right_id="b", step=0.1).collect()] == [(1, 3, 1.0)]


def _inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (y < ay) != (y < by) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_polygon_join_against_brute_force(spark):
    rng = random.Random(5)
    rings = [(k, [[cx + rng.uniform(1, 30) * math.cos(t), cy + rng.uniform(1, 30) * math.sin(t)] for t in (j * 2 * math.pi / 7 for j in range(7))]) for k, (cx, cy) in enumerate((rng.uniform(-90, 90), rng.uniform(-90, 90)) for _ in range(12))]
    polygons = spark.createDataFrame([*rings, (98, None), (99, [[0.0, 0.0]])], "g long, ring array<array<double>>")
    p, points = _points(spark, rng, 200, "p")
    want = sorted((i, g) for i, x, y in p for g, ring in rings if _inside(x, y, ring))
    for step in (7.0, 1000.0):
        assert sorted(map(tuple, matching.polygon_join(points, polygons, point_id="p", polygon_id="g", ring="ring", step=step).collect())) == want
    assert want


def test_zonal_mean_falls_back_to_the_nearest_pixel(spark):
    pixels = spark.createDataFrame([("a", 0.0, 0.0, 2.0), ("a", 1.0, 0.0, 4.0), (None, 9.0, 9.0, 7.0), (None, 8.0, 8.0, None)], "zone string, x double, y double, v double")
    zones = spark.createDataFrame([("a", 0.5, 0.0), ("b", 7.0, 7.0), ("c", -5.0, 0.0)], "zone string, x double, y double")
    assert {r.zone: r.v for r in panel.zonal_mean(pixels, zones, "v").collect()} == {"a": 3.0, "b": 7.0, "c": 2.0}


def test_geometry_as_text_and_binary(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))",), ("polygon((0 0,2 0,0 2,0 0))",), ("POINT (1 2)",), (None,)], "w string")
    rows = df.select(files.polygon_area("w").alias("a"), files.polygon_bounds("w").alias("b")).collect()
    assert [r.a for r in rows] == [11.0, 2.0, None, None] and tuple(rows[0].b) == (0.0, 0.0, 4.0, 3.0)
    back = df.limit(1).select(files.polygon_wkt(files.polygon_rings("w")).alias("w")).select(files.polygon_area("w")).first()[0]
    assert back == 11.0
    points = spark.createDataFrame([(bytearray(struct.pack("<BIdd", 1, 1, 1.5, -2.0)),), (bytearray(struct.pack(">BIdd", 0, 1, 3.0, 4.0)),), (bytearray(struct.pack("<BI", 1, 2)),), (None,)], "b binary")
    got = [tuple(r[0]) if r[0] else None for r in points.select(files.points_of_wkb(F.col("b"))).collect()]
    assert got == [(1.5, -2.0), (3.0, 4.0), None, None]
    made = spark.createDataFrame([(1.5, -2.0), (None, 1.0)], "x double, y double").select(files.wkb_points(F.col("x"), F.col("y"))).collect()
    assert bytes(made[0][0]) == struct.pack("<BIdd", 1, 1, 1.5, -2.0) and made[1][0] is None
