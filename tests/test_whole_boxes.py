"""The intersect join finds every pair of boxes that touch, against brute force."""

import random

from confluo.operators import matching
from confluo.plans import catalog


def _touch(a, b):
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def test_query_returns_pairs_of_any_ids(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.randrange(1, 90), rng.random() * 1000) for k in range(300)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    boxes = {}
    for y, i, x in rows:
        b = boxes.get(i, (x, y, x, y))
        boxes[i] = (min(b[0], x), min(b[1], y), max(b[2], x), max(b[3], y))
    want = sorted((i, j) for i in boxes for j in boxes if i < j and _touch(boxes[i], boxes[j]))
    assert any(i % 40 != j % 40 for i, j in want)
    assert sorted(map(tuple, catalog.queries()["box_intersect_join"](spark, str(tmp_path)).collect())) == want


def test_box_join_against_brute_force(spark):
    rng = random.Random(2)

    def some(n, size):
        lows = [(rng.randrange(100), rng.randrange(100)) for _ in range(n)]
        return [(i, float(x), float(y), float(x + rng.randrange(size)), float(y + rng.randrange(size))) for i, (x, y) in enumerate(lows)]

    names = "id long, x0 double, y0 double, x1 double, y1 double"
    for left, right in ((some(60, 9), some(80, 9)), (some(60, 1), some(60, 1)), (some(40, 90), some(40, 3)), ([(1, 5.0, 5.0, 5.0, 5.0)], [(2, 5.0, 5.0, 5.0, 5.0)])):
        a, b = (spark.createDataFrame([*rows, (-1, None, 0.0, 9.0, 9.0)], names) for rows in (left, right))
        got = sorted(map(tuple, matching.box_join(a, b, ("x0", "y0", "x1", "y1"), left_id="id", right_id="id").collect()))
        assert got == sorted((p[0], q[0]) for p in left for q in right if _touch(p[1:], q[1:]))
    none = spark.createDataFrame([], names)
    assert matching.box_join(none, none, ("x0", "y0", "x1", "y1"), left_id="id", right_id="id").count() == 0
