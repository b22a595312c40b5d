"""The nearest value of a key against brute force, on odd values and many ranges, without a product of a key's rows."""

import math
import random

from confluo.operators import matching

LEFT, RIGHT = "a long, k int, x double", "b long, k int, y double"


def _apart(x, y):
    d = abs(x - y)
    return math.inf if math.isnan(d) else d, math.isnan(d)


def _brute(left, right):
    best = {}
    for a, k, x in left:
        for b, j, y in right:
            if k is not None and k == j and x is not None and y is not None:
                best[a] = min(best.get(a, ((math.inf, True), math.inf)), (_apart(x, y), b))
    return {a: b for a, (_, b) in best.items()}


def _near(spark, left, right):
    out = matching.nearest_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), left_id="a", right_id="b", left_value="x", right_value="y", on="k")
    return {r.a: r.b for r in out.collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    inf, nan, tiny = math.inf, math.nan, 0.1 + 0.2
    for some in (lambda: float(rng.randrange(40)), lambda: rng.uniform(-9, 9), lambda: rng.choice([inf, -inf, nan, 0.3, tiny, 5.0, 1e16, 1.0, 1.25, -0.0, None])):
        left = [(rng.randrange(150), rng.choice([0, 1, 2, None]), some()) for _ in range(120)]
        right = [(b, rng.choice([0, 1, 3, None]), some()) for b in rng.sample(range(900), 90)]
        assert _near(spark, left, right) == _brute(left, right)


def test_rounded_distances_that_are_the_same(spark):
    right = [(9, 1, 0.3), (4, 1, 0.1 + 0.2), (2, 1, 1.0), (1, 1, 90.0)]
    assert abs(5.0 - 0.3) == abs(5.0 - (0.1 + 0.2))
    assert _near(spark, [(1, 1, 5.0)], right[:2]) == {1: 4} and _near(spark, [(1, 1, math.inf)], right) == {1: 1}


def test_no_product_of_a_key(spark):
    """40,000 rows on each side of one key would be 1.6 billion pairs."""
    n = 40_000
    a, b = spark.range(n).selectExpr("id as a", "1 as k", "id * 3.0d as x"), spark.range(n).selectExpr("id as b", "1 as k", "id * 3.0d + 1 as y")
    out = matching.nearest_join(a, b, left_id="a", right_id="b", left_value="x", right_value="y", on="k")
    assert out.where("a <> b or distance <> 1.0").count() == 0 and out.count() == n
