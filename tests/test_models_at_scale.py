"""Models on tables against the same on arrays, and closures that only look at what is asked."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from confluo.operators import estimate, graph, windows


def _panel(n_units=12, n_years=9, seed=3):
    rng = np.random.default_rng(seed)
    unit, year = np.repeat(np.arange(n_units), n_years), np.tile(np.arange(n_years), n_units)
    z, x = rng.normal(size=len(unit)), rng.normal(size=len(unit))
    e = 0.7 * z + 0.3 * x + unit / 5 + rng.normal(size=len(unit))
    y = 2 * e - x + unit + year / 3 + rng.normal(size=len(unit))
    return pd.DataFrame({"unit": unit, "year": year, "z": z, "z2": 2 * z + x, "x": x, "e": e, "y": y, "zero": np.where(unit == 0, np.nan, 1.0)})


@pytest.mark.parametrize("fes, clusters", [(["unit"], ["unit"]), (["unit", "year"], ["unit"]), (["unit"], ["unit", "year"]), ([], ["unit"])])
def test_two_stage_least_squares_on_a_table(spark, fes, clusters):
    p = _panel()
    got = estimate.fe_iv(spark.createDataFrame(p), "y", "e", ["z"], ["x"], fes, clusters)
    arrays = [p[f].to_numpy() for f in fes]
    want = estimate.fit(p["y"].to_numpy(), p[["x"]].to_numpy(), ["x"], arrays, [p[c].to_numpy() for c in clusters], endogenous=p["e"].to_numpy(), instruments=p[["z"]].to_numpy(), endogenous_name="e")
    assert got.names == want.names == ["e", "x"] and got.n == want.n and got.n_clusters == want.n_clusters
    assert got.beta == pytest.approx(want.beta, abs=1e-6) and got.variance == pytest.approx(want.variance, abs=1e-7)
    assert got.first_stage_f == pytest.approx(want.first_stage_f, rel=1e-5)


def test_an_instrument_that_says_nothing_new_is_left_out(spark):
    p = spark.createDataFrame(_panel())
    one, two = (estimate.fe_iv(p, "y", "e", z, ["x"], ["unit"], ["unit"]) for z in (["z"], ["z", "z2"]))
    assert one.beta == pytest.approx(two.beta, abs=1e-6)
    with pytest.raises(ValueError):
        estimate.fe_iv(p.withColumn("w", F.col("x") * 2), "y", "e", ["w"], ["x"], ["unit"], ["unit"])


def test_interactions_and_subsamples(spark):
    p = spark.createDataFrame(_panel()).withColumn("half", F.when(F.col("unit") < 6, "low").otherwise("high"))
    wide, names = estimate.with_interactions(p, ["x"], "half", ["low", "high"])
    both = estimate.fe_ols(wide, "y", names, ["unit"], ["unit"])
    apart = estimate.fit_subsamples(p, "half", ["low", "high", "none"], lambda d: estimate.fe_ols(d, "y", ["x"], ["unit"], ["unit"]))
    # With fixed effects of units, which are in one half each, a model of interactions is a model of each half.
    assert both.beta == pytest.approx([apart["low"].beta[0], apart["high"].beta[0]], abs=1e-6) and apart["none"] is None
    with pytest.raises(ValueError):
        estimate.with_interactions(wide, ["x"], "half", ["low"])


def test_nesting_takes_no_loop_over_levels():
    n = 200_000
    rng = np.random.default_rng(0)
    unit = np.repeat(np.arange(n // 2), 2)
    x = rng.normal(size=n)
    began = time.perf_counter()
    f = estimate.fit(2 * x + unit, x[:, None], ["x"], [unit], [unit // 10])
    assert f.beta[0] == pytest.approx(2) and time.perf_counter() - began < 30


def test_closure_of_a_chain_and_shorter_ways(spark):
    n = 60
    edges = [(k, k + 1) for k in range(n)] + [(0, 30), (10, 55)]
    got = {(r.src, r.dst): r.hops for r in graph.closure(spark.createDataFrame(edges, "src long, dst long")).collect()}
    far = np.full((n + 1, n + 1), 10**6)
    for a, b in edges:
        far[a, b] = 1
    for k in range(n + 1):
        far = np.minimum(far, far[:, k : k + 1] + far[k : k + 1])
    assert got == {(a, b): far[a, b] for a in range(n + 1) for b in range(n + 1) if a != b and far[a, b] < 10**6}


def test_targets_pay_for_their_own_system(spark, monkeypatch):
    rows = [(k, k, k + 1, 1.0, float(100 - k)) for k in range(1, 9)] + [(k, k, k + 1, 1.0, float(300 - k)) for k in range(101, 140)]
    trenches = spark.createDataFrame(rows, "trench_id long, upstream_node long, downstream_node long, distance double, estuary_distance double")
    seen = []
    real = graph.closure
    monkeypatch.setattr(graph, "closure", lambda e, m=None: seen.append(e.count()) or real(e, m))
    pairs = graph.upstream_pairs(trenches.withColumn("system_id", F.when(F.col("trench_id") < 100, 1).otherwise(2)), targets=spark.createDataFrame([(8,)], "trench_id long"))
    assert {r.source for r in pairs.collect()} == set(range(1, 9)) and seen == [8]


def test_systems_are_numbered_in_order(spark):
    t = spark.createDataFrame([(k, k % 40 * 3) for k in range(400)] + [(-1, None)], "trench_id long, system_id long")
    got = {r.trench_id: r.system_id for r in graph.number_systems(t).collect()}
    assert {got[k] for k in range(40)} == set(range(1, 41)) and got[-1] == 0 and all(got[k] == k % 40 + 1 for k in range(400))


def test_helper_columns_take_free_names(spark):
    df = spark.createDataFrame([("u", 1, 1.0, 5), ("u", 2, None, 6), ("u", 3, 3.0, 7)], "u string, k int, v double, __confluo_k int")
    got = windows.interpolate(df, "u", "k", "v", "w").orderBy("k").collect()
    assert [r.w for r in got] == [1.0, 2.0, 3.0] and [r["__confluo_k"] for r in got] == [5, 6, 7]
    z = windows.zscore(df.withColumnRenamed("__confluo_k", "__confluo_m"), "k", "z").orderBy("k").collect()
    assert [r.z for r in z] == [-1.0, 0.0, 1.0] and [r["__confluo_m"] for r in z] == [5, 6, 7]
