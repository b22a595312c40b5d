"""Estimators on data whose answer is known, and the model suite."""

import datetime as dt
import json

import numpy as np
import pytest

from confluo.functions.student import p_value, quantile
from confluo.operators import guards, panel, suite
from confluo.operators.estimate import demean_arrays, fe_ols, fit, keep_repeated


def _data(noise=0.0, n_units=12, n_times=8, seed=0):
    rng = np.random.default_rng(seed)
    u, t = (a.ravel() for a in np.meshgrid(np.arange(n_units), np.arange(n_times), indexing="ij"))
    x = rng.normal(size=(len(u), 2)) + u[:, None] * 0.3
    y = x @ [2.0, -1.5] + 3 * u + np.sin(t) + noise * rng.normal(size=len(u))
    return u, t, x, y


def test_exact_recovery():
    u, t, x, y = _data()
    f = fit(y, x, ["a", "b"], [u, t], [u])
    assert f.beta == pytest.approx([2, -1.5]) and f.n == len(y) and f.n_clusters == 12


def test_dummies_give_the_same():
    u, t, x, y = _data(noise=1.0)
    drop = np.random.default_rng(1).random(len(u)) < 0.8
    u, t, x, y = u[drop], t[drop], x[drop], y[drop]
    f = fit(y, x, ["a", "b"], [u, t], [u])
    d = np.column_stack([x] + [u == k for k in range(12)] + [t == k for k in range(1, 8)]).astype(float)
    assert f.beta == pytest.approx(np.linalg.lstsq(d, y, rcond=None)[0][:2], abs=1e-8)
    xx, r = demean_arrays(x, [u, t]), y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
    s = np.stack([np.bincount(u, xx[:, k] * r, 12) for k in range(2)], 1)
    bread = np.linalg.inv(xx.T @ xx)
    v = bread @ (s.T @ s) @ bread * 12 / 11 * (len(y) - 1) / (len(y) - 2 - 1 - 7)
    assert f.variance == pytest.approx(v, rel=1e-6)


def test_spark_and_arrays_agree(spark):
    u, t, x, y = _data(noise=1.0)
    df = spark.createDataFrame([(int(a), int(b), float(p), float(q), float(r)) for a, b, (p, q), r in zip(u, t, x, y)] + [(99, 0, 1.0, 1.0, 1.0)], "u int, t int, a double, b double, y double")
    for clusters in (["u"], ["u", "t"]):
        got = fe_ols(df, "y", ["a", "b"], ["u", "t"], clusters)
        want = fit(y, x, ["a", "b"], [u, t], [{"u": u, "t": t}[c] for c in clusters])
        assert got.n == want.n and got.beta == pytest.approx(want.beta, abs=1e-6) and got.variance == pytest.approx(want.variance, rel=1e-4)


def test_singletons_and_collinear_columns():
    assert keep_repeated([np.array([1, 1, 2, 3, 3]), np.array([1, 1, 1, 1, 2])]).tolist() == [True, True, False, False, False]
    u, t, x, y = _data()
    f = fit(y, np.column_stack((x, x[:, 0] * 2, u)), ["a", "b", "twice", "unit"], [u], [u])
    assert f.dropped == ["twice", "unit"] and f.names == ["a", "b"]


def test_two_stage_recovers():
    rng = np.random.default_rng(2)
    u = np.repeat(np.arange(40), 10)
    z, hidden = rng.normal(size=400), rng.normal(size=400)
    e = z + hidden + u * 0.1
    y = 1.7 * e - 2 * hidden + u
    f = fit(y, np.zeros((400, 0)), [], [u], [u], endogenous=e, instruments=z[:, None])
    assert abs(f.beta[0] - 1.7) < 0.25 and f.first_stage_f > 100
    exact = fit(1.7 * e + u, np.zeros((400, 0)), [], [u], [u], endogenous=e, instruments=z[:, None])
    assert exact.beta[0] == pytest.approx(1.7)


def test_student():
    assert p_value(2.228, 10) == pytest.approx(0.05, abs=1e-4) and quantile(0.95, 10) == pytest.approx(2.2281, abs=1e-3) and p_value(0, 5) == 1


STATIONS = {"1001": (1, 0.2), "1002": (2, -0.1), "1003": (3, 0.05)}
DATES = [dt.date(2020, 1, 15), dt.date(2020, 7, 15), dt.date(2021, 1, 15), dt.date(2021, 7, 15)]
SETTINGS = suite.SuiteSettings(minimum_observations=1, tiers=(("high", 10), ("medium", 5), ("low", 1), ("rare", 0)))


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(5)
    cover, names = [], [f"lc_{b}_{c}_cnt" for b in SETTINGS.buckets for c in SETTINGS.classes]
    for trench in (1, 2, 3):
        for year in (2020, 2021):
            cover.append((trench, year, *[float(x) for x in rng.integers(1, 50, len(names))]))
    rows = []
    for code, (trench, effect) in STATIONS.items():
        for d in DATES:
            q = (d.month - 1) // 3 + 1
            rows.append((code, dt.datetime(d.year, d.month, d.day, 8), d, trench, 6 + 0.1 * trench + effect + float(rng.normal()), 15.0 + q + float(rng.random()), 1 + effect + q * 0.1, 100.0 + 10 * trench + 5 * q + float(rng.normal()), 120.0 + 8 * trench + 4 * q + float(rng.normal())))
    sensor = spark.createDataFrame(rows, "station_code string, datetime timestamp, date date, trench_id long, ph double, turbidity double, total_nitrogen double, streamflow_discharge_day double, streamflow_discharge_mean_7d double")
    told = {"ph": {"recommended_transform": "identity"}, "turbidity": {"recommended_transform": "log10_1p"}, "total_nitrogen": {"recommended_transform": "log10_1p"}, "absent": {}}
    return sensor, spark.createDataFrame(cover, "trench_id long, year int, " + ", ".join(f"{n} double" for n in names)), spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "trench_id long, system_id long"), told


def test_catalog_and_selection(inputs):
    catalog = suite.build_pollutant_catalog(inputs[0], inputs[3], SETTINGS)
    assert suite.select_pollutants(catalog, group_kind="type", group_name="core_physicochemical").pollutants == ("ph", "turbidity")
    assert set(suite.select_pollutants(catalog, group_kind="importance", group_name="high").pollutants) == {"ph", "turbidity", "total_nitrogen"}
    assert suite.summarize_groups(catalog)["type"] == {"core_physicochemical": ["ph", "turbidity"], "nutrients": ["total_nitrogen"]}
    for wrong in (dict(explicit=["zinc"]), dict(group_kind="odd"), dict(group_kind="type", group_name="metals"), dict(explicit=["ph"], minimum_observations=99)):
        with pytest.raises(ValueError):
            suite.select_pollutants(catalog, **wrong)


def test_cumulative_specs():
    specs = suite.build_model_specs(SETTINGS, ["ph"], ["c41"], max_distance_step=3)
    assert [s.coefficient_columns for s in specs] == [tuple(f"lc_{b}_c41_cnt" for b in SETTINGS.buckets[:k]) for k in (1, 2, 3)]
    with pytest.raises(ValueError, match="Unknown land-cover subclasses"):
        suite.build_model_specs(SETTINGS, ["ph"], ["c99"])


def test_analysis_data(inputs):
    data, _ = suite.build_analysis_data(*inputs[:3], inputs[3], SETTINGS)
    r = data.orderBy("station_code", "date").first()
    assert r.quarter_year_system == "2020_Q1_10" and r.streamflow_discharge_day_scaled == pytest.approx(r.streamflow_discharge_day / 100) and r.ph__transformed == r.ph
    assert data.where("turbidity__transformed is null or total_nitrogen__transformed is null").isEmpty()


def test_suite_and_command_line(spark, inputs, tmp_path, capsys):
    run = suite.run_suite(*inputs, SETTINGS, pollutants=["ph"], classes=["c41"], max_distance_step=2, output_dir=str(tmp_path))
    manifest = run.manifest.collect()
    assert [m.status for m in manifest] == ["ok", "ok"] and [m.distance_step_name for m in manifest] == ["0_10km", "10_50km"] and run.output_dir.endswith("pollutant_ph")
    assert run.results.where("term = 'lc_0_10km_c41_cnt'").count() == 2 and json.load(open(f"{run.output_dir}/summary.json"))["models_succeeded"] == 2
    constant = inputs[1].withColumns({f"lc_{b}_c42_cnt": guards.F.lit(1.0) for b in SETTINGS.buckets})
    failed = suite.run_suite(inputs[0], constant, *inputs[2:], SETTINGS, pollutants=["ph"], classes=["c42", "c41"], max_distance_step=1)
    assert {m.land_cover_subclass: m.status for m in failed.manifest.collect()} == {"c42": "failed", "c41": "ok"}
    for name, df in zip(("s", "c", "t"), inputs):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    (tmp_path / "told.json").write_text(json.dumps({"recommendations": inputs[3]}))
    both = ["--sensor-data", f"{tmp_path}/s.parquet", "--transformations", f"{tmp_path}/told.json", "--min-observations", "1"]
    capsys.readouterr()
    assert suite.main(["list-groups", *both, "--as-json"], spark) == 0 and "core_physicochemical" in json.loads(capsys.readouterr().out)["type"]
    assert suite.main(["run", *both, "--land-cover", f"{tmp_path}/c.parquet", "--trenches", f"{tmp_path}/t.parquet", "--output-dir", f"{tmp_path}/out", "--pollutants", "ph", "--land-cover-subclasses", "c41", "--max-distance-step", "1"], spark) == 0
    assert (tmp_path / "out/pollutant_ph/manifest.parquet").exists()


def test_guards(spark):
    a, b = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), spark.createDataFrame([(1, 5)], "k int, w int")
    assert guards.checked_join(a, b, ["k"], "left", "many_to_one").count() == 2
    with pytest.raises(ValueError):
        guards.checked_join(b, a, ["k"], "left", "many_to_one")
    with pytest.raises(KeyError):
        guards.require_columns(a, ["z"])
    mixed = spark.createDataFrame([("1", "x", None, [1]), ("n", "y", None, [2])], "a string, b string, c string, d array<int>")
    assert guards.numeric_columns(mixed) == ["a"] and guards.dense_columns(mixed) == ["a", "b", "d"] and guards.varies(mixed, "b") and not guards.varies(mixed, "c")
    assert guards.first_present(["z", "k"], a.columns) == "k" and guards.first_table(spark, ["no_such_table"]) is None


def test_panels(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 1.0, 1.0), ("b", 1, 1.0, None), ("b", 2, 1.0, 1.0), ("c", 1, None, None), ("c", 2, 1.0, float("nan"))], "u string, t int, x double, y double")
    assert {r.u for r in panel.balanced_units(df, "u", ["x", "y"]).collect()} == {"a", "b"} and panel.is_balanced(df, "u", "t")
    old, new = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0)], "u string, t int, v double"), spark.createDataFrame([("a", 2, 40.0), ("a", 3, 50.0)], "u string, t int, v double")
    assert {r.t: r.v for r in panel.splice(old, new, "u", "t", "v", 2).collect()} == {1: 5.0, 2: 40.0, 3: 50.0}
    assert {r.t: r.v for r in panel.splice(old, new, "u", "t", "v", 2, "new_over_old").collect()} == {1: 20.0, 2: 40.0, 3: 50.0}
