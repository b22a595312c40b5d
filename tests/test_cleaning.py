"""Cleaning and streamflow rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from confluo.functions import numeric, text
from confluo.operators import clean, profile, reshape, streamflow, windows


@pytest.mark.parametrize("variable, value, label", [
    ("turbidity", 9999.0, "REMOVE_CODED"), ("turbidity", 44000.0, "REMOVE_CODED"), ("turbidity", 46000.0, "REMOVE_CODED"), ("turbidity", 46001.0, "OK"), ("turbidity", -1.0, "REMOVE_INVALID"), ("air_temperature", -1.0, "OK"),
    ("air_temperature", -11.0, "REMOVE_INVALID"), ("ph", 14.1, "REMOVE_INVALID"), ("ph", 14.0, "OK"), ("zinc", 1000.0, "REMOVE_CODED"), ("zinc", 999.0, "OK"), ("ph", None, "OK"), ("dissolved_oxygen", 41.0, "REMOVE_INVALID"),
])
def test_labels(spark, variable, value, label):
    assert spark.createDataFrame([(variable, value)], "v string, x double").select(clean.classify_value(F.col("v"), F.col("x"))).first()[0] == label


def test_giant_and_clean_table(spark):
    rows = [(k, "s", 1.0 + k % 5, 1.0) for k in range(200)] + [(200, "s", 1e5 * 3, float("inf")), (201, "t", float("nan"), 2e7)]
    df = spark.createDataFrame(rows, "row_id long, station_code string, turbidity double, total_coliforms double")
    cleaned, flags, summary = clean.clean_measurement_values(df, ["turbidity", "total_coliforms"])
    by = {r.row_id: r for r in cleaned.collect()}
    assert by[200].turbidity is None and by[199].turbidity == 5.0 and by[201].total_coliforms == 2e7
    s = {r.variable: r for r in summary.collect()}
    assert (s["turbidity"].OK, s["turbidity"].REMOVE_CODED, s["turbidity"].n) == (200, 1, 200) and s["total_coliforms"].microbio_high == 1 and s["total_coliforms"].n_sensors == 2
    assert flags.count() == 402


def test_idempotent_on_good_rows(spark):
    df = spark.createDataFrame([(k, "s", float(k % 7)) for k in range(50)], "row_id long, station_code string, ph double")
    once = clean.clean_measurement_values(df, ["ph"])[0]
    assert sorted(once.collect()) == sorted(clean.clean_measurement_values(once, ["ph"])[0].collect()) == sorted(df.collect())


def test_transform_rules(spark):
    rows = [("a", 19, 1.0, 9.0, 1.0, 1.0, 1.0), ("b", 20, 0.1, 1.0, 1.0, 1.0, 1.0), ("c", 20, 0.0, 1.5, 1.0, 1.0, 1.0), ("d", 20, -1.0, 9.0, 1.0, 1.0, 1.0), ("e", 20, 0.0, 0.0, 0.0, 0.0, 5.0)]
    got = profile.recommend_transform(spark.createDataFrame(rows, "variable string, n int, min double, skew double, q1 double, median double, p99 double"))
    assert [r.recommended_transform for r in got.orderBy("variable").collect()] == ["identity", "log10", "log10_1p", "identity", "identity"]


def _days(spark, values, station="s"):
    start = dt.date(2000, 1, 1)
    return spark.createDataFrame([(station, start + dt.timedelta(k), v) for k, v in enumerate(values)], "station_code string, date date, discharge double")


@pytest.mark.parametrize("n, suspicious, nulled", [(30, False, False), (31, True, False), (365, True, False), (366, False, True)])
def test_runs(spark, n, suspicious, nulled):
    out = streamflow.apply_rules(_days(spark, [5.0] * n + [6.0])).orderBy("date").collect()
    assert out[0].flag_constant_run_suspicious is suspicious and (out[0].discharge is None) is nulled and out[n].discharge == 6.0
    zero = streamflow.apply_rules(_days(spark, [0.0] * n)).collect()
    assert not any(r.flag_constant_run_suspicious for r in zero) and all((r.discharge is None) is nulled for r in zero)


def test_jumps_and_bad_stations(spark):
    out = streamflow.apply_rules(_days(spark, [0.0, 1.0, 0.005, 51.0, 0.005, 49.0])).orderBy("date").collect()
    assert [r.flag_jump_suspicious for r in out] == [False, True, False, True, False, False]
    for bad, n in ((False, 5), (True, 6)):
        out = streamflow.apply_rules(_days(spark, [100_000.0] * n + [float(k) for k in range(1, 101 - n)])).collect()
        assert {r.flag_bad_station for r in out} == {bad} and sum(r.discharge is None for r in out) == n


def test_february_and_best_row(spark):
    cols = ", ".join(f"discharge_{d} double" for d in range(1, 32))
    rows = [("s", "2019-02-10", *[float(d) for d in range(1, 32)]), ("s", "2020-02-01", *[float(d) for d in range(1, 32)])]
    daily = reshape.month_to_daily(spark.createDataFrame(rows, f"station_code string, date string, {cols}"))
    assert daily.count() == 28 + 29 and {r.date.day for r in daily.where("value > 28").collect()} == {29}
    with pytest.raises(ValueError):
        reshape.month_to_daily(spark.createDataFrame([("s", "2019-02-10")], "station_code string, date string"))
    base = {"station_code": "s", "date": "2020-01-01", "streamflow_acquisition_method": None}
    month = spark.createDataFrame(
        [{**base, "consistency_level": "1", "updated_at": "2021-01-01", "discharge_1": 5.0, "discharge_1_status": "ok"}, {**base, "consistency_level": "2", "updated_at": "2020-01-01", "discharge_1": 7.0, "discharge_1_status": None}],
        "station_code string, date string, streamflow_acquisition_method string, consistency_level string, updated_at string, discharge_1 double, discharge_1_status string",
    )
    out = streamflow.build_clean_streamflow_daily(month).collect()
    assert len(out) == 1 and out[0].discharge == 7.0 and len(out[0]) == 9


def test_best_row_priorities(spark):
    no = dict(flag_bad_station=False, flag_constant_run_suspicious=False, flag_jump_suspicious=False)
    fields = "station_code string, date string, consistency_level string, discharge double, quality_flag string, updated_at string, flag_bad_station boolean, flag_constant_run_suspicious boolean, flag_jump_suspicious boolean"
    base = dict(station_code="s", date="d", consistency_level="1", discharge=1.0, quality_flag="ok", updated_at="2020", **no)
    for worse in ({"consistency_level": None}, {"discharge": None}, {"quality_flag": "suspect"}, {"flag_jump_suspicious": True}, {"updated_at": "2019"}, {"discharge": -4.0}, {"discharge": 9999.0}):
        out = streamflow.best_rows(spark.createDataFrame([{**base, **worse}, base], fields)).collect()
        assert len(out) == 1 and {k: out[0][k] for k in base} == base


def test_windows(spark):
    df = spark.createDataFrame([("u", k, v) for k, v in enumerate([None, 1.0, None, 3.0, None])], "u string, k int, v double")
    w = windows.over("u", "k")
    rows = windows.interpolate(windows.interpolate(df, "u", "k", "v", "a"), "u", "k", "v", "b", extend=False)
    rows = rows.select("k", "a", "b", windows.rolling_mean("v", w, 2).alias("m"), windows.cumulative_sum(F.coalesce("v", F.lit(1.0)), w).alias("s"), windows.cumulative_sum("v", w).alias("t"), windows.cumulative_mean("v", w).alias("c"), windows.forward_fill("v", w).alias("f")).orderBy("k").collect()
    assert [r.a for r in rows] == [None, 1.0, 2.0, 3.0, 3.0] and [r.b for r in rows] == [None, 1.0, 2.0, 3.0, None]
    assert [r.m for r in rows] == [None, 1.0, 1.0, 3.0, 3.0] and [r.s for r in rows] == [1, 2, 3, 6, 7] and [r.t for r in rows] == [None] * 5
    assert [r.c for r in rows] == [None, 1.0, 1.0, 2.0, 2.0] and [r.f for r in rows] == [None, 1.0, 1.0, 3.0, 3.0]


def test_sliding_ols_replaces_the_outlier(spark):
    values = [1.0 * k for k in range(10)]
    values[4] = 60.0
    out = windows.sliding_ols(spark.createDataFrame([("u", k, v) for k, v in enumerate(values)], "u string, k int, v double"), "u", "k", "v", "k").orderBy("k").collect()
    assert out[4].adjusted == pytest.approx(out[4].fitted) and out[4].adjusted < 30


@pytest.mark.parametrize("d, name", [(0.0, "0_10km"), (10.0, "0_10km"), (10.0001, "10_50km"), (50.0, "10_50km"), (100.0, "50_100km"), (250.0, "100_250km"), (500.0, "250_500km"), (500.1, "500km_plus"), (-1.0, None), (None, None)])
def test_bucket_edges(spark, d, name):
    assert spark.createDataFrame([(d,)], "d double").select(numeric.distance_bucket("d")).first()[0] == name


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(text.slugify(lit("Região: São João--x "))) == "regiao_sao_joao_x" and one(text.slugify(lit("***"))) == "run"
    assert one(text.normalise_code(lit(" 123.0 "))) == "123" and one(text.normalise_code(lit(" "))) is None
    assert one(text.decimal_comma(lit("1,5"))) == 1.5 and one(text.decimal_comma(lit("-"), True)) == 0.0 and one(text.decimal_comma(lit("-"))) is None
    assert [one(text.month_number(lit(s))) for s in ("Março 2020", "nuvem_dez", "2020-03", "11/1999", "x_07_y", "none")] == [3, 12, 3, 11, 7, None]
    assert [one(text.keyword_type(lit(s))) for s in ("total_nitrogen", "Chlorides", "ph", "water_quality_index", "zinc", "odd")] == ["nutrients", "organics_pesticides", "core_physicochemical", "composite_indices", "metals", "other"]
    assert one(text.period_key(lit(2020), lit(1), lit(None))) == "2020_Q1_<NA>" and one(text.two_digit_year(lit(23))) == 1923 and one(text.two_digit_year(lit(22))) == 2022
    assert str(one(text.at_time(lit("2020-01-01"), lit("0.5")))) == "2020-01-01 12:00:00" and str(one(text.at_time(lit("2020-01-01"), lit("7:30")))) == "2020-01-01 07:30:00" and str(one(text.at_time(lit("2020-01-01"), lit("?")))) == "2020-01-01 00:00:00"
    assert one(text.implied_decimal(lit("12345"))) == 123.45 and one(text.lookup(lit("z"), {"a": 1}, 9)) == 9
    assert one(numeric.finite(lit(float("nan")))) is None and one(numeric.finite(lit(float("inf")))) is None and one(numeric.log10_1p(lit(-0.5))) is None and one(numeric.log10_1p(lit(9.0))) == 1.0
    assert one(numeric.cutoff_weight(lit(200.0), 100.0)) == 0 and one(numeric.kernel_weight(lit(2.0), 2.0, "gaussian")) == pytest.approx(0.36788, abs=1e-5)
    for bad in (lambda: numeric.kernel_weight(lit(1.0), 1.0, "x"), lambda: numeric.transform(lit(1.0), "ln")):
        with pytest.raises(ValueError):
            bad()
