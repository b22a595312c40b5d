"""The tasks of the daily streamflow grow in number with the months, and their number changes no row."""

from confluo.operators import streamflow


def test_tasks_grow_with_the_months(spark, monkeypatch):
    days = ", ".join(f"CASE WHEN (s * 7 + m * 3 + {d}) % 5 > 0 THEN cast((s + m + {d} div 9) % 4 as double) END AS discharge_{d}, 'ok' AS discharge_{d}_status" for d in range(1, 32))
    months = spark.range(600).selectExpr("id % 40 as s", "id div 40 as m").selectExpr("s as station_code", "add_months(date'2000-01-01', cast(m as int)) as date", "m % 3 as consistency_level", *[x for x in days.split(", ") if x])
    whole = sorted(map(str, streamflow.build_clean_streamflow_daily(months).collect()))
    monkeypatch.setattr(streamflow, "MONTHS_A_TASK", 20)
    out = streamflow.build_clean_streamflow_daily(months)
    assert out.rdd.getNumPartitions() >= 30 and sorted(map(str, out.collect())) == whole and len(whole) == 40 * 456
