"""Cleaning queries. Events stand for measurements: the user is the station, the type the variable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from confluo.functions.numeric import transform
from confluo.operators import clean, profile, reshape, streamflow
from confluo.plans.registry import Tables, query

#: Values that hold sentinels, impossible and giant ones, made from the measured ones.
_DIRTY_SQL = """
dirty AS (SELECT event_id, CAST(user_id AS VARCHAR) AS station_code, CASE event_type WHEN 'click' THEN 'ph' WHEN 'view' THEN 'cadmium' WHEN 'purchase' THEN 'total_coliforms' ELSE 'turbidity' END AS variable,
CASE WHEN event_id % 97 = 1 THEN 9999.0 WHEN event_id % 89 = 2 THEN 45000.0 WHEN event_id % 83 = 3 THEN -value WHEN event_id % 199 = 4 THEN value * 1e7 ELSE value / 10 END AS value FROM events)
"""
_LABEL_SQL = """
labelled AS (SELECT *, CASE WHEN value IS NULL THEN 'OK' WHEN value IN (9999, 99999, 999999) OR value BETWEEN 44000 AND 46000 THEN 'REMOVE_CODED' WHEN variable <> 'ph' AND value < 0 THEN 'REMOVE_INVALID'
WHEN variable = 'ph' AND (value < 0 OR value > 14) THEN 'REMOVE_INVALID' WHEN variable = 'cadmium' AND value >= 1000 THEN 'REMOVE_CODED' ELSE 'OK' END AS label FROM dirty)
"""
_GIANT_SQL = f"""
{_DIRTY_SQL}, {_LABEL_SQL}, p AS (SELECT variable, quantile_cont(value, 0.99) AS p99 FROM labelled WHERE label = 'OK' GROUP BY 1),
flagged AS (SELECT labelled.* REPLACE (CASE WHEN label = 'OK' AND variable <> 'total_coliforms' AND p99 > 0 AND value > 1000 * p99 THEN 'REMOVE_CODED' ELSE label END AS label) FROM labelled LEFT JOIN p USING (variable))
"""


def dirty(t: Tables) -> DataFrame:
    kind, i, v = F.col("event_type"), F.col("event_id"), F.col("value")
    variable = F.when(kind == "click", "ph").when(kind == "view", "cadmium").when(kind == "purchase", "total_coliforms").otherwise("turbidity")
    value = F.when(i % 97 == 1, 9999.0).when(i % 89 == 2, 45000.0).when(i % 83 == 3, -v).when(i % 199 == 4, v * 1e7).otherwise(v / 10)
    return t.events.select("event_id", F.col("user_id").cast("string").alias("station_code"), variable.alias("variable"), value.alias("value"))


def wide(t: Tables) -> DataFrame:
    names = ("ph", "cadmium", "total_coliforms", "turbidity")
    return dirty(t).select(F.col("event_id").alias("row_id"), "station_code", *[F.when(F.col("variable") == n, F.col("value")).alias(n) for n in names])


VARIABLES = ("ph", "cadmium", "total_coliforms", "turbidity")


@query(f"WITH {_DIRTY_SQL}, {_LABEL_SQL} SELECT event_id, variable, label FROM labelled")
def classify_values(t: Tables) -> DataFrame:
    return dirty(t).select("event_id", "variable", clean.classify_value(F.col("variable"), F.col("value")).alias("label"))


@query(f"""
WITH {_GIANT_SQL}, s AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.99) AS p99 FROM flagged WHERE label = 'OK' GROUP BY 1)
SELECT event_id AS row_id, variable, label, coalesce(label = 'OK' AND (value > q3 + 3 * (q3 - q1) OR (p99 > 0 AND value > 10 * p99)), false) AS extreme, label = 'OK' AND variable = 'total_coliforms' AND value > 1e7 AS microbio FROM flagged LEFT JOIN s USING (variable) WHERE value IS NOT NULL
""")
def giant_value_and_review_flags(t: Tables) -> DataFrame:
    flags = clean.build_cleaning_flags(wide(t), VARIABLES)
    return flags.select("row_id", "variable", F.col("cleaning_label").alias("label"), F.col("flag_extreme_review").alias("extreme"), F.col("flag_microbio_high").alias("microbio"))


@query(f"WITH {_GIANT_SQL} SELECT variable, count(*) FILTER (label = 'OK') AS ok, count(*) FILTER (label = 'REMOVE_CODED') AS coded, count(*) FILTER (label = 'REMOVE_INVALID') AS invalid FROM flagged WHERE value IS NOT NULL GROUP BY 1")
def cleaning_label_pivot(t: Tables) -> DataFrame:
    summary = clean.clean_measurement_values(wide(t), VARIABLES)[2]
    return summary.select("variable", F.col("OK").alias("ok"), F.col("REMOVE_CODED").alias("coded"), F.col("REMOVE_INVALID").alias("invalid"))


@query(f"WITH {_GIANT_SQL} SELECT event_id AS row_id, " + ", ".join(f"CASE WHEN variable = '{v}' AND label = 'OK' THEN value END AS {v}" for v in VARIABLES) + " FROM flagged")
def clean_wide_table(t: Tables) -> DataFrame:
    return clean.clean_measurement_values(wide(t), VARIABLES)[0].select("row_id", *VARIABLES)


@query("""
WITH v AS (SELECT event_type AS variable, user_id, value FROM events UNION ALL SELECT 'squared', user_id, pow(value, 4) FROM events UNION ALL SELECT 'shifted', user_id, pow(value, 4) - 1 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END FROM events UNION ALL SELECT 'few', user_id, value FROM events WHERE event_id < 10),
p AS (SELECT variable, count(value) AS n, min(value) AS lo, skewness(value) AS skew, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.99) AS p99 FROM v GROUP BY 1)
SELECT variable, CASE WHEN n < 20 THEN 'identity' WHEN lo > 0 AND (skew >= 1 OR p99 / nullif(med, 0) >= 10) THEN 'log10' WHEN lo >= 0 AND (skew >= 1 OR p99 / nullif(q1, 0) >= 10) THEN 'log10_1p' ELSE 'identity' END AS recommended_transform FROM p
""")
def transform_recommendation(t: Tables) -> DataFrame:
    e = t.events
    v = F.pow("value", F.lit(4.0))
    long = (
        e.select(F.col("event_type").alias("variable"), "user_id", "value").union(e.select(F.lit("squared"), "user_id", v)).union(e.select(F.lit("shifted"), "user_id", v - 1 + (F.col("event_id") % 2 == 0).cast("int")))
        .union(e.where("event_id < 10").select(F.lit("few"), "user_id", "value"))
    )
    return profile.recommend_transform(profile.variable_profile(long.withColumnRenamed("user_id", "station_code"))).select("variable", "recommended_transform")


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN value WHEN 'view' THEN CASE WHEN value - 50 >= 0 THEN round(log10(1 + value - 50), 6) END ELSE CASE WHEN value > 0 THEN round(log10(value), 6) END END AS y FROM events
""")
def apply_transform(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    y = F.when(kind == "click", transform("value", "identity")).when(kind == "view", F.round(transform(F.col("value") - 50, "log10_1p"), 6)).otherwise(F.round(transform("value", "log10"), 6))
    return t.events.select("event_id", y.alias("y"))


@query("""
WITH v AS (SELECT event_id, user_id, CASE WHEN event_id % 17 = 0 THEN 100000.0 WHEN event_id % 13 > 0 THEN value END AS x FROM events), s AS (SELECT user_id, count(*) FILTER (x = 100000) / nullif(count(x), 0) AS share FROM v GROUP BY 1)
SELECT event_id, coalesce(share > 0.05, false) AS bad FROM v JOIN s USING (user_id)
""")
def sentinel_station_share(t: Tables) -> DataFrame:
    i = F.col("event_id")
    daily = t.events.select("event_id", F.col("user_id").alias("station_code"), F.col("ts").alias("date"), F.when(i % 17 == 0, 100_000.0).when(i % 13 > 0, F.col("value")).alias("discharge"))
    return streamflow.apply_rules(daily, tie=("event_id",)).select("event_id", F.col("flag_bad_station").alias("bad"))


@query("""
WITH v AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 = 0 THEN 0.0 WHEN event_id % 5 = 1 THEN value / 1e5 ELSE value * 10 END AS x FROM events), l AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM v)
SELECT event_id, coalesce((p > 0 AND p < 0.01 AND x / nullif(p, 0) > 10000) OR (p = 0 AND x > 0), false) AS jump FROM l
""")
def jump_flag(t: Tables) -> DataFrame:
    i = F.col("event_id")
    daily = t.events.select("event_id", F.col("user_id").alias("station_code"), F.col("ts").alias("date"), F.when(i % 5 == 0, 0.0).when(i % 5 == 1, F.col("value") / 1e5).otherwise(F.col("value") * 10).alias("discharge"))
    return streamflow.apply_rules(daily, tie=("event_id",)).select("event_id", F.col("flag_jump_suspicious").alias("jump"))


def monthly(t: Tables) -> DataFrame:
    """Orders as months of a station: discharges by the day of the month, and their status."""
    o = t.orders.select(F.col("o_custkey").alias("station_code"), F.trunc("o_orderdate", "MM").alias("date"), F.dayofmonth("o_orderdate").alias("d"), "o_totalprice", "o_orderstatus", "o_orderkey")
    each = [c for d in range(1, 32) for c in (F.max(F.when(F.col("d") == d, F.col("o_totalprice"))).alias(f"discharge_{d}"), F.max(F.when(F.col("d") == d, F.col("o_orderstatus"))).alias(f"discharge_{d}_status"))]
    return o.groupBy("station_code", "date").agg(*each, F.max(F.col("o_orderkey") % 3).alias("consistency_level"))


@query("""
WITH m AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(day(o_orderdate) AS INT) AS d, max(o_totalprice) AS v, max(o_orderstatus) AS s FROM orders GROUP BY ALL),
k AS (SELECT DISTINCT o_custkey, m FROM m), g AS (SELECT o_custkey, m, unnest(range(1, 32))::INT AS d FROM k)
SELECT o_custkey AS station_code, CAST(g.m + to_days(g.d - 1) AS DATE) AS date, v AS value, s AS quality_flag FROM g LEFT JOIN m USING (o_custkey, m, d) WHERE month(g.m + to_days(g.d - 1)) = month(g.m)
""")
def month_wide_to_daily(t: Tables) -> DataFrame:
    return reshape.month_to_daily(monthly(t)).select("station_code", "date", "value", "quality_flag")


@query("""
WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS date, event_id % 3 AS c, CASE WHEN event_id % 4 > 0 THEN value END AS x, ['ok', 'suspect', '5', 'none'][event_id % 4 + 1] AS q FROM events),
r AS (SELECT *, CASE q WHEN 'ok' THEN 1000 WHEN 'suspect' THEN 100 WHEN '5' THEN 994 ELSE 0 END AS rank FROM e)
SELECT user_id, date, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY c DESC, x IS NOT NULL DESC, rank DESC, event_id) AS k FROM r) WHERE k = 1
""")
def best_row_per_station_day(t: Tables) -> DataFrame:
    i = F.col("event_id")
    q = F.element_at(F.array(*[F.lit(x) for x in ("ok", "suspect", "5", "none")]), (i % 4 + 1).cast("int"))
    no = F.lit(False)
    daily = t.events.select(
        "event_id", F.col("user_id").alias("station_code"), F.to_date("ts").alias("date"), (i % 3).alias("consistency_level"), F.when(i % 4 > 0, F.col("value")).alias("discharge"), q.alias("quality_flag"), F.lit(None).cast("timestamp").alias("updated_at"),
        no.alias("flag_bad_station"), no.alias("flag_constant_run_suspicious"), no.alias("flag_jump_suspicious"),
    )
    return streamflow.best_rows(daily, tie=("event_id",)).select(F.col("station_code").alias("user_id"), "date", "event_id")


@query("""
WITH m AS (SELECT o_custkey AS station_code, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(day(o_orderdate) AS INT) AS d, max(o_totalprice) AS v, max(o_orderstatus) AS s FROM orders GROUP BY ALL),
k AS (SELECT o_custkey AS station_code, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, max(o_orderkey % 3) AS consistency_level FROM orders GROUP BY ALL), g AS (SELECT *, unnest(range(1, 32))::INT AS d FROM k),
r AS (SELECT station_code, CAST(g.m + to_days(g.d - 1) AS DATE) AS date, v, s AS quality_flag, consistency_level FROM g LEFT JOIN m USING (station_code, m, d) WHERE month(g.m + to_days(g.d - 1)) = month(g.m)),
b AS (SELECT *, coalesce(count(*) FILTER (v = 100000) OVER w / nullif(count(v) OVER w, 0) > 0.05, false) AS bad, CASE WHEN v <> 100000 THEN v END AS x FROM r WINDOW w AS (PARTITION BY station_code)),
c AS (SELECT *, sum(CASE WHEN x = before THEN 0 ELSE 1 END) OVER (PARTITION BY station_code ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(x) OVER (PARTITION BY station_code ORDER BY date) AS before FROM b)),
n AS (SELECT *, count(*) OVER (PARTITION BY station_code, run) AS n FROM c), y AS (SELECT *, CASE WHEN n <= 365 THEN x END AS y FROM n),
j AS (SELECT *, lag(y) OVER (PARTITION BY station_code ORDER BY date) AS p FROM y)
SELECT station_code, date, CASE WHEN y < 0 OR y > 1e6 OR y IN (9999, 99999, 999999) THEN NULL ELSE y END AS discharge, quality_flag, consistency_level, CAST(NULL AS VARCHAR) AS streamflow_acquisition_method,
coalesce(x <> 0 AND n BETWEEN 31 AND 365, false) AS flag_constant_run_suspicious, coalesce((p > 0 AND p < 0.01 AND y / nullif(p, 0) > 10000) OR (p = 0 AND y > 0), false) AS flag_jump_suspicious, bad AS flag_bad_station FROM j
""")
def clean_streamflow_daily(t: Tables) -> DataFrame:
    return streamflow.build_clean_streamflow_daily(monthly(t))


@query("""
SELECT user_id, count(*) AS n, round(avg(CAST(value < 20 AS DOUBLE)), 6) AS low_share FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING avg(CAST(value IS NULL OR value < 5 AS DOUBLE)) <= 0.05 AND count(value) >= 4) GROUP BY 1
""")
def station_quality_filter(t: Tables) -> DataFrame:
    marked = t.events.withColumn("v", F.when(F.col("value") >= 5, F.col("value")))
    kept = marked.withColumn("__s", F.avg(F.col("v").isNull().cast("double")).over(Window.partitionBy("user_id"))).withColumn("__n", F.count("value").over(Window.partitionBy("user_id"))).where("__s <= 0.05 and __n >= 4")
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") < 20).cast("double")), 6).alias("low_share"))
