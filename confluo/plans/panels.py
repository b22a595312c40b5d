"""Panel queries on orders, customers and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from confluo.functions.numeric import number
from confluo.operators import panel, reshape, windows
from confluo.plans.registry import Tables, query

_YEARLY = "y AS (SELECT c_nationkey AS unit, CAST(year(o_orderdate) AS INT) AS year, round(sum(o_totalprice), 2) AS a, CASE WHEN count(*) % 5 > 0 THEN avg(c_acctbal) END AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def yearly(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("unit"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("a"), F.when(F.count("*") % 5 > 0, F.avg("c_acctbal")).alias("b"), F.count("*").alias("n"))


@query(f"""
WITH {_YEARLY}, c AS (SELECT unit, count(a) AS ca, count(b) AS cb FROM y GROUP BY 1), m AS (SELECT least(median(ca), median(cb)) AS t FROM c) SELECT unit, year, a FROM y WHERE unit IN (SELECT unit FROM c, m WHERE ca >= t AND cb >= t)
""")
def balanced_panel_filter(t: Tables) -> DataFrame:
    return panel.balanced_units(yearly(t), "unit", ["a", "b"]).select("unit", "year", "a")


@query(f"WITH {_YEARLY} SELECT count(DISTINCT unit) AS units, count(DISTINCT year) AS years, count(*) AS cells, count(DISTINCT unit) * count(DISTINCT year) = count(*) AS balanced FROM y")
def balance_check(t: Tables) -> DataFrame:
    return yearly(t).agg(F.countDistinct("unit").alias("units"), F.countDistinct("year").alias("years"), F.countDistinct("unit", "year").alias("cells")).withColumn("balanced", F.col("units") * F.col("years") == F.col("cells"))


_GRID = f"""
{_YEARLY}, g AS (SELECT u.unit, k.year, CASE WHEN (u.unit * 7 + k.year) % 3 = 0 THEN a END AS a FROM (SELECT DISTINCT unit FROM y) u CROSS JOIN (SELECT DISTINCT year FROM y) k LEFT JOIN y USING (unit, year)),
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY year) AS k FROM g),
i AS (SELECT *, last_value(a IGNORE NULLS) OVER b AS va, last_value(CASE WHEN a IS NOT NULL THEN k END IGNORE NULLS) OVER b AS ka, first_value(a IGNORE NULLS) OVER f AS vb, first_value(CASE WHEN a IS NOT NULL THEN k END IGNORE NULLS) OVER f AS kb FROM r
WINDOW b AS (PARTITION BY unit ORDER BY k ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY unit ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


def _grid(t: Tables) -> DataFrame:
    y = yearly(t)
    g = reshape.complete_grid(y, "unit", y, "year")
    return g.withColumn("a", F.when((F.col("unit") * 7 + F.col("year")) % 3 == 0, F.col("a")))


for _name, _extend, _end in (("complete_grid_interpolate", True, "va"), ("interpolate_inner_only", False, "NULL")):
    query(
        f"WITH {_GRID} SELECT unit, year, round(CASE WHEN a IS NOT NULL THEN a WHEN ka IS NOT NULL AND kb IS NOT NULL THEN va + (vb - va) * (k - ka) / (kb - ka) WHEN kb IS NULL THEN {_end} END, 4) AS filled FROM i", _name
    )(lambda t, extend=_extend: windows.interpolate(_grid(t), "unit", "year", "a", "filled", extend=extend).select("unit", "year", F.round("filled", 4).alias("filled")))


@query("""
WITH y AS (SELECT c_nationkey AS unit, CAST(year(o_orderdate) AS INT) AS year, round(sum(o_totalprice), 2) AS v, round(sum(o_totalprice) / 3 + count(*), 2) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
f AS (SELECT unit, v / nullif(w, 0) AS f FROM y WHERE year = 1997)
SELECT unit, year, round(w, 4) AS v FROM y WHERE year >= 1997 UNION ALL SELECT y.unit, year, round(v * f, 4) FROM y JOIN f USING (unit) WHERE year < 1997
""")
def gdp_linkage(t: Tables) -> DataFrame:
    y = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("unit"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.round(F.sum("o_totalprice") / 3 + F.count("*"), 2).alias("w"))
    out = panel.splice(y.select("unit", "year", "v"), y.where("year >= 1997").select("unit", "year", F.col("w").alias("v")), "unit", "year", "v", 1997)
    return out.withColumn("v", F.round("v", 4))


@query(f"""
WITH {_YEARLY}, d AS (SELECT unit, year, CASE WHEN unit % 4 = 3 AND year % 4 = 0 THEN 0 ELSE n END AS deaths, a AS population FROM y)
SELECT unit AS mun_id, year, deaths, population, round(deaths * 1000 / nullif(population, 0), 6) AS mortality_rate, round(CASE WHEN count(*) OVER w = 5 THEN sum(deaths) OVER w END * 1000 / nullif(population, 0), 6) AS mortality_rate_5y FROM d
WINDOW w AS (PARTITION BY unit ORDER BY year ROWS 4 PRECEDING)
""")
def mortality_panel(t: Tables) -> DataFrame:
    y = yearly(t)
    deaths = y.where("not (unit % 4 = 3 and year % 4 = 0)").select(F.col("unit").alias("mun_id"), "year", F.col("n").alias("deaths"))
    out = panel.mortality(deaths, y.select(F.col("unit").alias("mun_id"), "year", F.col("a").alias("population")))
    return out.select("mun_id", "year", "deaths", "population", F.round("mortality_rate", 6).alias("mortality_rate"), F.round("mortality_rate_5y", 6).alias("mortality_rate_5y"))


@query("""
WITH p AS (SELECT l_partkey AS pixel, CAST(year(l_shipdate) AS INT) AS year, CASE min(l_returnflag) WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS code FROM lineitem GROUP BY ALL),
b AS (SELECT a.year, a.pixel % 10 AS zone, p.code AS was, a.code AS is_ FROM p a JOIN p ON p.pixel = a.pixel AND p.year = a.year - 1)
SELECT zone, year, count(*) FILTER (was = 1 AND is_ <> 1) AS "left", count(*) FILTER (was = 1 AND is_ = 2) AS to_farm, count(*) FILTER (was = 1 AND is_ IN (2, 3)) AS to_any FROM b GROUP BY ALL
""")
def two_period_transition(t: Tables) -> DataFrame:
    flag = F.min("l_returnflag")
    p = t.lineitem.groupBy(F.col("l_partkey").alias("pixel_id"), F.year("l_shipdate").alias("year")).agg(F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).alias("class_code"))
    return panel.transitions(p.withColumn("zone", F.col("pixel_id") % 10), groups={"farm": [2], "any": [2, 3]}, by=["zone"])


@query("""
SELECT p_brand AS zone, p_size AS year, CAST(count(*) AS BIGINT) AS land_cover_total, CAST(count(*) FILTER (p_partkey % 3 = 0) AS BIGINT) AS land_cover_class_0, CAST(count(*) FILTER (p_partkey % 3 = 1) AS BIGINT) AS land_cover_class_1 FROM part GROUP BY ALL
""")
def zonal_histogram(t: Tables) -> DataFrame:
    pixels = t.part.select(F.col("p_brand").alias("zone"), F.col("p_size").alias("year"), (F.col("p_partkey") % 3).alias("code"), F.lit(1).cast("long").alias("n"))
    return panel.zonal_histogram(pixels, "zone", "year", "code", [0, 1])


@query(f"""
WITH {_YEARLY}, k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY year) AS i FROM y)
SELECT unit, year, CASE WHEN count(*) OVER w >= 2 THEN round(regr_slope(a, year) OVER w, 3) END AS slope FROM k WINDOW w AS (PARTITION BY unit ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")
def sliding_regression_slope(t: Tables) -> DataFrame:
    w = Window.partitionBy("unit").orderBy("year").rowsBetween(-2, 0)
    return yearly(t).select("unit", "year", F.round(F.regr_slope("a", "year").over(w), 3).alias("slope"))


@query(f"""
WITH {_YEARLY}, k AS (SELECT unit, year, a, row_number() OVER (PARTITION BY unit ORDER BY year) AS i, count(*) OVER (PARTITION BY unit) AS n FROM y),
f AS (SELECT k.unit, k.i, regr_slope(o.a, o.year) AS slope, regr_intercept(o.a, o.year) AS start FROM k JOIN k o ON o.unit = k.unit AND o.i BETWEEN k.i AND k.i + greatest(k.n // 2, 2) - 1 WHERE k.i + greatest(k.n // 2, 2) - 1 <= k.n GROUP BY ALL HAVING count(o.a) >= 2),
m AS (SELECT unit, median(slope) AS slope, median(start) AS start FROM f GROUP BY 1), r AS (SELECT k.*, CASE WHEN n >= 4 THEN start + slope * year END AS fitted FROM k LEFT JOIN m USING (unit)),
q AS (SELECT unit, quantile_cont(a - fitted, 0.25) AS q1, quantile_cont(a - fitted, 0.75) AS q3 FROM r GROUP BY 1)
SELECT unit, year, round(a, 3) AS a, round(fitted, 3) AS fitted, round(CASE WHEN a - fitted < q1 - 1.5 * (q3 - q1) OR a - fitted > q3 + 1.5 * (q3 - q1) THEN fitted ELSE a END, 3) AS adjusted FROM r JOIN q USING (unit)
""")
def sliding_ols_adjust(t: Tables) -> DataFrame:
    out = windows.sliding_ols(yearly(t).select("unit", "year", "a"), "unit", "year", "a", "year")
    return out.select("unit", F.col("year").cast("int").alias("year"), *[F.round(c, 3).alias(c) for c in ("a", "fitted", "adjusted")])


@query("SELECT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(y) AS BIGINT) AS iy, x * 0.5 AS min_x, y * 0.5 AS min_y, x * 0.5 + 0.5 AS max_x, y * 0.5 + 0.5 AS max_y FROM (SELECT unnest(range(0, 8))::DOUBLE AS x), (SELECT unnest(range(0, 4))::DOUBLE AS y)")
def grid_of_boxes(t: Tables) -> DataFrame:
    return panel.grid_boxes(t.spark, (0.0, 0.0, 4.0, 2.0), 0.5)


@query("""
SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1997 THEN o_custkey * 100000 + o_orderkey % 1000 ELSE o_orderkey % 1000 END AS code FROM orders
""")
def census_recode(t: Tables) -> DataFrame:
    as_2010 = F.when(F.year("o_orderdate") == 1997, 2010).otherwise(2000)
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("state"), (F.col("o_orderkey") % 1000).alias("municipality"), as_2010.alias("year"))
    return o.select("o_orderkey", panel.census_municipality().alias("code"))


@query("SELECT count(x) AS n_numbers, round(sum(x), 4) AS total FROM (SELECT try_cast(c_name AS DOUBLE) AS x FROM customer UNION ALL SELECT try_cast(CAST(c_acctbal AS VARCHAR) AS DOUBLE) FROM customer)")
def coerce_numbers(t: Tables) -> DataFrame:
    both = t.customer.select(number("c_name").alias("x")).union(t.customer.select(number(F.col("c_acctbal").cast("string"))))
    return both.agg(F.count("x").alias("n_numbers"), F.round(F.sum("x"), 4).alias("total"))


@query(f"""
WITH {_GRID}, s AS (SELECT unit FROM g GROUP BY 1 HAVING avg(CAST(a IS NULL AS INT)) <= 0.7), f AS (SELECT unit, year, CASE WHEN a IS NOT NULL THEN a ELSE va + (vb - va) * (k - ka) / (kb - ka) END AS a FROM i)
SELECT unit, year, round(a, 4) AS a FROM f WHERE a IS NOT NULL AND unit IN (SELECT unit FROM s)
""")
def imputed_model_rows(t: Tables) -> DataFrame:
    from confluo.operators.estimate import impute_for_model

    return impute_for_model(_grid(t).select("unit", "year", "a"), "unit", "year", ["a"], most_missing=0.7).select("unit", "year", F.round("a", 4).alias("a"))


@query("""
WITH p AS (SELECT CASE WHEN c_nationkey % 4 > 0 THEN c_nationkey END AS zone, c_acctbal AS x, c_nationkey * 10.0::DOUBLE AS y, CAST(c_custkey AS DOUBLE) AS v FROM customer), z AS (SELECT n_nationkey AS zone, n_nationkey * 100.0::DOUBLE AS x, n_nationkey * 10.0::DOUBLE AS y FROM nation),
m AS (SELECT zone, avg(v) AS v FROM p WHERE zone IS NOT NULL GROUP BY 1), o AS (SELECT x, y, avg(v) AS v FROM p GROUP BY ALL),
n AS (SELECT z.zone, arg_min(o.v, pow(o.x - z.x, 2) + pow(o.y - z.y, 2)) AS v FROM z, o GROUP BY 1)
SELECT z.zone, round(coalesce(m.v, n.v), 4) AS v FROM z LEFT JOIN m USING (zone) JOIN n USING (zone)
""")
def zonal_mean_with_fallback(t: Tables) -> DataFrame:
    """Means of the pixels of each zone; a fourth of the zones have none and take the nearest pixel."""
    key = F.col("c_nationkey")
    pixels = t.customer.select(F.when(key % 4 > 0, key).alias("zone"), F.col("c_acctbal").alias("x"), (key * 10.0).alias("y"), F.col("c_custkey").cast("double").alias("v"))
    zones = t.nation.select(F.col("n_nationkey").alias("zone"), (F.col("n_nationkey") * 100.0).alias("x"), (F.col("n_nationkey") * 10.0).alias("y"))
    return panel.zonal_mean(pixels, zones, "v", step=5.0).withColumn("v", F.round("v", 4))
