"""Estimation queries. Where the closed form is a grouping, SQL states it too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.operators import suite
from confluo.operators.estimate import Fit, fe_iv, fe_ols, fit_subsamples, with_interactions
from confluo.plans.registry import Tables, query
from confluo.session import cut

_PANEL = """
x AS (SELECT c_nationkey AS unit, CAST(year(o_orderdate) AS INT) AS year, avg(o_totalprice) / 1000 AS y, avg(c_acctbal) / 1000 AS x1, CAST(count(*) AS DOUBLE) AS x2 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
k AS (SELECT * FROM x WHERE unit IN (SELECT unit FROM x GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT year) FROM x)))
"""


def balanced(t: Tables) -> DataFrame:
    """The balanced panel. It is small and every model goes over it many times, so the orders are joined once and it is kept."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    x = cut(j.groupBy(F.col("c_nationkey").alias("unit"), F.year("o_orderdate").alias("year")).agg((F.avg("o_totalprice") / 1000).alias("y"), (F.avg("c_acctbal") / 1000).alias("x1"), F.count("*").cast("double").alias("x2")))
    whole = x.groupBy("unit").count().where(F.col("count") == F.lit(x.select("year").distinct().count())).select("unit")
    return x.join(whole, "unit")


def _table(t: Tables, f: Fit) -> DataFrame:
    return t.spark.createDataFrame([(r["term"], round(r["estimate"], 5), round(r["std_error"], 5), f.n) for r in f.tidy()], "term string, estimate double, std_error double, nobs long")


def _closed_form(demean: str, k: str) -> str:
    """Least squares of y on x1 from demeaned sums, with the variance by clusters of units."""
    return f"""
WITH {_PANEL}, d AS ({demean}), b AS (SELECT sum(dx * dy) / sum(dx * dx) AS b, sum(dx * dx) AS xx, count(*) AS n FROM d), s AS (SELECT unit, sum(dx * (dy - b * dx)) AS s FROM d, b GROUP BY 1),
v AS (SELECT count(*) AS g, sum(s * s) AS m FROM s)
SELECT 'x1' AS term, round(b, 5) AS estimate, round(sqrt(m * g / (g - 1) * (n - 1) / (n - {k})) / xx, 5) AS std_error, n AS nobs FROM b, v
"""


@query(_closed_form("SELECT unit, x1 - avg(x1) OVER (PARTITION BY unit) AS dx, y - avg(y) OVER (PARTITION BY unit) AS dy FROM k", "2"))
def fe_ols_one_way(t: Tables) -> DataFrame:
    return _table(t, fe_ols(balanced(t), "y", ["x1"], ["unit"], ["unit"]))


@query(
    _closed_form(
        "SELECT unit, x1 - avg(x1) OVER (PARTITION BY unit) - avg(x1) OVER (PARTITION BY year) + avg(x1) OVER () AS dx, y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS dy FROM k",
        "(1 + (SELECT count(DISTINCT year) FROM k))",
    )
)
def fe_ols_two_way_balanced(t: Tables) -> DataFrame:
    return _table(t, fe_ols(balanced(t), "y", ["x1"], ["unit", "year"], ["unit"]))


@query(f"""
WITH {_PANEL}, d AS (SELECT x1 - avg(x1) OVER (PARTITION BY unit) AS e, x2 - avg(x2) OVER (PARTITION BY unit) AS z, y - avg(y) OVER (PARTITION BY unit) AS y FROM k)
SELECT round(sum(z * e) / sum(z * z), 6) AS first_stage, round(sum(z * y) / sum(z * z), 6) AS reduced_form, round(sum(z * y) / sum(z * e), 3) AS iv FROM d
""")
def iv_two_stage(t: Tables) -> DataFrame:
    p = balanced(t)
    first, reduced = (fe_ols(p, y, ["x2"], ["unit"], ["unit"]).beta[0] for y in ("x1", "y"))
    iv = fe_iv(p, "y", "x1", ["x2"], [], ["unit"], ["unit"]).beta[0]
    return t.spark.createDataFrame([(round(float(first), 6), round(float(reduced), 6), round(float(iv), 3))], "first_stage double, reduced_form double, iv double")


#: Least squares on two regressors, from demeaned sums. ``d`` has unit, year, dx, dz and dy.
_TWO = """
m AS (SELECT sum(dx * dx) AS xx, sum(dx * dz) AS xz, sum(dz * dz) AS zz, sum(dx * dy) AS xy, sum(dz * dy) AS zy, count(*) AS n FROM d),
b AS (SELECT *, xx * zz - xz * xz AS det, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM m),
r AS (SELECT d.*, dx * (dy - b1 * dx - b2 * dz) AS s1, dz * (dy - b1 * dx - b2 * dz) AS s2 FROM d, b)
"""


@query(f"""
WITH {_PANEL}, d AS (SELECT unit, year, x1 - avg(x1) OVER (PARTITION BY unit) AS dx, x2 - avg(x2) OVER (PARTITION BY unit) AS dz, y - avg(y) OVER (PARTITION BY unit) AS dy FROM k), {_TWO},
c AS (SELECT 1 AS sign, sum(s1) AS s1, sum(s2) AS s2, 'u' AS how FROM r GROUP BY unit UNION ALL SELECT 1, sum(s1), sum(s2), 'y' FROM r GROUP BY year UNION ALL SELECT -1, sum(s1), sum(s2), 'b' FROM r GROUP BY unit, year),
g AS (SELECT how, min(sign) AS sign, count(*) AS g, sum(s1 * s1) AS m11, sum(s1 * s2) AS m12, sum(s2 * s2) AS m22 FROM c GROUP BY how),
v AS (SELECT sum(sign * g / (g - 1.0) * (n - 1.0) / (n - 3.0) * (zz * zz * m11 - 2 * zz * xz * m12 + xz * xz * m22) / (det * det)) AS v1, sum(sign * g / (g - 1.0) * (n - 1.0) / (n - 3.0) * (xx * xx * m22 - 2 * xx * xz * m12 + xz * xz * m11) / (det * det)) AS v2 FROM g, b)
SELECT 'x1' AS term, round(b1, 5) AS estimate, round(sqrt(greatest(v1, 0)), 5) AS std_error, n AS nobs FROM b, v UNION ALL SELECT 'x2', round(b2, 5), round(sqrt(greatest(v2, 0)), 5), n FROM b, v
""")
def multiway_cluster_errors(t: Tables) -> DataFrame:
    """Errors clustered by unit and by year. The unit is nested in its clusters, so its levels don't count in the factor."""
    return _table(t, fe_ols(balanced(t), "y", ["x1", "x2"], ["unit"], ["unit", "year"]))


@query(f"""
WITH {_PANEL}, d AS (SELECT unit, year, i - avg(i) OVER (PARTITION BY unit) AS dx, x1 - avg(x1) OVER (PARTITION BY unit) AS dz, y - avg(y) OVER (PARTITION BY unit) AS dy FROM (SELECT *, x1 * CAST(year >= 1998 AS DOUBLE) AS i FROM k)), {_TWO}
SELECT 'x1' AS term, round(b2, 5) AS estimate, n AS nobs FROM b UNION ALL SELECT 'x1_late', round(b1, 5), n FROM b
""")
def interaction_model(t: Tables) -> DataFrame:
    """A regressor by itself and in late years."""
    p, names = with_interactions(balanced(t).withColumn("late", (F.col("year") >= 1998).cast("double")), ["x1"], "late")
    f = fe_ols(p, "y", ["x1", *names], ["unit"], ["unit"])
    return t.spark.createDataFrame([(n, round(float(b), 5), f.n) for n, b in zip(f.names, f.beta)], "term string, estimate double, nobs long")


@query(f"""
WITH {_PANEL}, h AS (SELECT *, CASE WHEN unit % 3 = 0 THEN 'a' WHEN unit % 3 = 1 THEN 'b' ELSE 'c' END AS part FROM k), d AS (SELECT part, x1 - avg(x1) OVER (PARTITION BY unit) AS dx, y - avg(y) OVER (PARTITION BY unit) AS dy FROM h)
SELECT part, round(sum(dx * dy) / sum(dx * dx), 5) AS estimate, count(*) AS nobs FROM d GROUP BY part
""")
def subsample_models(t: Tables) -> DataFrame:
    """The same model in three parts of the units, and in one that has none."""
    p = balanced(t).withColumn("part", F.element_at(F.array(*map(F.lit, "abc")), (F.col("unit") % 3 + 1).cast("int")))
    fits = fit_subsamples(p, "part", ["a", "b", "c", "none"], lambda d: fe_ols(d, "y", ["x1"], ["unit"], ["unit"]))
    return t.spark.createDataFrame([(k, round(float(f.beta[0]), 5), f.n) for k, f in fits.items() if f], "part string, estimate double, nobs long")


_CATALOG = """
c AS (SELECT 'total_nitrogen' AS name, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n FROM orders UNION ALL SELECT 'turbidity', count(CASE WHEN o_orderstatus = 'P' THEN 1 END) FROM orders UNION ALL SELECT 'zinc', count(*) FROM orders UNION ALL SELECT 'chlorides', count(CASE WHEN o_orderkey <= 3 THEN 1 END) FROM orders)
"""


def _catalog(t: Tables) -> list[suite.Pollutant]:
    o = t.orders.select(
        F.when(F.col("o_orderstatus") == "F", 1).alias("total_nitrogen"), F.when(F.col("o_orderstatus") == "P", 1).alias("turbidity"), F.lit(1).alias("zinc"), F.when(F.col("o_orderkey") <= 3, 1).alias("chlorides")
    )
    return suite.build_pollutant_catalog(o, {n: {} for n in ("total_nitrogen", "turbidity", "zinc", "chlorides", "depth")}, suite.SuiteSettings(tiers=(("high", 10_000), ("medium", 1_000), ("rare", 0))))


@query(f"""
WITH {_CATALOG} SELECT name, CASE name WHEN 'total_nitrogen' THEN 'nutrients' WHEN 'turbidity' THEN 'core_physicochemical' WHEN 'zinc' THEN 'metals' ELSE 'organics_pesticides' END AS type_group, n AS observation_count, CASE WHEN n >= 10000 THEN 'high' WHEN n >= 1000 THEN 'medium' ELSE 'rare' END AS importance_group FROM c
""")
def importance_tiers(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(p.name, p.type_group, p.observation_count, p.importance_group) for p in _catalog(t)], "name string, type_group string, observation_count long, importance_group string")


@query(f"""
WITH {_CATALOG}, g AS (SELECT name, CASE name WHEN 'total_nitrogen' THEN 'nutrients' WHEN 'turbidity' THEN 'core_physicochemical' WHEN 'zinc' THEN 'metals' ELSE 'organics_pesticides' END AS t, CASE WHEN n >= 10000 THEN 'high' WHEN n >= 1000 THEN 'medium' ELSE 'rare' END AS i FROM c)
SELECT 'type' AS kind, t AS name, string_agg(name, ',' ORDER BY name) AS members FROM g GROUP BY t UNION ALL SELECT 'importance', i, string_agg(name, ',' ORDER BY name) FROM g GROUP BY i
""")
def group_listing(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(kind, name, ",".join(who)) for kind, by in suite.summarize_groups(_catalog(t)).items() for name, who in by.items()], "kind string, name string, members string")


@query("""
SELECT p AS pollutant, c AS land_cover_subclass, i AS distance_step_index, b[i] AS distance_step_name, array_to_string(b[1:i], ',') AS included_buckets FROM (SELECT unnest(['ph', 'zinc']) AS p), (SELECT unnest(['c41', 'c42']) AS c), (SELECT unnest([1, 2, 3]) AS i),
(SELECT ['0_10km', '10_50km', '50_100km'] AS b)
""")
def model_spec_expansion(t: Tables) -> DataFrame:
    specs = suite.build_model_specs(suite.SuiteSettings(), ["ph", "zinc"], ["c41", "c42"], max_distance_step=3)
    return t.spark.createDataFrame([(s.pollutant, s.land_cover_subclass, s.distance_step_index, s.distance_step_name, ",".join(s.included_buckets)) for s in specs], "pollutant string, land_cover_subclass string, distance_step_index int, distance_step_name string, included_buckets string")


@query()
def model_suite(t: Tables) -> DataFrame:
    """Specs fitted as one job over the balanced panel, one of them with a regressor that isn't there."""
    s = suite.SuiteSettings(buckets=("0_10km", "10_50km"), classes=("c0", "c9"), fixed_effects=("unit", "year"), cluster="unit", controls=())
    p = balanced(t).select("unit", "year", F.col("y").alias("ph__transformed"), F.col("x1").alias("lc_0_10km_c0_cnt"), F.col("x2").alias("lc_10_50km_c0_cnt"))
    return suite.fit_specs(p, suite.build_model_specs(s, ["ph"], ["c0", "c9"]), s)


@query(f"""
WITH {_PANEL}, t AS (SELECT unit, year, x1 - avg(x1) OVER u - avg(x1) OVER w + avg(x1) OVER () AS dx, x2 - avg(x2) OVER u - avg(x2) OVER w + avg(x2) OVER () AS dz, y - avg(y) OVER u - avg(y) OVER w + avg(y) OVER () AS dy FROM k WINDOW u AS (PARTITION BY unit), w AS (PARTITION BY year)),
d AS (SELECT * FROM t), {_TWO}, l AS (SELECT count(DISTINCT year) - 1 AS years FROM k),
o AS (SELECT xy / xx AS b FROM m), os AS (SELECT sum(dx * (dy - b * dx)) AS s FROM d, o GROUP BY unit), ov AS (SELECT count(*) AS g, sum(s * s) AS q FROM os),
us AS (SELECT sum(s1) AS s1, sum(s2) AS s2 FROM r GROUP BY unit), uv AS (SELECT count(*) AS g, sum(s1 * s1) AS m11, sum(s1 * s2) AS m12, sum(s2 * s2) AS m22 FROM us)
SELECT 0 AS spec, n AS nobs, 'ok' AS status, 'lc_0_10km_c0_cnt' AS term, round(o.b, 5) AS estimate, round(sqrt(q * g / (g - 1) * (n - 1) / (n - 2 - years)) / xx, 5) AS std_error FROM o, ov, m, l
UNION ALL SELECT 1, n, 'ok', 'lc_0_10km_c0_cnt', round(b1, 5), round(sqrt(g / (g - 1.0) * (n - 1.0) / (n - 3 - years) * (zz * zz * m11 - 2 * zz * xz * m12 + xz * xz * m22)) / det, 5) FROM b, uv, l
UNION ALL SELECT 1, n, 'ok', 'lc_10_50km_c0_cnt', round(b2, 5), round(sqrt(g / (g - 1.0) * (n - 1.0) / (n - 3 - years) * (xx * xx * m22 - 2 * xx * xz * m12 + xz * xz * m11)) / det, 5) FROM b, uv, l
UNION ALL SELECT 2, 0, 'failed', NULL, NULL, NULL UNION ALL SELECT 3, 0, 'failed', NULL, NULL, NULL
""")
def suite_estimates(t: Tables) -> DataFrame:
    """Estimates and errors of the models of :func:`model_suite`."""
    return model_suite(t).select("spec", "nobs", "status", "term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"))
