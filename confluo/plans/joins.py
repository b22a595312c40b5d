"""Joins of every kind on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from confluo.operators import guards, matching, reshape
from confluo.plans.registry import Tables, query


@query("""
SELECT DISTINCT l_partkey AS trench_id, CAST(year(o_orderdate) AS INT) AS year FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey IS NOT NULL AND o_orderdate IS NOT NULL
""")
def sensor_trench_year_targets(t: Tables) -> DataFrame:
    from confluo.operators.network import sensor_targets

    return sensor_targets(t.orders.select(F.col("o_orderkey").alias("station_code"), F.col("o_orderdate").alias("date")), t.lineitem.select(F.col("l_orderkey").alias("station_code"), F.col("l_partkey").alias("trench_id")))


@query("""
WITH c AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_acctbal < 2000 GROUP BY 1)
SELECT coalesce(c.k, s.k) AS nation, n_customers, n_suppliers FROM c FULL JOIN s ON c.k = s.k
""")
def outer_join_controls(t: Tables) -> DataFrame:
    c = t.customer.where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers"))
    s = t.supplier.where("s_acctbal < 2000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return c.join(s, "nation", "full")


@query("""
SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey RIGHT JOIN (SELECT * FROM region) ON n_regionkey = r_regionkey
""")
def left_and_right_joins(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "right").select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("""
SELECT l_orderkey, l_linenumber, p_type, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
""")
def checked_and_semi_joins(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    j = guards.checked_join(lines, t.part.withColumnRenamed("p_partkey", "l_partkey"), ["l_partkey"], "inner", "many_to_one")
    return guards.checked_join(j, t.supplier.withColumnRenamed("s_suppkey", "l_suppkey"), ["l_suppkey"], "inner", "many_to_one").select("l_orderkey", "l_linenumber", "p_type", "s_name")


def _fetch_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Urgent orders are attempts, so that some stations have had none."""
    stations = t.customer.select(F.col("c_custkey").alias("station_code"))
    history = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("station_code"), (F.col("o_orderstatus") == "F").alias("success"))
    archives = t.supplier.select(F.concat(F.col("s_suppkey").cast("string"), F.lit("_archive.zip")).alias("filename"))
    return stations, history, archives


def _fetch(t: Tables, mode: str) -> DataFrame:
    return matching.pending_stations(*_fetch_tables(t), mode)


_STATIONS = "SELECT CAST(c_custkey AS VARCHAR) AS station_code FROM customer"
_TRIED = "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"
_OK = f"c_custkey NOT IN ({_TRIED} AND o_orderstatus = 'F')"
_ARCHIVED = "c_custkey NOT IN (SELECT s_suppkey FROM supplier)"
for _mode, _where in {
    "default": f"WHERE {_OK} AND {_ARCHIVED}",
    "missing-only": f"WHERE c_custkey NOT IN ({_TRIED}) AND {_ARCHIVED}",
    "retry-failed": f"WHERE c_custkey IN ({_TRIED} AND o_orderstatus <> 'F') AND {_OK}",
    "redownload-all": "",
}.items():
    query(f"{_STATIONS} {_where}", f"anti_join_pending_{_mode.replace('-', '_')}")(lambda t, mode=_mode: _fetch(t, mode))


@query(f"""
WITH h AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS ok FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS station_code, CASE WHEN h.ok THEN 'succeeded' WHEN s_suppkey IS NOT NULL THEN 'archived' WHEN h.ok IS NOT NULL THEN 'failed' ELSE 'new' END AS state,
NOT coalesce(h.ok, false) AND s_suppkey IS NULL AS attempt FROM customer LEFT JOIN h ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey
""")
def fetch_states(t: Tables) -> DataFrame:
    """What is known of each station, and whether it is tried by default."""
    stations, history, archives = _fetch_tables(t)
    return matching.fetch_states(stations, history, archives)


@query("""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS station_code, event_id AS run_id, ts AS attempted_at, 1 + event_id % 3 AS attempts, event_type AS status, CASE WHEN value < 10 THEN 'slow' END AS last_error FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY attempted_at DESC, run_id DESC) AS k, sum(attempts) OVER (PARTITION BY station_code) AS total FROM e)
SELECT station_code, CAST(total AS BIGINT) AS attempts, status, last_error FROM r WHERE k = 1
""")
def attempt_merge(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").cast("string").alias("station_code"), F.col("event_id").alias("run_id"), F.col("ts").alias("attempted_at"), (1 + F.col("event_id") % 3).alias("attempts"), F.col("event_type").alias("status"), F.when(F.col("value") < 10, "slow").alias("last_error"))
    return matching.merge_attempts(e)


@query("""
SELECT a.s_suppkey AS left_id, b.s_suppkey AS right_id, round(abs(a.s_acctbal - b.s_acctbal), 6) AS distance FROM supplier a JOIN supplier b ON abs(a.s_acctbal - b.s_acctbal) <= 50
""")
def range_join_radius(t: Tables) -> DataFrame:
    return matching.radius_join(t.supplier, t.supplier, "s_acctbal", 50.0, left_id="s_suppkey", right_id="s_suppkey").withColumn("distance", F.round("distance", 6))


@query("""
WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)
SELECT a.id AS left_id, b.id AS right_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM p a JOIN p b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 40
""")
def range_join_plane(t: Tables) -> DataFrame:
    p = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").alias("y"))
    return matching.radius_join(p, p, "x", 40.0, left_id="id", right_id="id", y="y").withColumn("distance", F.round("distance", 6))


@query("""
SELECT s_suppkey, c_custkey, round(gap, 6) AS distance FROM (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS gap, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS k
FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE k = 1
""")
def nearest_match_dedup(t: Tables) -> DataFrame:
    a, b = t.supplier.withColumnRenamed("s_nationkey", "nation"), t.customer.withColumnRenamed("c_nationkey", "nation")
    return matching.nearest_join(a, b, left_id="s_suppkey", right_id="c_custkey", left_value="s_acctbal", right_value="c_acctbal", on="nation").withColumn("distance", F.round("distance", 6))


@query("""
SELECT c_custkey, c_acctbal BETWEEN 0 AND 5000 AND c_nationkey >= 5 AS in_box, CAST(floor((c_acctbal - 0) / 250 + 0.5) AS BIGINT) AS cell FROM customer
""")
def box_filter_and_grid(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", matching.in_box("c_acctbal", "c_nationkey", (0, 5, 5000, None)).alias("in_box"), matching.grid_cell("c_acctbal", 0.0, 250.0).alias("cell"))


@query("""
SELECT c_custkey FROM customer WHERE (((c_nationkey < 0) <> (c_nationkey < 20)) AND c_acctbal < 4000.0 * c_nationkey / 20) <> (((c_nationkey < 20) <> (c_nationkey < 0)) AND c_acctbal < (9000.0 - 4000.0) * (c_nationkey - 20) / -20 + 4000.0)
""")
def point_in_polygon(t: Tables) -> DataFrame:
    return t.customer.where(matching.in_polygon("c_acctbal", "c_nationkey", [(0.0, 0.0), (4000.0, 20.0), (9000.0, 0.0)])).select("c_custkey")


@query("""
WITH d AS (SELECT s_suppkey AS left_id, c_custkey AS right_id, sqrt(pow(s_acctbal - c_acctbal, 2) + pow(s_nationkey * 100 - c_nationkey * 100, 2)) AS distance FROM supplier, customer)
SELECT left_id, right_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY distance, right_id) AS k FROM d) WHERE k = 1
""")
def nearest_point_join(t: Tables) -> DataFrame:
    """The customer nearest to each supplier in a plane, without a key that they share."""
    a = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100).alias("y"))
    b = t.customer.select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100).alias("y"))
    return matching.nearest_point(a, b, left_id="s_suppkey", right_id="c_custkey", step=20.0).withColumn("distance", F.round("distance", 6))


_RINGS = """
g AS (SELECT n_nationkey AS id, n_nationkey * 300.0::DOUBLE AS x, (n_nationkey % 5) * 4.0::DOUBLE AS y FROM nation),
e AS (SELECT id, unnest([[x, y, x + 900, y + 2], [x + 900, y + 2, x + 400, y + 9], [x + 400, y + 9, x + 500, y + 4], [x + 500, y + 4, x, y]]) AS s FROM g)
"""


@query(f"""
WITH {_RINGS}, c AS (SELECT c_custkey, id, count(*) FILTER ((c_nationkey < s[2]) <> (c_nationkey < s[4]) AND c_acctbal < (s[3] - s[1]) * (c_nationkey - s[2]) / nullif(s[4] - s[2], 0) + s[1]) AS n FROM customer, e GROUP BY ALL)
SELECT c_custkey AS point_id, id AS polygon_id FROM c WHERE n % 2 = 1
""")
def points_in_polygons(t: Tables) -> DataFrame:
    """Which of many polygons, that aren't convex and overlap, each customer lies in."""
    x, y = F.col("n_nationkey") * 300.0, (F.col("n_nationkey") % 5) * 4.0
    ring = F.array(*[F.array(x + a, y + b) for a, b in ((0, 0), (900, 2), (400, 9), (500, 4))])
    points = t.customer.select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))
    return matching.polygon_join(points, t.nation.select("n_nationkey", ring.alias("ring")), point_id="c_custkey", polygon_id="n_nationkey", ring="ring", step=100.0)


@query("""
WITH b AS (SELECT o_custkey AS id, min(o_totalprice) AS x0, max(o_totalprice) AS x1, CAST(min(o_orderkey) AS DOUBLE) AS y0, CAST(max(o_orderkey) AS DOUBLE) AS y1 FROM orders GROUP BY 1)
SELECT a.id AS left_id, b.id AS right_id FROM b a JOIN b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
""")
def box_intersect_join(t: Tables) -> DataFrame:
    """Every pair of customers whose boxes touch."""
    b = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_totalprice").alias("x0"), F.min("o_orderkey").cast("double").alias("y0"), F.max("o_totalprice").alias("x1"), F.max("o_orderkey").cast("double").alias("y1"))
    return matching.box_join(b, b, ("x0", "y0", "x1", "y1"), left_id="id", right_id="id").where(F.col("left_id") < F.col("right_id"))


@query("""
SELECT n_nationkey, y.year, n.total FROM (SELECT DISTINCT n_nationkey FROM nation) CROSS JOIN (SELECT unnest(range(1995, 2003))::INT AS year) y
LEFT JOIN (SELECT c_nationkey, CAST(year(o_orderdate) AS INT) AS year, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY ALL) n ON n.c_nationkey = n_nationkey AND n.year = y.year
""")
def complete_grid(t: Tables) -> DataFrame:
    totals = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    years = t.spark.range(1995, 2003).select(F.col("id").cast("int").alias("year"))
    return t.nation.select("n_nationkey").distinct().crossJoin(years).join(totals, ["n_nationkey", "year"], "left")


@query("""
SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1
""")
def dedup_keep_first(t: Tables) -> DataFrame:
    return reshape.first_by(t.lineitem, ["l_partkey"], [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("""
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS tier, CASE WHEN p_retailprice > avg(p_retailprice) OVER (PARTITION BY p_brand) THEN NULL ELSE p_retailprice END AS masked FROM part
""")
def case_when_and_mask(t: Tables) -> DataFrame:
    tier = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    high = F.col("p_retailprice") > F.avg("p_retailprice").over(Window.partitionBy("p_brand"))
    return t.part.select("p_partkey", tier.alias("tier"), F.when(~high, F.col("p_retailprice")).alias("masked"))
