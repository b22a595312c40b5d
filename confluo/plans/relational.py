"""Grouping, windows, ordering and reshaping on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from confluo.functions.numeric import half_open_bin, ratio, row_mean
from confluo.operators import reshape, windows
from confluo.operators.profile import variable_profile, weighted_mean, weighted_share
from confluo.plans.registry import Tables, query

FLAGS = ("A", "N", "R")


def events_ordered() -> tuple[str, ...]:
    return ("ts", "event_id")


@query("""
SELECT l_partkey AS trench_id, CAST(year(l_shipdate) AS INT) AS year, round(sum(l_quantity), 6) AS land_cover_total,
round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 6) AS class_a, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0), 6) AS class_n, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), 6) AS class_r
FROM lineitem GROUP BY ALL
""")
def land_cover_trench_year_sum(t: Tables) -> DataFrame:
    wide = reshape.pivot_sum(t.lineitem.select(F.col("l_partkey").alias("trench_id"), F.year("l_shipdate").alias("year"), "l_returnflag", "l_quantity"), ["trench_id", "year"], "l_returnflag", "l_quantity", FLAGS)
    total = sum((F.col(f) for f in FLAGS), F.lit(0.0))
    return wide.select("trench_id", "year", F.round(total, 6).alias("land_cover_total"), *[F.round(f, 6).alias(f"class_{f.lower()}") for f in FLAGS])


@query("""
SELECT l_returnflag, count(*) AS n, count(l_discount) AS n_discount, count(DISTINCT l_partkey) AS n_parts, round(sum(l_quantity), 4) AS total, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean,
round(stddev_samp(l_quantity), 6) AS std, round(sum(l_extendedprice) FILTER (l_discount > 0.05), 2) AS discounted
FROM lineitem GROUP BY l_returnflag
""")
def group_aggregates(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count("l_discount").alias("n_discount"), F.countDistinct("l_partkey").alias("n_parts"), F.round(F.sum(q), 4).alias("total"), F.min(q).alias("least"), F.max(q).alias("most"),
        F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_samp(q), 6).alias("std"), F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))), 2).alias("discounted"),
    )


@query("""
WITH p AS (SELECT event_type AS variable, count(value) AS n, count(DISTINCT user_id) AS n_sensors, min(value) AS lo, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.99) AS p99,
max(value) AS hi, avg(value) AS mean, stddev_samp(value) AS std, skewness(value) AS skew, avg(CAST(coalesce(value = 0, false) AS DOUBLE)) AS z, avg(CAST(coalesce(value < 0, false) AS DOUBLE)) AS neg FROM events GROUP BY 1)
SELECT variable, n, n_sensors, round(lo, 6) AS min, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(p99, 6) AS p99, round(hi, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std, round(skew, 6) AS skew,
round(z, 6) AS share_zero, round(neg, 6) AS share_negative, round(q3 - q1, 6) AS iqr, round(q3 + 3 * (q3 - q1), 6) AS upper_iqr FROM p
""")
def variable_profile_by_event(t: Tables) -> DataFrame:
    p = variable_profile(t.events.select(F.col("event_type").alias("variable"), "value", F.col("user_id").alias("station_code")))
    kinds = dict(p.dtypes)
    return p.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in p.columns])


@query("""
SELECT l_shipdate_year AS year, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 6) AS mean_price, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 6) AS returned_share
FROM (SELECT *, CAST(year(l_shipdate) AS INT) AS l_shipdate_year FROM lineitem) GROUP BY 1
""")
def weighted_predicate_share(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(
        F.round(weighted_mean("l_extendedprice", "l_quantity"), 6).alias("mean_price"), F.round(weighted_share(F.col("l_returnflag") == "R", "l_quantity"), 6).alias("returned_share")
    )


@query("""
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean_7, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND CURRENT ROW), 6) AS mean_31 FROM events
""")
def rolling_mean_7_31_rows(t: Tables) -> DataFrame:
    w = windows.over("user_id", events_ordered())
    return t.events.select("event_id", *[F.round(windows.rolling_mean("value", w, k), 6).alias(f"mean_{k}") for k in (7, 31)])


@query("""
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY ALL)
SELECT o_custkey, year, CASE WHEN count(total) OVER w = 5 THEN round(sum(total) OVER w, 4) END AS total_5 FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""")
def rolling_sum_5_full(t: Tables) -> DataFrame:
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 4).alias("total"))
    return y.select("o_custkey", "year", F.round(windows.rolling_sum_full("total", windows.over("o_custkey", "year"), 5), 4).alias("total_5"))


@query("""
WITH v AS (SELECT event_id, user_id, ts, CAST(floor(value / 40) AS BIGINT) AS level FROM events),
b AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY user_id ORDER BY ts, event_id) = level THEN 0 ELSE 1 END AS fresh FROM v),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT event_id, CAST(run AS BIGINT) AS run_id, count(*) OVER (PARTITION BY user_id, run) AS run_length FROM r
""")
def constant_run_length(t: Tables) -> DataFrame:
    level = t.events.select("event_id", "user_id", "ts", F.floor(F.col("value") / 40).cast("long").alias("level"))
    return windows.run_lengths(level, "user_id", events_ordered(), "level").select("event_id", F.col("run_id").cast("long").alias("run_id"), "run_length")


@query("""
WITH s AS (SELECT n_regionkey AS region, CAST(year(o_orderdate) AS INT) AS year, n_nationkey AS nation, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
h AS (SELECT *, v / sum(v) OVER (PARTITION BY region, year) AS share FROM s)
SELECT nation, year, round(share, 6) AS share, round(share - lag(share) OVER (PARTITION BY nation ORDER BY year), 6) AS change FROM h
""")
def lag_difference_shares(t: Tables) -> DataFrame:
    s = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_regionkey").alias("region"), F.year("o_orderdate").alias("year"), F.col("n_nationkey").alias("nation")).agg(F.sum("o_totalprice").alias("v"))
    )
    h = s.withColumn("share", ratio("v", F.sum("v").over(Window.partitionBy("region", "year"))))
    return h.select("nation", "year", F.round("share", 6).alias("share"), F.round(windows.difference("share", windows.over("nation", "year")), 6).alias("change"))


@query("""
SELECT event_id, round(avg(CASE WHEN event_type <> 'click' THEN value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-8, 4) AS mean_so_far FROM events
""")
def cummean_ignore_na(t: Tables) -> DataFrame:
    value = F.when(F.col("event_type") != "click", F.col("value"))
    return t.events.select("event_id", F.round(windows.cumulative_mean(value, windows.over("user_id", events_ordered())) + 1e-8, 4).alias("mean_so_far"))


@query("""
WITH b AS (SELECT user_id % 50 AS station, CAST(floor(value / 50) AS BIGINT) AS bin, CAST(hour(ts) AS INT) AS year, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL)
SELECT station, bin, year, round(sum(v) OVER (PARTITION BY station, bin ORDER BY year ROWS UNBOUNDED PRECEDING), 4) AS over_years, round(sum(v) OVER (PARTITION BY station, year ORDER BY bin ROWS UNBOUNDED PRECEDING), 4) AS over_bins FROM b
""")
def cumsum_two_way(t: Tables) -> DataFrame:
    b = t.events.groupBy((F.col("user_id") % 50).alias("station"), half_open_bin("value", 50).alias("bin"), F.hour("ts").alias("year")).agg(F.round(F.sum("value"), 4).alias("v"))
    return b.select(
        "station", "bin", "year", F.round(windows.cumulative_sum("v", windows.over(["station", "bin"], "year")), 4).alias("over_years"), F.round(windows.cumulative_sum("v", windows.over(["station", "year"], "bin")), 4).alias("over_bins")
    )


@query("""
SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS z FROM orders
""", "zscore")
def _zscore(t: Tables) -> DataFrame:
    return windows.zscore(t.orders, "o_totalprice", "z").select("o_orderkey", F.round("z", 6).alias("z"))


@query("""
WITH a AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey) AS d FROM orders)
SELECT o_orderkey, round(d - avg(d) OVER (PARTITION BY year), 4) AS d FROM a
""")
def two_way_demean(t: Tables) -> DataFrame:
    a = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), windows.demean("o_totalprice", ["o_custkey"]).alias("d"))
    return a.select("o_orderkey", F.round(windows.demean("d", ["year"]), 4).alias("d"))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events
""")
def forward_fill_last(t: Tables) -> DataFrame:
    return t.events.select("event_id", windows.forward_fill(F.when(F.col("event_type") == "purchase", F.col("value")), windows.over("user_id", events_ordered())).alias("last_purchase"))


@query("""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_id, abs(value - m) > 1.5 * (b - a) AS outlier FROM events JOIN q USING (event_type)
""")
def outlier_in_group(t: Tables) -> DataFrame:
    return t.events.select("event_id", windows.outlier("value", ["event_type"]).alias("outlier"))


@query("""
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS p FROM orders GROUP BY ALL)
SELECT o_custkey, year, coalesce(min(CASE WHEN p > 0 THEN year END) OVER (PARTITION BY o_custkey), 0) AS first_year FROM y
""")
def first_event_year(t: Tables) -> DataFrame:
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    return y.select("o_custkey", "year", windows.first_event("year", "p", ["o_custkey"]).alias("first_year"))


@query("""
WITH k AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, ['low', 'medium', 'high'][CAST(floor(r * 3 / n) AS INT) + 1] AS third FROM k
""")
def quantile_split_sample(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", windows.rank_thirds(windows.over("p_brand", ["p_retailprice", "p_partkey"]), ["p_brand"]).alias("third"))


@query("""
SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(CASE WHEN event_type = 'purchase' AND value <> 0 THEN 1 ELSE 0 END) = 1)
""")
def group_all_zero_filter(t: Tables) -> DataFrame:
    marked = t.events.withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return windows.keep_groups(marked, ["user_id"], F.max(F.coalesce(F.col("v") != 0, F.lit(False)))).select("event_id")


@query("""
SELECT user_id, CAST(year(ts) AS INT) AS year, round(avg(value), 6) AS value FROM events GROUP BY ALL
""")
def annual_resample_mean(t: Tables) -> DataFrame:
    from confluo.operators.panel import period_mean

    return period_mean(t.events, "user_id", "ts", "value").withColumn("value", F.round("value", 6))


@query("""
SELECT l_partkey, arg_max(l_suppkey, l_extendedprice * 1000000 - l_orderkey) AS main_supplier, list_sort(list_distinct(list(l_linenumber))) AS lines, count(*) AS n FROM lineitem GROUP BY 1
""")
def argmax_assignment(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.max_by("l_suppkey", F.col("l_extendedprice") * 1000000 - F.col("l_orderkey")).alias("main_supplier"), F.sort_array(F.collect_set("l_linenumber")).alias("lines"), F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 9")
def top_k_stations(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(9)


@query("""
SELECT CAST(floor(value / 25) AS BIGINT) AS bin, count(*) AS n, round(corr(value, user_id), 6) AS r FROM events GROUP BY 1 HAVING count(*) > 5
""")
def corr_by_bin(t: Tables) -> DataFrame:
    return t.events.groupBy(half_open_bin("value", 25).alias("bin")).agg(F.count("*").alias("n"), F.round(F.corr("value", "user_id"), 6).alias("r")).where("n > 5")


@query("""
SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY ALL
""")
def ols_slope_by_group(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"))


@query("""
SELECT n_name, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS o, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS p
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def label_pivot(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    wide = reshape.pivot_sum(j.select("n_name", "o_orderstatus", F.lit(1).cast("long").alias("n")), ["n_name"], "o_orderstatus", "n", ["F", "O", "P"])
    return wide.select("n_name", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("""
SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR variable IN (l_quantity, l_discount, l_tax))
""")
def melt_measurements(t: Tables) -> DataFrame:
    return reshape.melt(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("""
SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer
""")
def union_by_name_evolve(t: Tables) -> DataFrame:
    a = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = t.customer.select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return reshape.union_all([a, b]).select("id", "name", "balance", "segment")


@query("""
WITH g AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k, list(o_totalprice ORDER BY o_orderkey) AS v FROM orders GROUP BY 1) SELECT o_custkey, unnest(k) AS order_id, unnest(v) AS price FROM g
""")
def explode_zip_lists(t: Tables) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice")))
    g = t.orders.groupBy("o_custkey").agg(pairs.alias("p")).select("o_custkey", F.col("p.o_orderkey").alias("order_id"), F.col("p.o_totalprice").alias("price"))
    return reshape.explode_lists(g, ["order_id", "price"])


@query("""
WITH k AS (SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier) SELECT id, id NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AS never_negative FROM k
""")
def node_union_and_difference(t: Tables) -> DataFrame:
    ids = t.customer.select(F.col("c_nationkey").alias("id")).union(t.supplier.select("s_nationkey")).distinct()
    negative = t.supplier.where("s_acctbal < 0").select(F.col("s_nationkey").alias("id")).distinct().withColumn("neg", F.lit(True))
    return ids.join(negative, "id", "left").select("id", F.col("neg").isNull().alias("never_negative"))


@query("""
SELECT o_orderkey, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 6) AS index_value
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS a, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS DOUBLE) END AS b, CASE WHEN o_orderkey % 5 = 0 THEN 1.0::DOUBLE END AS c FROM orders)
""")
def row_mean_index(t: Tables) -> DataFrame:
    cols = [F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")), F.when(F.col("o_orderkey") % 5 == 0, 1.0)]
    return t.orders.select("o_orderkey", F.round(row_mean(cols), 6).alias("index_value"))
