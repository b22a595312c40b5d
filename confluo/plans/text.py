"""Functions on strings, codes, dates, JSON and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.functions import text as tx
from confluo.functions.numeric import class_id, clip, distance_bucket, half_open_bin, quality_rank, wrap_longitude
from confluo.plans.registry import Tables, query


@query("""
SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'run') AS slug FROM documents
""")
def slugify_titles(t: Tables) -> DataFrame:
    """A slug of each whole text."""
    return t.documents.select("doc_id", tx.slugify("text").alias("slug"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS code, substr(c_name, 1, 6) AS head, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS nation FROM customer")
def normalise_codes(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", tx.normalise_code(F.concat(F.lit(" "), F.col("c_custkey").cast("double").cast("string"))).alias("code"), F.substring("c_name", 1, 6).alias("head"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("nation"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0.0 WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS amount FROM customer")
def decimal_comma_cast(t: Tables) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 7 == 0, "-").when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")))
    return t.customer.select("c_custkey", tx.decimal_comma(raw, dash_is_zero=True).alias("amount"))


@query("SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS m1, CAST(month(o_orderdate) AS INT) AS m2, CAST(month(o_orderdate) AS INT) AS m3 FROM orders")
def month_parse(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(x) for x in "Janeiro Fevereiro Março Abril Maio Junho Julho Agosto Setembro Outubro Novembro Dezembro".split()])
    m = F.month("o_orderdate")
    return t.orders.select("o_orderkey", tx.month_number(F.concat(F.lit("nuvens "), F.element_at(names, m))).alias("m1"), tx.month_number(F.date_format("o_orderdate", "yyyy-MM")).alias("m2"), tx.month_number(F.concat(F.lit("cloud_"), F.date_format("o_orderdate", "MM"), F.lit("_v2"))).alias("m3"))


@query("SELECT p_partkey, p_size AS size, p_retailprice AS price, p_brand AS brand FROM part")
def fixed_width_parse(t: Tables) -> DataFrame:
    line = F.concat(F.lpad(F.col("p_size").cast("string"), 4, " "), F.lpad(F.col("p_retailprice").cast("string"), 12, " "), F.rpad("p_brand", 12, " "))
    return t.part.select("p_partkey", *tx.fixed_width(line, {"size": (1, 4, "int"), "price": (5, 16, "double"), "brand": (17, 28, "string")}))


@query("SELECT o_orderkey, CAST(o_orderkey % 1000 + 100 AS DOUBLE) + (o_orderkey % 10000) / 10000.0::DOUBLE AS weight FROM orders")
def implied_decimals(t: Tables) -> DataFrame:
    """The operator on the digits of every order, of which three or four are before the point."""
    before = (F.col("o_orderkey") % 1000 + 100).cast("string")
    digits = F.concat(before, F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    return t.orders.select("o_orderkey", F.when(F.length(before) == 4, tx.implied_decimal(digits, 4)).otherwise(tx.implied_decimal(digits)).alias("weight"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, try_cast(json_extract_string(props, '$.ref') AS VARCHAR) AS ref FROM events")
def json_field_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", tx.json_field("props", "$.page").alias("page"), tx.json_field("props", "$.ref").alias("ref"))


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'phosph|nitr') THEN 'nutrients' WHEN regexp_matches(lower(p_name), 'steel|tin|lead|iron|copper') THEN 'metals' ELSE 'other' END AS kind FROM part
""")
def keyword_type_group(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.keyword_type("p_name", {"nutrients": "phosph nitr", "metals": "steel tin lead iron copper"}).alias("kind"))


@query("""
SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '_Q' || quarter(o_orderdate) || '_' || CASE WHEN o_custkey % 10 = 0 THEN '<NA>' ELSE CAST(o_custkey AS VARCHAR) END AS key,
CASE WHEN o_orderkey % 100 > 22 THEN o_orderkey % 100 + 1900 ELSE o_orderkey % 100 + 2000 END AS y, CAST(ceil((year(o_orderdate) - 1990) / 10.0) * 10 + 1990 AS INT) AS decade FROM orders
""")
def period_keys(t: Tables) -> DataFrame:
    unit = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey"))
    return t.orders.select("o_orderkey", tx.period_key(F.year("o_orderdate"), F.quarter("o_orderdate"), unit).alias("key"), tx.two_digit_year(F.col("o_orderkey") % 100).cast("long").alias("y"), tx.decade_bin(F.year("o_orderdate"), 1990).alias("decade"))


@query("SELECT event_id, CAST(ts AS DATE) AS day, date_trunc('minute', ts) AS minute FROM events")
def date_and_time_merge(t: Tables) -> DataFrame:
    return t.events.select("event_id", tx.date_of(F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("string")), F.col("ts").cast("string")).alias("day"), tx.at_time(F.to_date("ts"), F.date_format("ts", "HH:mm")).alias("minute"))


@query("""
SELECT p_partkey, CASE WHEN p_retailprice <= 10 THEN '0_10km' WHEN p_retailprice <= 50 THEN '10_50km' WHEN p_retailprice <= 100 THEN '50_100km' WHEN p_retailprice <= 250 THEN '100_250km' WHEN p_retailprice <= 500 THEN '250_500km' ELSE '500km_plus' END AS bucket,
CAST(least(floor(p_retailprice / 50), 20) AS BIGINT) AS bin, CASE WHEN p_retailprice > 180 THEN p_retailprice - 360 ELSE p_retailprice END AS lon, least(greatest(p_retailprice, 950), 1500) AS clipped, p_size * 10 + CAST(p_partkey % 10 AS INT) AS class_id FROM part
""")
def buckets_and_bins(t: Tables) -> DataFrame:
    x = "p_retailprice"
    return t.part.select("p_partkey", distance_bucket(x).alias("bucket"), half_open_bin(x, 50, 21).alias("bin"), wrap_longitude(x).alias("lon"), clip(x, 950.0, 1500.0).alias("clipped"), class_id("p_size", F.col("p_partkey") % 10).alias("class_id"))


@query("SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 1000 WHEN 1 THEN 100 WHEN 2 THEN 997 ELSE 0 END AS DOUBLE) AS rank FROM events")
def quality_ranks(t: Tables) -> DataFrame:
    flags = F.array(*[F.lit(x) for x in (" Consistido ", "review", "2", "unknown")], F.lit(None).cast("string"))
    return t.events.select("event_id", quality_rank(F.element_at(flags, (F.col("event_id") % 5 + 1).cast("int"))).alias("rank"))


@query("""
SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS INT) AS n_links, regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*["'']([^"'']*)["'']', 1)[1] AS first_link FROM pages
""")
def link_targets(t: Tables) -> DataFrame:
    found = tx.links("html")
    return t.pages.select("page_id", F.size(found).alias("n_links"), F.try_element_at(found, F.lit(1)).alias("first_link"))
