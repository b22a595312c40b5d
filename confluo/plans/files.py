"""Sources and sinks: tables written to the shared folder in each format and read back, and choices among columns and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.functions import text as tx
from confluo.operators import guards, panel, reshape
from confluo.plans.registry import Tables, query
from confluo.session import ensure_checkpoint_dir
from confluo.sources import files
from confluo.streaming.ingest import ingest


def _folder(t: Tables) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/files-{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def feather_round_trip(t: Tables) -> DataFrame:
    folder = _folder(t)
    files.write_feather(t.part.select("p_partkey", "p_name", "p_size", "p_retailprice"), folder)
    return files.read_feather(t.spark, f"{folder}/*.feather")


@query("SELECT c_custkey, c_name || ' ção; \"' || c_mktsegment || '\"' AS label, c_acctbal FROM customer")
def csv_latin1_round_trip(t: Tables) -> DataFrame:
    folder = _folder(t)
    label = F.concat("c_name", F.lit(' ção; "'), "c_mktsegment", F.lit('"'))
    t.customer.select("c_custkey", label.alias("label"), "c_acctbal").write.csv(folder, sep=";", header=True, encoding="ISO-8859-1", escape='"')
    return files.read_csv_latin1(t.spark, folder, escape='"').select(F.col("c_custkey").cast("long").alias("c_custkey"), "label", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def xml_rows(t: Tables) -> DataFrame:
    folder = _folder(t)
    t.nation.write.format("xml").option("rowTag", "Table").option("rootTag", "DataSet").save(folder)
    rows = files.read_xml_rows(t.spark, folder)
    return rows.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


def _zips(t: Tables) -> str:
    folder = _folder(t)
    files.write_zipped_tables(t.supplier.select("s_nationkey", "s_suppkey", "s_name", "s_acctbal"), folder, "s_nationkey", "table.csv")
    return folder


@query("SELECT s_suppkey, s_name, s_acctbal, CAST(s_nationkey AS VARCHAR) || '_data.zip' AS source_archive_name, 'table.csv' AS source_table_name FROM supplier")
def zipped_tables(t: Tables) -> DataFrame:
    rows = files.read_zipped_tables(t.spark, _zips(t), ["s_suppkey", "s_name", "s_acctbal"])
    return rows.withColumns({"s_suppkey": F.col("s_suppkey").cast("long"), "s_acctbal": F.col("s_acctbal").cast("double")})


@query("SELECT DISTINCT CAST(s_nationkey AS VARCHAR) || '_data.zip' AS filename, CAST(s_nationkey AS VARCHAR) AS station_code, true AS valid FROM supplier")
def archive_listing(t: Tables) -> DataFrame:
    return files.list_archives(t.spark, _zips(t)).select("filename", "station_code", "valid")


@query("SELECT r_regionkey AS key, r_name AS name, CAST(NULL AS DOUBLE) AS balance FROM region UNION ALL SELECT n_nationkey, NULL, round(avg(c_acctbal) + 1e-7, 4) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def evolving_append(t: Tables) -> DataFrame:
    folder = _folder(t)
    files.append_evolving(t.region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), folder)
    files.append_evolving(t.customer.groupBy(F.col("c_nationkey").alias("key")).agg(F.round(F.avg("c_acctbal") + 1e-7, 4).alias("balance")), folder)
    return files.read_evolving(t.spark, folder)


@query("SELECT o_custkey, list_sort(list(o_orderkey)) AS keys, count(*) AS n FROM orders GROUP BY 1")
def json_columns_round_trip(t: Tables) -> DataFrame:
    folder = _folder(t)
    lists = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"), F.count("*").alias("n"))
    files.encode_lists(lists).write.parquet(folder)
    return files.decode_lists(t.spark.read.parquet(folder))


@query("SELECT 'keys' AS name, true AS stored_as_text UNION ALL SELECT 'n', false UNION ALL SELECT 'o_custkey', false")
def column_metadata(t: Tables) -> DataFrame:
    """Which columns of a stored table hold JSON, by the metadata that is stored with it."""
    folder = _folder(t)
    files.encode_lists(t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("keys"), F.count("*").alias("n"))).write.parquet(folder)
    return t.spark.createDataFrame([(f.name, "json_of" in f.metadata) for f in t.spark.read.parquet(folder).schema], "name string, stored_as_text boolean")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def table_replace(t: Tables) -> DataFrame:
    folder = _folder(t)
    for df, key, name in ((t.region, "r_regionkey", "r_name"), (t.nation, "n_nationkey", "n_name")):
        df.select(F.col(key).alias("key"), F.col(name).alias("name")).write.mode("overwrite").parquet(folder)
    return t.spark.read.parquet(folder)


@query("SELECT r_regionkey, r_name FROM region")
def first_available_table(t: Tables) -> DataFrame:
    name = f"confluo_{uuid.uuid4().hex}"
    t.region.select("r_regionkey", "r_name").createOrReplaceTempView(name)
    return guards.first_table(t.spark, [f"{name}_absent", name])


@query("SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS value FROM lineitem GROUP BY ALL")
def matrix_market_round_trip(t: Tables) -> DataFrame:
    folder = _folder(t)
    files.write_matrix_market(t.lineitem.groupBy(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("value")), folder, 1, 1)
    return files.read_matrix_market_parts(t.spark, folder)


@query("SELECT c_custkey, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer")
def geometry_binary_round_trip(t: Tables) -> DataFrame:
    """Points as well-known binary in Parquet."""
    folder = _folder(t)
    t.customer.select("c_custkey", files.wkb_points(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("geometry")).write.parquet(folder)
    return t.spark.read.parquet(folder).select("c_custkey", files.points_of_wkb(F.col("geometry")).alias("p")).select("c_custkey", "p.x", "p.y")


@query("SELECT s_suppkey, s_acctbal AS x0, CAST(s_nationkey AS DOUBLE) AS y0, s_acctbal + 8 AS x1, s_nationkey + 4.0::DOUBLE AS y1, 30.0::DOUBLE AS area, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y, 5.0::DOUBLE AS length FROM supplier")
def geometry_text_round_trip(t: Tables) -> DataFrame:
    """Boxes of 8 by 4 with a hole of 2 by 1, points and lines as text in Parquet."""
    folder = _folder(t)
    x, y = F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    at = lambda a, b: F.array(x + a, y + b)
    box = lambda a, b, c, d: F.array(at(a, b), at(c, b), at(c, d), at(a, d), at(a, b))
    line = F.concat(F.lit("LINESTRING (0 0, 3 4)"))
    rows = t.supplier.select("s_suppkey", files.polygon_wkt(F.array(box(0, 0, 8, 4), box(1, 1, 3, 2))).alias("area"), "s_acctbal", y.alias("n"))
    rows.select("s_suppkey", "area", files.point_wkt("s_acctbal", "n").alias("point"), line.alias("line")).write.parquet(folder)
    px, py = files.parse_point("point")
    got = t.spark.read.parquet(folder).select("s_suppkey", files.polygon_bounds("area").alias("b"), F.round(files.polygon_area("area"), 6).alias("area"), px.alias("x"), py.alias("y"), files.line_length("line").alias("length"))
    return got.select("s_suppkey", "b.*", "area", "x", "y", "length")


@query("SELECT event_id, user_id, value FROM events")
def stream_ingest(t: Tables) -> DataFrame:
    """What arrives in a folder, appended to a table by a stream."""
    folder = _folder(t)
    t.events.select("event_id", "user_id", "value").write.parquet(f"{folder}/in")
    ingest(t.spark, f"{folder}/in", "event_id long, user_id long, value double", f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "value")


@query("SELECT count(*) AS orders, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders")
def run_summary(t: Tables) -> DataFrame:
    path = _folder(t)
    row = t.orders.agg(F.count("*").alias("orders"), F.sum("o_custkey").alias("keys")).first()
    files.write_summary(path, row.asDict())
    return t.spark.read.json(path, multiLine=True, schema="orders long, keys long")


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS lc_a FROM supplier")
def known_columns_renamed(t: Tables) -> DataFrame:
    """Columns renamed as far as they are there, the first present of two, and those of a prefix."""
    df = reshape.rename_known(t.supplier, {"s_suppkey": "id", "s_name": "name", "s_acctbal": "lc_a", "absent": "x"})
    first = guards.first_present(["code", "id"], df.columns)
    return df.select(first, "name", *guards.with_prefix(df, "lc_"))


@query("""
SELECT 'value' AS name, count(CASE WHEN event_type <> 'click' THEN value END) * 2 > count(*) AS dense, count(DISTINCT CASE WHEN event_type <> 'click' THEN value END) > 1 AS varied FROM events
UNION ALL SELECT 'few', count(CASE WHEN event_type = 'click' THEN value END) * 2 > count(*), count(DISTINCT CASE WHEN event_type = 'click' THEN value END) > 1 FROM events UNION ALL SELECT 'same', true, false
""")
def column_checks(t: Tables) -> DataFrame:
    """Whether columns are mostly there, and whether they vary."""
    click = F.col("event_type") == "click"
    df = t.events.select(F.when(~click, F.col("value")).alias("value"), F.when(click, F.col("value")).alias("few"), F.lit(1).alias("same"))
    dense = guards.dense_columns(df)
    return t.spark.createDataFrame([(c, c in dense, guards.varies(df, c)) for c in df.columns], "name string, dense boolean, varied boolean")


@query("SELECT unnest(['c_acctbal', 'c_custkey', 'c_nationkey']) AS name")
def measurement_columns(t: Tables) -> DataFrame:
    """Columns in which some value is a number."""
    return t.spark.createDataFrame([(c,) for c in guards.numeric_columns(t.customer)], "name string")


@query("""
SELECT c_custkey, coalesce(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'cars' WHEN 'MACHINERY' THEN 'tools' END, 'other') AS kind, CASE WHEN c_nationkey = c_custkey % 25 THEN [c_nationkey] ELSE [c_nationkey, CAST(c_custkey % 25 AS INT)] END AS codes FROM customer
""")
def map_lookup(t: Tables) -> DataFrame:
    """Labels by a small table, and the different ones of some columns in order."""
    codes = tx.ordered_unique(["c_nationkey", (F.col("c_custkey") % 25).cast("int"), F.lit(None).cast("int"), "c_nationkey"])
    return t.customer.select("c_custkey", tx.lookup("c_mktsegment", {"AUTOMOBILE": "cars", "MACHINERY": "tools"}, "other").alias("kind"), codes.alias("codes"))


@query("""
SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1997 THEN o_custkey * 100000 + o_orderkey % 1000 ELSE o_orderkey % 1000 END AS municipality,
CASE WHEN o_custkey % 3 > 0 THEN nullif(o_orderkey % 1000, 0) END AS from_municipality, CASE o_custkey % 4 WHEN 1 THEN 'white' WHEN 2 THEN 'black' ELSE 'not stated' END AS race FROM orders
""")
def census_rows(t: Tables) -> DataFrame:
    """Municipality codes, those that people came from, and labels of coded answers."""
    o = t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("state"), (F.col("o_orderkey") % 1000).alias("municipality"), F.when(F.year("o_orderdate") == 1997, 2010).otherwise(2000).alias("year"),
        F.when(F.col("o_custkey") % 3 == 0, 9_999_999).otherwise(F.col("o_orderkey") % 1000).alias("from_code"), (F.col("o_custkey") % 4).alias("race_code"),
    )
    return panel.census_rows(o, labels={"race_code": ("race", {1: "white", 2: "black"}, "not stated")}, came_from={"from_code": "from_municipality"}).select("o_orderkey", "municipality", "from_municipality", "race")

