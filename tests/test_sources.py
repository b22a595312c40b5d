"""Readers, writers and the folder stream."""

import zipfile

import pytest
from pyspark.sql import functions as F

from confluo.operators.matching import pending_stations
from confluo.sources import files
from confluo.streaming.ingest import ingest


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("nome;v\nSão;1,5\n".encode("latin-1"))
    assert files.read_csv_latin1(spark, str(tmp_path / "a.csv")).first().nome == "São"
    (tmp_path / "a.xml").write_text("<r><Table><a>1</a></Table><Table><a>2</a></Table></r>")
    assert files.read_xml_rows(spark, str(tmp_path / "a.xml")).count() == 2
    (tmp_path / "f.txt").write_text("12ab 7\n3 \n")
    got = [tuple(r) for r in files.read_fixed_width(spark, str(tmp_path / "f.txt"), {"n": (1, 2, "int"), "s": (3, 4, "string"), "k": (5, 6, "int")}).collect()]
    assert sorted(got, key=str) == sorted([(12, "ab", 7), (3, None, None)], key=str)
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n3 3 2\n1 2 0.5\n3 1 2\n")
    assert sorted(map(tuple, files.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect())) == [(1, 2, 0.5), (3, 1, 2.0)]


def test_feather(spark, tmp_path):
    df = spark.range(100).withColumn("s", F.col("id").cast("string")).repartition(3)
    files.write_feather(df, str(tmp_path / "f"))
    assert sorted(files.read_feather(spark, str(tmp_path / "f/*.feather")).collect()) == sorted(df.collect())
    with pytest.raises(FileNotFoundError):
        files.read_feather(spark, str(tmp_path / "none/*"))


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "12_a.zip", "w") as z:
        z.writestr("t.csv", "a;b\n1;x\n2;y\n")
        z.writestr("readme.md", "no")
    (tmp_path / "13_b.zip").write_bytes(b"broken but long enough to be a file")
    with zipfile.ZipFile(tmp_path / "14_c.zip", "w"):
        pass
    listed = {r.filename: (r.station_code, r.valid) for r in files.list_archives(spark, str(tmp_path)).collect()}
    assert listed == {"12_a.zip": ("12", True), "13_b.zip": ("13", True), "14_c.zip": ("14", False)}
    rows = files.read_zipped_tables(spark, str(tmp_path), ["a", "b"]).collect()
    assert sorted((r.a, r.b, r.source_archive_name, r.source_table_name) for r in rows) == [("1", "x", "12_a.zip", "t.csv"), ("2", "y", "12_a.zip", "t.csv")]


def test_evolution_json_and_wkt(spark, tmp_path):
    path = str(tmp_path / "t")
    files.append_evolving(spark.createDataFrame([(1, "a")], "k int, s string"), path)
    files.append_evolving(spark.createDataFrame([(2, 3.5)], "k int, x double"), path)
    assert sorted((r.k, r.s, r.x) for r in files.read_evolving(spark, path).collect()) == [(1, "a", None), (2, None, 3.5)]
    nested = spark.createDataFrame([([1, 2], {"a": 1}, 1), (None, None, 2)], "l array<int>, m map<string,int>, k int")
    coded = files.encode_lists(nested)
    assert dict(coded.dtypes) == {"l": "string", "m": "string", "k": "int"} and files.decode_lists(coded).collect() == nested.collect()
    p = spark.createDataFrame([(1.5, -2.0)], "x double, y double").select(files.point_wkt("x", "y").alias("w"))
    assert tuple(p.select(*files.parse_point("w")).first()) == (1.5, -2.0)
    lines = spark.createDataFrame([("LINESTRING (0 0, 3 4, 3 5)",), ("POINT (1 2)",)], "w string").select(files.line_length("w"))
    assert [r[0] for r in lines.collect()] == [6.0, None]


def test_pending_modes(spark):
    stations = spark.createDataFrame([(k,) for k in range(1, 6)], "station_code int")
    history = spark.createDataFrame([(1, True), (2, False), (3, False), (3, True)], "station_code int, success boolean")
    archives = spark.createDataFrame([("4_x.zip",), ("x_5.zip",)], "filename string")
    ask = lambda mode, h=history: sorted(r.station_code for r in pending_stations(stations, h, archives, mode).collect())
    assert ask("default") == ["2", "5"] and ask("missing-only") == ["5"] and ask("retry-failed") == ["2"] and len(ask("redownload-all")) == 5
    assert ask("default", None) == ["1", "2", "3", "5"] and ask("retry-failed", None) == []
    with pytest.raises(ValueError):
        ask("odd")


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).repartition(4).write.parquet(src)
    run = lambda: ingest(spark, src, "id long", out, str(tmp_path / "cp"), lambda d: d.where("id % 2 = 0"), files_at_once=2).awaitTermination()
    run()
    spark.range(10, 14).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(out)
    assert sorted(r.id for r in got.collect()) == [0, 2, 4, 6, 8, 10, 12] and got.select("batch").distinct().count() >= 2
