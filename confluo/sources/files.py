"""Readers and writers of files that Spark has no format for, or that need a fixed way to be read."""

from __future__ import annotations

import fnmatch
import io
import json
import os
import struct
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.functions.text import fixed_width


def read_csv_latin1(spark: SparkSession, path: str, sep: str = ";", **options: str) -> DataFrame:
    """Delimited text in Latin-1 with a header; all columns are text, to be cast by the caller."""
    return spark.read.csv(path, sep=sep, encoding="ISO-8859-1", header=True, **options)


def read_xml_rows(spark: SparkSession, path: str, tag: str = "Table") -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).load(path)


def read_fixed_width(spark: SparkSession, path: str, layout: Mapping[str, tuple[int, int, str]], encoding: str = "ISO-8859-1") -> DataFrame:
    """Fields by 1-based first and last place and type; lines are split among tasks."""
    lines = spark.read.option("encoding", encoding).csv(path, sep="\u0001", quote="", schema="line string", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return lines.select(*fixed_width("line", layout))


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (or of a URI such as hdfs://, s3:// or file:) and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files of a folder that match ``path``, as in ``folder/*.feather``, one task each; only the schema of the first is read here."""
    folder, pattern = path.rsplit("/", 1)
    system, root = open_folder(folder)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))
    if not files:
        raise FileNotFoundError(path)
    with system.open_input_file(files[0]) as f:
        schema = spark.createDataFrame(pa.ipc.open_file(f).schema.empty_table()).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, _ = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with there.open_input_file(name) as f:
                    reader = pa.ipc.open_file(f)
                    for k in range(reader.num_record_batches):
                        yield reader.get_batch(k)

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files), "file").mapInArrow(read, schema)


def write_feather(df: DataFrame, folder: str) -> None:
    """One Arrow IPC file a partition, batch by batch, under a name of its own until it is whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name, out, writer = f"{root}/.part-{part:05d}.{attempt}", None, None
        for batch in batches:
            if writer is None:
                out = system.open_output_stream(name)
                writer = pa.ipc.new_file(out, batch.schema)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
            out.close()
            system.move(name, f"{root}/part-{part:05d}.feather")
        yield from ()

    df.mapInArrow(write, "done int").count()


def write_zipped_tables(df: DataFrame, folder: str, by: str, member: str, sep: str = ";") -> None:
    """A zip file ``<by>_data.zip`` for each value of ``by``, with the value's other columns as delimited Latin-1 text. The rows of a value are held as a whole."""
    import csv

    columns = [c for c in df.columns if c != by]

    def write(frame: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        text = io.StringIO()
        out = csv.writer(text, delimiter=sep)
        out.writerow(columns)
        out.writerows(zip(*(frame[c].to_pylist() for c in columns)))
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(member, text.getvalue().encode("iso-8859-1"))
        value = frame[by][0].as_py()
        name = f"{root}/.{value}.{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(name) as f:
            f.write(packed.getvalue())
        system.move(name, f"{root}/{value}_data.zip")
        return pa.table({"done": pa.array([1], pa.int32())})

    df.groupBy(by).applyInArrow(write, "done int").count()


def list_archives(spark: SparkSession, folder: str, least_bytes: int = 23) -> DataFrame:
    """Zip files of a folder: ``path``, ``filename``, ``bytes``, ``station_code`` and whether each has more than an empty archive. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("filename"), "bytes", F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit("")).alias("station_code"), (F.col("bytes") >= least_bytes).alias("valid"))


def read_zipped_tables(spark: SparkSession, folder: str, columns: Sequence[str], suffix: str = ".csv", sep: str = ";") -> DataFrame:
    """Rows of all delimited members of the zip files of a folder, as text, with the archive and member that each is from. Archives that can't be read give none."""
    import csv

    names = [*columns, "source_archive_name", "source_table_name"]
    schema = pa.schema([(c, pa.string()) for c in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content.as_py()))
                except zipfile.BadZipFile:
                    continue
                for member in sorted(n for n in z.namelist() if n.lower().endswith(suffix)):
                    rows = list(csv.DictReader(io.TextIOWrapper(z.open(member), "iso-8859-1"), delimiter=sep))
                    if rows:
                        cols = [[r.get(c) for r in rows] for c in columns] + [[path.rsplit("/", 1)[-1]] * len(rows), [member] * len(rows)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")
    return files.mapInArrow(read, ", ".join(f"`{c}` string" for c in names))


def append_evolving(df: DataFrame, path: str) -> None:
    """Append rows by column name; columns that either side lacks are null there. Read with :func:`read_evolving`."""
    df.write.mode("append").parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def encode_lists(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which any store keeps; their types go into the metadata of the columns."""
    nested = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    return df.select(*[F.to_json(c).alias(c, metadata={"json_of": nested[c].json()}) if c in nested else F.col(c) for c in df.columns])


def decode_lists(df: DataFrame) -> DataFrame:
    """What :func:`encode_lists` made, as it was."""
    kinds = {f.name: T._parse_datatype_json_string(f.metadata["json_of"]) for f in df.schema if "json_of" in f.metadata}
    return df.select(*[F.from_json(c, kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def point_wkt(x: str, y: str) -> Column:
    return F.concat(F.lit("POINT ("), F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"), F.lit(")"))


def parse_point(c: str) -> tuple[Column, Column]:
    """Both coordinates of ``POINT (x y)``; null where the text is none."""
    part = lambda k: F.nullif(F.regexp_extract(F.col(c), r"(?i)^\s*POINT\s*\(\s*([-+\d.eE]+)\s+([-+\d.eE]+)\s*\)\s*$", k), F.lit("")).try_cast("double")
    return part(1), part(2)


def line_length(c: str) -> Column:
    """Length of a ``LINESTRING``, in the units of its coordinates; null where the text is none."""
    inner = F.nullif(F.regexp_extract(F.col(c), r"(?i)^\s*LINESTRING\s*\(([^()]*)\)\s*$", 1), F.lit(""))
    points = F.transform(F.split(F.trim(inner), r"\s*,\s*"), lambda p: F.transform(F.split(p, r"\s+"), lambda z: z.try_cast("double")))
    step = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: F.hypot(a[0] - b[0], a[1] - b[1]))
    return F.when(inner.isNotNull(), F.aggregate(step, F.lit(0.0), lambda s, x: s + x))


def polygon_rings(c: str) -> Column:
    """The rings of a ``POLYGON`` as arrays of points (arrays of two numbers), the outer one first; null where the text is none."""
    inner = F.nullif(F.regexp_extract(F.col(c), r"(?i)^\s*POLYGON\s*\(\s*(\(.*\))\s*\)\s*$", 1), F.lit(""))
    rings = F.split(F.regexp_replace(inner, r"^\(|\)$", ""), r"\)\s*,\s*\(")
    return F.transform(rings, lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*"), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda z: z.try_cast("double"))))


def polygon_area(c: str) -> Column:
    """Area of a ``POLYGON`` less its holes, in squares of the units of its coordinates."""
    def area(r: Column) -> Column:
        ahead = F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
        return F.abs(F.aggregate(F.zip_with(r, ahead, lambda a, b: a[0] * b[1] - b[0] * a[1]), F.lit(0.0), lambda s, x: s + x)) / 2

    sizes = F.transform(polygon_rings(c), area)
    return F.aggregate(F.slice(sizes, 2, F.size(sizes)), sizes[0], lambda s, x: s - x)


def polygon_bounds(c: str) -> Column:
    """A struct of the least and largest coordinates of a ``POLYGON``: ``x0``, ``y0``, ``x1``, ``y1``."""
    outer = polygon_rings(c)[0]
    of = lambda k: F.transform(outer, lambda p: p[k])
    return F.struct(F.array_min(of(0)).alias("x0"), F.array_min(of(1)).alias("y0"), F.array_max(of(0)).alias("x1"), F.array_max(of(1)).alias("y1"))


def polygon_wkt(rings: Column) -> Column:
    """Text of a polygon whose rings are arrays of points."""
    point = lambda p: F.concat(p[0].cast("string"), F.lit(" "), p[1].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, point), ", "), F.lit(")"))
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))


def _wkb_point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def _to_points(x: pa.Array, y: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else _wkb_point(a, b) for a, b in zip(x.to_pylist(), y.to_pylist())], pa.binary())


def _of_points(data: pa.Array) -> pa.Array:
    out = []
    for b in data.to_pylist():
        order = "<" if b and b[0] == 1 else ">"
        out.append(dict(zip("xy", struct.unpack_from(f"{order}dd", b, 5))) if b and len(b) >= 21 and struct.unpack_from(f"{order}I", b, 1)[0] == 1 else None)
    return pa.array(out, pa.struct([("x", pa.float64()), ("y", pa.float64())]))


for _f, _n in ((_to_points, ("x", "y")), (_of_points, ("data",))):
    # Spark wants the types, which postponed evaluation leaves as text.
    _f.__annotations__ = dict.fromkeys((*_n, "return"), pa.Array)


def wkb_points(x: Column, y: Column) -> Column:
    """Well-known binary of points, as GeoParquet stores them; null where a coordinate is."""
    return F.arrow_udf(_to_points, "binary")(x, y)


def points_of_wkb(data: Column) -> Column:
    """Struct of the coordinates ``x`` and ``y`` of well-known binary points, of either byte order; null where it is another geometry."""
    return F.arrow_udf(_of_points, "struct<x:double,y:double>")(data)


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Entries ``i``, ``j``, ``value`` of a coordinate matrix, counted from 1; its comment and size lines are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%"))
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    # The line of sizes has a whole number in third place and names the largest row and column.
    entries = parts.select(F.col("p")[0].try_cast("long").alias("i"), F.col("p")[1].try_cast("long").alias("j"), F.col("p")[2].alias("v"), F.monotonically_increasing_id().alias("__k"))
    first = entries.agg(F.min("__k")).first()[0]
    return entries.where(F.col("__k") != F.lit(first)).select("i", "j", F.col("v").try_cast("double").alias("value"))


def write_matrix_market(entries: DataFrame, folder: str, rows: int, columns: int) -> None:
    """Entries ``i``, ``j``, ``value`` as text of a coordinate matrix in a folder of parts; the first part holds the header."""
    n = entries.count()
    head = entries.sparkSession.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{rows} {columns} {n}",)], "value string").coalesce(1)
    lines = entries.select(F.concat_ws(" ", "i", "j", "value").alias("value"))
    head.write.mode("overwrite").text(f"{folder}/head")
    lines.write.mode("overwrite").text(f"{folder}/body")


def read_matrix_market_parts(spark: SparkSession, folder: str) -> DataFrame:
    """What :func:`write_matrix_market` wrote."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(f"{folder}/body").select(p[0].try_cast("long").alias("i"), p[1].try_cast("long").alias("j"), p[2].try_cast("double").alias("value"))


def write_summary(path: str, summary: Mapping[str, object], markdown: bool = False) -> None:
    """A small summary of a run as JSON or as a Markdown list, at a path or URI."""
    text = "".join(f"- {k}: {v}\n" for k, v in summary.items()) if markdown else json.dumps(summary, indent=2, default=str)
    system, name = open_folder(path)
    with system.open_output_stream(name) as f:
        f.write(text.encode())
