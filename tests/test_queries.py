"""Every registered query against its SQL, and the contract of the entry module."""

import collections
import glob
import importlib
import os
import subprocess
import sys

import duckdb
import pytest

from confluo.plans import catalog

SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace(" ", "T").removesuffix("T00:00:00")
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = collections.Counter(tuple(_norm(r[c]) for c in order) for r in got.collect())
    b = collections.Counter(tuple(_norm(dict(zip(want.columns, r))[c]) for c in order) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_module(spark):
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_library_without_the_llm_folder(tmp_path, with_pipeline):
    """A copy without it, with the pipeline's file or without, imports and keeps the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{root}/confluo", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "confluo/llm")], check=True)
    if with_pipeline:
        (tmp_path / "corpus_pipeline.py").write_text("from confluo.llm import pack_sos\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 140 and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
