"""The flagship assembles every trench and year of the line items."""

import duckdb
import pytest
from pyspark.sql import functions as F

from confluo.plans import catalog

SF = "/root/testdata/sf0.001"


def test_targets_of_all_line_items(spark):
    out = catalog.queries()["upstream_bucket_assembly"](spark, SF)
    got = sorted(map(tuple, out.select("trench_id", "year").collect()))
    want = duckdb.sql(f"SELECT DISTINCT l_partkey, CAST(year(l_shipdate) AS INT) + 1 FROM read_parquet('{SF}/lineitem.parquet') WHERE l_partkey >= 4").fetchall()
    assert got == sorted(want)


def test_values_equal_the_sql_over_all_line_items(spark):
    """The registered statement, asked for the targets of all line items."""
    sql = catalog.oracle_sql()["upstream_bucket_assembly"].replace("l_linenumber = 1 AND ", "")
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    want = con.sql(sql)
    got = catalog.queries()["upstream_bucket_assembly"](spark, SF).select(*[F.col(c).cast("double") for c in want.columns]).collect()
    by = lambda rows: {(r[0], r[1]): [None if v is None else float(v) for v in r] for r in rows}
    a, b = by(got), by(want.fetchall())
    assert a.keys() == b.keys() and len(got) == len(a)
    for k in a:
        assert [v is None for v in a[k]] == [v is None for v in b[k]]
        assert [v or 0 for v in a[k]] == pytest.approx([v or 0 for v in b[k]], abs=1e-5)
