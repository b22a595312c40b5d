"""Implied decimals of every order."""

import pytest

from confluo.plans import catalog


def test_every_order_has_its_weight(spark, tmp_path):
    keys = [0, 7, 42, 899, 900, 999, 1000, 1899, 1900, 9999, 10000, 10950, 123456, 600000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = dict(map(tuple, catalog.queries()["implied_decimals"](spark, str(tmp_path)).collect()))
    assert got == pytest.approx({k: k % 1000 + 100 + k % 10000 / 10000 for k in keys})
