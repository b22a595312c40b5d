"""The panel of the models is kept: what they do with it doesn't read or join the tables again."""

from confluo.plans import estimates
from confluo.plans.registry import Tables


def test_models_do_not_read_the_tables_again(spark, sf_dir):
    panel = estimates.balanced(Tables(spark, sf_dir))
    assert panel.count() and "parquet" not in panel._jdf.queryExecution().optimizedPlan().toString().lower()
