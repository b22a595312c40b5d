"""The sample that the learned operators are fitted on is bounded and uses its bound."""

import pytest
from pyspark.sql import functions as F

from confluo.llm import quality_gam, toxicity_ordinal

ROWS = {"quality": lambda d, n, b: len(quality_gam.training_rows(d, n, bound=b)[1]), "toxic": lambda d, n, b: len(toxicity_ordinal.training_rows(d, n, bound=b)[2])}


@pytest.mark.parametrize("label", ROWS)
@pytest.mark.parametrize("bound", [1, 2, 7, 100])
def test_bound(spark, label, bound):
    """An id on 5,000 rows counts once, and labels of other documents don't count."""
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = docs.unionByName(spark.range(5000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("again "), F.col("id")).alias("text")))
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias(label))
    assert ROWS[label](docs, labels, bound) == min(bound, 10)
    assert ROWS[label](docs.where("text is null"), labels, bound) == 0


def test_labels_both_ways_and_null(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (3, "c"), (4, "d"), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 0), (4, None), (None, 1), (4, 7)], "doc_id long, quality int")
    x, y = quality_gam.training_rows(docs, labels)
    assert y.tolist() == [1, 0] and len(x) == 2
