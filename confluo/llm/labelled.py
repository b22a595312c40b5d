"""A bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int) -> DataFrame:
    """``id``, ``y`` and ``text`` of at most ``bound`` documents, one row an id, those whose hashed ids are smallest.

    ``allowed`` is a condition on the label ``y``. Only ids that are in ``docs`` count towards the bound, so labels of other
    documents don't use it up. Labels that are null or not allowed, and ids labelled in two ways, are left out. Of the rows of a
    repeated id, the least text that isn't null is taken.
    """
    given = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & allowed)
    clear = given.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")
    # Ids are made distinct first, so that an id that is on a third of all rows isn't a third of a join.
    there = docs.select(F.col("doc_id").alias("id")).distinct()
    chosen = clear.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(bound)
    # At most ``bound`` rows of 12 bytes are broadcast.
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    return rows.groupBy("id", "y").agg(F.min("text").alias("text"))
