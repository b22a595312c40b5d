"""Every stage on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "The river runs past the old stone mill, and its wheel turns slowly through every season of the year."
LONG = "Every spring the ferry brings traders, musicians and letters across our wide green bay.\n" * 2000
ROWS = [
    (1, GOOD, "en", "a", len(GOOD)), (1, GOOD, "en", "a", len(GOOD)), (2, GOOD + " Indeed.", "en", "a", 9), (3, None, None, None, None), (4, "", "", "", 0), (None, "A lonely line about lamps, with no number of its own to speak of.", "en", "b", 3),
    (5, LONG, "en", "c", None), (6, 'The password: "kX93#vQz81LmPq" was left in a note beside the gate of the garden.', "en", "d", 7), (7, "We know that one two three four five six seven eight nine ten was copied here.", "en", "e", 8),
]
CLASH = ["keep", "group_id", "__confluo_q", "__confluo_id", "__confluo_gone", "__confluo_n", "__confluo_hits", "__Confluo_clean", "item_id", "id", "hi", "node", "g", "n", "bin_id", "p"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name, rows in (("full", ROWS), ("empty", [])):
        d = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (3, None, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, None)] if rows else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out[name] = d
    return out


WANT = {
    "quality": [-1, 1, 1, 2, 5, 6, 7],
    "near_duplicates": [-1, 1, 3, 4, 5, 6, 7],
    "decontamination": [-1, 1, 1, 2, 3, 4, 5, 6],
    "secrets": [-1, 1, 1, 2, 3, 4, 5, 6, 7],
}


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES], ids=lambda s: s.__name__)
def test_stage(spark, folders, stage):
    docs = spark.read.parquet(f"{folders['full']}/documents.parquet")
    plain = stage(spark, docs, folders["full"])
    wide = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    if stage is pipeline.packing:
        key = lambda df: sorted(map(tuple, df.fillna(-1).collect()))
        assert key(plain) == key(stage(spark, wide, folders["full"])) and len({r[0] for r in key(plain)}) >= 1
        assert {r.doc_id for r in plain.collect()} == {r[0] for r in ROWS}
    else:
        assert plain.columns == docs.columns
        ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())
        got = stage(spark, wide, folders["full"])
        assert got.columns == wide.columns and ids(got) == ids(plain) == WANT[stage.__name__]
        if stage is pipeline.secrets:
            assert {r.doc_id for r in plain.collect() if r.text and "[SECRET]" in r.text} == {6}
    assert stage(spark, docs.limit(0), folders["full"]).count() == 0
    assert stage(spark, docs.limit(0), folders["empty"]).count() == 0


def test_run(spark, folders):
    assert pipeline.run(spark, folders["empty"]).count() == 0
    assert {r.doc_id for r in pipeline.run(spark, folders["full"]).select("doc_id").distinct().collect()} == {None, 1, 5, 6}
