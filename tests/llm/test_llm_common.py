"""What holds for every operator: nulls, empty tables, repeated rows and other columns."""

import pytest
from pyspark.sql import functions as F

from confluo.llm import host_suffix, line_rules, pack_sos, quality_gam, secret_guess, simhash_gray, sstable, toxicity_ordinal, url_rules, wu_manber

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "The river runs past the old stone mill and turns the wheel. " * 3000
ROWS = [
    (1, "A quiet sentence about rivers and mills, ended well.", "en", "a", 52),
    (1, "A quiet sentence about rivers and mills, ended well.", "en", "a", 52),
    (2, None, None, None, None),
    (3, "", "", "", 0),
    (None, "An orphan without an id says hello to all the readers.", "en", "b", 1),
    (4, LONG, "en", "c", len(LONG)),
    (5, "   \n\t ", "en", "c", 6),
    (-6, "token = \"q7Zk2mXw9RtB4vN8\" and nothing else of interest here.", "en", "d", 9),
]
LABELS = "doc_id long, quality int, toxic int"
BENCH = [(1, "one two three four five six seven eight nine"), (None, "x"), (2, None)]


def apply_all(docs, labels, bench):
    return {
        1: lambda: quality_gam.score_quality(docs, labels),
        2: lambda: secret_guess.scan_secrets(docs),
        3: lambda: wu_manber.find_contamination(docs, bench),
        4: lambda: simhash_gray.near_duplicates(docs),
        5: lambda: sstable.build_shards(docs),
        6: lambda: toxicity_ordinal.score_toxicity(docs, labels),
        7: lambda: pack_sos.pack_documents(docs),
        9: lambda: line_rules.clean_lines(docs),
    }


NAMES = ["keep", "p_good", "grade", "group_id", "bin_id", "id", "hi", "node", "g", "n", "rest", "rule", "start", "severity", "__l", "__m", "__q", "__s", "__t", "__h", "count", "bucket"]


@pytest.mark.parametrize("op", [1, 2, 3, 4, 5, 6, 7, 9])
def test_edges(spark, op):
    docs = spark.createDataFrame(ROWS, DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, None), (1, 1, 0)], LABELS)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    plain = apply_all(docs, labels, bench)[op]().toPandas()
    clash = docs.select("*", *[F.lit("x").alias(n) for n in NAMES])
    clash = apply_all(clash, labels, bench)[op]()
    assert clash.columns == list(plain.columns)
    if op != 5:  # the shards hold the other columns too
        key = list(plain.columns)
        a = sorted(map(repr, plain[key].itertuples(index=False)))
        assert a == sorted(map(repr, clash.toPandas()[key].itertuples(index=False)))
    if op in (1, 6, 9):
        assert len(plain) == len(ROWS)
        assert (plain.doc_id.isna()).sum() == 1
    if op == 4:
        assert sorted(plain.doc_id) == [-6, 1, 2, 3, 4, 5] and plain.keep.all()
    if op == 7:
        assert plain.groupby("doc_id", dropna=False).size().sum() >= len(ROWS) and (plain.bin_offset + plain.n_tokens <= pack_sos.CAPACITY).all()
    if op == 2:
        assert plain[plain.secret].doc_id.tolist() == [-6]


@pytest.mark.parametrize("op", [1, 2, 3, 4, 5, 6, 7, 9])
def test_empty_tables(spark, op):
    docs = spark.createDataFrame([], DOCS)
    got = apply_all(docs, spark.createDataFrame([], LABELS), spark.createDataFrame([], "item_id long, text string"))[op]()
    assert got.count() == 0


@pytest.mark.parametrize("op", [1, 3, 6])
def test_no_labels_or_items(spark, op):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = apply_all(docs, spark.createDataFrame([], LABELS), spark.createDataFrame([], "item_id long, text string"))[op]().toPandas()
    if op == 1:
        assert got.keep.sum() == sum(bool(r[1]) for r in ROWS)
    elif op == 6:
        assert not got.toxic.any()
    else:
        assert got.empty


def test_pages_edges(spark):
    rows = [(1, "http://a.example/x", "<p>one two</p>"), (1, "http://a.example/x", "<p>one two</p>"), (2, None, None), (3, "", ""), (None, "not a url", "<b>bold</b> text"), (4, "http://A.example/y", "plain & simple &amp; short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("blob", F.lit("z")).withColumn("rule", F.lit(True))
    got = host_suffix.extract_pages(pages).toPandas()
    assert len(got) == 6 and sorted(got.text) == sorted(["one two", "one two", "", "", "bold text", "plain & simple & short"])
    assert got[got.page_id == 4].host.tolist() == ["a.example"]
    blocked = url_rules.filter_urls(pages, ["||a.example^"]).toPandas()
    assert blocked.blocked.sum() == 3 and len(blocked) == 6
    assert host_suffix.extract_pages(pages.limit(0)).count() == 0 and url_rules.filter_urls(pages.limit(0)).count() == 0
    assert not url_rules.filter_urls(pages, []).toPandas().blocked.any()
