"""Benchmark passages in other spellings and scripts, short and long items, and the SQL on a fixture that has them all."""

import collections
import time

import duckdb
import pyarrow as pa
import pytest

from confluo.llm import wu_manber

ITEMS = [
    (1, "We don't say - \"how many\" stones lie in the old river bed."), (2, "five words are one pattern"), (3, "four words are none"), (4, None), (5, "ΟΙ ΠΟΤΑΜΟΙ ΤΗΣ ΧΩΡΑΣ ΜΑΣ ΠΑΝΕ ΣΤΗ ΘΑΛΑΣΣΑ"),
    (6, "Реки нашей страны текут в море и никогда назад не идут"), (2, "FIVE words are, one pattern"), (7, "seven words stand here in a row"), (8, "seven words stand here in a row"), (None, "an item without an id has these nine words"),
]
DOCS = [
    (1, "x We don’t say – “how many” stones lie in the old river bed… y"), (2, "so five words are one pattern; five words are one pattern"), (3, "four words are none"), (4, None), (5, ""), (6, "οι ποταμοι της χωρας μας πανε στη θαλασσα"),
    (7, "РЕКИ нашей страны, текут в море и никогда назад не идут"), (8, "seven words stand here in a row"), (8, "seven words stand here in a row"), (None, "an item without an id has these nine words here"), (9, "nothing of the kind"), (10, "x five words are one patterns"),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_against_the_sql(tables):
    docs, items = tables
    got = collections.Counter(tuple(r) for r in wu_manber.find_contamination(docs, items).collect())
    con = duckdb.connect()
    for name, rows, key in (("documents", DOCS, "doc_id"), ("benchmark", ITEMS, "item_id")):
        con.register(name, pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}))
    # The statement's lower() knows no final sigma, so it misses the Greek item.
    assert got.pop((6, 5, 1)) == 1
    assert got == collections.Counter(con.sql(wu_manber.ORACLE).fetchall())
    assert {r[0] for r in got} == {1, 2, 7, 8, None} and got[2, 2, 2] == 1 and got[8, 7, 1] == 2


def test_drop(tables):
    kept = wu_manber.drop_contaminated(*tables)
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter([3, 4, 5, 9, 10])


def test_many_passes_find_the_same(tables, monkeypatch):
    key = lambda: collections.Counter(tuple(r) for r in wu_manber.find_contamination(*tables).collect())
    one = key()
    monkeypatch.setattr(wu_manber, "PASS_BYTES", 60)
    assert key() == one


def test_a_long_word_takes_no_more_memory_than_itself():
    p = wu_manber.Patterns([1], pa.array(["w" * 100_000 + " " + " ".join(f"word{k}" for k in range(3000))]))
    e = wu_manber.WuManber(p)
    held = sum(x.nbytes for x in (p.text, p.start, p.size, p.item, p.first, e.shift, e.by_suffix, e.suffix))
    assert len(p) == 2994 and held < 8 << 20
    docs, pats = wu_manber._matches(pa.array(["a " + " ".join(f"word{k}" for k in range(100, 120)), "w" * 100_000 + " word0 word1 word2 word3 word4 word5 word6"]), e)
    assert (docs == 0).sum() == 13 and (docs == 1).sum() == 1


def test_long_texts():
    p = wu_manber.Patterns([1], pa.array(["one two three four five six seven eight"]))
    e = wu_manber.WuManber(p)
    text = "a b c d " * 2_000_000 + "one two three four five six seven eight"
    began = time.perf_counter()
    docs, _ = wu_manber._matches(pa.array([text, "¿" * 1_000_000 + " one two three four five six seven eight"]), e)
    assert docs.tolist() == [0, 1] and time.perf_counter() - began < 20


def test_fold_leaves_latin_texts_alone():
    texts = pa.array(["Été — noir", "plain", None, "ÜBER"])
    assert wu_manber.unicode_fold(texts).to_pylist() == ["été noir", "plain", None, "ÜBER"]
