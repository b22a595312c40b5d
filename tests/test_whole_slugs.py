"""Slugs are of whole texts."""

import re
import unicodedata

import pyarrow.parquet as pq

from confluo.functions import text
from confluo.plans import catalog

SF = "/root/testdata/sf0.001"
_FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def test_every_character_counts(spark, tmp_path):
    long = "Água limpa " * 20 + "FIM"
    spark.createDataFrame([(1, long), (2, "*" * 100 + "São"), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, catalog.queries()["slugify_titles"](spark, str(tmp_path)).collect()))
    assert got == {1: "agua_limpa_" * 20 + "fim", 2: "sao", 3: None, 4: "run"}


def test_given_texts(spark):
    got = dict(map(tuple, catalog.queries()["slugify_titles"](spark, SF).collect()))
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert set(got) == set(table["doc_id"]) and any(len(x) > 80 for x in got.values())
    for i, text in zip(table["doc_id"], table["text"]):
        assert got[i] == (re.sub("[^a-z0-9]+", "_", text.lower().translate(_FOLD)).strip("_") or "run")


def test_letters_of_all_latin_scripts(spark):
    words = ["Łódź", "Žižkov", "ﬁve", "Ⅻ", "İzmir", "e\u0301te\u0301", "ｆｕｌｌ２", "x²", "Ǆ", "ĳ", "Ấp"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.slugify("w")).collect()]
    single = [re.sub("[^a-z0-9]+", "_", "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))).strip("_") for w in words]
    same = [g == s for g, s in zip(got, single)]
    # Signs that are several letters, such as ligatures, aren't taken apart.
    assert [w for w, ok in zip(words, same) if not ok] == ["ﬁve", "Ⅻ", "Ǆ", "ĳ"]
