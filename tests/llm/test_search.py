"""Searches against brute force."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from confluo.llm import flat, host_suffix, simhash_gray, url_rules, wu_manber

SF = "/root/testdata/sf0.01"


def _column(table, name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/{table}.parquet", columns=[name]).column(name).to_pylist()


def test_fold_and_words():
    raw = np.frombuffer("Été, N°5 ÜBER-all\n".encode(), np.uint8)
    folded = flat.fold(raw)
    s, e, _ = flat.words(folded, np.array([0, len(raw)]))
    assert [bytes(folded[a:b]).decode(errors="replace") for a, b in zip(s, e)][0] == "été"
    assert flat.hash_word("Über") == flat.hash_word("über")


@given(st.lists(st.text("ab ", max_size=40), max_size=8), st.lists(st.text("ab ", min_size=3, max_size=30), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_wu_manber_equals_find(texts, items):
    found = wu_manber.Patterns(list(range(len(items))), pa.array(items), words=2, least=2)
    patterns = [bytes(found.text[a : a + n]) for a, n in zip(found.start, found.size)]
    assert len(set(patterns)) == len(patterns)
    docs, pats = wu_manber._matches(pa.array(texts, pa.string()), wu_manber.WuManber(found))
    got = sorted(zip(docs.tolist(), pats.tolist()))
    expect = []
    for d, t in enumerate(texts):
        w = ["", *t.split(), ""]
        flat_text = " ".join(w).encode()
        for k, p in enumerate(patterns):
            expect += [(d, k)] * len(re.findall(b"(?=" + re.escape(p) + b")", flat_text))
    assert got == sorted(expect)


def test_decontamination_finds_passages_and_leaves_the_rest(spark):
    bench = spark.createDataFrame([(7, "Alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "xx alpha, BETA gamma-delta epsilon zeta; eta theta yy"), (2, "alpha beta gamma delta epsilon zeta eta"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in wu_manber.find_contamination(docs, bench).collect()] == [(1, 7, 1)]
    assert sorted(r.doc_id for r in wu_manber.drop_contaminated(docs, bench).collect()) == [2, 3]


def _bits(hi, lo):
    return np.unpackbits(np.column_stack((hi, lo)).view(np.uint8).reshape(len(hi), 16), axis=1)


def test_gray_index_finds_all_pairs_of_a_bucket():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, (20, 2), dtype=np.uint64)
    code = base[rng.integers(0, 20, 500)]
    for _ in range(6):
        code = code ^ (np.uint64(1) << rng.integers(0, 64, code.shape, dtype=np.uint64))
    bucket = rng.integers(0, 3, 500)
    got = {tuple(sorted(p)) for i, j in simhash_gray.GrayIndex(bucket, code[:, 0].copy(), code[:, 1].copy()).pairs(14) for p in zip(i.tolist(), j.tolist())}
    d = np.bitwise_count(code[:, None] ^ code[None]).sum(2)
    expect = {(i, j) for i in range(500) for j in range(i + 1, 500) if bucket[i] == bucket[j] and d[i, j] <= 14}
    assert got == expect and expect


def test_gray_rank_orders_neighbours_one_bit_apart():
    codes = np.arange(256, dtype=np.uint64) << np.uint64(56)
    rank, _ = simhash_gray.gray_rank(codes, np.zeros(256, np.uint64))
    by_rank = codes[np.argsort(rank)]
    assert (np.bitwise_count(by_rank[1:] ^ by_rank[:-1]) == 1).all()


def test_near_duplicates_recall(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = simhash_gray.near_duplicates(docs).toPandas().set_index("doc_id")
    assert len(out) == docs.count()
    ids = docs.select("doc_id", "text").toPandas()
    hi, lo, some = simhash_gray.fingerprints(pa.array(ids.text))
    bits = _bits(hi[some], lo[some]).astype(np.int16)
    near = np.argwhere(np.triu((bits[:, None] != bits[None]).sum(2) <= simhash_gray.MOST, 1)) if len(bits) < 1500 else []
    group = out.loc[ids.doc_id[some]].group_id.to_numpy()
    assert len(near) and (group[near[:, 0]] == group[near[:, 1]]).mean() >= 0.9
    # Copies by text are always together, and each group keeps one document, that of the least id.
    same = ids.groupby("text").doc_id.apply(list)
    assert all(out.loc[x].group_id.nunique() == 1 for x in same if len(x) > 1)
    assert (out[out.keep].index == out[out.keep].group_id).all() and out.groupby("group_id").keep.sum().eq(1).all()


def test_drop_near_duplicates(spark):
    text = "the quick brown fox jumps over the lazy dog near the river bank while seven wise owls watch closely from ancient trees tonight"
    rows = [(5, text), (3, text + " indeed"), (9, "an entirely different line about stone bridges, markets, and lanterns in the winter evening of a northern town"), (9, "zz"), (None, text), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as group_id")
    out = simhash_gray.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in out.collect() if r.text)
    assert [g[0] for g in got] == [-1, 3, 9] and out.count() == 4


def test_simhash_many_copies(spark):
    docs = spark.range(1200).selectExpr("id as doc_id", "'the same words in the same order every time that they are read aloud' as text")
    out = simhash_gray.near_duplicates(docs).toPandas()
    assert out.keep.sum() == 1 and out.group_id.eq(0).all() and out.n_links.eq(1199).all()


RULES = ["||bad.example^", "/ads/*", "@@||bad.example^*/ok", "|http://x.", "track|", "^q=1^", "/re[0-9]+x/", "a*b^", "! comment", ""]
URLS = ["http://bad.example/", "https://www.bad.example/p/ok", "https://good.example/ads/1", "http://x.y/z", "http://u.v/track", "http://u.v/tracker", "http://u.v/?q=1&r", "http://u.v/?qq=1&r", "http://u.v/re55x", "http://u.v/aXXb?", "HTTP://BAD.EXAMPLE:80/", "http://notbad.example/"]


def test_url_index_equals_trying_every_rule():
    rules = url_rules.parse_all(RULES)
    m = url_rules.Matcher(rules, *url_rules.build_index(rules, {"example": 9, "bad": 2, "ads": 1}))
    for u in URLS:
        all_ = [k for k, r in enumerate(rules) if re.search(r.regex, u.lower(), re.ASCII)]
        expect = (next((k for k in all_ if not rules[k].exception), None), next((k for k in all_ if rules[k].exception), None))
        assert m.match(u) == expect, u
    assert m.match("http://bad.example/")[0] == 0 and m.match("http://notbad.example/")[0] is None


def test_rarest_token_is_chosen_and_few_rules_run():
    rules = url_rules.parse_all([f"||site{k}.example^" for k in range(200)])
    index, rest = url_rules.build_index(rules, {"example": 1000})
    assert "example" not in index and not rest
    m = url_rules.Matcher(rules, index, rest)
    assert m.match("http://site7.example/")[0] == 7 and m.runs == 1


def test_token_counts(spark):
    urls = spark.createDataFrame([("http://a.bb/bb/cc",), ("http://bb.dd",), (None,)], "url string")
    assert url_rules.token_counts(urls, ["bb", "cc", "zz"]) == {"bb": 2, "cc": 1}


def _brute(texts, least):
    seen = defaultdict(set)
    for t in set(texts):
        w = t.split()
        for k in range(len(w) - least + 1):
            seen[tuple(w[k : k + least])].add(t)
    out = []
    for t in texts:
        w, gone = t.split(), set()
        for k in range(len(w) - least + 1):
            if len(seen[tuple(w[k : k + least])]) > 1:
                gone |= set(range(k, k + least))
        out.append((len(w), len(gone), [x for k, x in enumerate(w) if k not in gone]))
    return out


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14).map(" ".join), max_size=7), st.integers(1, 6))
@settings(max_examples=80, deadline=None)
def test_host_suffix_array_equals_brute_force(texts, least):
    got = host_suffix.clean_host(texts, least)
    assert [(n, r, t.split()) for n, r, t in got] == _brute(texts, least)


def test_large_hosts_are_dealt_out_alike(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    key = lambda df: sorted(map(tuple, df.collect()))
    one, many = host_suffix.extract_pages(pages), host_suffix.extract_pages(pages, host_bytes=1000, part_bytes=20_000)
    assert key(one) == key(many)
    by = defaultdict(list)
    for r, h in zip(pages.collect(), map(host_suffix.extract, _column("pages", "html"))):
        by[re.match(r"https?://([^/?#:]+)", r.url)[1].lower()].append((r.page_id, h))
    got = {r.page_id: (r.n_tokens, r.n_removed, r.text.split()) for r in one.collect()}
    for rows in by.values():
        for (i, _), e in zip(rows, _brute([h for _, h in rows], host_suffix.LEAST)):
            assert got[i] == e


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>T</title></head><body><p>Hello <b>wor</b>ld</p><p>Next</p>", "Hello world\nNext"),
    ("<script>if (a < b) {}</script>x<!-- <p>no</p> -->y", "x\ny"), ("a &lt;b&gt; &amp;amp; c", "a <b> &amp; c"), ("1 < 2 and <i>x</i>", "1 < 2 and x"), ("<style>unclosed", ""), (None, ""), ("\0<br>", ""),
])
def test_extract(page, text):
    assert host_suffix.extract(page) == text
