"""Token ids against the tokenizer on whole texts, in shards and in training sequences. The tokenizer is a small one made here."""

import base64
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from confluo.llm import pack_sos, sstable, tokens

DOCS = "doc_id long, text string, lang string"
MERGES = [b"th", b"the", b" t", b" the", b"er", b"in", b" i", b" in", b"an", b" a", b" an", b"\n\n", b"  ", b"ri", b"riv", b"river", b" r", b" river"]
RANKS = b"\n".join(base64.b64encode(t) + b" " + str(k).encode() for k, t in enumerate([bytes([k]) for k in range(256)] + MERGES))


@pytest.fixture(scope="module")
def tokenizer(tmp_path_factory):
    path = tmp_path_factory.mktemp("t") / "small.tiktoken"
    path.write_bytes(RANKS)
    return str(path)


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ther in\n\t '.1é 　 日"), max_size=30)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_ids_are_those_of_whole_texts(texts):
    e = tokens.encoder(RANKS)
    for _ in range(2):
        ids, at = e.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.tokenizer.encode_ordinary(t or "") for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e = tokens.Encoder(RANKS)
    text = ["the river in the end " * k for k in range(1, 9)]
    for t in text:
        ids, _ = e.encode(pa.array([t, "an  inn\n"]))
        assert e.decode(ids) == t + "an  inn\n"


def test_a_large_file_is_refused(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        tokens.read_tokenizer(tokenizer)


ROWS = [(k, f"the river {k} in the end " * (k % 9), "en") for k in range(150)] + [(7, None, None), (7, "", ""), (None, "an orphan in the river", "x"), (-1, "in the river " * 3000, "en"), (5, "the river 5 in the end " * 5, "en")]


def test_shards_of_token_ids(spark, tmp_path, tokenizer):
    docs = spark.createDataFrame(ROWS, DOCS)
    sstable.save_shards(sstable.build_shards(docs, shard_docs=40, block_bytes=300, tokenizer=tokenizer), f"file://{tmp_path}/s")
    e = tokens.encoder(RANKS)
    shards = sstable.read_shards(f"file://{tmp_path}/s")
    text = lambda v: None if v is None else e.decode(v)
    got = Counter((i, text(sstable.decode_value(v, tokenizer)[0])) for s in shards for i, v in s.scan())
    assert got == Counter((r[0], r[1]) for r in ROWS) and len(shards) > 2
    assert [text(sstable.decode_value(v, tokenizer)[0]) for s in shards for v in s.get(-1)] == [ROWS[-2][1]]


class _Counted:
    """A file that counts what is read of it."""

    def __init__(self, file):
        self.file, self.read_bytes, self.seek = file, 0, file.seek

    def read(self, n):
        self.read_bytes += n
        return self.file.read(n)


def test_a_lookup_reads_one_block(tmp_path):
    w = sstable.ShardWriter(0, 4096)
    rng = np.random.default_rng(0)
    parts = [w.add(k, rng.bytes(300)) for k in range(2000)]
    data = b"".join(p[-1] for p in [*parts, *w.close()] if p)
    (tmp_path / "x").write_bytes(data)
    with open(tmp_path / "x", "rb") as f:
        file = _Counted(f)
        shard = sstable.ShardReader(file)
        before = file.read_bytes
        assert before < len(data) / 10 and len(shard.get(1234)) == 1
        assert file.read_bytes - before < 2 * 4096 + 600
        again = file.read_bytes
        assert shard.get(10**9) == [] and file.read_bytes - again < 2 * 4096


@pytest.mark.parametrize("capacity", [1, 64, 2048])
def test_sequences_hold_every_text(spark, tokenizer, capacity):
    docs = spark.createDataFrame(ROWS if capacity > 1 else ROWS[:12], DOCS)
    packed = pack_sos.pack_documents(docs, capacity=capacity, group_docs=40, tokenizer=tokenizer)
    e = tokens.encoder(RANKS)
    by = defaultdict(list)
    for r in packed.collect():
        assert len(r.tokens) == r.n_tokens and r.bin_offset + r.n_tokens <= capacity
        by[r.doc_id].append((r.piece, r.tokens))
    got = Counter()
    for doc, pieces in by.items():
        # Repeated ids have pieces of equal number; the end marks part their texts when none is cut.
        if sum(p == 0 for p, _ in pieces) == 1:
            got[doc, e.decode([t for _, x in sorted(pieces) for t in x])] += 1
        else:
            got.update((doc, e.decode(x)) for _, x in pieces)
    want = Counter((r[0], (r[1] or "") + tokens.END) for r in docs.collect())
    once = {d for d, n in Counter(r[0] for r in docs.collect()).items() if n == 1}
    assert {k: v for k, v in got.items() if k[0] in once} == {k: v for k, v in want.items() if k[0] in once}
    if capacity == 2048:
        assert got == want
    rows = pack_sos.sequences(packed).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(r.tokens) for r in rows) == sum(len(e.tokenizer.encode_ordinary(r[1] or "")) + 1 for r in docs.collect())
    assert all(list(r.starts) == sorted(r.starts) and r.starts[0] == 0 and len(r.doc_ids) == len(r.starts) for r in rows)


def test_an_id_on_most_rows_is_spread(spark, tokenizer):
    docs = spark.createDataFrame([(None if k % 3 else k, "the river", "en") for k in range(600)], DOCS).repartition(3)
    packed = pack_sos.pack_documents(docs, capacity=32, group_docs=50, tokenizer=tokenizer).toPandas()
    groups = (packed.bin_id // (1 << 32)).value_counts()
    assert len(packed) == 600 and groups.max() < 200


def test_empty_table(spark, tokenizer):
    docs = spark.createDataFrame([], DOCS)
    assert pack_sos.pack_documents(docs, tokenizer=tokenizer).count() == 0 and sstable.build_shards(docs, tokenizer=tokenizer).count() == 0
