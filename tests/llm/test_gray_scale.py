"""The search behind near-duplicates: recall by distance, dense groups, buckets that are dealt out, and its growth."""

import time

import numpy as np
import pytest

from confluo.llm import simhash_gray as sg


def _codes(rng, n):
    return rng.integers(0, 2**64, (n, 2), dtype=np.uint64)


def _flip(rng, code, bits):
    out = code.copy()
    for k in range(len(out)):
        for x in rng.choice(128, bits, replace=False):
            out[k, x // 64] ^= np.uint64(1) << np.uint64(x % 64)
    return out


def _nodes(spark, code):
    rows = [(k, int(a), int(b)) for k, (a, b) in enumerate(code.view(np.int64).tolist())]
    return spark.createDataFrame(rows, "node long, hi long, lo long")


def _groups(n, edges):
    e = np.array([(r.src, r.dst) for r in edges.collect()], np.int64).reshape(-1, 2)
    return sg.forest(n, e[:, 0], e[:, 1])


def _brute(code, most):
    d = np.bitwise_count(code[:, None] ^ code[None]).sum(2)
    return sg.forest(len(code), *np.nonzero(d <= most))


@pytest.mark.parametrize("bits", [4, 12, 16, 18, 19, 20])
def test_recall_at_each_distance(spark, bits):
    """Pairs by themselves: no chain or third copy helps. The number of tables follows that of fingerprints."""
    rng = np.random.default_rng(bits)
    base = _codes(rng, 2000)
    code = np.concatenate((base, _flip(rng, base, bits)))
    label = _groups(len(code), sg.near_edges(_nodes(spark, code)))
    found = (label[:2000] == label[2000:]).mean()
    assert found >= 0.93 and len(np.unique(label)) == len(code) - round(found * 2000)


def test_plan_keeps_recall_and_bucket_size():
    for n in (1, 100, 10**5, 10**7, 10**10):
        tables, sample = sg.plan(n)
        assert 1 - (1 - (1 - sg.MOST / 128) ** sample) ** tables >= sg.RECALL and n / 2**sample <= 2 * sg.BUCKET
    assert sg.plan(10**10)[0] < 1500


def test_dense_and_chained_groups_in_one_bucket():
    rng = np.random.default_rng(5)
    centres = _codes(rng, 3)
    code = np.concatenate([_flip(rng, np.repeat(centres[k : k + 1], 400, 0), bits) for k, bits in enumerate((6, 9, 12))] + [_codes(rng, 100)])
    chain = [_codes(rng, 1)]
    for _ in range(30):
        chain.append(_flip(rng, chain[-1], 15))
    code = np.concatenate([code, *chain])
    bucket = np.zeros(len(code), np.int64)
    group = sg.peel(bucket, code[:, 0].copy(), code[:, 1].copy(), 20)
    assert (group >= 0).sum() > 400
    assert (sg.links(bucket, code[:, 0].copy(), code[:, 1].copy(), 20) == _brute(code, 20)).all()


def test_crowded_buckets_are_dealt_out_whole(spark):
    """With few rows a task, buckets are split in slices; what is connected stays the same as by brute force."""
    rng = np.random.default_rng(6)
    centre = _codes(rng, 1)
    code = np.concatenate([_flip(rng, np.repeat(centre, 300, 0), bits) for bits in (5, 8, 11)] + [_codes(rng, 60)])
    code = np.unique(np.concatenate([code, _flip(rng, code[-40:], 14)]), axis=0)
    nodes = _nodes(spark, code)
    want = _brute(code, 20)
    for hot in (40, 150):
        label = _groups(len(code), sg.near_edges(nodes, hot=hot, recall=0.9999))
        assert (label == want).all()


def test_a_dense_bucket_takes_time_in_proportion():
    rng = np.random.default_rng(7)
    took = []
    for n in (20_000, 80_000):
        code = np.repeat(_codes(rng, 1), n, 0)
        for _ in range(5):
            code[np.arange(n), rng.integers(0, 2, n)] ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
        began = time.perf_counter()
        label = sg.links(np.zeros(n, np.int64), code[:, 0].copy(), code[:, 1].copy(), 20)
        took.append(time.perf_counter() - began)
        assert (label == 0).all()
    assert took[1] < 8 * took[0] + 0.5


def test_unrelated_fingerprints_take_time_in_proportion(spark):
    took = []
    for n in (10_000, 40_000):
        code = _codes(np.random.default_rng(8), n)
        tables, sample = sg.plan(n)
        began = time.perf_counter()
        for a, b in sg.samples(tables, sample):
            key = (code[:, 0] & np.int64(a).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) ^ (code[:, 1] & np.int64(b).astype(np.uint64))
            order = np.argsort(key)
            assert len(np.unique(sg.links(key[order].view(np.int64), code[order, 0], code[order, 1], sg.MOST))) == n
        took.append((time.perf_counter() - began) / tables)
    assert took[1] < 6 * took[0]
