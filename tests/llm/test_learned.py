"""Operators that learn: held-out accuracy, and what the models promise."""

import numpy as np
import pyarrow as pa
import pytest

from confluo.llm import quality_gam, toxicity_ordinal as tox

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled():
    import pyarrow.parquet as pq

    d = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    return d.merge(pq.read_table(f"{SF}/labels.parquet").to_pandas(), on="doc_id").sample(frac=1, random_state=3)


def test_quality_held_out(labelled):
    train, test = labelled.iloc[:2500], labelled.iloc[2500:]
    m = quality_gam.fit_gam(quality_gam.features(pa.array(train.text)), train.quality.to_numpy(float))
    p = 1 / (1 + np.exp(-m.score(quality_gam.features(pa.array(test.text)))))
    good, keep = test.quality.to_numpy() == 1, p >= 0.35
    assert keep[good].mean() > 0.985 and (~keep)[~good].mean() > 0.9


def test_gam_is_a_sum_of_tables():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.fit_gam(x, y, n_pairs=1, pair_rounds=60)
    assert m.pairs == [(0, 1)]
    assert (((m.score(x) > 0) == (y > 0)).mean()) > 0.9
    one = x[7]
    by_hand = m.base + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(m.edges, m.tables, one))
    by_hand += m.pair_tables[0][np.searchsorted(m.pair_edges[0], one[0], "right"), np.searchsorted(m.pair_edges[1], one[1], "right")]
    assert m.score(x[7:8])[0] == pytest.approx(by_hand)


def test_toxicity_held_out(labelled):
    train, test = labelled.iloc[:3000], labelled.iloc[3000:]
    doc, bucket, words = tox.sparse_features(pa.array(train.text))
    model = tox.fit_ordinal(doc, bucket, tox.grades_of(train.toxic.to_numpy(), doc, bucket, words))
    p = model.exceed(model.sums(pa.array(test.text)))[:, 0] >= 0.4
    toxic = test.toxic.to_numpy() == 1
    assert p[toxic].mean() > 0.8 and p[~toxic].mean() < 0.01


def test_ordinal_recovers_order_and_shares_weights():
    rng = np.random.default_rng(1)
    texts, grade = [], []
    for _ in range(900):
        g = int(rng.integers(0, 4))
        texts.append(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 12).tolist() + ["vile"] * (g > 0) + ["vileworst"] * (g > 1) + ["vilemostest"] * (g > 2)))
        grade.append(g)
    y = np.array(grade)
    doc, bucket, words = tox.sparse_features(pa.array(texts))
    assert (tox.grades_of(y, doc, bucket, words) == y).all()
    m = tox.fit_ordinal(doc, bucket, y)
    assert (np.diff(m.thresholds) > 0).all() and m.weights.ndim == 1
    severity = m.exceed(m.sums(pa.array(texts))).sum(1)
    means = [severity[y == g].mean() for g in range(4)]
    assert all(a < b for a, b in zip(means, means[1:])) and abs(means[3] - 3) < 0.5


def test_binary_labels_become_grades_by_density():
    texts = ["calm words here"] * 30 + ["vile " + "calm words here " * k for k in range(1, 31)]
    y = np.array([0] * 30 + [1] * 30)
    doc, bucket, words = tox.sparse_features(pa.array(texts))
    g = tox.grades_of(y, doc, bucket, words)
    assert set(g[:30]) == {0} and set(g[30:]) == {1, 2, 3} and g[30] == 3 and g[59] == 1


def test_scores_of_the_whole_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    out = tox.score_toxicity(docs, labels).toPandas()
    assert len(out) == docs.count() and (out.severity >= 0).all() and (out.severity <= 3).all()
    kept = quality_gam.filter_quality(docs, labels)
    scored = quality_gam.score_quality(docs, labels).toPandas()
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(scored[scored.keep].doc_id)
