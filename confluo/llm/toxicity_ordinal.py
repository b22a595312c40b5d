"""Toxicity: cumulative-link ordinal regression on sparse text features.

A text's features are the hashed words in it and the hashed first 6 and 8 bytes of its longer words, each
counted once. One weight a feature serves all grades: P(grade > k) = sigmoid(w.x - theta[k]) with
theta[0] < theta[1] < ..., so the grades share their weights and differ in thresholds alone. The expected
severity is the sum of these probabilities over k.

Labels that say more than 0 and 1 are the grades. Where they say only whether a text is toxic, the toxic ones
are graded 1 to ``GRADES`` by how dense telling words are in them, with words that are much likelier in toxic
than in other labelled texts taken as telling.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm import flat
from confluo.llm.labelled import labelled_sample

BITS = 20
GRADES = 3
PREFIXES = (6, 8)
#: Features seen in fewer labelled texts than this have no weight.
LEAST_TEXTS = 2
#: Nor have features that, by themselves, don't raise the grade by this many standard deviations. So harmless words don't make up for others.
LEAST_SIGNAL = 2.5


def _occurrences(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and bucket of each feature occurrence, and the number of words of each document."""
    folded = flat.fold(raw)
    starts, ends, doc = flat.words(folded, off)
    hashes, docs = [flat.span_hashes(folded, starts, ends)], [doc]
    for k, size in enumerate(PREFIXES):
        long = np.flatnonzero(ends - starts > size)
        hashes.append(flat.mix(flat.span_hashes(folded, starts[long], starts[long] + size), k + 11))
        docs.append(doc[long])
    bucket = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate(docs), bucket, np.bincount(doc, minlength=len(off) - 1)


def sparse_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs in order, and the number of words of each text."""
    raw, off = flat.buffers(texts)
    keys, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in flat.slices(off):
        doc, bucket, n = _occurrences(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        keys.append(np.unique(doc + i << BITS | bucket))
        words.append(n)
    key = np.concatenate(keys)
    return key >> BITS, key & ((1 << BITS) - 1), np.concatenate(words)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each, of texts with the sums ``z``."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -500, 500)))

    def sums(self, texts: pa.Array) -> np.ndarray:
        raw, off = flat.buffers(texts)
        out = np.zeros(len(off) - 1)
        for i, j in flat.slices(off):
            doc, bucket, _ = _occurrences(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            some = np.flatnonzero(self.weights[bucket])
            key = np.unique(doc[some] << BITS | bucket[some])
            out[i:j] = np.bincount(key >> BITS, self.weights[key & ((1 << BITS) - 1)], j - i)
        return out


def grades_of(label: np.ndarray, doc: np.ndarray, bucket: np.ndarray, words: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Severity grades of labelled texts: the labels themselves if any is over 1, else by the density of telling features."""
    if not len(label) or label.max() > 1 or label.min() == label.max():
        return label.astype(np.int64)
    toxic = label > 0
    many = np.bincount(bucket[toxic[doc]], minlength=1 << BITS)
    few = np.bincount(bucket[~toxic[doc]], minlength=1 << BITS)
    odds = np.log((many + 0.5) / (toxic.sum() + 1)) - np.log((few + 0.5) / ((~toxic).sum() + 1))
    telling = (odds > 2) & (many >= LEAST_TEXTS)
    dense = np.bincount(doc[telling[bucket]], minlength=len(label)) / np.maximum(words, 1)
    cuts = np.quantile(dense[toxic], np.arange(1, grades) / grades)
    return np.where(toxic, 1 + np.searchsorted(cuts, dense, "left"), 0)


def _lbfgs(f, x: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """A minimum of ``f``, which gives a value and a gradient, by limited-memory BFGS with halved steps."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            alphas.append(s @ q / (s @ y))
            q -= alphas[-1] * y
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, y), alpha in zip(past, reversed(alphas)):
            q += (alpha - y @ q / (s @ y)) * s
        step, slope = 1.0, g @ q
        while True:
            new = x - step * q
            new_value, new_g = f(new)
            if new_value <= value - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = new - x, new_g - g
        done = value - new_value <= 1e-7 * max(abs(value), 1)
        x, value, g = new, new_value, new_g
        if done:
            break
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
    return x


def fit_ordinal(doc: np.ndarray, bucket: np.ndarray, grade: np.ndarray, *, ridge: float = 0.3, rounds: int = 200) -> OrdinalModel:
    """Least penalised loss over weights and thresholds. Features are screened first by their gradient at weight 0.

    The thresholds stay ordered, as it is their gaps' logarithms that are fitted. With no rows, or one grade only,
    all weights are 0 and the thresholds say that grade.
    """
    n, top = len(grade), max(int(grade.max(initial=0)), 1)
    above = np.array([((grade > k).sum() + 0.5) / (n + 1) for k in range(top)])
    theta = np.log((1 - above) / above)
    theta = np.maximum.accumulate(theta) + 1e-3 * np.arange(top)
    weights = np.zeros(1 << BITS)
    if not n or grade.min() == grade.max():
        return OrdinalModel(weights, theta)
    rows = np.arange(n)

    def around(m: OrdinalModel, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.column_stack((np.ones(n), m.exceed(z), np.zeros(n)))
        return p[rows, grade], p[rows, grade + 1]

    a, b = around(OrdinalModel(weights, theta), np.zeros(n))
    pull, texts = a + b - 1, np.bincount(bucket, minlength=1 << BITS)
    signal = -np.bincount(bucket, pull[doc], 1 << BITS) / (np.sqrt(np.maximum(texts, 1)) * pull.std())
    used = np.flatnonzero((texts >= LEAST_TEXTS) & (signal >= LEAST_SIGNAL))
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    some = place[bucket] >= 0
    d, f, k = doc[some], place[bucket[some]], len(used)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, gaps = x[:k], np.exp(x[k + 1 :])
        m = OrdinalModel(w, x[k] + np.concatenate(([0], np.cumsum(gaps))))
        a, b = around(m, np.bincount(d, w[f], n))
        near = np.maximum(a - b, 1e-12)
        gt = np.bincount(grade, a * (1 - a) / near, top + 1)[1:] - np.bincount(grade, b * (1 - b) / near, top + 1)[:-1]
        tail = np.cumsum(gt[::-1])[::-1]
        gw = np.bincount(f, (a + b - 1)[d], k) + ridge * w
        return float(-np.log(near).sum() + ridge / 2 * (w @ w)), np.concatenate((gw, tail[:1], tail[1:] * gaps))

    x = _lbfgs(loss, np.concatenate((np.zeros(k), theta[:1], np.log(np.diff(theta)))), rounds)
    weights[used] = x[:k]
    return OrdinalModel(weights, x[k] + np.concatenate(([0], np.cumsum(np.exp(x[k + 1 :])))))


def training_rows(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", bound: int = 12_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (text, bucket), labels and word counts of at most ``bound`` labelled documents, those whose hashed ids are smallest.

    ``bound`` is the most that reaches the driver, however many labels and repeated documents there are. Labels that are null or negative,
    and ids labelled in two ways or not among ``docs``, are left out and don't count; a repeated id counts once.
    """
    chosen = labelled_sample(docs, labels, label, F.col("y") >= 0, bound)

    @F.arrow_udf("struct<n:int,f:array<int>>")
    def vector(texts: pa.Array) -> pa.Array:
        doc, bucket, words = sparse_features(texts)
        at = np.searchsorted(doc, np.arange(len(words) + 1)).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(words.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32)))], names=["n", "f"])

    rows = chosen.select("id", "y", vector("text").alias("x")).select("id", "y", "x.n", "x.f").toArrow().combine_chunks()
    rows = rows.sort_by("id")
    lists = rows["f"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().astype(np.int64), rows["y"].to_numpy().astype(np.int64), rows["n"].to_numpy().astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, *, bound: int = 12_000) -> OrdinalModel:
    doc, bucket, y, words = training_rows(docs, labels, bound=bound)
    return fit_ordinal(doc, bucket, grades_of(y, doc, bucket, words))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, bound: int = 12_000, threshold: float = 0.4) -> DataFrame:
    """``doc_id``, ``severity`` (expected grade), ``grade`` (the most that is likelier than not) and ``toxic`` of every document.

    ``toxic`` holds where P(grade > 0) is at least ``threshold``. Each row is scored by itself: repeated rows give
    repeated results and ties need no order. Null and empty texts have severity 0 and aren't toxic. A null id is
    carried. Other columns of ``docs``, whatever their names, play no part. With no usable labels nothing is
    toxic. An empty table gives no rows. Texts of any length are read whole.
    """
    model = fit(docs, labels, bound=bound)
    used = np.flatnonzero(model.weights)
    sent = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), model.weights[used].astype(np.float64), model.thresholds))
    learned = bool(len(used))

    def score(texts: pa.Array) -> pa.Array:
        at, values, thresholds = sent.value
        weights = np.zeros(1 << BITS)
        weights[at] = values
        m = OrdinalModel(weights, thresholds)
        p = m.exceed(m.sums(texts))
        p[np.diff(flat.buffers(texts)[1]) == 0] = 0.0
        return pa.StructArray.from_arrays([pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array((p[:, 0] >= threshold) & learned)], names=["severity", "grade", "toxic"])

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(score, "struct<severity:double,grade:int,toxic:boolean>").asNondeterministic()
    return docs.select(F.col("doc_id"), udf(F.col("text")).alias("__s")).select("doc_id", F.round("__s.severity", 6).alias("severity"), "__s.grade", "__s.toxic")
