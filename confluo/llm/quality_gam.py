"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn. Each step fits one tree of at most three leaves to the
current gradients of a single feature's bins and adds it to that feature's lookup table. The pairs
whose 2-D bins explain most of what is left then get tables of their own, learned by depth-2 trees.
A score is a sum of table entries: one ``searchsorted`` a feature and one gather a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm import flat
from confluo.llm.labelled import labelled_sample
from confluo.llm.names import free_name

FEATURES = (
    "log_words", "word_length", "symbol_share", "upper_share", "digit_share", "punct_share", "pipe_share", "bang_share",
    "repeat_share", "distinct_share", "line_repeat_share", "words_per_line", "non_ascii_share", "longest_word",
)

_CLASS = {
    "symbol": b"#$%&*+=<>@^_~`\\{}[]/", "upper": bytes(range(65, 91)), "digit": b"0123456789", "punct": b".,;:?!'\"()-",
    "pipe": b"|", "bang": b"!",
}
_LUT = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)).astype(np.uint8) for k, v in _CLASS.items()}


def _features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    n, size = len(off) - 1, np.diff(off)
    folded = flat.fold(raw)
    starts, ends, doc = flat.words(folded, off)
    n_words = np.bincount(doc, minlength=n)
    word_off = np.concatenate(([0], np.cumsum(n_words)))
    h = flat.span_hashes(folded, starts, ends)
    length = ends - starts
    bytes_, words_ = np.maximum(size, 1), np.maximum(n_words, 1)
    share = {k: flat.per_doc(lut[raw], off) / bytes_ for k, lut in _LUT.items()}
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    once, _ = flat.distinct_per_doc(doc, h)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    breaks = np.flatnonzero(raw == 10)
    line_start = np.union1d(off[:-1][size > 0], breaks + 1)
    line_start = line_start[line_start < len(raw)]
    line_end = np.append(line_start[1:], len(raw)).astype(np.int64)
    line_doc = np.searchsorted(off, line_start, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    line_once, _ = flat.distinct_per_doc(line_doc, flat.span_hashes(raw, line_start, line_end))
    lines_ = np.maximum(lines, 1)
    return np.column_stack([
        np.log1p(n_words), flat.per_doc(length, word_off) / words_, share["symbol"], share["upper"], share["digit"], share["punct"],
        share["pipe"], share["bang"], flat.per_doc(again, word_off) / words_, np.bincount(once, minlength=n) / words_,
        1 - np.bincount(line_once, minlength=n) / lines_ * (lines > 0) - (lines == 0), np.minimum(n_words / lines_, 1e4),
        flat.per_doc((raw >= 128).astype(np.int64), off) / bytes_, np.minimum(longest, 1e3),
    ])


def features(texts: pa.Array) -> np.ndarray:
    """One row of :data:`FEATURES` for each text; null and empty texts give a row of zeros."""
    raw, off = flat.buffers(texts)
    parts = [_features(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in flat.slices(off)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class GamModel:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that a text is good."""
        out = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for p in self.pairs for k in p}
        for (a, b), t in zip(self.pairs, self.pair_tables):
            out += t[coarse[a], coarse[b]]
        return out


def _bins(column: np.ndarray, most: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, most + 1)[1:-1])) if len(column) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, lam: float) -> np.ndarray:
    """Leaf values over a row of bins, with up to ``leaves`` leaves found by best-first splits."""
    spans, cg, ch = [(0, len(g))], np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + lam)
    while len(spans) < leaves:
        best = (1e-12, None, None)
        for k, (a, b) in enumerate(spans):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = gain_of(a, c) + gain_of(c, b) - gain_of(a, b)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], k, int(c[i]))
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + lam)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    """A depth-2 tree over 2-D bins: one cut of the first axis, then one of the second on each side."""
    best, value = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, gg.shape[0]):
            gain, v = 0.0, np.zeros_like(gg)
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = gg[part].sum(0), hh[part].sum(0)
                leaf = _tree(pg, ph, 2, lam)
                gain += float((-leaf * pg - 0.5 * leaf**2 * (ph + lam / max(len(pg), 1))).sum())
                v[part] = leaf
            if gain > best:
                best, value = gain, v if axis == 0 else v.T
    return value, best


def fit_gam(x: np.ndarray, y: np.ndarray, *, bins: int = 32, pair_bins: int = 6, rounds: int = 150, pair_rounds: int = 20, n_pairs: int = 5, rate: float = 0.1, leaves: int = 3, lam: float = 4.0) -> GamModel:
    """Fit to rows ``x`` and 0/1 labels ``y``. With no rows, or one class only, the tables stay 0 and the base says that class."""
    k = len(FEATURES) if x.ndim < 2 or not len(x) else x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    edges = [_bins(x[:, j], bins) if len(x) else np.zeros(0) for j in range(k)]
    coarse_edges = [_bins(x[:, j], pair_bins) if len(x) else np.zeros(0) for j in range(k)]
    model = GamModel(edges, [np.zeros(len(e) + 1) for e in edges], pair_edges=coarse_edges, base=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    code = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    f = np.full(len(y), model.base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(k):
            g, h = gradients()
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(code[j], g, size), np.bincount(code[j], h, size), leaves, lam)
            model.tables[j] += step
            f += step[code[j]]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse_edges)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = gradients()
    ranked = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h), lam)[1], a, b) for a, b in combinations(range(k), 2)), key=lambda t: (-t[0], t[1:]))
    model.pairs = [(a, b) for gain, a, b in ranked[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for i, (a, b) in enumerate(model.pairs):
            g, h = gradients()
            step = rate * _pair_tree(grid(a, b, g), grid(a, b, h), lam)[0]
            model.pair_tables[i] += step
            f += step[coarse[a], coarse[b]]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, *, label: str = "quality", bound: int = 8000) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``bound`` labelled documents, those whose hashed ids are smallest.

    ``bound`` is the most that reaches the driver, however many labels and repeated documents there are. Labels that are null, and
    ids labelled both ways or not among ``docs``, are left out and don't count; a repeated id counts once.
    """
    chosen = labelled_sample(docs, labels, label, F.col("y").isin(0, 1), bound)

    @F.arrow_udf("array<double>")
    def vector(texts: pa.Array) -> pa.Array:
        x = features(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    rows = chosen.select("id", "y", vector("text").alias("x")).toArrow()
    order = np.argsort(rows["id"].to_numpy()) if rows.num_rows else []
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))[order]
    y = rows["y"].to_numpy().astype(float)[order] if rows.num_rows else np.zeros(0)
    return x, y


def scorer(model: GamModel, threshold: float):
    """An Arrow UDF of a text column: struct of the probability that a text is good, and whether it is kept."""

    def score(texts: pa.Array) -> pa.Array:
        p = 1 / (1 + np.exp(-model.score(features(texts))))
        empty = np.diff(flat.buffers(texts)[1]) == 0
        p[empty] = 0.0
        return pa.StructArray.from_arrays([pa.array(p), pa.array((p >= threshold) & ~empty)], names=["p", "keep"])

    # Annotations of a nested function are strings under postponed evaluation; Spark wants the types.
    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # Declared non-deterministic so that a filter on the result doesn't make Spark score each text twice.
    return F.arrow_udf(score, "struct<p:double,keep:boolean>").asNondeterministic()


def score_quality(docs: DataFrame, labels: DataFrame, *, bound: int = 8000, threshold: float = 0.35) -> DataFrame:
    """``doc_id``, ``p_good`` and ``keep`` of every document.

    Each row is scored by itself: repeated rows give repeated results and ties need no order. A null or
    empty text has ``p_good`` 0 and isn't kept. A null id is carried. Other columns of ``docs``, whatever
    their names, play no part. With no usable labels every non-empty text scores 0.5 and is kept. Texts of any length are read
    whole.
    """
    udf = scorer(fit_gam(*training_rows(docs, labels, bound=bound)), threshold)
    return docs.select(F.col("doc_id"), udf(F.col("text")).alias("__q")).select("doc_id", F.round("__q.p", 6).alias("p_good"), F.col("__q.keep").alias("keep"))


def filter_quality(docs: DataFrame, labels: DataFrame, *, bound: int = 8000, threshold: float = 0.35) -> DataFrame:
    """The rows of ``docs`` that :func:`score_quality` keeps, all columns as they were. Null and empty texts go."""
    udf = scorer(fit_gam(*training_rows(docs, labels, bound=bound)), threshold)
    q = free_name(docs, "__confluo_q")
    return docs.withColumn(q, udf(F.col("text"))).where(F.col(q)["keep"]).drop(q)
