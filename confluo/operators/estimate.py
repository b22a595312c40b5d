"""Fixed-effects least squares, clustered errors and two-stage least squares.

Regressors and outcome are freed of the fixed effects by alternating projections; coefficients come from the normal
equations and errors from sums of scores by cluster. ``fit`` works on arrays, for a sample that one task holds.
``fe_ols`` does the same to a DataFrame of any size: demeaning by grouped means, then sums of products.

Small-sample factor of a cluster variance: G/(G-1) * (n-1)/(n-k), with k the regressors, one, and the levels but one
of each fixed effect that isn't nested in the clusters. With several cluster variables the variances add by
inclusion and exclusion, each with the factor of its own G.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.student import p_value, quantile
from confluo.session import cut, free_name


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    variance: np.ndarray
    n: int
    n_clusters: int
    dropped: list[str]
    first_stage_f: float | None = None

    def tidy(self) -> list[dict]:
        se = np.sqrt(np.maximum(np.diag(self.variance), 0))
        df, rows = self.n_clusters - 1, []
        wide = quantile(0.95, df)
        for name, b, s in zip(self.names, self.beta, se):
            t = b / s if s > 0 else (np.inf * np.sign(b) if b else np.nan)
            rows.append({"term": name, "estimate": float(b), "std_error": float(s), "t_value": float(t), "p_value": p_value(float(t), df), "conf_low": float(b - wide * s), "conf_high": float(b + wide * s)})
        return rows


def _codes(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].ravel()


def keep_repeated(fes: Sequence[np.ndarray]) -> np.ndarray:
    """Rows that stay when levels of a fixed effect with one row go, again and again until there are none."""
    keep = np.ones(len(fes[0]) if fes else 0, bool)
    while True:
        once = np.zeros(len(keep), bool)
        for f in fes:
            c = _codes(f[keep])
            once[np.flatnonzero(keep)[np.bincount(c)[c] == 1]] = True
        if not once.any():
            return keep
        keep &= ~once


def demean_arrays(values: np.ndarray, fes: Sequence[np.ndarray], tol: float = 1e-12, rounds: int = 10_000) -> np.ndarray:
    """Columns without the means of the fixed effects' levels."""
    out = values.astype(float).copy()
    codes = [_codes(f) for f in fes]
    counts = [np.bincount(c) for c in codes]
    scale = np.maximum(np.abs(out).max(0, initial=0), 1e-300)
    for _ in range(rounds):
        moved = 0.0
        for c, n in zip(codes, counts):
            means = np.stack([np.bincount(c, out[:, k]) / n for k in range(out.shape[1])], 1) if out.shape[1] else np.zeros((len(n), 0))
            out -= means[c]
            moved = max(moved, float((np.abs(means).max(0, initial=0) / scale).max(initial=0)))
        if len(codes) < 2 or moved < tol:
            break
    return out


def independent(gram: np.ndarray, scale: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Columns that aren't, but for ``tol``, combinations of those before them. ``scale`` is their squared size before demeaning."""
    keep: list[int] = []
    for k in range(len(gram)):
        rest = gram[k, k]
        if keep:
            g = gram[np.ix_(keep, keep)]
            rest = rest - gram[k, keep] @ np.linalg.solve(g, gram[keep, k])
        if rest > tol * max(scale[k], 1e-300):
            keep.append(k)
    return keep


def _subsets(n: int) -> list[tuple[int, ...]]:
    return [s for size in range(1, n + 1) for s in combinations(range(n), size)]


def fit(y: np.ndarray, x: np.ndarray, names: Sequence[str], fes: Sequence[np.ndarray], clusters: Sequence[np.ndarray], *, endogenous: np.ndarray | None = None, instruments: np.ndarray | None = None, endogenous_name: str = "endogenous") -> Fit:
    """Least squares of y on x with fixed effects; with an endogenous column and instruments, two-stage least squares (the endogenous comes first)."""
    columns = [y[:, None], x] + ([endogenous[:, None], instruments] if endogenous is not None else [])
    data = np.column_stack(columns).astype(float)
    keep = keep_repeated(fes) if fes else np.ones(len(y), bool)
    fes, clusters = [f[keep] for f in fes], [_codes(c[keep]) for c in clusters]
    raw = data[keep]
    if not len(raw):
        raise ValueError("no observations are left")
    d = demean_arrays(raw, fes) if fes else raw
    n, kx = len(d), x.shape[1]
    y_, x_ = d[:, 0], d[:, 1 : 1 + kx]
    keep_x = independent(x_.T @ x_, (raw[:, 1 : 1 + kx] ** 2).sum(0)) if kx else []
    dropped = [names[k] for k in range(kx) if k not in keep_x]
    x_, used = x_[:, keep_x], [names[k] for k in keep_x]
    f_stat = None
    if endogenous is None:
        fitted = actual = x_
    else:
        e_, z_ = d[:, 1 + kx], d[:, 2 + kx :]
        both = np.column_stack((x_, z_))
        pick = independent(both.T @ both, (both**2).sum(0), 1e-12)
        both = both[:, pick]
        pi = np.linalg.solve(both.T @ both, both.T @ e_)
        restricted = e_ - x_ @ np.linalg.solve(x_.T @ x_, x_.T @ e_) if x_.shape[1] else e_
        q = both.shape[1] - x_.shape[1]
        rest = e_ - both @ pi
        df = n - both.shape[1] - sum(len(np.unique(f)) - 1 for f in fes) - bool(fes)
        f_stat = float(((restricted @ restricted - rest @ rest) / q) / max(rest @ rest / max(df, 1), 1e-300)) if q > 0 else None
        fitted, actual = np.column_stack((both @ pi, x_)), np.column_stack((e_, x_))
        used = [endogenous_name, *used]
    if not used:
        raise ValueError("no regressor is left")
    bread = np.linalg.inv(fitted.T @ fitted)
    beta = bread @ (fitted.T @ y_)
    scores = fitted * (y_ - actual @ beta)[:, None]
    # A fixed effect is nested in clusters if it has as many levels alone as together with them.
    nested = [any(len(np.unique(codes * (int(c.max()) + 1) + c)) == codes.max() + 1 for c in clusters) for codes in map(_codes, fes)]
    k = len(used) + 1 + sum(len(np.unique(f)) - 1 for f, inside in zip(fes, nested) if not inside)
    variance, least = np.zeros((len(used), len(used))), None
    for subset in _subsets(len(clusters)):
        c = _codes(np.unique(np.stack([clusters[i] for i in subset], 1), axis=0, return_inverse=True)[1].ravel())
        g = int(c.max()) + 1
        sums = np.stack([np.bincount(c, scores[:, j]) for j in range(scores.shape[1])], 1)
        factor = (g / (g - 1) if g > 1 else np.nan) * (n - 1) / max(n - k, 1)
        variance += (-1) ** (len(subset) + 1) * factor * bread @ (sums.T @ sums) @ bread
        least = g if len(subset) == 1 and (least is None or g < least) else least
    return Fit(used, beta, variance, n, least or n, dropped, f_stat)


def demean_columns(df: DataFrame, values: Sequence[str], fes: Sequence[str], *, tol: float = 1e-8, rounds: int = 200) -> DataFrame:
    """The table with ``values`` freed of the fixed effects' means.

    One fixed effect takes one pass. With more, passes go on until the largest mean that is taken off is under ``tol`` of the column's spread.
    """
    def once(d: DataFrame) -> DataFrame:
        for f in fes:
            mean = {v: free_name(d, f"__confluo_{v}") for v in values}
            means = d.groupBy(f).agg(*[F.avg(v).alias(m) for v, m in mean.items()])
            d = d.join(means, f).select(*[c for c in d.columns if c not in values], *[(F.col(v) - F.col(m)).alias(v) for v, m in mean.items()])
        return d

    df = df.withColumns({v: F.col(v).cast("double") for v in values}).dropna(subset=[*values, *fes])
    if len(fes) < 2:
        return once(df) if fes else df
    now = cut(df)
    spread = now.agg(*[F.stddev_pop(v).alias(v) for v in values]).first()
    for _ in range(rounds):
        now = cut(once(now))
        off = [now.groupBy(f).agg(*[F.avg(v).alias(v) for v in values]).agg(*[F.max(F.abs(F.col(v))).alias(v) for v in values]).first() for f in fes]
        if all((o[v] or 0) <= tol * max(spread[v] or 0, 1e-12) for o in off for v in values):
            break
    return now


def _gram(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    row = df.agg(*[F.sum(F.col(a) * F.col(b)) for a in left for b in right]).first()
    return np.array([x or 0.0 for x in row], float).reshape(len(left), len(right))


def complete_sample(df: DataFrame, columns: Sequence[str], fes: Sequence[str]) -> DataFrame:
    """Complete rows, without levels of a fixed effect that have one row, again and again until there are none."""
    sample = df.select(*dict.fromkeys(columns)).dropna()
    while fes:
        left = sample
        for f in fes:
            left = left.join(left.groupBy(f).count().where("count > 1").select(f), f, "left_semi")
        left = cut(left)
        if left.count() == sample.count():
            break
        sample = left
    return sample


def _clustered(d: DataFrame, scores: Sequence[Column], bread: np.ndarray, fes: Sequence[str], clusters: Sequence[str], n: int) -> tuple[np.ndarray, int]:
    """Variance by clusters from the scores of each row, and the number of clusters."""
    names = [f"__s{k}" for k in range(len(scores))]
    scored = d.select(*dict.fromkeys(clusters), *[s.alias(x) for s, x in zip(scores, names)])
    k = len(scores) + 1
    for f in fes:
        nested = any(d.select(f, c).distinct().groupBy(f).count().where("count > 1").isEmpty() for c in clusters)
        k += 0 if nested else d.select(f).distinct().count() - 1
    variance, least = np.zeros((len(scores), len(scores))), None
    for subset in _subsets(len(clusters)):
        sums = cut(scored.groupBy(*[clusters[i] for i in subset]).agg(*[F.sum(s).alias(s) for s in names]))
        g = sums.count()
        factor = (g / (g - 1) if g > 1 else np.nan) * (n - 1) / max(n - k, 1)
        variance += (-1) ** (len(subset) + 1) * factor * bread @ _gram(sums, names, names) @ bread
        least = g if len(subset) == 1 and (least is None or g < least) else least
    return variance, least or n


def _combined(weights: np.ndarray, columns: Sequence[str]) -> Column:
    return sum((F.lit(float(w)) * F.col(c) for w, c in zip(weights, columns)), F.lit(0.0))


def fe_ols(df: DataFrame, y: str, xs: Sequence[str], fes: Sequence[str], clusters: Sequence[str]) -> Fit:
    """Fixed-effects least squares of a table of any size. What reaches the driver are sums of products of the regressors."""
    sample = complete_sample(df, [y, *xs, *fes, *clusters], fes)
    scale = np.diag(_gram(sample, xs, xs))
    d = cut(demean_columns(sample, [y, *xs], fes))
    n = d.count()
    if not n:
        raise ValueError("no observations are left")
    gram = _gram(d, xs, xs)
    keep = independent(gram, scale)
    used = [xs[k] for k in keep]
    if not used:
        raise ValueError("no regressor is left")
    bread = np.linalg.inv(gram[np.ix_(keep, keep)])
    beta = bread @ _gram(d, used, [y]).ravel()
    residual = F.col(y) - _combined(beta, used)
    variance, clusters_ = _clustered(d, [F.col(x) * residual for x in used], bread, fes, clusters, n)
    return Fit(used, beta, variance, n, clusters_, [xs[j] for j in range(len(xs)) if j not in keep])


def fe_iv(df: DataFrame, y: str, endogenous: str, instruments: Sequence[str], xs: Sequence[str], fes: Sequence[str], clusters: Sequence[str]) -> Fit:
    """Two-stage least squares with fixed effects of a table of any size; the endogenous regressor comes first.

    Both stages come from one matrix of sums of products of the demeaned columns. The first-stage F compares it with and without the
    instruments. Instruments that are combinations of others or of ``xs`` are left out.
    """
    sample = complete_sample(df, [y, endogenous, *instruments, *xs, *fes, *clusters], fes)
    columns = [y, endogenous, *xs, *instruments]
    scale = np.diag(_gram(sample, columns, columns))
    d = cut(demean_columns(sample, columns, fes))
    n = d.count()
    if not n:
        raise ValueError("no observations are left")
    all_ = _gram(d, columns, columns)
    place = {c: k for k, c in enumerate(columns)}
    pick = lambda a, b: all_[np.ix_([place[x] for x in a], [place[x] for x in b])]
    outer = [*xs, *instruments]
    kept = [outer[k] for k in independent(pick(outer, outer), scale[2:])]
    used_x, used_z = [x for x in xs if x in kept], [z for z in instruments if z in kept]
    if not used_z:
        raise ValueError("no instrument is left")
    first = [*used_x, *used_z]
    pi = np.linalg.solve(pick(first, first), pick(first, [endogenous])).ravel()
    e2 = float(pick([endogenous], [endogenous])[0, 0])
    rest = e2 - pi @ pick(first, [endogenous]).ravel()
    alone = e2 - (pick([endogenous], used_x) @ np.linalg.solve(pick(used_x, used_x), pick(used_x, [endogenous])))[0, 0] if used_x else e2
    df_ = n - len(first) - sum(d.select(f).distinct().count() - 1 for f in fes) - bool(fes)
    f_stat = float((alone - rest) / len(used_z) / max(rest / max(df_, 1), 1e-300))
    # Fitted regressors are combinations of the first stage's: the endogenous by pi, the others themselves.
    load = np.column_stack((pi, *[np.eye(len(first))[:, k] for k in range(len(used_x))]))
    bread = np.linalg.inv(load.T @ pick(first, first) @ load)
    beta = bread @ (load.T @ pick(first, [y])).ravel()
    residual = F.col(y) - _combined(beta, [endogenous, *used_x])
    variance, clusters_ = _clustered(d, [_combined(load[:, k], first) * residual for k in range(load.shape[1])], bread, fes, clusters, n)
    return Fit([endogenous, *used_x], beta, variance, n, clusters_, [x for x in xs if x not in used_x], f_stat)


def with_interactions(df: DataFrame, xs: Sequence[str], by: str, levels: Sequence[object] | None = None) -> tuple[DataFrame, list[str]]:
    """A column ``x_by_level`` for each regressor and each of ``levels``: the regressor where ``by`` is that level, else 0. Where ``by`` is null, null.

    Without ``levels`` a number is multiplied with, as ``x_by``.
    """
    if levels is None:
        names = {f"{x}_{by}": F.col(x) * F.col(by) for x in xs}
    else:
        names = {f"{x}_{by}_{level}": F.when(F.col(by).isNotNull(), F.col(x) * (F.col(by) == F.lit(level)).cast("double")) for x in xs for level in levels}
    taken = [n for n in names if n in df.columns]
    if taken:
        raise ValueError(f"the table has {', '.join(taken)} already")
    return df.withColumns(names), list(names)


def fit_subsamples(df: DataFrame, by: str, levels: Sequence[object], model: Callable[[DataFrame], Fit]) -> dict[object, Fit | None]:
    """A model of the rows of each level; None for a level in which it can't be fitted. The levels are a short list that is given."""
    out: dict[object, Fit | None] = {}
    for level in levels:
        try:
            out[level] = model(df.where(F.col(by) == F.lit(level)))
        except ValueError:
            out[level] = None
    return out


def impute_for_model(df: DataFrame, unit: str, period: str, columns: Sequence[str], *, most_missing: float = 0.05) -> DataFrame:
    """Rows that a model can use: units with at most ``most_missing`` of every column missing, gaps between two values filled in a straight line, and then complete rows."""
    from functools import reduce

    from confluo.operators.windows import interpolate, share_null

    shares = df.groupBy(unit).agg(*[share_null(c).alias(f"s{k}") for k, c in enumerate(columns)])
    kept = df.join(shares.where(reduce(lambda a, b: a & b, [F.col(f"s{k}") <= most_missing for k in range(len(columns))])).select(unit), unit, "left_semi")
    for c in columns:
        made = free_name(kept, f"__confluo_{c}")
        kept = interpolate(kept, unit, period, c, made, extend=False).withColumn(c, F.col(made)).drop(made)
    return kept.dropna(subset=list(columns))
