"""Column expressions on numbers: finite values, transforms, kernels, buckets and weights. All are null-safe and raise nothing under ANSI rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

KERNELS = ("uniform", "triangular", "epanechnikov", "gaussian", "exponential")
#: Name and upper edge in km; each bucket holds its upper edge, the first one zero too.
BUCKETS = (("0_10km", 10.0), ("10_50km", 50.0), ("50_100km", 100.0), ("100_250km", 250.0), ("250_500km", 500.0), ("500km_plus", None))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value as a double; NaN and infinities become null."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def number(c: Column | str) -> Column:
    """Text as a finite double, null where it is none."""
    return finite(col(c).cast("string").try_cast("double"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def log10_1p(c: Column | str) -> Column:
    x = finite(c)
    return F.when(x >= 0, F.log10(1.0 + x))


def log10_positive(c: Column | str) -> Column:
    x = finite(c)
    return F.when(x > 0, F.log10(x))


def transform(c: Column | str, name: str) -> Column:
    """``identity``, ``log10_1p`` (null below 0) or ``log10`` (null up to 0)."""
    known = {"identity": finite, "log10_1p": log10_1p, "log10": log10_positive}
    if name not in known:
        raise ValueError(f"unknown transform {name!r}; known are {sorted(known)}")
    return known[name](c)


def kernel_weight(distance: Column | str, bandwidth: float, kind: str) -> Column:
    """Weight of a distance. Uniform, triangular and Epanechnikov end at the bandwidth; the Gaussian is exp(-(d/h)**2)."""
    u = F.abs(col(distance).cast("double")) / float(bandwidth)
    inside = lambda w: F.when(u <= 1, w).when(u > 1, 0.0)
    if kind == "uniform":
        return inside(F.lit(1.0))
    if kind == "triangular":
        return inside(1 - u)
    if kind == "epanechnikov":
        return inside(0.75 * (1 - u * u))
    if kind == "gaussian":
        return F.exp(-u * u)
    if kind == "exponential":
        return F.exp(-u)
    raise ValueError(f"unknown kernel {kind!r}; known are {KERNELS}")


def triangular_weight(distance: Column | str, radius: float) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - col(distance).cast("double") / float(radius))


def cutoff_weight(distance: Column | str, reach: float, kind: str = "exponential") -> Column:
    """Weight up to ``reach`` and 0 beyond it: ``linear`` falls to 0 there, ``exponential`` decays by e over a fifth of it, ``inverse`` is 1/d."""
    d = col(distance).cast("double")
    forms = {"linear": 1 - d / reach, "exponential": F.exp(-5 * d / reach), "inverse": F.try_divide(F.lit(1.0), d)}
    if kind not in forms:
        raise ValueError(f"unknown weight {kind!r}; known are {sorted(forms)}")
    return F.when((d >= 0) & (d <= reach), forms[kind]).when(d.isNotNull(), 0.0)


def distance_bucket(distance: Column | str, buckets: Sequence[tuple[str, float | None]] = BUCKETS) -> Column:
    """Name of the right-closed bucket of a distance; null for negative and null ones."""
    d = col(distance)
    out = F.when(d < 0, None)
    for name, edge in buckets:
        out = out.when(d.isNotNull() if edge is None else d <= edge, name)
    return out


def half_open_bin(value: Column | str, width: float, bins: int | None = None) -> Column:
    """Number of the bin [k width, (k+1) width); with ``bins``, the last one is open to the right."""
    k = F.floor(col(value) / float(width)).cast("long")
    return k if bins is None else F.least(k, F.lit(bins - 1).cast("long"))


def row_mean(columns: Sequence[Column | str]) -> Column:
    """Mean over the columns of a row that aren't null."""
    cols = [col(c).cast("double") for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.try_divide(total, sum((c.isNotNull().cast("int") for c in cols), F.lit(0)))


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    x = col(c)
    y = x if low is None else F.greatest(x, F.lit(low))
    y = y if high is None else F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def wrap_longitude(c: Column | str) -> Column:
    x = col(c)
    return F.when(x > 180, x - 360).otherwise(x)


def class_id(major: Column | str, minor: Column | str) -> Column:
    """``10 * major + minor``; null if either is."""
    return col(major).cast("int") * 10 + col(minor).cast("int")


def quality_rank(flag: Column | str) -> Column:
    """How far a quality flag is to be trusted: 999 - n for a number n, 1000 for approval, 100 for doubt, else 0."""
    text = F.upper(F.trim(col(flag).cast("string")))
    n = text.try_cast("double")
    good = "APPROVED APROVADO CONSISTED CONSISTIDA CONSISTIDO GOOD OK VALID VALIDO".split()
    return F.when(n.isNotNull(), 999 - n).when(text.isin(good), 1000.0).when(text.isin("REVIEW", "SUSPECT", "SUSPEITO"), 100.0).otherwise(0.0)
