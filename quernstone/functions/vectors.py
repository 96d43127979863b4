"""Vector arithmetic as Column expressions: array<float> in, double out.

All arithmetic is in double, whatever the stored type, so results agree with any engine that does the same.
Smaller distances are closer for every metric; ``dot`` is therefore negated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10
METRICS = ("cosine", "l2", "dot", "manhattan")


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(u: Column, v: Column) -> Column:
    products = F.zip_with(as_double(u), as_double(v), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """v over its norm; a vector of (nearly) zero norm is divided by EPSILON."""
    n = F.greatest(norm(v), F.lit(EPSILON))
    return F.transform(as_double(v), lambda x: x / n)


def cosine_similarity(u: Column, v: Column) -> Column:
    return dot(u, v) / (F.greatest(norm(u), F.lit(EPSILON)) * F.greatest(norm(v), F.lit(EPSILON)))


def cosine_distance(u: Column, v: Column, clipped: bool = False) -> Column:
    """1 - similarity; graph search clips it at 0, exact and cell search do not."""
    d = 1.0 - cosine_similarity(u, v)
    return F.greatest(F.lit(0.0), d) if clipped else d


def euclidean(u: Column, v: Column, squared: bool = False) -> Column:
    gaps = F.zip_with(as_double(u), as_double(v), lambda x, y: (x - y) * (x - y))
    s = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x)
    return s if squared else F.sqrt(s)


def manhattan(u: Column, v: Column) -> Column:
    gaps = F.zip_with(as_double(u), as_double(v), lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x)


def distance(u: Column, v: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return cosine_distance(u, v)
    if metric == "l2":
        return euclidean(u, v)
    if metric == "dot":
        return -dot(u, v)
    if metric == "manhattan":
        return manhattan(u, v)
    raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")


def score(d: Column, metric: str = "cosine") -> Column:
    """A distance as a score between 0 and 1, larger is better."""
    if metric == "cosine":
        return F.least(F.greatest((2.0 - d) / 2.0, F.lit(0.0)), F.lit(1.0))
    if metric in ("l2", "manhattan"):
        return 1.0 / (1.0 + d)
    if metric == "dot":
        return sigmoid(F.greatest(F.least(-d, F.lit(10.0)), F.lit(-10.0)))
    raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")


def sigmoid(x: Column, limit: float = 20.0) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))))


def valid(v: Column, dim: int, metric: str = "cosine") -> Column:
    """Whether a vector may be stored: the right length, all finite, and for cosine a norm that is not zero."""
    fine = v.isNotNull() & (F.size(v) == dim) & ~F.exists(as_double(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return fine & (norm(v) > 0) if metric == "cosine" else fine


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-up on the binary value, the same in any engine with IEEE doubles."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale
