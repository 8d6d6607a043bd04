"""Score and embedding arrays as column expressions; all run inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_normalise(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / norm)


def logsumexp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.ln(total(F.transform(a, lambda x: F.exp(x - top))))


def log_softmax(a: Column) -> Column:
    lse = logsumexp(a)
    return F.transform(a, lambda x: x - lse)


def softmax(a: Column) -> Column:
    return F.transform(log_softmax(a), F.exp)


def argmax(a: Column) -> Column:
    """Index of the first largest value, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top_k(a: Column, k: int) -> Column:
    """The k best (score, index), of equal scores the lowest index first."""
    pairs = F.transform(a, lambda x, i: F.struct((-x).alias("neg"), i.alias("idx")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["neg"]).alias("score"), p["idx"].alias("idx")))


def angle_score(cosine: Column, dims: int) -> Column:
    """z-score of the angle: sqrt(d - 2) * (acos(-cos) - pi / 2)."""
    inside = F.greatest(F.least(cosine, F.lit(1 - 1e-7)), F.lit(-1 + 1e-7))
    return math.sqrt(dims - 2) * (F.acos(-inside) - math.pi / 2)


def angle_cosine(z: Column, dims: int) -> Column:
    return F.sin(z / math.sqrt(dims - 2))


def entropy(a: Column) -> Column:
    return -total(F.transform(log_softmax(a), lambda x: F.exp(x) * x))


def margin(a: Column) -> Column:
    ordered = F.array_sort(F.transform(a, lambda x: -x))
    return F.get(ordered, F.lit(1)) - F.get(ordered, F.lit(0))


#: Rules of novelty, signed so that higher means more novel.
NOVELTY = {
    "max": lambda a: -F.array_max(a),
    "energy": lambda a: -logsumexp(a),
    "msp": lambda a: -F.array_max(softmax(a)),
    "entropy": entropy,
    "margin": lambda a: -margin(a),
}
