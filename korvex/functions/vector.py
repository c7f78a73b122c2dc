"""Vector functions as Column expressions, in double precision. A higher score is always better."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-10
METRICS = {"cosine": "cosine", "l2": "l2", "ip": "ip", "inner_product": "ip"}


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def literal(vector) -> Column:
    """A query vector as an array literal."""
    return F.array(*[F.lit(float(x)) for x in vector])


def inner_product(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def negative_l2(a: Column, b: Column) -> Column:
    return -F.sqrt(l2_squared(a, b))


def cosine_similarity(a: Column, b: Column) -> Column:
    """The denominator is FLOOR at least, so a zero vector scores 0."""
    return inner_product(a, b) / F.greatest(F.sqrt(inner_product(a, a) * inner_product(b, b)), F.lit(FLOOR))


def norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def normalize(v: Column) -> Column:
    """Unit length; a vector of norm FLOOR or less stays as it is."""
    n = norm(v)
    return F.when(n > FLOOR, F.transform(_double(v), lambda x: x / n)).otherwise(_double(v))


def metric_name(metric: str) -> str:
    try:
        return METRICS[metric.lower()]
    except KeyError:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(METRICS)}") from None


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    return {"cosine": cosine_similarity, "l2": negative_l2, "ip": inner_product}[metric_name(metric)](a, b)
