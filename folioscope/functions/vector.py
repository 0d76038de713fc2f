"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """1 less the cosine distance; null where a norm is 0. Norms may be given, computed once a row."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size > 0, dot(a, b) / size)


def quantised(a, digits: int = 6) -> Column:
    """Components to ``digits`` digits, with their signs: a negative one too small for them is -0.0."""
    return F.transform(a, lambda x: F.abs(F.round(x.cast("double"), digits)) * F.signum(x.cast("double")))
