"""Column expressions on vectors.  All sums are sequential and in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def norm2(v: Column | str) -> Column:
    """Squared norm."""
    return _sum(F.transform(as_double(v), lambda x: x * x))


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def sqdist(a: Column | str, b: Column | str) -> Column:
    """Squared L2 distance by direct differences."""
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def sqdist_expanded(na: Column | str, nb: Column | str, ab: Column | str) -> Column:
    """Squared L2 distance from norms and an inner product, not below 0."""
    return F.greatest(_c(na) - 2 * _c(ab) + _c(nb), F.lit(0.0))


def normalize(v: Column | str) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    n = F.sqrt(norm2(v))
    return F.when(n == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / n))


def as_float(v: Column | str) -> Column:
    """Bytes (or any numbers) to single precision."""
    return _c(v).cast("array<float>")


def numeric(x: Column | str) -> Column:
    """A double, or null for what is no number."""
    return _c(x).cast("string").try_cast("double")


def path_part(path: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(_c(path), pattern, group)
