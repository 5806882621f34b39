"""Vector arithmetic as column expressions; doubles, folded left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: a lambda's variable isn't copied as an expression is."""
    return F.transform(F.array(value), use)[0]


def normalise(a: Column) -> Column:
    """Unit vector; the norm is taken as at least 1e-12, so a zero vector stays one."""
    length = F.greatest(norm(a), F.lit(1e-12))
    return _once(F.struct(a.alias("v"), length.alias("n")), lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))


def centre(a: Column, mean: Column) -> Column:
    """``a`` less ``mean``, at unit length."""
    return _once(F.zip_with(a, mean, lambda x, m: x.cast("double") - m.cast("double")), normalise)


def is_finite(a: Column) -> Column:
    """No null, NaN or infinite element, and not all zero."""
    good = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return a.isNotNull() & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(a, lambda x: x != 0), F.lit(False))
