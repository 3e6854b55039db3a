"""Numbers, vectors and dates as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def cosine_distance(similarity: Column, same: Column) -> Column:
    """1 - similarity within [-1, 1], never below 0, and 0 for a pair of one thing with itself."""
    return F.when(same, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - clip(similarity, -1.0, 1.0)))


def expand(v: Column, dims: int, parts: int) -> Column:
    """Each element repeated dims // parts + 1 times, cut to ``dims`` elements."""
    each = dims // parts + 1
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.get(v, F.floor(i / each).cast("int")))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x * k)


def renormalised(v: Column) -> Column:
    """Negative elements as 0, then divided by their sum if that is over 0."""
    pos = F.transform(v, lambda x: F.greatest(F.lit(0.0), x))
    return let(pos, lambda p: let(total(p), lambda s: F.when(s > 0, F.transform(p, lambda x: x / s)).otherwise(p)))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entropy(p: Column) -> Column:
    """Aggregate: natural entropy of shares, those over 0."""
    return F.coalesce(-F.sum(F.when(p > 0, p * F.ln(p))), F.lit(0.0))


def utility(popularity: Column, sentiment: Column, cost: Column, alpha: float, beta: float) -> Column:
    return alpha * popularity + beta * sentiment - cost


def to_time(c: Column) -> Column:
    """A timestamp; null if it can't be read as one."""
    return F.try_to_timestamp(c.cast("string"))


def period(ts: Column, unit: str) -> Column:
    """Calendar window as text: M yyyy-MM, W Monday/Sunday, D yyyy-MM-dd."""
    if unit == "M":
        return F.date_format(ts, "yyyy-MM")
    if unit == "D":
        return F.date_format(ts, "yyyy-MM-dd")
    if unit == "W":
        monday = F.date_trunc("week", ts).cast("date")
        return F.concat(F.date_format(monday, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"))
    raise ValueError(f"unit is M, W or D, not {unit!r}")
