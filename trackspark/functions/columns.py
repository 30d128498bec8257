"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def track() -> WindowSpec:
    """The rows of one object in order of time."""
    return Window.partitionBy("object_id").orderBy("time")


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(squared(a, b))


def squared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    dx, dy, dz = (p - q for p, q in zip(a, b))
    return dx * dx + dy * dy + dz * dz


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def non_zero(c: Column) -> Column:
    """``c``, or null where it is 0."""
    return F.when(c != 0, c)


def middle(values: Column, of: Callable[[Column], Column] = lambda v: v) -> Column:
    """Median of an array in order, or of a rising function of its values; null if it is empty."""
    n = F.size(values)
    return (of(F.get(values, F.floor((n - 1) / 2).cast("int"))) + of(F.get(values, F.floor(n / 2).cast("int")))) / 2


def angle(u: Sequence[Column], v: Sequence[Column]) -> Column:
    """Degrees between two vectors; null if either has no length."""
    dot = sum((p * q for p, q in zip(u[1:], v[1:])), u[0] * v[0])
    norms = F.sqrt(sum((p * p for p in u[1:]), u[0] * u[0])) * F.sqrt(sum((q * q for q in v[1:]), v[0] * v[0]))
    cosine = F.try_divide(dot, norms)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) + F.lit(0.0) * cosine)
