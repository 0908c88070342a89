"""Vector arithmetic on ARRAY columns, in double precision and in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits that distances keep before the smallest is chosen, so that plans that add in another order agree on ties.
TIE_DIGITS = 9
EPS = 1e-12


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sq_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(EPS))
    return F.transform(v, lambda x: x / n)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subvector(v: Column, m: Column | int, size: int) -> Column:
    """Part m (from 0) of parts of ``size`` components."""
    m = F.lit(m) if isinstance(m, int) else m
    return F.slice(v, m * size + 1, F.lit(size))


def check_parts(dim: int, parts: int) -> int:
    """Components in each part; a part count that does not divide the dimension is an error."""
    if parts <= 0 or dim % parts:
        raise ValueError(f"{dim} components cannot be cut into {parts} equal parts")
    return dim // parts
