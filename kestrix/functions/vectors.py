"""Array-of-double arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def scale(k: Column, x: Column) -> Column:
    return F.transform(x, lambda a: a * k)


def norm(x: Column, p: float = 2) -> Column:
    if math.isinf(p):
        return F.array_max(F.transform(x, lambda a: F.abs(a.cast("double"))))
    if p == 2:
        return F.sqrt(dot(x, x))
    return F.pow(total(F.transform(x, lambda a: F.pow(F.abs(a.cast("double")), F.lit(float(p))))), F.lit(1.0 / p))


def distance(x: Column, y: Column, p: float = 2) -> Column:
    return norm(F.zip_with(x, y, lambda a, b: a.cast("double") - b.cast("double")), p)


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    size = norm(x) * norm(y)
    return F.when(size == 0, 0.0).otherwise(dot(x, y) / size)


def normalize(x: Column) -> Column:
    n = norm(x)
    return F.transform(x, lambda a: a / F.nullif(n, F.lit(0.0)))


def angle(x: Column, y: Column, degrees: bool = False) -> Column:
    out = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(x, y))))
    return F.degrees(out) if degrees else out


def linear_combination(coefficients: list[float], vectors: list[Column]) -> Column:
    out = None
    for k, v in zip(coefficients, vectors):
        out = scale(F.lit(float(k)), v) if out is None else add(out, scale(F.lit(float(k)), v))
    return out


def is_orthogonal(x: Column, y: Column, tol: float = 1e-10) -> Column:
    return F.abs(dot(x, y)) < tol


def is_unit(x: Column, tol: float = 1e-10) -> Column:
    return F.abs(norm(x) - 1) < tol


def all_pairs(left: DataFrame, right: DataFrame, few: int = 4096) -> DataFrame:
    """Each row of left with each of right, where that is what is asked for. The right side is broadcast where it has
    at most `few` rows; else it is dealt in blocks, and blocks meet by an equi-join."""
    if right.limit(few + 1).count() <= few:
        return left.crossJoin(F.broadcast(right))
    n = 64
    cells = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda d, c: F.pmod(F.xxhash64(*d.columns), F.lit(n)).cast("int").alias(c)
    x = left.select("*", block(left, "__i")).withColumn("__j", cells)
    y = right.select("*", block(right, "__j")).withColumn("__i", cells)
    return x.join(y, ["__i", "__j"]).drop("__i", "__j")
