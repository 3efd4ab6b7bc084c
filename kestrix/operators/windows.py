"""Global order without a single task: running totals and row numbers over a bucketed key.

A window over a whole table puts all rows in one partition. Here rows are cut into buckets that
follow the order; totals of the buckets before (a few rows) are added to what a window within
each bucket gives.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import stored


def running_totals(df: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds each named running total, in the given order; `bucket` must not fall along it."""
    df = df.withColumn("__b", bucket)
    each = df.groupBy("__b").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    each = each.select("__b", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    inside = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__i_{n}": F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(each), "__b")
    return df.withColumns({n: F.col(f"__o_{n}") + F.col(f"__i_{n}") for n in sums}).drop("__b", *[f"__{k}_{n}" for n in sums for k in "oi"])


def row_numbers(df: DataFrame, bucket: Column, order: list[Column], name: str = "rn") -> DataFrame:
    """Adds row numbers from 1 in the given order."""
    return running_totals(df, bucket, order, {name: F.lit(1).cast("bigint")})


def numbered(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), name: str = "rn") -> DataFrame:
    """Adds row numbers from 1 in the given order (of each group), however few groups or distinct values there are.

    The table is sorted in ranges and stored; rows are numbered within their range, and the counts of a group's
    ranges before are added, so no task holds a group. `order` should end in a column without ties."""
    keys = [F.col(c) for c in by]
    ranges = stored(df.sort(*keys, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.select(*by, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = ranges.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__p").orderBy(*order)))
    same = [inside[c].eqNullSafe(counts[c]) for c in (*by, "__p")]
    return inside.join(counts, reduce(lambda a, b: a & b, same)).select(*[inside[c] for c in df.columns], (F.col("__before") + F.col("__r")).alias(name))


def score_bucket(p: Column, buckets: int = 256) -> Column:
    """Buckets of a score in [0, 1], highest first."""
    return -F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * buckets)


def balanced_bucket(df: DataFrame, column: str, buckets: int = 64) -> Column:
    """Buckets of about equally many rows in rising order, whatever the distribution: edges are
    approximate quantiles (sketches of bounded size), looked up by a binary tree of comparisons."""
    edges = sorted(set(df.approxQuantile(column, [i / buckets for i in range(1, buckets)], 0.25 / buckets)))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(column) < F.lit(edges[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(edges))


def falling_bucket(df: DataFrame, column: str = "p", buckets: int = 64) -> Column:
    """Buckets of about equally many rows, highest first."""
    return -balanced_bucket(df, column, buckets)


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation; [] without values. Values are counted, then ranked in
    balanced buckets, so no buffer holds all of them; two values a share reach the driver."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    n = counts.agg(F.sum("c")).first()[0]
    if not n:
        return []
    at = [(n - 1) * s for s in shares]
    wanted = sorted({k for a in at for k in (math.floor(a), math.ceil(a))})
    ranked = running_totals(counts, balanced_bucket(counts, "v"), [F.col("v")], {"upto": F.col("c")})
    places = F.filter(F.array(*[F.lit(k) for k in wanted]), lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("c")))
    value = {r.k: r.v for r in ranked.select("v", F.explode(places).alias("k")).collect()}
    return [value[math.floor(a)] + (a - math.floor(a)) * (value[math.ceil(a)] - value[math.floor(a)]) for a in at]
