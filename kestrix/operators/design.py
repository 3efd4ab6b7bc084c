"""Design matrices: imputation, scaling, indicators, interactions, and checks, fitted once and applied as expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .encoders import categories
from .windows import quantiles


def fill_value(df: DataFrame, column: str, how: str) -> Column | float | None:
    """mean, median, mode (least of ties), zero; statistics of the data that is fitted."""
    if how == "zero":
        return 0.0
    if how == "mode":
        row = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.col("count").desc(), column).limit(1).collect()
        return row[0][0] if row else None
    if how == "median":
        return next(iter(quantiles(df, column, [0.5])), None)
    return df.agg(F.avg(column)).first()[0]


@dataclass
class Feature:
    """A column and how it enters the matrix: numeric (standard, minmax, none) or categorical (onehot, dummy)."""

    name: str
    kind: str = "numeric"
    scale: str = "standard"
    missing: str = "mean"


@dataclass
class DesignMatrix:
    """fit() takes statistics once; transform() is a select of expressions, the same for any data."""

    features: list[Feature]
    interactions: list[tuple[str, str]] = field(default_factory=list)
    intercept: bool = True
    state: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> DesignMatrix:
        numeric = [f for f in self.features if f.kind == "numeric"]
        if numeric:
            row = df.agg(*[g(f.name).alias(f"{n}_{f.name}") for f in numeric for n, g in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]).first()
            for f in numeric:
                low = (row[f"mean_{f.name}"], row[f"std_{f.name}"]) if f.scale == "standard" else (row[f"min_{f.name}"], row[f"max_{f.name}"] - row[f"min_{f.name}"])
                shift, by = low if f.scale != "none" else (0.0, 1.0)
                self.state[f.name] = (fill_value(df, f.name, f.missing), float(shift), float(by) if by > 1e-10 else 1.0)
        for f in self.features:
            if f.kind != "numeric":
                self.state[f.name] = categories(df, f.name)
        return self

    def columns(self) -> dict[str, Column]:
        out: dict[str, Column] = {"intercept": F.lit(1.0)} if self.intercept else {}
        for f in self.features:
            if f.kind == "numeric":
                fill, shift, by = self.state[f.name]
                out[f.name] = (F.coalesce(F.col(f.name).cast("double"), F.lit(fill)) - F.lit(shift)) / F.lit(by)
            else:
                for v in self.state[f.name][1 if f.kind == "dummy" else 0 :]:
                    out[f"{f.name}_{v}"] = F.coalesce(F.col(f.name) == F.lit(v), F.lit(False)).cast("double")
        for a, b in self.interactions:
            out[f"{a}_x_{b}"] = out[a] * out[b]
        return out

    def names(self) -> list[str]:
        return list(self.columns())

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return df.select(*keep, *[c.alias(n) for n, c in self.columns().items()])


def interactions(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    """Products of pairs `a_x_b` and powers `a_pow2` up to a degree."""
    new = {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)}
    new |= {f"{c}_pow{k}": F.pow(F.col(c), F.lit(k)) for c in columns for k in range(2, degree + 1)}
    return df.withColumns(new)


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """By column: nulls, zeros, mean, population deviation, whether constant, values beyond 3 deviations; two passes."""
    stats = df.agg(*[g.alias(f"{n}_{c}") for c in columns for n, g in (("m", F.avg(c)), ("s", F.stddev_pop(c)))])
    z = {c: F.abs(F.col(c) - F.col(f"m_{c}")) > 3 * F.col(f"s_{c}") for c in columns}
    row = lambda c: F.struct(F.lit(c).alias("name"), F.col(f"nulls_{c}").alias("nulls"), F.col(f"zeros_{c}").alias("zeros"), F.col(f"m2_{c}").alias("mean"), F.col(f"s2_{c}").alias("std"), (F.col(f"s2_{c}") < 1e-10).alias("is_constant"), F.col(f"out_{c}").alias("outliers"))
    wide = df.crossJoin(F.broadcast(stats)).agg(*[g.alias(f"{n}_{c}") for c in columns for n, g in (("nulls", F.count_if(F.col(c).isNull())), ("zeros", F.count_if(F.col(c) == 0)), ("m2", F.max(f"m_{c}")), ("s2", F.max(f"s_{c}")), ("out", F.count_if(z[c] & (F.col(f"s_{c}") >= 1e-10))))])
    return wide.select(F.explode(F.array(*[row(c) for c in columns])).alias("r")).select("r.*")


def collinear(df: DataFrame, columns: list[str], threshold: float = 0.95) -> DataFrame:
    """Pairs whose correlation is beyond the threshold; all pairs in one aggregate."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("r")).select("r.*").where(F.abs("correlation") > threshold)


def sparsity(df: DataFrame, columns: list[str]) -> DataFrame:
    zeros = sum((F.count_if(F.col(c) == 0) for c in columns), F.lit(0))
    return df.agg((zeros / (F.count("*") * len(columns))).alias("sparsity"))
