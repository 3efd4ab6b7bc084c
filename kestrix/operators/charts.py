"""What charts show, as tables: points, bars and cells that a front end draws."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .calibration import binned, uniform_edges
from .discrimination import confusion, rates, roc_curve
from .linalg import gram


def calibration_curves(df: DataFrame, model: str, bins: int = 10) -> DataFrame:
    """By model and bin: mean score, share of positives, rows."""
    return binned(df, uniform_edges(bins), (model,))


def roc_curves(df: DataFrame, model: str, names: list[str]) -> DataFrame:
    """ROC points of each of the named models."""
    parts = [roc_curve(df.where(F.col(model) == n)).withColumn("model", F.lit(n)) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fairness(df: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """By group: share told positive (demographic parity), recall (equal opportunity), false positive rate (equalised
    odds), precision (predictive parity), and each one's gap to the best group's share told positive."""
    by = rates(confusion(df, threshold, (group,)))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    out = by.select(group, ((F.col("tp") + F.col("fp")) / n).alias("positive_rate"), "recall", (1 - F.col("specificity")).alias("false_positive_rate"), "precision")
    most = out.agg(F.max("positive_rate").alias("__m"))
    return out.crossJoin(F.broadcast(most)).withColumn("gap", F.col("__m") - F.col("positive_rate")).drop("__m")


def performance_over_time(df: DataFrame, period: str, threshold: float = 0.5) -> DataFrame:
    """By period: rows, Brier, accuracy and base rate."""
    return df.groupBy(period).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(((F.col("p") >= threshold) == (F.col("y") == 1)).cast("double")).alias("accuracy"), F.avg("y").alias("base"))


def residuals(df: DataFrame, target: str, fitted: str) -> DataFrame:
    """Adds residual and its standardised value (population deviation)."""
    made = df.withColumn("residual", F.col(target) - F.col(fitted))
    stats = made.agg(F.avg("residual").alias("__m"), F.stddev_pop("residual").alias("__s"))
    return made.crossJoin(F.broadcast(stats)).withColumn("standardized", (F.col("residual") - F.col("__m")) / F.nullif("__s", F.lit(0.0))).drop("__m", "__s")


def principal_plane(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds pc1 and pc2, the coordinates on the two directions of most variance."""
    ones = df.withColumn("__1", F.lit(1.0))
    a, _, _, n = gram(ones, [*columns, "__1"])
    mean = a[-1, :-1] / max(n, 1)
    _, vectors = np.linalg.eigh(a[:-1, :-1] / max(n, 1) - np.outer(mean, mean))
    top = vectors[:, ::-1][:, :2]
    top = top * np.where(top[np.abs(top).argmax(axis=0), [0, 1]] < 0, -1, 1)
    axis = lambda k: sum(((F.col(c) - float(mean[i])) * float(top[i, k]) for i, c in enumerate(columns)), F.lit(0.0))
    return df.withColumn("pc1", axis(0)).withColumn("pc2", axis(1))


def heatmap(cells: DataFrame, i: str, j: str, value: str) -> DataFrame:
    """Cells with their value scaled to 0..1 between the least and the largest."""
    ends = cells.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    return cells.crossJoin(F.broadcast(ends)).select(i, j, value, F.coalesce((F.col(value) - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)), F.lit(0.0)).alias("shade"))


def convergence(losses: list[float], tol: float = 1e-6) -> list[dict]:
    """By step: the loss, its fall since the step before, and whether that is under the tolerance."""
    return [{"step": k, "loss": x, "fall": None if not k else losses[k - 1] - x, "converged": bool(k) and abs(losses[k - 1] - x) < tol} for k, x in enumerate(losses)]


def gram_schmidt_steps(vectors: list[list[float]]) -> list[dict]:
    """Of each vector what is left of it after the ones before, and the unit vector; null where nothing is left."""
    out, basis = [], []
    for v in np.array(vectors, float):
        rest = v - sum(((v @ q) * q for q in basis), np.zeros_like(v))
        size = float(np.linalg.norm(rest))
        unit = rest / size if size > 1e-12 * max(1.0, float(np.linalg.norm(v))) else None
        if unit is not None:
            basis.append(unit)
        out.append({"vector": v.tolist(), "rest": rest.tolist(), "unit": None if unit is None else unit.tolist()})
    return out


def rank_parts(a: list[list[float]]) -> list[dict]:
    """The rank-one parts of a small matrix, the largest first, with the share of the whole that they explain so far."""
    u, s, v = np.linalg.svd(np.array(a, float), full_matrices=False)
    total = float((s**2).sum()) or 1.0
    return [{"singular_value": float(s[k]), "part": (s[k] * np.outer(u[:, k], v[k])).tolist(), "explained": float((s[: k + 1] ** 2).sum()) / total} for k in range(len(s))]


def projection_points(y: list[float], x: list[list[float]]) -> dict:
    """A vector, its projection onto the columns of x, the residual, and the small hat matrix."""
    a, b = np.array(x, float), np.array(y, float)
    hat = a @ np.linalg.pinv(a)
    return {"y": b.tolist(), "projection": (hat @ b).tolist(), "residual": (b - hat @ b).tolist(), "hat": hat.tolist()}


def normal_pdf(x: Column, mean: float, deviation: float) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / deviation, 2)) / (deviation * math.sqrt(2 * math.pi))


def seeded(seed: int, n: int) -> list[float]:
    """n numbers in [0, 1) of a linear congruential generator (fixed values: multiplier 1664525, increment 1013904223)."""
    out = []
    for _ in range(n):
        seed = (seed * 1664525 + 1013904223) % (1 << 32)
        out.append(seed / 0xFFFFFFFF)
    return out
