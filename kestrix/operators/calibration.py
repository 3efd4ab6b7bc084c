"""Calibration of probabilities: two-level aggregates over bins.

Inputs are DataFrames with y (0 or 1) and p columns; `by` columns (model, group) give a row each.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import lookup
from ..storage import stored
from .windows import balanced_bucket, quantiles, row_numbers


def uniform_edges(n: int) -> list[float]:
    """The inner edges of n equal bins of [0, 1]."""
    return [i / n for i in range(1, n)]


def bin_of(p: Column, edges: list[float]) -> Column:
    """Number of inner edges at or below p: bins are closed on the left."""
    return sum((F.when(p >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)).cast("int")


def quantile_edges(df: DataFrame, n: int) -> list[float]:
    """Inner quantile edges; equal bins if fewer than n + 1 edges differ."""
    cuts = quantiles(df, "p", [i / n for i in range(n + 1)])
    return sorted(set(cuts))[1:-1] if len(set(cuts)) == n + 1 else uniform_edges(n)


def binned(df: DataFrame, edges: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """By bin: n, mean p (conf) and mean y (acc)."""
    return df.groupBy(*by, bin_of(F.col("p"), edges).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"))


def brier(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def brier_decomposition(df: DataFrame, bins: int = 10) -> DataFrame:
    """uncertainty, resolution, reliability and their sum over equal bins."""
    b = binned(df, uniform_edges(bins))
    total = b.agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("acc")) / F.sum("n")).alias("base"))
    n = F.col("n") / F.col("total")
    parts = b.crossJoin(F.broadcast(total)).agg(F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"), F.sum(n * F.pow(F.col("acc") - F.col("base"), 2)).alias("resolution"), F.sum(n * F.pow(F.col("conf") - F.col("acc"), 2)).alias("reliability"))
    return parts.withColumn("brier", F.col("uncertainty") - F.col("resolution") + F.col("reliability"))


def expected_calibration_error(df: DataFrame, edges: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    return binned(df, edges, by).groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def maximum_calibration_error(df: DataFrame, edges: list[float], least: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    gap = F.abs(F.col("acc") - F.col("conf"))
    return binned(df, edges, by).groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("n") >= least, gap)), F.max(gap)).alias("mce"))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """All bins, empty ones too: centre, accuracy (null if empty) and count."""
    b = binned(df, uniform_edges(bins))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(b), "bin", "left").select("bin", ((F.col("bin") + 0.5) / bins).alias("center"), "acc", F.coalesce("n", F.lit(0)).alias("n"))


def wilson(successes: Column, trials: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Wilson interval, clamped to [0, 1]; (0, 1) without trials."""
    z, n = NormalDist().inv_cdf((1 + level) / 2), F.nullif(trials, F.lit(0))
    p, z2 = successes / n, z * z
    center, width = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.coalesce(F.greatest(center - width, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.least(center + width, F.lit(1.0)), F.lit(1.0))


def hosmer_lemeshow(df: DataFrame, groups: int = 10) -> DataFrame:
    """chi2 and degrees of freedom over groups of equally many rows by p, then id; the rest joins the last."""
    n = F.lit(df.count())
    ranked = row_numbers(df, balanced_bucket(df, "p"), [F.col("p"), F.col("id")])
    g = F.least(F.floor((F.col("rn") - 1) / F.floor(n / groups)), F.lit(groups - 1))
    by = ranked.groupBy(g.alias("g")).agg(F.sum("y").alias("o"), F.sum("p").alias("e"), F.avg("p").alias("m"))
    return by.agg(F.sum(F.when(F.col("e") * (1 - F.col("m")) > 0, F.pow(F.col("o") - F.col("e"), 2) / (F.col("e") * (1 - F.col("m"))))).alias("chi2"), (F.count("*") - 2).alias("df"))


def spiegelhalter(df: DataFrame) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    top, var = F.sum((y - p) * (1 - 2 * p)), F.sum(F.pow(1 - 2 * p, 2) * p * (1 - p))
    return df.agg((top / F.sqrt(F.nullif(var, F.lit(0.0)))).alias("z"))


def chi2_survival(x: float, df: int) -> float:
    """1 - P(df/2, x/2) by the series or the continued fraction of the incomplete gamma."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        b += 2
        d = 1 / (b - i * (i - a) * d)
        c = b - i * (i - a) / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    """1 / (1 + e^-z) without overflow."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def platt(p: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) * logit(p) + F.lit(b))


def platt_fit(df: DataFrame, steps: int = 50, rate: float = 1.0) -> tuple[float, float]:
    """a and b by Newton steps on two-number sums; one aggregate a step."""
    a, b = 1.0, 0.0
    z = df.select(logit(F.col("p")).alias("z"), "y")
    for _ in range(steps):
        q = sigmoid(F.lit(a) * F.col("z") + F.lit(b))
        w = q * (1 - q)
        s = z.select((q - F.col("y")).alias("r"), w.alias("w"), "z").agg(*[F.sum(x).alias(n) for n, x in (("g1", F.col("r") * F.col("z")), ("g0", F.col("r")), ("h11", F.col("w") * F.col("z") * F.col("z")), ("h10", F.col("w") * F.col("z")), ("h00", F.col("w")))]).first()
        det = s.h11 * s.h00 - s.h10**2
        if not det:
            break
        da, db = (s.h00 * s.g1 - s.h10 * s.g0) / det, (s.h11 * s.g0 - s.h10 * s.g1) / det
        a, b = a - rate * da, b - rate * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def temperatures(df: DataFrame, grid: list[float]) -> DataFrame:
    """Mean negative log-likelihood of logits scaled by each temperature; one pass, a column each."""
    z = logit(F.col("p"))
    nll = [F.avg(-F.when(F.col("y") == 1, F.log(sigmoid(z / t))).otherwise(F.log(sigmoid(-z / t)))).alias(f"t{i}") for i, t in enumerate(grid)]
    wide = df.agg(*nll)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(grid)])).alias("r")).select("r.*")


def isotonic(df: DataFrame) -> DataFrame:
    """Pool-adjacent-violators. Ties of p are pooled first, then each bucket of about equally many scores alone; only
    buckets whose ends are out of order are pooled together, until none are. Of a bucket two numbers reach the driver."""
    import pandas as pd

    def pool(rows: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list[float]] = []  # low, high, n, sum
        for r in rows.sort_values("low").itertuples(index=False):
            blocks.append([r.low, r.high, r.n, r.s])
            while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
                low, high, n, s = blocks.pop()
                blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + n, blocks[-1][3] + s]
        return pd.DataFrame(blocks, columns=["low", "high", "n", "s"])

    kind = "low double, high double, n double, s double"
    ties = df.groupBy("p").agg(F.count("*").cast("double").alias("n"), F.sum("y").cast("double").alias("s")).select(F.col("p").alias("low"), F.col("p").alias("high"), "n", "s")
    ties = stored(ties, "ties")

    def pooled(rows: DataFrame) -> DataFrame:
        return stored(rows.groupBy("b").applyInPandas(lambda g: pool(g).assign(b=g["b"].iloc[0]), f"{kind}, b int"), "blocks")

    parts = pooled(ties.withColumn("b", balanced_bucket(ties, "low", 256).cast("int")))
    while True:
        mean = F.col("s") / F.col("n")
        ends = sorted(map(tuple, parts.groupBy("b").agg(F.min_by(mean, "low"), F.max_by(mean, "low")).collect()))
        into: dict[int, int] = {}
        for (a, _, last), (b, first, _) in zip(ends, ends[1:]):
            if last >= first:
                into[b] = into.get(a, a)
        if not into:
            break
        parts = pooled(parts.withColumn("b", F.coalesce(lookup(into, F.col("b")), F.col("b"))))
    return parts.select("low", "high", F.col("n").cast("bigint").alias("n"), (F.col("s") / F.col("n")).alias("value"))


def probability_faults(df: DataFrame) -> DataFrame:
    """Counts of nulls, values outside [0, 1] and labels that are not 0 or 1."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("p").isNull() | F.col("y").isNull()).alias("nulls"), F.count_if((F.col("p") < 0) | (F.col("p") > 1)).alias("out_of_range"), F.count_if(~F.col("y").isin(0, 1)).alias("not_binary"))


def full_calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """One row: n, base rate, Brier and its parts, ECE, MCE, Hosmer-Lemeshow chi2 and df, Spiegelhalter z. df has y, p, id."""
    edges = uniform_edges(bins)
    parts = [df.agg(F.count("*").alias("n"), F.avg("y").alias("base")), brier(df), brier_decomposition(df, bins).drop("brier"), expected_calibration_error(df, edges), maximum_calibration_error(df, edges), hosmer_lemeshow(df, bins), spiegelhalter(df)]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # a row each


def compare_calibration(df: DataFrame, model: str, bins: int = 10) -> DataFrame:
    """By model: n, Brier, ECE, MCE and the rank by ECE (1 is best; ties by name)."""
    edges, by = uniform_edges(bins), (model,)
    out = df.groupBy(model).agg(F.count("*").alias("n")).join(brier(df, by), model).join(expected_calibration_error(df, edges, by), model).join(maximum_calibration_error(df, edges, by=by), model)
    return out.withColumn("rank", F.row_number().over(Window.orderBy("ece", model)))  # a row a model
