"""Discrimination of scores: cumulative counts over distinct scores.

Inputs have y (0 or 1), p and, where an order of ties matters, id: ties go by falling p, then id.
Running totals are made by bucket of p, so no task holds all scores.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .windows import balanced_bucket, falling_bucket, row_numbers, running_totals


def by_score(df: DataFrame) -> DataFrame:
    """Distinct scores with cumulative tp and fp from the highest down, and the totals n_pos and n_neg."""
    ties = df.groupBy("p").agg(F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg"))
    cum = running_totals(ties, falling_bucket(ties), [F.col("p").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    total = ties.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return cum.crossJoin(F.broadcast(total))


def roc_curve(df: DataFrame) -> DataFrame:
    """fpr, tpr at each distinct threshold, with the origin (threshold null)."""
    points = by_score(df).select(F.col("p").alias("threshold"), (F.col("fp") / F.col("n_neg")).alias("fpr"), (F.col("tp") / F.col("n_pos")).alias("tpr"))
    return points.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def roc_auc(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area as the share of (positive, negative) pairs in order, ties half; null for a single class.

    Mid-ranks come from counts by score, whose running totals are made in buckets."""
    ties = df.groupBy(*by, "p").agg(F.sum("y").cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    ties = ties.withColumn("b", balanced_bucket(ties, "p"))
    parts = ties.groupBy(*by, "b").agg(F.sum("n").alias("bn"))
    before = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select(*by, "b", F.coalesce(F.sum("bn").over(before), F.lit(0.0)).alias("off"))
    inside = Window.partitionBy(*by, "b").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ties.withColumn("cum", F.sum("n").over(inside)).join(offset if by else F.broadcast(offset), [*by, "b"]).withColumn("rank", F.col("off") + F.col("cum") - (F.col("n") - 1) / 2)
    pos, n = F.sum("pos"), F.sum("n")
    area = (F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0.0))
    return ranked.groupBy(*by).agg(area.alias("auc"))


def thresholds(df: DataFrame) -> DataFrame:
    """At each distinct threshold: tp, fp, fn, tn, tpr, fpr, precision, youden, corner (distance to (0, 1))."""
    s = by_score(df)
    tpr, fpr = F.col("tp") / F.col("n_pos"), F.col("fp") / F.col("n_neg")
    return s.select(F.col("p").alias("threshold"), "tp", "fp", (F.col("n_pos") - F.col("tp")).alias("fn"), (F.col("n_neg") - F.col("fp")).alias("tn"), tpr.alias("tpr"), fpr.alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (tpr - fpr).alias("youden"), F.sqrt(F.pow(fpr, 2) + F.pow(1 - tpr, 2)).alias("corner"))


def pr_curve(df: DataFrame) -> DataFrame:
    """precision and recall at each distinct threshold, with (1, 0) in front (threshold null)."""
    points = by_score(df).select(F.col("p").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("n_pos")).alias("recall"))
    return points.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def trapezoid(points: DataFrame, x: str, y: str, by: str, bucket: Column, falling: bool = False) -> DataFrame:
    """Area under (x, y) in the order of `by`. The last point of each bucket is carried to the next (one row a bucket)."""
    pts = points.withColumn("__b", bucket)
    order, back = (F.col(by).desc(), F.col(by).asc()) if falling else (F.col(by).asc(), F.col(by).desc())
    inside = Window.partitionBy("__b").orderBy(order)
    last = pts.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(back))).where("__r = 1")
    across = Window.orderBy("__b")
    ends = last.select("__b", F.lag(x).over(across).alias("__x"), F.lag(y).over(across).alias("__y"))
    step = pts.withColumn("__px", F.lag(x).over(inside)).withColumn("__py", F.lag(y).over(inside)).join(F.broadcast(ends), "__b", "left")
    px, py = F.coalesce("__px", "__x"), F.coalesce("__py", "__y")
    return step.agg(F.coalesce(F.sum((F.col(x) - px) * (F.col(y) + py) / 2), F.lit(0.0)).alias("area"))


def pr_auc(df: DataFrame) -> DataFrame:
    """Trapezoid over recall; the first point is (recall 0, precision 1)."""
    s = by_score(df).select("p", (F.col("tp") / F.col("n_pos")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    first = df.sparkSession.range(1).select(F.lit(2.0).alias("p"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return trapezoid(s.unionByName(first), "recall", "precision", "p", falling_bucket(s), falling=True).withColumnRenamed("area", "pr_auc")


def ranked(df: DataFrame) -> DataFrame:
    """Rows with rn (1 is the highest score), and cumulative tp, by (p desc, id)."""
    return running_totals(df, falling_bucket(df), [F.col("p").desc(), F.col("id")], {"rn": F.lit(1).cast("bigint"), "tp": F.col("y").cast("bigint")})


def average_precision(df: DataFrame) -> DataFrame:
    """Mean precision at each positive row; ties by id."""
    return ranked(df).agg((F.sum(F.when(F.col("y") == 1, F.col("tp") / F.col("rn"))) / F.sum("y")).alias("average_precision"))


def confusion(df: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    hit, y = F.col("p") >= F.lit(threshold), F.col("y") == 1
    return df.groupBy(*by).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, specificity, f1, mcc, balanced accuracy from tp fp fn tn; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    recall, spec = safe(tp, tp + fn), safe(tn, tn + fp)
    out = {"accuracy": safe(tp + tn, tp + fp + fn + tn), "precision": safe(tp, tp + fp), "recall": recall, "specificity": spec, "f1": safe(2 * tp, 2 * tp + fp + fn), "mcc": safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "balanced_accuracy": (recall + spec) / 2}
    return counts.select(*counts.columns, *[c.alias(n) for n, c in out.items()])


def threshold_grid(df: DataFrame, steps: int) -> DataFrame:
    """tp and fp at thresholds k / steps, k = 0..steps, with totals: one pass into steps, then a total from above."""
    cell = F.least(F.floor(F.col("p") * steps + 1e-9), F.lit(steps)).cast("int")
    cells = df.groupBy(cell.alias("k")).agg(F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k")).join(F.broadcast(cells), "k", "left")
    above = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)  # steps + 1 rows
    every = Window.partitionBy()
    return grid.select("k", (F.col("k") / steps).alias("threshold"), *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(n) for c, n in (("pos", "tp"), ("neg", "fp"))], F.sum("pos").over(every).alias("n_pos"), F.sum("neg").over(every).alias("n_neg"))


def lift_curve(df: DataFrame, bins: int = 10) -> DataFrame:
    """Cumulative lift of the top k tenths (of n div bins rows each)."""
    n, base = df.agg(F.count("*"), F.avg("y")).first()
    size = n // bins
    marks = ranked(df).where((F.col("rn") % size == 0) & (F.col("rn") <= size * bins))
    return marks.select((F.col("rn") / size).cast("int").alias("bin"), (F.col("rn") / n).alias("share"), (F.col("tp") / F.col("rn") / F.lit(base)).alias("lift"))


def gains_curve(df: DataFrame, points: int = 100) -> DataFrame:
    """Share of positives among the first floor(i * n / points) rows."""
    n, total = df.agg(F.count("*"), F.sum("y")).first()
    at = df.sparkSession.range(1, points + 1).select(F.col("id").alias("point"), F.floor(F.col("id") * n / points).alias("rn"))
    return ranked(df).select("rn", "tp").join(F.broadcast(at), "rn").select("point", (F.col("rn") / n).alias("share"), (F.col("tp") / F.lit(total)).alias("gain"))


def at_percentile(df: DataFrame, percents: list[int]) -> DataFrame:
    """lift and capture (share of positives) of the top ceil(n * percent / 100) rows."""
    n, total = df.agg(F.count("*"), F.sum("y")).first()
    cuts = [(k, math.ceil(n * k / 100)) for k in percents]
    at = df.sparkSession.createDataFrame(cuts, "percent int, rn bigint")
    return ranked(df).join(F.broadcast(at), "rn").select("percent", (F.col("tp") / F.col("rn") / F.lit(total / n)).alias("lift"), (F.col("tp") / F.lit(total)).alias("capture"))


def lift_per_bin(df: DataFrame, bins: int = 10) -> DataFrame:
    """Lift of each tenth by itself."""
    n, base = df.agg(F.count("*"), F.avg("y")).first()
    r = row_numbers(df, falling_bucket(df), [F.col("p").desc(), F.col("id")])
    return r.groupBy((F.floor((F.col("rn") - 1) * bins / n) + 1).cast("int").alias("bin")).agg(F.count("*").alias("n"), (F.avg("y") / F.lit(base)).alias("lift"))


def concordance(df: DataFrame) -> DataFrame:
    """Shares of concordant, discordant and tied pairs, and Somers' D, from counts by score."""
    s = by_score(df)
    low = F.col("n_neg") - F.col("fp")  # negatives with a lower score
    tied = F.col("neg")
    pairs = F.max(F.col("n_pos").cast("double") * F.col("n_neg"))
    c, t = F.sum((F.col("pos") * low).cast("double")), F.sum((F.col("pos") * tied).cast("double"))
    return s.agg((c / pairs).alias("concordant"), ((pairs - c - t) / pairs).alias("discordant"), (t / pairs).alias("tied"), ((c - (pairs - c - t)) / pairs).alias("somers_d"))


def delong(df: DataFrame) -> DataFrame:
    """AUCs of p and p2 on the same rows, variance of their difference and z, from mid-rank placements."""

    def placed(d: DataFrame, p: str, name: str) -> DataFrame:
        ties = d.groupBy(F.col(p).alias("p")).agg(F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg"))
        cum = running_totals(ties, falling_bucket(ties), [F.col("p").desc()], {"cp": F.col("pos"), "cn": F.col("neg")})
        total = ties.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
        cum = cum.crossJoin(F.broadcast(total)).select(F.col("p").alias(p), ((F.col("n_neg") - F.col("cn") + F.col("neg") / 2) / F.col("n_neg")).alias(f"{name}_pos"), ((F.col("cp") - F.col("pos") / 2) / F.col("n_pos")).alias(f"{name}_neg"))
        return d.join(cum, p).withColumn(name, F.when(F.col("y") == 1, F.col(f"{name}_pos")).otherwise(F.col(f"{name}_neg"))).drop(f"{name}_pos", f"{name}_neg")

    v = placed(placed(df, "p", "v1"), "p2", "v2")
    pos, neg = F.col("y") == 1, F.col("y") == 0
    on = lambda c, test: F.when(test, F.col(c))
    d = F.col("v1") - F.col("v2")
    var = F.var_samp(F.when(pos, d)) / F.count_if(pos) + F.var_samp(F.when(neg, d)) / F.count_if(neg)
    out = v.agg(F.avg(on("v1", pos)).alias("auc1"), F.avg(on("v2", pos)).alias("auc2"), var.alias("variance"))
    return out.withColumn("z", F.coalesce((F.col("auc1") - F.col("auc2")) / F.sqrt(F.nullif("variance", F.lit(0.0))), F.lit(0.0)))


def bootstrap_auc(df: DataFrame, rounds: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the AUC under Poisson bootstrap weights.

    Rows of one score are interchangeable, so a weight is drawn by distinct score, class and round (a sum of n
    Poisson weights is Poisson of mean n). Buckets of scores draw by themselves; a row a bucket and round leaves them."""

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("p")
        b = int(group["b"].iloc[0])
        rng = np.random.default_rng([seed, -b])
        pos, neg, won = np.zeros(rounds), np.zeros(rounds), np.zeros(rounds)
        counts = group[["pos", "neg"]].to_numpy()
        for k in range(0, len(counts), 256):
            part = counts[k : k + 256]
            x, y = np.zeros((len(part), rounds)), np.zeros((len(part), rounds))
            for out, n in ((x, part[:, 0]), (y, part[:, 1])):
                out[n > 0] = rng.poisson(n[n > 0, None], (int((n > 0).sum()), rounds))
            won += (x * (neg + np.cumsum(y, axis=0) - y / 2)).sum(axis=0)
            pos += x.sum(axis=0)
            neg += y.sum(axis=0)
        return pd.DataFrame({"b": b, "round": np.arange(rounds), "pos": pos, "neg": neg, "won": won})

    ties = df.groupBy("p").agg(F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg"))
    parts = ties.withColumn("b", falling_bucket(ties).cast("bigint")).groupBy("b").applyInPandas(draw, "b bigint, round int, pos double, neg double, won double")
    lower = Window.partitionBy("round").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # buckets are highest first
    each = parts.withColumn("won", F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(lower), F.lit(0.0)))
    each = each.groupBy("round").agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
    tail = (1 - level) / 2
    return each.agg(F.avg("auc").alias("auc_mean"), F.percentile("auc", F.lit(tail)).alias("low"), F.percentile("auc", F.lit(1 - tail)).alias("high"))


def full_discrimination(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: AUC, Gini, PR AUC, average precision, KS, its threshold, Somers' D, the rates at a threshold, and the
    lift of the top 10, 20, 30 and 50 per cent. df has y, p, id."""
    auc = roc_auc(df).withColumn("gini", 2 * F.col("auc") - 1)
    best = thresholds(df).agg(F.max("youden").alias("ks"), F.max_by("threshold", F.struct("youden", "threshold")).alias("ks_threshold"))
    lifts = at_percentile(df, [10, 20, 30, 50]).groupBy().agg(*[F.max(F.when(F.col("percent") == k, F.col("lift"))).alias(f"lift_{k}") for k in (10, 20, 30, 50)])
    parts = [auc, pr_auc(df), average_precision(df), best, concordance(df).select("somers_d"), rates(confusion(df, threshold)), lifts]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # a row each


def compare_roc(df: DataFrame, model: str) -> DataFrame:
    """By model: AUC, Gini and the rank by AUC (1 is best; ties by name)."""
    return roc_auc(df, (model,)).withColumn("gini", 2 * F.col("auc") - 1).withColumn("rank", F.row_number().over(Window.orderBy(F.col("auc").desc(), model)))


def evaluate(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """What a fitted model's scores are worth: Brier, log-loss, accuracy, AUC, PR AUC, ECE and MCE in one row."""
    from .calibration import brier, expected_calibration_error, maximum_calibration_error, uniform_edges
    from .models import log_loss

    edges = uniform_edges(10)
    parts = [brier(df), df.agg(log_loss(F.col("y"), F.col("p")).alias("log_loss"), F.avg(((F.col("p") >= threshold) == (F.col("y") == 1)).cast("double")).alias("accuracy")), roc_auc(df), pr_auc(df), expected_calibration_error(df, edges), maximum_calibration_error(df, edges)]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)
