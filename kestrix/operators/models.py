"""Models whose fits are distributed sums: Beta-Binomial baseline, logistic IRLS, discrete hazard, embeddings, attention."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import stored
from .calibration import sigmoid
from .encoders import index_categories
from .linalg import linear


def beta_posterior(df: DataFrame, group: str, y: str, strength: float = 10.0) -> DataFrame:
    """By group: n, positives, posterior alpha and beta (prior: global rate of that strength), mean, mode, variance, shrinkage."""
    by = df.groupBy(group).agg(F.count(y).alias("n"), F.sum(y).cast("bigint").alias("k"))
    every = df.agg(F.avg(y).alias("g"))
    a, b = F.lit(strength) * F.col("g") + F.col("k"), F.lit(strength) * (1 - F.col("g")) + F.col("n") - F.col("k")
    out = by.crossJoin(F.broadcast(every)).withColumn("alpha", a).withColumn("beta", b)
    s = F.col("alpha") + F.col("beta")
    return out.select(group, "n", "k", "alpha", "beta", (F.col("alpha") / s).alias("mean"), F.try_divide(F.col("alpha") - 1, s - 2).alias("mode"), (F.col("alpha") * F.col("beta") / (s * s * (s + 1))).alias("variance"), (F.lit(strength) / (F.col("n") + strength)).alias("shrinkage"))


def beta_interval(level: float = 0.8, cells: int = 1000):
    """Credible interval of Beta(alpha, beta) by a trapezoid CDF on a grid, as a column function of two columns."""
    x = (np.arange(cells) + 0.5) / cells

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(a, b):
            log = (p - 1) * np.log(x) + (q - 1) * np.log1p(-x) - (math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q))
            c = np.cumsum(np.exp(log))
            c /= c[-1]
            out.append(tuple(float(x[np.searchsorted(c, t)]) for t in ((1 - level) / 2, (1 + level) / 2)))
        return pd.DataFrame(out, columns=["low", "high"])

    return F.pandas_udf(run, "low double, high double")


@dataclass
class Logistic:
    """Ridge logistic regression by IRLS; each step is one distributed aggregate and a p x p solve."""

    columns: list[str]
    lam: float = 0.1
    steps: int = 100
    tol: float = 1e-6
    beta: np.ndarray | None = None
    taken: int = 0

    def fit(self, df: DataFrame, y: str, weight: str | None = None) -> Logistic:
        p = len(self.columns)
        beta = np.zeros(p)
        df = stored(df.select(*dict.fromkeys([*self.columns, y, *([weight] if weight else [])])), "design")  # each step reads it
        w0 = F.col(weight) if weight else F.lit(1.0)
        for self.taken in range(1, self.steps + 1):
            rows = df.withColumn("__q", sigmoid(linear(self.columns, beta)))
            rows = rows.withColumn("__w", w0 * F.greatest(F.lit(1e-10), F.col("__q") * (1 - F.col("__q")))).withColumn("__r", w0 * (F.col(y) - F.col("__q")))
            s = rows.agg(*[F.sum(F.col("__r") * F.col(c)).alias(f"g{i}") for i, c in enumerate(self.columns)], *[F.sum(F.col("__w") * F.col(self.columns[i]) * F.col(self.columns[j])).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]).first()
            h = np.array([[s[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) + self.lam * np.eye(p)
            g = np.array([s[f"g{i}"] for i in range(p)]) - self.lam * beta
            step = np.linalg.solve(h, g)
            beta = beta + step
            if np.linalg.norm(step) < self.tol:
                break
        self.beta = beta
        return self

    def probability(self) -> Column:
        return sigmoid(linear(self.columns, self.beta))

    def odds_ratios(self) -> dict[str, float]:
        return dict(zip(self.columns, np.exp(self.beta).tolist()))

    def importance(self) -> list[tuple[str, float]]:
        return sorted(zip(self.columns, np.abs(self.beta).tolist()), key=lambda x: (-x[1], x[0]))


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def person_period(df: DataFrame, time: str, event: str | None = None) -> DataFrame:
    """A row for each period up to a subject's time; label 1 in the last (if the event took place)."""
    last = F.col("t") == F.col(time)
    hit = last if event is None else last & (F.col(event) == 1)
    return df.withColumn("t", F.explode(F.sequence(F.lit(1), F.col(time)))).withColumn("label", hit.cast("int"))


def life_table(pp: DataFrame) -> DataFrame:
    """By period: at risk, events, hazard, survival and probability of the event in the period."""
    by = pp.groupBy("t").agg(F.count("*").alias("at_risk"), F.sum("label").cast("bigint").alias("events"))
    h = by.withColumn("hazard", F.col("events") / F.col("at_risk"))
    w = Window.orderBy("t")  # a row a period
    alive = h.withColumn("survival", F.when(F.max(F.when(F.col("hazard") >= 1, 1).otherwise(0)).over(w) == 1, 0.0).otherwise(F.exp(F.sum(F.when(F.col("hazard") < 1, F.log1p(-F.col("hazard")))).over(w))))
    return alive.withColumn("event_prob", F.coalesce(F.lag("survival").over(w), F.lit(1.0)) * F.col("hazard"))


def timing(table: DataFrame) -> DataFrame:
    """Expected time, first period with survival at or under a half (else the last), 10 and 90 per cent points."""
    cum = table.withColumn("cum", 1 - F.col("survival"))
    first = lambda test: F.coalesce(F.min(F.when(test, F.col("t"))), F.max("t"))
    return cum.agg(F.sum(F.col("t") * F.col("event_prob")).alias("expected"), first(F.col("survival") <= 0.5).alias("median"), first(F.col("cum") >= 0.1).alias("p10"), first(F.col("cum") >= 0.9).alias("p90"))


def fit_hazard(df: DataFrame, time: str, columns: list[str], periods: int | None = None, lam: float = 0.1, steps: int = 100, tol: float = 1e-6) -> Logistic:
    """Discrete hazard: ridge logistic on person-periods with an indicator a period and no intercept, over all
    periods of the data or, as a horizon, the first `periods`.

    A person-period has one indicator, so the sums of a step are by period: its row of the Gram matrix."""
    periods = periods or df.agg(F.max(time)).first()[0] or 0
    names, q = [f"t{k}" for k in range(1, periods + 1)] + columns, len(columns)
    pp = person_period(stored(df.select(time, *columns), "subjects"), time).where(F.col("t") <= periods)  # each step reads it
    beta, m = np.zeros(periods + q), Logistic(names, lam, steps, tol)
    for m.taken in range(1, steps + 1):
        base = F.element_at(F.array(*[F.lit(float(b)) for b in beta[:periods]]), F.col("t")) if periods else F.lit(0.0)
        rows = pp.withColumn("__q", sigmoid(base + linear(columns, beta[periods:]) if columns else base))
        rows = rows.withColumn("__w", F.greatest(F.lit(1e-10), F.col("__q") * (1 - F.col("__q")))).withColumn("__r", F.col("label") - F.col("__q"))
        w, r = F.col("__w"), F.col("__r")
        sums = [F.sum(r).alias("r"), F.sum(w).alias("w")] + [F.sum(r * F.col(c)).alias(f"g{i}") for i, c in enumerate(columns)] + [F.sum(w * F.col(c)).alias(f"h{i}") for i, c in enumerate(columns)]
        sums += [F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"h{i}_{j}") for i in range(q) for j in range(i, q)]
        h, g = lam * np.eye(periods + q), -lam * beta
        for s in rows.groupBy("t").agg(*sums).collect():  # one row a period
            k = s.t - 1
            h[k, k] += s.w
            g[k] += s.r
            for i in range(q):
                h[k, periods + i] += s[f"h{i}"]
                h[periods + i, k] += s[f"h{i}"]
                g[periods + i] += s[f"g{i}"]
                for j in range(q):
                    h[periods + i, periods + j] += s[f"h{min(i, j)}_{max(i, j)}"]
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.linalg.norm(step) < tol:
            break
    m.beta = beta
    return m


def embedding_dim(n: int) -> int:
    return min(600, round(1.6 * n**0.56))


def softmax(score: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return e / F.sum(e).over(w)


def attention(queries: DataFrame, keys: DataFrame, dim: int) -> DataFrame:
    """softmax(q.k / sqrt(d)) over a table of keys: (query_id, key_id, weight)."""
    from ..functions.vectors import all_pairs, dot

    pairs = all_pairs(queries.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), keys.select(F.col("id").alias("key_id"), F.col("vector").alias("k")))
    scored = pairs.select("query_id", "key_id", (dot(F.col("q"), F.col("k")) / math.sqrt(dim)).alias("score"))
    return scored.select("query_id", "key_id", softmax("score", ["query_id"]).alias("weight"))


def _ridge_side(pairs: DataFrame, own: str, other: str, vectors: DataFrame, dim: int, lam: float) -> DataFrame:
    """(own, vector): the ridge vectors of one kind of categories where those of the other are given. Sums by
    category are combined in each task before they meet, so a hot category is no large group."""
    x, n = [F.col("vector")[i] for i in range(dim)], F.col("n")
    cells = [(i, j) for i in range(dim) for j in range(i, dim)]
    sums = [F.sum(n * x[i] * x[j]) for i, j in cells] + [F.sum(n * F.col("t") * x[i]) for i in range(dim)]

    def solve(rows: pd.Series) -> pd.Series:
        s = np.array(rows.tolist(), float).reshape(-1, len(cells) + dim)
        h = np.empty((len(s), dim, dim))
        for k, (i, j) in enumerate(cells):
            h[:, i, j] = h[:, j, i] = s[:, k]
        return pd.Series(list(np.linalg.solve(h + lam * np.eye(dim), s[:, len(cells) :, None])[..., 0]))

    by = pairs.join(vectors, other).groupBy(own).agg(F.array(*sums).alias("s"))
    return by.select(own, F.pandas_udf(solve, "array<double>")("s").alias("vector"))


def train_embeddings(df: DataFrame, left: str, right: str, y: str, dim: int = 8, epochs: int = 30, lam: float = 1.0, few: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Vectors of two kinds of categories whose dot products fit the mean of y by pair (alternating ridge on
    the pair table, which one aggregate makes): (id, name, embedding) of each kind.

    At most `few` pairs are fitted on the driver; more by sums on the executors, with the same steps from the same start.
    Rows without one of the categories or y teach nothing."""
    spark = df.sparkSession
    pairs = df.dropna(subset=[left, right, y]).groupBy(left, right).agg(F.count("*").alias("n"), F.avg(y).alias("m"))
    pairs = stored(pairs, "pairs")
    base = pairs.agg(F.sum(F.col("m") * F.col("n")) / F.sum("n")).first()[0]
    # the start is a hash of the name and the coordinate, with deviation 0.1
    start = F.array(*[(F.pmod(F.xxhash64(F.col(right).cast("string"), F.lit(i)), F.lit(1 << 20)) / (1 << 20) - 0.5) * 0.1 * math.sqrt(12) for i in range(dim)])
    first = pairs.select(right).distinct().select(right, start.alias("vector"))
    if pairs.limit(few + 1).count() > few:
        pairs = pairs.withColumn("t", F.col("m") - base)
        v = first
        for k in range(epochs):
            u = stored(_ridge_side(pairs, left, right, v, dim, lam), f"left{k}")
            v = stored(_ridge_side(pairs, right, left, u, dim, lam), f"right{k}")
        numbered = lambda d, c: d.join(index_categories(d, c), c).select(F.col("code").alias("id"), F.col(c).cast("string").alias("name"), F.col("vector").alias("embedding"))
        return numbered(u, left), numbered(v, right)
    table = pairs.orderBy(left, right).toPandas()
    a, an = pd.factorize(table[left], sort=True)
    b, bn = pd.factorize(table[right], sort=True)
    begin = dict(first.collect())
    u, v = np.zeros((len(an), dim)), np.array([begin[name] for name in bn], float).reshape(-1, dim)
    target, n = table["m"].to_numpy(float) - (base or 0.0), table["n"].to_numpy(float)
    for _ in range(epochs):
        for own, other, at, ot in ((u, v, a, b), (v, u, b, a)):
            for k in range(len(own)):
                rows = at == k
                x = other[ot[rows]]
                own[k] = np.linalg.solve((x * n[rows, None]).T @ x + lam * np.eye(dim), (x * n[rows, None]).T @ target[rows])
    make = lambda names, m: spark.createDataFrame([(i, str(name), [float(x) for x in row]) for i, (name, row) in enumerate(zip(names, m))], "id int, name string, embedding array<double>")
    return make(an, u), make(bn, v)


def contributions(df: DataFrame, columns: list[str], beta: list[float | Decimal], id: str, k: int = 5) -> DataFrame:
    """The k largest parts x * beta of each row's score, by size, then by name: NaN before all numbers, missing parts last.

    A decimal beta times a whole or decimal number is an exact product, so equal parts tie as written."""
    parts = [(c, (F.col(c) * F.lit(b)).cast("double")) for c, b in zip(columns, beta)]
    keyed = F.array(*[F.struct(x.isNull().alias("missing"), (~F.isnan(x)).alias("number"), (-F.abs(x)).alias("neg"), F.lit(c).alias("feature"), x.alias("contribution")) for c, x in parts])
    return df.select(id, F.posexplode(F.slice(F.sort_array(keyed), 1, k)).alias("rank", "s")).select(id, (F.col("rank") + 1).alias("rank"), "s.feature", "s.contribution")


def normal_interval(p: Column, n: Column | int, z: float = 1.96) -> tuple[Column, Column]:
    half = z * F.sqrt(p * (1 - p) / n)
    return F.greatest(p - half, F.lit(0.0)), F.least(p + half, F.lit(1.0))
