"""Linear algebra for tall tables: one distributed Gram aggregate, then p x p work on the driver.

p (columns) is small and bounds all that reaches the driver; n (rows) never does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def gram(df: DataFrame, columns: list[str], target: str | None = None, weight: str | None = None, most: int = 100) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'WX, X'Wy, y'Wy and n in one aggregate over p(p+1)/2 products; of more than `most` columns, where a plan
    would hold too many, each task makes the matrix of its rows and these are added up."""
    w = F.col(weight) if weight else F.lit(1.0)
    names = [*columns, *([target] if target else [])]
    if len(columns) > most:
        return _wide_gram(df.select(w.cast("double").alias("__w"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]), len(columns), bool(target))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(F.count("*").alias("n"), *[F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs]).first()
    full = np.zeros((len(names), len(names)))
    for i, j in pairs:
        full[i, j] = full[j, i] = row[f"s{i}_{j}"] or 0.0
    p = len(columns)
    return full[:p, :p], (full[:p, p] if target else np.zeros(0)), (float(full[p, p]) if target else 0.0), row["n"]


def _wide_gram(rows: DataFrame, p: int, target: bool) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The parts of `gram` from rows of weight, columns and target; (p + 1)^2 numbers leave each task."""
    m = p + target

    def part(batches):
        total, n = np.zeros((m, m)), 0
        for batch in batches:
            x = batch.to_numpy(float)
            x = x[~np.isnan(x).any(axis=1)]
            total += (x[:, 1:] * x[:, :1]).T @ x[:, 1:]
            n += len(x)
        i, j = np.indices((m, m))
        yield pd.DataFrame({"i": np.append(i.ravel(), -1), "j": np.append(j.ravel(), -1), "v": np.append(total.ravel(), n)})

    full, n = np.zeros((m, m)), 0
    for r in rows.mapInPandas(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r.i < 0:
            n = int(r.v)
        else:
            full[r.i, r.j] = r.v
    return full[:p, :p], (full[:p, p] if target else np.zeros(0)), (float(full[p, p]) if target else 0.0), n


def gram_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """X'X as rows (i, j, value), in the plan."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns))]
    wide = df.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in pairs if i <= j])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{min(i, j)}_{max(i, j)}").alias("value")) for i, j in pairs])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cholesky where it can, least squares where the matrix is singular."""
    try:
        low = np.linalg.cholesky(a)
        return np.linalg.solve(low.T, np.linalg.solve(low, b))
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def ridge(df: DataFrame, columns: list[str], target: str, lam: float = 0.0, weight: str | None = None) -> np.ndarray:
    a, b, _, _ = gram(df, columns, target, weight)
    return solve(a + lam * np.eye(len(columns)), b)


def ridge_path(df: DataFrame, columns: list[str], target: str, lams: list[float]) -> np.ndarray:
    """Coefficients for each lambda from one Gram aggregate."""
    a, b, _, _ = gram(df, columns, target)
    return np.array([solve(a + lam * np.eye(len(columns)), b) for lam in lams])


def ridge_cv(df: DataFrame, columns: list[str], target: str, lams: list[float], fold: Column, folds: int = 5) -> dict[float, float]:
    """Mean squared error by lambda; a fold's training Gram is the whole less the fold's own: one aggregate in all."""
    names = [*columns, target]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = df.groupBy(fold.alias("__f")).agg(F.count("*").alias("n"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    parts = []
    for r in rows:
        m = np.zeros((len(names), len(names)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        parts.append((m, r["n"]))
    whole = sum(m for m, _ in parts)
    p = len(columns)
    out = {}
    for lam in lams:
        error = 0.0
        for m, _ in parts:
            t = whole - m
            beta = solve(t[:p, :p] + lam * np.eye(p), t[:p, p])
            error += m[p, p] - 2 * beta @ m[:p, p] + beta @ m[:p, :p] @ beta
        out[lam] = error / sum(n for _, n in parts)
    return out


def linear(columns: list[str], beta: np.ndarray) -> Column:
    return sum((F.col(c) * F.lit(float(b)) for c, b in zip(columns, beta)), F.lit(0.0))


def quadratic_form(columns: list[str], inverse: np.ndarray) -> Column:
    """x' A x of a row."""
    terms = [F.col(a) * F.col(b) * F.lit(float(inverse[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return sum(terms, F.lit(0.0))


def leverage(df: DataFrame, columns: list[str], lam: float = 0.0) -> DataFrame:
    """Adds the diagonal of the hat matrix, without the matrix."""
    a, *_ = gram(df, columns)
    return df.withColumn("leverage", quadratic_form(columns, np.linalg.pinv(a + lam * np.eye(len(columns)))))


def ridge_loocv(df: DataFrame, columns: list[str], target: str, lam: float) -> DataFrame:
    """Mean of (residual / (1 - leverage))^2."""
    a, b, _, _ = gram(df, columns, target)
    reg = a + lam * np.eye(len(columns))
    beta = solve(reg, b)
    r = F.col(target) - linear(columns, beta)
    return df.agg(F.avg(F.pow(r / (1 - quadratic_form(columns, np.linalg.pinv(reg))), 2)).alias("loocv"))


def effective_df(a: np.ndarray, lam: float) -> float:
    values = np.maximum(np.linalg.eigvalsh(a), 0)
    return float((values / (values + lam)).sum())


def ridge_gcv(df: DataFrame, columns: list[str], target: str, lam: float) -> float:
    """(rss / n) / (1 - df / n)^2 from the Gram aggregate alone."""
    a, b, yy, n = gram(df, columns, target)
    beta = solve(a + lam * np.eye(len(columns)), b)
    rss = yy - 2 * beta @ b + beta @ a @ beta
    return float(rss / n / (1 - effective_df(a, lam) / n) ** 2)


def singular_values(df: DataFrame, columns: list[str]) -> np.ndarray:
    a, *_ = gram(df, columns)
    return np.sqrt(np.maximum(np.linalg.eigvalsh(a)[::-1], 0))


def rank(df: DataFrame, columns: list[str], tol: float = 1e-7) -> int:
    s = singular_values(df, columns)
    return int((s > tol * s.max()).sum()) if len(s) else 0


def condition_number(df: DataFrame, columns: list[str]) -> float:
    s = singular_values(df, columns)
    return float(s.max() / s.min()) if s.min() > 0 else float("inf")


def explained_variance(df: DataFrame, columns: list[str]) -> np.ndarray:
    s = singular_values(df, columns) ** 2
    return s / s.sum()


def choose_rank(df: DataFrame, columns: list[str], share: float = 0.95) -> int:
    return int(np.searchsorted(np.cumsum(explained_variance(df, columns)), share - 1e-12) + 1)


def principal(df: DataFrame, columns: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values and right vectors (columns)."""
    a, *_ = gram(df, columns)
    values, vectors = np.linalg.eigh(a)
    order = np.argsort(values)[::-1][:k]
    return np.sqrt(np.maximum(values[order], 0)), vectors[:, order]


def low_rank(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Rows projected on the k largest right singular vectors: the best approximation of rank k."""
    _, v = principal(df, columns, k)
    p = v @ v.T
    return df.withColumns({f"{c}_k": linear(columns, p[:, j]) for j, c in enumerate(columns)})


def approximation_error(df: DataFrame, columns: list[str], k: int, norm: str = "fro") -> float:
    tail = singular_values(df, columns)[k:]
    return float(np.sqrt((tail**2).sum())) if norm == "fro" else float(tail.max(initial=0.0))


def qr_r(df: DataFrame, columns: list[str]) -> np.ndarray:
    """R of the thin QR factorisation (positive diagonal), as the Cholesky factor of X'X."""
    a, *_ = gram(df, columns)
    return np.linalg.cholesky(a).T


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of matrices in long form (i, j, v): a join on the inner index and a sum."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j2"), F.col("v").alias("v2"))
    return a.withColumnRenamed("j", "k").join(right, "k").groupBy("i", F.col("j2").alias("j")).agg(F.sum(F.col("v") * F.col("v2")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.sum("v").alias("trace"))


def frobenius(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def project_onto(df: DataFrame, y: str, a: str) -> DataFrame:
    """(y.a / a.a) a over the rows of two columns."""
    k = df.agg((F.sum(F.col(y) * F.col(a)) / F.sum(F.col(a) * F.col(a))).alias("__k"))
    return df.crossJoin(F.broadcast(k)).withColumn("projection", F.col("__k") * F.col(a)).drop("__k")


def fit_quality(df: DataFrame, target: str, fitted: Column) -> DataFrame:
    """Residual sum of squares and R squared."""
    r = F.col(target) - fitted
    return df.agg(F.sum(r * r).alias("rss"), (1 - F.sum(r * r) / (F.sum(F.col(target) * F.col(target)) - F.sum(target) * F.sum(target) / F.count("*"))).alias("r2"))


def project_subspace(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Adds projection (of the target onto the columns' span) and residual (onto its complement)."""
    out = df.withColumn("projection", linear(columns, ridge(df, columns, target)))
    return out.withColumn("residual", F.col(target) - F.col("projection"))


def hat_entries(df: DataFrame, columns: list[str], id: str, rows: DataFrame) -> DataFrame:
    """Entries (i, j, value) of the hat matrix X (X'X)^-1 X' for all rows i and the few rows j of `rows` (id alone):
    the whole matrix has a cell for each pair of rows. 1 on the diagonal less these is the projection onto the complement."""
    from ..functions.vectors import all_pairs

    inverse = np.linalg.pinv(gram(df, columns)[0])
    turned = [linear(columns, inverse[:, k]) for k in range(len(columns))]
    some = df.join(rows.select(id), id, "left_semi").select(F.col(id).alias("j"), *[t.alias(f"__t{k}") for k, t in enumerate(turned)])
    pairs = all_pairs(df.select(F.col(id).alias("i"), *columns), some)
    return pairs.select("i", "j", sum((F.col(c) * F.col(f"__t{k}") for k, c in enumerate(columns)), F.lit(0.0)).alias("value"))


def orthogonality(df: DataFrame, columns: list[str], residual: str, tol: float = 1e-8) -> DataFrame:
    """By column its product with the residual, and whether that is zero beside the lengths of the two."""
    wide = df.agg(*[F.sum(F.col(c) * F.col(residual)).alias(f"d{i}") for i, c in enumerate(columns)], *[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"n{i}") for i, c in enumerate(columns)], F.sqrt(F.sum(F.col(residual) * F.col(residual))).alias("r"))
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"d{i}").alias("product"), (F.abs(F.col(f"d{i}")) <= tol * (1 + F.col(f"n{i}") * F.col("r"))).alias("orthogonal")) for i, c in enumerate(columns)])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def cauchy_schwarz(df: DataFrame, x: str, y: str) -> DataFrame:
    """|x.y|, |x||y| and whether the first is at most the second, of two columns."""
    out = df.agg(F.abs(F.sum(F.col(x) * F.col(y))).alias("inner"), (F.sqrt(F.sum(F.col(x) * F.col(x))) * F.sqrt(F.sum(F.col(y) * F.col(y)))).alias("bound"))
    return out.withColumn("holds", F.col("inner") <= F.col("bound") * (1 + 1e-12))


def identity(spark, n: int) -> DataFrame:
    """The identity as cells (i, j, v)."""
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def diagonal(vector: DataFrame) -> DataFrame:
    """Cells of the diagonal matrix of a vector (i, v)."""
    return vector.select("i", F.col("i").alias("j"), "v")


def outer(x: DataFrame, y: DataFrame) -> DataFrame:
    """Cells of the product x y' of two vectors (i, v)."""
    from ..functions.vectors import all_pairs

    return all_pairs(x.select("i", F.col("v").alias("__x")), y.select(F.col("i").alias("j"), F.col("v").alias("__y"))).select("i", "j", (F.col("__x") * F.col("__y")).alias("v"))


def to_sparse(df: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """(id, column, value) of what is not zero."""
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    return df.select(id, F.explode(F.filter(cells, lambda s: F.coalesce(s["value"], F.lit(0.0)) != 0)).alias("c")).select(id, "c.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns, in one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    wide = df.agg(*[F.corr(columns[i], columns[j]).alias(f"r{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"r{min(i, j)}_{max(i, j)}").alias("r")) for i in range(len(columns)) for j in range(len(columns))]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
