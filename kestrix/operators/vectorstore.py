"""Vector store operations: filtered k-nearest neighbours, hybrid and keyword search, aggregates.

Brute force is exact and distributed: scores are column expressions, and a top-k keeps k rows a task.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import cosine, doubles
from ..storage import stored

_OPERATORS = {
    "Equal": lambda c, v: c == F.lit(v), "NotEqual": lambda c, v: c != F.lit(v),
    "GreaterThan": lambda c, v: c > F.lit(v), "GreaterThanEqual": lambda c, v: c >= F.lit(v),
    "LessThan": lambda c, v: c < F.lit(v), "LessThanEqual": lambda c, v: c <= F.lit(v),
    "Like": lambda c, v: F.lower(c).contains(str(v).lower()),
}


def filters(spec: dict[str, Any] | None) -> Column:
    """A boolean tree: And, Or over operands; comparisons of a path (a list or a name) with a value. Null is no match."""
    if not spec:
        return F.lit(True)
    op = spec["operator"]
    if op in ("And", "Or"):
        parts = [filters(s) for s in spec["operands"]]
        return reduce((lambda a, b: a & b) if op == "And" else (lambda a, b: a | b), parts)
    if op not in _OPERATORS:
        raise ValueError(f"unknown operator {op}")
    path = spec["path"] if isinstance(spec["path"], str) else ".".join(spec["path"])
    value = next(v for k, v in spec.items() if k.startswith("value"))
    return F.coalesce(_OPERATORS[op](F.col(path), value), F.lit(False))


def equals(conditions: dict[str, Any]) -> dict[str, Any]:
    return {"operator": "And", "operands": [{"operator": "Equal", "path": k, "value": v} for k, v in conditions.items()]} if conditions else {}


def within(name: str, low: float | None = None, high: float | None = None) -> dict[str, Any]:
    """A closed range; no bounds match all."""
    parts = [{"operator": op, "path": name, "value": v} for op, v in (("GreaterThanEqual", low), ("LessThanEqual", high)) if v is not None]
    return {"operator": "And", "operands": parts} if parts else {}


def search(df: DataFrame, query: list[float], limit: int = 10, where: dict | None = None, vector: str = "vector", id: str = "id") -> DataFrame:
    """Nearest by cosine: adds similarity, distance (1 - s) and certainty (1 - distance / 2); ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.where(filters(where)).where(F.col(vector).isNotNull()).withColumn("similarity", cosine(doubles(F.col(vector)), q))
    top = scored.orderBy(F.col("similarity").desc(), id).limit(limit)
    return top.withColumn("distance", 1 - F.col("similarity")).withColumn("certainty", (2 - F.col("distance")) / 2)


def search_batch(df: DataFrame, queries: DataFrame, k: int, vector: str = "vector", id: str = "id", block: int = 2048) -> DataFrame:
    """For every query row its k nearest rows (other than itself), as (query_id, id, similarity, rank).

    Queries are taken in blocks of bounded size; a task scores its rows against a block by one matrix
    product and keeps k a query, so what is shuffled is k rows a query and task."""
    parts = None
    n = queries.count()
    blocks = max(1, -(-n // block))
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(id), F.lit(blocks)) == b).select(id, vector).collect()
        if not rows:
            continue
        ids = np.array([r[0] for r in rows])
        q = np.array([r[1] for r in rows], float)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def near(batches, ids=ids, q=q):
            best = np.full((len(ids), 0), 0.0)
            best_id = np.zeros((len(ids), 0), np.int64)
            for rows in batches:
                rows = rows[rows[vector].notna()]
                if not len(rows):
                    continue
                x = np.array(rows[vector].tolist(), float)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                own = rows[id].to_numpy()
                s = q @ x.T
                s[ids[:, None] == own[None, :]] = -np.inf
                best = np.concatenate([best, s], axis=1)
                best_id = np.concatenate([best_id, np.broadcast_to(own, s.shape)], axis=1)
                order = np.lexsort((best_id, -np.round(best, 12)))[:, :k]
                best, best_id = np.take_along_axis(best, order, 1), np.take_along_axis(best_id, order, 1)
            if best.shape[1]:
                frame = pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), id: best_id.ravel(), "similarity": best.ravel()})
                yield frame[np.isfinite(frame["similarity"])]

        # stored block by block: one block's vectors are on the driver and in the plan at a time
        part = stored(df.select(id, vector).mapInPandas(near, f"query_id bigint, {id} bigint, similarity double"), "near") if blocks > 1 else df.select(id, vector).mapInPandas(near, f"query_id bigint, {id} bigint, similarity double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return df.sparkSession.createDataFrame([], f"query_id bigint, {id} bigint, similarity double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), id)
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword(df: DataFrame, query: str, properties: list[str], limit: int | None = None, id: str = "id") -> DataFrame:
    """Rows of which any text (or text array) property contains the query, in any case, by id."""
    q = query.lower()
    kinds = dict(df.dtypes)
    tests = [F.exists(F.col(p), lambda x: F.lower(x).contains(q)) if kinds[p].startswith("array") else F.lower(F.col(p)).contains(q) for p in properties]
    out = df.where(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]))
    return out.orderBy(id).limit(limit) if limit is not None else out


def relevance(df: DataFrame, query: str, name: str, limit: int = 10, id: str = "id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The rows with the highest BM25 score of the query's words (runs of a-z and 0-9 in any case) in a text property;
    ties by id. Only rows with one of the words are counted; three numbers and one a word are broadcast."""
    words = F.regexp_extract_all(F.lower(F.col(name)), F.lit("[a-z0-9]+"), F.lit(0))
    asked = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    rows = df.select("*", F.size(words).alias("__n"), F.filter(words, lambda w: w.isin(asked) if asked else F.lit(False)).alias("__w")).where(F.col(name).isNotNull())
    every = rows.agg(F.count("*").alias("__N"), F.avg("__n").alias("__mean"))
    each = rows.select(id, "__n", F.explode("__w").alias("__w")).groupBy(id, "__n", "__w").agg(F.count("*").alias("__tf"))
    idf = each.groupBy("__w").agg(F.count("*").alias("__df")).crossJoin(F.broadcast(every)).select("__w", "__mean", F.log1p((F.col("__N") - F.col("__df") + 0.5) / (F.col("__df") + 0.5)).alias("__idf"))
    part = F.col("__idf") * F.col("__tf") * (k1 + 1) / (F.col("__tf") + k1 * (1 - b + b * F.col("__n") / F.col("__mean")))
    return each.join(F.broadcast(idf), "__w").groupBy(id).agg(F.sum(part).alias("score")).orderBy(F.col("score").desc(), id).limit(limit)


def hybrid(df: DataFrame, query: str, vector_query: list[float], properties: list[str], alpha: float = 0.7, limit: int = 10, where: dict | None = None, vector: str = "vector", id: str = "id") -> DataFrame:
    """alpha * max(0, cosine) + (1 - alpha) * [a property contains the query]; scores over 0 only."""
    q = F.array(*[F.lit(float(x)) for x in vector_query])
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(p)).contains(query.lower()), F.lit(False)) for p in properties])
    near = F.greatest(F.lit(0.0), F.coalesce(cosine(doubles(F.col(vector)), q), F.lit(0.0)))
    scored = df.where(filters(where)).withColumn("score", F.lit(alpha) * near + F.lit(1 - alpha) * hit.cast("double"))
    return scored.where("score > 0").orderBy(F.col("score").desc(), id).limit(limit)


def aggregate_by(df: DataFrame, name: str, how: str = "count") -> DataFrame:
    """By value of a property (`_null_` for none): count, sum or mean of that property."""
    by = F.coalesce(F.col(name).cast("string"), F.lit("_null_")).alias("value")
    agg = {"count": F.count(F.lit(1)), "sum": F.sum(F.col(name).try_cast("double")), "mean": F.avg(F.col(name).try_cast("double"))}
    if how not in agg:
        raise ValueError(f"unknown aggregation {how}")
    return df.groupBy(by).agg(agg[how].alias("result"))


def boosted_share(df: DataFrame, query: list[float], boost: Column, accepted: Column, top: int = 20, scale: float = 20.0) -> DataFrame:
    """Score of the top rows by boosted similarity: their accepted share times `scale`, and its tier."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = df.withColumn("s", cosine(doubles(F.col("vector")), q) * boost).orderBy(F.col("s").desc(), "id").limit(top)
    share = near.agg(F.avg(accepted.cast("double")).alias("share"))
    tier = F.when(F.col("share") >= 0.75, "exceptional").when(F.col("share") >= 0.5, "strong").when(F.col("share") >= 0.25, "moderate").otherwise("developing")
    return share.select("share", (F.col("share") * scale).alias("score"), tier.alias("tier"))


def text_vectors(dim: int = 64):
    """A deterministic unit vector of a text by signed hashing of its words (a column function)."""
    import xxhash

    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return F.pandas_udf(encode, "array<double>")
