"""Vector store queries over embeddings, keyword and hybrid search over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import vectorstore as S
from .common import Family, rounded, table

family = Family()
QUERIES, ORACLE = family.queries, family.oracle


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("vector"), "label")


def _first(spark, sf) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").first().embedding]


_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings), q AS (SELECT e AS qe FROM v WHERE id = 0)"
_COS = "list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)))"


@family.add(f"WITH {_V} SELECT id, round({_COS}, 6) AS similarity FROM v, q ORDER BY {_COS} DESC, id LIMIT 10")
def knn_cosine(spark, sf):
    return rounded(S.search(vectors(spark, sf), _first(spark, sf)).select("id", "similarity"))


@family.add(f"WITH {_V} SELECT id, label, round({_COS}, 6) AS similarity FROM v, q WHERE label >= 3 AND label <= 6 ORDER BY {_COS} DESC, id LIMIT 10")
def knn_filtered(spark, sf):
    return rounded(S.search(vectors(spark, sf), _first(spark, sf), where=S.within("label", 3, 6)).select("id", "label", "similarity"))


@family.add("WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT a.id AS query_id, b.id AS id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank FROM p) SELECT query_id, id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_batch(spark, sf):
    v = vectors(spark, sf)
    return rounded(S.search_batch(v, v.where("id % 50 = 0"), 5))


@family.add("WITH a AS (SELECT doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, text FROM documents JOIN embeddings ON vec_id = doc_id), q AS (SELECT e AS qe FROM a WHERE doc_id = 0), s AS (SELECT doc_id, 0.7 * greatest(0, list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)))) + 0.3 * CAST(contains(lower(text), 'license') AS DOUBLE) AS score FROM a, q) SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 10")
def hybrid_alpha(spark, sf):
    v = vectors(spark, sf)
    rows = table(spark, sf, "documents").select("doc_id", "text").join(v, F.col("doc_id") == F.col("id"))
    return rounded(S.hybrid(rows, "license", _first(spark, sf), ["text"], 0.7, 10).select("doc_id", "score"))


@family.add("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') ORDER BY doc_id LIMIT 20")
def keyword_contains(spark, sf):
    return S.keyword(table(spark, sf, "documents"), "LICENSE", ["text", "source"], 20, "doc_id").select("doc_id", "lang")


@family.add(f"WITH {_V}, b AS (SELECT id, label, {_COS} * (1 + CASE WHEN label = 3 THEN 0.15 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 0.1 ELSE 0 END) AS s FROM v, q), t AS (SELECT * FROM b ORDER BY s DESC, id LIMIT 20), a AS (SELECT avg(CAST(label % 2 = 1 AS DOUBLE)) AS share FROM t) SELECT round(share, 6) AS share, round(share * 20, 6) AS score, CASE WHEN share >= 0.75 THEN 'exceptional' WHEN share >= 0.5 THEN 'strong' WHEN share >= 0.25 THEN 'moderate' ELSE 'developing' END AS tier FROM a")
def boosted_topk_score(spark, sf):
    boost = 1 + F.when(F.col("label") == 3, 0.15).otherwise(0.0) + F.when(F.col("id") % 2 == 0, 0.1).otherwise(0.0)
    return rounded(S.boosted_share(vectors(spark, sf), _first(spark, sf), boost, F.col("label") % 2 == 1))


@family.add("WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), q AS (SELECT unnest(['license', 'password', 'the']) AS t), f AS (SELECT doc_id, t, len(w) AS l, len(list_filter(w, lambda x: x = t)) AS tf FROM d, q), i AS (SELECT t, count(*) AS df FROM f WHERE tf > 0 GROUP BY t) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM f JOIN i USING (t), s WHERE tf > 0 GROUP BY doc_id ORDER BY sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) DESC, doc_id LIMIT 10")
def text_relevance(spark, sf):
    return rounded(S.relevance(table(spark, sf, "documents"), "the LICENSE, password", "text", 10, "doc_id"))


_CENT = "u AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL)"


@family.add(f"WITH {_CENT} SELECT CAST(label AS INTEGER) AS label, CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS mean FROM c")
def label_centroids(spark, sf):
    rows = vectors(spark, sf).select("label", F.posexplode("vector").alias("i", "x"))
    return rounded(rows.groupBy("label", "i").agg(F.avg("x").alias("mean")))


@family.add(f"WITH {_CENT}, g AS (SELECT label, list(m ORDER BY i) AS e FROM c GROUP BY label) SELECT a.label AS a, b.label AS b, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS similarity FROM g a, g b")
def similarity_matrix(spark, sf):
    rows = vectors(spark, sf).select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    g = rows.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("e"))
    pairs = V.all_pairs(g.select(F.col("label").alias("a"), F.col("e").alias("x")), g.select(F.col("label").alias("b"), F.col("e").alias("y")))
    return rounded(pairs.select("a", "b", V.cosine(F.col("x"), F.col("y")).alias("similarity")))


@family.add("SELECT coalesce(CAST(CASE WHEN label > 1 THEN label END AS VARCHAR), '_null_') AS value, count(*) AS result FROM embeddings GROUP BY 1")
def aggregate_by_property(spark, sf):
    v = vectors(spark, sf).withColumn("label", F.when(F.col("label") > 1, F.col("label")))
    return S.aggregate_by(v, "label")


@family.add("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS l1, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS l2, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS linf FROM embeddings")
def vector_norms(spark, sf):
    e = F.col("vector")
    return rounded(vectors(spark, sf).select("id", V.norm(e, 1).alias("l1"), V.norm(e).alias("l2"), V.norm(e, float("inf")).alias("linf")))


@family.add(f"WITH {_V} SELECT id, round(degrees(acos(least(1, greatest(-1, {_COS})))), 4) AS degrees FROM v, q WHERE id <> 0")
def vector_angles(spark, sf):
    q = F.array(*[F.lit(x) for x in _first(spark, sf)])
    return vectors(spark, sf).where("id != 0").select("id", F.round(V.angle(F.col("vector"), q, True), 4).alias("degrees"))


@family.add()
def text_hash_vectors(spark, sf):
    """Vectors of documents by signed hashing of words, which SQL lacks."""
    return table(spark, sf, "documents").select("doc_id", S.text_vectors(32)("text").alias("vector"))
