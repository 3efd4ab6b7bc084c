"""Bundled analyses, comparisons, chart tables, subspaces, cases, stores and the relational additions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.vectors import doubles
from ..operators import attention as A, calibration as C, cases as K, charts as H, discrimination as D, encoders as E, etl, linalg as L, objects as O, windows as W
from .common import APP, PRED, Family, applications, predictions, rounded, table

family = Family()
QUERIES, ORACLE = family.queries, family.oracle

_BIN = " + ".join(f"CAST(p >= 0.{k} AS INTEGER)" for k in range(1, 10))
_BINS = f"b AS (SELECT grp, {_BIN} AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM pred GROUP BY ALL)"
_ECE = "e AS (SELECT grp, sum(n * abs(acc - conf)) / sum(n) AS ece, coalesce(max(abs(acc - conf)) FILTER (n >= 10), max(abs(acc - conf))) AS mce FROM b GROUP BY grp)"


@family.add(f"WITH {PRED}, {_BINS}, {_ECE}, r AS (SELECT grp, count(*) AS n, avg((p - y) ** 2) AS brier FROM pred GROUP BY grp) SELECT grp, r.n, round(brier, 6) AS brier, round(ece, 6) AS ece, round(mce, 6) AS mce, CAST(row_number() OVER (ORDER BY ece, grp) AS INTEGER) AS rank FROM e JOIN r USING (grp)")
def compare_calibration(spark, sf):
    return rounded(C.compare_calibration(predictions(spark, sf), "grp"))


_ONE = PRED.replace("o_orderpriority AS grp", "1 AS grp")


@family.add(f"WITH {_ONE}, {_BINS}, {_ECE}, q AS (SELECT count(*) AS n, avg(y) AS base, avg((p - y) ** 2) AS brier, sum((y - p) * (1 - 2 * p)) / sqrt(sum((1 - 2 * p) ** 2 * p * (1 - p))) AS z FROM pred), d AS (SELECT max(q.base * (1 - q.base)) AS uncertainty, sum(b.n / q.n * (acc - q.base) ** 2) AS resolution, sum(b.n / q.n * (conf - acc) ** 2) AS reliability FROM b, q), o AS (SELECT least((row_number() OVER (ORDER BY p, id) - 1) // (count(*) OVER () // 10), 9) AS g, y, p FROM pred), h AS (SELECT sum(y) AS o, sum(p) AS e, avg(p) AS m FROM o GROUP BY g), x AS (SELECT sum((o - e) ** 2 / (e * (1 - m))) FILTER (e * (1 - m) > 0) AS chi2, count(*) - 2 AS df FROM h) SELECT q.n, round(base, 6) AS base, round(brier, 6) AS brier, round(uncertainty, 6) AS uncertainty, round(resolution, 6) AS resolution, round(reliability, 6) AS reliability, round(ece, 6) AS ece, round(mce, 6) AS mce, round(chi2, 4) AS chi2, df, round(z, 4) AS z FROM q, d, e, x")
def full_calibration(spark, sf):
    out = C.full_calibration(predictions(spark, sf))
    return rounded(out.withColumn("chi2", F.round("chi2", 4)).withColumn("z", F.round("z", 4)))


_AUC = "k AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2 AS r FROM pred), a AS (SELECT grp, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM k GROUP BY grp)"


@family.add(f"WITH {PRED}, {_AUC} SELECT grp, round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini, CAST(row_number() OVER (ORDER BY auc DESC, grp) AS INTEGER) AS rank FROM a")
def compare_roc(spark, sf):
    return rounded(D.compare_roc(predictions(spark, sf), "grp"))


@family.add(f"WITH {_ONE}, {_AUC}, s AS (SELECT p, sum(sum(y)) OVER w / (SELECT sum(y) FROM pred) - sum(sum(1 - y)) OVER w / (SELECT sum(1 - y) FROM pred) AS j FROM pred GROUP BY p WINDOW w AS (ORDER BY p DESC)), o AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS rn, count(*) OVER () AS n FROM pred), ap AS (SELECT sum(tp / rn) FILTER (y = 1) / sum(y) AS ap FROM (SELECT y, rn, sum(y) OVER (ORDER BY rn) AS tp FROM o)), l AS (SELECT avg(y) FILTER (rn <= ceil(n * 0.1)) / avg(y) AS l10, avg(y) FILTER (rn <= ceil(n * 0.5)) / avg(y) AS l50 FROM o) SELECT round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini, round(ap, 6) AS average_precision, round((SELECT max(j) FROM s), 6) AS ks, round(l10, 6) AS lift_10, round(l50, 6) AS lift_50, (SELECT count(*) FROM pred WHERE p >= 0.5 AND y = 1) AS tp FROM a, ap, l")
def full_discrimination(spark, sf):
    return rounded(D.full_discrimination(predictions(spark, sf)).select("auc", "gini", "average_precision", "ks", "lift_10", "lift_50", "tp"))


@family.add(f"WITH {_ONE}, {_BINS}, {_ECE}, {_AUC} SELECT round(avg((p - y) ** 2), 6) AS brier, round(avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)), 6) AS accuracy, round((SELECT auc FROM a), 6) AS auc, round((SELECT ece FROM e), 6) AS ece, round((SELECT mce FROM e), 6) AS mce FROM pred")
def evaluate_model(spark, sf):
    return rounded(D.evaluate(predictions(spark, sf)).select("brier", "accuracy", "auc", "ece", "mce"))


@family.add(f"WITH {PRED}, c AS (SELECT grp, avg(CAST(p >= 0.5 AS DOUBLE)) AS positive_rate, coalesce(avg(CAST(p >= 0.5 AS DOUBLE)) FILTER (y = 1), 0) AS recall, coalesce(avg(CAST(p >= 0.5 AS DOUBLE)) FILTER (y = 0), 1) AS false_positive_rate, coalesce(avg(y) FILTER (p >= 0.5), 0) AS precision FROM pred GROUP BY grp) SELECT grp, round(positive_rate, 6) AS positive_rate, round(recall, 6) AS recall, round(false_positive_rate, 6) AS false_positive_rate, round(precision, 6) AS precision, round(max(positive_rate) OVER () - positive_rate, 6) AS gap FROM c")
def fairness_by_group(spark, sf):
    return rounded(H.fairness(predictions(spark, sf), "grp"))


_TIME = "pred AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS period, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice / 500000 AS p FROM orders)"


@family.add(f"WITH {_TIME} SELECT period, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)), 6) AS accuracy, round(avg(y), 6) AS base FROM pred GROUP BY period")
def performance_over_time(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(H.performance_over_time(o.select(F.year("o_orderdate").alias("period"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 500000).alias("p")), "period"))


_XY = "x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS q, l_discount * 100 AS d, l_extendedprice / 1000 AS y FROM lineitem), s AS (SELECT sum(q * q) AS a, sum(q * d) AS b, sum(d * d) AS c, sum(q * y) AS e, sum(d * y) AS f FROM x), t AS (SELECT (c * e - b * f) / (a * c - b * b) AS bq, (a * f - b * e) / (a * c - b * b) AS bd FROM s)"


def _xy(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("d"), (F.col("l_extendedprice") / 1000).alias("y"))


@family.add(f"WITH {_XY} SELECT id, round(bq * q + bd * d, 6) AS projection, round(y - bq * q - bd * d, 6) AS residual FROM x, t")
def project_onto_subspace(spark, sf):
    return rounded(L.project_subspace(_xy(spark, sf), ["q", "d"], "y").select("id", "projection", "residual"))


@family.add(f"WITH {_XY}, m AS (SELECT a / (a * c - b * b) AS ia, b / (a * c - b * b) AS ib, c / (a * c - b * b) AS ic FROM s) SELECT i.id AS i, j.id AS j, round(i.q * j.q * ic - (i.q * j.d + i.d * j.q) * ib + i.d * j.d * ia, 9) AS value FROM x i, (SELECT * FROM x WHERE id IN (SELECT min(id) FROM x)) j, m")
def hat_matrix_column(spark, sf):
    x = _xy(spark, sf)
    return rounded(L.hat_entries(x, ["q", "d"], "id", x.agg(F.min("id").alias("id"))), 9)


@family.add("SELECT 'd' AS name, true AS orthogonal UNION ALL SELECT 'q', true")
def residual_orthogonality(spark, sf):
    return L.orthogonality(L.project_subspace(_xy(spark, sf), ["q", "d"], "y"), ["q", "d"], "residual", 1e-8).select("name", "orthogonal")


@family.add(f"WITH {_XY} SELECT round(abs(sum(q * y)), 2) AS inner, round(sqrt(sum(q * q)) * sqrt(sum(y * y)), 2) AS bound, abs(sum(q * y)) <= sqrt(sum(q * q)) * sqrt(sum(y * y)) AS holds FROM x")
def cauchy_schwarz(spark, sf):
    return rounded(L.cauchy_schwarz(_xy(spark, sf), "q", "y"), 2)


@family.add("WITH a AS (SELECT l_returnflag AS i, sum(l_discount) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_linestatus AS j, sum(l_tax) AS v FROM lineitem GROUP BY 1) SELECT i, j, round(a.v * b.v, 4) AS v FROM a, b")
def outer_product(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(L.outer(li.groupBy(F.col("l_returnflag").alias("i")).agg(F.sum("l_discount").alias("v")), li.groupBy(F.col("l_linestatus").alias("i")).agg(F.sum("l_tax").alias("v"))), 4)


@family.add("SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END + CASE WHEN i = j THEN n ELSE 0 END AS v FROM (SELECT CAST(l_linenumber AS BIGINT) - 1 AS i, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1) JOIN (SELECT unnest(range(7)) AS j) ON i = j")
def identity_plus_diagonal(spark, sf):
    d = table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("bigint").alias("i")).agg(F.count("*").cast("double").alias("v"))
    return L.identity(spark, 7).unionByName(L.diagonal(d)).groupBy("i", "j").agg(F.sum("v").alias("v"))


@family.add("SELECT l_orderkey * 10 + l_linenumber AS id, c.k AS column, CASE c.k WHEN 0 THEN l_discount ELSE l_tax END AS value FROM lineitem, (VALUES (0), (1)) c(k) WHERE CASE c.k WHEN 0 THEN l_discount ELSE l_tax END <> 0")
def sparse_cells(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return L.to_sparse(li, "id", ["l_discount", "l_tax"])


@family.add(f"WITH {_XY} SELECT a, b, round(r, 6) AS r FROM (SELECT 'q' AS a, 'q' AS b, corr(q, q) AS r FROM x UNION ALL SELECT 'q', 'd', corr(q, d) FROM x UNION ALL SELECT 'd', 'q', corr(d, q) FROM x UNION ALL SELECT 'd', 'd', corr(d, d) FROM x)")
def correlation_cells(spark, sf):
    return rounded(L.correlations(_xy(spark, sf), ["q", "d"]))


@family.add(f"WITH {_XY}, r AS (SELECT id, y - bq * q - bd * d AS r FROM x, t) SELECT id, round((r - avg(r) OVER ()) / stddev_pop(r) OVER (), 4) AS standardized FROM r")
def standardized_residuals(spark, sf):
    fit = L.project_subspace(_xy(spark, sf), ["q", "d"], "y")
    return rounded(H.residuals(fit, "y", "projection").select("id", "standardized"), 4)


_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label, vec_id % 40 + 60.0 AS gpa FROM embeddings), q AS (SELECT e AS qe FROM v WHERE id = 0)"
_COS = "list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)))"


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("vector"), "label")
    return v.withColumn("gpa", F.col("id") % 40 + 60.0), [float(x) for x in v.where("id = 0").first().vector]


@family.add(f"WITH {_V} SELECT id, gpa, round({_COS}, 6) AS similarity FROM v, q WHERE gpa >= 70 AND gpa <= 90 ORDER BY {_COS} DESC, id LIMIT 10")
def matching_students(spark, sf):
    v, q = _vectors(spark, sf)
    return rounded(O.find_matching_students(v, q, 10, 70, 90).select("id", "gpa", "similarity"))


@family.add(f"WITH {_V} SELECT id, round({_COS}, 6) AS similarity FROM v, q WHERE label = 3 ORDER BY {_COS} DESC, id LIMIT 10")
def recommended_programs(spark, sf):
    v, q = _vectors(spark, sf)
    return rounded(O.recommend_programs(v.withColumn("province", F.col("label").cast("string")), q, "3").select("id", "similarity"))


_CASE = f"c AS (SELECT id, e, 'U' || label AS university, 'P' || (id % 7) AS program, CASE WHEN id % 5 <> 0 THEN gpa END AS grade, CASE id % 4 WHEN 0 THEN 'Accepted' WHEN 1 THEN 'Rejected' WHEN 2 THEN 'Deferred' ELSE 'Waitlisted' END AS decision FROM v)"


def _cases(spark, sf):
    v, q = _vectors(spark, sf)
    k = F.col("id") % 4
    decision = F.when(k == 0, "Accepted").when(k == 1, "Rejected").when(k == 2, "Deferred").otherwise("Waitlisted")
    return v.select("id", "vector", F.concat(F.lit("U"), F.col("label").cast("string")).alias("university"), F.concat(F.lit("P"), (F.col("id") % 7).cast("string")).alias("program"), F.when(F.col("id") % 5 != 0, F.col("gpa")).alias("grade"), decision.alias("decision")), q


@family.add(f"WITH {_V}, {_CASE}, n AS (SELECT *, {_COS} * (1 + CASE WHEN lower(program) = 'p3' THEN 0.15 WHEN contains(lower(program), 'p3') OR contains('p3', lower(program)) THEN 0.05 ELSE 0 END + CASE WHEN lower(university) = 'u2' THEN 0.1 ELSE 0 END + CASE WHEN abs(grade - 85) <= 5 THEN 0.1 ELSE 0 END) AS s FROM c, q), t AS (SELECT * FROM n ORDER BY s DESC, id LIMIT 20), a AS (SELECT count(*) AS n, avg(CAST(decision = 'Accepted' AS DOUBLE)) AS share FROM t) SELECT n, round(share, 6) AS share, round(share * 20, 6) AS score, CASE WHEN share >= 0.75 THEN 'exceptional' WHEN share >= 0.5 THEN 'strong' WHEN share >= 0.25 THEN 'moderate' ELSE 'developing' END AS tier FROM a")
def case_assessment(spark, sf):
    cases, q = _cases(spark, sf)
    return rounded(K.assess(cases, q, "U2", "P3", 85.0))


@family.add(f"WITH {_V}, {_CASE}, n AS (SELECT *, {_COS} AS s FROM c, q WHERE grade IS NOT NULL ORDER BY s DESC, id LIMIT 6) SELECT id, grade, round(greatest(0, s) * 20, 1) AS ec_score, CASE WHEN s >= 0.7 THEN 1 WHEN s >= 0.5 THEN 2 WHEN s >= 0.3 THEN 3 ELSE 4 END AS ec_tier, CASE decision WHEN 'Deferred' THEN 'Waitlisted' ELSE decision END AS decision FROM n")
def similar_cases(spark, sf):
    cases, q = _cases(spark, sf)
    return K.similar_cases(cases, q).select("id", "grade", "ec_score", "ec_tier", "decision")


@family.add(f"WITH {_V}, {_CASE} SELECT count(*) FILTER (decision = 'Accepted') AS accepted, count(*) FILTER (decision = 'Rejected') AS rejected, count(*) FILTER (decision NOT IN ('Accepted', 'Rejected')) AS other FROM c")
def case_outcomes(spark, sf):
    return K.outcome_counts(_cases(spark, sf)[0])


@family.add(f"WITH {_V}, u AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), g AS (SELECT label, list(x ORDER BY i) AS qe FROM m GROUP BY label), s AS (SELECT id, g.label AS category, {_COS} AS similarity FROM v, g) SELECT id, CAST(category AS INTEGER) AS category, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.35")
def case_categories(spark, sf):
    v, _ = _vectors(spark, sf)
    cells = v.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centers = cells.groupBy(F.col("label").alias("category")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    return rounded(K.classify(v, centers))


@family.add(f"WITH {APP}, a AS (SELECT id, university, program, grade, CAST(decision = 'Accepted' AS INTEGER) AS y FROM app), g AS (SELECT avg(grade) AS m, stddev_pop(grade) AS s, avg(y) AS base, count(*) AS n FROM a), u AS (SELECT university, (count(*) * avg(y) + 10 * max(base)) / (count(*) + 10) AS e FROM a, g GROUP BY university), f AS (SELECT program, count(*) / max(n) AS e FROM a, g GROUP BY program) SELECT id, round((grade - g.m) / g.s, 6) AS grade_scaled, round(u.e, 6) AS university_encoded, round(f.e, 6) AS program_frequency FROM a, g, u, f WHERE u.university = a.university AND f.program = a.program")
def composite_encoder(spark, sf):
    rows = applications(spark, sf).withColumn("y", (F.col("decision") == "Accepted").cast("int"))
    made = E.Composite([E.Encoder("gpa", "grade"), E.Encoder("target", "university"), E.Encoder("frequency", "program")]).fit(rows, "y")
    return rounded(made.transform(rows).select("id", *made.names()))


@family.add(f"WITH {APP}, a AS (SELECT id, university, CAST(decision = 'Accepted' AS INTEGER) AS y FROM app), g AS (SELECT avg(y) AS base FROM a), u AS (SELECT university, sum(y) AS s, count(*) AS n FROM a GROUP BY 1) SELECT id, round(CASE WHEN n <= 1 THEN base ELSE (s - y + 10 * base) / (n - 1 + 10) END, 6) AS university_encoded FROM a JOIN u USING (university), g")
def admission_encoding(spark, sf):
    rows = applications(spark, sf).withColumn("y", (F.col("decision") == "Accepted").cast("int"))
    out, _ = E.encode_admissions(rows, "y", None)
    return rounded(out.select("id", "university_encoded"))


@family.add("SELECT CAST(o_custkey AS VARCHAR) AS student_id, count(*) AS n FROM orders GROUP BY 1")
def records_and_documents(spark, sf):
    """Records to documents of JSON and back: the number of applications stays."""
    o = table(spark, sf, "orders")
    rows = o.groupBy(F.col("o_custkey").cast("string").alias("student_id")).agg(F.collect_list(F.create_map(F.lit("order"), F.col("o_orderkey").cast("string"))).alias("applications"))
    docs = etl.document_of(etl.record_of(rows))
    return docs.select("student_id", F.size(F.from_json("document", "student_id string, applications array<map<string,string>>")["applications"]).cast("bigint").alias("n"))


# Relational additions


@family.add("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY user_id HAVING count(*) >= 5 AND avg(value) > 20")
def having_groups(spark, sf):
    by = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rounded(by.where("n >= 5 and mean > 20"))


@family.add("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_distinct(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")))


@family.add("SELECT l_suppkey AS k FROM lineitem EXCEPT ALL SELECT ps.s_suppkey FROM supplier ps")
def except_all(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k")).exceptAll(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")))


@family.add("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@family.add("SELECT event_id, event_type, CAST(user_id AS BIGINT) AS user, round(value * 2, 6) AS twice FROM events")
def json_functions(spark, sf):
    text = F.to_json(F.struct("event_type", F.struct(F.col("user_id").alias("user"), F.col("value")).alias("who")))
    rows = table(spark, sf, "events").select("event_id", text.alias("doc"))
    return rounded(rows.select("event_id", F.get_json_object("doc", "$.event_type").alias("event_type"), F.get_json_object("doc", "$.who.user").cast("bigint").alias("user"), (F.from_json("doc", "who struct<value: double>")["who"]["value"] * 2).alias("twice")))


@family.add("WITH e AS (SELECT count(DISTINCT o_custkey) AS n, median(o_totalprice) AS m FROM orders) SELECT true AS distinct_is_near, true AS median_is_near FROM e")
def approximate_aggregates(spark, sf):
    """HyperLogLog and quantile sketches within five and two per cent of the exact values."""
    o = table(spark, sf, "orders").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.count_distinct("o_custkey").alias("n"), F.percentile_approx("o_totalprice", 0.5, 10_000).alias("m"), F.median("o_totalprice").alias("exact"))
    return o.select((F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("distinct_is_near"), (F.abs(F.col("m") - F.col("exact")) <= 0.02 * F.col("exact")).alias("median_is_near"))


@family.add()
def self_attention_rows(spark, sf):
    """Multi-head attention over each vector's quarters as tokens; drawn weights, which SQL lacks."""
    v, _ = _vectors(spark, sf)
    n = F.size("vector")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("vector", k * F.floor(n / 4).cast("int") + 1, 16))
    return v.select("id", A.Attention(16, 4).build().self_attention(tokens).alias("a")).select("id", F.size("a.output").alias("tokens"), F.size("a.weights").alias("heads"))


@family.add()
def attention_patterns(spark, sf):
    rows = applications(spark, sf).withColumn("y", (F.col("decision") == "Accepted").cast("int"))
    return A.AttentionModel(["grade", "l_discount"], ["university", "program"], 8, 2).patterns(rows)
