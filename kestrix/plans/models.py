"""Linear algebra and models."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import functions as F

from ..operators import linalg as L, models as M
from .common import APP, PRED, Family, applications, predictions, rounded, table

family = Family()
QUERIES, ORACLE = family.queries, family.oracle


def _xy(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit(1.0).alias("c0"), F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("d"), (F.col("l_extendedprice") / 1000).alias("y"))


_XY = "x AS (SELECT l_orderkey AS id, 1.0 AS c0, l_quantity AS q, l_discount * 100 AS d, l_extendedprice / 1000 AS y FROM lineitem)"


@family.add(f"WITH {_XY}, u AS (SELECT 0 AS i, 0 AS j, sum(q * q) AS value FROM x UNION ALL SELECT 0, 1, sum(q * d) FROM x UNION ALL SELECT 1, 0, sum(q * d) FROM x UNION ALL SELECT 1, 1, sum(d * d) FROM x) SELECT i, j, round(value, 2) AS value FROM u")
def gram_matrix(spark, sf):
    return rounded(L.gram_long(_xy(spark, sf), ["q", "d"]), 2)


@family.add(f"WITH {_XY} SELECT id, round(2 * q - 0.5 * d, 6) AS v FROM x")
def matvec(spark, sf):
    return rounded(_xy(spark, sf).select("id", L.linear(["q", "d"], [2.0, -0.5]).alias("v")))


_COO = "a AS (SELECT l_returnflag AS i, l_linenumber AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), b AS (SELECT l_linenumber AS i, l_linestatus AS j, avg(l_discount) AS v FROM lineitem GROUP BY ALL)"


def _coo(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.groupBy(F.col("l_returnflag").alias("i"), F.col("l_linenumber").alias("j")).agg(F.sum("l_quantity").alias("v"))
    return a, li.groupBy(F.col("l_linenumber").alias("i"), F.col("l_linestatus").alias("j")).agg(F.avg("l_discount").alias("v"))


@family.add(f"WITH {_COO} SELECT a.i, b.j, round(sum(a.v * b.v), 4) AS v FROM a JOIN b ON a.j = b.i GROUP BY ALL")
def matmul_coo(spark, sf):
    return rounded(L.matmul(*_coo(spark, sf)), 4)


@family.add(f"WITH {_COO} SELECT round(sqrt(sum(v * v)), 4) AS norm FROM a")
def frobenius_norm(spark, sf):
    return rounded(L.frobenius(_coo(spark, sf)[0]), 4)


@family.add("SELECT round(sum(v), 4) AS trace FROM (SELECT l_linenumber AS i, l_suppkey % 7 + 1 AS j, sum(l_tax) AS v FROM lineitem GROUP BY ALL) WHERE i = j")
def matrix_trace(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(L.trace(li.groupBy(F.col("l_linenumber").alias("i"), (F.col("l_suppkey") % 7 + 1).alias("j")).agg(F.sum("l_tax").alias("v"))), 4)


@family.add(f"WITH {_XY}, k AS (SELECT sum(y * q) / sum(q * q) AS k FROM x) SELECT id, round(k * q, 6) AS projection FROM x, k")
def project_onto_vector(spark, sf):
    return rounded(L.project_onto(_xy(spark, sf), "y", "q").select("id", "projection"))


@family.add(f"WITH {_XY} SELECT round(regr_intercept(y, q), 6) AS intercept, round(regr_slope(y, q), 6) AS slope FROM x")
def simple_ols(spark, sf):
    b = L.ridge(_xy(spark, sf), ["c0", "q"], "y")
    return rounded(spark.createDataFrame([tuple(map(float, b))], "intercept double, slope double"))


@family.add(f"WITH {_XY}, f AS (SELECT regr_intercept(y, q) AS a, regr_slope(y, q) AS b FROM x) SELECT round(sum((y - a - b * q) ** 2), 2) AS rss, round(1 - sum((y - a - b * q) ** 2) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2 FROM x, f")
def residual_ss_r2(spark, sf):
    x = _xy(spark, sf)
    fit = L.fit_quality(x, "y", L.linear(["c0", "q"], L.ridge(x, ["c0", "q"], "y")))
    return fit.select(F.round("rss", 2).alias("rss"), F.round("r2", 6).alias("r2"))


@family.add(f"WITH {_XY}, s AS (SELECT sum(q * q) + 10 AS a, sum(q * d) AS b, sum(d * d) + 10 AS c, sum(q * y) AS e, sum(d * y) AS f FROM x) SELECT round((c * e - b * f) / (a * c - b * b), 6) AS b_q, round((a * f - b * e) / (a * c - b * b), 6) AS b_d FROM s")
def ridge_p2_closed_form(spark, sf):
    b = L.ridge(_xy(spark, sf), ["q", "d"], "y", 10.0)
    return rounded(spark.createDataFrame([tuple(map(float, b))], "b_q double, b_d double"))


@family.add(f"WITH {_XY}, s AS (SELECT sum(q * q) AS a, sum(q * d) AS b, sum(d * d) AS c FROM x) SELECT id, round((q * q * c - 2 * q * d * b + d * d * a) / (a * c - b * b), 9) AS leverage FROM x, s")
def leverage_p2(spark, sf):
    return rounded(L.leverage(_xy(spark, sf), ["q", "d"]).select("id", "leverage"), 9)


@family.add(f"WITH {_XY}, s AS (SELECT sum(q * q) + 5 AS a, sum(q * y) AS e FROM x) SELECT round(avg(((y - e / a * q) / (1 - q * q / a)) ** 2), 6) AS loocv FROM x, s")
def ridge_loocv(spark, sf):
    return rounded(L.ridge_loocv(_xy(spark, sf), ["q"], "y", 5.0))


@family.add(f"WITH {_XY}, l AS (SELECT unnest([0.1, 1.0, 10.0, 1000.0]) AS lam), s AS (SELECT sum(q * q) AS a, sum(q * y) AS e FROM x) SELECT CAST(lam AS DOUBLE) AS lam, round(e / (a + lam), 6) AS b_q FROM s, l")
def ridge_path(spark, sf):
    lams = [0.1, 1.0, 10.0, 1000.0]
    path = L.ridge_path(_xy(spark, sf), ["q"], "y", lams)
    return rounded(spark.createDataFrame([(a, float(b[0])) for a, b in zip(lams, path)], "lam double, b_q double"))


@family.add(f"WITH {_XY}, f AS (SELECT *, id % 5 AS fold FROM x), s AS (SELECT fold, sum(q * q) AS a, sum(q * y) AS e FROM f GROUP BY fold), t AS (SELECT fold, (SELECT sum(a) FROM s) - a AS a, (SELECT sum(e) FROM s) - e AS e FROM s), l AS (SELECT unnest([1.0, 100.0]) AS lam) SELECT CAST(lam AS DOUBLE) AS lam, round(avg((y - t.e / (t.a + lam) * q) ** 2), 6) AS mse FROM f JOIN t USING (fold), l GROUP BY lam")
def ridge_cv(spark, sf):
    out = L.ridge_cv(_xy(spark, sf), ["q"], "y", [1.0, 100.0], F.col("id") % 5)
    return rounded(spark.createDataFrame([(a, float(b)) for a, b in out.items()], "lam double, mse double"))


@family.add()
def spectrum(spark, sf):
    """Singular values, explained shares, condition number: eigenvalues, which SQL lacks."""
    x = _xy(spark, sf)
    s, e = L.singular_values(x, ["c0", "q", "d"]), L.explained_variance(x, ["c0", "q", "d"])
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(s, e))], "i int, singular_value double, explained double")


@family.add()
def low_rank_rows(spark, sf):
    return L.low_rank(_xy(spark, sf), ["c0", "q", "d"], 2).select("id", "c0_k", "q_k", "d_k")


@family.add()
def ridge_gcv(spark, sf):
    x = _xy(spark, sf)
    return spark.createDataFrame([(lam, L.ridge_gcv(x, ["c0", "q", "d"], "y", lam)) for lam in (0.1, 10.0)], "lam double, gcv double")


# Models

_LAB = f"{APP}, lab AS (SELECT university, program, CAST(decision = 'Accepted' AS INTEGER) AS y FROM app)"
_POST = f"WITH {_LAB}, g AS (SELECT avg(y) AS g FROM lab), c AS (SELECT university, count(*) AS n, CAST(sum(y) AS BIGINT) AS k, 10 * max(g) + sum(y) AS a, 10 * (1 - max(g)) + count(*) - sum(y) AS b FROM lab, g GROUP BY university)"


def _labelled(spark, sf):
    return applications(spark, sf).withColumn("y", (F.col("decision") == "Accepted").cast("int"))


@family.add(f"{_POST} SELECT university, n, k, round(a, 6) AS alpha, round(b, 6) AS beta, round(a / (a + b), 6) AS mean, round((a - 1) / (a + b - 2), 6) AS mode, round(a * b / ((a + b) ** 2 * (a + b + 1)), 6) AS variance, round(10 / (n + 10), 6) AS shrinkage FROM c")
def beta_posterior(spark, sf):
    return rounded(M.beta_posterior(_labelled(spark, sf), "university", "y"))


@family.add(f"{_POST} SELECT university, CAST(row_number() OVER (ORDER BY a / (a + b), university) AS INTEGER) AS rank FROM c")
def difficulty_rank(spark, sf):
    from ..operators.windows import numbered

    post = M.beta_posterior(_labelled(spark, sf), "university", "y")
    return numbered(post, [F.col("mean"), F.col("university")], name="rank").select("university", F.col("rank").cast("int").alias("rank"))


@family.add(f"WITH {_LAB} SELECT program, round(10 / (count(*) + 10), 6) AS factor FROM lab GROUP BY program")
def shrinkage(spark, sf):
    return rounded(_labelled(spark, sf).groupBy("program").agg(F.count("*").alias("n")).select("program", (10 / (F.col("n") + 10)).alias("factor")))


@family.add()
def beta_interval(spark, sf):
    post = M.beta_posterior(_labelled(spark, sf), "university", "y")
    return post.select("university", M.beta_interval(0.8)("alpha", "beta").alias("i")).select("university", "i.low", "i.high")


def _subjects(spark, sf):
    return table(spark, sf, "events").select("event_id", (1 + F.col("event_id") % 20).cast("int").alias("time"), F.col("value"))


@family.add("SELECT t, count(*) AS n, CAST(sum(CAST(t = 1 + event_id % 20 AS INTEGER)) AS BIGINT) AS events FROM (SELECT event_id, CAST(unnest(range(1, 2 + event_id % 20)) AS INTEGER) AS t FROM events) GROUP BY t")
def person_period(spark, sf):
    return M.person_period(_subjects(spark, sf), "time").groupBy("t").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("events"))


_LIFE = "WITH e AS (SELECT 1 + event_id % 20 AS time FROM events), p AS (SELECT CAST(t AS INTEGER) AS t, count(*) AS at_risk, count(*) FILTER (time = t) AS events FROM e JOIN range(1, 21) g(t) ON t <= time GROUP BY t), h AS (SELECT *, events / at_risk AS hazard FROM p), s AS (SELECT t, at_risk, events, hazard, CASE WHEN max(hazard) OVER w >= 1 THEN 0 ELSE product(1 - hazard) OVER w END AS survival FROM h WINDOW w AS (ORDER BY t)), v AS (SELECT *, coalesce(lag(survival) OVER (ORDER BY t), 1) * hazard AS event_prob FROM s)"


@family.add(f"{_LIFE} SELECT t, at_risk, events, round(hazard, 6) AS hazard, round(survival, 6) AS survival, round(event_prob, 6) AS event_prob FROM v")
def life_table_survival(spark, sf):
    return rounded(M.life_table(M.person_period(_subjects(spark, sf), "time")))


@family.add(f"{_LIFE} SELECT round(sum(t * event_prob), 6) AS expected, min(t) FILTER (survival <= 0.5) AS median, min(t) FILTER (1 - survival >= 0.1) AS p10, min(t) FILTER (1 - survival >= 0.9) AS p90 FROM v")
def expected_event_time(spark, sf):
    return rounded(M.timing(M.life_table(M.person_period(_subjects(spark, sf), "time"))))


_BETA = {"c0": -1.5, "q": 0.04, "d": -0.03}
_SCORE = f"WITH {_XY}, z AS (SELECT id, c0, q, d, " + " + ".join(f"{c} * {b}" for c, b in _BETA.items()) + " AS z FROM x), s AS (SELECT *, 1 / (1 + exp(-z)) AS p FROM z)"


def _scored(spark, sf):
    from ..operators.calibration import sigmoid

    return _xy(spark, sf).withColumn("p", sigmoid(L.linear(list(_BETA), list(_BETA.values()))))


@family.add(f"{_SCORE} SELECT id, round(p, 6) AS p FROM s")
def score_fixed_beta(spark, sf):
    return rounded(_scored(spark, sf).select("id", "p"))


@family.add(f"{_SCORE}, c AS (SELECT id, least(greatest(p, 0.001), 0.999) AS p FROM s) SELECT id, round(greatest(p - 1.96 * sqrt(p * (1 - p) / 100), 0), 6) AS low, round(least(p + 1.96 * sqrt(p * (1 - p) / 100), 1), 6) AS high, CASE WHEN p >= 0.7 THEN 'Likely' WHEN p >= 0.4 THEN 'Possible' ELSE 'Unlikely' END AS label FROM c")
def score_interval_label(spark, sf):
    p = F.least(F.greatest(F.col("p"), F.lit(0.001)), F.lit(0.999))
    low, high = M.normal_interval(p, 100)
    from ..functions.text import bucket_label

    return rounded(_scored(spark, sf).select("id", low.alias("low"), high.alias("high"), bucket_label(p, [(0.7, "Likely"), (0.4, "Possible")], "Unlikely").alias("label")))


_EX = "WITH x AS (SELECT event_id AS id, 1.0 AS c0, value AS v, event_id % 13 AS m FROM events), u AS (SELECT id, 'c0' AS feature, c0 * -1.5 AS c FROM x UNION ALL SELECT id, 'v', v * 0.04 FROM x UNION ALL SELECT id, 'm', m * -0.2 FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(c) DESC, feature) AS rank FROM u)"


@family.add(f"{_EX} SELECT id, CAST(rank AS INTEGER) AS rank, feature, round(c, 6) AS contribution FROM r WHERE rank <= 2")
def explain_topk(spark, sf):
    x = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit(1.0).alias("c0"), F.col("value").alias("v"), (F.col("event_id") % 13).alias("m"))
    return rounded(M.contributions(x, ["c0", "v", "m"], [-1.5, 0.04, Decimal("-0.2")], "id", 2))


@family.add()
def irls_fit(spark, sf):
    x = _xy(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label")), "id")
    m = M.Logistic(["c0", "q", "d"], 0.1).fit(x, "label")
    return spark.createDataFrame([(c, float(b), float(math.exp(b))) for c, b in zip(m.columns, m.beta)], "feature string, beta double, odds_ratio double")


@family.add()
def hazard_fit(spark, sf):
    m = M.fit_hazard(_subjects(spark, sf), "time", ["value"])
    return spark.createDataFrame([(c, float(b)) for c, b in zip(m.columns, m.beta)], "feature string, beta double")


@family.add()
def embedding_fit(spark, sf):
    a, b = M.train_embeddings(_labelled(spark, sf), "university", "program", "y", 4, 10)
    return a.withColumn("kind", F.lit("university")).unionByName(b.withColumn("kind", F.lit("program")))


@family.add()
def attention_weights(spark, sf):
    """Attention of all vectors over the label centroids."""
    from .vectors import vectors

    v = vectors(spark, sf)
    cells = v.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    keys = cells.groupBy(F.col("label").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    return M.attention(v.select("id", "vector"), keys, 64)


@family.add(f"WITH {PRED} SELECT round(avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))), 6) AS log_loss FROM pred")
def log_loss(spark, sf):
    return rounded(predictions(spark, sf).agg(M.log_loss(F.col("y"), F.col("p")).alias("log_loss")))
