"""Encoders, design matrices and temporal splits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import design as X, encoders as E, splits as S
from .common import APP, Family, applications, rounded, table

family = Family()
QUERIES, ORACLE = family.queries, family.oracle


def labelled(spark, sf):
    return applications(spark, sf).withColumn("y", (F.col("decision") == "Accepted").cast("int"))


_LAB = f"{APP}, lab AS (SELECT *, CAST(decision = 'Accepted' AS INTEGER) AS y FROM app)"


@family.add(f"WITH {APP}, n AS (SELECT id, grade / 100 AS g FROM app), s AS (SELECT avg(g) AS m, stddev_pop(g) AS sd FROM n) SELECT id, round((g - m) / sd, 6) AS gpa_scaled FROM n, s")
def gpa_zscore(spark, sf):
    rows = applications(spark, sf).select("id", E.normalize_gpa(F.col("grade"), "percentage").alias("gpa"))
    return rounded(E.standardize(rows, ["gpa"]).select("id", "gpa_scaled"))


@family.add("SELECT 'ib_total' AS scale, max(p_size) * 1.0 / 2 AS largest FROM part")
def scale_detect(spark, sf):
    rows = table(spark, sf, "part").select((F.col("p_size") / 2).alias("v"))
    return E.detect_scale(rows, "v")


@family.add(f"WITH {_LAB}, g AS (SELECT avg(y) AS g FROM lab), c AS (SELECT university, count(*) AS n, avg(y) AS m FROM lab GROUP BY 1) SELECT university, n, round((n * m + 10 * g) / (n + 10), 6) AS encoded FROM c, g")
def target_smooth(spark, sf):
    return rounded(E.fit_target(labelled(spark, sf), "university", "y"))


@family.add(f"WITH {_LAB}, g AS (SELECT avg(y) AS g FROM lab), c AS (SELECT university, count(*) AS n, sum(y) AS s FROM lab GROUP BY 1) SELECT id, university, y, round(CASE WHEN n <= 1 THEN g ELSE (s - y + 10 * g) / (n - 1 + 10) END, 6) AS encoded FROM lab JOIN c USING (university), g")
def target_loo(spark, sf):
    return rounded(E.leave_one_out(labelled(spark, sf), "university", "y").select("id", "university", "y", "encoded"))


@family.add(f"WITH {APP} SELECT university, round(count(*) / sum(count(*)) OVER (), 6) AS encoded FROM app GROUP BY 1")
def frequency(spark, sf):
    return rounded(E.fit_frequency(applications(spark, sf), "university"))


@family.add(f"WITH {_LAB}, c AS (SELECT university, sum(y) + 0.5 AS p, sum(1 - y) + 0.5 AS n FROM lab GROUP BY 1), d AS (SELECT university, p / sum(p) OVER () AS dp, n / sum(n) OVER () AS dn FROM c) SELECT university, round(ln(dp / dn), 6) AS encoded, round((dp - dn) * ln(dp / dn), 6) AS iv FROM d")
def woe_iv(spark, sf):
    return rounded(E.fit_woe(labelled(spark, sf), "university", "y"))


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@family.add("SELECT p_partkey, " + ", ".join(f"CAST(p_type = '{t}' AS DOUBLE) AS p_type_{t}" for t in _TYPES) + " FROM part")
def onehot(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    return E.one_hot(part, "p_type", E.categories(part, "p_type")).drop("p_type")


@family.add("SELECT p_partkey, " + ", ".join(f"CAST(p_type = '{t}' AS DOUBLE) AS p_type_{t}" for t in _TYPES[1:]) + " FROM part")
def dummy(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    values = E.categories(part, "p_type")
    return E.one_hot(part, "p_type", values, drop=values[0]).drop("p_type")


@family.add("SELECT p_partkey, CAST(CASE p_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(_TYPES)) + " END AS INTEGER) AS p_type_index FROM part")
def ordinal(spark, sf):
    return E.ordinal(table(spark, sf, "part"), "p_type", _TYPES).select("p_partkey", "p_type_index")


@family.add("SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_brand FROM part)")
def category_index(spark, sf):
    return E.index_categories(table(spark, sf, "part"), "p_brand")


@family.add(f"WITH {_LAB}, g AS (SELECT avg(y) AS g FROM lab), c AS (SELECT university, (count(*) * avg(y) + 10 * g) / (count(*) + 10) AS e FROM lab, g GROUP BY university, g), v AS (SELECT unnest([0.2, 0.33, 0.4]) AS v), r AS (SELECT v, university, row_number() OVER (PARTITION BY v ORDER BY abs(e - v), university) AS rn FROM c, v) SELECT CAST(v AS DOUBLE) AS v, university FROM r WHERE rn = 1")
def target_inverse(spark, sf):
    values = spark.createDataFrame([(0.2,), (0.33,), (0.4,)], "v double")
    return E.inverse_lookup(values, E.fit_target(labelled(spark, sf), "university", "y"), "university", "v")


_Q = "CASE quarter(o_orderdate) WHEN 1 THEN 'Winter' WHEN 2 THEN 'Spring' WHEN 3 THEN 'Summer' ELSE 'Fall' END"


@family.add(f"WITH t AS (SELECT o_orderkey, quarter(o_orderdate) - 1 AS i, year(o_orderdate) AS y FROM orders) SELECT o_orderkey, round(cos(i * {2 * math.pi / 4!r}), 6) + 0.0 AS term_cos, round(sin(i * {2 * math.pi / 4!r}), 6) + 0.0 AS term_sin, CAST(y AS INTEGER) AS term_year FROM t")
def term_cyclic(spark, sf):
    names = F.element_at(F.array(*[F.lit(x) for x in ("Winter", "Spring", "Summer", "Fall")]), F.quarter("o_orderdate"))
    rows = table(spark, sf, "orders").withColumn("term", F.concat_ws(" ", names, F.year("o_orderdate").cast("string")))
    cos, sin, year = E.term_cycle(F.col("term"))
    return rows.select("o_orderkey", (F.round(cos, 6) + 0.0).alias("term_cos"), (F.round(sin, 6) + 0.0).alias("term_sin"), year.alias("term_year"))


_T = 2 * math.pi


@family.add(f"SELECT event_id, round(cos((month(ts) - 1) * {_T / 12!r}), 6) AS month_cos, round(sin((month(ts) - 1) * {_T / 12!r}), 6) AS month_sin, round(cos((dayofyear(ts) - 1) * {_T / 365!r}), 6) AS doy_cos, round(sin((dayofyear(ts) - 1) * {_T / 365!r}), 6) AS doy_sin, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS INTEGER) AS days_since, CAST(year(ts) AS INTEGER) AS year, isodow(ts) >= 6 AS is_weekend FROM events")
def date_cyclic(spark, sf):
    return rounded(table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in E.date_cycle(F.col("ts").cast("date")).items()]))


# Design matrix


def _numeric(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))


@family.add("WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem) SELECT l_orderkey AS id, round((l_quantity - mq) / sq, 6) AS q_scaled, round((l_tax - mt) / st, 6) AS t_scaled FROM lineitem, s")
def standard_scale(spark, sf):
    return rounded(E.standardize(_numeric(spark, sf), ["q", "t"]).select("id", "q_scaled", "t_scaled"))


@family.add("WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) - min(l_quantity) AS b FROM lineitem) SELECT l_orderkey AS id, round((l_quantity - a) / b, 6) AS q_scaled FROM lineitem, s")
def minmax_scale(spark, sf):
    return rounded(E.standardize(_numeric(spark, sf), ["q"], "minmax").select("id", "q_scaled"))


_HOLES = "h AS (SELECT l_orderkey AS id, CASE WHEN l_quantity > 5 THEN l_quantity END AS q FROM lineitem)"


@family.add(f"WITH {_HOLES}, c AS (SELECT q, count(*) AS n FROM h WHERE q IS NOT NULL GROUP BY q) SELECT round(avg(coalesce(q, (SELECT avg(q) FROM h))), 6) AS mean_filled, round(avg(coalesce(q, (SELECT median(q) FROM h))), 6) AS median_filled, round(avg(coalesce(q, (SELECT q FROM c ORDER BY n DESC, q LIMIT 1))), 6) AS mode_filled, round(avg(coalesce(q, 0)), 6) AS zero_filled FROM h")
def impute_mean_median_mode(spark, sf):
    rows = _numeric(spark, sf).withColumn("q", F.when(F.col("q") > 5, F.col("q")))
    fills = {how: X.fill_value(rows, "q", how) for how in ("mean", "median", "mode", "zero")}
    return rounded(rows.agg(*[F.avg(F.coalesce(F.col("q"), F.lit(float(v)))).alias(f"{how}_filled") for how, v in fills.items()]))


@family.add("SELECT l_orderkey AS id, round(l_quantity * l_discount, 6) AS q_x_d, round(l_quantity * l_tax, 6) AS q_x_t, round(l_discount * l_tax, 6) AS d_x_t FROM lineitem")
def interactions(spark, sf):
    return rounded(X.interactions(_numeric(spark, sf), ["q", "d", "t"], 1).select("id", "q_x_d", "q_x_t", "d_x_t"))


@family.add("SELECT l_orderkey AS id, round(l_quantity ** 2, 6) AS q_pow2, round(l_quantity ** 3, 6) AS q_pow3 FROM lineitem")
def polynomial(spark, sf):
    return rounded(X.interactions(_numeric(spark, sf), ["q"], 3).select("id", "q_pow2", "q_pow3"))


def _z(c: str) -> str:
    return f"SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} = 0) AS zeros, round(avg({c}), 3) AS mean, round(stddev_pop({c}), 3) AS std, stddev_pop({c}) < 1e-10 AS is_constant, count(*) FILTER (abs({c} - (SELECT avg({c}) FROM n)) > 3 * (SELECT stddev_pop({c}) FROM n) AND (SELECT stddev_pop({c}) FROM n) >= 1e-10) AS outliers FROM n"


@family.add("WITH n AS (SELECT l_quantity AS q, l_discount AS d, 1.0 AS k, l_quantity ** 2 AS o FROM lineitem) " + " UNION ALL ".join(_z(c) for c in "qdko"))
def constant_columns(spark, sf):
    rows = _numeric(spark, sf).select("q", "d", F.lit(1.0).alias("k"), F.pow("q", F.lit(2)).alias("o"))
    out = X.column_report(rows, ["q", "d", "k", "o"])
    return out.withColumn("mean", F.round("mean", 3)).withColumn("std", F.round("std", 3))


@family.add("WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) SELECT count(*) FILTER (abs(o_totalprice - m) > 1.5 * s) AS n FROM orders, s")
def outliers_z(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return E.standardize(o, ["o_totalprice"]).agg(F.count_if(F.abs("o_totalprice_scaled") > 1.5).alias("n"))


@family.add("SELECT 'q' AS a, 'q2' AS b, round(corr(l_quantity, l_quantity * 2 + l_tax), 6) AS correlation FROM lineitem")
def collinear_pairs(spark, sf):
    rows = _numeric(spark, sf).withColumn("q2", F.col("q") * 2 + F.col("t"))
    return rounded(X.collinear(rows, ["q", "q2", "d"]))


@family.add("SELECT round((count(*) FILTER (l_discount = 0) + count(*) FILTER (l_tax = 0)) / (2 * count(*)), 6) AS sparsity FROM lineitem")
def sparsity(spark, sf):
    return rounded(X.sparsity(_numeric(spark, sf), ["d", "t"]))


@family.add(f"WITH s AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM part) SELECT p_partkey, 1.0 AS intercept, round((p_size - m) / s, 6) AS p_size, {', '.join(f'CAST(p_type = {chr(39)}{t}{chr(39)} AS DOUBLE) AS p_type_{t}' for t in _TYPES[1:])}, round((p_size - m) / s * CAST(p_type = 'SMALL' AS DOUBLE), 6) + 0.0 AS p_size_x_p_type_SMALL FROM part, s")
def design_matrix(spark, sf):
    part = table(spark, sf, "part")
    d = X.DesignMatrix([X.Feature("p_size"), X.Feature("p_type", "dummy")], [("p_size", "p_type_SMALL")]).fit(part)
    return rounded(d.transform(part, ("p_partkey",)))


# Splits

_POS = "r AS (SELECT event_id, ts, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)"


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "event_type", "user_id")


def _counts(df):
    return df.groupBy("fold", "split").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@family.add("SELECT split, count(*) AS n FROM (SELECT CASE WHEN CAST(ts AS DATE) <= DATE '2024-01-08' THEN 'train' WHEN CAST(ts AS DATE) > DATE '2024-01-10' AND CAST(ts AS DATE) <= DATE '2024-01-20' THEN 'val' WHEN CAST(ts AS DATE) > DATE '2024-01-20' AND CAST(ts AS DATE) <= DATE '2024-01-28' THEN 'test' END AS split FROM events) GROUP BY 1")
def temporal_split(spark, sf):
    return S.temporal_split(_events(spark, sf), "ts", "2024-01-10", "2024-01-20", "2024-01-28", 2).groupBy("split").agg(F.count("*").alias("n"))


def _fold_sql(ranges: str) -> str:
    return f"WITH {_POS}, f AS (SELECT i AS fold, n // 6 AS v, r.* FROM r, range(5) k(i)), l AS (SELECT fold, pos, CASE {ranges} END AS split FROM f) SELECT CAST(fold AS INTEGER) AS fold, split, count(*) AS n, min(pos) AS first, max(pos) AS last FROM l WHERE split IS NOT NULL GROUP BY ALL"


@family.add(_fold_sql("WHEN pos < v + fold * v THEN 'train' WHEN pos >= v + fold * v + 30 AND pos < v + fold * v + 30 + v THEN 'val'"))
def cv_expanding(spark, sf):
    return _counts(S.expanding_cv(_events(spark, sf), "ts", "event_id", 5, 30))


@family.add(_fold_sql("WHEN pos >= fold * v AND pos < fold * v + v THEN 'train' WHEN pos >= fold * v + v AND pos < fold * v + v + v THEN 'val'"))
def cv_sliding(spark, sf):
    return _counts(S.sliding_cv(_events(spark, sf), "ts", "event_id", 5))


@family.add("WITH g AS (SELECT user_id, min(ts) AS f FROM events GROUP BY 1), p AS (SELECT user_id, row_number() OVER (ORDER BY f, user_id) - 1 AS pos, greatest(1, count(*) OVER () // 4) AS v FROM g), l AS (SELECT i AS fold, CASE WHEN pos < v + i * v THEN 'train' WHEN pos < v + i * v + v THEN 'val' END AS split FROM events JOIN p USING (user_id), range(3) k(i)) SELECT CAST(fold AS INTEGER) AS fold, split, count(*) AS n FROM l WHERE split IS NOT NULL GROUP BY ALL")
def cv_grouped(spark, sf):
    return S.grouped_cv(_events(spark, sf), "ts", "user_id").groupBy("fold", "split").agg(F.count("*").alias("n"))


@family.add("WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, event_type, CASE WHEN rn <= least(greatest(1, floor(n * 0.2)), n - 1) THEN 'test' ELSE 'train' END AS split FROM r")
def stratified_first_k(spark, sf):
    return S.stratified_first(_events(spark, sf), "event_type", ["ts", "event_id"]).select("event_id", "event_type", "split")


@family.add(f"WITH {_POS}, f AS (SELECT i AS fold, pos, n, n // 5 AS v FROM r, range(5) k(i)), e AS (SELECT *, fold * v AS a, CASE WHEN fold = 4 THEN n ELSE (fold + 1) * v END AS b FROM f), l AS (SELECT fold, pos, CASE WHEN pos >= a AND pos < b THEN 'test' WHEN pos < a - 10 OR pos >= b + 20 THEN 'train' END AS split FROM e) SELECT CAST(fold AS INTEGER) AS fold, split, count(*) AS n, min(pos) AS first, max(pos) AS last FROM l WHERE split IS NOT NULL GROUP BY ALL")
def purged_kfold(spark, sf):
    return _counts(S.purged_kfold(_events(spark, sf), "ts", "event_id", 5, 10, 20))


@family.add(f"WITH {_POS} SELECT event_id, pos, CASE WHEN pos < floor(n * (1 - 0.2)) THEN 'train' ELSE 'test' END AS split FROM r")
def train_test_cut(spark, sf):
    return S.train_test_cut(_events(spark, sf), "ts", "event_id").select("event_id", "pos", "split")


_SPLIT = "s AS (SELECT ts, CASE WHEN event_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM events WHERE event_id % 3 <> 0 OR ts > TIMESTAMP '2024-01-15'), e AS (SELECT min(ts) FILTER (split = 'test') AS t0, max(ts) FILTER (split = 'train') AS t1 FROM s)"


@family.add(f"WITH {_SPLIT} SELECT max(t1) >= max(t0) AS has_leakage, count(*) FILTER (split = 'train' AND ts >= t0) AS train_after, count(*) FILTER (split = 'test' AND ts <= t1) AS test_before, CAST(greatest(0, date_diff('day', CAST(max(t0) AS DATE), CAST(max(t1) AS DATE))) AS INTEGER) AS overlap_days FROM s, e")
def leakage_check(spark, sf):
    ev = _events(spark, sf).where("event_id % 3 != 0 or ts > timestamp '2024-01-15'").withColumn("split", F.when(F.col("event_id") % 3 == 0, "test").otherwise("train"))
    return S.leakage(ev, "ts")


@family.add(f"WITH {_POS}, f AS (SELECT i AS fold, n // 6 AS v, r.* FROM r, range(5) k(i)), l AS (SELECT fold, event_type, CASE WHEN pos < v + fold * v THEN 'train' WHEN pos < v + fold * v + v THEN 'val' END AS split FROM f) SELECT CAST(fold AS INTEGER) AS fold, split, count(*) AS n, CAST(sum(CAST(event_type = 'click' AS INTEGER)) AS BIGINT) AS positives FROM l WHERE split IS NOT NULL GROUP BY ALL")
def fold_statistics(spark, sf):
    rows = S.expanding_cv(_events(spark, sf), "ts", "event_id", 5).withColumn("y", (F.col("event_type") == "click").cast("int"))
    return S.fold_statistics(rows, "y")


@family.add("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year, month(o_orderdate) IN (9, 10, 11, 12, 1, 3, 4, 5) AS in_season FROM orders")
def date_features(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in S.date_features(F.col("o_orderdate")).items()])


@family.add("SELECT CASE WHEN year(o_orderdate) <= (SELECT max(year(o_orderdate)) FROM orders) - 1 THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM orders GROUP BY 1")
def holdout_year(spark, sf):
    return S.holdout_years(table(spark, sf, "orders"), "o_orderdate").groupBy("split").agg(F.count("*").alias("n"))
