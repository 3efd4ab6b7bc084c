"""Calibration and discrimination queries over labelled scores."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import calibration as C, discrimination as D
from .common import PRED, TIES, Family, predictions, rounded, table, tied_predictions

family = Family()
QUERIES, ORACLE = family.queries, family.oracle

_EDGES = [i / 10 for i in range(1, 10)]
_BIN = "(" + " + ".join(f"CAST(p >= {e!r} AS INTEGER)" for e in _EDGES) + ")"
_BINS = f"b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM pred GROUP BY 1)"


@family.add(f"WITH {PRED} SELECT round(avg((p - y) ** 2), 6) AS brier FROM pred")
def brier(spark, sf):
    return rounded(C.brier(predictions(spark, sf)))


@family.add(f"WITH {PRED}, {_BINS}, t AS (SELECT sum(n) AS nn, sum(n * acc) / sum(n) AS base FROM b), d AS (SELECT max(base * (1 - base)) AS u, sum(n / nn * (acc - base) ** 2) AS res, sum(n / nn * (conf - acc) ** 2) AS rel FROM b, t) SELECT round(u, 6) AS uncertainty, round(res, 6) AS resolution, round(rel, 6) AS reliability, round(u - res + rel, 6) AS brier FROM d")
def brier_decomposition(spark, sf):
    return rounded(C.brier_decomposition(predictions(spark, sf)))


@family.add(f"WITH {PRED}, {_BINS} SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b")
def ece_uniform(spark, sf):
    return rounded(C.expected_calibration_error(predictions(spark, sf), C.uniform_edges(10)))


@family.add(f"WITH {PRED}, q AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM pred), b AS (SELECT len(list_filter(e, lambda x: x <= p)) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM pred, q GROUP BY 1) SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b")
def ece_quantile(spark, sf):
    df = predictions(spark, sf)
    return rounded(C.expected_calibration_error(df, C.quantile_edges(df, 10)))


@family.add(f"WITH {PRED}, {_BINS} SELECT round(coalesce(max(abs(acc - conf)) FILTER (n >= 10), max(abs(acc - conf))), 6) AS mce FROM b")
def mce_min_samples(spark, sf):
    return rounded(C.maximum_calibration_error(predictions(spark, sf), C.uniform_edges(10)))


@family.add(f"WITH {TIES}, {_BINS} SELECT CAST(r.bin AS INTEGER) AS bin, round((r.bin + 0.5) / 10, 6) AS center, round(acc, 6) AS acc, coalesce(n, 0) AS n FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin")
def reliability_bins(spark, sf):
    return rounded(C.reliability(tied_predictions(spark, sf)))


@family.add(f"WITH {PRED}, {_BINS} SELECT CAST(bin AS INTEGER) AS bin, n, round(conf, 6) AS conf, round(acc, 6) AS acc FROM b")
def calibration_curve(spark, sf):
    return rounded(C.binned(predictions(spark, sf), C.uniform_edges(10)))


_Z = NormalDist().inv_cdf(0.975)


@family.add(f"WITH {PRED}, {_BINS}, w AS (SELECT bin, n, acc AS p, {_Z!r} AS z FROM b) SELECT CAST(bin AS INTEGER) AS bin, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0), 6) AS low, round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1), 6) AS high FROM w")
def wilson_bins(spark, sf):
    by = predictions(spark, sf).groupBy(C.bin_of(F.col("p"), C.uniform_edges(10)).alias("bin")).agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    low, high = C.wilson(F.col("k"), F.col("n"))
    return rounded(by.select("bin", low.alias("low"), high.alias("high")))


_HL = f"WITH {PRED}, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rn, count(*) OVER () AS nn FROM pred), g AS (SELECT least((rn - 1) // (nn // 10), 9) AS g, sum(y) AS o, sum(p) AS e, avg(p) AS m FROM r GROUP BY 1)"


@family.add(f"{_HL} SELECT round(sum((o - e) ** 2 / (e * (1 - m))), 4) AS chi2, count(*) - 2 AS df FROM g")
def hosmer_lemeshow_chi2(spark, sf):
    return C.hosmer_lemeshow(predictions(spark, sf)).select(F.round("chi2", 4).alias("chi2"), "df")


@family.add()
def hosmer_lemeshow_p(spark, sf):
    """The p-value comes from the incomplete gamma function, which SQL lacks."""
    row = C.hosmer_lemeshow(predictions(spark, sf)).first()
    return spark.createDataFrame([(row.chi2, row.df, C.chi2_survival(row.chi2, row.df))], "chi2 double, df bigint, p_value double")


@family.add(f"WITH {PRED} SELECT round(sum((y - p) * (1 - 2 * p)) / sqrt(sum((1 - 2 * p) ** 2 * p * (1 - p))), 6) AS z FROM pred")
def spiegelhalter_z(spark, sf):
    return rounded(C.spiegelhalter(predictions(spark, sf)))


@family.add(f"WITH {PRED}, b AS (SELECT grp, {_BIN} AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM pred GROUP BY ALL) SELECT grp, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b GROUP BY grp")
def subgroup_ece(spark, sf):
    return rounded(C.expected_calibration_error(predictions(spark, sf), C.uniform_edges(10), ("grp",)))


_LOGIT = "ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6)))"


@family.add(f"WITH {PRED} SELECT id, round(1 / (1 + exp(-(0.7 * {_LOGIT} - 0.2))), 6) AS p FROM pred")
def platt_apply(spark, sf):
    return rounded(predictions(spark, sf).select("id", C.platt(F.col("p"), 0.7, -0.2).alias("p")))


_GRID = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]


@family.add(f"WITH {PRED}, g AS (SELECT unnest({_GRID}) AS temperature), z AS (SELECT y, {_LOGIT} AS z FROM pred) SELECT CAST(temperature AS DOUBLE) AS temperature, round(avg(-CASE WHEN y = 1 THEN ln(1 / (1 + exp(-z / temperature))) ELSE ln(1 / (1 + exp(z / temperature))) END), 6) AS nll FROM z, g GROUP BY 1")
def temperature_grid(spark, sf):
    return rounded(C.temperatures(predictions(spark, sf), _GRID))


@family.add()
def platt_fit(spark, sf):
    a, b = C.platt_fit(predictions(spark, sf))
    return spark.createDataFrame([(a, b)], "a double, b double")


@family.add()
def isotonic_pava(spark, sf):
    return C.isotonic(predictions(spark, sf))


@family.add(f"WITH {PRED} SELECT count(*) AS n, count(*) FILTER (p IS NULL OR y IS NULL) AS nulls, count(*) FILTER (p < 0 OR p > 1) AS out_of_range, count(*) FILTER (y NOT IN (0, 1)) AS not_binary FROM pred")
def probability_faults(spark, sf):
    return C.probability_faults(predictions(spark, sf))


# Discrimination

_CUM = "t AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM pred GROUP BY p), s AS (SELECT p, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS P_, CAST(sum(neg) OVER () AS BIGINT) AS N_ FROM t WINDOW w AS (ORDER BY p DESC))"
_RANK = "r AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS rn, sum(y) OVER (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING) AS tp, count(*) OVER () AS nn, sum(y) OVER () AS yy FROM pred)"
_AREA = "SELECT p, row_number() OVER (ORDER BY p) AS x FROM pred"


@family.add(f"WITH {TIES}, {_CUM} SELECT round(p, 6) AS threshold, round(fp / N_, 6) AS fpr, round(tp / P_, 6) AS tpr FROM s UNION ALL SELECT NULL, 0, 0")
def roc_curve(spark, sf):
    return rounded(D.roc_curve(tied_predictions(spark, sf)))


_AUC = "SELECT {k}round((sum(mid * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(cnt) - sum(pos))), 6) AS auc FROM (SELECT {k}p, sum(y) AS pos, count(*) AS cnt, sum(count(*)) OVER ({part}ORDER BY p) - (count(*) - 1) / 2 AS mid FROM pred GROUP BY {k}p){by}"


@family.add(f"WITH {PRED} " + _AUC.format(k="", part="", by=""))
def roc_auc(spark, sf):
    return rounded(D.roc_auc(predictions(spark, sf)))


@family.add(f"WITH {TIES} " + _AUC.format(k="", part="", by=""))
def roc_auc_ties(spark, sf):
    return rounded(D.roc_auc(tied_predictions(spark, sf)))


@family.add(f"WITH {PRED} " + _AUC.format(k="grp, ", part="PARTITION BY grp ", by=" GROUP BY grp"))
def subgroup_auc(spark, sf):
    return rounded(D.roc_auc(predictions(spark, sf), ("grp",)))


@family.add("WITH pred AS (SELECT 'price' AS model, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice / 500000 AS p FROM orders UNION ALL SELECT 'key', CAST(o_orderstatus = 'F' AS INTEGER), (o_orderkey % 997) / 997 FROM orders) " + _AUC.format(k="model, ", part="PARTITION BY model ", by=" GROUP BY model"))
def model_comparison(spark, sf):
    df = predictions(spark, sf)
    other = df.select(F.lit("key").alias("model"), "y", ((F.col("id") % 997) / 997).alias("p"))
    return rounded(D.roc_auc(df.select(F.lit("price").alias("model"), "y", "p").unionByName(other), ("model",)))


@family.add(f"WITH {TIES}, {_CUM} SELECT round(p, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / P_, 6) AS recall FROM s UNION ALL SELECT NULL, 1, 0")
def pr_curve(spark, sf):
    return rounded(D.pr_curve(tied_predictions(spark, sf)))


@family.add(f"WITH {PRED}, {_CUM}, c AS (SELECT p, tp / P_ AS rec, tp / (tp + fp) AS prec FROM s UNION ALL SELECT 2, 0, 1), l AS (SELECT rec, prec, lag(rec) OVER (ORDER BY p DESC) AS r0, lag(prec) OVER (ORDER BY p DESC) AS p0 FROM c) SELECT round(sum((rec - r0) * (prec + p0) / 2), 6) AS pr_auc FROM l")
def pr_auc(spark, sf):
    return rounded(D.pr_auc(predictions(spark, sf)))


@family.add(f"WITH {PRED}, {_RANK} SELECT round(sum(tp / rn) FILTER (y = 1) / max(yy), 6) AS average_precision FROM r")
def average_precision(spark, sf):
    return rounded(D.average_precision(predictions(spark, sf)))


@family.add(f"WITH {PRED}, {_CUM} SELECT round(p, 6) AS threshold, round(tp / P_ - fp / N_, 6) AS youden FROM s ORDER BY tp / P_ - fp / N_ DESC, p DESC LIMIT 1")
def youden_threshold(spark, sf):
    return rounded(D.thresholds(predictions(spark, sf)).orderBy(F.col("youden").desc(), F.col("threshold").desc()).limit(1).select("threshold", "youden"))


@family.add(f"WITH {PRED}, {_CUM}, d AS (SELECT p, sqrt((fp / N_) ** 2 + (1 - tp / P_) ** 2) AS corner FROM s) SELECT round(p, 6) AS threshold, round(corner, 6) AS corner FROM d ORDER BY d.corner, p DESC LIMIT 1")
def closest_threshold(spark, sf):
    return rounded(D.thresholds(predictions(spark, sf)).orderBy("corner", F.col("threshold").desc()).limit(1).select("threshold", "corner"))


_GRIDSQL = "c AS (SELECT CAST(least(floor(p * {n} + 1e-9), {n}) AS INTEGER) AS k, y FROM pred), g AS (SELECT CAST(i AS INTEGER) AS k, i / {n} AS threshold, (SELECT count(*) FILTER (y = 1) FROM c WHERE c.k >= i) AS tp, (SELECT count(*) FILTER (y = 0) FROM c WHERE c.k >= i) AS fp, (SELECT sum(y) FROM c) AS P_ FROM range({m}) t(i))"


@family.add(f"WITH {PRED}, {_GRIDSQL.format(n=100, m=101)} SELECT round(threshold, 6) AS threshold, round(2 * tp / (tp + fp + P_), 6) AS f1 FROM g ORDER BY 2 * tp / (tp + fp + P_) DESC, g.threshold LIMIT 1")
def best_f1_grid(spark, sf):
    g = D.threshold_grid(predictions(spark, sf), 100).withColumn("f1", 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n_pos")))
    return rounded(g.orderBy(F.col("f1").desc(), "threshold").limit(1).select("threshold", "f1"))


@family.add(f"WITH {PRED}, {_GRIDSQL.format(n=100, m=101)} SELECT round(threshold, 6) AS threshold, tp, fp, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS precision, round(tp / P_, 6) AS recall FROM g WHERE k BETWEEN 1 AND 99")
def threshold_metrics(spark, sf):
    g = D.threshold_grid(predictions(spark, sf), 100).where(F.col("k").between(1, 99))
    return rounded(g.select("threshold", "tp", "fp", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)).alias("precision"), (F.col("tp") / F.col("n_pos")).alias("recall")))


_CONF = "SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM pred"


@family.add(f"WITH {PRED} {_CONF}")
def confusion(spark, sf):
    return D.confusion(predictions(spark, sf))


@family.add(f"WITH {PRED}, c AS ({_CONF}) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c")
def classification_metrics(spark, sf):
    return rounded(D.rates(D.confusion(predictions(spark, sf))))


@family.add(f"WITH {PRED}, {_RANK} SELECT CAST(rn // (nn // 10) AS INTEGER) AS bin, round(rn / nn, 6) AS share, round(tp / rn / (yy / nn), 6) AS lift FROM r WHERE rn % (nn // 10) = 0 AND rn <= (nn // 10) * 10")
def lift_curve(spark, sf):
    return rounded(D.lift_curve(predictions(spark, sf)))


@family.add(f"WITH {PRED}, {_RANK} SELECT i AS point, round(rn / nn, 6) AS share, round(tp / yy, 6) AS gain FROM range(1, 101) g(i) JOIN r ON rn = i * nn // 100")
def gains_curve(spark, sf):
    return rounded(D.gains_curve(predictions(spark, sf)))


_TOP = f"WITH {PRED}, {_RANK}, k AS (SELECT unnest([5, 10, 20, 50]) AS percent) SELECT CAST(percent AS INTEGER) AS percent, {{}} FROM k JOIN r ON rn = ceil(nn * percent / 100)"


@family.add(_TOP.format("round(tp / rn / (yy / nn), 6) AS lift"))
def lift_at_k(spark, sf):
    return rounded(D.at_percentile(predictions(spark, sf), [5, 10, 20, 50]).drop("capture"))


@family.add(_TOP.format("round(tp / yy, 6) AS capture"))
def capture_at_k(spark, sf):
    return rounded(D.at_percentile(predictions(spark, sf), [5, 10, 20, 50]).drop("lift"))


@family.add(f"WITH {PRED}, {_RANK} SELECT CAST(((rn - 1) * 10) // nn + 1 AS INTEGER) AS bin, count(*) AS n, round(avg(y) / (max(yy) / max(nn)), 6) AS lift FROM r GROUP BY 1")
def lift_per_bin(spark, sf):
    return rounded(D.lift_per_bin(predictions(spark, sf)))


@family.add(f"WITH {TIES}, {_CUM}, c AS (SELECT sum(CAST(pos AS DOUBLE) * (N_ - fp)) AS c, sum(CAST(pos AS DOUBLE) * neg) AS t, max(CAST(P_ AS DOUBLE) * N_) AS n FROM s) SELECT round(c / n, 6) AS concordant, round((n - c - t) / n, 6) AS discordant, round(t / n, 6) AS tied, round((c - (n - c - t)) / n, 6) AS somers_d FROM c")
def somers_d(spark, sf):
    return rounded(D.concordance(tied_predictions(spark, sf)))


_PLACE = "CASE WHEN y = 1 THEN (sum(1 - y) OVER (ORDER BY {p} RANGE UNBOUNDED PRECEDING) - sum(1 - y) OVER (PARTITION BY {p}) / 2) / sum(1 - y) OVER () ELSE (sum(y) OVER (ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING) - sum(y) OVER (PARTITION BY {p}) / 2) / sum(y) OVER () END"


@family.add(f"WITH pred AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice / 500000 AS p, (o_orderkey % 997) / 997 AS p2 FROM orders), v AS (SELECT y, {_PLACE.format(p='p')} AS v1, {_PLACE.format(p='p2')} AS v2 FROM pred), a AS (SELECT avg(v1) FILTER (y = 1) AS auc1, avg(v2) FILTER (y = 1) AS auc2, var_samp(v1 - v2) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(v1 - v2) FILTER (y = 0) / count(*) FILTER (y = 0) AS variance FROM v) SELECT round(auc1, 6) AS auc1, round(auc2, 6) AS auc2, round(variance, 9) AS variance, round((auc1 - auc2) / sqrt(variance), 6) AS z FROM a")
def delong(spark, sf):
    df = predictions(spark, sf).withColumn("p2", (F.col("id") % 997) / 997)
    out = D.delong(df)
    return out.select(F.round("auc1", 6).alias("auc1"), F.round("auc2", 6).alias("auc2"), F.round("variance", 9).alias("variance"), F.round("z", 6).alias("z"))


@family.add()
def auc_bootstrap_ci(spark, sf):
    return D.bootstrap_auc(predictions(spark, sf))


@family.add("SELECT CAST(floor(least(p, 0.999999) * 20) AS INTEGER) AS bin, y, count(*) AS n FROM (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice / 500000 AS p FROM orders) GROUP BY ALL")
def prediction_distribution(spark, sf):
    return predictions(spark, sf).groupBy(F.floor(F.least(F.col("p"), F.lit(0.999999)) * 20).cast("int").alias("bin"), "y").agg(F.count("*").alias("n"))


@family.add("SELECT y, p_, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM (SELECT quality AS y, CAST(n_chars > 2000 AS INTEGER) AS p_ FROM labels JOIN documents USING (doc_id)) GROUP BY y, p_")
def confusion_normalised(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 2000).cast("int").alias("p_"))
    by = rows.groupBy("y", "p_").agg(F.count("*").alias("n"))
    return rounded(by.join(by.groupBy("y").agg(F.sum("n").alias("t")), "y").select("y", "p_", "n", (F.col("n") / F.col("t")).alias("share")))
