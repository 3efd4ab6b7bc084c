"""Grouped analytics, and what the client computes from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from .common import APP, Family, applications, rounded, table

family = Family()
QUERIES, ORACLE = family.queries, family.oracle

_RATE = "count(*) AS n, count(*) FILTER (decision = 'Accepted') AS n_accepted, round(avg(CAST(decision = 'Accepted' AS DOUBLE)), 6) AS rate"


@family.add(f"WITH {APP}, a AS (SELECT university, program, count(*) AS n, count(*) FILTER (decision = 'Accepted') AS n_accepted, avg(CAST(decision = 'Accepted' AS DOUBLE)) AS rate FROM app GROUP BY ALL) SELECT university, program, n, n_accepted, round(rate, 6) AS rate FROM a WHERE n >= 20 ORDER BY a.rate, university, program LIMIT 20")
def competitive_programs(spark, sf):
    return rounded(A.competitive(applications(spark, sf)))


@family.add(f"WITH {APP} SELECT program, {_RATE} FROM app GROUP BY program")
def admission_rates(spark, sf):
    return rounded(A.acceptance(applications(spark, sf), ["program"]))


@family.add(f"WITH {APP} SELECT university, cycle_year, {_RATE} FROM app GROUP BY ALL")
def admission_rates_by_year(spark, sf):
    return rounded(A.acceptance(applications(spark, sf), ["university", "cycle_year"]))


_LIST = "count(*) AS n, median(grade) FILTER (decision = 'Accepted') AS median, avg(grade) FILTER (decision = 'Accepted') AS mean"
_DIFF = "CASE WHEN median IS NULL THEN 'Unknown' WHEN median >= 93 THEN 'Very High' WHEN median >= 88 THEN 'High' WHEN median >= 82 THEN 'Moderate' ELSE 'Accessible' END"
_CONF = "CASE WHEN n >= 30 THEN 'high' WHEN n >= 10 THEN 'moderate' ELSE 'low' END"


@family.add(f"WITH {APP}, a AS (SELECT university, program, {_LIST} FROM app GROUP BY ALL) SELECT university, program, n, round(median, 6) AS median, round(mean, 6) AS mean, {_DIFF} AS difficulty, {_CONF} AS confidence FROM a")
def program_listing(spark, sf):
    return rounded(A.listing(applications(spark, sf)))


@family.add(f"WITH {APP} SELECT university, decision, count(*) AS n FROM app GROUP BY ALL")
def decision_breakdown(spark, sf):
    return applications(spark, sf).groupBy("university", "decision").agg(F.count("*").alias("n"))


_STATS = "round(avg(grade), 6) AS mean, round(quantile_cont(grade, 0.5), 6) AS median, round(quantile_cont(grade, 0.25), 6) AS p25, round(quantile_cont(grade, 0.75), 6) AS p75, min(grade) AS min, max(grade) AS max, round(coalesce(stddev_samp(grade), 0), 6) AS std, count(*) AS n"


@family.add(f"WITH {APP} SELECT university, decision, {_STATS} FROM app GROUP BY ALL")
def grade_stats(spark, sf):
    return rounded(A.grade_stats(applications(spark, sf), ["university", "decision"]))


@family.add(f"WITH {APP}, a AS (SELECT university, cycle_year, {_STATS} FROM app WHERE decision = 'Accepted' GROUP BY ALL) SELECT university, cycle_year, min, p25, median, p75, max, n, {_CONF} AS confidence FROM a")
def admitted_range_by_year(spark, sf):
    return rounded(A.admitted_range(applications(spark, sf), ["university", "cycle_year"]))


_HIST = f"""{APP}, d AS (SELECT * FROM app WHERE decision IN ('Accepted', 'Rejected')),
e AS (SELECT university, floor(min(grade)) AS lo, ceil(max(grade)) AS hi FROM d GROUP BY university),
h AS (SELECT university, lo, CAST(least(floor((grade - lo) / 2), greatest(1, ceil((hi - lo) / 2)) - 1) AS INTEGER) AS bin, decision FROM d JOIN e USING (university)),
hist AS (SELECT university, bin, lo + bin * 2.0 AS start, count(*) FILTER (decision = 'Accepted') AS accepted, count(*) FILTER (decision <> 'Accepted') AS rejected FROM h GROUP BY university, lo, bin)"""


@family.add(f"WITH {_HIST} SELECT university, bin, CAST(start AS DOUBLE) AS start, accepted, rejected FROM hist")
def grade_histogram(spark, sf):
    return A.histogram(applications(spark, sf), ["university"])


@family.add(f"""WITH {APP}, o AS (SELECT university, decision_month, row_number() OVER (PARTITION BY university ORDER BY decision_month) AS rn, count(*) OVER (PARTITION BY university) AS n FROM app WHERE decision = 'Accepted')
SELECT university, min(decision_month) AS earliest, min(decision_month) FILTER (rn = n // 2 + 1) AS median, max(decision_month) AS latest, max(n) AS n FROM o GROUP BY university""")
def offer_timeline(spark, sf):
    return A.timeline(applications(spark, sf), ["university"])


@family.add(f"WITH {APP} SELECT cycle_year, round(median(grade), 6) AS median_all, round(coalesce(median(grade) FILTER (decision = 'Accepted'), 0), 6) AS median_accepted, count(*) AS n FROM app GROUP BY cycle_year")
def year_trend(spark, sf):
    return rounded(A.year_trend(applications(spark, sf)))


@family.add(f"""WITH {APP}, a AS (SELECT grade, l_discount * 1000 AS g11, l_tax * 1000 AS g12 FROM app WHERE decision = 'Accepted'),
u AS (SELECT 'grade' AS "column", grade AS v FROM a UNION ALL SELECT 'g11', g11 FROM a UNION ALL SELECT 'g12', g12 FROM a)
SELECT "column", round(avg(v), 6) AS mean, round(median(v), 6) AS median, count(v) AS n FROM u GROUP BY 1""")
def grade_progression(spark, sf):
    rows = applications(spark, sf).withColumn("g11", F.col("l_discount") * 1000).withColumn("g12", F.col("l_tax") * 1000)
    return rounded(A.progression(rows, ["grade", "g11", "g12"]))


@family.add(f"WITH {APP} SELECT university, count(*) FILTER (applicant = 'O') AS n_101, count(*) FILTER (applicant = 'F') AS n_105, count(*) FILTER (applicant NOT IN ('O', 'F')) AS n_unknown FROM app GROUP BY university")
def applicant_type_breakdown(spark, sf):
    c = F.col("applicant")
    return applications(spark, sf).groupBy("university").agg(F.count_if(c == "O").alias("n_101"), F.count_if(c == "F").alias("n_105"), F.count_if(~c.isin("O", "F")).alias("n_unknown"))


@family.add("SELECT n_name AS province, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def province_breakdown(spark, sf):
    rows = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(A.shares(rows.select(F.col("n_name").alias("province")), "province"))


@family.add(f"WITH {APP}, a AS (SELECT university, program, count(*) AS n, avg(CASE WHEN grade > 90 THEN 1.0 ELSE 0.0 END) AS missing FROM app GROUP BY ALL) SELECT university, program, n, round(missing, 6) AS missing, missing > 0.1 OR n < 10 AS is_sparse FROM a")
def data_quality(spark, sf):
    rows = applications(spark, sf).withColumn("grade", F.when(F.col("grade") <= 90, F.col("grade")))
    return rounded(A.data_quality(rows, ["university", "program"], 0.1))


@family.add(f"WITH {APP}, a AS (SELECT university, median(grade) AS median FROM app WHERE decision = 'Accepted' AND grade > 70 GROUP BY university) SELECT university, round(median, 6) AS median, {_DIFF} AS difficulty FROM a")
def difficulty_labels(spark, sf):
    rows = applications(spark, sf).where(A.accepted() & (F.col("grade") > 70)).groupBy("university").agg(F.percentile("grade", F.lit(0.5)).alias("median"))
    return rounded(rows.withColumn("difficulty", A.difficulty(F.col("median"))))


_WHOLE = f"""{APP}, d AS (SELECT * FROM app WHERE decision IN ('Accepted', 'Rejected')), e AS (SELECT floor(min(grade)) AS lo, ceil(max(grade)) AS hi FROM d),
h AS (SELECT lo, CAST(least(floor((grade - lo) / 2), greatest(1, ceil((hi - lo) / 2)) - 1) AS INTEGER) AS bin, decision FROM d, e),
hist AS (SELECT lo + bin * 2.0 AS start, count(*) FILTER (decision = 'Accepted') AS accepted, count(*) FILTER (decision <> 'Accepted') AS rejected FROM h GROUP BY lo, bin)"""


@family.add(f"WITH {_WHOLE} SELECT CAST(round(100 * sum(CASE WHEN start + 2 <= 71.5 THEN accepted WHEN start <= 71.5 THEN accepted * (71.5 - start) / 2 ELSE 0 END) / sum(accepted)) AS DOUBLE) AS percentile FROM hist")
def histogram_percentile(spark, sf):
    return A.percentile_in_histogram(A.histogram(applications(spark, sf)), 71.5)


@family.add(f"WITH {_WHOLE}, g AS (SELECT CAST(unnest([1.0, 35.5, 80.0, 99.0, 120.0]) AS DOUBLE) AS grade), m AS (SELECT grade, max(start) AS s FROM g LEFT JOIN hist ON start <= grade GROUP BY grade) SELECT grade, round(accepted / (accepted + rejected), 6) AS probability FROM m LEFT JOIN hist ON s = start")
def what_if_probability(spark, sf):
    return rounded(A.what_if(A.histogram(applications(spark, sf)), [1.0, 35.5, 80.0, 99.0, 120.0]))


@family.add(f"""WITH {APP}, q AS (SELECT program, quantile_cont(grade, 0.25) AS p25, quantile_cont(grade, 0.75) AS p75 FROM app WHERE decision = 'Accepted' GROUP BY program)
SELECT program, CASE WHEN l_discount * 10 >= 0.75 AND grade >= coalesce(p75, 95) THEN 'safety' WHEN l_discount * 10 < 0.4 OR grade < coalesce(p25, 80) THEN 'reach' ELSE 'target' END AS tier, count(*) AS n
FROM app LEFT JOIN q USING (program) GROUP BY ALL""")
def admission_tier(spark, sf):
    app = applications(spark, sf)
    q = A.grade_stats(app.where(A.accepted()), ["program"]).select("program", "p25", "p75")
    rows = app.join(q, "program", "left")
    return rows.groupBy("program", A.tier(F.col("l_discount") * 10, F.col("grade"), F.col("p25"), F.col("p75")).alias("tier")).agg(F.count("*").alias("n"))


@family.add()
def program_analytics(spark, sf):
    """The whole nested document of one program; its parts are compared one by one above."""
    return A.program_document(applications(spark, sf), "Brand#1", "STANDARD")
