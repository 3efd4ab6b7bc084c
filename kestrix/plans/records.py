"""Parsers, joins, name matching, review, ETL and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import etl as E, matching as M
from ..streaming import events as S
from .common import Family, rounded, table

family = Family()
QUERIES, ORACLE = family.queries, family.oracle

# Parsers: strings are made from table values, so that every case of the parser occurs.


def _grades(spark, sf):
    q, k = F.col("l_quantity").cast("int"), F.col("l_orderkey") % 9
    s = q.cast("string")
    raw = F.when(k == 0, F.concat(s, F.lit("%"))).when(k == 1, s).when(k == 2, F.concat(s, F.lit("-"), (q + 4).cast("string"))).when(k == 3, F.concat(s, F.lit(" – "), (q + 4).cast("string"))).when(k == 4, F.lit("low 90s")).when(k == 5, F.lit("around Mid 80s")).when(k == 6, (q + 80).cast("string")).when(k == 7, F.concat(s, F.lit("f")))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), raw.alias("raw"))


@family.add("SELECT l_orderkey AS id, CASE l_orderkey % 9 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity + 2 WHEN 3 THEN l_quantity + 2 WHEN 4 THEN 92.0 WHEN 5 THEN 85.0 WHEN 6 THEN CASE WHEN l_quantity + 80 <= 100 THEN l_quantity + 80 END END AS grade FROM lineitem")
def parse_grade(spark, sf):
    return _grades(spark, sf).select("id", T.parse_grade(F.col("raw")).alias("grade"))


_DECISIONS = {"accepted": "Accepted", "admitted": "Accepted", "offer": "Accepted", "rejected": "Rejected", "denied": "Rejected", "waitlisted": "Waitlisted"}


@family.add("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Accepted' WHEN 1 THEN 'Rejected' WHEN 2 THEN 'Waitlisted' WHEN 3 THEN 'Accepted' END AS decision FROM orders")
def normalize_decision(spark, sf):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, " ADMITTED ").when(k == 1, "Denied (late)").when(k == 2, "waitlisted").when(k == 3, "Offer - with conditions").otherwise("no idea")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.normalize_by(_DECISIONS, raw).alias("decision"))


@family.add("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 < 5 THEN CAST(month(o_orderdate) AS INTEGER) END AS month FROM orders")
def parse_decision_month(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.date_format(d, "M/d/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "MMMM d")).when(k == 3, F.date_format(d, "MMM d, yyyy")).when(k == 4, F.date_format(d, "d MMM yyyy")).otherwise("soon")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.parse_month(raw).alias("month"))


@family.add("SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INTEGER) AS term, CAST(year(o_orderdate) + CASE WHEN o_orderkey % 3 = 2 AND year(o_orderdate) < 2000 THEN 100 ELSE 0 END AS INTEGER) AS year FROM orders")
def parse_term(spark, sf):
    names = F.array(*[F.lit(x) for x in ("Winter", "Spring", "Summer", "Fall")])
    name, y, k = F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int")), F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.concat_ws(" ", name, y)).when(k == 1, F.concat_ws("-", y, name)).otherwise(F.concat(F.substring(name, 1, 2), F.substring(y, 3, 2)))
    term, year = T.parse_term(raw)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), term.alias("term"), year.alias("year"))


@family.add("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS n, event_id % 3 = 0 AS flag FROM events")
def clean_nulls_cast(spark, sf):
    i = F.col("event_id")
    raw = table(spark, sf, "events").select("event_id", F.when(i % 4 == 0, F.lit(" N/A ")).otherwise(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("event_type"), F.when(i % 5 == 0, F.lit("12x")).otherwise(i.cast("string")).alias("n"), F.when(i % 3 == 0, F.lit("Yes")).otherwise(F.lit("no")).alias("flag"))
    return E.cleaning({"n": "int", "flag": "bool"})(raw)


@family.add("SELECT p_partkey, p_name FROM part")
def strip_prefix(spark, sf):
    part = table(spark, sf, "part")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper("p_brand"), F.lit(" - "), "p_name")).otherwise(F.col("p_name"))
    return part.select("p_partkey", T.strip_prefix(raw, F.col("p_brand")).alias("p_name"))


@family.add("SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'BSc' WHEN p_partkey % 4 = 2 THEN 'BEng' END AS degree, p_partkey % 4 = 1 AS is_coop, p_partkey % 4 = 2 AS is_honours, CASE WHEN p_partkey % 4 = 3 THEN lower(p_type) END AS specialisation, upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS base_name, replace(p_name, ' ', '_') AS name_key FROM part")
def program_components(spark, sf):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    raw = F.when(k == 1, F.concat(F.lit("BSc "), n, F.lit(" Co-op"))).when(k == 2, F.concat(F.lit("Honours Bachelor of Engineering "), n)).when(k == 3, F.concat(n, F.lit(" ("), "p_type", F.lit(")"))).otherwise(n)
    return table(spark, sf, "part").select("p_partkey", *[c.alias(a) for a, c in T.program_components(raw).items()])


@family.add("SELECT p_partkey FROM part WHERE p_partkey % 6 = 0")
def garbage_filter(spark, sf):
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    raw = F.when(k == 0, n).when(k == 1, F.lit("n/a")).when(k == 2, F.concat(F.lit("/"), n)).when(k == 3, F.concat(n, F.lit(" ("))).when(k == 4, F.lit("a 1 2 3")).otherwise(F.concat_ws(" ", n, n, n, n))
    return table(spark, sf, "part").withColumn("raw", raw).where(T.is_valid_name(F.col("raw"))).select("p_partkey")


@family.add("SELECT o_orderkey AS student_id, CAST((o_orderkey % 10 = 0)::INT + (o_orderkey % 7 = 0)::INT + (o_orderkey % 6 = 5)::INT + (o_orderkey % 11 = 0)::INT AS INTEGER) AS n_errors FROM orders")
def validate_errors(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("student_id"), F.when(k % 10 != 0, F.lit("U")).alias("university"), F.lit("P").alias("program"), F.when(k % 7 == 0, F.lit("101")).otherwise(F.lit("88.5")).alias("gpa"), F.when(k % 6 == 5, F.lit("maybe")).otherwise(F.lit("Admitted")).alias("outcome"), F.when(k % 11 == 0, F.lit("2031")).otherwise(F.lit("2020")).alias("cycle_year"))
    return E.validation()(rows).select("student_id", F.size("_validation_errors").alias("n_errors"))


# Joins


_ALIASES = {"click": "interaction", "view": "impression", "purchase": "conversion", "error": "fault"}


@family.add("SELECT coalesce(CASE event_type WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'impression' WHEN 'purchase' THEN 'conversion' WHEN 'error' THEN 'fault' END, event_type) AS canonical, count(*) AS n FROM events GROUP BY 1")
def alias_broadcast(spark, sf):
    dim = spark.createDataFrame(list(_ALIASES.items()), "alias string, canonical string")
    rows = M.match_aliases(table(spark, sf, "events"), "event_type", dim)
    return rows.groupBy(F.coalesce("canonical", "event_type").alias("canonical")).agg(F.count("*").alias("n"))


@family.add("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_elem(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 400000")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@family.add("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def anti_excluded(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


_RULES = [("Brand#1*", "S*", 0.5), ("Brand#?", "*", 0.15), ("*", "PROMO", 0.1)]


@family.add("SELECT p_partkey, CAST(CASE WHEN p_brand LIKE 'Brand#1%' AND p_type LIKE 'S%' THEN 0.5 WHEN p_brand LIKE 'Brand#_' THEN 0.15 WHEN p_type = 'PROMO' THEN 0.1 ELSE 0 END AS DOUBLE) AS weight FROM part")
def glob_theta(spark, sf):
    return table(spark, sf, "part").select("p_partkey", M.glob_weight("p_brand", "p_type", _RULES).alias("weight"))


@family.add("SELECT a.o_orderkey AS a, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND abs(a.o_totalprice - b.o_totalprice) <= 25000 GROUP BY 1")
def range_self(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    b = o.toDF("o_custkey", "b", "price")
    near = o.join(b, "o_custkey").where((F.col("o_orderkey") != F.col("b")) & (F.abs(F.col("o_totalprice") - F.col("price")) <= 25000))
    return near.groupBy(F.col("o_orderkey").alias("a")).agg(F.count("*").alias("n"))


@family.add("SELECT e.event_id, arg_max(p.value, p.ts) AS last_value FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'view' AND p.ts <= e.ts WHERE e.event_type = 'click' GROUP BY e.event_id")
def asof_last_view(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    ev = table(spark, sf, "events").withColumn("last_value", F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(w))
    return ev.where("event_type = 'click' and last_value is not null").select("event_id", "last_value")


@family.add("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) + 0 AS g1, grouping(l_linestatus) + 0 AS g2 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("bigint").alias("g1"), F.grouping("l_linestatus").cast("bigint").alias("g2"))


@family.add("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


# Names


_TOK = "array_to_string(list_sort(string_split_regex(trim(regexp_replace(lower({}), '[^a-z0-9\\s]', '', 'g')), '\\s+')), ' ')"
_NAMES = f"n AS (SELECT DISTINCT p_name AS name, {_TOK.format('p_name')} AS t FROM part)"
_SIM = "CASE WHEN a.t = b.t THEN 1.0 WHEN a.t = '' OR b.t = '' THEN 0.0 ELSE 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)) END"
_SHARED = "len(list_intersect(string_split(a.t, ' '), string_split(b.t, ' '))) > 0"


@family.add(f"WITH {_NAMES} SELECT a.name AS a, b.name AS b, round({_SIM}, 6) AS score FROM n a, n b WHERE {_SHARED}")
def token_sort_similarity(spark, sf):
    part = table(spark, sf, "part")
    return rounded(M.pairs_by_token(part, part, "p_name", "p_name").select("a", "b", T.token_sort_similarity(F.col("a"), F.col("b")).alias("score")))


@family.add(f"WITH {_NAMES}, c AS (SELECT name, t FROM n WHERE name < 'm'), s AS (SELECT a.name AS p_name, b.name AS b, {_SIM} AS score FROM n a, c b), r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, b DESC) AS rn FROM s WHERE score >= 0.85) SELECT n.name AS p_name, coalesce(b, 'INVALID') AS canonical, round(coalesce(score, 0), 6) AS score FROM n LEFT JOIN r ON n.name = p_name AND rn = 1")
def fuzzy_top1(spark, sf):
    part = table(spark, sf, "part")
    canon = part.where("p_name < 'm'").select(F.col("p_name").alias("c")).distinct()
    return rounded(M.best_match(part, "p_name", canon, "c"))


@family.add("SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 'red') OR contains('red', lower(p_name))")
def substring_match_both(spark, sf):
    return table(spark, sf, "part").where(T.substring_either(F.col("p_name"), F.lit("RED"))).select("p_name").distinct()


@family.add()
def name_clusters(spark, sf):
    """Greedy clusters, one after the other by frequency."""
    return M.leader_clusters(table(spark, sf, "part"), "p_name", 0.7)


_REVIEW = "rv AS (SELECT DISTINCT p_type || ' ' || substr(p_brand, 7) AS variant, p_type AS canonical, CASE p_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))) + " END AS cluster_id, CASE CAST(substr(p_brand, 7) AS INTEGER) % 5 WHEN 0 THEN 'SPLIT' WHEN 1 THEN 'MERGE' WHEN 2 THEN 'DELETE' ELSE 'KEEP' END AS action FROM part)"


def _review(spark, sf):
    types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    brand = F.substring("p_brand", 7, 9)
    k = brand.cast("int") % 5
    rows = table(spark, sf, "part").select(F.concat_ws(" ", "p_type", brand).alias("variant"), F.col("p_type").alias("canonical"), T.lookup({t: i for i, t in enumerate(types)}, F.col("p_type")).alias("cluster_id"), F.when(k == 0, "SPLIT").when(k == 1, "MERGE").when(k == 2, "DELETE").otherwise("KEEP").alias("action")).distinct()
    return rows.withColumn("notes", F.lit(None).cast("string")).withColumn("merge_target", F.when(F.col("action") == "MERGE", 0)).withColumn("score", F.lit(75.0) + F.length("variant") % 20).withColumn("frequency", F.length("variant").cast("bigint"))


@family.add(f"WITH {_REVIEW} SELECT CASE action WHEN 'SPLIT' THEN variant WHEN 'MERGE' THEN 'ECONOMY' ELSE canonical END AS canonical, string_agg(variant, ',' ORDER BY variant) AS variants FROM rv WHERE action <> 'DELETE' GROUP BY 1")
def apply_review(spark, sf):
    return M.apply_review(_review(spark, sf)).select("canonical", F.array_join("variants", ",").alias("variants"))


@family.add(f"WITH {_REVIEW}, s AS (SELECT *, 75.0 + length(variant) % 20 AS score, length(variant) AS frequency FROM rv) SELECT count(*) AS items, count(DISTINCT cluster_id) AS clusters, count(*) FILTER (score < 80) AS low_score, count(*) FILTER (frequency > 50 AND score < 90) AS high_impact FROM s")
def review_statistics(spark, sf):
    return M.review_statistics(_review(spark, sf))


# Events; on a stream the same functions take a watermark


@family.add("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    return S.tumbling_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@family.add("WITH w AS (SELECT unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) AS start, value FROM events) SELECT start, round(avg(value), 6) AS mean, count(*) AS n FROM w GROUP BY start")
def sliding_avg(spark, sf):
    return rounded(S.sliding_average(table(spark, sf, "events"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@family.add("WITH l AS (SELECT user_id, ts, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS INTEGER) AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def sessionize(spark, sf):
    return S.sessions(table(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@family.add("SELECT DISTINCT user_id, event_type FROM events")
def watermark_dedup(spark, sf):
    return S.deduplicated(table(spark, sf, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type")
