"""Document pipeline queries: orders as documents with their lineitems nested, events as flat documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators.windows import quantiles
from .common import Family, rounded, table

family = Family()
QUERIES, ORACLE = family.queries, family.oracle


def students(spark, sf):
    """A document an order: applications are its lineitems."""
    li = table(spark, sf, "lineitem")
    outcome = F.when(F.col("l_returnflag") == "A", "admitted").when(F.col("l_returnflag") == "R", "rejected").otherwise("waitlisted")
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.concat(F.lit("U"), (F.col("l_suppkey") % 10).cast("string")).alias("university"), F.col("l_linestatus").alias("program"), outcome.alias("outcome"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("application_date"), F.col("l_quantity").alias("quantity"))
    nested = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("applications"))
    o = table(spark, sf, "orders")
    return o.join(nested, o.o_orderkey == nested.l_orderkey, "left").select(F.col("o_orderkey").alias("student_id"), F.struct(F.col("o_orderpriority").alias("province"), F.year("o_orderdate").alias("graduation_year")).alias("demographics"), F.struct((F.col("o_totalprice") / 5000).alias("gpa_overall")).alias("academics"), "applications")


#: The same, unnested.
FLAT = """flat AS (
  SELECT o_orderkey AS student_id, o_orderpriority AS province, o_totalprice / 5000 AS gpa, l_linenumber AS line,
    'U' || CAST(l_suppkey % 10 AS VARCHAR) AS university, l_linestatus AS program,
    CASE l_returnflag WHEN 'A' THEN 'admitted' WHEN 'R' THEN 'rejected' ELSE 'waitlisted' END AS outcome,
    strftime(l_shipdate, '%Y-%m-%d') AS application_date, l_quantity AS quantity
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


@family.add("SELECT o_orderkey AS student_id, o_orderpriority AS province FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1997")
def match_eq(spark, sf):
    return D.aggregate(students(spark, sf), [{"$match": {"demographics.province": "1-URGENT", "demographics.graduation_year": 1997}}, {"$project": {"student_id": 1, "province": "$demographics.province"}}])


@family.add(f"WITH {FLAT} SELECT DISTINCT student_id FROM flat WHERE university = 'U3' AND outcome = 'admitted'")
def match_elem(spark, sf):
    return D.find(students(spark, sf), {"applications": {"$elemMatch": {"university": "U3", "outcome": "admitted"}}}).select("student_id")


@family.add(f"WITH {FLAT} SELECT student_id, line, university, outcome FROM flat")
def unwind_items(spark, sf):
    return D.aggregate(students(spark, sf), [{"$unwind": "$applications"}, {"$project": {"student_id": 1, "line": "$applications.line", "university": "$applications.university", "outcome": "$applications.outcome"}}])


@family.add(f"WITH {FLAT} SELECT count(*) AS n, round(sum(quantity), 2) AS total, round(avg(gpa), 6) AS mean_gpa FROM flat")
def group_null_key(spark, sf):
    out = D.aggregate(students(spark, sf), [{"$unwind": "$applications"}, {"$group": {"_id": None, "n": {"$count": {}}, "total": {"$sum": "$applications.quantity"}, "mean_gpa": {"$avg": "$academics.gpa_overall"}}}]).drop("_id")
    return out.select("n", F.round("total", 2).alias("total"), F.round("mean_gpa", 6).alias("mean_gpa"))


@family.add(f"WITH {FLAT} SELECT university, program, count(*) AS n FROM flat GROUP BY ALL")
def group_composite(spark, sf):
    out = D.aggregate(students(spark, sf), [{"$unwind": "$applications"}, {"$group": {"_id": {"university": "$applications.university", "program": "$applications.program"}, "n": {"$sum": 1}}}])
    return out.select("_id.*", F.col("n").cast("bigint").alias("n"))


@family.add(f"WITH {FLAT} SELECT university, CAST(count(*) FILTER (outcome = 'admitted') AS BIGINT) AS admitted, count(*) AS total, round(coalesce(count(*) FILTER (outcome = 'admitted') / count(*), 0), 6) AS rate FROM flat GROUP BY university")
def group_sum_cond(spark, sf):
    stages = [
        {"$unwind": "$applications"},
        {"$group": {"_id": "$applications.university", "admitted": {"$sum": {"$cond": [{"$eq": ["$applications.outcome", "admitted"]}, 1, 0]}}, "total": {"$sum": 1}}},
        {"$project": {"university": "$_id", "admitted": 1, "total": 1, "rate": {"$divide": ["$admitted", "$total"]}, "_id": 0}},
    ]
    return rounded(D.aggregate(students(spark, sf), stages)).withColumn("admitted", F.col("admitted").cast("bigint")).withColumn("total", F.col("total").cast("bigint"))


@family.add("SELECT event_type, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def group_avg_min_max(spark, sf):
    out = D.aggregate(table(spark, sf, "events"), [{"$group": {"_id": "$event_type", "mean": {"$avg": "$value"}, "low": {"$min": "$value"}, "high": {"$max": "$value"}}}])
    return rounded(out.withColumnRenamed("_id", "event_type"))


@family.add("SELECT user_id, min_by(event_type, event_id) AS first_type, max_by(event_type, event_id) AS last_type, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY user_id")
def group_first_push(spark, sf):
    out = D.aggregate(table(spark, sf, "events"), [{"$group": {"_id": "$user_id", "first_type": {"$first": "$event_type"}, "last_type": {"$last": "$event_type"}, "types": {"$push": "$event_type"}}}], order=["event_id"])
    return out.select(F.col("_id").alias("user_id"), "first_type", "last_type", F.array_join("types", ",").alias("types"))


@family.add("SELECT event_id, round(value * 2 + 1, 6) AS twice, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS level, round(value - event_id, 6) AS less FROM events")
def project_expr(spark, sf):
    return rounded(D.aggregate(table(spark, sf, "events"), [{"$project": {"event_id": 1, "twice": {"$add": [{"$multiply": ["$value", 2]}, 1]}, "level": {"$cond": {"if": {"$gt": ["$value", 10]}, "then": "high", "else": "low"}}, "less": {"$subtract": ["$value", "$event_id"]}}}]))


@family.add("SELECT event_id, round(coalesce(value / nullif(user_id % 3, 0), 0), 6) AS q FROM events")
def project_divide_zero(spark, sf):
    ev = table(spark, sf, "events").withColumn("m", F.col("user_id") % 3)
    return rounded(D.aggregate(ev, [{"$project": {"event_id": 1, "q": {"$divide": ["$value", "$m"]}}}]))


@family.add("SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) ORDER BY v ASC NULLS FIRST, event_id DESC LIMIT 50")
def sort_multi_nulls(spark, sf):
    ev = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return D.aggregate(ev, [{"$sort": {"v": 1, "event_id": -1}}, {"$limit": 50}, {"$project": {"event_id": 1, "v": 1}}])


@family.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 3")
def find_project_limit(spark, sf):
    return D.find(table(spark, sf, "orders"), {"o_orderstatus": "F"}, {"o_orderkey": 1, "o_totalprice": 1}, [("o_totalprice", -1), ("o_orderkey", 1)], 3)


@family.add("SELECT count(*) AS n FROM events WHERE event_type = 'click' AND value >= 5")
def count_documents(spark, sf):
    return D.count_documents(table(spark, sf, "events"), {"event_type": "click", "value": {"$gte": 5}})


@family.add("SELECT count(*) AS n FROM events WHERE (event_type IN ('click', 'view') OR value > 50) AND NOT (user_id < 10) AND regexp_matches(props, '\"k\": 1')")
def match_boolean(spark, sf):
    return D.count_documents(table(spark, sf, "events"), {"$and": [{"$or": [{"event_type": {"$in": ["click", "view"]}}, {"value": {"$gt": 50}}]}, {"$nor": [{"user_id": {"$lt": 10}}]}], "props": {"$regex": '"k": 1'}})


@family.add(f"WITH {FLAT}, s AS (SELECT DISTINCT student_id, gpa FROM flat WHERE university = 'U2' AND outcome = 'rejected') SELECT round(avg(gpa), 6) AS mean, round(stddev_pop(gpa), 6) AS std, round(min(gpa), 6) AS min, round(max(gpa), 6) AS max, round(median(gpa), 6) AS median, count(*) AS n FROM s")
def gpa_statistics(spark, sf):
    rows = D.find(students(spark, sf), D.application_query(university="U2", outcome="rejected"))
    g = F.col("academics.gpa_overall")
    middle = quantiles(rows.select(g.alias("g")), "g", [0.5])
    return rounded(rows.agg(F.avg(g).alias("mean"), F.stddev_pop(g).alias("std"), F.min(g).alias("min"), F.max(g).alias("max"), F.lit(middle[0] if middle else None).cast("double").alias("median"), F.count(g).alias("n")))


@family.add(f"WITH {FLAT}, y AS (SELECT unnest(['1996', '1997', '2030']) AS year) SELECT y.year, count(student_id) AS applications, count(student_id) FILTER (outcome = 'admitted') AS admitted FROM y LEFT JOIN flat ON substr(application_date, 1, 4) = y.year AND university = 'U1' GROUP BY y.year")
def application_trends(spark, sf):
    apps = D.unwind(students(spark, sf), "applications").select("student_id", "applications.*").where("university = 'U1'")
    by = apps.groupBy(F.substring("application_date", 1, 4).alias("year")).agg(F.count("*").alias("applications"), F.count_if(F.col("outcome") == "admitted").alias("admitted"))
    years = spark.createDataFrame([("1996",), ("1997",), ("2030",)], "year string")
    return years.join(F.broadcast(by), "year", "left").fillna(0, ["applications", "admitted"])


@family.add("SELECT b.o_orderkey FROM orders a JOIN orders b ON b.o_totalprice / 5000 BETWEEN a.o_totalprice / 5000 - 5 AND a.o_totalprice / 5000 + 5 AND a.o_orderkey <> b.o_orderkey WHERE a.o_orderkey = 7 ORDER BY b.o_orderkey LIMIT 10")
def similar_records_range(spark, sf):
    s = students(spark, sf).drop("applications").select("student_id", F.col("academics.gpa_overall").alias("gpa"))
    me = s.where("student_id = 7").select(F.col("gpa").alias("g0"))
    return s.where("student_id != 7").join(F.broadcast(me), F.col("gpa").between(F.col("g0") - 5, F.col("g0") + 5)).orderBy("student_id").limit(10).select(F.col("student_id").alias("o_orderkey"))


@family.add("SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def lookup_left(spark, sf):
    out = D.aggregate(table(spark, sf, "customer").select("c_custkey"), [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}], collections={"orders": table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")})
    total = F.aggregate("orders", F.lit(0.0), lambda a, x: a + x["o_totalprice"])
    return out.select("c_custkey", F.coalesce(F.size("orders"), F.lit(0)).cast("bigint").alias("n_orders"), F.coalesce(F.round(total, 2), F.lit(0.0)).alias("total"))


@family.add("SELECT CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS status, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 10 ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1")
def update_many(spark, sf):
    out = D.update_many(table(spark, sf, "orders"), {"o_orderstatus": "P"}, {"$set": {"o_orderstatus": "pending"}, "$inc": {"o_totalprice": 10}})
    return out.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@family.add("SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P') THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_one(spark, sf):
    return D.update_one(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), {"o_orderstatus": "P"}, {"$set": {"o_orderstatus": "X"}}, ["o_orderkey"])


_NEW = "n AS (SELECT o_orderkey + (SELECT max(o_orderkey) // 2 FROM orders) AS o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders)"


@family.add(f"WITH {_NEW} SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM n UNION ALL SELECT o_orderkey, round(o_totalprice, 2) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)")
def upsert_merge(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return D.upsert(old, _shifted(old), ["o_orderkey"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


def _shifted(old):
    half = old.agg(F.floor(F.max("o_orderkey") / 2).alias("h"))
    return old.crossJoin(F.broadcast(half)).select((F.col("o_orderkey") + F.col("h")).alias("o_orderkey"), (F.col("o_totalprice") * 2).alias("o_totalprice"))


@family.add(f"WITH {_NEW} SELECT count(*) FILTER (o_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS inserted, count(*) FILTER (o_orderkey IN (SELECT o_orderkey FROM orders)) AS updated, CAST(0 AS BIGINT) AS errors FROM n")
def bulk_upsert_counts(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return D.upsert_counts(old, _shifted(old), ["o_orderkey"])


@family.add("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'")
def delete_many(spark, sf):
    return D.delete_many(table(spark, sf, "orders"), {"o_orderstatus": "O"}).select("o_orderkey")


@family.add("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def insert_union(spark, sf):
    return D.insert_many(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))
