"""Cases of past applications: what a new one resembles, and how those fared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_trivial, substring_either
from ..functions.vectors import all_pairs, cosine, doubles

# A boost by what a case has in common, the thresholds of tiers, and of a category.
EXACT, CONTAINING, SAME_UNIVERSITY, NEAR_GRADE, GRADE_BAND = 0.15, 0.05, 0.10, 0.10, 5.0
TIERS = ((0.75, "exceptional"), (0.5, "strong"), (0.25, "moderate"))
CATEGORY = 0.35


def boost(university: str, program: str, grade: float | None) -> Column:
    """1 and a share for the same program (or one that contains it), university, and a grade within five."""
    same = F.when(F.lower("program") == program.lower(), EXACT).when(substring_either(F.col("program"), F.lit(program)), CONTAINING).otherwise(0.0)
    out = 1 + same + F.when(F.lower("university") == university.lower(), SAME_UNIVERSITY).otherwise(0.0)
    return out if grade is None else out + F.when(F.abs(F.col("grade") - grade) <= GRADE_BAND, NEAR_GRADE).otherwise(0.0)


def tier(share: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for at, name in TIERS:
        out = out.when(share >= at, F.lit(name))
    return out.otherwise("developing")


def assess(cases: DataFrame, vector: list[float] | None, university: str, program: str, grade: float | None = None, top: int = 20) -> DataFrame:
    """share accepted among the `top` nearest cases by boosted cosine, score (of 20) and tier; one row.
    Without a vector or a case: share and score 0, tier developing, n 0."""
    q = F.array(*[F.lit(float(x)) for x in vector or []])
    usable = cases.where(F.col("vector").isNotNull()) if vector else cases.limit(0)
    near = usable.withColumn("s", cosine(doubles(F.col("vector")), q) * boost(university, program, grade) if vector else F.lit(0.0))
    near = near.orderBy(F.col("s").desc(), "id").limit(top)
    share = near.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("decision") == "Accepted").cast("double")), F.lit(0.0)).alias("share"))
    return share.select("n", "share", (F.col("share") * 20).alias("score"), tier(F.col("share")).alias("tier"))


def similar_cases(cases: DataFrame, vector: list[float], k: int = 6) -> DataFrame:
    """The k nearest cases that have a grade, with a score of 20 by similarity, a tier of it (1 is nearest) and the
    outcome; a deferred one counts as waitlisted."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    near = cases.where(F.col("grade").isNotNull() & F.col("vector").isNotNull()).withColumn("similarity", cosine(doubles(F.col("vector")), q))
    near = near.orderBy(F.col("similarity").desc(), "id").limit(k)
    level = F.when(F.col("similarity") >= 0.7, 1).when(F.col("similarity") >= 0.5, 2).when(F.col("similarity") >= 0.3, 3).otherwise(4)
    score = F.round(F.greatest(F.lit(0.0), F.col("similarity")) * 20, 1)
    outcome = F.when(F.lower("decision") == "deferred", "Waitlisted").otherwise(F.col("decision"))
    return near.select("id", "university", "program", "grade", score.alias("ec_score"), level.alias("ec_tier"), outcome.alias("decision"), "similarity")


def outcome_counts(cases: DataFrame) -> DataFrame:
    """Accepted, rejected and other of the cases shown."""
    hit = lambda v: F.count_if(F.col("decision") == v)
    return cases.agg(hit("Accepted").alias("accepted"), hit("Rejected").alias("rejected"), (F.count("*") - hit("Accepted") - hit("Rejected")).alias("other"))


def classify(items: DataFrame, prototypes: DataFrame, least: float = CATEGORY) -> DataFrame:
    """(id, category, similarity) of each category whose prototype vector is at least so near; prototypes are
    (category, vector)."""
    pairs = all_pairs(items.select("id", F.col("vector").alias("__x")), prototypes.select("category", F.col("vector").alias("__y")))
    return pairs.select("id", "category", cosine(doubles(F.col("__x")), doubles(F.col("__y"))).alias("similarity")).where(F.col("similarity") >= least)


def describe(activities: DataFrame, text: str = "description") -> DataFrame:
    """Descriptions that say something, joined to one text a request, in their order (pos)."""
    kept = activities.where(F.col(text).isNotNull() & ~is_trivial(F.col(text)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim(text).alias("t")))), lambda s: s["t"]), ". ")
    return kept.groupBy("request_id").agg(joined.alias("text"))
