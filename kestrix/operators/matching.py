"""Name matching: alias joins, fuzzy scores of all names that may reach a threshold, leader clusters and the review workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import glob_to_regex, sorted_tokens, token_sort_similarity
from ..storage import stored
from .windows import numbered


def match_aliases(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Exact join on the trimmed, lower-cased name; adds canonical (null on a miss)."""
    dim = aliases.select(F.lower(F.trim("alias")).alias("__a"), "canonical").dropDuplicates(["__a"])
    return names.join(dim, F.lower(F.trim(F.col(name))) == F.col("__a"), "left").drop("__a")


def pairs_by_token(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of distinct names that share a word: an equi-join on words, not all pairs."""
    words = lambda d, c, k: d.select(F.col(c).alias(k)).distinct().select(k, F.explode(F.array_distinct(F.split(sorted_tokens(F.col(k)), " "))).alias("__w"))
    return words(left, a, "a").join(words(right, b, "b"), "__w").select("a", "b").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(a, b, score) of all pairs of distinct names whose score is at least `least` (above 0); none is lost.

    A score of `least` allows e = (1 - least) * (the longer length) edits of the sorted words, so lengths are near. Cut
    into e + 1 parts, one part of b is left whole by e edits and stands in a within e places of its own: names
    meet by (length, part, its text) in an equi-join, and only those that meet are scored."""
    shape = lambda d, c, k: d.select(F.col(c).alias(k)).where(F.col(k).isNotNull()).distinct().withColumn("__s", sorted_tokens(F.col(k))).withColumn("__n", F.length("__s"))
    widest = lambda n: F.floor(n / F.lit(float(least)) + 1e-9)
    edits = lambda n: F.floor(F.lit(1 - float(least)) * widest(n) + 1e-9).cast("int")
    start = lambda n, i, e: F.floor(n * i / (e + 1)).cast("int")
    each = lambda low, high: F.explode(F.sequence(low.cast("int"), high.cast("int")))
    y = shape(right, b, "b").withColumn("__e", edits(F.col("__n"))).withColumn("__i", each(F.lit(0), F.col("__e")))
    y = y.withColumn("__from", start(F.col("__n"), F.col("__i"), F.col("__e"))).withColumn("__to", start(F.col("__n"), F.col("__i") + 1, F.col("__e")))
    y = y.select("b", F.col("__n").cast("int").alias("__m"), "__i", F.substring(F.col("__s"), F.col("__from") + 1, F.col("__to") - F.col("__from")).alias("__part"))
    x = shape(left, a, "a").withColumn("__m", each(F.ceil(F.col("__n") * least - 1e-9), widest(F.col("__n")))).withColumn("__e", edits(F.col("__m")))
    x = x.withColumn("__i", each(F.lit(0), F.col("__e")))
    x = x.withColumn("__from", start(F.col("__m"), F.col("__i"), F.col("__e"))).withColumn("__k", start(F.col("__m"), F.col("__i") + 1, F.col("__e")) - F.col("__from"))
    low, high = F.greatest(F.lit(0), F.col("__from") - F.col("__e")), F.least(F.col("__n") - F.col("__k"), F.col("__from") + F.col("__e"))
    x = x.where(low <= high).withColumn("__at", each(low, high)).select("a", "__m", "__i", F.substring(F.col("__s"), F.col("__at") + 1, F.col("__k")).alias("__part")).distinct()
    met = x.join(y, ["__m", "__i", "__part"]).select("a", "b").distinct()
    return met.withColumn("score", token_sort_similarity(F.col("a"), F.col("b"))).where(F.col("score") >= least)


def best_match(names: DataFrame, name: str, canonical: DataFrame, target: str, least: float = 0.85) -> DataFrame:
    """For each distinct name its most similar canonical one (ties by name) if it reaches `least`, else INVALID with score 0."""
    scored = similar_pairs(names, canonical, name, target, least)
    best = scored.groupBy("a").agg(F.max_by(F.struct("b", "score"), F.struct("score", F.col("b"))).alias("m"))
    out = names.select(F.col(name).alias("a")).distinct().join(best, "a", "left")
    return out.select(F.col("a").alias(name), F.coalesce("m.b", F.lit("INVALID")).alias("canonical"), F.coalesce("m.score", F.lit(0.0)).alias("score"))


def leader_clusters(names: DataFrame, name: str, least: float = 0.8) -> DataFrame:
    """Greedy clusters in the order of frequency, then length, then name: (cluster_id, canonical, variant, score, frequency).

    The most frequent name that is left leads; names near it join. That is: a name leads unless a name before it that
    leads is near, and joins the first such. Names before which no undecided name is near are told all at once, round by round."""
    counts = stored(names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("frequency")), "names")
    place = lambda n, f: F.struct((-F.col(f)).alias("f"), (-F.length(n)).alias("l"), F.col(n).alias("name"))
    near = similar_pairs(counts, counts, "name", "name", least).where("a != b")
    side = lambda c: counts.select(F.col("name").alias(c), place("name", "frequency").alias(f"k{c}"))
    near = stored(near.join(side("a"), "a").join(side("b"), "b"), "near")
    open_, leads = near, None
    while open_.limit(1).count():
        # a leads if it comes before all undecided names that are near
        first = open_.groupBy("a").agg(F.min("kb").alias("kb"), F.first("ka").alias("ka")).where("ka < kb").select("a")
        first = stored(first, "leads")
        leads = first if leads is None else leads.unionByName(first)
        joined = open_.join(first, "a", "left_semi").select(F.col("b").alias("x"))
        done = stored(joined.unionByName(first.select(F.col("a").alias("x"))).distinct(), "done")
        open_ = stored(open_.join(done, F.col("a") == F.col("x"), "left_anti").join(done, F.col("b") == F.col("x"), "left_anti"), "open")
    if leads is not None:
        # names that were left alone, with their near ones all decided, lead too unless a leader is near
        taken = near.join(leads.select(F.col("a").alias("b")), "b", "left_semi").select("a").distinct()
        leads = counts.select(F.col("name").alias("a")).join(taken, "a", "left_anti")
        member = near.join(leads.select(F.col("a").alias("b")), "b", "left_semi").groupBy(F.col("a").alias("variant")).agg(F.min_by(F.struct("b", "score"), "kb").alias("m"))
        member = member.select("variant", F.col("m.b").alias("canonical"), F.col("m.score").alias("score"))
    else:
        leads = counts.select(F.col("name").alias("a"))
        member = counts.limit(0).select(F.col("name").alias("variant"), F.col("name").alias("canonical"), F.lit(0.0).alias("score"))
    heads = numbered(counts.join(leads.select(F.col("a").alias("name")), "name"), [F.col("frequency").desc(), F.length("name").desc(), F.col("name")])
    heads = heads.select(F.col("name").alias("canonical"), (F.col("rn") - 1).cast("int").alias("cluster_id"))
    every = member.unionByName(heads.select(F.col("canonical").alias("variant"), "canonical", F.lit(1.0).alias("score")))
    return every.join(heads, "canonical").join(counts.withColumnRenamed("name", "variant"), "variant").select("cluster_id", "canonical", "variant", "score", "frequency")


def review_statistics(rows: DataFrame, least: float = 80.0) -> DataFrame:
    return rows.agg(F.count("*").alias("items"), F.count_distinct("cluster_id").alias("clusters"), F.count_if(F.col("score") < least).alias("low_score"), F.count_if((F.col("frequency") > 50) & (F.col("score") < 90)).alias("high_impact"))


def review_order(kind: str) -> list[Column]:
    """Sort keys by kind: cluster, score, frequency, canonical."""
    presets = {"score": [F.col("score").asc(), F.col("cluster_id"), F.col("variant")], "frequency": [F.col("frequency").desc(), F.col("cluster_id"), F.col("variant")], "canonical": [F.col("canonical"), F.col("score").desc(), F.col("variant")]}
    return presets.get(kind, [F.col("cluster_id"), F.col("score").desc(), F.col("variant")])


def review_faults(rows: DataFrame) -> DataFrame:
    """(variant, message) of rows that cannot be applied."""
    known = rows.select(F.col("cluster_id").alias("merge_target")).distinct().withColumn("__ok", F.lit(True))
    checked = rows.join(known, "merge_target", "left")
    messages = F.array_compact(F.array(
        F.when(~F.col("action").isin("KEEP", "SPLIT", "MERGE", "RENAME", "DELETE"), F.lit("unknown action")),
        F.when((F.col("action") == "MERGE") & F.col("__ok").isNull(), F.lit("merge target does not exist")),
        F.when((F.col("action") == "RENAME") & (F.coalesce(F.col("notes"), F.lit("")) == ""), F.lit("rename needs a name in notes")),
    ))
    twice = rows.groupBy("variant").agg(F.count_distinct("cluster_id").alias("n")).where("n > 1").select("variant", F.lit("in two clusters").alias("message"))
    return checked.select("variant", F.explode(messages).alias("message")).unionByName(twice)


def apply_review(rows: DataFrame) -> DataFrame:
    """canonical -> sorted variants after KEEP, SPLIT, MERGE, RENAME (for its whole cluster) and DELETE."""
    rename = rows.where("action = 'RENAME'").groupBy("cluster_id").agg(F.max_by("notes", "variant").alias("__new"))
    heads = rows.select("cluster_id", "canonical").distinct().join(rename, "cluster_id", "left").select(F.col("cluster_id").alias("merge_target"), F.coalesce("__new", "canonical").alias("__target"))
    own = rows.join(rename, "cluster_id", "left").join(heads, "merge_target", "left").where("action != 'DELETE'")
    name = F.when(F.col("action") == "SPLIT", F.col("variant")).when(F.col("action") == "MERGE", F.col("__target")).otherwise(F.coalesce("__new", "canonical"))
    return own.groupBy(name.alias("canonical")).agg(F.sort_array(F.collect_set("variant")).alias("variants"))


def glob_weight(a: str, b: str, rules: list[tuple[str, str, float]], default: float = 0.0) -> Column:
    """The weight of the first rule whose two shell patterns fit; rules are literals of the plan."""
    out = F.when(F.lit(False), F.lit(0.0))
    for x, y, weight in rules:
        out = out.when(F.col(a).rlike(glob_to_regex(x)) & F.col(b).rlike(glob_to_regex(y)), F.lit(float(weight)))
    return out.otherwise(F.lit(float(default)))


def first_per(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")
