"""Grouped analytics over application records.

Input columns: university, program, grade, decision (Accepted, Rejected, Waitlisted), cycle_year,
decision_month, and for some province, applicant_type, g11, g12. Each is one aggregate, whatever the number of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import bucket_label, substring_either

ACCEPTED = "Accepted"
DIFFICULTY = [(93.0, "Very High"), (88.0, "High"), (82.0, "Moderate")]
CONFIDENCE = [(30, "high"), (10, "moderate")]


def accepted() -> Column:
    return F.col("decision") == ACCEPTED


def select_program(df: DataFrame, university: str, program: str) -> DataFrame:
    """Rows of the program; by substring in either direction where none is equal."""
    exact = df.where((F.col("university") == university) & (F.col("program") == program))
    if exact.limit(1).count():
        return exact
    return df.where(substring_either(F.col("university"), F.lit(university)) & substring_either(F.col("program"), F.lit(program)))


def acceptance(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(accepted()).alias("n_accepted"), F.avg(accepted().cast("double")).alias("rate"))


def competitive(df: DataFrame, least: int = 20, top: int = 20) -> DataFrame:
    """The programs with the lowest acceptance rates among those with enough applications."""
    return acceptance(df, ["university", "program"]).where(F.col("n") >= least).orderBy("rate", "university", "program").limit(top)


def grade_stats(df: DataFrame, by: list[str] | None = None, grade: str = "grade") -> DataFrame:
    g = F.col(grade)
    quantiles = F.percentile(g, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.where(g.isNotNull()).groupBy(*(by or [])).agg(F.avg(g).alias("mean"), quantiles.alias("q"), F.min(g).alias("min"), F.max(g).alias("max"), F.coalesce(F.stddev_samp(g), F.lit(0.0)).alias("std"), F.count(g).alias("n"))
    return out.select(*(by or []), "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"), "min", "max", "std", "n")


def difficulty(median: Column) -> Column:
    return bucket_label(median, DIFFICULTY, "Accessible", "Unknown")


def confidence(n: Column) -> Column:
    return bucket_label(n, CONFIDENCE, "low")


def listing(df: DataFrame) -> DataFrame:
    """Every program: n, median and mean accepted grade, difficulty, confidence; most applications first."""
    g = F.when(accepted(), F.col("grade"))
    by = df.groupBy("university", "program").agg(F.count("*").alias("n"), F.percentile(g, F.lit(0.5)).alias("median"), F.avg(g).alias("mean"))
    return by.withColumn("difficulty", difficulty(F.col("median"))).withColumn("confidence", confidence(F.col("n"))).orderBy(F.col("n").desc(), "university", "program")


def histogram(df: DataFrame, by: list[str] | None = None, width: float = 2.0) -> DataFrame:
    """Accepted and rejected counts in bins of `width` from the floor of the least grade; the last bin is closed. Empty bins are left out."""
    rows = df.where(F.col("decision").isin("Accepted", "Rejected") & F.col("grade").isNotNull())
    ends = rows.groupBy(*(by or [])).agg(F.floor(F.min("grade")).alias("lo"), F.ceil(F.max("grade")).alias("hi"))
    joined = rows.join(ends, by) if by else rows.crossJoin(F.broadcast(ends))
    bins = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / width))
    bin_ = F.least(F.floor((F.col("grade") - F.col("lo")) / width), bins - 1)
    out = joined.groupBy(*(by or []), "lo", bin_.cast("int").alias("bin")).agg(F.count_if(accepted()).alias("accepted"), F.count_if(~accepted()).alias("rejected"))
    return out.select(*(by or []), "bin", (F.col("lo") + F.col("bin") * width).cast("double").alias("start"), "accepted", "rejected")


def timeline(df: DataFrame, by: list[str]) -> DataFrame:
    """Of accepted rows: earliest, upper median and latest month, from counts by month."""
    months = df.where(accepted() & F.col("decision_month").isNotNull()).groupBy(*by, "decision_month").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    cum = months.withColumn("upto", F.sum("c").over(w.orderBy("decision_month"))).withColumn("n", F.sum("c").over(w))
    upper = F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("decision_month")))
    return cum.groupBy(*by).agg(F.min("decision_month").alias("earliest"), upper.alias("median"), F.max("decision_month").alias("latest"), F.max("n").alias("n"))


def year_trend(df: DataFrame) -> DataFrame:
    g = F.col("grade")
    return df.groupBy("cycle_year").agg(F.coalesce(F.percentile(g, F.lit(0.5)), F.lit(0.0)).alias("median_all"), F.coalesce(F.percentile(F.when(accepted(), g), F.lit(0.5)), F.lit(0.0)).alias("median_accepted"), F.count("*").alias("n"))


def admitted_range(df: DataFrame, by: list[str]) -> DataFrame:
    stats = grade_stats(df.where(accepted()), by)
    return stats.select(*by, "min", "p25", "median", "p75", "max", "n", confidence(F.col("n")).alias("confidence"))


def progression(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median and n of several grades of accepted rows, a row each."""
    wide = df.where(accepted()).agg(*[f.alias(f"{k}_{c}") for c in columns for k, f in (("mean", F.avg(c)), ("median", F.percentile(c, F.lit(0.5))), ("n", F.count(c)))])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}_{c}").alias(k) for k in ("mean", "median", "n")]) for c in columns])).alias("r")).select("r.*")


def shares(df: DataFrame, column: str, missing: str = "Unknown") -> DataFrame:
    """Counts and shares of the values of a column, missing ones under a name."""
    by = df.groupBy(F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def data_quality(df: DataFrame, by: list[str], sparse: float = 0.3) -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("grade").isNull().cast("double")).alias("missing"))
    return out.withColumn("is_sparse", (F.col("missing") > sparse) | (F.col("n") < 10))


def percentile_in_histogram(bins: DataFrame, grade: float, width: float = 2.0, count: str = "accepted") -> DataFrame:
    """Percentile of a grade: counts of the bins below, and a linear part of its own; 50 without data, 100 above all."""
    below = F.sum(F.when(F.col("start") + width <= grade, F.col(count)).when(F.col("start") <= grade, F.col(count) * (F.lit(grade) - F.col("start")) / width).otherwise(0))
    return bins.agg(F.coalesce(F.round(100 * below / F.nullif(F.sum(count), F.lit(0))), F.lit(50.0)).alias("percentile"))


def what_if(bins: DataFrame, grades: list[float], width: float = 2.0) -> DataFrame:
    """Accepted share of the bin that holds each grade; above all bins the last; below them null."""
    asked = bins.sparkSession.createDataFrame([(float(g),) for g in grades], "grade double")
    inside = F.col("start") <= F.col("grade")
    hit = asked.join(F.broadcast(bins), inside, "left").groupBy("grade").agg(F.max_by(F.struct("accepted", "rejected"), "start").alias("b"))
    return hit.select("grade", F.try_divide(F.col("b.accepted"), F.col("b.accepted") + F.col("b.rejected")).alias("probability"))


def tier(probability: Column, grade: Column, p25: Column, p75: Column) -> Column:
    low, high = F.coalesce(p25, F.lit(80.0)), F.coalesce(p75, F.lit(95.0))
    return F.when((probability >= 0.75) & (grade >= high), "safety").when((probability < 0.4) | (grade < low), "reach").otherwise("target")


def program_document(df: DataFrame, university: str, program: str) -> DataFrame:
    """All parts for one program as one row of nested columns."""
    rows = select_program(df, university, program)
    pack = lambda d, name: d.agg(F.sort_array(F.collect_list(F.struct(*d.columns))).alias(name))
    out = pack(rows.groupBy("decision").agg(F.count("*").alias("n")), "decisions")
    for part, name in ((grade_stats(rows), "grades"), (histogram(rows), "distribution"), (year_trend(rows), "trend"), (admitted_range(rows, ["cycle_year"]), "admitted"), (timeline(rows.withColumn("k", F.lit(1)), ["k"]).drop("k"), "timeline")):
        out = out.crossJoin(pack(part, name))
    return out
