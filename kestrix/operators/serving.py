"""Batch scoring of applications: validation, features, probability, interval, label, explanation.

A request is a row; a batch is one plan over all rows, with an array of errors where a row is not
valid, so a bad row does not stop the others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bucket_label, lookup
from .calibration import logit, sigmoid
from .models import normal_interval

PROVINCES = ("AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT")
REQUEST = "request_id bigint, top_6_average double, university string, program string, grade_11_average double, grade_12_average double, province string, country string, application_year int, activities array<struct<description: string>>"


def request_errors() -> Column:
    """Messages of what is wrong with a request; empty for a valid one."""
    average = lambda c: F.when(~F.col(c).between(0, 100), F.lit(f"{c} must be within 0 and 100"))
    named = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c} is required"))
    return F.array_compact(F.array(
        F.when(F.col("top_6_average").isNull(), F.lit("top_6_average is required")),
        *[average(c) for c in ("top_6_average", "grade_11_average", "grade_12_average")],
        named("university"), named("program"),
        F.when(F.col("province").isNotNull() & ~F.upper("province").isin(*PROVINCES), F.lit("unknown province")),
    ))


@dataclass
class Scorer:
    """Fixed coefficients over built features, with Platt scaling (a, b) and n behind the interval.

    A grade that is missing takes the top-six average; a grade of 0 is a grade."""

    beta: dict[str, float] = field(default_factory=lambda: {"intercept": -9.0, "top_6": 0.08, "grade_11": 0.015, "grade_12": 0.02, "is_on": 0.1, "is_bc": 0.05, "is_qc": 0.0, "is_domestic": 0.1, "activities": 0.15})
    a: float = 1.0
    b: float = 0.0
    n: int = 100

    def features(self) -> dict[str, Column]:
        top = F.col("top_6_average")
        province = F.upper(F.coalesce("province", F.lit("")))
        home = F.lower(F.coalesce("country", F.lit("canada"))) == "canada"
        count = F.least(F.coalesce(F.size("activities"), F.lit(0)), F.lit(10))
        return {
            "intercept": F.lit(1.0), "top_6": top, "grade_11": F.coalesce("grade_11_average", top), "grade_12": F.coalesce("grade_12_average", top),
            **{f"is_{p.lower()}": (province == p).cast("double") for p in ("ON", "BC", "QC")},
            "is_domestic": home.cast("double"), "activities": F.greatest(count, F.lit(0)).cast("double"),
        }

    def score(self, requests: DataFrame) -> DataFrame:
        """request_id, errors, probability, low, high, label, reasons (feature, contribution; largest first)."""
        rows = requests.withColumn("errors", request_errors())
        ok = F.size("errors") == 0
        rows = rows.withColumns({f"__{k}": c for k, c in self.features().items()})
        z = sum((F.col(f"__{k}") * F.lit(w) for k, w in self.beta.items()), F.lit(0.0))
        rows = rows.withColumn("__raw", sigmoid(z))
        p = F.least(F.greatest(sigmoid(F.lit(self.a) * logit(F.col("__raw")) + F.lit(self.b)), F.lit(0.001)), F.lit(0.999))
        rows = rows.withColumn("probability", F.when(ok, p))
        low, high = normal_interval(F.col("probability"), self.n)
        parts = F.array(*[F.struct((-F.abs(F.col(f"__{k}") * F.lit(w))).alias("size"), F.lit(k).alias("feature"), (F.col(f"__{k}") * F.lit(w)).alias("contribution")) for k, w in self.beta.items() if k != "intercept"])
        reasons = F.transform(F.slice(F.array_sort(parts), 1, 5), lambda s: F.struct(s["feature"].alias("feature"), s["contribution"].alias("contribution")))
        return rows.select("request_id", "errors", "probability", low.alias("low"), high.alias("high"), F.when(ok, bucket_label(F.col("probability"), [(0.7, "Likely"), (0.4, "Possible")], "Unlikely")).alias("label"), F.when(ok, reasons).alias("reasons"))


def canonical(c: Column, aliases: dict[str, str]) -> Column:
    """The canonical name of a trimmed alias in any case; else the value itself."""
    return F.coalesce(lookup({k.lower(): v for k, v in aliases.items()}, F.lower(F.trim(c))), c)


def similar_programs(df: DataFrame, vectors: DataFrame, key: str, name: str, k: int = 5) -> DataFrame:
    """The k nearest programs of each by cosine of their vectors, itself left out."""
    from .vectorstore import search_batch

    near = search_batch(vectors, df, k)
    names = vectors.select(F.col(key).alias("id"), F.col(name).alias("similar"))
    return near.join(names, "id").select("query_id", "rank", "similar", "similarity")
