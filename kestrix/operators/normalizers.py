"""Name normalisers: exact alias, then the most similar canonical name, with a match report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.text import program_components
from .matching import best_match, match_aliases


@dataclass
class UniversityNormalizer:
    """Aliases (alias, canonical) as a table; names that no alias equals are scored against canonical ones."""

    aliases: DataFrame
    least: float = 0.85

    def normalize(self, df: DataFrame, name: str) -> DataFrame:
        """Adds canonical (INVALID for no match) and match_kind: exact, fuzzy or invalid.

        Scores are made for distinct names that miss, and joined back."""
        exact = match_aliases(df, name, self.aliases)
        missed = exact.where("canonical is null").select(F.col(name).alias("__n")).where("__n is not null").distinct()
        known = self.aliases.select(F.col("canonical").alias("__c")).distinct()
        scored = best_match(missed, "__n", known, "__c", self.least).select("__n", F.col("canonical").alias("__f"))
        out = exact.join(scored, F.col(name) == F.col("__n"), "left")
        kind = F.when(F.col("canonical").isNotNull(), "exact").when(F.coalesce(F.col("__f"), F.lit("INVALID")) != "INVALID", "fuzzy").otherwise("invalid")
        return out.withColumn("match_kind", kind).withColumn("canonical", F.coalesce("canonical", "__f", F.lit("INVALID"))).drop("__n", "__f")

    def variations(self, canonical: str) -> list[str]:
        return sorted(r.alias for r in self.aliases.where(F.col("canonical") == canonical).collect())

    def canonical_names(self) -> list[str]:
        return sorted(r.canonical for r in self.aliases.select("canonical").distinct().collect())


def report(normalized: DataFrame) -> DataFrame:
    """matched, fuzzy, invalid, total and the match rate in per cent (0 for no rows)."""
    n = lambda k: F.count_if(F.col("match_kind") == k)
    rate = F.coalesce(F.try_divide(100.0 * (n("exact") + n("fuzzy")), F.count("*")), F.lit(0.0))
    return normalized.agg(n("exact").alias("matched"), n("fuzzy").alias("fuzzy"), n("invalid").alias("invalid"), F.count("*").alias("total"), rate.alias("match_rate"))


def normalize_programs(df: DataFrame, name: str, bases: DataFrame | None = None) -> DataFrame:
    """Adds the components of a program name; a base name with an alias takes its canonical form."""
    out = df.withColumns(program_components(F.col(name)))
    if bases is not None:
        out = match_aliases(out, "base_name", bases).withColumn("base_name", F.coalesce("canonical", "base_name")).drop("canonical")
        out = out.withColumn("name_key", F.regexp_replace(F.lower("base_name"), " ", "_"))
    return out
