"""The SQL surface: tables as views, and functions of the engine as temporary SQL functions.

The functions are SQL expressions, so Catalyst inlines them; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SORTED = "array_join(array_sort(split(trim(regexp_replace(lower({0}), '[^a-z0-9\\\\s]', '')), '\\\\s+')), ' ')"
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"

FUNCTIONS = {
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": _DOT.format("a", "b"),
    "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": f"coalesce(try_divide({_DOT.format('a', 'b')}, sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')})), 0D)",
    "sorted_tokens(s STRING) RETURNS STRING": _SORTED.format("s"),
    "token_similarity(a STRING, b STRING) RETURNS DOUBLE": f"CASE WHEN {_SORTED.format('a')} = {_SORTED.format('b')} THEN 1D WHEN {_SORTED.format('a')} = '' OR {_SORTED.format('b')} = '' THEN 0D ELSE 1 - levenshtein({_SORTED.format('a')}, {_SORTED.format('b')}) / greatest(length({_SORTED.format('a')}), length({_SORTED.format('b')})) END",
    "logistic(z DOUBLE) RETURNS DOUBLE": "CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END",
    "posterior_mean(k DOUBLE, n DOUBLE, prior DOUBLE, strength DOUBLE) RETURNS DOUBLE": "(strength * prior + k) / (strength + n)",
    "contains_either(a STRING, b STRING) RETURNS BOOLEAN": "contains(lower(a), lower(b)) OR contains(lower(b), lower(a))",
}


def register_functions(spark: SparkSession) -> list[str]:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.partition("(")[0] for head in FUNCTIONS]


def register_tables(spark: SparkSession, tables: dict[str, str | DataFrame]) -> None:
    """Views by name, of Parquet paths or DataFrames."""
    for name, source in tables.items():
        (spark.read.parquet(source) if isinstance(source, str) else source).createOrReplaceTempView(name)


def query(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """A parametrised SQL query; values are bound, not pasted."""
    return spark.sql(text, args=parameters or None)
