"""Writers of results: nested JSON, flat CSV, YAML mappings and model files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_clusters(members: DataFrame, path: str) -> None:
    """Cluster members as a JSON document a cluster: cluster_id, canonical, members."""
    nested = members.groupBy("cluster_id", "canonical").agg(F.sort_array(F.collect_list(F.struct("variant", "score", "frequency"))).alias("members"))
    nested.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """Review rows as written by write_csv; an empty merge target is null."""
    raw = spark.read.options(header=True, escape='"').csv(path)
    number = lambda c, k: F.nullif(F.trim(c), F.lit("")).cast(k)
    return raw.select(number("cluster_id", "int").alias("cluster_id"), "canonical", "variant", number("score", "double").alias("score"), number("frequency", "bigint").alias("frequency"), "action", "notes", number("merge_target", "int").alias("merge_target"))


def mapping_yaml(mapping: DataFrame) -> str:
    """canonical -> variants as YAML, by name; the mapping is a reviewed list, small by nature."""
    import yaml

    return yaml.safe_dump({r.canonical: list(r.variants) for r in mapping.orderBy("canonical").collect()}, allow_unicode=True, sort_keys=True)


def save_model(spark: SparkSession, state: dict, path: str) -> None:
    """A model's parameters as one JSON line in a folder of any store that Spark writes."""
    spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition columns; rows of a partition value are gathered first, large ones split by Spark."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by a key, so that joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_files(df: DataFrame, kind: str, path: str) -> None:
    """Parquet, ORC, JSON lines, CSV or, where the session has its package, Avro."""
    df.write.mode("overwrite").format(kind).save(path)


def cluster_rows(clusters: DataFrame) -> DataFrame:
    """Nested clusters (cluster_id, canonical, members) as a row a member."""
    return clusters.select("cluster_id", "canonical", F.explode("members").alias("m")).select("cluster_id", "canonical", "m.variant", "m.score", "m.frequency")


def review_items(members: DataFrame) -> DataFrame:
    """Rows for review of cluster members: the action is KEEP until a reviewer says otherwise; the worst scores first."""
    return members.select("cluster_id", "canonical", "variant", "score", "frequency", F.lit("KEEP").alias("action"), F.lit("").alias("notes"), F.lit(None).cast("int").alias("merge_target")).orderBy("score", "cluster_id", "variant")


def cluster_summary(members: DataFrame, top: int = 10) -> tuple[dict, DataFrame]:
    """Counts of clusters, names and records with the largest cluster's size; the `top` clusters by size."""
    by = members.groupBy("cluster_id", "canonical").agg(F.count("*").alias("size"), F.sum("frequency").alias("total_frequency"))
    r = by.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("names"), F.coalesce(F.sum("total_frequency"), F.lit(0)).alias("records"), F.coalesce(F.max("size"), F.lit(0)).alias("largest")).first()
    return r.asDict(), by.orderBy(F.col("size").desc(), "cluster_id").limit(top)


def write_summary(spark: SparkSession, counts: dict, path: str) -> None:
    """Counts as lines of text."""
    spark.createDataFrame([(f"{k}: {v}",) for k, v in counts.items()], "value string").coalesce(1).write.mode("overwrite").text(path)
