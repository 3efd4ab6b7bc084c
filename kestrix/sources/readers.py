"""Readers of records: CSV, JSON with a record path, alias files, and paged HTTP as a Python data source."""

from __future__ import annotations

import json
import urllib.request
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None, keep: list[str] | None = None, constants: dict[str, str] | None = None, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """All strings. Renames the columns that are there, adds missing ones as null, then constants. A byte order mark is dropped."""
    df = spark.read.options(header=True, sep=sep, encoding=encoding, multiLine=True, inferSchema=False, escape='"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    for old, new in (columns or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    for c, v in (constants or {}).items():
        df = df.withColumn(c, F.lit(v))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in keep]) if keep else df


def read_csv_positions(spark: SparkSession, path: str, names: dict[int, str]) -> DataFrame:
    """Columns by position, the first line left out; short rows give nulls."""
    df = spark.read.options(header=True, multiLine=True, escape='"', mode="PERMISSIVE").csv(path)
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{i}").alias(n) for i, n in names.items()])


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines less the header, 0 at least."""
    return max(0, spark.read.text(path).count() - 1)


def read_json(spark: SparkSession, path: str, record_path: str | None = None) -> DataFrame:
    """Whole-file JSON: the rows at a dotted path (an array gives a row each, an object one)."""
    df = spark.read.option("multiLine", True).json(path)
    if record_path:
        c = F.col(record_path)
        kind = df.select(c.alias("r")).dtypes[0][1]
        df = df.select((F.explode(c) if kind.startswith("array") else c).alias("r")).select("r.*")
    return df


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """A YAML file of canonical name -> variations as (alias, canonical); a canonical name is its own alias."""
    import yaml

    table = yaml.safe_load("\n".join(r.value for r in spark.read.text(path).collect())) or {}
    rows = [(a, c) for c, names in table.items() for a in [c, *(names or [])]]
    return spark.createDataFrame(rows, "alias string, canonical string").select(F.lower(F.trim("alias")).alias("alias"), "canonical").dropDuplicates(["alias"])


class PagedHttp(DataSource):
    """spark.read.format("paged_http").option("url", ...).schema(...): follows `next` links; records are a
    list, or under `data` or `results`, or the object itself. Option token: bearer token."""

    @classmethod
    def name(cls) -> str:
        return "paged_http"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema):
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.token, self.timeout = options["url"], options.get("token"), float(options.get("timeout", 5))

    def partitions(self):
        return [InputPartition(0)]  # each page names the next

    def read(self, partition):
        for record in pages(self.url, self.token, self.timeout):
            yield (json.dumps(record),)


def pages(url: str, token: str | None = None, timeout: float = 5.0, fetch=None):
    """Records of all pages."""
    if fetch is None:

        def fetch(at: str):
            request = urllib.request.Request(at, headers={"Authorization": f"Bearer {token}"} if token else {})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r)

    while url:
        page = fetch(url)
        rows = page if isinstance(page, list) else page.get("data", page.get("results", page)) if isinstance(page, dict) else []
        yield from rows if isinstance(rows, list) else [rows]
        link = page.get("next") if isinstance(page, dict) else None
        url = urljoin(url, link) if link else ""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedHttp)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def is_json(spark: SparkSession, path: str) -> bool:
    """Whether the path is there and no document of it is malformed."""
    if not is_file(spark, path):
        return False
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return "_corrupt" not in rows.columns


def is_reachable(url: str, token: str | None = None, timeout: float = 5.0, fetch=None) -> bool:
    """Whether the address answers with 200; any error is no."""
    from urllib.request import Request, urlopen

    request = Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
    try:
        with (fetch or urlopen)(request, timeout=timeout) as answer:
            return answer.status == 200
    except Exception:
        return False


def read_files(spark: SparkSession, kind: str, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON lines, CSV or, where the session has its package, Avro."""
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)
