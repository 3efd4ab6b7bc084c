"""Shared pieces: column picking, tables in the shared folder, tokenising, labels."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship

_UPPER = re.compile("[A-Z]+")
#: Words of the licence and benchmark contracts: digits, letters a-z and all beyond ASCII.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Words of the near-duplicate contract: runs without ASCII white space.
TOKEN = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    return text.lower() if text.isascii() else _UPPER.sub(lambda m: m[0].lower(), text)


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; extra columns, also ones whose names differ in case
    alone or occur twice, are dropped before any name is resolved. A missing column is null.
    All operators start here, so the executors get the package's code here too."""
    ship(df.sparkSession)
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[(F.col(f"_c{at[c]}") if c in at else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def documents(df: DataFrame) -> DataFrame:
    """doc_id and whole text; null text counts as empty."""
    return pick(df, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids fall in a part of their own (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="kestrix-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Fewer rows in a batch between JVM and Python, for actions on rows of several kilobytes: what a
    worker holds at once is then some megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Where the shared folder is on a mounted file system, files get no checksum files beside them: each would start
#: several processes to set permissions, and while one starts, all of an executor's memory counts twice.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_scopes: list[list[Workspace]] = []


@contextmanager
def scratch():
    """The workspaces that operators make in here are dropped at its end: for results that are stored by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for ws in _scopes.pop():
            ws.drop()


class Workspace:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/kestrix-{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)
        if _scopes:
            _scopes[-1].append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with small_batches(self.spark):
            df.write.mode("overwrite").options(compression="zstd", **PLAIN_FILES).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        """Remove one table, or all; what is no longer read needs no disk."""
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception as e:  # the session may have ended before the interpreter does
            if name:
                raise RuntimeError(f"cannot remove {self.root}/{name}") from e


def training_ids(labelled: DataFrame, most: int) -> DataFrame:
    """A bounded, deterministic sample of labelled rows (doc_id, y): the `most` smallest by a
    hash of the id. The top-k keeps at most `most` rows of two numbers a task, so the result is small enough to broadcast."""
    return labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
