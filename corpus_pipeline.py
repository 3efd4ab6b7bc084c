"""A corpus pipeline: language ID, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns
of documents. `run` applies them in turn, each stage's result written to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kestrix.llm.common import Workspace, scratch, table
from kestrix.llm.decontaminate import find_contamination
from kestrix.llm.exact_dedup import exact_dedup
from kestrix.llm.langid import UND, predictor
from kestrix.llm.near_dedup import near_duplicates
from kestrix.llm.packing import pack
from kestrix.llm.queries import tokenizer_paths

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MOST_FILES = 10_000

#: Packed pieces are ids of a tokenizer, which SQL cannot make.
ORACLE_SQL = None


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _numbered(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The documents with a number of each row (ids may be null or repeat) that every run gives anew.

    Rows of files are numbered by file and place in it, over a broadcast table of the files where these are
    at most MOST_FILES; the rows of other tables, or of more files, are stored with a number."""
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        path = F.col("_metadata.file_path").alias("_path")
        files = docs.select(path).distinct().limit(MOST_FILES + 1).collect()
        if len(files) <= MOST_FILES:
            number = docs.sparkSession.createDataFrame([(k, r[0]) for k, r in enumerate(sorted(files))], "_file bigint, _path string")
            rows = docs.select(*COLUMNS, path, F.col("_metadata.row_index").alias("_row")).join(F.broadcast(number), "_path")
            return rows.select(*COLUMNS, (F.shiftleft("_file", 40) + F.col("_row")).alias("row"))
    return ws.save(_plain(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")


def _keep(docs: DataFrame, name: str, decide: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The documents whose rows an operator keeps.

    `decide` takes the numbered documents, and as an operator sees them (the number in place of the id), and gives
    the numbers that stay; these are stored, after which what the operator stored on its way needs no disk. They
    grow with the documents, so they are never broadcast."""
    ws = Workspace(docs.sparkSession, name)
    numbered = _numbered(docs, ws)
    with scratch():
        rows = ws.save(decide(numbered, numbered.select(F.col("row").alias("doc_id"), "text")).select("row"), "rows")
    return _plain(numbered.join(rows.hint("merge"), "row", "left_semi"))


def _one_of_each(numbered: DataFrame, found: DataFrame, group: str, best: Column) -> DataFrame:
    """The row with the least `best` of each group of an operator's rows."""
    named = found.select(F.col("doc_id").alias("row"), F.col(group).alias("group")).join(numbered.select("row", "doc_id").hint("merge"), "row")
    return named.groupBy("group").agg(F.min(F.struct(best.alias("best"), "row"))["row"].alias("row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts and texts without letters, whatever could be learned from the table, and gives
    documents without a language the one that is predicted. A language that a document states stays."""
    told = _plain(docs).withColumn("_p", predictor(docs)(F.coalesce("text", F.lit(""))))
    named = F.coalesce("lang", F.nullif(F.col("_p.lang_pred"), F.lit(UND)))
    return _plain(told.where("_p.lettered").withColumn("lang", named))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    largest = F.struct(F.col("doc_id").isNull(), -F.col("doc_id").cast("decimal(20,0)"))
    return _keep(docs, "exact-rows", lambda numbered, seen: _one_of_each(numbered, exact_dedup(seen), "keep_id", largest))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    least = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    return _keep(docs, "near-rows", lambda numbered, seen: _one_of_each(numbered, near_duplicates(seen)[0], "component_id", least))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _keep(docs, "clean-rows", lambda numbered, seen: find_contamination(seen, benchmark).where(~F.col("contaminated")).select(F.col("doc_id").alias("row")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences."""
    path, ranks = tokenizer_paths()
    return pack(docs, path, ranks)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
