"""Extract, transform, load: extractors give DataFrames, transformers are functions of DataFrames, loaders write.

A run is one lazy plan for each extractor; counts come from observations of that plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.text import NULL_TOKENS, clean, convert, lookup, parse_date
from ..storage import remove
from .documents import upsert

Transformer = Callable[[DataFrame], DataFrame]


def cleaning(types: dict[str, str] | None = None, tokens: tuple[str, ...] = NULL_TOKENS) -> Transformer:
    """Trims strings, makes null tokens null, casts the named columns (null on failure)."""

    def run(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        out = {c: clean(F.col(c), tokens) for c in df.columns if kinds[c] == "string"}
        for c, kind in (types or {}).items():
            if c in kinds:
                out[c] = convert(out.get(c, F.col(c).cast("string")), kind)
        return df.withColumns(out)

    return run


def normalization(mappings: dict[str, dict[str, str]]) -> Transformer:
    """Maps values of the named fields: exact, then in any case, else as they are."""

    def run(df: DataFrame) -> DataFrame:
        low = {f: {k.lower(): v for k, v in m.items()} for f, m in mappings.items()}
        return df.withColumns({f: F.coalesce(lookup(m, F.col(f)), lookup(low[f], F.lower(f)), F.col(f)) for f, m in mappings.items() if f in df.columns and m})

    return run


def validation(required: tuple[str, ...] = ("student_id", "university", "program"), strict: bool = False) -> Transformer:
    """Adds _validation_errors; strict drops rows that have any."""

    def run(df: DataFrame) -> DataFrame:
        number = lambda c: F.col(c).try_cast("double")
        tests = [F.when(F.col(c).isNull() if c in df.columns else F.lit(True), F.lit(f"missing {c}")) for c in required]
        tests += [F.when(~number(c).between(0, 100), F.lit(f"{c} out of range")) for c in df.columns if "gpa" in c.lower()]
        tests += [F.when(~number(c).between(2015, 2030), F.lit(f"{c} out of range")) for c in df.columns if "year" in c.lower()]
        if "outcome" in df.columns:
            tests.append(F.when(~F.lower("outcome").isin("admitted", "rejected", "waitlisted"), F.lit("invalid outcome")))
        if {"application_date", "decision_date"} <= set(df.columns):
            tests.append(F.when(F.col("decision_date") < F.col("application_date"), F.lit("decision before application")))
        out = df.withColumn("_validation_errors", F.array_compact(F.array(*tests)))
        return out.where(F.size("_validation_errors") == 0).drop("_validation_errors") if strict else out

    return run


def enrichment(rates: DataFrame | None = None, keys: tuple[str, ...] = ("university", "program"), date: str = "application_date") -> Transformer:
    """Joins historical rates by key and adds month and year of a date string."""

    def run(df: DataFrame) -> DataFrame:
        if rates is not None:
            df = df.join(rates, list(keys), "left")
        if date in df.columns:
            d = parse_date(F.col(date))
            df = df.withColumn(f"{date}_month", F.month(d)).withColumn(f"{date}_year", F.year(d))
        return df

    return run


class ParquetUpsert:
    """A keyed Parquet sink: a load merges new rows into the table and writes a new version beside the old one.

    Another sink on the same path goes on from its newest whole version; the one before stays for those who read it,
    older ones are removed."""

    def __init__(self, path: str, keys: list[str]):
        self.path, self.keys = path, keys

    def versions(self, spark) -> list[int]:
        """Numbers of the versions whose write came to its end."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/_SUCCESS")
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in found or [])

    def read(self, spark) -> DataFrame | None:
        found = self.versions(spark)
        return spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def load(self, df: DataFrame) -> None:
        spark = df.sparkSession
        old, found = self.read(spark), self.versions(spark)
        rows = df.dropna(subset=self.keys).dropDuplicates(self.keys)
        merged = rows if old is None else upsert(old, rows, self.keys)
        merged.write.mode("overwrite").parquet(f"{self.path}/v{(found or [0])[-1] + 1}")
        for k in found[:-1]:
            remove(spark, f"{self.path}/v{k}")

    def delete(self, spark, key: dict) -> None:
        """Writes a version without the rows of that key."""
        df, found = self.read(spark), self.versions(spark)
        if df is not None:
            hit = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items()])
            df.where(~hit).write.mode("overwrite").parquet(f"{self.path}/v{found[-1] + 1}")

    def exists(self, spark, key: dict) -> bool:
        df = self.read(spark)
        return df is not None and bool(df.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in key.items()])).limit(1).count())


class VectorSink:
    """Rows with a text of some columns and its vector, as Parquet."""

    def __init__(self, path: str, columns: list[str], encode):
        self.path, self.columns, self.encode = path, columns, encode

    def load(self, df: DataFrame) -> None:
        df.withColumn("vector", self.encode(F.concat_ws(" ", *self.columns))).write.mode("append").parquet(self.path)

    def exists(self, spark, key: dict) -> bool:
        """Whether a row of that key was loaded."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return False
        return bool(spark.read.parquet(self.path).where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in key.items()])).limit(1).count())


@dataclass
class Pipeline:
    extractors: list[Callable[[], DataFrame]] = field(default_factory=list)
    transformers: list[Transformer] = field(default_factory=list)
    loaders: list = field(default_factory=list)

    def add_extractor(self, e: Callable[[], DataFrame]) -> Pipeline:
        self.extractors.append(e)
        return self

    def add_transformer(self, t: Transformer) -> Pipeline:
        self.transformers.append(t)
        return self

    def add_loader(self, sink) -> Pipeline:
        self.loaders.append(sink)
        return self

    def validate(self) -> None:
        if not self.extractors or not self.loaders:
            raise ValueError("a pipeline needs an extractor and a loader")

    def run(self, since: tuple[str, str] | None = None, dry: bool = False) -> dict[str, int]:
        """Counts of rows extracted, loaded and invalid. `since` (column, ISO date) loads later rows only."""
        self.validate()
        stats = {"extracted": 0, "loaded": 0, "invalid": 0}
        for extract in self.extractors:
            seen, done = Observation(), Observation()
            rows = extract()
            if since:
                rows = rows.where(F.col(since[0]) >= F.lit(since[1]))
            rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
            rows = reduce(lambda d, t: d.transform(t), self.transformers, rows)
            bad = F.size("_validation_errors") > 0 if "_validation_errors" in rows.columns else F.lit(False)
            rows = rows.observe(done, F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
            if dry:
                rows.write.format("noop").mode("overwrite").save()
            for sink in [] if dry else self.loaders:
                sink.load(rows)
            stats["extracted"] += seen.get["n"]
            stats["loaded"] += done.get["n"] * (not dry)
            stats["invalid"] += done.get["bad"]
        return stats


def admission_pipeline(extract: Callable[[], DataFrame], sink, mappings: dict[str, dict[str, str]] | None = None, types: dict[str, str] | None = None, vectors: VectorSink | None = None) -> Pipeline:
    """Clean, normalise and validate applications into a sink (and a sink of vectors)."""
    out = Pipeline().add_extractor(extract).add_transformer(cleaning(types)).add_transformer(normalization(mappings or {})).add_transformer(validation())
    for s in [sink, *([vectors] if vectors else [])]:
        out.add_loader(s)
    return out


RECORD = ("student_id", "demographics", "academics", "applications", "metadata")


def record_of(documents: DataFrame) -> DataFrame:
    """The five fields of a student's record; a field that is missing or null has its empty value."""
    empty = {"student_id": "string", "demographics": "map<string,string>", "academics": "map<string,string>", "applications": "array<map<string,string>>", "metadata": "map<string,string>"}
    kinds = dict(documents.dtypes)
    zero = lambda c, k: F.lit("") if k == "string" else F.array().cast(k) if k.startswith("array") else F.from_json(F.lit("{}"), k)
    return documents.select(*[F.coalesce(F.col(c), zero(c, kinds[c])).alias(c) if c in kinds else zero(c, empty[c]).alias(c) for c in RECORD])


def document_of(records: DataFrame) -> DataFrame:
    """Records as documents of JSON (student_id, document)."""
    return records.select("student_id", F.to_json(F.struct(*RECORD)).alias("document"))


def clean_years(spark, raw: str, out: str, years: list[str], normalise: Callable[[DataFrame], DataFrame], name: str = "university", dry: bool = False) -> DataFrame:
    """Each year's CSV folder (raw/year) with a column `<name>_normalized` written to out/year; not in a dry run.
    Gives (year, loaded, matched); a year without a folder is not in it."""
    from ..sources.readers import is_file
    from ..sources.writers import write_csv

    rows = []
    for year in years:
        if not is_file(spark, f"{raw}/{year}"):
            continue
        seen = Observation()
        made = normalise(spark.read.options(header=True, escape='"').csv(f"{raw}/{year}")).withColumnRenamed("canonical", f"{name}_normalized")
        made = made.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col(f"{name}_normalized") != "INVALID").alias("hit"))
        if dry:
            made.write.format("noop").mode("overwrite").save()
        else:
            write_csv(made, f"{out}/{year}")
        rows.append((year, seen.get["n"], seen.get["hit"]))
    return spark.createDataFrame(rows, "year string, loaded bigint, matched bigint")
