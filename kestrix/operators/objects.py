"""A store of objects with properties and a vector: classes with a schema, objects by id, search.

A class is a versioned Parquet table, so a change writes a new version and readers of the old one go on."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import remove
from .etl import ParquetUpsert
from .vectorstore import equals, search, within

# Property kinds and the two classes' properties.
KINDS = {"text": "string", "number": "double", "int": "bigint", "boolean": "boolean", "text[]": "array<string>"}
PROGRAM = {"name": "text", "university": "text", "faculty": "text", "province": "text", "min_average": "number", "acceptance_rate": "number", "competitiveness": "number", "description": "text"}
STUDENT = {"student_id": "text", "gpa": "number", "province": "text", "interests": "text[]"}


def program_schema(dim: int = 128) -> dict:
    return {"class": "Program", "properties": dict(PROGRAM), "dim": dim}


def student_schema(dim: int = 128) -> dict:
    return {"class": "Student", "properties": dict(STUDENT), "dim": dim}


class ObjectStore:
    """Classes of objects under a path. Objects have id (string), their properties and a vector of the class's size."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.connected = spark, path, False

    def connect(self) -> ObjectStore:
        self.connected = True
        return self

    def disconnect(self) -> None:
        self.connected = False

    def is_ready(self) -> bool:
        return self.connected

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    # classes

    def create_schema(self, schema: dict) -> None:
        if self.class_exists(schema["class"]):
            raise ValueError(f"class {schema['class']} exists")
        unknown = {k for k in schema["properties"].values() if k not in KINDS}
        if unknown:
            raise ValueError(f"unknown kinds {sorted(unknown)}")
        self.spark.createDataFrame([(json.dumps(schema),)], "schema string").coalesce(1).write.parquet(f"{self.path}/{schema['class']}/schema")

    def class_exists(self, name: str) -> bool:
        where, fs = self._at(f"{self.path}/{name}/schema/_SUCCESS")
        return fs.exists(where)

    def get_schema(self, name: str | None = None) -> dict | list[dict]:
        """A class's schema, or all of them by name."""
        if name is not None:
            if not self.class_exists(name):
                raise KeyError(name)
            return json.loads(self.spark.read.parquet(f"{self.path}/{name}/schema").first()[0])
        where, fs = self._at(f"{self.path}/*/schema/_SUCCESS")
        return [self.get_schema(f.getPath().getParent().getParent().getName()) for f in sorted(fs.globStatus(where) or [], key=str)]

    def delete_schema(self, name: str) -> None:
        remove(self.spark, f"{self.path}/{name}")

    def _table(self, name: str) -> tuple[ParquetUpsert, str]:
        kinds = ", ".join(f"`{k}` {KINDS[v]}" for k, v in self.get_schema(name)["properties"].items())
        return ParquetUpsert(f"{self.path}/{name}/objects", ["id"]), f"id string, {kinds}, vector array<double>"

    # objects

    def objects(self, name: str) -> DataFrame:
        sink, kind = self._table(name)
        found = sink.read(self.spark)
        return self.spark.createDataFrame([], kind) if found is None else found

    def add_objects(self, name: str, rows: DataFrame) -> int:
        """Adds objects, or replaces those of the same id; missing properties are null. Gives their number.
        A vector of another size than the class's is an error of the job."""
        sink, kind = self._table(name)
        dim = self.get_schema(name)["dim"]
        columns = [c.split()[0].strip("`") for c in kind.split(", ")]
        kinds = dict(zip(columns, (c.split()[1] for c in kind.split(", "))))
        made = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
        size = F.size("vector")
        fits = F.when(F.col("vector").isNull() | (size == dim), F.col("vector")).otherwise(F.raise_error(F.lit(f"vectors of {name} have {dim} numbers")).cast("array<double>"))
        before = self.objects(name).select("id")
        sink.load(made.withColumn("vector", fits))
        return self.objects(name).join(before, "id", "left_anti").count()

    def add_object(self, name: str, properties: dict, vector: list[float] | None, id: str) -> str:
        sink, kind = self._table(name)
        self.add_objects(name, self.spark.createDataFrame([{**properties, "id": id, "vector": vector}], kind))
        return id

    def get_object(self, name: str, id: str) -> dict | None:
        row = self.objects(name).where(F.col("id") == id).first()
        return None if row is None else row.asDict(True)

    def update_object(self, name: str, id: str, properties: dict, vector: list[float] | None = None) -> bool:
        """Sets the given properties (and vector) of an object; False if there is none."""
        old = self.get_object(name, id)
        if old is None:
            return False
        new = old | properties | ({"vector": vector} if vector is not None else {})
        self.add_object(name, {k: v for k, v in new.items() if k not in ("id", "vector")}, new["vector"], id)
        return True

    def delete_object(self, name: str, id: str) -> bool:
        if self.get_object(name, id) is None:
            return False
        self._table(name)[0].delete(self.spark, {"id": id})
        return True

    # search

    def find_matching_students(self, vector: list[float], limit: int = 10, min_gpa: float | None = None, max_gpa: float | None = None) -> DataFrame:
        return find_matching_students(self.objects("Student"), vector, limit, min_gpa, max_gpa)

    def recommend_programs(self, vector: list[float], province: str | None = None, limit: int = 10) -> DataFrame:
        return recommend_programs(self.objects("Program"), vector, province, limit)


def find_matching_students(students: DataFrame, vector: list[float], limit: int = 10, min_gpa: float | None = None, max_gpa: float | None = None) -> DataFrame:
    """The nearest students by cosine whose gpa is in the closed range."""
    return search(students, vector, limit, within("gpa", min_gpa, max_gpa))


def recommend_programs(programs: DataFrame, vector: list[float], province: str | None = None, limit: int = 10) -> DataFrame:
    """The nearest programs by cosine, of a province where one is given."""
    return search(programs, vector, limit, equals({"province": province}) if province else None)
