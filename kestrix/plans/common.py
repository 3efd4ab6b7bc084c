"""Tables, shared views and the registry of a query family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Family:
    """Queries of a family with the SQL that tells the same (none where SQL cannot)."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison (never -0.0), under the column's own name if given by name."""
    return (F.round(F.col(c), digits) + 0.0).alias(c) if isinstance(c, str) else F.round(c, digits) + 0.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded."""
    return df.select(*[r(c, digits) if t == "double" else F.col(c) for c, t in df.dtypes])


#: Applications: a part's brand and type as university and program, return flag as decision.
APP = """app AS (
  SELECT l_orderkey AS id, p_brand AS university, p_type AS program, l_quantity * 2 AS grade,
    CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Rejected' ELSE 'Waitlisted' END AS decision,
    CAST(year(l_shipdate) AS INTEGER) AS cycle_year, CAST(month(l_shipdate) AS INTEGER) AS decision_month,
    l_linestatus AS applicant, l_discount, l_tax
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("university"), F.col("p_type").alias("program"), (F.col("l_quantity") * 2).alias("grade"), F.when(flag == "A", "Accepted").when(flag == "R", "Rejected").otherwise("Waitlisted").alias("decision"), F.year("l_shipdate").alias("cycle_year"), F.month("l_shipdate").alias("decision_month"), F.col("l_linestatus").alias("applicant"), "l_discount", "l_tax")


#: Labelled scores of orders: one tie or so; of lineitems: 11 values.
PRED = "pred AS (SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice / 500000 AS p, o_orderpriority AS grp FROM orders)"
TIES = "pred AS (SELECT l_orderkey AS id, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_discount * 10 AS p FROM lineitem)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 500000).alias("p"), F.col("o_orderpriority").alias("grp"))


def tied_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"))
