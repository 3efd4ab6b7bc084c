"""A document-style query language compiled to DataFrame plans.

A collection is a DataFrame with nested columns. `find` and `aggregate` take filter documents and
stage lists; each stage becomes DataFrame operations, so Catalyst sees one plan. Stages and operators that
are not known raise, instead of being passed over.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T


def field_type(schema: T.DataType, path: str) -> T.DataType | None:
    """The type at a dotted path; None if missing. Paths go into structs and maps, not into arrays."""
    at: T.DataType | None = schema
    for name in path.split("."):
        if isinstance(at, T.StructType):
            at = at[name].dataType if name in at.names else None
        elif isinstance(at, T.MapType):
            at = at.valueType
        else:
            return None
    return at


def path_column(schema: T.DataType, path: str) -> Column:
    """The value at a dotted path; null where the schema has no such path."""
    if field_type(schema, path) is None:
        return F.lit(None)
    first, *rest = path.split(".")
    return reduce(lambda c, name: c[name], rest, F.col(f"`{first}`"))


_COMPARE = {
    "$ne": lambda a, b: ~a.eqNullSafe(b),
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
}


def _known(c: Column) -> Column:
    """Unknown counts as false: needed where a condition is negated or becomes a value. As a plain
    filter it is left alone, so that it can reach the scan."""
    return F.coalesce(c, F.lit(False))


def _condition(value: Column, want: Any) -> Column:
    if not isinstance(want, dict) or not any(k.startswith("$") for k in want):
        return value == F.lit(want) if want is not None else value.isNull()
    parts = []
    for op, operand in want.items():
        if op == "$elemMatch":
            parts.append(F.exists(value, lambda e: reduce(lambda a, b: a & b, [_condition(_inside(e, k), v) for k, v in operand.items()], F.lit(True))))
        elif op == "$eq":
            parts.append(_condition(value, operand))
        elif op in _COMPARE:
            parts.append(_COMPARE[op](value, F.lit(operand)))
        elif op in ("$in", "$nin"):
            found = value.isin(list(operand))
            parts.append(found if op == "$in" else ~_known(found))
        elif op == "$exists":
            parts.append(value.isNotNull() if operand else value.isNull())
        elif op == "$regex":
            parts.append(value.rlike(operand))
        elif op == "$not":
            parts.append(~_known(_condition(value, operand)))
        else:
            raise ValueError(f"unknown operator {op}")
    return reduce(lambda a, b: a & b, parts)


def _inside(element: Column, path: str) -> Column:
    return reduce(lambda c, name: c[name], path.split("."), element)


def match(schema: T.DataType, query: dict[str, Any] | None) -> Column:
    """A filter document as a condition; a missing path matches nothing."""
    out = F.lit(True)
    for key, want in (query or {}).items():
        if key in ("$and", "$or", "$nor"):
            parts = [match(schema, q) for q in want]
            joined = reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), parts)
            out = out & (~_known(joined) if key == "$nor" else joined)
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            out = out & _condition(path_column(schema, key), want)
    return out


def expression(schema: T.DataType, e: Any) -> Column:
    """An expression document: "$path", literals and operators."""
    if isinstance(e, str) and e.startswith("$"):
        return path_column(schema, e[1:])
    if not isinstance(e, dict):
        return F.lit(e)
    if len(e) != 1 or not next(iter(e)).startswith("$"):
        return F.struct(*[expression(schema, v).alias(k) for k, v in e.items()])
    (op, operand), go = next(iter(e.items())), lambda x: expression(schema, x)
    zero = lambda x: F.coalesce(go(x).cast("double"), F.lit(0.0))
    if op == "$cond":
        test, then, other = (operand["if"], operand["then"], operand["else"]) if isinstance(operand, dict) else operand
        return F.when(F.coalesce(go(test).cast("boolean"), F.lit(False)), go(then)).otherwise(go(other))
    if op == "$eq":
        return go(operand[0]).eqNullSafe(go(operand[1]))
    if op in _COMPARE:
        return _known(_COMPARE[op](go(operand[0]), go(operand[1])))
    if op == "$divide":
        return F.coalesce(F.try_divide(go(operand[0]).cast("double"), go(operand[1]).cast("double")), F.lit(0.0))
    if op == "$subtract":
        return zero(operand[0]) - zero(operand[1])
    if op in ("$add", "$multiply"):
        return reduce((lambda a, b: a + b) if op == "$add" else (lambda a, b: a * b), [zero(x) for x in operand])
    if op == "$sum":
        return reduce(lambda a, b: a + b, [zero(x) for x in operand]) if isinstance(operand, list) else go(operand)
    if op == "$ifNull":
        return F.coalesce(*[go(x) for x in operand])
    if op == "$concat":
        return F.concat(*[go(x).cast("string") for x in operand])
    if op in ("$and", "$or"):
        return reduce((lambda a, b: a & b) if op == "$and" else (lambda a, b: a | b), [F.coalesce(go(x).cast("boolean"), F.lit(False)) for x in operand])
    if op in ("$toLower", "$toUpper", "$abs", "$size", "$year", "$month"):
        return {"$toLower": F.lower, "$toUpper": F.upper, "$abs": F.abs, "$size": F.size, "$year": F.year, "$month": F.month}[op](go(operand))
    raise ValueError(f"unknown operator {op}")


_NUMERIC = (T.NumericType, T.BooleanType)


def _accumulator(schema: T.StructType, spec: dict[str, Any], order: list[str] | None) -> Column:
    (op, operand), *_ = spec.items()
    c = expression(schema, operand) if op != "$count" else None
    if op == "$count":
        return F.count(F.lit(1))
    if op in ("$sum", "$avg", "$min", "$max", "$stdDevPop"):
        if isinstance(operand, str) and operand.startswith("$"):  # what is not a number is passed over
            kind = field_type(schema, operand[1:])
            c = c.cast("double") if isinstance(kind, T.BooleanType) else c if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
        if op == "$sum":
            return F.coalesce(F.sum(c), F.lit(0))
        return F.coalesce({"$avg": F.avg, "$min": F.min, "$max": F.max, "$stdDevPop": F.stddev_pop}[op](c), F.lit(0))
    if op in ("$first", "$last"):
        if not order:
            raise ValueError(f"{op} needs an order: give aggregate(order=[...])")
        by = F.struct(*[F.col(x) for x in order])
        return (F.min_by if op == "$first" else F.max_by)(c, by)
    if op == "$push":
        return F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(x).alias(f"o{i}") for i, x in enumerate(order)], c.alias("v")))), lambda s: s["v"]) if order else F.sort_array(F.collect_list(c))
    if op == "$addToSet":
        return F.sort_array(F.collect_set(c))
    raise ValueError(f"unknown accumulator {op}")


def _sorted(df: DataFrame, keys) -> list[Column]:
    keys = keys.items() if isinstance(keys, dict) else keys
    return [path_column(df.schema, k).asc_nulls_first() if d > 0 else path_column(df.schema, k).desc_nulls_last() for k, d in keys]


def project(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """1 keeps, 0 leaves out, everything else is an expression. `_id` stays unless it is 0."""
    named = dict(spec)
    if "_id" in df.columns and "_id" not in named:
        named = {"_id": 1} | named
    if all(v == 0 for v in named.values()):
        return df.drop(*named)
    if named and all(v in (0, 1) and not isinstance(v, bool) for v in named.values() if not isinstance(v, (str, dict, list))) and any("." in k for k in named):
        return df.select(*_nested(df.schema, [k for k, v in named.items() if v]))
    return df.select(*[(path_column(df.schema, k) if v == 1 and not isinstance(v, (bool, float)) else expression(df.schema, v)).alias(k) for k, v in named.items() if not (v == 0 and isinstance(v, int))])


def _nested(schema: T.StructType, paths: list[str]) -> list[Column]:
    """Dotted paths rebuilt as nested structs."""
    tree: dict = {}
    for p in paths:
        at = tree
        for name in p.split("."):
            at = at.setdefault(name, {})

    def build(prefix: str, node: dict) -> Column:
        if not node:
            return path_column(schema, prefix)
        return F.struct(*[build(f"{prefix}.{k}", v).alias(k) for k, v in node.items()])

    return [build(k, v).alias(k) for k, v in tree.items()]


def unwind(df: DataFrame, path: str) -> DataFrame:
    """A row for each element, in place; rows with a missing, null or empty array go."""
    name = path.removeprefix("$")
    if not isinstance(field_type(df.schema, name), T.ArrayType):
        return df.where(F.lit(False))
    first, *rest = name.split(".")
    if not rest:
        return df.withColumn(first, F.explode(F.col(first)))
    return df.withColumn("__e", F.explode(path_column(df.schema, name))).withColumn(first, F.col(first).withField(".".join(rest), F.col("__e"))).drop("__e")


def group(df: DataFrame, spec: dict[str, Any], order: list[str] | None = None) -> DataFrame:
    """`_id`: null for one group of all, a path, a constant or a composite document."""
    spec = dict(spec)
    key = spec.pop("_id")
    aggs = [_accumulator(df.schema, v, order).alias(k) for k, v in spec.items()]
    if key is None:
        return df.agg(*aggs).select(F.lit(None).cast("string").alias("_id"), *spec)
    if isinstance(key, dict) and not (len(key) == 1 and next(iter(key)).startswith("$")):
        parts = {f"__k{i}": (k, expression(df.schema, v)) for i, (k, v) in enumerate(key.items())}
        out = df.groupBy(*[c.alias(n) for n, (_, c) in parts.items()]).agg(*aggs)
        return out.select(F.struct(*[F.col(n).alias(k) for n, (k, _) in parts.items()]).alias("_id"), *spec)
    return df.groupBy(expression(df.schema, key).alias("_id")).agg(*aggs)


def aggregate(df: DataFrame, stages: list[dict[str, Any]], order: list[str] | None = None, collections: dict[str, DataFrame] | None = None) -> DataFrame:
    """Compile a stage list. `order` names the columns that give rows their order ($first, $last, $push);
    `collections` are those that $lookup may name."""
    for stage in stages:
        if len(stage) != 1:
            raise ValueError(f"a stage has one operator: {stage}")
        ((op, spec),) = stage.items()
        if op == "$match":
            df = df.where(match(df.schema, spec))
        elif op == "$unwind":
            df = unwind(df, spec if isinstance(spec, str) else spec["path"])
        elif op == "$group":
            df = group(df, spec, order)
        elif op == "$project":
            df = project(df, spec)
        elif op == "$addFields":
            df = df.withColumns({k: expression(df.schema, v) for k, v in spec.items()})
        elif op == "$sort":
            df = df.orderBy(*_sorted(df, spec))
        elif op == "$limit":
            df = df.limit(int(spec))
        elif op == "$skip":
            df = df.offset(int(spec))
        elif op == "$count":
            df = df.agg(F.count(F.lit(1)).alias(spec))
        elif op == "$lookup":
            other = (collections or {})[spec["from"]]
            rows = other.groupBy(F.col(spec["foreignField"]).alias("__f")).agg(F.sort_array(F.collect_list(F.struct(*other.columns))).alias(spec["as"]))
            df = df.join(rows, path_column(df.schema, spec["localField"]) == F.col("__f"), "left").drop("__f")
        elif op == "$replaceRoot":
            df = df.select(expression(df.schema, spec["newRoot"]).alias("__r")).select("__r.*")
        else:
            raise ValueError(f"unknown stage {op}")
    return df


def find(df: DataFrame, query: dict[str, Any] | None = None, projection: dict[str, int] | None = None, sort: list[tuple[str, int]] | None = None, limit: int = 0) -> DataFrame:
    """Filter, then sort, then limit (0: none), then projection."""
    out = df.where(match(df.schema, query))
    if sort:
        out = out.orderBy(*_sorted(out, sort))
    if limit:
        out = out.limit(limit)
    return project(out, projection) if projection else out


def find_one(df: DataFrame, query: dict[str, Any], projection: dict[str, int] | None = None) -> DataFrame:
    return find(df, query, projection, limit=1)


def count_documents(df: DataFrame, query: dict[str, Any] | None = None) -> DataFrame:
    return df.where(match(df.schema, query)).agg(F.count(F.lit(1)).alias("n"))


def application_query(university: str | None = None, program: str | None = None, outcome: str | None = None, year: int | None = None, province: str | None = None) -> dict[str, Any]:
    """A filter document for nested applications; the year is a real range of ISO dates."""
    inside: dict[str, Any] = {k: v for k, v in {"university": university, "program": program, "outcome": outcome}.items() if v is not None}
    if year is not None:
        inside["application_date"] = {"$gte": f"{year}-01-01", "$lte": f"{year}-12-31"}
    out: dict[str, Any] = {"applications": {"$elemMatch": inside}} if inside else {}
    return out | ({"demographics.province": province} if province is not None else {})


# Mutations: each gives the collection as it is afterwards.


def set_fields(df: DataFrame, condition: Column, values: dict[str, Any]) -> DataFrame:
    """`$set` of dotted paths where the condition holds."""
    for path, value in values.items():
        first, *rest = path.split(".")
        new = F.lit(value) if not isinstance(value, Column) else value
        whole = F.col(first).withField(".".join(rest), new) if rest else new
        old = F.col(first) if first in df.columns else F.lit(None)
        df = df.withColumn(first, F.when(condition, whole).otherwise(old))
    return df


def update_many(df: DataFrame, query: dict[str, Any], update: dict[str, Any]) -> DataFrame:
    """`$set`, `$inc` and `$unset` on all that match."""
    hit = match(df.schema, query)
    df = df.withColumn("__hit", hit)
    values = dict(update.get("$set", {})) | {k: path_column(df.schema, k) + F.lit(v) for k, v in update.get("$inc", {}).items()}
    if unknown := set(update) - {"$set", "$inc", "$unset"}:
        raise ValueError(f"unknown update {sorted(unknown)}")
    values |= {k: None for k in update.get("$unset", {})}
    return set_fields(df, F.col("__hit"), values).drop("__hit")


def update_one(df: DataFrame, query: dict[str, Any], update: dict[str, Any], order: list[str]) -> DataFrame:
    """The first match in the given order (whose columns identify a row)."""
    first = df.where(match(df.schema, query)).orderBy(*order).limit(1).select(*[F.col(c).alias(f"__{c}") for c in order])
    hit = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in order])
    marked = df.join(F.broadcast(first), hit, "left").withColumn("__hit", F.col(f"__{order[0]}").isNotNull()).drop(*[f"__{c}" for c in order])
    return set_fields(marked, F.col("__hit"), update["$set"]).drop("__hit")


def delete_many(df: DataFrame, query: dict[str, Any]) -> DataFrame:
    return df.where(~_known(match(df.schema, query)))


def insert_many(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Merge by key: new keys are added, known ones replaced; of several rows with a key the last by
    `order` counts. Rows without a key are left out."""
    rows = rows.dropna(subset=keys)
    if order is not None:
        rest = [c for c in rows.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def upsert_counts(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """inserted, updated and errors (rows without a key) that an upsert makes."""
    known = target.select(*keys, F.lit(1).alias("__known")).distinct()
    bad = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return rows.join(known, keys, "left").agg(F.count_if(~bad & F.col("__known").isNull()).alias("inserted"), F.count_if(F.col("__known").isNotNull()).alias("updated"), F.count_if(bad).alias("errors"))
