"""Feature encoders: a fit is one aggregate (a small table), a transform a join to it or an expression."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import lookup, parse_term
from .windows import numbered

# Letter grades on the unit scale.
LETTERS = {"a+": 0.97, "a": 0.93, "a-": 0.9, "b+": 0.87, "b": 0.83, "b-": 0.8, "c+": 0.77, "c": 0.73, "c-": 0.7, "d+": 0.67, "d": 0.63, "d-": 0.6, "f": 0.5}
FEW = 10_000
#: Largest value of a scale and what it is called.
SCALES = ((4.5, "four_point"), (7.0, "ib_course"), (45.0, "ib_total"))


def detect_scale(df: DataFrame, value: str) -> DataFrame:
    """letter, four_point, ib_course, ib_total or percentage, by the largest number."""
    top = F.max(F.col(value).try_cast("double"))
    out = F.when(top.isNull(), "letter")
    for most, name in SCALES:
        out = out.when(top <= most, name)
    return df.agg(out.otherwise("percentage").alias("scale"), top.alias("largest"))


def normalize_gpa(value: Column, scale: str) -> Column:
    """To [0, 1]: percent / 100, four-point / 4, IB (v - 1) / 44 or / 6, letters by table (0.5 if unknown)."""
    if scale == "letter":
        return lookup(LETTERS, F.lower(F.trim(value)), F.lit(0.5))
    v = value.cast("double")
    return {"percentage": v / 100, "four_point": v / 4, "ib_total": (v - 1) / 44, "ib_course": (v - 1) / 6}[scale]


def denormalize_gpa(value: Column, scale: str) -> Column:
    return {"percentage": value * 100, "four_point": value * 4, "ib_total": value * 44 + 1, "ib_course": value * 6 + 1}[scale]


def standardize(df: DataFrame, columns: list[str], kind: str = "standard") -> DataFrame:
    """z with the population deviation (1 where it is under 1e-10), or min-max; statistics in one aggregate."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in ((("m", F.avg), ("s", F.stddev_pop)) if kind == "standard" else (("m", F.min), ("s", lambda c: F.max(c) - F.min(c))))])
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*df.columns, *[((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") < 1e-10, 1.0).otherwise(F.col(f"__s_{c}"))).alias(f"{c}_scaled") for c in columns])


def inverse_standardize(value: Column, mean: float, deviation: float) -> Column:
    return value * deviation + mean


def fit_target(df: DataFrame, category: str, y: str, smoothing: float = 10.0) -> DataFrame:
    """By category the smoothed mean of y: (n * mean + m * global) / (n + m)."""
    by = df.groupBy(category).agg(F.count(y).alias("n"), F.avg(y).alias("mean"))
    every = df.agg(F.avg(y).alias("g"))
    return by.crossJoin(F.broadcast(every)).select(category, "n", ((F.col("n") * F.col("mean") + smoothing * F.col("g")) / (F.col("n") + smoothing)).alias("encoded"))


def transform_lookup(df: DataFrame, fitted: DataFrame, category: str, unknown: float | Column) -> DataFrame:
    """Join to a fitted table of categories; unknown ones take the given value. The table is broadcast by Spark where it is small."""
    other = unknown if isinstance(unknown, Column) else F.lit(float(unknown))
    return df.join(fitted.select(category, "encoded"), category, "left").withColumn("encoded", F.coalesce("encoded", other))


def leave_one_out(df: DataFrame, category: str, y: str, smoothing: float = 10.0) -> DataFrame:
    """((sum - y) + m * global) / (n - 1 + m); a category of one row takes the global mean.

    Sums come from a grouped aggregate joined back, so a hot category is no window of its own."""
    by = df.groupBy(category).agg(F.count(y).alias("__n"), F.sum(y).alias("__s"))
    every = df.agg(F.avg(y).alias("__g"))
    out = df.join(by, category).crossJoin(F.broadcast(every))
    value = F.when(F.col("__n") <= 1, F.col("__g")).otherwise((F.col("__s") - F.col(y) + smoothing * F.col("__g")) / (F.col("__n") - 1 + smoothing))
    return out.withColumn("encoded", value).drop("__n", "__s", "__g")


def fit_frequency(df: DataFrame, category: str, share: bool = True, least: float = 0.0) -> DataFrame:
    by = df.groupBy(category).agg(F.count("*").alias("n"))
    if not share:
        return by.select(category, F.greatest(F.col("n").cast("double"), F.lit(float(least))).alias("encoded"))
    every = df.agg(F.count("*").alias("total"))
    return by.crossJoin(F.broadcast(every)).select(category, F.greatest(F.col("n") / F.col("total"), F.lit(float(least))).alias("encoded"))


def fit_woe(df: DataFrame, category: str, y: str, add: float = 0.5) -> DataFrame:
    """Weight of evidence ln(share of positives / share of negatives), `add` to each count, and its part of the information value."""
    by = df.groupBy(category).agg((F.sum(y) + add).alias("pos"), (F.sum(1 - F.col(y)) + add).alias("neg"))
    every = by.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    dp, dn = F.col("pos") / F.col("n_pos"), F.col("neg") / F.col("n_neg")
    return by.crossJoin(F.broadcast(every)).select(category, F.log(dp / dn).alias("encoded"), ((dp - dn) * F.log(dp / dn)).alias("iv"))


def inverse_lookup(values: DataFrame, fitted: DataFrame, category: str, value: str) -> DataFrame:
    """The category whose code is nearest to each value (ties by name). A table of at most FEW categories is looked
    through row by row; beyond that distinct values meet the categories in blocks."""
    if fitted.limit(FEW + 1).count() > FEW:
        from ..functions.vectors import all_pairs

        pairs = all_pairs(values.select(F.col(value).alias("__v")).distinct(), fitted.select(F.col(category).cast("string").alias("__c"), "encoded"))
        near = pairs.groupBy("__v").agg(F.min_by("__c", F.struct(F.abs(F.col("encoded") - F.col("__v")), "__c")).alias(category))
        return values.join(near, F.col(value).eqNullSafe(F.col("__v")), "left").select(*values.columns, category)
    table = fitted.agg(F.sort_array(F.collect_list(F.struct(category, "encoded"))).alias("t"))
    near = F.aggregate("t", F.struct(F.lit(None).cast("string").alias("c"), F.lit(float("inf")).alias("d")), lambda a, x: F.when(F.abs(x["encoded"] - F.col(value)) < a["d"], F.struct(x[category].cast("string").alias("c"), F.abs(x["encoded"] - F.col(value)).alias("d"))).otherwise(a))
    return values.crossJoin(F.broadcast(table)).select(*values.columns, near["c"].alias(category))


def categories(df: DataFrame, category: str, most: int = 1000) -> list:
    """Sorted distinct values; more than `most` are no case for indicator columns."""
    found = sorted(r[0] for r in df.select(category).dropna().distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"{category} has more than {most} values")
    return found


def one_hot(df: DataFrame, category: str, values: list, drop: str | None = None) -> DataFrame:
    """An indicator column a value; `drop` leaves one out as the reference (dummy coding)."""
    return df.withColumns({f"{category}_{v}".replace(" ", "_"): F.coalesce(F.col(category) == F.lit(v), F.lit(False)).cast("double") for v in values if v != drop})


def ordinal(df: DataFrame, category: str, values: list) -> DataFrame:
    """The position of the value; null for an unknown one."""
    return df.withColumn(f"{category}_index", lookup({v: i for i, v in enumerate(values)}, F.col(category)))


def index_categories(df: DataFrame, category: str) -> DataFrame:
    """Sorted distinct values numbered from 0."""
    distinct = df.select(category).dropna().distinct()
    return numbered(distinct, [F.col(category)], name="__r").select(category, (F.col("__r") - 1).cast("int").alias("code"))


def term_cycle(raw: Column, terms: int = 4) -> tuple[Column, Column, Column]:
    """cos and sin of the term's place in the year, and the year."""
    index, year = parse_term(raw)
    angle = index * F.lit(2 * math.pi / terms)
    return F.cos(angle), F.sin(angle), year


def term_from_cycle(cos: Column, sin: Column, terms: int = 4) -> Column:
    return F.pmod(F.round(F.atan2(sin, cos) * F.lit(terms / (2 * math.pi))).cast("int"), F.lit(terms))


def date_cycle(d: Column, since: str = "2020-01-01") -> dict[str, Column]:
    """Cyclic month and day of year, days since a date, year, weekend flag."""
    month, day = F.month(d) - 1, F.dayofyear(d) - 1
    turn = lambda x, n: x * F.lit(2 * math.pi / n)
    return {"month_cos": F.cos(turn(month, 12)), "month_sin": F.sin(turn(month, 12)), "doy_cos": F.cos(turn(day, 365)), "doy_sin": F.sin(turn(day, 365)), "days_since": F.datediff(d, F.lit(since).cast("date")), "year": F.year(d), "is_weekend": F.weekday(d) >= 5}


def feature_names(kind: str, column: str, values: list | None = None) -> list[str]:
    """Names of the columns that an encoder of that kind makes; `values` are those of one-hot columns."""
    fixed = {"gpa": [f"{column}_scaled"], "target": [f"{column}_encoded"], "frequency": [f"{column}_frequency"], "woe": [f"{column}_woe"], "ordinal": [f"{column}_index"], "term": [f"{column}_cos", f"{column}_sin", f"{column}_year"], "date": [f"{column}_{k}" for k in ("month_cos", "month_sin", "doy_cos", "doy_sin", "days_since", "year", "is_weekend")]}
    if kind == "one_hot":
        return [f"{column}_{v}".replace(" ", "_") for v in values or []]
    return fixed[kind]


@dataclass
class Encoder:
    """An encoder of one column: fit makes a small table or statistics, transform adds its named columns."""

    kind: str
    column: str
    state: object = None

    def fit(self, df: DataFrame, y: str | None = None) -> Encoder:
        if self.kind == "gpa":
            row = df.agg(F.avg(F.col(self.column).cast("double")).alias("m"), F.stddev_pop(F.col(self.column).cast("double")).alias("s")).first()
            self.state = (row.m or 0.0, row.s if row.s and row.s >= 1e-10 else 1.0)
        elif self.kind in ("target", "woe"):
            if y is None:
                raise ValueError(f"a {self.kind} encoder needs a target")
            self.state = (fit_target if self.kind == "target" else fit_woe)(df, self.column, y)
        elif self.kind == "frequency":
            self.state = fit_frequency(df, self.column)
        elif self.kind in ("one_hot", "ordinal"):
            self.state = categories(df, self.column)
        elif self.kind not in ("term", "date"):
            raise ValueError(f"unknown encoder {self.kind}")
        return self

    def names(self) -> list[str]:
        return feature_names(self.kind, self.column, self.state if self.kind == "one_hot" else None)

    def transform(self, df: DataFrame) -> DataFrame:
        c = F.col(self.column)
        if self.kind == "term":
            return df.withColumns(dict(zip(self.names(), term_cycle(c))))
        if self.kind == "date":
            return df.withColumns(dict(zip(self.names(), date_cycle(c).values())))
        if self.state is None:
            raise ValueError("the encoder is not fitted")
        if self.kind == "gpa":
            return df.withColumn(self.names()[0], (c.cast("double") - self.state[0]) / self.state[1])
        if self.kind == "one_hot":
            return one_hot(df, self.column, self.state)
        if self.kind == "ordinal":
            return ordinal(df, self.column, self.state)
        return transform_lookup(df, self.state, self.column, 0.0).withColumnRenamed("encoded", self.names()[0])


@dataclass
class Composite:
    """Several encoders, fitted and applied one after the other; their columns stand side by side."""

    encoders: list[Encoder]

    def fit(self, df: DataFrame, y: str | None = None) -> Composite:
        for e in self.encoders:
            e.fit(df, y)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, e: e.transform(d), self.encoders, df)

    def names(self) -> list[str]:
        return [n for e in self.encoders for n in e.names()]


def admission_encoders() -> dict[str, Encoder]:
    """An encoder for each usual field of an application."""
    return {"grade": Encoder("gpa", "grade"), "university": Encoder("target", "university"), "program": Encoder("frequency", "program"), "term": Encoder("term", "term"), "decision_date": Encoder("date", "decision_date")}


def encode_admissions(df: DataFrame, y: str | None = None, encoders: dict[str, Encoder] | None = None) -> tuple[DataFrame, dict[str, Encoder]]:
    """The rows with the columns of each encoder whose field has a value: fitted here where none are given (the target
    encoder then leaves each row's own label out), else applied as they are. With the encoders."""
    fresh = encoders is None
    encoders = encoders or admission_encoders()
    here = [f for f in encoders if f in df.columns]
    full = df.agg(*[F.count(f).alias(f) for f in here]).first() if here else {}
    out = df
    used = {f: encoders[f] for f in here if full[f]}
    for e in used.values():
        if fresh:
            e.fit(df, y)
        if fresh and e.kind == "target":
            out = leave_one_out(out, e.column, y).withColumnRenamed("encoded", e.names()[0])
        else:
            out = e.transform(out)
    return out, used
