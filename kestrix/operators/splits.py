"""Temporal splits: a fold and split label on rows, never index lists.

Row positions in time come from counts by day plus a number within the day, so no task sorts the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .windows import numbered, row_numbers


def temporal_split(df: DataFrame, date: str, train_end: str, val_end: str, test_end: str, gap_days: int = 0) -> DataFrame:
    """train up to train_end less the gap, val up to val_end, test up to test_end; null elsewhere."""
    d = F.col(date).cast("date")
    day = lambda s: F.lit(s).cast("date")
    label = F.when(d <= F.date_sub(day(train_end), gap_days), "train").when((d > day(train_end)) & (d <= day(val_end)), "val").when((d > day(val_end)) & (d <= day(test_end)), "test")
    return df.withColumn("split", label)


def positions(df: DataFrame, date: str, id: str) -> DataFrame:
    """Adds pos from 0 in the order of (date, id)."""
    return row_numbers(df, F.col(date).cast("date"), [F.col(date), F.col(id)]).withColumn("pos", F.col("rn") - 1).drop("rn")


def _folds(df: DataFrame, ranges: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Rows by fold from ranges (fold, train from, train to, val from, val to), ends left out."""
    made = None
    for fold, a, b, c, d in ranges:
        label = F.when((F.col("pos") >= a) & (F.col("pos") < b), "train").when((F.col("pos") >= c) & (F.col("pos") < d), "val")
        item = F.struct(F.lit(fold).alias("fold"), label.alias("split"))
        made = [item] if made is None else [*made, item]
    return df.withColumn("__f", F.explode(F.array(*made))).where("__f.split is not null").select(*df.columns, "__f.fold", "__f.split")


def expanding_cv(df: DataFrame, date: str, id: str, k: int = 5, gap: int = 0, least: int | None = None) -> DataFrame:
    """Fold i trains on the first m + i * v rows and validates on the v rows after a gap; v = n // (k + 1)."""
    n = df.count()
    v = n // (k + 1)
    m = least if least is not None else v
    return _folds(positions(df, date, id), [(i, 0, m + i * v, m + i * v + gap, min(n, m + i * v + gap + v)) for i in range(k)])


def sliding_cv(df: DataFrame, date: str, id: str, k: int = 5, gap: int = 0, width: int | None = None) -> DataFrame:
    """Fold i trains on `width` rows from i * v and validates on the v rows after a gap."""
    n = df.count()
    v = n // (k + 1)
    w = width or v
    return _folds(positions(df, date, id), [(i, i * v, i * v + w, i * v + w + gap, min(n, i * v + w + gap + v)) for i in range(k)])


def grouped_cv(df: DataFrame, date: str, group: str, k: int = 3) -> DataFrame:
    """Groups in the order of their first date (then name) are cut like rows in an expanding split."""
    first = df.groupBy(group).agg(F.min(date).alias("__first"))
    g = first.count()
    v = max(1, g // (k + 1))
    ranked = row_numbers(first, F.col("__first").cast("date"), [F.col("__first"), F.col(group)]).select(group, (F.col("rn") - 1).alias("pos"))
    joined = df.join(ranked, group)
    return _folds(joined, [(i, 0, v + i * v, v + i * v, v + i * v + v) for i in range(k)]).drop("pos")


def stratified_first(df: DataFrame, y: str, order: list[str], share: float = 0.2) -> DataFrame:
    """Of each class the first max(1, floor(n * share)) rows are test, but one at least stays in train."""
    n = df.groupBy(y).agg(F.count("*").alias("__n"))
    cut = F.least(F.greatest(F.lit(1), F.floor(F.col("__n") * share)), F.col("__n") - 1)
    return numbered(df, [F.col(c) for c in order], (y,), "__r").join(n, y).withColumn("split", F.when(F.col("__r") <= cut, "test").otherwise("train")).drop("__r", "__n")


def purged_kfold(df: DataFrame, date: str, id: str, k: int = 5, purge: int = 0, embargo: int = 0) -> DataFrame:
    """Contiguous folds; training leaves out `purge` rows before the fold and `embargo` rows after it."""
    n = df.count()
    size = n // k
    rows = positions(df, date, id)
    items = []
    for i in range(k):
        a, b = i * size, n if i == k - 1 else (i + 1) * size
        label = F.when((F.col("pos") >= a) & (F.col("pos") < b), "test").when((F.col("pos") < a - purge) | (F.col("pos") >= b + embargo), "train")
        items.append(F.struct(F.lit(i).alias("fold"), label.alias("split")))
    return rows.withColumn("__f", F.explode(F.array(*items))).where("__f.split is not null").select(*rows.columns, "__f.fold", "__f.split")


def train_test_cut(df: DataFrame, date: str, id: str, share: float = 0.2) -> DataFrame:
    cut = int(df.count() * (1 - share))
    return positions(df, date, id).withColumn("split", F.when(F.col("pos") < cut, "train").otherwise("test"))


def holdout_years(df: DataFrame, date: str, years: int = 1) -> DataFrame:
    """Train up to the last year less `years`, val after it."""
    last = df.agg(F.max(F.year(date)).alias("__y"))
    return df.crossJoin(F.broadcast(last)).withColumn("split", F.when(F.year(date) <= F.col("__y") - years, "train").otherwise("val")).drop("__y")


def leakage(df: DataFrame, date: str) -> DataFrame:
    """Of rows labelled train and test: whether their date ranges overlap, by how many rows and days."""
    d = F.col(date)
    ends = df.agg(F.min(F.when(F.col("split") == "test", d)).alias("t0"), F.max(F.when(F.col("split") == "train", d)).alias("t1"))
    both = df.crossJoin(F.broadcast(ends))
    late, early = (F.col("split") == "train") & (d >= F.col("t0")), (F.col("split") == "test") & (d <= F.col("t1"))
    return both.agg(F.coalesce(F.max(F.col("t1") >= F.col("t0")), F.lit(False)).alias("has_leakage"), F.count_if(late).alias("train_after"), F.count_if(early).alias("test_before"), F.greatest(F.lit(0), F.coalesce(F.datediff(F.max("t1"), F.max("t0")), F.lit(0))).alias("overlap_days"))


def fold_statistics(df: DataFrame, y: str) -> DataFrame:
    return df.groupBy("fold", "split").agg(F.count("*").alias("n"), F.sum(y).cast("bigint").alias("positives"))


def date_features(d: Column) -> dict[str, Column]:
    """year, month, day of year, and whether the month is in the season (9-12, 1, 3-5)."""
    return {"year": F.year(d), "month": F.month(d), "day_of_year": F.dayofyear(d), "in_season": F.month(d).isin(9, 10, 11, 12, 1, 3, 4, 5)}
