"""Quality: regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from sums over all labelled training rows; each covariance is
shrunk towards the pooled one and towards its own diagonal, factored once (Cholesky), and a score
is the Mahalanobis log-density difference of the two classes plus their log prior.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, documents, fold, pick

FEATURES = ("log_words", "mean_word", "distinct_share", "top_share", "upper_share", "digit_share", "symbol_share", "letter_share", "end_share", "lone_symbols", "symbol_runs", "line_words", "repeat_lines", "repeat_pairs", "char_entropy", "word_entropy")
_ASCII = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 white space, 5 usual punctuation, 6 other symbols; 7 beyond ASCII
_ASCII[33:127], _ASCII[128:] = 6, 7
for _kind, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"()-?"), 1):
    _ASCII[list(_set)] = _kind


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text; all zero without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.bincount(raw, minlength=256)
    kinds = np.bincount(_ASCII, weights=chars, minlength=8).astype(int)
    kind = _ASCII[raw]
    solid = max(1, int(len(raw) - kinds[4]))
    counts = Counter(words)
    freq = np.fromiter(counts.values(), float, len(counts)) / n
    lines = [x for x in text.split("\n") if x.strip()]
    letters = kinds[1] + kinds[2] + kinds[7]
    sentence = sum(map(text.count, (". ", ".\n", "? ", "! "))) + 1
    symbol = (kind == 5) | (kind == 6)
    runs = int((symbol[1:] & (raw[1:] == raw[:-1])).sum())  # symbols that repeat the one before
    first = np.flatnonzero((kind != 4) & np.concatenate([[True], kind[:-1] == 4]))
    lone = int((~np.logical_or.reduceat(~symbol & (kind > 0) & (kind != 4), first)).sum()) if len(first) else 0  # runs without letter or digit
    share = chars[chars > 0] / len(raw)
    pairs = len(set(zip(words, words[1:])))
    logit = lambda x: float(np.log((x + 0.005) / (1.005 - x)))
    return [
        float(np.log1p(n)),
        float(np.log(solid / n)),
        logit(len(counts) / n),
        logit(float(freq.max())),
        logit(min(1.0, kinds[1] / max(1, kinds[1] + kinds[2]))),
        logit(kinds[3] / solid),
        logit(kinds[6] / solid),
        logit(min(1.0, letters / solid)),
        float(np.log((sentence + 0.5) / (n + 1))),
        logit(min(1.0, lone / n)),
        logit(min(1.0, runs / solid)),
        float(np.log(n / max(1, len(lines)))),
        logit(1 - len(set(lines)) / max(1, len(lines))),
        logit(1 - pairs / max(1, n - 1)),
        float(-(share * np.log(share)).sum()),
        float(-(freq * np.log(freq)).sum() / np.log(n + 1.0)),
    ]


@dataclass
class Qda:
    """Means, cached Cholesky factors and log priors of both classes; None without one of them."""

    shrink: float = 0.1
    pool: float = 0.2
    parts: list | None = None
    base: float = 0.5

    def fit(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Qda:
        """sums: by class the count, the sum vector and the sum of outer products."""
        total = sum(n for n, *_ in sums.values())
        self.base = (sums[1][0] if 1 in sums else 0) / total if total else 0.5
        if len(sums) < 2:
            return self
        mean = {c: s / n for c, (n, s, _) in sums.items()}
        cov = {c: q / n - np.outer(mean[c], mean[c]) for c, (n, _, q) in sums.items()}
        pooled = sum(sums[c][0] * cov[c] for c in sums) / total
        self.parts = []
        for c in (0, 1):
            s = (1 - self.pool) * cov[c] + self.pool * pooled
            s = (1 - self.shrink) * s + self.shrink * np.diag(np.diag(s)) + 1e-4 * np.eye(len(s))
            low = np.linalg.cholesky(s)
            self.parts.append((mean[c], np.linalg.inv(low), float(np.log(np.diag(low)).sum()), float(np.log(sums[c][0] / total))))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.base)
        log0, log1 = (prior - half - 0.5 * (((x - m) @ inverse.T) ** 2).sum(axis=1) for m, inverse, half, prior in self.parts)
        return 1 / (1 + np.exp(np.clip(log0 - log1, -35, 35)))


def score_quality(docs: DataFrame, labels: DataFrame, y: str = "quality", folds: int = 4, held: int = 2, threshold: float = 0.7, shrink: float = 0.1, pool: float = 0.2) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted and the statistics (array).

    All labelled rows outside the held-out fold teach, by sums that each task makes of its rows.
    Null or empty text has all statistics 0 and is scored like any other. Labels repeated for an
    id: the largest counts. With labels of one class only, or none, all scores are its share (0.5
    without labels). Null ids are not held out; repeated rows each get their row."""
    ws = Workspace(docs.sparkSession, "quality")
    dim = len(FEATURES)

    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts])

    measured = ws.save(documents(docs).select("doc_id", F.pandas_udf(measure, "array<double>")("text").alias("statistics")), "statistics")
    taught = pick(labels, doc_id="bigint", **{y: "int"}).dropna().where(fold(F.col("doc_id"), folds) != held)
    taught = taught.where(F.col(y).isin(0, 1)).groupBy("doc_id").agg(F.max(y).alias("y"))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for rows in batches:
            for c, group in rows.groupby("y"):
                x = np.array(group["statistics"].tolist(), float)
                s = sums.setdefault(int(c), [0, np.zeros(dim), np.zeros((dim, dim))])
                s[0] += len(x)
                s[1] += x.sum(axis=0)
                s[2] += x.T @ x
        for c, (n, s, q) in sums.items():
            yield pd.DataFrame({"y": [c], "n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    parts = measured.join(taught, "doc_id").select("y", "statistics").mapInPandas(gather, "y int, n bigint, s array<double>, q array<double>")
    flat = parts.select("y", "n", F.posexplode(F.concat("s", "q")).alias("at", "v")).groupBy("y", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    sums: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for r in flat.collect():  # 2 classes x (dim + dim^2) numbers, whatever the input
        n, s, q = sums.get(r.y, (0, np.zeros(dim), np.zeros(dim * dim)))
        (s if r["at"] < dim else q)[r["at"] if r["at"] < dim else r["at"] - dim] = r.v
        sums[r.y] = (r.n, s, q)
    model = Qda(shrink, pool).fit({c: (n, s, q.reshape(dim, dim)) for c, (n, s, q) in sums.items()})

    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(rows.tolist(), float).reshape(-1, dim)))

    out = measured.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), F.pandas_udf(score, "double")("statistics").alias("score"), "statistics")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "statistics")
