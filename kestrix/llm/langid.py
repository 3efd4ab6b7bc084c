"""Language ID by hierarchical discrimination.

First a language family is predicted from hashed character n-grams (multinomial log-likelihoods by
family); then one-versus-one linear support vector machines separate the languages of that family.
Fitted on a bounded sample of documents (`max_train`, shared out evenly by language); every
document is scored, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import Workspace, documents, fold, pick

# Family of a language code; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tk uz",
    "indic": "bn gu hi mr ne pa si ur",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LATIN = re.compile("[A-Za-z]")
UND = "und"


def lettered(text: str) -> bool:
    """Whether any character is a letter (Unicode category L; numerals such as \u00b2 or \u2167 are none)."""
    return bool(_LATIN.search(text)) or not text.isascii() and any(map(str.isalpha, text))


def vector(text: str, dim: int) -> np.ndarray:
    """Hashed counts of byte bigrams, trigrams and 4-grams of the lower-cased letters and spaces of a whole text, square-rooted and of unit length."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    raw = raw[((raw >= 97) & (raw <= 122)) | (raw >= 128) | (raw == 32)].astype(np.uint32)
    out = np.zeros(dim, np.float32)
    if len(raw) < 2:
        return out
    bits = np.uint32(32 - int(dim).bit_length() + 1)
    gram = raw[:-1] * np.uint32(257) + raw[1:]
    for k in (2, 3, 4):
        out += np.bincount((gram * np.uint32(2654435761) + np.uint32(k)) >> bits, minlength=dim)
        if len(gram) < 2 or k == 4:
            break
        gram = gram[:-1] * np.uint32(257) + raw[k:]
    out = np.sqrt(out)
    return out / max(float(np.linalg.norm(out)), 1e-9)


class Model:
    """Family log-likelihood weights and, by family, a hyperplane for each pair of its languages.

    x may be of halves: rows become floats a batch at a time."""

    def __init__(self, x: np.ndarray, y: list[str], epochs: int = 12, lam: float = 1e-3):
        self.langs = sorted(set(y))
        lang = np.array([self.langs.index(v) for v in y], int)
        names = [FAMILY.get(v, v) for v in self.langs]
        self.families = sorted(set(names))
        self.members = {f: [i for i, n in enumerate(names) if n == f] for f in self.families}
        family = np.array([self.families.index(names[i]) for i in lang], int)
        self.bayes = np.zeros((len(self.families), x.shape[1]), np.float32)
        for f in range(len(self.families)):
            rows = np.flatnonzero(family == f)
            mass = sum((x[rows[k : k + 256]].astype(np.float32) ** 2).sum(axis=0) for k in range(0, len(rows), 256)) + 1e-3
            self.bayes[f] = np.log(mass / mass.sum())
        self.planes = {(a, b): self._svm(x, lang, a, b, epochs, lam) for m in self.members.values() for a, b in combinations(m, 2)}

    @staticmethod
    def _svm(x: np.ndarray, lang: np.ndarray, a: int, b: int, epochs: int, lam: float) -> tuple[np.ndarray, float]:
        """Pegasos with averaging over small batches; the order is fixed, so fits repeat."""
        at = np.flatnonzero((lang == a) | (lang == b))
        sign = np.where(lang[at] == a, 1.0, -1.0).astype(np.float32)
        w, bias, mean_w, mean_b, t = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0, 0
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            order = rng.permutation(len(at))
            for k in range(0, len(order), 16):
                t += 1
                rows = order[k : k + 16]
                part = x[at[rows]].astype(np.float32)
                bad = sign[rows] * (part @ w + bias) < 1
                rate = 1 / (lam * (t + 100))
                w *= 1 - rate * lam
                if bad.any():
                    w += (rate / len(rows)) * (sign[rows[bad]] @ part[bad])
                    bias += 0.01 * rate / len(rows) * float(sign[rows[bad]].sum())
                mean_w += (w - mean_w) / t
                mean_b += (bias - mean_b) / t
        return mean_w, mean_b

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UND, 0.0)] * len(x)
        mass = x**2
        logs = mass @ self.bayes.T * 60
        prob = np.exp(logs - logs.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        out: list[tuple[str, float]] = [(UND, 0.0)] * len(x)
        best = prob.argmax(axis=1)
        for f, name in enumerate(self.families):
            rows, own = np.flatnonzero(best == f), self.members[name]
            if not len(rows):
                continue
            votes, sure = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for i, j in combinations(range(len(own)), 2):
                w, bias = self.planes[own[i], own[j]]
                p = 1 / (1 + np.exp(-np.clip(4 * (x[rows] @ w + bias), -30, 30)))
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                sure[:, i] += p
                sure[:, j] += 1 - p
            pairs = max(1, len(own) - 1)
            top = (votes + sure / (pairs + 1)).argmax(axis=1)
            for r, row in enumerate(rows):
                out[row] = (self.langs[own[top[r]]], float(prob[row, f] * (sure[r, top[r]] / pairs if len(own) > 1 else 1.0)))
        return out


def train(docs: DataFrame, folds: int = 4, held: int = 2, max_train: int = 6000, dim: int = 4096) -> Model:
    """Fit on at most `max_train` documents outside the held-out fold, evenly by language (the
    smallest reduced id hashes of each; of more languages than that, a document each of the most frequent).
    Null texts, texts without letters, null languages teach nothing; of rows that repeat an id one does."""
    taught = pick(docs, doc_id="bigint", lang="string").dropna().where(fold(F.col("doc_id"), folds) != held).where(F.col("lang") != UND)
    counts = taught.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_train)
    share = max(1, max_train // max(1, counts.count()))
    # by hash, each language is first thinned to some 1.5 shares: what meets in its window does not grow with the table
    draw = F.xxhash64("doc_id")
    part = counts.select("lang", F.least(F.lit(1.0), F.lit(1.5 * share + 200) / F.col("count")).alias("part"))
    thin = taught.join(F.broadcast(part), "lang").where(F.pmod(draw, F.lit(1 << 20)) < F.col("part") * (1 << 20))
    order = [F.pmod(draw, F.lit(1 << 20)), draw, F.col("doc_id")]
    sample = thin.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("k") <= share)
    sample = sample.groupBy("doc_id").agg(F.max("lang").alias("y")).orderBy(*order).limit(max_train)

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([vector(t, dim).astype(np.float16).tobytes() if lettered(t) else b"" for t in texts])

    # at most max_train rows of two values are broadcast, here as above; made by all tasks at once, then read a row at a time
    found = documents(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "y", F.pandas_udf(extract, "binary")("text").alias("x"))
    ws = Workspace(docs.sparkSession, "langid")
    stored = ws.save(found.groupBy("doc_id", "y").agg(F.max("x").alias("x")), "sample")
    x, keys = np.zeros((max_train, dim), np.float16), []
    for r in stored.where(F.octet_length("x") > 0).toLocalIterator():
        x[len(keys)] = np.frombuffer(r.x, np.float16)
        keys.append((r.doc_id, r.y))
    ws.drop()
    rows = sorted(range(len(keys)), key=keys.__getitem__)
    return Model(x[rows], [keys[k][1] for k in rows])


def predictor(docs: DataFrame, folds: int = 4, held: int = 2, max_train: int = 6000, dim: int = 4096):
    """A column function of a text: struct(lang_pred, score, lettered), from a model fitted on docs. A
    text without letters is never told; one with letters is `und` only where nothing can be learned."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, folds, held, max_train, dim))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out: list[tuple[str, float, bool]] = []
            for k in range(0, len(texts), 256):
                part = texts.iloc[k : k + 256].fillna("")
                got = model.value.predict(np.array([vector(t, dim) for t in part]))
                out += [(*g, True) if ok else (UND, 0.0, False) for g, ok in zip(got, map(lettered, part))]
            yield pd.DataFrame(out, columns=["lang_pred", "score", "lettered"])

    # taken for deterministic, a filter on one field would be pushed below and run the model a second time
    return F.pandas_udf(run, "lang_pred string, score double, lettered boolean").asNondeterministic()


def identify_language(docs: DataFrame, folds: int = 4, held: int = 2, max_train: int = 6000, dim: int = 4096) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Null or empty texts and texts without letters: `und`, score 0; so are all without a row to
    learn from. Score: share of the family times the mean margin probability of the winner in its
    pairs. Null ids are not held out."""
    predict = predictor(docs, folds, held, max_train, dim)
    rows = documents(docs).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), predict("text").alias("r"))
    return rows.select("doc_id", "held_out", "r.lang_pred", "r.score")
