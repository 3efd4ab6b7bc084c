"""Lexical retrieval packing: documents into sequences of a fixed number of tokens.

Full windows of a long document are sequences of their own. What is left of each document is
dealt to shards of bounded size by a MinHash of its tokens, so like documents meet. Each shard
has a BM25 inverted index (document frequencies are those of all documents): for a seed, it
returns the unused neighbours, which greedily fill the seed's window; then the largest unused
piece that fits is taken, and a gap that is worth it is filled by cutting a neighbour.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from copy import copy
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, documents


@lru_cache(2)
def _encoder(path: str, ranks: str | None):
    """A function from texts to lists of ids.

    The tokenizer file at `path` is the standard. Where a rank file of the same vocabulary is given,
    the faster library encodes, and only texts that spell a special token go to the standard one."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    standard = Tokenizer.from_file(path)
    slow = lambda text: standard.encode(text, add_special_tokens=False).ids
    if ranks is None:
        return slow
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in standard.get_added_tokens_decoder().values()]
    return lambda text: slow(text) if any(s in text for s in special) else fast.encode_ordinary(text)


def tokenize(docs: DataFrame, path: str, ranks: str | None, size: int, end_id: int, ws: Workspace) -> DataFrame:
    """A stored table of pieces: their number (piece), doc_id, start, length, ids_crc32, doc_tokens and, for a window that is not
    full, its ids (binary, 32 bits each) and `sign`, the id with the least hash; full windows have a sequence id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, windows = _encoder(path, ranks), TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*encode(text), end_id], np.uint32)
                full = len(ids) // size * size
                for start in range(0, full, size):
                    out.append((doc_id, start, size, crc32(ids[start : start + size].astype("<u4").tobytes()), len(ids), (((part << 31) + windows) << 1) + 1, None, None))
                    windows += 1
                if rest := len(ids) - full:
                    raw = ids[full:].astype("<u4").tobytes()
                    sign = int(ids[full:][np.argmin(ids[full:] * np.uint32(2654435761))])
                    out.append((doc_id, full, rest, crc32(raw), len(ids), None, raw, sign))
            frame = pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "ids", "sign"])
            yield frame.astype({"sequence_id": "Int64", "sign": "Int64"})

    rows = documents(docs).select(F.col("doc_id").cast("string"), "text")  # pandas would make ids with nulls floats
    made = rows.mapInPandas(run, "id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, ids binary, sign bigint")
    return ws.save(made.withColumn("doc_id", F.col("id").cast("bigint")).drop("id").withColumn("piece", F.monotonically_increasing_id()), "pieces")


def _document_frequencies(rest: DataFrame) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Tokens, in how many pieces each occurs, the number of pieces and their mean length. At most
    one number for each entry of the vocabulary from a task, and in all."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw in batch["ids"]:
                found = np.frombuffer(raw, np.uint32)
                if found.max() >= len(total):
                    total = np.pad(total, (0, int(found.max()) + 1 - len(total)))
                seen = np.zeros(int(found.max()) + 1, bool)
                seen[found] = True
                total[: len(seen)] += seen
        some = np.flatnonzero(total)
        yield pd.DataFrame({"token": some, "df": total[some]})

    rows = rest.select("ids").mapInPandas(count, "token bigint, df bigint").groupBy("token").agg(F.sum("df").alias("df")).collect()
    n, mean = rest.agg(F.count("*"), F.avg("length")).first()
    return np.array([r.token for r in rows], np.int64), np.array([r["df"] for r in rows], np.int64), n, float(mean or 1.0)


def _shards(rest: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """By sign (one entry of the vocabulary): its first shard and how many it is spread over."""
    rows = sorted(rest.groupBy("sign").agg(F.count("*").alias("n")).collect())
    signs, first, spread, shard, room = [], [], [], 0, most
    for sign, n in rows:
        wide = -(-n // most)
        if n > room:
            shard, room = shard + (room < most), most
        signs.append(sign)
        first.append(shard)
        spread.append(wide)
        if wide > 1:
            shard += wide
        else:
            room -= n
    return np.array(signs, np.int64), np.array(first, np.int64), np.array(spread, np.int64), shard + 1


class Index:
    """The BM25 inverted index of one shard's pieces: by token, pieces and their weights. Postings of a token
    that a quarter of the pieces have are a row of weights of all pieces instead."""

    def __init__(self, pieces: list[np.ndarray], idf: dict[int, float], mean: float, k1: float = 1.2, b: float = 0.75):
        self.terms, own, weight = [], [], []
        for ids in pieces:
            t, tf = np.unique(ids, return_counts=True)
            w = np.array([idf[x] for x in t.tolist()])
            self.terms.append((t, w))
            own.append(t)
            weight.append(w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ids) / mean)))
        flat = np.concatenate(own)
        docs = np.repeat(np.arange(len(pieces)), [len(t) for t in own])
        order = np.argsort(flat, kind="stable")
        self.docs, self.weights = docs[order], np.concatenate(weight)[order]
        self.tokens, self.begins = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.begins[1:], len(flat))
        self.n = len(pieces)
        common = np.flatnonzero(4 * (self.ends - self.begins) >= self.n)
        self.row = np.full(len(self.tokens), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n))
        for r, k in enumerate(common):
            self.dense[r, self.docs[self.begins[k] : self.ends[k]]] = self.weights[self.begins[k] : self.ends[k]]

    def neighbours(self, piece: int, terms: int | None = None, top: int | None = None, unused: np.ndarray | None = None) -> np.ndarray:
        """Pieces (of `unused`, where given) by falling BM25 score for the query of the piece's tokens (the
        `terms` rarest, where given), the first `top` or all of them; ties by number."""
        t, w = self.terms[piece]
        if terms is not None and len(t) > terms:
            t = t[np.argsort(-w, kind="stable")[:terms]]
        at = np.searchsorted(self.tokens, t)
        row = self.row[at]
        scores = self.dense[row[row >= 0]].sum(axis=0)
        at = at[row < 0]
        sizes = self.ends[at] - self.begins[at]
        if total := int(sizes.sum()):
            k = np.arange(total) + np.repeat(self.begins[at] - np.cumsum(sizes) + sizes, sizes)
            scores += np.bincount(self.docs[k], self.weights[k], minlength=self.n)
        found = np.flatnonzero(scores if unused is None else (scores > 0) & unused)
        return found[np.argsort(-scores[found], kind="stable")][:top]

    def without_used(self, unused: np.ndarray) -> Index:
        """The index with the postings of `unused` pieces alone."""
        out = copy(self)
        keep = unused[self.docs]
        before = np.append(0, np.cumsum(keep))
        out.docs, out.weights, out.begins, out.ends = self.docs[keep], self.weights[keep], before[self.begins], before[self.ends]
        return out


def fill(pieces: list[np.ndarray], index: Index, size: int, terms: int | None = None, top: int | None = None, least: int = 32) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece, first token in it, tokens); every token lies in exactly one.

    Seeds go by falling length; all unused neighbours of a seed are tried in their order. A gap under
    `least` tokens is left as padding."""
    rest = {k: (0, len(p)) for k, p in enumerate(pieces)}  # unused part of each piece
    sizes = sorted((len(p), k) for k, p in enumerate(pieces))  # of whole unused parts
    left = np.array([len(p) for p in pieces], np.int64)  # tokens of each unused part
    indexed = len(pieces)
    out = []

    def take(k: int, n: int) -> tuple[int, int, int]:
        first, last = rest.pop(k)
        del sizes[bisect_right(sizes, (last - first, k)) - 1]
        left[k] = last - first - n
        if first + n < last:
            rest[k] = (first + n, last)
            insort(sizes, (last - first - n, k))
        return k, first, n

    while sizes:
        seed = sizes[-1][1]
        room = size - sizes[-1][0]
        row = [take(seed, sizes[-1][0])]
        near = np.empty(0, np.int64)
        if room >= least and sizes:
            if 2 * len(rest) < indexed:
                index, indexed = index.without_used(left > 0), len(rest)
            near = index.neighbours(seed, terms, top, left > 0)
            fits = near[left[near] <= room]
            while len(fits):
                n = int(left[fits[0]])
                row.append(take(int(fits[0]), n))
                room -= n
                fits = fits[1:][left[fits[1:]] <= room]
        while room and sizes:
            at = bisect_right(sizes, (room, len(pieces))) - 1
            if at < 0:
                break
            n, k = sizes[at]
            row.append(take(k, n))
            room -= n
        if room >= least and sizes:  # nothing whole fits any more: the best unused neighbour is cut
            whole = near[left[near] > 0]
            row.append(take(int(whole[0]) if len(whole) else sizes[0][1], room))
        out.append(row)
    return out


def pack(docs: DataFrame, path: str, ranks: str | None = None, size: int = 2048, end_id: int = 1, shard_pieces: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end token alone. Null ids stay null; rows that repeat an id are
    documents of their own. An empty table packs to no rows. A shard holds some
    `shard_pieces` pieces of under `size` tokens, so its memory is bounded; a sign that more pieces
    share is spread over several shards by a hash of the pieces' numbers, whatever their ids."""
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    pieces = tokenize(docs, path, ranks, size, end_id, ws)
    rest = pieces.where("ids is not null")
    tokens, df, n, mean = _document_frequencies(rest)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    signs, first, spread, shards = _shards(rest, shard_pieces)
    shared = spark.sparkContext.broadcast((dict(zip(tokens.tolist(), idf.tolist())), mean))
    where = spark.sparkContext.broadcast({s: (f, w) for s, f, w in zip(signs.tolist(), first.tolist(), spread.tolist())})

    def deal(sign: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([f + x % w for (f, w), x in zip(map(where.value.__getitem__, sign), h)], dtype="int64")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ids_crc32", "order", "start"], kind="stable").reset_index(drop=True)
        ids = [np.frombuffer(x, "<u4") for x in group["ids"]]
        idf, mean = shared.value
        rows = []
        for q, row in enumerate(fill(ids, Index(ids, idf, mean), size)):
            offset = 0
            for k, at, n in row:
                rows.append((k, at, n, crc32(ids[k][at : at + n].tobytes()), (int(group["shard"].iloc[0]) << 31) + q, offset))
                offset += n
        k, at, n, crc, q, offset = map(list, zip(*rows))
        got = group.iloc[k].reset_index(drop=True)
        return pd.DataFrame({"id": got["id"], "start": got["start"] + np.array(at), "length": n, "ids_crc32": crc, "doc_tokens": got["doc_tokens"], "sequence_id": np.array(q, np.int64) << 1, "offset": offset})

    dealt = rest.withColumn("order", F.xxhash64("piece")).withColumn("shard", F.pandas_udf(deal, "bigint")("sign", F.pmod("order", F.lit(1 << 30))))
    dealt = dealt.select("shard", F.col("doc_id").cast("string").alias("id"), "start", "ids_crc32", "doc_tokens", "ids", "order")
    packed = dealt.groupBy("shard").applyInPandas(run, "id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = pieces.where("ids is null").withColumn("offset", F.lit(0).cast("bigint"))
    return full.select(names).unionByName(packed.withColumn("doc_id", F.col("id").cast("bigint")).select(names))
