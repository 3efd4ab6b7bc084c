"""Benchmark decontamination over a distributed positional inverted index.

The benchmark is taken in blocks of items of bounded size, so that its vocabulary, windows and what
is broadcast of them are bounded too. A block's index is partitioned by documents: each row holds
the postings (term, sorted positions) of some documents for all terms that an item of the block
uses, and is stored in the shared folder. Each window starts from the positions of its rarest term (by frequency over all documents)
and intersects the offset-adjusted lists of the others, rarest first. Exact phrases need every term at its place, proximity matches each within
`slop` words of it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import WORD, Workspace, documents, lower, pick

WIDE = np.int64(1) << np.int64(36)  # more than the positions of one row of the index


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


class Windows:
    """The distinct windows of some items, as term numbers, each with its offsets rarest first."""

    def __init__(self, items: list[tuple[str, list[str]]], vocab: dict[str, int], frequency: np.ndarray, size: int):
        found: dict[tuple[int, ...], set[int]] = defaultdict(set)
        self.items = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.items)}
        for name, words in items:
            terms = [vocab[w] for w in words]
            for k in range(max(1, len(terms) - size + 1) if terms else 0):
                found[tuple(terms[k : k + size])].add(number[name])
        rows = [w for w in found if all(frequency[t] for t in w)]  # a term that no document has ends it here
        self.n, self.size = np.array([len(w) for w in rows], np.int64), size
        self.terms = np.full((len(rows), size), -1, np.int64)
        self.order = np.zeros((len(rows), size), np.int64)
        for k, w in enumerate(rows):
            self.terms[k, : len(w)] = w
            self.order[k, : len(w)] = np.argsort(frequency[list(w)], kind="stable")
        self.owners = [sorted(found[w]) for w in rows]
        anchor = self.terms[np.arange(len(rows)), self.order[:, 0]] if rows else np.empty(0, np.int64)
        self.by_anchor = np.argsort(anchor, kind="stable")
        self.anchors, self.first = np.unique(anchor[self.by_anchor], return_index=True)
        self.last = np.append(self.first[1:], len(rows))

    def search(self, keys: np.ndarray, terms: np.ndarray, starts: np.ndarray, slop: int = 0, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all occurrences; keys: term * WIDE + position, sorted, with each
        term's slice starting at `starts`. Candidates are made `most` or so at a time."""
        found_w, found_s = [], []
        at = np.searchsorted(terms, self.anchors)
        ends = np.append(starts[1:], len(keys))
        for a, (term, k) in enumerate(zip(self.anchors, at)):
            if k >= len(terms) or terms[k] != term:
                continue
            positions = keys[starts[k] : ends[k]] - term * WIDE
            mine = self.by_anchor[self.first[a] : self.last[a]]
            step = max(1, most // len(positions))
            for j in range(0, len(mine), step):
                w = np.repeat(mine[j : j + step], len(positions))
                s = np.tile(positions, len(mine[j : j + step])) - self.order[w, 0]
                for r in range(1, self.size):
                    live = r < self.n[w]
                    if not live.any():
                        break
                    offset = self.order[w, r]
                    want = self.terms[w, offset] * WIDE + s + offset
                    near = np.searchsorted(keys, want - slop)
                    ok = ~live | (keys[np.minimum(near, len(keys) - 1)] <= want + slop) & (near < len(keys))
                    w, s = w[ok], s[ok]
                    if not len(w):
                        break
                found_w.append(w)
                found_s.append(s)
        empty = np.empty(0, np.int64)
        return (np.concatenate(found_w), np.concatenate(found_s)) if found_w else (empty, empty)


def build_index(rows: DataFrame, vocab: list[str], gap: int, ws: Workspace, name: str = "index", shard_words: int = 250_000) -> DataFrame:
    """The stored index of rows (row, doc_id, text): a row for each run of documents of some `shard_words`
    words (a longer document has a row of its own); `gap` free positions part documents."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {w: k for k, w in enumerate(shared.value)}
        ids: list = []
        numbers: list[int] = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        places: list[np.ndarray] = []
        base = gap

        def row() -> pd.DataFrame:
            term, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (parts, places))
            order = np.argsort(term, kind="stable")
            distinct, first = np.unique(term[order], return_index=True)
            return pd.DataFrame({"rows": [numbers], "doc_ids": [ids], "sizes": [sizes], "terms": [distinct.astype(np.int32).tobytes()], "starts": [first.astype(np.int64).tobytes()], "positions": [place[order].astype(np.int64 if base >> 31 else np.int32).tobytes()]})

        for batch in batches:
            for number_, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"]):
                words = words_of(text)
                t = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
                p = np.flatnonzero(t >= 0)
                parts.append(t[p])
                places.append(p + base)
                numbers.append(number_)
                ids.append(doc_id)
                sizes.append(len(words))
                base += len(words) + gap
                if base >= shard_words:
                    yield row()
                    numbers, ids, sizes, parts, places, base = [], [], [], [], [], gap
        if ids:
            yield row()

    named = rows.select("row", F.col("doc_id").cast("string"), "text")  # pandas would make numbers with nulls floats
    return ws.save(named.mapInPandas(run, "rows array<bigint>, doc_ids array<string>, sizes array<bigint>, terms binary, starts binary, positions binary"), name)


def _frequencies(index: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each term over all documents; at most one number a term from a task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms, starts, n in zip(batch["terms"], batch["starts"], batch["n"]):
                total[np.frombuffer(terms, np.int32)] += np.diff(np.append(np.frombuffer(starts, np.int64), n))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some, "n": total[some]})

    width = F.when(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x) >= F.lit(1 << 30), 8).otherwise(4)
    parts = index.select("terms", "starts", (F.octet_length("positions") / width).cast("bigint").alias("n"))
    rows = parts.mapInPandas(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r.term] = r.n
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, slop: int | None = None, share: int = 20, block_words: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items
    (sorted names), n_near (windows found within `slop`, exact ones too; null without slop).

    A document is contaminated if n_hit > 0 and share * n_hit >= n_words. Null and empty texts have
    no words and are clean. Items without words have no window; an item without an id has the empty
    name; items that share an id count once. Null document ids stay; repeated rows each get their row.
    The benchmark is taken in blocks of some `block_words` words, each with an index of its own terms:
    what is broadcast is bounded however large the benchmark is. A window lies in one item, so in one block."""
    spark = docs.sparkSession
    ws = Workspace(spark, "decontaminate")
    items = pick(benchmark, item_id="string", text="string").withColumn("text", F.coalesce("text", F.lit(""))).select(F.coalesce("item_id", F.lit("")).alias("item_id"), "text")
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.explode(F.regexp_extract_all(small, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))).alias("w"))
    blocks = max(1, -(-words.count() // block_words))
    gap = size + 2 * (slop or 0) + 1
    rows = documents(docs).withColumn("row", F.monotonically_increasing_id())
    if blocks > 1:
        rows = ws.save(rows, "rows")  # so that blocks see the same numbers
    parts = None
    for b in range(blocks):
        mine = [(r.item_id, words_of(r.text)) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        vocab = sorted({w for _, text in mine for w in text})
        index = build_index(rows, vocab, gap, ws, f"index{b}")
        windows = Windows(mine, {w: k for k, w in enumerate(vocab)}, _frequencies(index, len(vocab)), size)
        part = _search(index, windows, gap, slop)
        if blocks > 1:
            part = ws.save(part, f"found{b}")
            ws.drop(f"index{b}")
        parts = part if parts is None else parts.unionByName(part)
    if blocks > 1:
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        parts = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), flat("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("n_near").alias("n_near"))
    # spans are disjoint and sorted within a block; over blocks, each adds what lies beyond those before
    union = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(s["from"], a["end"]))).alias("n"), F.greatest(a["end"], s["to"]).alias("end")))
    out = parts.select("doc_id", "n_words", union["n"].alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items", "n_near")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "n_near")


def _search(index: DataFrame, windows: Windows, gap: int, slop: int | None) -> DataFrame:
    """A row for each document: row, doc_id, n_words, spans of hit words, items, n_near."""
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        win = shared.value
        for batch in batches:
            for r in batch.itertuples(index=False):
                terms, starts = np.frombuffer(r.terms, np.int32).astype(np.int64), np.frombuffer(r.starts, np.int64)
                sizes = np.array(r.sizes, np.int64)
                begins = gap + np.cumsum(np.append(0, sizes[:-1] + gap))
                end = int(begins[-1] + sizes[-1] + gap)
                places = np.frombuffer(r.positions, np.int64 if end >> 31 else np.int32).astype(np.int64)
                keys = np.repeat(terms, np.diff(np.append(starts, len(places)))) * WIDE + places
                near = np.zeros(len(sizes), np.int64)
                if slop is not None:
                    w, s = win.search(keys, terms, starts, slop)
                    pairs = np.unique((np.searchsorted(begins, s, "right") - 1) * len(win.n) + w)
                    near = np.bincount(pairs // max(1, len(win.n)), minlength=len(sizes))
                w, s = win.search(keys, terms, starts)
                spans: list[list[dict]] = [[] for _ in sizes]
                items: list[set[str]] = [set() for _ in sizes]
                order = np.argsort(s, kind="stable")
                for k, at, n in zip(w[order].tolist(), s[order].tolist(), win.n[w[order]].tolist()):
                    d = int(np.searchsorted(begins, at, "right")) - 1
                    first = at - int(begins[d])
                    mine = spans[d]
                    if mine and first <= mine[-1]["to"]:
                        mine[-1]["to"] = max(mine[-1]["to"], first + n)
                    else:
                        mine.append({"from": first, "to": first + n})
                    items[d].update(win.items[i] for i in win.owners[k])
                yield pd.DataFrame({"row": np.array(r.rows, np.int64), "doc_id": pd.array([None if x is None else int(x) for x in r.doc_ids], "Int64"), "n_words": sizes, "spans": spans, "items": [sorted(x) for x in items], "n_near": near if slop is not None else pd.array([None] * len(sizes), "Int64")})

    return index.mapInPandas(run, "row bigint, doc_id bigint, n_words bigint, spans array<struct<`from`: bigint, `to`: bigint>>, items array<string>, n_near bigint")


def items_digest(names: list[str]) -> str:
    return sha256(",".join(sorted(names)).encode()).hexdigest()
