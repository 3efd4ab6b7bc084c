"""MinHash near-dedup with circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: sigma scatters the hashed shingles, and pi,
circularly shifted by k, gives coordinate k. Texts with equal shingle sets are one class, so
copies never make pairs. Classes meet in band buckets; a bucket first links its members to one
leader each round (a star, not all pairs), links are verified on the full sets, and connected
components are formed. Only pairs of classes in the same bucket but in different components are
then still open. All of them are compared by their signatures, block by block within the bucket
and without making rows of them; those whose signatures allow the similarity are verified. So no
link is lost but by the odds below, and groups of copies cost as many tests as members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, documents

DIM = 1 << 20
BANDS, ROWS = 40, 6  # misses a pair of similarity 0.8 with probability (1 - 0.8**6)**40 = 5e-6
SIGMAS = 5.0  # standard errors by which equal coordinates may fall short: misses 3e-7 of such pairs
BLOCK = 512  # classes of a bucket that are compared with as many at a time
SKETCH = 2048  # coordinates, 4 bits each, of the finer signatures of classes that meet another
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_SPAN = 1 << 16  # bytes hashed at a time
_BASE = 0x5851F42D4C957F2D
_POWER, _INVERSE = (np.cumprod(np.where(np.arange(_SPAN + 1) > 0, np.uint64(x), np.uint64(1)), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
_EQUAL = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)  # equal halves of two bytes, by their xor


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each run without ASCII white space, A-Z taken as a-z.

    A word's hash is a polynomial of its bytes modulo 2**64, found for all words of a span at once
    from running sums; words of 256 bytes or more are hashed one by one."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).view(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(first), np.uint64)
    long = np.flatnonzero(last - first >= 256)
    k = 0
    while k < len(first):
        n = int(np.searchsorted(last, first[k] + _SPAN, "right"))  # words that end within the span
        if n > k:
            low, high = int(first[k]), int(last[n - 1])
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTES[raw[low:high]] * _POWER[: high - low], out=sums[1:])
            at = first[k:n] - low
            out[k:n] = (sums[last[k:n] - low] - sums[at]) * _INVERSE[at] + (last[k:n] - first[k:n]).astype(np.uint64) * _ODD[3]
        k = max(n, k + 1)  # a word longer than a span is one of the long ones
    for k in long:
        out[k] = xxhash.xxh3_64_intdigest(bytes(raw[first[k] : last[k]]).lower())
    return _mix(out)


def shingles(text: str, size: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of the whole sequence if shorter."""
    h = word_hashes(text)
    if len(h) == 0:
        return h
    if len(h) < size:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(27))) * _ODD[1] + h[k : len(h) - size + 1 + k] * _ODD[k % 4]
    out = np.sort(_mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


@lru_cache(2)
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    sigma, pi = rng.permutation(DIM).astype(np.uint32), rng.permutation(DIM).astype(np.uint32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)


def signature(found: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: coordinate j is the least pi(sigma(x) + j) over the set."""
    sigma, shifted = _permutations(k)
    at = sigma[(found >> np.uint64(20)).astype(np.int64) & (DIM - 1)]
    out = np.full(k, DIM, np.uint32)
    for i in range(0, len(at), 256):
        np.minimum(out, shifted[at[i : i + 256]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    part = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * _ODD[2]
    for c in range(rows):
        h = _mix(h + part[:, c] * _ODD[3])
    return h.view(np.int64)


def sketch(docs: DataFrame, size: int = 4, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n (shingles), set (128-bit name of the set, null if empty), keys (one a band)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                s = shingles(t, size)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(signature(s, bands * rows), bands, rows)) if len(s) else (0, None, None))
            yield pd.DataFrame(out, columns=["n", "set", "keys"])

    made = F.pandas_udf(run, "n bigint, set binary, keys array<bigint>")
    return documents(docs).select("doc_id", made("text").alias("r")).select("doc_id", "r.*")


def components(edges: DataFrame, ws: Workspace, at: str) -> DataFrame:
    """(node, root) of all nodes with an edge (a, b); root names the component.

    Each round every node takes the least name among its neighbours' (one pointer jump), and edges
    are contracted; half the names of a component go each round, whatever its shape."""
    left = ws.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), f"{at}-edges")
    jumps = []
    while n := left.count():
        # what a round makes is at most two rows an edge: few files of them, where there are few
        k, parts = len(jumps), -(-n // 20_000)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        jump = near.join(near.select(F.col("node").alias("to"), F.col("to").alias("root")), "to").select("node", "root")
        jumps.append(ws.save(jump.coalesce(parts), f"{at}-jump{k}"))
        on = lambda c: jumps[k].select(F.col("node").alias(c), F.col("root").alias(f"{c}2"))
        nxt = left.join(on("a"), "a").join(on("b"), "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a != b").distinct()
        left = ws.save(nxt.coalesce(parts), f"{at}-edges{k}")
    if not jumps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = jumps[0]
    for jump in jumps[1:]:
        step = jump.select(F.col("node").alias("root"), F.col("root").alias("root2"))
        out = out.join(step, "root", "left").select("node", F.coalesce("root2", "root").alias("root"))
    return ws.save(out, f"{at}-out") if jumps[1:] else out


def _full_sets(docs: DataFrame, classes: DataFrame, cids: DataFrame, size: int) -> DataFrame:
    """cid, keys, fine signature (sig) and the full set (hashes) of the classes that meet another in a bucket."""
    null = F.lit(-(1 << 63))
    wanted = classes.join(cids, "cid", "left_semi").select("cid", "set", "keys", F.coalesce("doc_id", null).alias("id"))

    def full(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, names in batches:
            out = []
            for text, name in zip(texts, names):
                s = shingles(text, size)
                raw = s.tobytes()
                out.append((fine(s).tobytes(), raw) if xxhash.xxh3_128_digest(raw) == name else (None, None))
            yield pd.DataFrame(out, columns=["sig", "hashes"])

    texts = documents(docs).select(F.coalesce("doc_id", null).alias("id"), "text").join(wanted, "id")
    # the function sees both sides of the join, so it runs after it, on candidates only; were it taken for
    # deterministic, the filter would be pushed below it and run it a second time, in other Python workers
    made = F.pandas_udf(full, "sig binary, hashes binary").asNondeterministic()
    sets = texts.select("cid", "keys", made("text", "set").alias("r")).where("r.hashes is not null")
    return sets.select("cid", "keys", "r.*").dropDuplicates(["cid"])  # rows that repeat an id and a set


def fine(found: np.ndarray) -> np.ndarray:
    """The last 4 bits of SKETCH coordinates, two to a byte."""
    s = (signature(found, SKETCH) & np.uint32(15)).astype(np.uint8)
    return s[::2] | (s[1::2] << np.uint8(4))


def least_equal(percent: int) -> int:
    """Equal coordinates of fine signatures that a pair at the threshold has but for SIGMAS standard
    errors; those that differ have equal bits one time in 16."""
    q = percent / 100 + (1 - percent / 100) / 16
    return int(np.floor(SKETCH * (q - SIGMAS * np.sqrt(q * (1 - q) / SKETCH))))


def _verified(pairs: DataFrame, sets: DataFrame, need: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose signatures allow it and whose full sets meet 100 * intersection >= percent * union."""

    def near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([int(_EQUAL[np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)].sum()) >= need for x, y in zip(left, right)], dtype=bool)

    def holds(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                out.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pd.Series(out, dtype=bool)

    side = lambda c, value, name: sets.select(F.col("cid").alias(c), F.col(value).alias(name))
    likely = pairs.join(side("b", "sig", "y"), "b").join(side("a", "sig", "x"), "a").where(F.pandas_udf(near, "boolean")("x", "y")).select("a", "b")
    held = likely.join(side("b", "hashes", "y"), "b").join(side("a", "hashes", "x"), "a")
    return held.where(F.pandas_udf(holds, "boolean")("x", "y")).select("a", "b")


def _open_pairs(told: DataFrame, sets: DataFrame, need: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that share a bucket but no component and whose sizes and signatures allow a link.

    A bucket is cut into blocks of BLOCK classes or so; a group is a pair of blocks, so its memory is
    bounded. Each pair comes from its first common bucket alone."""
    sizes = told.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = told.join(sets.select("cid", "sig", "keys"), "cid").join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cid", "n", "root", "sig", "keys")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        key, x, y = group["key"].iloc[0], group["x"].iloc[0], group["y"].iloc[0]
        sig = np.array([np.frombuffer(b, np.uint8) for b in group["sig"]])
        keys = np.array(group["keys"].tolist(), np.int64)
        cid, n, root, block = (group[c].to_numpy() for c in ("cid", "n", "root", "block"))
        left, right = (np.flatnonzero(block == x), np.flatnonzero(block == y)) if x != y else (np.arange(len(cid)), np.arange(len(cid)))
        own = int((keys[0] == key).argmax())
        out_a, out_b = [], []
        for k in range(0, len(left), 64):
            part = left[k : k + 64]
            ok = (root[part, None] != root[None, right]) & (100 * np.minimum(n[part, None], n[None, right]) >= percent * np.maximum(n[part, None], n[None, right]))
            if x == y:
                ok &= cid[part, None] < cid[None, right]
            i, j = np.nonzero(ok)
            i, j = part[i], right[j]
            for m in range(0, len(i), 2048):
                p, q = i[m : m + 2048], j[m : m + 2048]
                near = _EQUAL[sig[p] ^ sig[q]].sum(axis=1) >= need
                p, q = p[near], q[near]
                first = (keys[p] == keys[q]).argmax(axis=1) == own
                out_a.append(np.minimum(cid[p[first]], cid[q[first]]))
                out_b.append(np.maximum(cid[p[first]], cid[q[first]]))
        flat = lambda v: np.concatenate(v) if v else np.empty(0, np.int64)
        return pd.DataFrame({"a": flat(out_a), "b": flat(out_b)})

    # dealt by block pair: the plan would else leave all blocks of a bucket in one task
    return rows.repartition("key", "x", "y").groupBy("key", "x", "y").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS, stars: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows are doc_id, n_shingles, component_id, kept, one per input row; links are
    verified pairs of sets, as the least doc_ids of the two, enough to connect each component.

    Null and empty texts have no shingles and are linked with nothing: component_id is their own
    id, kept is true. Null ids stay null and count last when a component looks for its least id. Rows
    that repeat an id and a text have the same result."""
    ws = Workspace(docs.sparkSession, "near")
    all_rows = ws.save(sketch(docs, size, bands, rows), "sketch")
    classes = all_rows.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = ws.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    each = classes.select("cid", "n", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("lead"), F.max("cid").alias("last")).where("lead.cid != last")
    members = ws.save(each.join(shared.select("key", "lead"), "key"), "members")
    fits = lambda x, y: F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)
    pairs = members.where(F.col("cid") != F.col("lead.cid")).where(fits(F.col("n"), F.col("lead.n"))).select(F.col("lead.cid").alias("a"), F.col("cid").alias("b")).distinct()
    pairs = ws.save(pairs, "pairs0")
    sets = ws.save(_full_sets(docs, classes, members.select("cid").distinct(), size), "sets")
    need = least_equal(percent)
    tested, links = pairs, ws.save(_verified(pairs, sets, need, percent), "links0")
    comp, before = components(links, ws, "comp0"), None
    for k in range(1, stars + 2):
        # buckets that still hold several components, and how many pairs of different ones they have
        told = members.select("key", "cid", "n").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        by = told.groupBy("key", "root").agg(F.count("*").alias("m"))
        open_ = by.groupBy("key").agg(F.count("*").alias("c"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("q")).where("c > 1")
        open_ = ws.save(open_.select("key", "m", ((F.col("m") * F.col("m") - F.col("q")) / 2).alias("pairs")), f"open{k}")
        n, most = open_.agg(F.sum("m"), F.sum("pairs")).first()
        if not n:
            break
        told = ws.save(told.join(open_.select("key"), "key"), f"told{k}")
        # many pairs to a member: another star first, while stars still close a fifth of what is open
        final = k > stars or most <= 4 * n or before is not None and most > 0.8 * before
        before = most
        if not final:  # led by who has most links
            degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("links"))
            ranked = told.join(degree, "cid", "left").select("key", F.struct(F.coalesce("links", F.lit(0)).alias("links"), F.xxhash64("cid", F.lit(k)).alias("h"), "cid", "n", "root").alias("s"))
            lead = ranked.groupBy("key").agg(F.max("s").alias("s"))
            cand = told.join(lead, "key").where((F.col("root") != F.col("s.root")) & fits(F.col("n"), F.col("s.n"))).select(F.least("cid", "s.cid").alias("a"), F.greatest("cid", "s.cid").alias("b"))
        else:
            cand = _open_pairs(told, sets, need, percent)
        pairs = ws.save(cand.distinct().join(tested, ["a", "b"], "left_anti"), f"pairs{k}")
        found = ws.save(_verified(pairs, sets, need, percent), f"links{k}")
        tested, links = tested.unionByName(pairs), links.unionByName(found)
        comp = components(links, ws, f"comp{k}")
        if final:
            break
    named = classes.select("set", "cid", "doc_id").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    told = named.join(least, "root").select("set", "component_id")
    out = all_rows.select("doc_id", "n", "set").join(told, "set", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    ids = lambda c: classes.select(F.col("cid").alias(c), F.col("doc_id").alias(f"{c}_id"))
    return out, links.join(ids("a"), "a").join(ids("b"), "b").select("a_id", "b_id")
