"""Exact dedup by deterministic block naming, with DataFrame operations only.

A text is cut into fixed-size blocks. Distinct blocks are sorted and numbered; then adjacent
names are paired, distinct pairs sorted and numbered, until one name is left of each text. Texts
of equally many blocks are equal exactly if their last names are. Content crosses the network
once, already reduced to distinct blocks by each task: it meets under a 128-bit key, and least
and greatest block of a key must be the same, so a key that two blocks share is seen (and the
keys are made anew from another seed). Names, not texts, are joined after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Workspace, documents


def _name(keys: DataFrame, ws: Workspace, at: str) -> DataFrame:
    """Distinct keys in sorted order, each with an integer name; stored, so that names hold."""
    return ws.save(keys.orderBy("k1", "k2").withColumn("name", F.monotonically_increasing_id()), at)


def _keys(block: Column, seed: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)


def name_documents(docs: DataFrame, block_chars: int = 4096, normalise: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, text_sha256, blocks, name; texts are equal exactly if
    (blocks, name) are. Null counts as empty; an empty text is one empty block."""
    ws = Workspace(docs.sparkSession, "names")
    text = F.col("text") if normalise is None else normalise
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    rows = documents(docs).select("doc_id", text.alias("text"))
    blocks = rows.select(F.explode(F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(cut)).alias("block"))
    for seed in range(8):
        k1, k2 = _keys(F.col("block"), seed)
        found = blocks.select(k1.alias("k1"), k2.alias("k2"), "block").groupBy("k1", "k2").agg((F.min("block") != F.max("block")).alias("two"))
        names = _name(found, ws, "blocks")
        if not names.where("two").limit(1).count():
            break
    else:
        raise RuntimeError("keys of blocks collided under every seed")
    key = F.transform(F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(cut), lambda b: F.struct(*(k.alias(n) for k, n in zip(_keys(b, seed), ("k1", "k2")))))
    base = rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), key.alias("keys")).withColumn("row", F.monotonically_increasing_id())
    base = ws.save(base.withColumn("blocks", F.size("keys")), "base")
    level = base.select("row", "blocks", F.posexplode("keys").alias("pos", "k")).select("row", "blocks", "pos", "k.*")
    level = ws.save(level.join(names.select("k1", "k2", "name"), ["k1", "k2"]).select("row", "blocks", "pos", "name"), "level0")
    done = [level.where("blocks = 1").select("row", "name")]
    most, k = base.agg(F.max("blocks")).first()[0] or 1, 0
    while most > 1 << k:
        # pairs of adjacent names; the last of an odd number is paired with -1
        wide = level.where(F.col("blocks") > (1 << k)).groupBy("row", "blocks", F.shiftright("pos", 1).alias("pos"))
        pairs = ws.save(wide.agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("k1"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("k2")), f"pairs{k}")
        names = _name(pairs.select("k1", "k2").distinct(), ws, f"names{k}")
        k += 1
        level = ws.save(pairs.join(names, ["k1", "k2"]).select("row", "blocks", "pos", "name"), f"level{k}")
        done.append(level.where((F.col("blocks") > (1 << (k - 1))) & (F.col("blocks") <= (1 << k))).select("row", "name"))
    last = done[0]
    for part in done[1:]:
        last = last.unionByName(part)
    return base.select("row", "doc_id", "text_sha256", "blocks").join(last, "row").select("doc_id", "text_sha256", "blocks", "name")


def exact_dedup(docs: DataFrame, block_chars: int = 4096, normalise: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; null ids lose to all others, and a group of null
    ids alone keeps them. Rows that repeat id and text all carry kept = true if they hold that id.
    The group sizes are counted by task before they meet, so large groups are no burden."""
    named = name_documents(docs, block_chars, normalise)
    # stored, so that the join deals both sides anew and adaptive execution may split a large group
    groups = Workspace(docs.sparkSession, "groups").save(named.groupBy("blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    out = named.join(groups, ["blocks", "name"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
