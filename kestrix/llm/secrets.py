"""Secret scan with corpus-wide ownership frequency.

Each task finds candidate spans by pattern. Candidate hashes are then aggregated over the whole
corpus by distinct repositories (documents) and owners (sources): what many owners hold is a
widely copied example, what few hold looks live. Tokens of high entropy without a telling
pattern become spans of their own only if they are specific to an owner.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256
from math import log2

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, lower, pick

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a longest run of 24 or more: shorter runs are failing matches
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Public formats of credentials, by the method's own kinds.
FORMATS = {
    "github": re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    "google": re.compile(r"\bAIza[A-Za-z0-9_-]{35}"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "slack": re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
}
HINTS = {"github": "gh", "google": "AIza", "jwt": "eyJ", "pem": "-----BEGIN", "slack": "xox"}
LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ORDER = {k: i for i, k in enumerate((*KINDS, *FORMATS, "entropy"))}


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, secret) of the base kinds, leftmost and non-overlapping in each."""
    low = lower(text)
    out = []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return out


def _entropy(s: str) -> float:
    return -sum(n / len(s) * log2(n / len(s)) for n in Counter(s).values())


def candidates(text: str, least: float = 3.5) -> list[tuple[int, int, str, str]]:
    """Base spans, spans of known formats, and high-entropy tokens that overlap none of them."""
    out = base_spans(text)
    for kind, hint in HINTS.items():
        if hint in text:
            out += [(m.start(), m.end(), kind, m[0]) for m in FORMATS[kind].finditer(text)]
    taken = [(s, e) for s, e, *_ in out]
    for m in LONG.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and _entropy(s) >= least and all(m.end() <= a or b <= m.start() for a, b in taken):
            out.append((m.start(), m.end(), "entropy", s))
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]]))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, copied: int = 3, least: float = 3.5) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example, found (array of kind, start, end, distinct owners and repositories (documents), copies, live).

    A candidate held by `copied` or more distinct owners is an example, else live; an entropy token
    must be live to be a span. Null or empty text has no spans (the digest is of the empty string).
    A null owner is one owner of its own; null ids stay, and repeated rows each get their row.
    Candidate counts are made by task and (hash, owner) before they meet, so a credential that a
    third of all rows copy is one row of each task."""
    ws = Workspace(docs.sparkSession, "secrets")
    got = pick(docs, doc_id="bigint", source="string", text="string").withColumn("text", F.coalesce("text", F.lit("")))

    def spans(text: str) -> list[dict]:
        seen: set[str] = set()
        out = []
        for a, b, k, s in candidates(text, least):
            out.append({"kind": k, "from": a, "to": b, "key": blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "first": s not in seen})
            seen.add(s)
        return out

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([spans(t) for t in texts])

    kind = "array<struct<kind: string, `from`: bigint, `to`: bigint, `key`: binary, first: boolean>>"
    rows = got.select("doc_id", "source", F.pandas_udf(find, kind)("text").alias("found")).withColumn("row", F.monotonically_increasing_id())
    rows = ws.save(rows, "candidates")
    each = rows.where(F.size("found") > 0).select("row", "source", F.explode("found").alias("f")).select("row", "source", "f.*")
    owners = each.groupBy("key", F.coalesce("source", F.lit("\0")).alias("owner")).agg(F.count("*").alias("n"), F.count_if("first").alias("repos"))
    owners = owners.groupBy("key").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("copies"))
    told = each.join(owners, "key").withColumn("live", F.col("owners") < copied)
    rank = F.create_map(*[x for k, i in ORDER.items() for x in (F.lit(k), F.lit(i))])
    span = F.struct("from", rank[F.col("kind")].alias("rank"), "to", "kind", "owners", "repos", "copies", "live")
    told = told.where("live or kind != 'entropy'").groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("s"))
    out = rows.select("row", "doc_id").join(told, "row", "left").withColumn("s", F.coalesce("s", F.array().cast(dict(told.dtypes)["s"])))
    text = lambda x: F.concat_ws(":", x["kind"], x["from"].cast("string"), x["to"].cast("string"))
    base = F.filter("s", lambda x: x["kind"].isin(*KINDS))
    n = lambda test: F.size(F.filter("s", test)).cast("bigint")
    return out.select(
        "doc_id",
        *[n(_is(k)).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("s", text), ",").alias("spans"),
        n(lambda x: x["live"]).alias("n_live"),
        n(lambda x: ~x["live"]).alias("n_example"),
        F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["from"].alias("start"), x["to"].alias("end"), x["owners"].alias("owners"), x["repos"].alias("repos"), x["copies"].alias("copies"), x["live"].alias("live"))).alias("found"),
    )


def base_digest(text: str) -> str:
    """base_sha256 of one text."""
    spans = sorted(((a, b, k) for a, b, k, _ in base_spans(text)), key=lambda x: (x[0], ORDER[x[2]]))
    return sha256(_joined(spans).encode()).hexdigest()
