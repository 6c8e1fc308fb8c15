"""Secret scans with corpus-wide ownership frequency.

Base patterns find assignments, access keys and hex strings in every whole text; further candidates are
long tokens of mixed characters and tokens of known shapes. The values of all of them, those of base spans too, are hashed
and counted over the corpus by distinct owners and repositories. What more than ``max_owners`` owners hold, or
stands in more than ``max_repositories``, is a widely copied example; the rest is owner-specific and looks live. Base spans
stay in any case and get their class; other candidates become spans if they look live.

Values are reduced to distinct (value, owner, repository) before owners are counted, so a value in a
third of all rows is a few rows; the join back is of the occurrences with one row for each value, which Spark may split.

Defined cases: null text is empty; a null owner is an owner of its own; copies of a document within a
repository count once; very long texts are scanned whole; of candidates that overlap the kind listed first stays, then the
leftmost; repeated rows are scanned row by row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_row

#: Kinds in the order of their output; the base ones first.
KINDS = ("assign", "access", "hex", "jwt", "forge", "token")
BASE = 3
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
#: Shapes of signed tokens and of the tokens of code forges.
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_FORGE = re.compile(r"\b(?:gh[oprsu]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    # characters beyond ASCII may have ASCII letters as lower case, never the reverse: no key word is missed
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if _LONG_HEX.search(text):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def _bits(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def candidates(text: str, base: list[tuple[int, int, int]], least_bits: float = 3.5) -> list[tuple[int, int, int]]:
    """Spans that may be secrets and overlap no base span."""
    if not any(len(w) >= 14 for w in text.split()):
        return []
    found = []
    if "eyJ" in text:
        found += [(m.start(), 3, m.end()) for m in _JWT.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in _FORGE.finditer(text)]
    for m in _TOKEN.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v) and _bits(v) >= least_bits:
            found.append((m.start(), 5, m.end()))
    taken = sorted((a, b) for a, _, b in base)
    # base spans of different kinds may overlap each other: how far any of them reaches so far
    reach, most = [], 0
    for _, b in taken:
        most = max(most, b)
        reach.append(most)
    mine: list[tuple[int, int]] = []
    out: list[tuple[int, int, int]] = []
    for s, k, e in sorted(found, key=lambda x: (x[1], x[0])):
        i, j = bisect.bisect_left(taken, (e, 0)), bisect.bisect_left(mine, (e, 0))
        if (i == 0 or reach[i - 1] <= s) and (j == 0 or mine[j - 1][1] <= s):
            bisect.insort(mine, (s, e))
            out.append((s, k, e))
    return sorted(out)


def value_of(text: str, span: tuple[int, int, int]) -> str:
    """What is secret in a span: of an assignment, what is assigned."""
    s, k, e = span
    return _ASSIGN.match(text, s, e)[2] if k == 0 else text[s:e]


def scan(
    docs: DataFrame, max_owners: int = 1, max_repositories: int = 3, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")
) -> DataFrame:
    """One row for each document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, found``.

    ``found`` lists (kind, start, end, owners, repositories, live) of all base spans and of those that the method adds.
    """
    owner = F.coalesce(docs[owner_col].cast("string"), F.lit("\0"))
    repo = F.to_json(F.array(*(docs[c].cast("string") for c in repo_cols)))
    d = with_row(docs.select(docs[id_col].alias("doc_id"), owner.alias("owner"), repo.alias("repo"), docs[text_col].alias("text")))
    kind = d.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary())]))

    def run(batches):
        for b in batches:
            every = []
            for t in b.column("text").to_pylist():
                t = t or ""
                x = base_spans(t)
                every.append([{"start": s[0], "kind": s[1], "end": s[2], "value": hashlib.sha256(value_of(t, s).encode()).digest()[:16]} for s in (*x, *candidates(t, x))])
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("doc_id"), b.column("owner"), b.column("repo"), pa.array(every, span)], ["_row", "doc_id", "owner", "repo", "every"])

    d = cut(d.mapInArrow(run, f"_row long, doc_id {kind}, owner string, repo string, every array<struct<start:long,kind:int,end:long,value:binary>>"))

    held = d.where(F.size("every") > 0).select("_row", "owner", "repo", F.explode("every").alias("m")).select("_row", "owner", "repo", "m.*")
    places = held.select("value", "owner", "repo").distinct()
    counts = places.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    at = held.join(counts.withColumn("live", live), "value").where((F.col("kind") < BASE) | F.col("live"))
    names = F.array(*map(F.lit, KINDS))
    at = at.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", "live"))).alias("found"))

    d = d.select("_row", "doc_id").join(at, "_row", "left").withColumn("found", F.coalesce("found", F.array()))
    base = F.filter("found", lambda s: s["kind"] < BASE)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    named = F.transform("found", lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["owners"].alias("owners"), s["repositories"].alias("repositories"), s["live"].alias("live")))
    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), named.alias("found"))
