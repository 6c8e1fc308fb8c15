"""Exact dedup by a minimal perfect hash over historical distinct digests.

``build_index`` turns the distinct digests of a history into a partitioned minimal perfect hash by
compress, hash and displace: each part of about ``PART`` digests has exactly as many slots as digests,
each small bucket of a part a displacement, each slot the full digest, the winner's locator and the
size of its group. ``lookup`` evaluates the hash with column functions, and compares the full digest
in the slot: only a digest equal byte for byte is a member. What is no member is grouped separately.

The hash build sees every distinct digest once, so that a hot group of copies is one row there; both
look-ups are equi-joins with the documents on the left, which Spark may split where a key is hot.

Defined cases: null text counts as empty; rows with equal id and text are ties, of which the one with
the larger row number stays; null ids rank below all others; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, with_row

#: Digests in a part, and small buckets in a part; the table of a part stays below a megabyte.
PART, BUCKETS = 4096, 1024
INDEX = "part long, slot long, bucket long, m long, s int, d0 long, d1 long, digest string, keep_id long, keep_row long, group_size long"


def _hex(digest: Column | str, k: int) -> Column:
    """60 bits of the hex digest, from the k-th group of 15 letters, as a long."""
    return F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(_row, doc_id, digest)`` of every row, cut."""
    row = [docs[row_col].alias("_row")] if row_col else []
    d = docs.select(*row, docs[id_col].cast("long").alias("doc_id"), F.sha2(text_of(docs, text_col), 256).alias("digest"))
    return cut(d if row_col else with_row(d))


def winners(d: DataFrame) -> DataFrame:
    """Of each digest the row with the largest id, and the number of rows."""
    best = F.max(F.struct("doc_id", "_row"))
    g = d.groupBy("digest").agg(best.alias("w"), F.count(F.lit(1)).alias("group_size"))
    return g.select("digest", F.col("w.doc_id").alias("keep_id"), F.col("w._row").alias("keep_row"), "group_size")


def _displace(f: np.ndarray, g: np.ndarray, bucket: np.ndarray, m: int):
    """Displacements (d0, d1) of each bucket so that (f + d0 g + d1) mod m is a permutation, or None."""
    free = np.ones(m, bool)
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    groups = np.split(order, starts[1:])
    d0s, d1s, slots = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
    for rows in sorted(groups, key=len, reverse=True):
        for d0 in range(4 * m):
            at = (f[rows] + d0 * g[rows]) % m
            if len(np.unique(at)) < len(rows):
                continue
            shifts = np.arange(m) if len(rows) > 1 else (np.flatnonzero(free)[:1] - at[0]) % m
            fits = np.flatnonzero(free[(at[:, None] + shifts[None, :]) % m].all(axis=0))
            if len(fits):
                d0s[rows], d1s[rows] = d0, shifts[fits[0]]
                slots[rows] = (at + shifts[fits[0]]) % m
                free[slots[rows]] = False
                break
        else:
            return None
    return d0s, d1s, slots


def _build(p: pd.DataFrame) -> pd.DataFrame:
    m = len(p)
    x, y, b = (p[c].to_numpy(np.int64) for c in ("f", "g", "bucket"))
    for s in range(40):
        if (found := _displace((x >> s) % m, (y >> s) % m, b, m)) is not None:
            d0, d1, slot = found
            return pd.DataFrame({"part": p["part"], "slot": slot, "bucket": b, "m": m, "s": s, "d0": d0, "d1": d1, "digest": p["digest"], "keep_id": p["keep_id"].astype("Int64"), "keep_row": p["keep_row"], "group_size": p["group_size"]})
    raise ValueError("no displacement found: are the digests distinct?")


def build_index(history: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``(seeds, slots, parts)`` over ``history(digest, keep_id, keep_row, group_size)`` of distinct digests."""
    parts = max(1, -(-history.count() // PART))
    keyed = history.select("*", F.pmod(_hex("digest", 2), F.lit(parts)).alias("part"), F.pmod(_hex("digest", 3), F.lit(BUCKETS)).alias("bucket"), _hex("digest", 0).alias("f"), _hex("digest", 1).alias("g"))
    index = cut(keyed.groupBy("part").applyInPandas(_build, INDEX))
    seeds = index.select("part", "bucket", "m", "s", "d0", "d1").distinct()
    slots = index.select("part", "slot", F.col("digest").alias("slot_digest"), "keep_id", "keep_row", "group_size")
    return seeds, slots, parts


def lookup(d: DataFrame, seeds: DataFrame, slots: DataFrame, parts: int) -> DataFrame:
    """Adds the slot's ``keep_id, keep_row, group_size`` to each row of ``d``; null where no member."""
    at = d.withColumns({"part": F.pmod(_hex("digest", 2), F.lit(parts)), "bucket": F.pmod(_hex("digest", 3), F.lit(BUCKETS))})
    at = at.join(seeds, ["part", "bucket"], "left")
    f, g = (F.pmod(F.expr(f"shiftright({c}, s)"), F.col("m")) for c in ("f", "g"))
    at = at.withColumns({"f": _hex("digest", 0), "g": _hex("digest", 1)}).withColumn("slot", F.pmod(f + F.col("d0") * g + F.col("d1"), F.col("m")))
    found = at.select("_row", "doc_id", "digest", "part", "slot").join(slots, ["part", "slot"], "left")
    same = F.col("digest") == F.col("slot_digest")
    return found.select("_row", "doc_id", "digest", *(F.when(same, F.col(c)).alias(c) for c in ("keep_id", "keep_row", "group_size")))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row for each document: ``_row, doc_id, digest, keep_id, group_size, kept``.

    ``history``: an earlier ``winners`` table; its members stay winners and all their repeats go. Without
    one, the corpus itself is the history. Documents that are no members are grouped among themselves.
    """
    d = digests(docs, id_col, text_col, row_col)
    own = history is None
    known = cut(winners(d)) if own else history
    found = lookup(d, *build_index(known))
    if own:
        return found.select("_row", "doc_id", "digest", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"))
    found = cut(found)
    old = found.where("group_size is not null").select("_row", "doc_id", "digest", "keep_id", "group_size", F.lit(False).alias("kept"))
    rest = found.where("group_size is null").select("_row", "doc_id", "digest")
    new = rest.join(winners(rest), "digest").select("_row", "doc_id", "digest", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"))
    return old.unionByName(new)
