"""Target-distribution importance resampling over hashed n-grams, ranked by a distributed radix sort.

``weights`` counts the hashed n-grams (``orders`` consecutive words, repeats too) of the corpus and of the target in
a fixed number of buckets. Every bucket has a gain, the scaled log ratio of its two smoothed shares, and a
document weighs the sum of its gains: each task looks them up in an array, for whole blocks of text at once. Noise that
depends on the document's id alone makes the highest scores a draw without replacement.

``radix_ranks`` orders all candidates by least significant digits first. A pass counts the digits of each block
of rows; prefix sums of the counts, over digits and within a digit over blocks, give where each
block's rows of a digit start; with the row's place among them that is its destination. A pass is stable, every
block after it has exactly ``BLOCK`` rows whatever the keys, and passes on digits that don't differ are left out.
The driver sees the counts of buckets and the extremes of the keys; each pass is written to the shared folder.

CRCs of n-grams come from those of words: appending bytes is linear, so two words are joined by a table of shifts.

Defined cases: null or empty texts, and texts without words, have no features and weight 0; texts of fewer than
``min_words`` words are never drawn, but scored; ids of null draw noise as the text ``null`` and rank last of equal
scores; rows tied in score and id rank by their row number; very long texts are read in parts of ``PART``
bytes that hand on their last words; an empty corpus or target gives gains by the smoothing alone; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, with_row

#: Bytes of text handled at once, rows of a block, and bits of a digit.
PART, BLOCK, BITS = 1 << 20, 1 << 16, 12
#: Words up to this length have shift tables; n-grams with longer ones are hashed one by one.
LONG = 63
#: Bytes of words: digits, small letters (texts are lower-cased before) and all beyond ASCII.
_IN = np.zeros(256, bool)
_IN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_BYTE = _byte_table()


def _shift_tables() -> np.ndarray:
    """``[n, k, b]``: what byte ``b`` at place ``k`` of a CRC becomes when ``n`` bytes follow."""
    s = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(LONG + 1):
        s.append(_BYTE[s[-1] & 255] ^ (s[-1] >> np.uint32(8)))
    return np.stack(s)


_SHIFT = _shift_tables()


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = _SHIFT[n, 0, crc & 255]
    for k in range(1, 4):
        out ^= _SHIFT[n, k, (crc >> np.uint32(8 * k)) & 255]
    return out


_SPACE = _shifted(np.full(LONG + 1, zlib.crc32(b" "), np.uint32), np.arange(LONG + 1))


def _word_crcs(data: bytes, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(size <= LONG)
    for i in range(LONG):
        at = at[size[at] > i]
        if not len(at):
            break
        c = crc[at]
        crc[at] = _BYTE[(c ^ buf[start[at] + i]) & 255] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG).tolist():
        crc[i] = zlib.crc32(data[start[i] : start[i] + size[i]])
    return crc


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([False], _IN[buf], [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _ngrams(data: bytes, start: np.ndarray, size: np.ndarray, doc: np.ndarray, orders: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(last word, CRC)`` of the n-grams of each order, which never leave a document."""
    buf = np.frombuffer(data, np.uint8)
    crc = _word_crcs(data, buf, start, size)
    short = np.minimum(size, LONG)
    spaced = _SPACE[short] ^ crc
    last, now = np.arange(len(start)), crc
    yield last, now
    far = size > LONG
    for order in range(2, orders + 1):
        # each n-gram but those at a document's end goes on by the next word
        ok = (last + 1 < len(start)) & (doc[np.minimum(last + 1, len(start) - 1)] == doc[last])
        last, now = last[ok] + 1, now[ok]
        now = _shifted(now, short[last] + 1) ^ spaced[last]
        for i in np.flatnonzero(np.logical_or.reduce([far[last - k] for k in range(order)])).tolist() if far.any() else ():
            words = range(last[i] - order + 1, last[i] + 1)
            now[i] = zlib.crc32(b" ".join(data[start[w] : start[w] + size[w]] for w in words))
        yield last, now


def _parts(texts: list[bytes], orders: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, int]]:
    """``(bytes, starts, sizes, document of each word, words seen before)`` of about ``PART`` bytes each."""

    def made(data: bytes, ends: np.ndarray, number: np.ndarray, seen: int):
        start, stop = _words(np.frombuffer(data, np.uint8))
        return data, start, stop - start, number[np.searchsorted(ends, start, "right")], seen

    group: list[int] = []
    size = 0
    for i, t in enumerate([*texts, None]):
        if group and (t is None or len(t) > PART or size > PART):
            held = [texts[k] for k in group]
            yield made(b"\n".join(held).lower(), np.cumsum([len(x) + 1 for x in held]), np.array(group), 0)
            group, size = [], 0
        if t is None:
            break
        if len(t) <= PART:
            group.append(i)
            size += len(t)
            continue
        at, before, seen = 0, b"", 0
        while at < len(t):
            stop = at + PART
            while stop < len(t) and (_IN[t[stop]] or 65 <= t[stop] <= 90):
                stop += 1
            p = made(before + t[at:stop].lower(), np.array([len(before) + stop - at + 1]), np.array([i]), seen)
            yield p
            tail = range(max(0, len(p[1]) - orders + 1), len(p[1]))
            before, seen, at = b"".join(p[0][p[1][w] : p[1][w] + p[2][w]] + b" " for w in tail), len(tail), stop


def _texts(docs: DataFrame, text_col: str) -> Column:
    return F.encode(F.coalesce(docs[text_col].cast("string"), F.lit("")), "UTF-8").alias("text")


def bucket_counts(docs: DataFrame, buckets: int, orders: int, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for data, start, size, doc, seen in _parts(b.column("text").to_pylist(), orders):
                for last, crc in _ngrams(data, start, size, doc, orders):
                    n += np.bincount(crc[last >= seen] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    counted = docs.select(_texts(docs, text_col)).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many rows as buckets
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the floor of 1000 times the log of the smoothed shares' ratio."""
    s_all, t_all, b = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, orders: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_row, doc_id, n_words, n_features, weight)`` of every document."""
    d = with_row(docs.select(docs[id_col].cast("long").alias("doc_id"), _texts(docs, text_col)))

    def run(batches):
        for b in batches:
            k = b.num_rows
            words, features, weight = (np.zeros(k, np.int64) for _ in range(3))
            for data, start, size, doc, seen in _parts(b.column("text").to_pylist(), orders):
                words += np.bincount(doc[seen:], minlength=k)
                for last, crc in _ngrams(data, start, size, doc, orders):
                    new = last >= seen
                    of, g = doc[last[new]], gain[crc[new] % np.uint32(len(gain))]
                    features += np.bincount(of, minlength=k)
                    # documents come in order: their sums are differences of running sums
                    total = np.concatenate(([0], np.cumsum(g)))
                    edge = np.searchsorted(of, np.arange(k + 1))
                    weight += total[edge[1:]] - total[edge[:-1]]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("doc_id"), *map(pa.array, (words, features, weight))], ["_row", "doc_id", "n_words", "n_features", "weight"])

    return d.mapInArrow(run, "_row long, doc_id long, n_words long, n_features long, weight long")


def _pass(state: DataFrame, digit: Column, block: int) -> DataFrame:
    """One stable counting-sort pass: ``at`` becomes each row's place by the digit."""
    s = state.withColumn("digit", digit)
    n = s.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("digit").agg(F.sum("n").alias("total"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # no more rows than a digit has values
    start = total.select("digit", F.coalesce(F.sum("total").over(before.orderBy("digit")), F.lit(0)).alias("start"))
    earlier = F.coalesce(F.sum("n").over(before.partitionBy("digit").orderBy("block")), F.lit(0))
    offset = n.select("block", "digit", earlier.alias("earlier")).join(start, "digit").select("block", "digit", (F.col("start") + F.col("earlier")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("block", "digit").orderBy("at")) - 1
    moved = s.withColumn("place", place).join(offset, ["block", "digit"]).withColumn("at", F.col("offset") + F.col("place"))
    return cut(moved.withColumn("block", F.expr(f"at div {block}")).select(*state.columns))


def radix_ranks(rows: DataFrame, keys: list[str], bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """``(_row, rank)``: the place of each row of ``rows(_row, *keys)`` by its keys, long columns without
    nulls and all ascending, the first key foremost; from 1. Equal keys are ranked by ``_row``.

    ``_row`` is what ``with_row`` gives: its upper bits name the first blocks.
    """
    ends = rows.agg(*(f(k).alias(f"{n}_{k}") for k in keys for n, f in (("min", F.min), ("max", F.max)))).first()
    block_of = F.shiftright("_row", 33)
    state = rows.select("_row", *keys, F.col("_row").alias("at"), block_of.alias("block"))
    if ends[f"min_{keys[0]}"] is None:
        return state.select("_row", F.col("at").alias("rank"))
    passes = 0
    for k in reversed(keys):
        span = ends[f"max_{k}"] - ends[f"min_{k}"]
        # as an unsigned number: the difference to the smallest, or where that leaves the range, the bits in unsigned order
        u, width = (F.col(k) - ends[f"min_{k}"], span.bit_length()) if span < 1 << 63 else (F.col(k).bitwiseXOR(F.lit(-(1 << 63))), 64)
        for low in range(0, width, bits):
            digit = F.shiftrightunsigned(u, low).bitwiseAND((1 << bits) - 1)
            state = _pass(state, digit.cast("int"), block)
            passes += 1
    if not passes:  # all keys are equal
        state = _pass(state, F.lit(0), block)
    return state.select("_row", (F.col("at") + 1).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), min_words: int = 20, buckets: int = 10_000, orders: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """``(_row, doc_id, n_features, weight, score, rank)`` of every document; ``rank`` of those drawn, else null.

    Drawn are ``share`` of the documents with at least ``min_words`` words.
    """
    gain = gains(bucket_counts(docs, buckets, orders, text_col), bucket_counts(target, buckets, orders, target_col))
    d = weights(docs, gain, orders, id_col, text_col)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    d = cut(d.withColumn("score", F.col("weight") + noise))

    able = d.where(F.col("n_words") >= min_words)
    last = F.col("doc_id").isNull().cast("long")
    ranks = radix_ranks(able.select("_row", (-F.col("score")).alias("low"), last.alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id")), ["low", "last", "id"])
    drawn = able.count() * share[0] // share[1]
    return d.join(ranks.where(F.col("rank") <= drawn), "_row", "left").select("_row", "doc_id", "n_features", "weight", "score", "rank")
