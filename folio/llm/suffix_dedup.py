"""Removal of repeated byte strings by blockwise suffix sorting over a difference cover.

A string of ``length`` bytes that starts at two places anywhere in the corpus goes, at both. Positions of
a difference cover modulo ``v`` are sampled: for any two positions some shift below ``v`` takes both
into the sample, so two equal strings of ``length`` bytes share sampled windows of
``depth = length - v + 1`` bytes. The work goes block by block:

1. Texts are dealt into compressed chunks of about two megabytes, written once.
2. The sampled windows of every chunk, named by hashes of their bytes, go to buckets of the name space;
   a bucket is sorted at a time, and the names found in two places are the ties of the sample.
3. Only suffixes with a tied sampled window can be repeated: all others are in no tie longer than the
   cover allows. The rest are sorted, again a bucket at a time, by the names of their first ``length`` bytes.
4. The chunk turns the repeated suffixes into covered bytes.

Buckets answer a chunk with one bit for each name in the order asked, so no positions travel. A chunk asks for each name
once, with a mark if it holds it twice: a passage in a third of all documents is one name in each
chunk. Memory is bounded by a chunk and a bucket, whatever the corpus; the number of buckets follows it.
Names are pairs of hashes modulo a prime: unequal strings of n bytes share one with probability (n / 2**31)**2 at
most, built ones (periodic, Thue-Morse) included.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; repeated rows are
documents of their own and cover each other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import Windows
from .common import cut, release

CHUNK = 2 << 20
#: Bytes of text whose names one bucket holds.
BUCKET_TEXT = 16 << 20


def difference_cover(r: int) -> tuple[np.ndarray, int]:
    """The cover of ``6r + 4`` residues modulo ``24r**2 + 36r + 13`` (Colbourn and Ling 2000)."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    cover, v = np.cumsum([0, *steps]), 24 * r * r + 36 * r + 13
    if len(np.unique((cover[:, None] - cover[None, :]) % v)) != v:
        raise ValueError("not a difference cover")
    return cover, v


def cover_for(length: int) -> tuple[np.ndarray, int]:
    """The sparsest cover that leaves sampled windows of half the length, so that few ties are shorter than it."""
    if length < 26:
        raise ValueError("length must be 26 bytes at least")
    r = 0
    while 24 * (r + 1) ** 2 + 36 * (r + 1) + 13 <= length // 2:
        r += 1
    return difference_cover(r)


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(chunk, n, ids, lens, blob)``: the texts in compressed chunks, cut."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        first, k = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0
        pack = zstandard.ZstdCompressor(level=9).compress

        def made():
            return pa.RecordBatch.from_arrays(
                [pa.array([first + k]), pa.array([size]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array([len(t) for t in texts], "<i8").tobytes()], pa.binary()), pa.array([pack(b"".join(texts))], pa.binary())],
                ["chunk", "n", "ids", "lens", "blob"],
            )

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(i), texts.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield made()
                    ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield made()

    return cut(d.mapInArrow(run, "chunk long, n long, ids array<long>, lens binary, blob binary"))


class _Chunk:
    """A chunk's bytes, its sampled windows and its suffixes."""

    def __init__(self, lens: bytes, blob: bytes, length: int):
        self.length = length
        self.data = zstandard.ZstdDecompressor().decompress(blob) if blob else b""
        self.buf = np.frombuffer(self.data, np.uint8)
        self.lens = np.frombuffer(lens, "<i8")
        self.ends = np.cumsum(self.lens)
        n = len(self.buf)
        starts = self.ends - self.lens
        local = (np.arange(n, dtype=np.int64) - np.repeat(starts, self.lens)).astype(np.int32)
        self.left = np.repeat(self.lens, self.lens).astype(np.int32) - local
        cover, v = cover_for(length)
        self.depth = length - v + 1
        chosen = np.zeros(v, bool)
        chosen[cover] = True
        self.sampled = np.flatnonzero(chosen[local % v] & (self.left >= self.depth))
        self.windows = Windows(self.buf)
        del local

    def cover_names(self) -> np.ndarray:
        """52 bits are enough: a false tie of the sample makes another candidate, and loses none."""
        return self.windows.of(self.sampled, self.sampled + self.depth) & ~np.uint64(0xFFF)

    def candidates(self, tied: np.ndarray) -> np.ndarray:
        """Starts of suffixes with a tied sampled window in their first ``length`` bytes."""
        n = len(self.buf)
        upto = np.zeros(n + 1, np.int32)
        upto[self.sampled[tied] + 1] = 1
        np.cumsum(upto, out=upto)
        at = np.flatnonzero(self.left >= self.length)
        return at[upto[at + self.length - self.depth + 1] > upto[at]]

    def suffix_names(self, at: np.ndarray) -> np.ndarray:
        return self.windows.of(at, at + self.length)


def _squeezed(sorted_names: np.ndarray) -> bytes:
    """Differences by byte planes, compressed: the upper planes are zeros, the next one is far from even."""
    planes = np.diff(sorted_names, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _ask(chunk: int, names: np.ndarray, bits: int) -> pa.RecordBatch | None:
    """The distinct names of a chunk, by bucket."""
    if not len(names):
        return None
    u, counts = np.unique(names, return_counts=True)
    of = (u >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(u), np.int64)
    at = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(u)]))
    spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(of[at[:-1]]),
            pa.array(np.full(len(spans), chunk, np.int64)),
            pa.array([_squeezed(u[a:b]) for a, b in spans], pa.binary()),
            pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in spans], pa.binary()),
        ],
        ["bucket", "chunk", "names", "twice"],
    )


def _sort_bucket(table: pa.Table) -> pa.Table:
    """Sorts one bucket, and answers each chunk which of its names are in two places."""
    parts = [_unsqueezed(x) for x in table.column("names").to_pylist()]
    size = [len(p) for p in parts]
    names = np.concatenate(parts)
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(table.column("twice").to_pylist(), size, strict=True)]).astype(bool)
    order = np.argsort(names, kind="stable")
    s = names[order]
    same = s[1:] == s[:-1]
    tied = twice[order]
    tied[1:] |= same
    tied[:-1] |= same
    back = np.empty(len(names), bool)
    back[order] = tied
    ends = np.cumsum(size)
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(back[e - n : e]).tobytes() for e, n in zip(ends.tolist(), size, strict=True)], pa.binary()), "n": pa.array(size, pa.int64())})


def _answers(asked: DataFrame, name: str) -> DataFrame:
    """``(chunk, name)``: the answers of all buckets to a chunk, in the order of the buckets, cut."""
    got = asked.groupBy("bucket").applyInArrow(_sort_bucket, "chunk long, bucket long, bits binary, n long")
    got = got.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits", "n"))).alias(name))
    return cut(got)


def _told(names: np.ndarray, answers: list[dict] | None) -> np.ndarray:
    """The answer for each name, from the answers to the distinct ones."""
    if not len(names):
        return np.zeros(0, bool)
    bits = np.concatenate([np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in answers]).astype(bool)
    return bits[np.unique(names, return_inverse=True)[1]]


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    ``with_text`` adds ``kept``, the remaining bytes, and ``spans``, the removed runs as (start, end).
    """
    spark = docs.sparkSession
    chunks = _chunks(docs, id_col, text_col)
    total = chunks.agg(F.sum("n")).first()[0] or 0
    bits = max(4, int(total // BUCKET_TEXT).bit_length())
    ask = "bucket long, chunk long, names binary, twice binary"

    def ask_cover(batches):
        for b in batches:
            for chunk, lens, blob in zip(b.column("chunk").to_pylist(), b.column("lens"), b.column("blob"), strict=True):
                if (out := _ask(chunk, _Chunk(lens.as_py(), blob.as_py(), length).cover_names(), bits)) is not None:
                    yield out

    def ask_suffixes(batches):
        for b in batches:
            for chunk, lens, blob, cover in zip(b.column("chunk").to_pylist(), b.column("lens"), b.column("blob"), b.column("cover"), strict=True):
                c = _Chunk(lens.as_py(), blob.as_py(), length)
                at = c.candidates(_told(c.cover_names(), cover.as_py()))
                if (out := _ask(chunk, c.suffix_names(at), bits)) is not None:
                    yield out

    columns = ["chunk", "lens", "blob"]
    cover = _answers(chunks.select(*columns).mapInArrow(ask_cover, ask), "cover")
    release(spark)
    known = chunks.join(cover, "chunk", "left")
    suffix = _answers(known.select(*columns, "cover").mapInArrow(ask_suffixes, ask), "suffix")
    release(spark)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * with_text
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary(), pa.list_(pa.list_(pa.int64()))] * with_text

    def cover_bytes(batches):
        for b in batches:
            for ids, lens, blob, cover, suffix in zip(*(b.column(c) for c in ("ids", "lens", "blob", "cover", "suffix")), strict=True):
                c = _Chunk(lens.as_py(), blob.as_py(), length)
                at = c.candidates(_told(c.cover_names(), cover.as_py()))
                at = at[_told(c.suffix_names(at), suffix.as_py())]
                edge = np.zeros(len(c.buf) + 1, np.int32)
                edge[at] += 1
                edge[at + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                out = []
                for i, end, n in zip(ids.as_py(), c.ends.tolist(), c.lens.tolist(), strict=True):
                    g = gone[end - n : end]
                    if g.any():
                        runs = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8)))
                        kept = c.buf[end - n : end][~g].tobytes()
                    else:
                        runs, kept = np.zeros(0, np.int64), c.data[end - n : end]
                    out.append((i, n, n - len(kept), len(runs) // 2, hashlib.sha256(kept).hexdigest(), *((kept, runs.reshape(-1, 2).tolist()) if with_text else ())))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    known = chunks.join(cover, "chunk", "left").join(suffix, "chunk", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<array<long>>" * with_text
    return known.select("ids", "lens", "blob", "cover", "suffix").mapInArrow(cover_bytes, schema)
