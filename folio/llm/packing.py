"""Best-fit packing of documents into sequences, as vector bin packing.

A piece needs tokens, one document place and attention cost (the square of its length). A bin's
residual capacities are a vector of the three; every constraint must hold for a piece to enter, and
among all open bins that admit it the one with the largest weighted dot product of demand and residual, or
the smallest weighted norm of what it leaves, is taken. Full pieces are sequences at once.

Pieces are dealt by hash to shards of about ``SHARD`` pieces, each packed in one task in decreasing
order of length; what stays under-filled in the shards is gathered per ``MERGE`` shards and packed again, so
that the loss is below one bin in some hundred, while no task holds more than a bounded number of
pieces, whatever the size of the corpus.

Defined cases: null text is the terminator alone; empty texts too; very long texts become as many pieces as they
need; repeated rows are documents of their own; ties are broken by row number; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, with_row

SHARD, MERGE = 60_000, 20
#: Words kept by a worker with their ids, in two halves: a full one becomes the older, and words that come again move on.
CACHE = 600_000
#: ASCII punctuation that never begins a contraction.
MARKS = b"!#$%&()*+,-./:;<=>?@[]^_`{|}~"
_kept: dict[str, tuple[object, list[dict[bytes, bytes]], list[bytes]]] = {}


def _tokenizer(path: str):
    """The tokenizer, this worker's words, newer and older ones, and the tokens added to the vocabulary, in lower case."""
    if path not in _kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        _kept[path] = (t, [{}, {}], [x.content.encode().lower() for x in t.get_added_tokens_decoder().values()])
    return _kept[path]


def _encoded(words: set[bytes], cache: dict[bytes, bytes], older: dict[bytes, bytes], tokenizer) -> None:
    """Puts the ids of words into the cache, from the older one where it has them.

    Letters and the punctuation after them are split before the merges too, so both parts of a word
    are encoded once for all words that share them.
    """
    split, new = [], set()
    for w in words:
        if (ids := older.get(w)) is not None:
            cache[w] = ids
            continue
        core = w.rstrip(MARKS)
        # the last character as the vocabulary sees it; lower case may end in a mark
        if core and len(core) < len(w) and (97 <= core[-1] <= 122 or core.decode().lower()[-1].isalpha()):
            tail = w[len(core) :]
            split.append((w, core, tail))
            new.add(core), new.add(tail)
        else:
            new.add(w)
    cache.update((x, older[x]) for x in new if x in older)
    new = [x for x in new if x not in cache]
    for x, e in zip(new, tokenizer.encode_batch_fast([x.decode() for x in new], add_special_tokens=False), strict=True):
        ids = e.ids
        cache[x] = struct.pack(f"<{len(ids)}I", *ids)
    for w, core, tail in split:
        cache[w] = cache[core] + cache[tail]


def token_bytes(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text, by a vocabulary that lower-cases and drops white space.

    It splits at white space before its merges, so a word's ids don't depend on its neighbours: each
    distinct word is encoded once and kept. Added tokens, such as the terminator's, are found before that,
    inside words too and by case: a text that may hold one is encoded whole.
    """
    tokenizer, kept, added = _tokenizer(path)
    for text in texts:
        low = text.lower()
        if any(x in low for x in added):
            yield np.array(tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            continue
        words = low.split()
        if new := set(words).difference(kept[0]):
            if len(kept[0]) + len(new) > CACHE // 2:
                kept[:] = {}, kept[0]
                new = set(words)
            _encoded(new, *kept, tokenizer)
        yield b"".join(map(kept[0].__getitem__, words))


def pieces(docs: DataFrame, vocabulary: str, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_row, doc_id, piece, start, length, ids_crc32)``, cut."""
    d = with_row(docs.select(docs[id_col].cast("long").alias("doc_id"), F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8").alias("text")))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        for b in slices(batches):
            rows, ids, out = b.column("_row").to_pylist(), b.column("doc_id").to_pylist(), []
            for row, doc, data in zip(rows, ids, token_bytes(b.column("text").to_pylist(), vocabulary), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * max_tokens)):
                    part = data[at : at + 4 * max_tokens]
                    out.append((row, doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["_row", "doc_id", "piece", "start", "length", "ids_crc32"])
        # the worker lives on, and so would what it holds
        pa.default_memory_pool().release_unused()

    return cut(d.mapInArrow(run, "_row long, doc_id long, piece int, start long, length long, ids_crc32 long"))


class Bins:
    """Open bins by their residual tokens, documents and cost; bins of equal residuals are as good as one."""

    def __init__(self, tokens: int, docs: int, cost: float, weights: tuple[float, float, float], rule: str):
        self.cap, self.rule = (tokens, docs, cost), rule
        self.scale = tuple(w / (c * c) for w, c in zip(weights, self.cap, strict=True))
        self.levels: list[dict[tuple[int, float], list[int]]] = [{} for _ in range(tokens + 1)]
        self.open = 0  # a bit for each level with bins
        self.bins = 0

    def _best(self, need: tuple[int, int, float]) -> tuple[int, tuple[int, float]] | None:
        """Level and other residuals of the best bin that admits a piece under every constraint."""
        (n, _, cost), (wt, wd, wc), norm = need, self.scale, self.rule == "norm"
        best, at = None, None
        mask = self.open >> n << n
        while mask:
            level = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            own = wt * (level - n) ** 2
            if norm and at is not None and own >= at:
                break  # levels beyond leave more tokens alone than the best does in all
            for docs, left in self.levels[level]:
                if docs >= 1 and left >= cost:
                    # of demand and residual as shares of the capacities: the norm of what is left, or the product
                    score = own + wd * (docs - 1) ** 2 + wc * (left - cost) ** 2 if norm else -(wt * n * level + wd * docs + wc * cost * left)
                    if at is None or score < at:
                        best, at = (level, (docs, left)), score
        return best

    def place(self, length: int) -> int:
        need = (length, 1, float(length) ** 2)
        found = self._best(need)
        if found is None:
            level, (docs, left), bin_ = *(self.cap[0], self.cap[1:]), self.bins
            self.bins += 1
        else:
            level, (docs, left) = found
            bin_ = self.levels[level][docs, left].pop()
            if not self.levels[level][docs, left]:
                del self.levels[level][docs, left]
                if not self.levels[level]:
                    self.open &= ~(1 << level)
        level, docs, left = level - length, docs - 1, left - need[2]
        if level > 0 and docs > 0:
            self.levels[level].setdefault((docs, left), []).append(bin_)
            self.open |= 1 << level
        return bin_


def _pack(lengths: np.ndarray, **kw) -> np.ndarray:
    """The bin of each piece, by decreasing length."""
    bins, out = Bins(**kw), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        out[i] = bins.place(int(lengths[i]))
    return out


def _packer(kw: dict, full_from: float):
    """Packs a shard; bins filled below ``full_from`` are marked open."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["_row", "piece"])
        b = _pack(p["length"].to_numpy(), **kw)
        fill = np.bincount(b, weights=p["length"], minlength=1)
        return p.assign(bin=b, open=fill[b] < full_from * kw["tokens"])[["_row", "piece", "length", "shard", "bin", "open"]]

    return run


def pack(
    docs: DataFrame,
    vocabulary: str,
    max_tokens: int = 2048,
    max_docs: int = 2048,
    max_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4),
    rule: str = "norm",
    **columns: str,
) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``max_docs`` and ``max_cost`` are the other two capacities; their defaults, one document a token
    and the square of the sequence, never bind, so that the fewest sequences come out; the small weights let
    them decide among bins that are about equally tight in tokens. ``rule``: ``norm`` or ``dot``.
    """
    kw = {"tokens": max_tokens, "docs": max_docs, "cost": float(max_cost or max_tokens**2), "weights": weights, "rule": rule}
    p = pieces(docs, vocabulary, max_tokens, **columns)
    whole = p.where(F.col("length") == max_tokens)
    parts = p.where(F.col("length") < max_tokens).select("_row", "piece", "length")
    shards = max(1, -(-parts.count() // SHARD))
    schema = "_row long, piece int, length long, shard long, bin long, open boolean"
    first = parts.withColumn("shard", F.pmod(F.xxhash64("_row", "piece"), F.lit(shards)))
    first = cut(first.groupBy("shard").applyInPandas(_packer(kw, 0.995), schema))
    again = first.where("open").select("_row", "piece", "length", F.pmod(F.xxhash64("_row"), F.lit(-(-shards // MERGE))).alias("shard"))
    again = again.groupBy("shard").applyInPandas(_packer(kw, 0.0), schema)
    placed = first.where("not open").withColumn("turn", F.lit(1)).unionByName(again.withColumn("turn", F.lit(2)))
    # each sequence is at most max_docs rows, so this window is bounded
    before = F.expr("coalesce(sum(length) over (partition by turn, shard, bin order by _row, piece rows between unbounded preceding and 1 preceding), 0)")
    # the lowest bit: not a whole piece alone; the next: the turn; then 30 bits of the bin
    key = F.expr("shiftleft(shard, 32) + shiftleft(bin, 2) + (turn - 1) * 2")
    placed = placed.select("_row", "piece", key.alias("sequence_id"), before.alias("offset"))
    alone = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    joined = p.where(F.col("length") < max_tokens).join(placed, ["_row", "piece"])
    return alone.unionByName(joined.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
