"""Source divergence audit by chunk factorization.

Terms (runs of letters) never cross white space, so a text's counts are those of its white-space chunks.

1. Each document's chunks are counted. Within a task, the counts of a chunk in documents of one group are
   summed as soon as ``min_docs`` documents hold it; a rarer chunk keeps a row for each of its documents.
2. Chunks meet by an exchange. The first row of each globally distinct chunk tokenizes it, and its terms
   are joined back to all rows of the chunk. A chunk found in ``min_docs`` documents of a language no longer needs its documents.
3. Terms meet by language and term: occurrences are summed by source, and distinct documents counted
   over what chunks of that term still name. Only terms in ``min_docs`` documents of their language go on.
4. Blocks of terms with the counts of all sources are compared in the worker, in 64-bit whole numbers.

Nothing is sampled or capped; a hot chunk or term is a row a task and group, and a hot group is only a column
of the blocks. A block holds at most ``CELLS`` counts, or one term of all sources.

Defined cases: null text, language and source count as empty; a group or text without terms counts 0 of every
term; repeated rows and ids are documents of their own; a very long text is split in the worker, one at a time;
ties are ordered by the item's bytes; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, with_row

#: What ends a term, of the characters below 128: everything but letters.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text split at once, entries held before a task hands on its sums, and counts in a block of terms.
BYTES, ENTRIES, CELLS = 2 << 20, 4_000_000, 1 << 20
#: Shares are out of so many, kept exact as a product of two factors.
ONE = 1_000_000_000
_FACTORS = (32_000, 31_250)


def _slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``BYTES`` bytes."""
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(text):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + BYTES, "right")))
        yield start, stop
        start = stop


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts ``key``, and the starts and lengths of its runs."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return order, start, np.diff(np.append(start, len(s)))


def _named(lang: pa.Array, source: pa.Array, names: dict[tuple[str, str], int]) -> np.ndarray:
    """The number of each row's group; new groups are added to ``names``."""
    a, b = pc.dictionary_encode(lang), pc.dictionary_encode(source)
    both, of = np.unique(a.indices.to_numpy().astype(np.int64) * max(1, len(b.dictionary)) + b.indices.to_numpy(), return_inverse=True)
    found = [(a.dictionary[k // len(b.dictionary)].as_py(), b.dictionary[k % len(b.dictionary)].as_py()) for k in both.tolist()]
    return np.array([names.setdefault(x, len(names)) for x in found], np.int64)[of]


def _summed(held: list[tuple], names: dict[tuple[str, str], int], min_docs: int) -> Iterator[pa.RecordBatch]:
    """The rows of what a task holds: ``(chunks, code, group, occurrences, document)`` of several slices."""
    words = pc.dictionary_encode(pa.concat_arrays([h[0] for h in held]))
    # codes of each slice become codes of the task
    chunk, at = [], 0
    for w, code, *_ in held:
        chunk.append(words.indices.to_numpy()[at : at + len(w)][code].astype(np.int64))
        at += len(w)
    chunk, group, occ, row = (np.concatenate(x) for x in (chunk, *([h[k] for h in held] for k in (2, 3, 4))))
    held.clear()  # else the slices stay beside their concatenation until the last row is out
    langs, sources = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
    order, start, docs = _runs(group * len(words.dictionary) + chunk)
    total = np.add.reduceat(occ[order], start) if len(start) else occ
    common = docs >= min_docs
    single = order[np.repeat(~common, docs)]
    first = order[start[common]]
    pick = np.concatenate((first, single))
    n = np.concatenate((total[common], occ[single]))
    r = pa.array(np.concatenate((np.zeros(len(first), np.int64), row[single])), mask=np.arange(len(pick)) < len(first))
    # in the order of chunks, neighbours are alike and shuffle files small
    pick_order = np.argsort(pc.rank(words.dictionary, "ascending", tiebreaker="dense").to_numpy()[chunk[pick]], kind="stable")
    for a in range(0, len(pick), 200_000):
        o = pick_order[a : a + 200_000]
        g = pa.array(group[pick[o]])
        yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), words.dictionary.take(pa.array(chunk[pick[o]])), pa.array(n[o]), r.take(pa.array(o))], ["lang", "source", "chunk", "n", "doc"])


def chunk_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, source, chunk, n, doc)`` of ``docs(_row, lang, source, text)``: ``n`` occurrences in the document
    ``doc``, or, where that is null, in at least ``min_docs`` documents."""

    def run(batches):
        held, size, names = [], 0, {}
        for b in batches:
            text, row, group = b.column("text"), b.column("_row").to_numpy(), _named(b.column("lang"), b.column("source"), names)
            for lo, hi in _slices(text):
                w = pc.ascii_split_whitespace(text.slice(lo, hi - lo))
                flat, of = w.flatten(), pc.list_parent_indices(w).to_numpy().astype(np.int64)
                full = pc.greater(pc.binary_length(flat), 0)
                d = pc.dictionary_encode(flat.filter(full))
                of = of[full.to_numpy(zero_copy_only=False)]
                k = max(1, len(d.dictionary))
                key, n = np.unique(of * k + d.indices.to_numpy(), return_counts=True)
                if len(key):
                    held.append((d.dictionary, key % k, group[lo:hi][key // k], n, row[lo:hi][key // k]))
                    size += len(key)
                if size >= ENTRIES:
                    yield from _summed(held, names, min_docs)
                    held, size = [], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield from _summed(held, names, min_docs)
        # the worker lives on, and so would what it holds
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, "lang string, source string, chunk string, n long, doc long")


def term_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, term, counts)``: of each term in ``min_docs`` documents of its language, the occurrences by source."""
    a = chunk_counts(docs, min_docs).repartition("chunk")
    here = Window.partitionBy("chunk").orderBy("lang")
    a = a.withColumn("first", F.row_number().over(here) == 1)
    low = F.translate("chunk", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    a = a.withColumn("terms", F.when(F.col("first"), F.regexp_extract_all(low, F.lit(TERM), F.lit(0))))
    a = a.withColumn("terms", F.first("terms", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    common = F.max(F.col("doc").isNull()).over(Window.partitionBy("chunk", "lang")) | (F.count("doc").over(Window.partitionBy("chunk", "lang")) >= min_docs)
    a = a.withColumn("common", common).withColumn("doc", F.when(~F.col("common"), F.col("doc")))
    t = a.select("lang", "source", "n", "doc", F.explode("terms").alias("term")).repartition("lang", "term")
    nth = F.dense_rank().over(Window.partitionBy("lang", "term").orderBy("doc"))  # nulls come first
    t = t.withColumn("enough", F.col("doc").isNull() | (nth >= min_docs))
    t = t.withColumn("kept", F.max("enough").over(Window.partitionBy("lang", "term"))).where("kept")
    t = t.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    # as many entries as the language has sources at most
    return t.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("counts"))


def shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``1 + floor(ONE * n / of)`` without overflow, for ``n <= of < 2**48``."""
    q, r = np.divmod(n * _FACTORS[0], of)
    return 1 + q * _FACTORS[1] + (r * _FACTORS[1]) // of


def _compare(terms: pa.Table, totals: pa.Table, top: int) -> pa.Table:
    """A block: sums of each two sources, and the ``top`` terms of each source within the block."""
    out: dict[str, list] = {k: [] for k in ("lang", "source", "part", "item", "value")}
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not terms.num_rows:
        return schema.empty_table()
    lang = terms.column("lang")[0].as_py()
    source = totals.column("source").to_pylist()
    at = {s: k for k, s in enumerate(source)}
    size = totals.column("n").to_numpy() + totals.column("v").to_numpy()
    counts = terms.column("counts").combine_chunks()
    flat = counts.flatten()
    encoded = pc.dictionary_encode(flat.field(0))
    to = np.array([at[s] for s in encoded.dictionary.to_pylist()], np.int64)
    n = np.zeros((terms.num_rows, len(source)), np.int64)
    n[pc.list_parent_indices(counts).to_numpy(), to[encoded.indices.to_numpy()]] = flat.field(1).to_numpy()
    p = shares(n + 1, size)
    every = int(totals.column("lang_n")[0].as_py() + totals.column("v")[0].as_py())
    q = shares(n.sum(axis=1) + 1, np.int64(every))

    def add(s: str, part: str, items: list[str], values: list[int]) -> None:
        for k, v in (("lang", [lang] * len(items)), ("source", [s] * len(items)), ("part", [part] * len(items)), ("item", items), ("value", values)):
            out[k] += v

    pair = np.zeros((len(source), len(source)), np.int64)
    for h in range(len(source)):
        d = p - p[:, h : h + 1]
        pair[:, h] = (d * d // p[:, h : h + 1]).sum(axis=0)
    names = terms.column("term")
    for g, s in enumerate(source):
        add(s, "pair", source[:g] + source[g + 1 :], np.delete(pair[g], g).tolist())
        k = np.flatnonzero((n[:, g] > 0) & (p[:, g] > q))
        d = p[k, g] - q[k]
        f = d * d // q[k]
        if len(k) > top:
            least = np.partition(f, len(f) - top)[len(f) - top]
            k, f = k[f >= least], f[f >= least]
        word = [names[i].as_py() for i in k.tolist()]
        best = sorted(zip((-f).tolist(), (w.encode() for w in word), word))[:top]
        add(s, "term", [w for _, _, w in best], [-v for v, _, _ in best])
    return pa.Table.from_pydict(out, schema)


def divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: of each source the other sources of its language by their
    divergence (part ``pair``), and the ``top`` terms that it has more often than its language (part ``term``)."""
    plain = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    d = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    counts = cut(term_counts(with_row(d), min_docs))
    groups = d.select("lang", "source").distinct()

    held = counts.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    v = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = groups.join(held, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    of_lang = totals.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("sources"))
    of_lang = of_lang.join(v, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    blocks = F.ceil(F.col("v") * F.col("sources") / CELLS).cast("long")
    totals = cut(totals.join(of_lang.withColumn("blocks", blocks), "lang"))

    langs = totals.select("lang", "blocks").distinct()
    terms = counts.join(langs, "lang").select("lang", "term", "counts", F.pmod(F.xxhash64("term"), "blocks").alias("block"))
    heads = totals.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    found = terms.groupBy("lang", "block").cogroup(heads.groupBy("lang", "block")).applyInArrow(
        lambda x, y: _compare(x, y, top), "lang string, source string, part string, item string, value long"
    )
    found = cut(found)

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = totals.select("lang", "source").join(totals.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(term.select("lang", "source", "part", "item", "value", "rank"))
