"""Quality rules by tokenizer fertility.

A public vocabulary measures every whole text: characters per token, the share of byte-fallback tokens
and the entropy of its tokens relative to the most that as many tokens could have. The vocabulary never joins
words, so each distinct word, marks included, is encoded once for each worker.

Rejection bands follow the corpus: for every language, or script where the language is null, quartiles of
the measures over all documents that pass the base rules, widened by ``WIDTH`` interquartile ranges. The
quartiles come from mergeable sketches, so a language with most of the rows is aggregated before its
shuffle. Groups of fewer than ``FEW`` documents use the bands of all documents.

Defined cases: null text has no words; very long texts are measured whole; texts without words fail the base rules; repeated rows are
judged row by row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WIDTH, FEW, CACHE = 3.0, 20, 800_000
SYMBOLS = "#*$%&|<>"
SCRIPTS = ("arabic", "cyrillic", "greek", "han", "hebrew", "latin", "other")
MEASURES = ("chars_per_token", "byte_share", "entropy")
_kept: dict[str, tuple] = {}


def _pieces(path: str):
    if path not in _kept:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        fallback = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        _kept[path] = (model, fallback, {})
    return _kept[path]


def _ids(words: list[bytes], path: str) -> np.ndarray:
    model, _, cache = _pieces(path)
    if new := {w for w in words if w not in cache}:
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = set(words)
        new = list(new)
        for w, ids in zip(new, model.encode([w.decode() for w in new], num_threads=1), strict=True):
            cache[w] = np.array(ids, "<i4").tobytes()
    return np.frombuffer(b"".join(map(cache.__getitem__, words)), "<i4")


def repeated_words(words: list[bytes], k: int = 3) -> int:
    """Words in ``k``-word windows that are found twice or more."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[:n]
    for j in range(1, k):
        # windows so far, numbered densely, times the next word
        key = np.unique(key, return_inverse=True)[1] * len(number) + ids[j : n + j]
    _, of, count = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(count[of] > 1)
    edge[at] += 1
    edge[at + k] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


@functools.cache
def _scripts() -> np.ndarray:
    """Of every code point the place of its script in ``SCRIPTS``; of those that aren't letters, one beyond."""
    out = np.full(0x110000, len(SCRIPTS), np.uint8)
    for o in range(0x110000):
        if chr(o).isalpha():
            s = "latin" if o < 0x250 else "greek" if o < 0x400 else "cyrillic" if o < 0x530 else "hebrew" if 0x590 <= o < 0x600 else "arabic" if 0x600 <= o < 0x780 else "han" if 0x3040 <= o < 0xA000 else "other"
            out[o] = SCRIPTS.index(s)
    return out


def _script(text: str) -> str:
    """The script of most letters of the whole text, by blocks; ties go to the smaller name."""
    count = np.zeros(len(SCRIPTS) + 1, np.int64)
    for a in range(0, len(text), 1 << 20):
        count += np.bincount(_scripts()[np.frombuffer(text[a : a + (1 << 20)].encode("utf-32-le"), "<u4")], minlength=len(count))
    return SCRIPTS[int(count[:-1].argmax())] if count[:-1].any() else "none"


def measure(text: str | None, path: str) -> tuple:
    """The base counts and the measures of one text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    buf = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((buf & 0xC0) != 0x80).sum())
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif line.encode().split():
            seen.add(line)
    ids = _ids(words, path)
    n = len(ids)
    if n:
        _, counts = np.unique(ids, return_counts=True)
        p = counts / n
        entropy = float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else 0.0
        measures = (chars / n, float(_pieces(path)[1][ids].mean()), entropy)
    else:
        measures = (None, None, None)
    return (len(words), chars, sum(map(text.count, SYMBOLS)), dups, repeated_words(words), *measures)


def quality(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: the counts, the measures, ``base_failed``, ``kept`` and the failed measures."""
    d = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    ints = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            rows = list(zip(*(measure(t, vocabulary) for t in texts), strict=True)) or [()] * 8
            groups = [x if x is not None else _script(t or "") for x, t in zip(langs, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(groups, pa.string()), *(pa.array(r, pa.int64()) for r in rows[:5]), *(pa.array(r, pa.float64()) for r in rows[5:])], ["doc_id", "band", *ints, *MEASURES])

    schema = f"doc_id {kind}, band string, " + ", ".join(f"{c} long" for c in ints) + ", " + ", ".join(f"{c} double" for c in MEASURES)
    d = cut(d.mapInArrow(run, schema))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    quartiles = lambda g: g.agg(F.count(F.lit(1)).alias("docs"), *(F.percentile_approx(c, [0.25, 0.75], 10000).alias(f"q_{c}") for c in MEASURES))
    good = d.where("not base_failed")
    # one grouping set for each band and one for all
    bands = cut(quartiles(good.select("band", *MEASURES).rollup("band")).withColumn("everything", F.col("band").isNull()))
    every = bands.where("everything").select(*(F.col(f"q_{c}").alias(f"all_{c}") for c in MEASURES))
    own = bands.where(~F.col("everything") & (F.col("docs") >= FEW)).select("band", *(f"q_{c}" for c in MEASURES))
    d = d.join(own, "band", "left").join(F.broadcast(every), how="left")  # a single row
    outside = []
    for c in MEASURES:
        q = F.coalesce(F.col(f"q_{c}"), F.col(f"all_{c}"))
        low, high = q[0], q[1]
        # at least a fiftieth of the upper quartile wide, so that uniform groups don't reject trifles
        reach = WIDTH * F.greatest(high - low, F.abs(high) / 50, F.lit(0.005))
        out = (F.col(c) > high + reach) if c == "byte_share" else ((F.col(c) < low - reach) | (F.col(c) > high + reach))
        outside.append(F.when(out, F.lit(c)))
    d = d.withColumn("outside", F.array_compact(F.array(*outside)))
    return d.select("doc_id", *ints, *MEASURES, "base_failed", (~F.col("base_failed") & (F.size("outside") == 0)).alias("kept"), "outside")
