"""Toxicity by weak supervision.

1. ``mine``: the invented languages of the corpus have no public lexicons, so words and word beginnings that
   stand out in toxic rows are taken from three quarters of a bounded sample of labelled rows, the development part.
   They are dealt into several lexicons by hash, so that the lexicon voters rest on different entries; a small
   fixed lexicon and patterns of address are further voters.
2. Every voter looks at every whole text of the corpus and votes 1 or 0. Only the counts of vote patterns, at
   most 2 to the number of voters, are gathered.
3. ``LabelModel``: EM on those counts estimates the share of toxic documents and the accuracies of the
   voters. The given label of the last quarter is a voter too, which abstains elsewhere; its accuracy is
   estimated like the others'. Voters still dependent given the label are grouped by their conditional
   correlation, and a group of size g with mean correlation r counts as ``g / (1 + (g - 1) r)`` independent ones.
4. ``fit``: a linear classifier on hashed words and word beginnings, trained on the posterior labels of
   the sampled rows. There a voter that doesn't vote abstains: lexicons know a part of the words only, so their
   silence says nothing against the label. Lexicon entries start from the evidence that the label model
   gives their voter, so that rare ones keep a weight unless rows speak against it. Shards of at most
   ``SHARD`` features train apart, and each weight is averaged by how often its feature was seen in them.
5. Every whole text gets the logistic score of its distinct features.

``SAMPLE`` bounds the labelled rows of steps 1 and 4; the sample is the rows of smallest hash. All else
covers all rows. Language, source and id are inputs of nothing.

Defined cases: null and empty texts score by the intercept alone; very long texts count with all their words;
repeated ids are scored row by row; null ids are scored and train nothing; labels are joined by id, and rows with no
label, a null label or two contradicting labels train nothing; with no labelled rows the fixed lexicon decides; an
empty table gives an empty result; extra columns are ignored, or handed on where ``keep`` names them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, with_row

SAMPLE, BITS, LEXICONS, PREFIXES = 40_000, 18, 4, (4, 5, 6)
#: Entries of all mined lexicons at most, those of most toxic rows; features that one shard of the training holds.
ENTRIES, SHARD = 4096, 1 << 22
#: Of so many parts of the sample, one tells the accuracy of the label; lexicons come from the others.
PARTS = 4
#: Common insults of English.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "pathetic", "scum", "worthless", "trash", "garbage", "clown", "disgusting", "dumb", "jerk", "filth", "vermin", "imbecile", "fool")
#: Patterns of direct abuse.
PATTERNS = (r"\b(?:you|they|those people)(?: are|'re) (?:an? |all |such )?(?:%s)\b" % "|".join(INSULTS), r"\b(?:shut up|go to hell|hate (?:you|them)|kill yourself)\b")

#: Of each pattern, substrings of which every match holds one.
GUARDS = (tuple(w for w in INSULTS if not any(x in w for x in INSULTS if x != w)), ("shut up", "go to hell", "hate you", "hate them", "kill yourself"))

#: ASCII punctuation, digits and white space part words; the rest of the text, in lower case, stays.
_PART = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def _words(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode().translate(_PART).split())


def _features(word: bytes) -> list[bytes]:
    """The word, and its beginnings in characters, marked as such."""
    w = word.decode()
    return [word, *(w[:n].encode() + b"*" for n in PREFIXES if len(w) > n)]


def _slot(feature: bytes) -> int:
    return zlib.crc32(feature) >> (32 - BITS)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE) -> DataFrame:
    """``(_id, text, label)``: at most so many labelled rows, of the smallest hashes, held-out ones never.

    The chosen ids are at most ``rows``, so they are broadcast.
    """
    y = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("label")).where("label in (0, 1)")
    y = y.where(~F.coalesce(held_out(F.col("_id")), F.lit(True)))
    y = y.groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    few = y.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text")).join(F.broadcast(few), "_id").orderBy(F.xxhash64("_id"), "_id").limit(rows).select("_id", "text", "label")


def mine(rows: DataFrame, odds: float = 12.0, share: float = 0.02, sure: float = 2.0, errors: float = 2.5) -> list[tuple[bytes, int]]:
    """``(feature, lexicon)`` of features in toxic ``rows(text, label)`` at least ``odds`` times as often as in the
    others, and still ``sure`` times when the log odds are taken so many standard ``errors`` lower. They are in
    at least ``share`` of the toxic rows: what few hold may be the words of a group of near copies.

    Toxic rows are counted by slot first, so that the tasks hold and sum those features only whose slot is in
    enough of them; at most ``ENTRIES`` come back.
    """
    n = rows.agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")).first()
    if not n.n1:
        return []
    least = max(4, share * n.n1)

    def toxic(batches):
        total = np.zeros(1 << BITS, np.int64)
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                total[_slots(text, {})] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    slots = rows.where("label = 1").select("text").mapInArrow(toxic, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    held = rows.sparkSession.sparkContext.broadcast(frozenset(r.slot for r in slots.where(F.col("n") >= least).collect()))  # at most 2**BITS

    def run(batches):
        count: dict[bytes, list[int]] = {}
        for b in slices(batches):
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                for f in {f for w in _words(text) for f in _features(w) if _slot(f) in held.value}:
                    count.setdefault(f, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), *(pa.array([x[k] for x in count.values()], pa.int64()) for k in (1, 0))], ["feature", "n1", "n0"])

    g = rows.select("text", "label").mapInArrow(run, "feature binary, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    log = F.log(((F.col("n1") + 0.5) / (n.n1 + 1)) / ((F.col("n0") + 0.5) / (n.n0 + 1)))
    low = log - errors * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    g = g.where((F.col("n1") >= least) & (log >= math.log(odds)) & (low >= math.log(sure))).orderBy(F.col("n1").desc(), "feature").limit(ENTRIES)
    chosen = [bytes(r.feature) for r in g.collect()]
    # a beginning says what the words below it say: the shortest is kept
    short = {f[:-1] for f in chosen if f.endswith(b"*")}
    word = {f: f.rstrip(b"*").decode() for f in chosen}
    return sorted((f, _slot(f) % LEXICONS) for f, w in word.items() if not any(w[:k].encode() in short and len(w) > k for k in PREFIXES))


class Voters:
    """Lexicon voters, the fixed lexicon, and the patterns."""

    def __init__(self, lexicon: list[tuple[bytes, int]]):
        self.words = {f: 1 << k for f, k in lexicon if not f.endswith(b"*")}
        self.starts = {f[:-1].decode(): 1 << k for f, k in lexicon if f.endswith(b"*")}
        self.fixed = {w.encode() for w in INSULTS}
        self.patterns = [re.compile(p) for p in PATTERNS]
        self.n = LEXICONS + 1 + len(self.patterns)
        self.kept: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        w = word.decode()
        bits = self.words.get(word, 0) | (1 << LEXICONS) * (word in self.fixed)
        for n in PREFIXES:
            bits |= self.starts.get(w[:n], 0) if len(w) > n else 0
        return bits

    def vote(self, text: str | None) -> int:
        out = 0
        for w in _words(text):
            if (b := self.kept.get(w)) is None:
                if len(self.kept) > 100_000:
                    self.kept.clear()
                b = self.kept[w] = self._word(w)
            out |= b
        low = (text or "").lower()
        for k, (p, guard) in enumerate(zip(self.patterns, GUARDS, strict=True)):
            out |= (1 << (LEXICONS + 1 + k)) * (any(g in low for g in guard) and bool(p.search(low)))
        return out


class LabelModel:
    """Two classes, voters that vote 1 or 0 and a label that may be missing, fitted by EM to ``(votes, label, count)``."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, n: int, label: np.ndarray | None = None, rounds: int = 100):
        x = (votes[:, None] >> np.arange(n)) & 1
        w = counts / max(1.0, counts.sum())
        label = np.full(len(votes), -1) if label is None else label
        known, on = w * (label >= 0), (label == 1).astype(float)
        q = np.where(x.sum(axis=1) >= 1, 0.9, 0.02)
        self.weight, self.label_hit, self.label_false = np.ones(n), 0.5, 0.5
        for turn in range(rounds):
            self.share = float(np.clip((w * q).sum(), 1e-4, 0.5))
            on1, on0 = (w * q) @ x, (w * (1 - q)) @ x
            self.hit = np.clip(on1 / max((w * q).sum(), 1e-9), 1e-3, 1 - 1e-3)
            self.false = np.clip(on0 / max((w * (1 - q)).sum(), 1e-9), 1e-4, 0.5)
            if known.any():
                self.label_hit, self.label_false = (float(np.clip((known * p) @ on / max((known * p).sum(), 1e-9), 1e-3, 1 - 1e-3)) for p in (q, 1 - q))
            if turn in (0, 3, 10, 30):
                self.weight = self._weights(x, w, q)
            q = self.posterior(votes, label)

    def _weights(self, x: np.ndarray, w: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of each voter the share of an independent one, from correlations given the label."""
        n = x.shape[1]
        corr = np.zeros((n, n))
        for p, rate in ((w * q, self.hit), (w * (1 - q), self.false)):
            z = (x - rate) / np.sqrt(rate * (1 - rate))
            corr += (z * p[:, None]).T @ z / max(p.sum(), 1e-9) / 2
        self.correlation = np.clip(corr, 0, 1)
        near = self.correlation > 0.3
        out = np.ones(n)
        for i in range(n):
            group = np.flatnonzero(near[i] | (np.arange(n) == i))
            others = group[group != i]
            r = self.correlation[i, others].mean() if len(others) else 0.0
            out[i] = 1 / (1 + len(others) * r)
        return out

    def posterior(self, votes: np.ndarray, label: np.ndarray | None = None, silent: bool = False) -> np.ndarray:
        """Of label 1; a given label, 0 or 1, counts by its estimated accuracy, -1 for none.

        ``silent``: a voter that doesn't vote abstains, as lexicons know a part of the words only.
        """
        x = (votes[:, None] >> np.arange(len(self.hit))) & 1
        on, off = np.log(self.hit / self.false), np.log((1 - self.hit) / (1 - self.false))
        s = np.log(self.share / (1 - self.share)) + (np.where(x == 1, on, 0 * off if silent else off) * self.weight).sum(axis=1)
        if label is not None:
            s = s + np.where(label == 1, np.log(self.label_hit / self.label_false), np.where(label == 0, np.log((1 - self.label_hit) / (1 - self.label_false)), 0.0))
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))

    def evidence(self, voter: int) -> float:
        """What a vote of 1 adds to the log odds if it stands alone."""
        return float(np.clip(np.log(self.hit[voter] / self.false[voter]), 0, 5))


def _slots(text: str | None, kept: dict[bytes, list[int]]) -> np.ndarray:
    """The distinct feature slots of a text; ``kept``: those of words seen before."""
    row: set[int] = set()
    for w in _words(text):
        if (f := kept.get(w)) is None:
            f = [_slot(x) for x in _features(w)]
            if len(kept) < 100_000:
                kept[w] = f
        row.update(f)
    return np.array(sorted(row), np.int32)


def fit(slots: np.ndarray, at: np.ndarray, target: np.ndarray, start: dict[int, float], passes: int = 12, l1: float = 4e-4) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, intercept and how often each slot is seen: logistic loss on soft labels by proximal AdaGrad on blocks of rows.

    Row ``r`` has the slots from ``at[r]`` to ``at[r + 1]``; those of ``start`` begin there. The L1 threshold drops
    features without evidence.
    """
    n = len(target)
    w, g2, b, b2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), 0.0, 1e-8
    w[list(start)] = list(start.values())
    seen = np.bincount(slots, minlength=1 << BITS)
    usable = (seen >= max(3, n // 5000)) | (w > 0)
    rng = np.random.default_rng(1)
    for _ in range(passes):
        for rows in np.array_split(rng.permutation(n), max(1, n // 64)):
            idx = np.concatenate([slots[at[r] : at[r + 1]] for r in rows])
            of = np.repeat(np.arange(len(rows)), at[rows + 1] - at[rows])
            ok = usable[idx]
            idx, of = idx[ok], of[ok]
            z = b + np.bincount(of, weights=w[idx], minlength=len(rows))
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[rows]
            u, inv = np.unique(idx, return_inverse=True)
            grad = np.bincount(inv, weights=e[of], minlength=len(u)) / len(rows)
            g2[u] += grad**2
            rate = 0.3 / np.sqrt(g2[u])
            x = w[u] - rate * grad 
            w[u] = np.sign(x) * np.maximum(np.abs(x) - rate * l1, 0)
            b2 += e.mean() ** 2
            b -= 0.3 / np.sqrt(b2) * e.mean()
    return w, b, seen


def trained(rows: DataFrame, start: dict[int, float]) -> np.ndarray:
    """Weights and, last, the intercept, of ``rows(shard, slots, target)``: the shards' own, averaged by what they saw."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        at = np.concatenate(([0], np.cumsum([len(x) for x in p["slots"]])))
        w, b, seen = fit(np.concatenate(p["slots"].to_list()) if at[-1] else np.zeros(0, np.int32), at, p["target"].to_numpy(), start)
        held = np.flatnonzero((w != 0) & (seen > 0))
        return pd.DataFrame({"slot": np.append(held, 1 << BITS), "w": np.append(w[held], b), "n": np.append(seen[held], len(p)).astype(float)})

    # a shard's zeros count too: what is seen in all of them is the divisor
    seen = rows.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("all"))
    own = rows.groupBy("shard").applyInPandas(run, "slot int, w double, n double")
    sums = own.groupBy("slot").agg(F.sum(F.col("w") * F.col("n")).alias("w"), F.sum("n").alias("n")).join(seen, "slot", "left")
    out = np.zeros((1 << BITS) + 1, np.float32)
    for slot, w in start.items():
        out[slot] = w
    for r in sums.select("slot", (F.col("w") / F.coalesce("all", "n")).alias("w")).collect():  # at most 2**BITS + 1
        out[r.slot] = r.w
    return out


def toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", row_col: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``_row, doc_id, held_out, score, predicted`` of every row of ``docs``; with ``keep``, these columns and ``predicted``."""
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(PARTS))
    rows = cut(sample(docs, labels, id_col, text_col, label_col).withColumn("part", part))
    lexicon = mine(rows.where("part > 0"))
    voters = Voters(lexicon)
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches):
        v = Voters(shared.value)
        total = Counter(v.vote(t) for b in slices(batches) for t in b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["votes", "n"])

    def describe(batches):
        v, kept = Voters(shared.value), {}
        for b in slices(batches):
            t = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("label"), b.column("part"), pa.array([v.vote(x) for x in t], pa.int64()), pa.array([_slots(x, kept) for x in t], pa.list_(pa.int32()))], ["_id", "label", "part", "votes", "slots"])

    text = docs.select(docs[text_col].alias("text"))
    patterns = {r.votes: r.n for r in text.mapInArrow(run, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()}  # at most 2**voters
    kind = rows.schema["_id"].dataType.simpleString()
    described = cut(rows.mapInArrow(describe, f"_id {kind}, label int, part long, votes long, slots array<int>"))
    labelled = described.where("part = 0").groupBy("votes", "label").count().collect()  # at most twice as many
    total = described.agg(F.sum(F.size("slots")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if total.rows:
        # every text votes once: the labelled ones with their label, the others without
        table = [(r.votes, r.label, r["count"]) for r in labelled]
        told = Counter()
        for v, _, n in table:
            told[v] += n
        table += [(v, -1, n - told[v]) for v, n in sorted(patterns.items()) if n > told[v]]
        votes, given, counts = (np.array(x) for x in zip(*sorted(table), strict=True))
        model = LabelModel(votes.astype(np.int64), counts.astype(float), voters.n, given)
        start = {_slot(w): model.evidence(LEXICONS) for w in voters.fixed} | {_slot(f): model.evidence(k) for f, k in lexicon}
        sent = spark.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def target(votes: pd.Series, label: pd.Series) -> pd.Series:
            return pd.Series(sent.value.posterior(votes.to_numpy(np.int64), label.to_numpy(), silent=True))

        shards = max(1, -(-total.n // SHARD))
        shard = F.pmod(F.xxhash64("_id", "votes"), F.lit(shards)).alias("shard")
        weights = trained(described.select(shard, "slots", target("votes", "label").alias("target")), start)
    else:  # nothing to learn from: the fixed lexicon
        weights = np.zeros((1 << BITS) + 1, np.float32)
        weights[-1] = -4
        weights[[_slot(w.encode()) for w in INSULTS]] = 5
    told = spark.sparkContext.broadcast(weights)  # 4 * 2**BITS bytes

    def rate(batches):
        w = told.value
        one = 1 / (1 + np.exp(-w[-1]))
        # slots with weight only: most words have none
        alive = set(np.flatnonzero(w[:-1]).tolist())
        kept: dict[bytes, tuple[int, ...]] = {}
        for b in slices(batches):
            out = []
            texts = b.column("kept").field(text_col) if keep else b.column("text")
            for t in texts.to_pylist():
                row: set[int] = set()
                for x in _words(t):
                    if (f := kept.get(x)) is None:
                        if len(kept) > 100_000:
                            kept.clear()
                        f = kept[x] = tuple(s for s in map(_slot, _features(x)) if s in alive)
                    if f:
                        row.update(f)
                out.append(1 / (1 + np.exp(-float(np.clip(w[-1] + sum(float(w[s]) for s in sorted(row)), -30, 30)))) if row else float(one))
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(out, pa.float64())], ["kept", "score"])

    if keep:
        d = docs.select(F.struct(*dict.fromkeys((*keep, text_col))).alias("kept"))
    else:
        row = [docs[row_col].alias("_row")] if row_col else []
        d = docs.select(*row, docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
        d = d if row_col else with_row(d)
        d = d.select(F.struct("_row", "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")).alias("kept"), "text")
    scored = d.mapInArrow(rate, f"kept {d.schema['kept'].dataType.simpleString()}, score double")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select(*(f"kept.{c}" for c in keep), predicted) if keep else scored.select("kept.*", "score", predicted)
