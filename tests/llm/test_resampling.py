"""Importance resampling against a plain version, the radix sort against sorting, CRCs against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folio.llm import resampling as r
from folio.llm.resampling import bucket_counts, radix_ranks, resample

SCHEMA = "doc_id long, text string, lang string, bucket int, n string, rank int, _row string, block int, digit int, at int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", 2, "y", 3, 4, 5) for i, t in rows], SCHEMA)


def features(text):
    w = WORD.findall((text or "").translate(LOW))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, share, buckets):
    s, t = (Counter(f % buckets for _, x in rs for f in features(x)[1]) for rs in (rows, target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out, able = [], []
    for i, x in rows:
        w, f = features(x)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[v % buckets] for v in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
        if len(w) >= 20:
            able.append(out[-1])
    able.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: share * len(able) // 100], 1):
        x[4] = k
    return Counter(map(tuple, out))


def corpus(seed, n=200):
    rng = random.Random(seed)
    words = ["the", "Cat", "1984", "naïve", "日本", "x" * 62, "y" * 63, "z" * 64, "w" * 200, "ÉTÉ", "a"]
    rows = [(i, "".join(rng.choice(words) + rng.choice((" ", ", ", "\n", "--", "\u007f")) for _ in range(rng.choice((0, 1, 2, 3, 19, 20, 80))))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, rows[7][1]), (5, rows[9][1]), (5, "q " * 30), (5, "q " * 30), (-(2**62), "q " * 30)]


def test_resampling(spark, monkeypatch):
    monkeypatch.setattr(r, "PART", 300)  # in parts that hand on their last words
    rows, target = corpus(1), [(i, t) for i, t in corpus(2, 20)]
    got = resample(table(spark, rows), table(spark, target), (30, 100), buckets=500)
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == brute(rows, target, 30, 500)


def test_odd_tables(spark):
    assert resample(table(spark, []), table(spark, [])).count() == 0
    got = resample(table(spark, [(1, None), (2, "a " * 40)]), table(spark, []), (100, 100)).orderBy("doc_id").collect()
    assert [(x.n_features, x.rank) for x in got] == [(0, None), (40 + 39 + 38, 1)] and got[0].weight == 0


def test_a_long_text(spark):
    rng = random.Random(3)
    t = " ".join(rng.choice(("Alpha", "b2", "γ", "d" * 70)) for _ in range(700_000))
    n = bucket_counts(table(spark, [(1, t), (2, "x" * 3_000_000 + " y")]), 97, 3)
    want = Counter(f % 97 for x in (t, "x" * 3_000_000 + " y") for f in features(x)[1])
    assert n.tolist() == [want[b] for b in range(97)]


def test_radix_ranks(spark):
    rng = np.random.default_rng(4)
    big = 2**63 - 1
    for keys, bits, block in (
        (np.stack((rng.integers(-40, 40, 3000), rng.integers(0, 10**9, 3000)), 1), 5, 64),
        (np.stack((rng.choice([-big, 0, big], 500), rng.integers(-big, big, 500)), 1), 16, 100),
        (np.stack((np.zeros(400, int), np.where(rng.random(400) < 0.6, 7, rng.integers(0, 9, 400))), 1), 3, 32),
        (np.ones((50, 2), int), 12, 8),
    ):
        rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(keys)], "_row long, a long, b long").repartition(7)
        got = {x._row: x["rank"] for x in radix_ranks(rows, ["a", "b"], bits, block).collect()}
        order = sorted(range(len(keys)), key=lambda i: (*keys[i].tolist(), i))
        assert got == {i: k for k, i in enumerate(order, 1)}
    assert radix_ranks(spark.createDataFrame([], "_row long, a long"), ["a"]).count() == 0
    blocks = radix_ranks(rows, ["a"], 12, 8).select(F.floor((F.col("rank") - 1) / 8).alias("b")).groupBy("b").count()
    assert {x["count"] for x in blocks.collect()} == {8, 2}
