"""Dedup operators against brute force, with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folio.llm.exact_dedup import _displace, digests, exact_dedup, winners
from folio.llm.near_dedup import near_dedup
from folio.llm.suffix_dedup import cover_for, difference_cover, remove_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, digest int, c int, node int, chunk int, size int"


def table(spark, rows):
    """Documents, with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(60):
        base = words(rng, rng.choice((1, 2, 3, 30, 120, 300)))
        for _ in range(rng.choice((1, 1, 2, 6, 45))):
            copy = [w if rng.random() > rng.choice((0, 0.002, 0.01, 0.03)) else "edit" for w in base]
            rows.append((n, " ".join(copy)))
            n += 1
    for t in (None, "", "  \n", "One", "ONE", "one two", "é" * 900, "é" * 900):
        rows.append((n, t))
        n += 1
    passage = " ".join(words(rng, 90))
    rows += [(n + k, " ".join(words(rng, 40)) + passage * (1 + k % 2) + " ".join(words(rng, 40))) for k in range(8)]
    return rows


def test_exact(spark, corpus):
    got = {r.doc_id: r for r in exact_dedup(table(spark, corpus)).collect()}
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    for ids in groups.values():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
    assert got[corpus[0][0]].digest == hashlib.sha256(corpus[0][1].encode()).hexdigest()


def test_exact_with_history_ties_and_null_ids(spark):
    old = winners(digests(table(spark, [(1, "a"), (9, "a"), (2, "b")])))
    got = exact_dedup(table(spark, [(3, "a"), (4, "new"), (5, "new"), (5, "new"), (None, "new"), (None, None)]), old)
    rows = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=str)
    assert (3, 9, 2, False) in rows and (4, 5, 4, False) in rows and (None, None, 1, True) in rows
    assert sum(r[3] for r in rows) == 2 and rows.count((5, 5, 4, True)) == 1
    assert exact_dedup(table(spark, [])).count() == 0


def test_displacement_is_a_permutation():
    import numpy as np

    rng = np.random.default_rng(1)
    for m in (1, 2, 7, 100, 4096):
        f, g, b = (rng.integers(0, 2**40, m) for _ in range(3))
        found = next(x for s in range(40) if (x := _displace((f >> s) % m, (g >> s) % m, b % 1024, m)) is not None)
        assert sorted(found[2]) == list(range(m))


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,similarity", [(3, (85, 100)), (5, (80, 100))])
def test_near(spark, corpus, k, similarity):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(table(spark, corpus), k, similarity).collect()}
    want = brute_components(corpus, k, *similarity)
    assert {i for i in want if got[i] != want[i]} == set()


def test_near_of_odd_tables(spark):
    assert near_dedup(table(spark, [])).count() == 0
    got = near_dedup(table(spark, [(1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (None, "A B C D E")])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (3, 3, False), (None, 3, False)], key=str)


def test_covers():
    for r in range(5):
        difference_cover(r)
    for length in (26, 50, 400, 2000):
        assert cover_for(length)[1] <= length // 2 + 1


@pytest.mark.parametrize("length", [60, 400])
def test_repeats(spark, corpus, length):
    got = {r.doc_id: r for r in remove_repeats(table(spark, corpus), length, with_text=True).collect()}
    data = {i: (t or "").encode() for i, t in corpus}
    count = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    for i, b in data.items():
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), len(b) - len(kept), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == sum(g and not p for g, p in zip(gone, [False, *gone])) == len(r.spans) and bytes(r.kept) == kept


def test_repeats_of_odd_tables(spark):
    assert remove_repeats(table(spark, [])).count() == 0
    got = remove_repeats(table(spark, [(1, None), (None, "x" * 399), (2, "y" * 401)])).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (399, 0), (401, 401)]


@pytest.mark.parametrize("length", [60, 400, 2000])
def test_repeats_of_built_strings(spark, length):
    """Thue-Morse strings agree under hashes modulo powers of two; periodic ones repeat at every shift."""
    morse = "".join("ab"[k.bit_count() % 2] for k in range(6000))
    rows = [(1, morse), (2, "xyz" * 900), (3, "q" + "xyz" * 40), (4, "ab" * 150), (5, morse[::-1][:500])]
    count = Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(table(spark, rows), length).collect()}
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        assert got[i] == (sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone])))
