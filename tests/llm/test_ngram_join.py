"""The n-gram join against brute force, filters that lose nothing, and odd tables."""

import random

import numpy as np
import pytest
from test_dedup import brute_components, table, words

from folio.llm.near_dedup import shingle_sets
from folio.llm.ngram_join import differing, ngram_join, prefix_length, signature


def built(seed, n=70):
    """Groups of copies with edits about the threshold, passages that many texts share, chains, odd texts."""
    rng = random.Random(seed)
    passage, rows = words(rng, 60), []
    for _ in range(n):
        base = words(rng, rng.choice((1, 2, 4, 6, 9, 30, 150)))
        if rng.random() < 0.4:
            base = base + passage
        for _ in range(rng.choice((1, 1, 1, 3, 30))):
            share = rng.choice((0, 0.005, 0.01, 0.03))
            rows.append(" ".join(w if rng.random() > share else rng.choice(("edit", "other")) for w in base))
    chain = words(rng, 120)
    rows += [" ".join(chain[2 * i : 2 * i + 80]) for i in range(20)]
    rows += [None, "", " \n", "One two", "ONE two", "é " * 30, "a " * 500]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k,similarity,seed", [(4, (85, 100), 1), (5, (80, 100), 2), (1, (60, 100), 3)])
def test_join(spark, k, similarity, seed):
    rows = built(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(table(spark, rows), k, similarity).collect()}
    want = brute_components(rows, k, *similarity)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_join_without_stars_is_the_same(spark):
    rows = built(4, 30)
    one, two, three = ({r.doc_id: r.component_id for r in ngram_join(table(spark, rows), 4, (85, 100), **how).collect()} for how in ({"turns": 0}, {"turns": 2}, {"turns": 0, "limit": 6}))
    assert one == two == three


def test_odd_tables(spark):
    assert ngram_join(table(spark, [])).count() == 0
    got = ngram_join(table(spark, [(1, None), (2, ""), (5, "a b c d e f"), (5, "a b c d e f"), (None, "A B C D E F"), (None, None)])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(1, 0, 1), (2, 0, 2), (5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 0, None)], key=str)


def test_filters_lose_no_pair():
    rng = np.random.default_rng(1)
    for n in (3, 6, 7, 40, 63, 64, 65, 129, 900, 5000):
        for m in {n, max(1, n * 9 // 10), n + n // 8}:
            common = min(n, m) - rng.integers(0, 1 + min(n, m) // 6)
            x = rng.integers(0, 2**64, n + m - common, dtype=np.uint64)
            one, two = np.sort(x[:n]), np.sort(x[n - common :])
            assert differing(signature(one), signature(two)) <= n + m - 2 * common
            if 100 * common >= 85 * (n + m - common) and n != common:
                # in any common order the prefixes meet
                assert set(one[: prefix_length(n, 85, 100)].tolist()) & set(two[: prefix_length(m, 85, 100)].tolist())
    assert prefix_length(5, 85, 100) == 0 and prefix_length(6, 85, 100) == 1


def test_a_long_text(spark):
    rng = random.Random(9)
    long = " ".join(words(rng, 400_000, 10**6))
    rows = [(1, long), (2, long + " more"), (3, long[: len(long) // 2])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(table(spark, rows), 4, (85, 100)).collect()}
    sets = [len(x) for x in shingle_sets([t.encode() for _, t in rows], 4)]
    assert got == {1: (sets[0], 1), 2: (sets[1], 1), 3: (sets[2], 3)}
