"""The divergence audit against a plain count with whole numbers, on odd tables, and by parts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from folio.llm import divergence as d
from folio.llm.divergence import divergence, shares

SCHEMA = "doc_id long, text string, lang string, source string, chunk int, n string, doc int, term int, first int, counts int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 1, "x", 2, 3, 4, 5) for i, (t, la, s) in enumerate(rows)], SCHEMA)


def brute(rows, min_docs=3, top=200):
    seen, count, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, (t, la, s) in enumerate(rows):
        la, s = la or "", s or ""
        groups[la].add(s)
        for w in TERM.findall((t or "").translate(LOW)):
            seen[la, w].add(i)
            count[la, s][w] += 1
    out = set()
    for la, sources in groups.items():
        kept = {w for (x, w), ids in seen.items() if x == la and len(ids) >= min_docs}
        n = {s: {w: count[la, s][w] for w in kept} for s in sources}
        p = {s: {w: 1 + 10**9 * (c + 1) // (sum(n[s].values()) + len(kept)) for w, c in n[s].items()} for s in sources}
        every = {w: sum(n[s][w] for s in sources) for w in kept}
        q = {w: 1 + 10**9 * (c + 1) // (sum(every.values()) + len(kept)) for w, c in every.items()}
        for s in sources:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in sources - {s}]
            terms = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if n[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(la, s, part, w, v, k) for k, (v, w) in enumerate(ranked[: top if part == "term" else None], 1)}
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "É", "ß", "日", "mi") for b in ("ne", "ru", "Ta", "sx", "")]
    ends = ("", ",", ".", "-", "’s", "\x00", "\x1f", "1")
    rows = []
    for _ in range(n):
        t = "".join(rng.choice(words) + rng.choice(ends) + rng.choice((" ", "  ", "\n", " ", "\x0b")) for _ in range(rng.choice((0, 1, 5, 60))))
        rows.append((t, rng.choice(("en", "en", "de", None, "")), rng.choice(("s1", "s2", "s3", None))))
    # one term by chunks of one document, of two, and of three documents
    rows += [("zeta zeta, zeta. Zeta! (zeta)", "xx", "a"), ("eta, eta", "xx", "a"), ("eta.", "xx", "b"), ("theta,", "xx", "a"), ("theta.", "xx", "b"), ("theta!", "xx", "c"), (None, "xx", "d"), ("nothing", "yy", "a"), (rows[0][0], *rows[0][1:])]
    return rows


def test_divergence(spark):
    for seed, kept in ((1, 3), (2, 1), (3, 5)):
        rows = corpus(seed)
        got = {tuple(r) for r in divergence(table(spark, rows), kept, 20).collect()}
        assert got == brute(rows, kept, 20)
    assert divergence(table(spark, [])).count() == 0
    assert divergence(table(spark, [(None, None, None)])).count() == 0


def test_small_parts_and_blocks(spark, monkeypatch):
    """Tasks that hand on early, and many blocks: the numbers that bound memory don't change the result."""
    monkeypatch.setattr(d, "BYTES", 50)
    monkeypatch.setattr(d, "CELLS", 8)
    rows = [*corpus(4, 60), ("long " * 300_000 + "end", "en", "s1")]
    held = d.chunk_counts.__globals__
    assert held["BYTES"] == 50
    assert {tuple(r) for r in divergence(table(spark, rows), 3, 5).collect()} == brute(rows, 3, 5)


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    of = rng.integers(1, 2**48, 2000)
    n = (of * rng.random(2000)).astype(np.int64)
    assert shares(n, of).tolist() == [1 + 10**9 * a // b for a, b in zip(n.tolist(), of.tolist(), strict=True)]
