"""Ownership frequency over a planted corpus, against a plain recount."""

import hashlib
import random
import re
from collections import defaultdict

from folio.llm.secret_scan import base_spans, candidates, scan, value_of

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_base(text):
    """The base spans by the stated patterns alone."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def corpus():
    rng = random.Random(11)
    make = lambda n, of="abcdefXYZ0123456789": "".join(rng.choice(of) for _ in range(n))
    copied = [f"ghp_{make(36)}" for _ in range(3)] + [f"token={make(12)}" for _ in range(3)] + ["AKIA" + make(16, "ABCDEF0123456789")]
    rows = []
    for i in range(400):
        parts = [make(5, "abc") for _ in range(30)]
        for _ in range(rng.randrange(4)):
            parts.insert(rng.randrange(30), rng.choice([rng.choice(copied), f"ghp_{make(36)}", f'"Password": "{make(9)}"', make(40, "0123456789abcdef"), f"x{make(30)}Q9", "AKIA" + make(17, "ABC123"), "tokens=short", "日本 secret= " + make(7)]))
        owner = rng.choice([None, *(f"o{k}" for k in range(6))])
        rows.append((i, rng.choice([" ", "\n"]).join(parts), rng.choice(["en", "de", None]), owner))
    # one owner's secret in many of its documents and two repositories, and the same in a text of 4 MB
    own = f"ghp_{make(36)}"
    rows += [(400 + k, f"live {own} here", "en" if k % 2 else "de", "o1") for k in range(40)]
    rows += [(500, "pad " * 1_000_000 + own, "en", "o1"), (501, None, None, None), (502, "", "en", "o1"), (502, "", "en", "o1")]
    return rows


def test_ownership_against_a_recount(spark):
    rows = corpus()
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, value string")
    got = sorted(scan(d).collect(), key=lambda r: r.doc_id)
    where = defaultdict(set)
    found = []
    for i, t, lang, owner in rows:
        base = plain_base(t or "")
        assert base == base_spans(t or "")
        spans = [*base, *candidates(t or "", base)]
        found.append((i, t or "", base, spans))
        for s in spans:
            where[value_of(t, s)].add((owner, lang))
    kinds = ("assign", "access", "hex", "jwt", "forge", "token")
    name = lambda spans: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
    added = shared = 0
    for r, (i, t, base, spans) in zip(got, sorted(found, key=lambda x: x[0]), strict=True):
        live = lambda s: len({o for o, _ in where[value_of(t, s)]}) <= 1 and len(where[value_of(t, s)]) <= 3  # noqa: E731, B023
        want = [s for s in spans if s[1] < 3 or live(s)]
        assert (r.doc_id, r.spans, r.base_sha256) == (i, name(want), hashlib.sha256(name(base).encode()).hexdigest())
        assert [(x.start, x.end, x.live) for x in r.found] == [(s[0], s[2], live(s)) for s in sorted(want)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        added += len(want) - len(base)
        shared += sum(not x.live for x in r.found)
    # the plant has both: spans added, and copied examples
    assert added > 30 and shared > 30
    at = len("pad ") * 1_000_000
    assert next(r for r in got if r.doc_id == 500).spans == f"forge:{at}:{at + 40}"
