"""The pattern voters against the plain patterns."""

import re

from folio.llm.toxicity import INSULTS, LEXICONS, PATTERNS, Voters


def test_patterns_vote_alone():
    texts = ["Please shut up now", "GO TO HELL", "we hate you all", "I hate them", "kill yourself", "you are an idiot\u2026", "they're all morons!", "those people are scum", None, ""]
    texts += [f"they are {w}\u201d" for w in INSULTS] + ["shut upwards", "hate your tea", "you are kind", "shut\nup"]
    v = Voters([])
    for t in texts:
        want = sum(1 << k for k, p in enumerate(PATTERNS) if re.search(p, (t or "").lower()))
        assert v.vote(t) >> (LEXICONS + 1) == want, t
    # the second pattern without a word of any lexicon
    assert v.vote("Please shut up now") == 1 << (LEXICONS + 2)
