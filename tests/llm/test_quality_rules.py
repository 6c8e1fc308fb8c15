"""Scripts of whole texts, and the band that follows."""

import random

import public_tokenizers

from folio.llm.quality_rules import _script, quality


def test_script_of_long_texts():
    # every second character is Latin at the stride of a sample of 4,000, most are Cyrillic
    text = "a\u0436\u0436\u0436\u0436" * 4000
    assert len(text) // 4000 == 5 and _script(text) == "cyrillic"
    assert _script("\u03b1" * 700_000 + "b" * 800_000) == "latin" and _script("\u03b1b") == "greek"
    assert _script("") == _script("12 !?") == "none" and _script("\U00020000\u05d0\u05d0") == "hebrew"


def test_band_of_a_long_text_without_language(spark):
    rng = random.Random(1)
    latin, cyrillic = "abcdefghij", "\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438\u043a"
    rows = [(i, " ".join("".join(rng.choices(cyrillic if i % 2 else latin, k=5)) for _ in range(200))) for i in range(60)]
    # words of one Latin letter and four Cyrillic ones: with the space, a period of six; the stride is six
    rows.append((99, "".join(rng.choice(latin) + "".join(rng.choices(cyrillic, k=4)) + " " for _ in range(4000))))
    d = spark.createDataFrame([(i, None, t) for i, t in rows], "doc_id int, lang string, text string")
    named = spark.createDataFrame([(i, "cyrillic" if i == 99 or i % 2 else "latin", t) for i, t in rows], "doc_id int, lang string, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert {(r.doc_id, r.kept, *r.outside) for r in quality(d, path).collect()} == {(r.doc_id, r.kept, *r.outside) for r in quality(named, path).collect()}
