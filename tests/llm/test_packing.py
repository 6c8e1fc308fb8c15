"""Ids of texts that hold added tokens, against the plain tokenizer."""

import zlib

import numpy as np
import public_tokenizers

from folio.llm import packing
from folio.llm.packing import pack, token_bytes


def test_added_tokens(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    assert t.get_added_tokens_decoder()
    texts = ["plain words, no token"]
    for x in t.get_added_tokens_decoder().values():
        texts += [f"hello {x.content} world", f"Hello{x.content}World", x.content, f"{x.content.upper()} a", f"{x.content[:-1]} a {x.content}{x.content}"]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert list(token_bytes([x.encode() for x in texts], path)) == want
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in pack(d, path).collect()}
    assert got == {i: (len(w) // 4 + 1, zlib.crc32(w + b"\0" * 4)) for i, w in enumerate(want)}


def test_words_kept(monkeypatch):
    """What a worker keeps between its tasks; words that come again stay when others go."""
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "_kept", {})
    for k in range(650):
        list(token_bytes([b"often " + b" ".join(b"w%d" % i for i in range(k * 1000, k * 1000 + 1000))], path))
    kept = packing._kept[path][1]
    assert sum(map(len, kept)) <= 600_000
    assert b"often" in kept[0]


def test_ids_with_a_full_cache(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"common word{i} words{i % 7}, Other{i}!".encode() for i in range(60)]
    want = list(token_bytes(texts, path))
    monkeypatch.setattr(packing, "_kept", {})
    monkeypatch.setattr(packing, "CACHE", 20)
    assert list(token_bytes(texts, path)) == want
