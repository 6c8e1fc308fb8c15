"""Token counts by a linear longest-match automaton (Song et al. 2021), without building pieces.

The vocabulary is a trie. Each node has a failure link and the number of tokens popped on the way: when
the next character has no edge, the automaton adds the popped count and continues at the link, so a word costs a
number of steps linear in its length, whatever the longest piece. Characters outside the vocabulary count as
their UTF-8 bytes, as byte fallback writes them. A word begins with the vocabulary's word mark.

Distinct words are counted once by each worker and kept. Every row is independent: one narrow stage,
no shuffle, nothing broadcast but the vocabulary's path.

Defined cases: null, empty and blank texts have no words and no tokens; words have no length limit;
repeated rows are counted row by row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

CACHE = 800_000
MARK = "▁"
_kept: dict[str, tuple] = {}


class LongestMatch:
    def __init__(self, pieces: Iterable[str]):
        self.pieces = frozenset(p for p in pieces if p)
        self.edges: list[dict[str, int]] = [{}]
        token = [False]
        for p in sorted(self.pieces):
            at = 0
            for c in p:
                nxt = self.edges[at].get(c)
                if nxt is None:
                    nxt = self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    token.append(False)
                at = nxt
            token[at] = True
        n = len(self.edges)
        # popped: tokens and, among them, fallback bytes
        self.link, self.popped, self.bytes = [0] * n, [0] * n, [0] * n
        queue = deque((0, c, v) for c, v in sorted(self.edges[0].items()))
        while queue:
            u, c, v = queue.popleft()
            if token[v]:
                self.link[v], self.popped[v], self.bytes[v] = 0, 1, 0
            elif u == 0:  # a first character that is no piece falls back to its bytes
                k = len(c.encode())
                self.link[v], self.popped[v], self.bytes[v] = 0, k, k
            else:
                z, pop, raw = self.link[u], self.popped[u], self.bytes[u]
                while z and c not in self.edges[z]:
                    z, pop, raw = self.link[z], pop + self.popped[z], raw + self.bytes[z]
                if c in self.edges[z]:
                    self.link[v] = self.edges[z][c]
                else:
                    k = len(c.encode())
                    pop, raw = pop + k, raw + k
                self.popped[v], self.bytes[v] = pop, raw
            queue.extend((v, d, x) for d, x in sorted(self.edges[v].items()))

    def count(self, word: str) -> tuple[int, int]:
        """Tokens of a word, and how many of them are fallback bytes."""
        at, n, raw = 0, 0, 0
        for c in word:
            while at and c not in self.edges[at]:
                n, raw, at = n + self.popped[at], raw + self.bytes[at], self.link[at]
            nxt = self.edges[at].get(c)
            if nxt is None:
                k = len(c.encode())
                n, raw = n + k, raw + k
            else:
                at = nxt
        while at:
            n, raw, at = n + self.popped[at], raw + self.bytes[at], self.link[at]
        return n, raw


def _automaton(path: str):
    if path not in _kept:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        plain = (i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)))
        _kept[path] = (LongestMatch(map(m.id_to_piece, plain)), {})
    return _kept[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, n_words, n_tokens, n_byte_tokens``."""
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        automaton, cache = _automaton(vocabulary)
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                words = (t or "").encode().split()
                for w in {w for w in words if w not in cache}:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = automaton.count(MARK + w.decode())
                n = raw = 0
                for w in words:
                    x = cache.get(w) or automaton.count(MARK + w.decode())
                    n, raw = n + x[0], raw + x[1]
                out.append((len(words), n, raw))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_words", "n_tokens", "n_byte_tokens"])

    return d.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_byte_tokens long")
