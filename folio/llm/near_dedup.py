"""Near-duplicate components by a chosen-path set similarity join.

Texts become sets of hashed word shingles. Equal sets are one class from the start, so copies cost one
row. Each class carries ``BITS`` one-bit minima of its set, by which similarities are estimated.
Independent trees branch the classes: a node has one function of its own, and with probability
``1 / similarity - 1`` a second, and sends every class to the child named by the full set's minimum under it;
two sets at the threshold meet again in about one child per node. The steps, as many whatever the data:

1. All trees are grown ``FIRST`` levels deep from the full sets, in one pass over the texts.
2. Every class is compared with the pivots of its nodes: the most central member and a random one. The best
   two are confirmed on the full sets, and the links' components are formed. This costs two comparisons a class,
   and makes one component of most near copies of a text, however many they are.
3. Nodes whose members are one component end. Larger ones than ``LIMIT`` branch on, ``TURNS`` times
   ``DEEPER`` levels; all others are compared exhaustively by estimates, pairs within a component apart.
4. Members with a partner go to the region of the pivots that lead them, a region in buckets of bounded size, and
   a bucket's candidates are confirmed on the full sets, at once for all trees. What of the
   deepest nodes is above ``LIMIT`` is compared exhaustively too, in slices.
5. The components of the new links join those of step 2.

No pair is ever a row but those of the pivots: nodes and buckets give their members, linear in their size, and
links that join two components. Links within a component can't change the answer.

Recall. By the branching process, a tree loses a pair at similarity 0.85 with probability 0.23 in two levels, 0.42
in five and 0.53 in eight, the deepest; ``trees`` gives as many as lose it together with at most ``LOSS`` there,
and far fewer above. Estimates are believed from ``DEVIATIONS`` standard deviations below the threshold on.

Defined cases: null and empty texts, or texts without words, have an empty set and are linked with
nothing; texts shorter than a shingle are one shingle; very long texts are hashed whole, one in memory at a
time besides its set; repeated rows are equal sets; of rows tied in their id the one with the smaller
row number stays, null ids come last; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import Windows, mix, words
from .common import components, cut, release, with_row

#: Bits of a sketch; levels of the first pass, turns of further levels for nodes above the limit, and levels of each.
BITS, FIRST, TURNS, DEEPER, LIMIT = 512, 2, 2, 3, 8192
#: At most so large a share of the pairs at the threshold is lost at the deepest level.
LOSS = 1e-3
#: Estimates so many standard deviations below the threshold aren't looked at.
DEVIATIONS = 4.5
#: Classes, and shingles in all, that one side of a bucket holds.
SIDE, SHINGLES = 1024, 1 << 19
#: Bytes of text hashed at once; words longer than this are hashed by another function, without weak inputs.
BLOCK, LONG = 1 << 20, 500

_rng = np.random.default_rng(7)
_MULT = (_rng.integers(0, 2**31, BITS, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def trees(similarity: float) -> int:
    """As many trees as lose together at most ``LOSS`` of the pairs at this similarity at the deepest level."""
    s, second, lost = similarity, 1 / similarity - 1, 0.0
    for _ in range(FIRST + TURNS * DEEPER):
        apart = 1 - s + s * lost
        lost = (1 - second) * apart + second * apart**2
    return max(1, math.ceil(math.log(LOSS) / math.log(lost))) if lost else 1


def least_agreeing(similarity: float) -> int:
    """Of ``BITS`` bits, those in which sets at the threshold agree at least, but for the stated deviations."""
    p = (1 + similarity) / 2
    return math.floor(BITS * p - DEVIATIONS * math.sqrt(BITS * p * (1 - p)))


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    for lo, hi in _blocks(texts):
        part = [t.lower() for t in texts[lo:hi]]
        data = b"\n".join(part)
        buf, s, e = words(data)
        ends = np.cumsum([len(t) + 1 for t in part])
        w = Windows(buf).of(s, e) if len(s) else np.zeros(0, np.uint64)
        for i in np.flatnonzero(e - s > LONG).tolist():
            w[i] = int.from_bytes(hashlib.blake2b(data[s[i] : e[i]], digest_size=8).digest(), "little")
        first = np.concatenate(([0], np.searchsorted(s, ends)))
        n = len(w)
        h = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            h += w[j : n - k + 1 + j] * _STEP[j] if n >= k else 0
        h = mix(h)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(h[a : b - k + 1])
            elif b > a:
                yield mix(np.array([(w[a:b] * _STEP[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _minima(x: np.ndarray, mult: np.ndarray, step: int = 4096) -> np.ndarray:
    out = np.full(len(mult), np.iinfo(x.dtype).max, x.dtype)
    for a in range(0, len(x), step):
        np.minimum(out, (x[None, a : a + step] * mult[:, None]).min(axis=1), out=out)
    return out


def _sketch(x: np.ndarray) -> np.ndarray:
    """One bit of each of ``BITS`` minima, as signed 64-bit words."""
    low = x.astype(np.uint32)
    m = np.concatenate([_minima(low, _MULT[i : i + 64], 1024) for i in range(0, BITS, 64)])
    m = (m ^ (m >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    m = (m ^ (m >> np.uint32(12))) * np.uint32(0x297A2D39)
    return np.packbits(((m >> np.uint32(15)) & np.uint32(1)).astype(np.uint8)).view("<i8")


def _reached(x: np.ndarray, node: np.ndarray, levels: int, similarity: float) -> np.ndarray:
    """The nodes that a set at ``node`` reaches so many levels down.

    Every node has functions of its own, and their minima are of the full set: neither trees nor levels
    share a sketch.
    """
    second = np.uint64(int((1 / similarity - 1) * 2**32))
    for _ in range(levels):
        more = node[(mix(node) >> np.uint64(32)) < second]
        pick = np.concatenate((mix(node * _STEP[40] + _STEP[41]), mix(more * _STEP[42] + _STEP[43])))
        node = mix(pick * _STEP[44] + mix(_minima(x, pick | np.uint64(1))))
    return node


def _sets(docs: DataFrame, k: int, similarity: float, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """``(_row, doc_id, md, n, key, sig, nodes)`` of every document, cut; ``nodes`` are those of the first levels."""
    text = F.coalesce(docs[text_col], F.lit(""))
    row = [docs[row_col].alias("_row")] if row_col else []
    d = docs.select(*row, docs[id_col].cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("md"), F.encode(text, "UTF-8").alias("text"))
    d = d if row_col else with_row(d)
    roots = np.arange(1, trees(similarity) + 1, dtype=np.uint64)
    longs = pa.list_(pa.int64())

    def run(batches):
        for b in batches:
            n, key, sig, nodes = [], [], [], []
            for x in shingle_sets(b.column("text").to_pylist(), k):
                n.append(len(x))
                key.append(np.array([x.sum(dtype=np.uint64), mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], "<u8").tobytes())
                sig.append(_sketch(x) if len(x) else None)
                nodes.append(_reached(x, roots, FIRST, similarity).view(np.int64) if len(x) else None)
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("doc_id"), b.column("md"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, longs), pa.array(nodes, longs)], ["_row", "doc_id", "md", "n", "key", "sig", "nodes"])

    return cut(d.mapInArrow(run, "_row long, doc_id long, md binary, n long, key binary, sig array<long>, nodes array<long>"))


def _texts(docs: DataFrame, text_col: str, classes: DataFrame, need: DataFrame) -> DataFrame:
    """``(c, text)``: the whole text of each class of ``need(c)``, cut."""
    wanted = need.select("c").distinct().join(classes.select("c", "md"), "c")
    text = F.coalesce(docs[text_col], F.lit(""))
    full = docs.select(F.unhex(F.md5(text)).alias("md"), F.encode(text, "UTF-8").alias("text"))
    return cut(full.join(wanted, "md").select("c", "text").dropDuplicates(["c"]))


def _branch(held: DataFrame, texts: DataFrame, levels: int, similarity: float, k: int) -> DataFrame:
    """``(node, c)``: the nodes that the classes of ``held(node, c)`` reach so many levels down."""
    # a class is in a few nodes of each tree, and its text is read once for all
    of = held.groupBy("c").agg(F.collect_list("node").alias("nodes")).join(texts, "c").select("c", "nodes", "text")

    def run(batches):
        for b in batches:
            at, c = b.column("nodes").to_pylist(), b.column("c").to_pylist()
            text = b.column("text")
            for lo in range(0, len(c), 200):
                part = [x.as_py() for x in text[lo : lo + 200]]
                to = [_reached(x, np.array(n, np.int64).view(np.uint64), levels, similarity).view(np.int64) for x, n in zip(shingle_sets(part, k), at[lo : lo + 200], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), pa.array(np.repeat(c[lo : lo + 200], [len(n) for n in to]))], ["node", "c"])

    return of.mapInArrow(run, "node long, c long")


def _agreeing(one: Column, two: Column) -> Column:
    """Bits in which two sketches agree."""
    apart = F.lit(0)
    for i in range(BITS // 64):
        apart = apart + F.bit_count(one[i].bitwiseXOR(two[i]))
    return F.lit(BITS) - apart


def _like(one: Column, two: Column, num: int, den: int) -> Column:
    """Whether two set sizes allow the similarity at all."""
    return den * F.least(one, two) >= num * F.greatest(one, two)


def _groups(batches, key: str, columns: tuple[str, ...]):
    """The rows of each key of batches sorted by it, as lists of column values, one key at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in itertools.chain(batches, [None]):
        if b is None or b.num_rows:
            keys = None if b is None else b.column(key).to_numpy()
            edge = [0] if b is None else [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), b.num_rows]
            for lo, hi in itertools.pairwise(edge) if b is not None else [(0, 0)]:
                if held and (b is None or keys[lo] != now):
                    yield now, [pa.chunked_array([x.column(c) for x in held]) for c in columns]
                    held = []
                if b is not None:
                    now = keys[lo]
                    held.append(b.slice(lo, hi - lo))


def _bits(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return flat.flatten().to_numpy().view(np.uint64).reshape(len(flat), BITS // 64)


def _alike(sig: np.ndarray, n: np.ndarray, r: np.ndarray, one: np.ndarray, two: np.ndarray, least: int, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, agreeing bits)`` of rows ``i`` of ``one`` and ``j`` of ``two`` that may be linked, by blocks."""
    step = max(1, (1 << 19) // max(1, len(two)))
    for a in range(0, len(one), step):
        i = one[a : a + step]
        low, high = np.minimum(n[i][:, None], n[two]), np.maximum(n[i][:, None], n[two])
        x, y = np.nonzero((r[i][:, None] != r[two]) & (den * low >= num * high))
        if len(x):
            agree = BITS - np.bitwise_count(sig[i[x]] ^ sig[two[y]]).sum(axis=1, dtype=np.int64)
            ok = agree >= least
            yield i[x[ok]], two[y[ok]], agree[ok]


def _partners(rows: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """``(lo, hi, side, c)``: members of ``rows(node, c, r, leader, n, sig)`` that may be linked with a member of
    another component in their node, by the leaders of both: ``lo`` is the smaller, ``side`` 0 or 1 that of ``c``."""

    def run(batches):
        for _, (c, r, leader, n, sig) in _groups(batches, "node", ("c", "r", "leader", "n", "sig")):
            c, r, leader, n, sig = c.to_numpy(), r.to_numpy(), leader.to_numpy(), n.to_numpy(), _bits(sig)
            names, of, count = np.unique(r, return_inverse=True, return_counts=True)
            if len(names) < 2:
                continue
            # all but the members of the largest component, against everybody
            few = np.flatnonzero(of != count.argmax())
            found = [np.zeros((0, 4), np.int64)]
            for i, j, _ in _alike(sig, n, r, few, np.arange(len(c)), least, num, den):
                lo, hi = np.minimum(leader[i], leader[j]), np.maximum(leader[i], leader[j])
                for x in (i, j):
                    found.append(np.unique(np.stack((lo, hi, (leader[x] > lo).astype(np.int64), c[x]), axis=1), axis=0))
            found = np.unique(np.concatenate(found), axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(4)], ["lo", "hi", "side", "c"])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "lo long, hi long, side long, c long")


def _buckets(need: DataFrame, classes: DataFrame) -> DataFrame:
    """``(k, side, c)``: the members of ``need(lo, hi, side, c)`` in buckets of bounded size.

    Both sides of a pair of leaders are cut into as many slices, and each slice meets each slice of the
    other side. Of one leader with itself each two slices meet once; side 2 is both sides.
    """
    m = need.join(classes.select("c", "n"), "c")
    size = m.groupBy("lo", "hi", "side").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("words"))
    parts = F.greatest(F.ceil(F.col("members") / SIDE), F.ceil(F.col("words") / SHINGLES))
    size = size.groupBy("lo", "hi").agg(F.max(parts).cast("long").alias("parts"))
    m = m.join(size, ["lo", "hi"]).withColumn("s", F.pmod(F.xxhash64("c"), F.col("parts")))
    m = m.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    same, first = F.col("lo") == F.col("hi"), F.col("side") == 0
    i = F.when(same, F.least("s", "t")).when(first, F.col("s")).otherwise(F.col("t"))
    j = F.when(same, F.greatest("s", "t")).when(first, F.col("t")).otherwise(F.col("s"))
    side = F.when(~same, F.col("side")).otherwise(F.when(F.col("s") == F.col("t"), 2).when(F.col("s") < F.col("t"), 0).otherwise(1))
    return m.select(F.xxhash64("lo", "hi", i, j).alias("k"), side.cast("long").alias("side"), "c")


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """The intersection sizes of all sets of one list with all of another, by products of incidence blocks."""
    every = [*one, *two]
    flat, of = np.concatenate(every), np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[name] > 1
    name, of = np.unique(name[keep], return_inverse=True)[1], of[keep]
    order = np.argsort(name, kind="stable")
    name, of = name[order], of[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for a in range(0, int(name[-1]) + 1 if len(name) else 0, 4096):
        lo, hi = np.searchsorted(name, [a, a + 4096])
        block = np.zeros((len(every), 4096), np.float32)
        block[of[lo:hi], name[lo:hi] - a] = 1
        out += block[: len(one)] @ block[len(one) :].T
    return out.round().astype(np.int64)


def _confirmed(members: DataFrame, k: int, least: int, num: int, den: int) -> DataFrame:
    """``(a, b)``: components that links join, of the buckets of ``members(k, side, c, r, n, sig, text)``.

    Each candidate of each bucket is checked on its full sets, unless its components are joined already.
    """

    def run(batches):
        for _, (side, r, n, sig, text) in _groups(batches, "k", ("side", "r", "n", "sig", "text")):
            side, r, n, sig = side.to_numpy(), r.to_numpy(), n.to_numpy(), _bits(sig)
            one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            found = list(_alike(sig, n, r, one, two, least, num, den))
            if not found:
                continue
            i, j, agree = (np.concatenate(x) for x in zip(*found, strict=True))
            once = (side[i] != 2) | (side[j] != 2) | (i < j)
            i, j, agree = i[once], j[once], agree[once]
            used = np.unique(np.concatenate((i, j))).tolist()
            if not used:
                continue
            sets = dict(zip(used, shingle_sets([text[x].as_py() for x in used], k), strict=True))
            u, edges = _Union(), []
            order = np.argsort(-agree, kind="stable")
            rows, cols = np.unique(i), np.unique(j)
            if len(i) > 4 * (len(rows) + len(cols)):
                both = _shared([sets[x] for x in rows.tolist()], [sets[x] for x in cols.tolist()])[np.searchsorted(rows, i), np.searchsorted(cols, j)]
                order = order[(den * both >= num * (n[i] + n[j] - both))[order]]
                linked = lambda x, y: True
            else:

                def linked(x, y):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    return den * both >= num * (len(sets[x]) + len(sets[y]) - both)

            for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                a, b = int(r[x]), int(r[y])
                if u.find(a) != u.find(b) and linked(x, y) and u.join(a, b):
                    edges.append((a, b))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in zip(*edges, strict=True)], ["a", "b"])

    return members.select("k", "side", "r", "n", "sig", "text").repartition("k").sortWithinPartitions("k").mapInArrow(run, "a long, b long")


def _rooted(rows: DataFrame, roots: DataFrame | None, key: str, name: str) -> DataFrame:
    """Adds the component of ``key``; without links so far, itself."""
    if roots is None:
        return rows.withColumn(name, F.col(key))
    r = roots.select(F.col("node").alias(key), F.col("root").alias(name))
    return rows.join(r, key, "left").withColumn(name, F.coalesce(F.col(name), F.col(key)))


def _several(rows: DataFrame) -> DataFrame:
    """``rows(node, c, r)`` of nodes of several components, with the node's size, cut."""
    size = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("r").alias("r0"), F.max("r").alias("r1"))
    return cut(rows.select("node", "c", "r").join(size.where("r0 <> r1").select("node", "size"), "node"))


def near_dedup(
    docs: DataFrame,
    k: int = 5,
    similarity: tuple[int, int] = (80, 100),
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """One row for each document: ``_row, doc_id, n_shingles, component_id, kept``."""
    num, den = similarity
    spark, tau, least = docs.sparkSession, num / den, least_agreeing(num / den)
    d = _sets(docs, k, tau, id_col, text_col, row_col)
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_row"))
    g = d.where("n > 0").groupBy("n", "key").agg(low.alias("low"), F.min("_row").alias("c"), F.first("md").alias("md"), F.first("sig").alias("sig"), F.first("nodes").alias("nodes"))
    classes = cut(g)

    # the nodes of several classes, and the pivots of each
    at = classes.select(F.explode("nodes").alias("node"), "c")
    at = cut(at.join(at.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "node"))
    weight = at.groupBy("c").agg(F.sum("size").alias("w"))
    best = F.max(F.struct("w", "c")).alias("x")
    pivots = at.join(weight, "c").groupBy("node").agg(best, F.min_by("c", F.xxhash64("c")).alias("y"))
    led = cut(at.select("node", "c").join(pivots, "node"))
    leaders = led.groupBy("c").agg(F.max("x").alias("x")).select("c", F.col("x.c").alias("leader"))

    # every class and the two best of its pivots
    s = classes.select("c", "n", "sig")
    star = led.select("c", F.explode(F.array("x.c", "y")).alias("p")).where("c <> p").distinct()
    star = star.join(s, "c").join(s.select(F.col("c").alias("p"), F.col("n").alias("m"), F.col("sig").alias("psig")), "p")
    agree = _agreeing(F.col("sig"), F.col("psig"))
    star = star.where(_like(F.col("n"), F.col("m"), num, den)).select("c", "p", agree.alias("agree")).where(F.col("agree") >= least)
    two = star.groupBy("c").agg(F.slice(F.sort_array(F.collect_list(F.struct("agree", "p")), asc=False), 1, 2).alias("two"))
    star = cut(two.select("c", F.explode("two.p").alias("p")))
    # a pivot is led by itself here, and its partners are the other side
    need = star.select(F.col("p").alias("lo"), F.lit(None).cast("long").alias("hi"), F.lit(1).cast("long").alias("side"), "c")
    parts = need.groupBy("lo").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("parts"))
    parted = need.join(parts, "lo").select(F.xxhash64("lo", F.pmod(F.xxhash64("c"), F.col("parts"))).alias("k"), "side", "c", "lo")
    members = parted.select("k", "side", "c").unionByName(parted.select("k", F.lit(0).cast("long").alias("side"), F.col("lo").alias("c")).distinct())

    def confirmed(members: DataFrame, roots: DataFrame | None, texts: DataFrame) -> DataFrame:
        return cut(_confirmed(_rooted(members.join(s, "c"), roots, "c", "r").join(texts, "c"), k, least, num, den))

    links = confirmed(members, None, _texts(docs, text_col, classes, members))
    release(spark)
    roots = cut(components(links))

    # what stays apart in its nodes
    apart, small = _several(_rooted(at.select("node", "c"), roots, "c", "r")), None
    for _ in range(TURNS):
        large = apart.where(F.col("size") > limit)
        if large.limit(1).count() == 0:
            break
        rest = apart.where(F.col("size") <= limit)
        small = rest if small is None else small.unionByName(rest)
        deeper = _branch(large.select("node", "c"), _texts(docs, text_col, classes, large), DEEPER, tau, k)
        apart = _several(_rooted(deeper, roots, "c", "r"))
    apart = apart if small is None else small.unionByName(apart)
    # a node at the deepest level is compared by slices, any two of which meet in half the limit
    slices = F.when(F.col("size") > limit, F.ceil(2 * F.col("size") / limit)).otherwise(1).cast("long")
    apart = apart.withColumns({"parts": slices, "t": F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))})
    slice_of = F.pmod(F.xxhash64("c"), F.col("parts"))
    apart = apart.select(F.xxhash64("node", F.least(slice_of, "t"), F.greatest(slice_of, "t")).alias("node"), "c", "r")
    found = _partners(apart.join(leaders, "c").join(s, "c"), least, num, den)
    need = cut(found.distinct())
    members = _buckets(need, s)
    links = confirmed(members, roots, _texts(docs, text_col, classes, need))
    release(spark)
    above = cut(components(links))

    of = _rooted(_rooted(classes.select("n", "key", "low", "c"), roots, "c", "r1"), above, "r1", "r")
    least_of = of.groupBy("r").agg(F.min("low").alias("first"))
    of = of.select("n", "key", "r").join(least_of, "r").select("n", "key", "first")
    out = d.select("_row", "doc_id", "n", "key").join(of, ["n", "key"], "left")
    one = F.coalesce(F.col("first._row"), F.col("_row"))
    return out.select("_row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), (one == F.col("_row")).alias("kept"))
