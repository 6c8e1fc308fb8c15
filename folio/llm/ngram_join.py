"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Texts become sets of hashed word n-grams, equal sets one class, so that copies cost one row.

1. One pass counts all n-grams in ``COUNTERS`` counters (by hash; sums of all tasks, whatever the size of the corpus), and
   names the class of every document. All n-grams are ordered by their counter's size and then by hash: rare ones
   first. Which order is taken doesn't change the result, only how many candidates there are, so hashed counts do:
   a frequent n-gram's counter stands out from the others' by far more than their deviation.
2. A second pass gives each class its prefix, so many of its rarest n-grams that two linked classes must share one,
   and a signature for the suffix filter. Prefixes are joined on their n-grams; n-grams of one class go, and of those
   with the same classes one stays.
   Members of a list that no other member can be linked with by the filters aren't looked at any more: their sets are not fetched.
3. A few turns of stars: each class is compared with those two others that it shares most prefix n-grams with among
   a list's hubs. That makes one component of most near copies of a text, however many they are, by two pairs a class.
4. What is apart yet meets in the lists: members of different components that pass the length, positional and suffix
   filters are partners. No pair is a row: a list gives its members by the two components, each once.
5. The partners of two components, in buckets of bounded size, are verified on the full sets until one link joins
   the components, once for all lists. The filters lose no pair; links within a component can't change the answer.

The suffix filter: n-grams are dealt to as many parts as the set has members, and a signature holds the parity
of each part, 1,024 at least. Two sets differ in at least as many n-grams as signatures differ in bits, so a pair with more
such bits than the similarity allows is none. Signatures of larger sets are folded to the smaller one's parts.

Defined cases: null and empty texts, or texts without words, have an empty set and are linked with
nothing; texts shorter than an n-gram are one n-gram; very long texts are hashed whole; rows of the same id are documents of
their own; repeated rows are equal sets; null ids are a component's smallest only where it has no other;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, placed
from .near_dedup import _buckets, _groups, _shared, shingle_sets

#: Counters of n-grams, the slices they are summed in, turns of stars, and hubs of a list in each.
COUNTERS, SLICES, TURNS, HUBS = 1 << 21, 256, 2, 3
#: Parts of a signature at least, members compared with one hub in a bucket, and members of a list compared in one task.
PARTS, SIDE, LIMIT = 1024, 512, 8192
#: Texts of a batch that are in memory as such at a time.
TEXTS = 256
#: Rows that a task remembers having given.
SEEN = 1 << 17
_TOP = np.uint64(64 - (COUNTERS - 1).bit_length())


def _sliced(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sets of a batch's texts, a few hundred texts in memory at a time."""
    for lo in range(0, len(texts), TEXTS):
        yield from shingle_sets(texts.slice(lo, TEXTS).to_pylist(), k)


def _key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.encode(F.coalesce(docs[text_col].cast("string"), F.lit("")), "UTF-8")
    return placed(docs, docs[id_col].cast("long").alias("doc_id"), text.alias("text"))


def _counted(d: DataFrame, k: int) -> DataFrame:
    """``(_file, _at, doc_id, n, key)`` of each document, and the task's counters as rows ``(slot, counts)``, cut."""
    names = ["_file", "_at", "doc_id", "n", "key", "slot", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches):
        total, held, size = np.zeros(COUNTERS, np.int64), [], 0
        for b in batches:
            n, key = [], []
            for x in _sliced(b.column("text"), k):
                n.append(len(x))
                key.append(hashlib.blake2b(x.astype("<u8").tobytes(), digest_size=16).digest())
                held.append((x >> _TOP).astype(np.int32))
                size += len(x)
                if size > COUNTERS // 4:
                    total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
            none = [pa.nulls(b.num_rows, t) for t in kinds[5:]]
            yield pa.RecordBatch.from_arrays([b.column("_file"), b.column("_at"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), *none], names)
        if held:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        if total.any():
            pack = zstandard.ZstdCompressor(level=1).compress
            parts = [pack(x.astype("<u4").tobytes()) for x in np.split(total, SLICES)]
            none = [pa.nulls(SLICES, t) for t in kinds[:5]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    return cut(d.mapInArrow(run, "_file long, _at long, doc_id long, n long, key binary, slot int, counts binary"))


def _ranks(counted: DataFrame) -> np.ndarray:
    """How frequent each counter is, an eighth of an octave a step; a table of fixed size."""

    def summing(last: bool):
        def run(batches):
            pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for s, c in zip(b.column("slot").to_pylist(), b.column("counts").to_pylist(), strict=True):
                    x = np.frombuffer(unpack(c), "<i8" if last else "<u4").astype(np.int64)
                    total[s] = total[s] + x if s in total else x
            for s, x in total.items():
                out = np.minimum(255, 8 * np.log2(1 + x)).astype(np.uint8).tobytes() if last else pack(x.astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([out], pa.binary())], ["slot", "counts"])

        return run

    # summed where they lie, then by slice
    parts = counted.where("slot is not null").select("slot", "counts").mapInArrow(summing(False), "slot int, counts binary")
    found = parts.repartition(SLICES // 8, "slot").mapInArrow(summing(True), "slot int, counts binary").collect()
    rank = np.zeros((SLICES, COUNTERS // SLICES), np.uint8)
    for r in found:
        rank[r.slot] = np.frombuffer(r.counts, np.uint8)
    return rank.reshape(-1)


def prefix_length(n: int, num: int, den: int) -> int:
    """So many n-grams of ``n`` that any linked set holds one; 0 where only equal sets can be linked."""
    return n - -(-num * n // den) + 1 if den * n >= num * (n + 1) else 0


def signature(x: np.ndarray) -> bytes:
    """The parity of each part of the set, as many parts as members, a power of two."""
    parts = max(PARTS, 1 << (len(x) - 1).bit_length())
    odd = np.bincount((x & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sig: bytes, parts: int) -> bytes:
    """A signature of so many parts."""
    a = np.frombuffer(sig, np.uint8)
    while len(a) > parts // 8:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a.tobytes()


def differing(one: bytes, two: bytes) -> int:
    """In how many n-grams two sets differ at least, by their signatures."""
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _prefixes(d: DataFrame, rank: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """``(_file, _at, n, prefix, sig, wide)`` of each document that an unequal set may be linked with."""

    def run(batches):
        for b in batches:
            keep, n, prefix, sig, wide = [], [], [], [], []
            for i, x in enumerate(_sliced(b.column("text"), k)):
                if p := prefix_length(len(x), num, den):
                    order = np.argsort(rank[x >> _TOP], kind="stable")[:p]  # sets are sorted by hash
                    keep.append(i)
                    n.append(len(x))
                    prefix.append(x[order].view(np.int64))
                    sig.append(signature(x))
                    # half as many parts as members still tell unlike sets apart
                    wide.append(folded(sig[-1], max(PARTS, 1 << (len(x) // 2).bit_length())))
            b = b.select(["_file", "_at"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), *(pa.array(z, pa.binary()) for z in (sig, wide))], ["_file", "_at", "n", "prefix", "sig", "wide"])

    return d.select("_file", "_at", "text").mapInArrow(run, "_file long, _at long, n long, prefix array<long>, sig binary, wide binary")


def _sets(d: DataFrame, of: DataFrame, k: int) -> DataFrame:
    """``(c, x)``: the whole sets of the classes of ``of(_file, _at, c)``, cut."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part = b.slice(lo, TEXTS)
                x = [s.astype("<u8").tobytes() for s in _sliced(part.column("text"), k)]
                yield pa.RecordBatch.from_arrays([part.column("c"), pa.array(x, pa.binary())], ["c", "x"])

    return cut(d.select("_file", "_at", "text").join(of.select("_file", "_at", "c"), ["_file", "_at"]).select("c", "text").mapInArrow(run, "c long, x binary"))


def _like(one: Column, two: Column, num: int, den: int) -> Column:
    """The length filter."""
    return den * F.least(one, two) >= num * F.greatest(one, two)


def _close(pairs: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """The suffix filter: ``(a, b)`` of pairs whose signatures allow the similarity."""
    s = prefixes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    t = prefixes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.select("a", "b").join(s, "a").join(t, "b")

    def run(batches):
        for b in batches:
            n = b.column("na").to_numpy() + b.column("nb").to_numpy()
            # |A| + |B| - 2 |A and B|, for the least intersection that links
            most = _most_apart(n, num, den)
            apart = [differing(x, y) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True)]
            ok = pa.array(np.array(apart, np.int64) <= most)
            yield b.select(["a", "b"]).filter(ok)

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The links among ``pairs(a, b)`` that have sets, on these: buckets of at most about ``SIDE`` members ``a`` and their hub ``b``."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("parts"))
    dealt = pairs.join(parts, "b").withColumn("k", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("parts"))))
    hubs = dealt.select("k", F.col("b").alias("hub"), F.col("b").alias("c")).distinct()
    rows = dealt.select("k", F.col("b").alias("hub"), F.col("a").alias("c")).unionByName(hubs)
    rows = rows.join(sets, "c").withColumn("member", F.col("c") != F.col("hub"))

    def run(batches):
        now, hub = None, None
        for b in batches:
            a, h = [], []
            for k, c, of, member, x in zip(b.column("k").to_pylist(), b.column("c").to_pylist(), b.column("hub").to_pylist(), b.column("member").to_pylist(), b.column("x"), strict=True):
                x = np.frombuffer(x.as_buffer(), "<u8")
                if not member:
                    now, hub = (k, of), x.copy()
                    continue
                if now != (k, of):  # a hub without a set can't be linked with anything
                    continue
                at = np.searchsorted(hub, x)
                both = int((hub[np.minimum(at, len(hub) - 1)] == x).sum())
                if den * both >= num * (len(hub) + len(x) - both):
                    a.append(c)
                    h.append(of)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(h, pa.int64())], ["a", "b"])

    return cut(rows.repartition("k").sortWithinPartitions("k", "hub", "member").mapInArrow(run, "a long, b long"))


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Adds the component ``r`` of the class ``c``."""
    if roots is None:
        return rows.withColumn("r", F.col("c"))
    return rows.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("r", F.coalesce("root", "c")).drop("root")


def _bits(sigs: list[bytes]) -> np.ndarray:
    """Signatures of ``PARTS`` parts, a row each."""
    return np.frombuffer(b"".join(x if len(x) == PARTS // 8 else folded(x, PARTS) for x in sigs), np.uint64).reshape(-1, PARTS // 64)


def _near(sig: np.ndarray, sigs: list[bytes], x: np.ndarray, y: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs ``x, y`` the suffix filter lets pass: by few parts all, by all their parts the large sets."""
    most = _most_apart(n[x] + n[y], num, den)
    ok = np.bitwise_count(sig[x] ^ sig[y]).sum(axis=1, dtype=np.int64) <= most
    for i in np.flatnonzero(ok & (np.minimum(n[x], n[y]) > PARTS)).tolist():
        ok[i] = differing(sigs[x[i]], sigs[y[i]]) <= most[i]
    return ok


def _most_apart(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """In how many n-grams two sets of so many together differ at most, if they are linked."""
    return n - 2 * -(-num * n // (num + den))


def _wanted(rows: DataFrame, num: int, den: int, most: int = 256) -> DataFrame:
    """``(c)``: members of the lists of ``rows(g, c, n, pos, wide)`` that may be linked with another one, and all of lists longer than ``most``."""

    def run(batches):
        seen: set[int] = set()
        for _, (c, n, pos, wide) in _groups(batches, "g", ("c", "n", "pos", "wide")):
            c, n, pos = c.to_numpy(), n.to_numpy(), pos.to_numpy()
            if len(c) <= most:
                low, high = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
                upto = np.minimum(pos[:, None], pos) + np.minimum((n - pos)[:, None], n - pos)
                ok = (den * low >= num * high) & ((num + den) * upto >= num * (low + high))
                np.fill_diagonal(ok, False)
                x, y = np.nonzero(ok)
                if not len(x):
                    continue
                sigs = wide.to_pylist()
                c = c[np.unique(x[_near(_bits(sigs), sigs, x, y, n, num, den)])]
            if new := [v for v in c.tolist() if v not in seen]:
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64())], ["c"])
            if len(seen) > SEEN:
                seen.clear()

    return rows.select("g", "c", "n", "pos", "wide").repartition("g").sortWithinPartitions("g").mapInArrow(run, "c long")


def _partners(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``(lo, hi, side, c)``: members of the lists of ``rows(home, g, c, r, n, pos, wide)`` that may be linked with a member
    of another component, by both components: ``lo`` is the smaller, ``side`` 0 or 1 that of ``c``. ``home`` is the
    smallest member of a list: lists of the same classes mostly meet in a task, which gives a row once."""

    def run(batches):
        seen: set[tuple[int, ...]] = set()
        for _, (c, r, n, pos, wide) in _groups(batches, "g", ("c", "r", "n", "pos", "wide")):
            c, r, n, pos, sigs = c.to_numpy(), r.to_numpy(), n.to_numpy(), pos.to_numpy(), wide.to_pylist()
            sig = _bits(sigs)
            _, of, count = np.unique(r, return_inverse=True, return_counts=True)
            # all but the members of the largest component, against everybody
            few = np.flatnonzero(of != count.argmax())
            found = [np.zeros((0, 4), np.int64)]
            step = max(1, (1 << 19) // len(c))
            for a in range(0, len(few), step):
                i = few[a : a + step]
                low, high = np.minimum(n[i][:, None], n), np.maximum(n[i][:, None], n)
                # n-grams before a common one may be common too, those after it at most as the shorter rest
                most = np.minimum(pos[i][:, None], pos) + np.minimum((n - pos)[i][:, None], n - pos)
                x, j = np.nonzero((r[i][:, None] != r) & (den * low >= num * high) & ((num + den) * most >= num * (low + high)))
                i = i[x]
                for k in range(0, len(i), 1 << 17):
                    x, y = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
                    ok = _near(sig, sigs, x, y, n, num, den)
                    x, y = x[ok], y[ok]
                    lo, hi = np.minimum(r[x], r[y]), np.maximum(r[x], r[y])
                    for z in (x, y):
                        found.append(np.unique(np.stack((lo, hi, (r[z] > lo).astype(np.int64), c[z]), axis=1), axis=0))
            if new := [v for v in map(tuple, np.unique(np.concatenate(found), axis=0).tolist()) if v not in seen]:
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*new, strict=True)], ["lo", "hi", "side", "c"])
            if len(seen) > SEEN:
                seen.clear()

    return rows.repartition("home").sortWithinPartitions("home", "g").mapInArrow(run, "lo long, hi long, side long, c long")


def _joined(members: DataFrame, num: int, den: int) -> DataFrame:
    """``(a, b)``: a link between the two sides of each bucket of ``members(k, side, c, n, wide, x)`` that has one, verified
    on the full sets. The sides are a component each, so one link is enough."""

    def run(batches):
        for _, (side, c, n, wide, x) in _groups(batches, "k", ("side", "c", "n", "wide", "x")):
            side, c, n, sig = side.to_numpy(), c.to_numpy(), n.to_numpy(), _bits(wide.to_pylist())
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            found = [np.zeros((0, 3), np.int64)]
            for i in one.tolist():
                apart = np.bitwise_count(sig[i] ^ sig[two]).sum(axis=1, dtype=np.int64)
                low, high = np.minimum(n[i], n[two]), np.maximum(n[i], n[two])
                ok = (apart <= _most_apart(n[i] + n[two], num, den)) & (den * low >= num * high)
                found.append(np.stack((np.full(ok.sum(), i), two[ok], apart[ok]), axis=1))
            pairs = np.concatenate(found)
            if not len(pairs):
                continue
            pairs = pairs[np.argsort(pairs[:, 2], kind="stable")]
            sets = {i: np.frombuffer(x[i].as_py(), "<u8") for i in np.unique(pairs[:, :2]).tolist()}
            rows, cols = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
            link = None
            for i, j in pairs[: 4 * (len(rows) + len(cols)), :2].tolist():
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    link = i, j
                    break
            else:
                if len(pairs) > 4 * (len(rows) + len(cols)):
                    both = _shared([sets[i] for i in rows.tolist()], [sets[j] for j in cols.tolist()])
                    ok = np.argwhere(den * both >= num * (n[rows][:, None] + n[cols] - both))
                    if len(ok):
                        link = int(rows[ok[0, 0]]), int(cols[ok[0, 1]])
            if link:
                yield pa.RecordBatch.from_arrays([pa.array([c[i]], pa.int64()) for i in link], ["a", "b"])

    return cut(members.select("k", "side", "c", "n", "wide", "x").repartition("k").sortWithinPartitions("k").mapInArrow(run, "a long, b long"))


def ngram_join(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", turns: int = TURNS, limit: int = LIMIT) -> DataFrame:
    """One row for each document: ``_file, _at, doc_id, n_shingles, component_id``."""
    num, den = similarity
    d = _key(docs, id_col, text_col)
    counted = _counted(d, k)
    rank = _ranks(counted)
    every = counted.where("slot is null").select("_file", "_at", "doc_id", "n", "key")
    g = every.where("n > 0").groupBy("n", "key").agg(F.min("doc_id").alias("low"), F.min(F.struct("_file", "_at")).alias("p"))
    classes = cut(g.select("n", "key", "low", "p._file", "p._at", F.monotonically_increasing_id().alias("c")))

    prefixes = cut(_prefixes(d, rank, k, num, den).join(classes.select("_file", "_at", "c"), ["_file", "_at"]).select("c", "n", "prefix", "sig", "wide"))
    posted = prefixes.select("c", "n", F.posexplode("prefix").alias("pos", "g"))
    several = posted.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g")
    met = cut(posted.join(several, "g").select("g", "c", "n", "pos"))
    # near copies share many n-grams: of lists with the same members, told by 128 bits, one is enough
    marks = [F.bit_xor(F.xxhash64("c", F.lit(i))).alias(f"f{i}") for i in range(2)]
    alike = met.groupBy("g").agg(*marks, F.count(F.lit(1)).alias("m")).groupBy("f0", "f1", "m").agg(F.min("g").alias("g"), F.count(F.lit(1)).alias("w"))
    lists = cut(met.join(alike.select("g", "w"), "g").select("g", "c", "n", "pos", "w"))
    wide = prefixes.select("c", "wide")
    wanted = _wanted(lists.join(wide, "c"), num, den).distinct()
    sets = _sets(d, classes.join(wanted, "c"), k)

    def apart(roots: DataFrame | None) -> DataFrame:
        """The lists of several components, with the component of each member and the list's size."""
        at = _rooted(lists, roots)
        mixed = at.groupBy("g").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.count(F.lit(1)).alias("size"), F.min("c").alias("home")).where("r0 <> r1").select("g", "size", "home")
        return at.join(mixed, "g")

    roots, links = None, None
    for turn in range(turns):
        at = apart(roots)
        member = F.struct("c", "r", "n")
        hubs = at.groupBy("g").agg(*(F.min_by(member, F.struct(F.xxhash64("c", F.lit(HUBS * turn + h)), "c")).alias(f"h{h}") for h in range(HUBS)))
        hubs = hubs.select("g", F.explode(F.array_distinct(F.array(*(f"h{h}" for h in range(HUBS))))).alias("hub"))
        own = at.join(hubs, "g").where((F.col("r") != F.col("hub.r")) & _like(F.col("n"), F.col("hub.n"), num, den))
        shared = own.groupBy("c", F.col("hub.c").alias("b")).agg(F.sum("w").alias("m"))
        best = shared.groupBy("c").agg(F.slice(F.sort_array(F.collect_list(F.struct("m", "b")), asc=False), 1, 2).alias("two")).select(F.col("c").alias("a"), F.explode("two.b").alias("b"))
        found = _verified(cut(_close(best, prefixes, num, den)), sets, num, den)
        links = found if links is None else links.unionByName(found)
        roots = cut(components(links))

    at = apart(roots).join(wide, "c")
    # a list above the limit is compared by slices, any two of which meet in half the limit
    slices = F.when(F.col("size") > limit, F.ceil(2 * F.col("size") / limit)).otherwise(1).cast("long")
    at = at.withColumns({"slices": slices, "t": F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))})
    s = F.pmod(F.xxhash64("c"), F.col("slices"))
    at = at.withColumn("g", F.when(F.col("slices") == 1, F.col("g")).otherwise(F.xxhash64("g", F.least(s, "t"), F.greatest(s, "t"))))
    need = cut(_partners(at.select("home", "g", "c", "r", "n", "pos", "wide"), num, den).distinct())
    held = prefixes.select("c", "n", "wide").join(sets, "c")
    found = _joined(_buckets(need, prefixes.select("c", "n")).join(held, "c"), num, den)
    roots = cut(components(found if links is None else links.unionByName(found)))

    of = _rooted(classes.select("n", "key", "low", "c"), roots)
    of = of.join(of.groupBy("r").agg(F.min("low").alias("least")), "r").select("n", "key", "least")
    out = every.join(of, ["n", "key"], "left")
    return out.select("_file", "_at", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
