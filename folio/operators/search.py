"""Search predicates: each parameter is a boolean Column; a search is their conjunction."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import columns as C


def every(*parts: Column | None) -> Column:
    """All parameters that are given must hold."""
    given = [F.coalesce(p, F.lit(False)) for p in parts if p is not None]
    return reduce(Column.__and__, given, F.lit(True))


def some(*parts: Column) -> Column:
    return reduce(Column.__or__, (F.coalesce(p, F.lit(False)) for p in parts), F.lit(False))


def _terms(query: str) -> list[str]:
    """Query words, folded as the tokens are."""
    low = query.lower()
    for a, b in (("ae", "a"), ("oe", "o"), ("ue", "u"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("ß", "ss")):
        low = low.replace(a, b)
    low = low.translate(str.maketrans("àáâãåçèéêëìíîïñòóôõùúûýÿ", "aaaaaceeeeiiiinoooouuuyy"))
    return [w for w in re.split(r"[\W_]+", low) if w and w not in C.STOP_WORDS]


def all_terms(tokens: Column, query: str) -> Column:
    """Every word of the query is a token; a query of stop words alone finds nothing."""
    words = _terms(query)
    return every(*(F.array_contains(tokens, w) for w in words)) if words else F.lit(False)


def any_term(tokens: Column, query: str) -> Column:
    words = _terms(query)
    return some(*(F.array_contains(tokens, w) for w in words)) if words else F.lit(False)


def across(fields: Sequence[Column], query: str) -> Column:
    """Every word in some field: the fields count as one."""
    return all_terms(F.flatten(F.array_compact(F.array(*fields))), query)


def phrase(tokens: Column, query: str) -> Column:
    """The words of the query side by side, in their order."""
    words = _terms(query)
    n = len(words)
    if not n:
        return F.lit(False)
    want = F.array(*map(F.lit, words))
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    return F.exists(starts, lambda i: F.slice(tokens, i, F.lit(n)) == want)


def prefix(tokens: Column, start: str) -> Column:
    return F.exists(tokens, lambda t: t.startswith(start.lower()))


def wildcard(tokens: Column, pattern: str) -> Column:
    """``*`` is any run of characters, ``?`` one."""
    like = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())
    return F.exists(tokens, lambda t: t.rlike(C.full(like)))


def exists(field: Column) -> Column:
    return field.isNotNull()


def values(field: Column, parameter: str) -> Column:
    """A comma list of alternatives; the suffix ``,AND`` asks for all of them. ``field`` is an array."""
    parts = [p.strip() for p in parameter.split(",") if p.strip()]
    both = parts[-1:] == ["AND"]
    parts = parts[:-1] if both else parts
    want = F.array(*map(F.lit, parts))
    return F.size(F.array_intersect(field, want)) == len(set(parts)) if both else F.arrays_overlap(field, want)


def issued(year: Column, parameter: str) -> Column:
    """``a-b`` with both ends included, ``*`` for an open end; anything else is equality."""
    parts = [p.strip() for p in parameter.split("-")]
    while parts and not parts[-1]:
        parts.pop()  # 1990- is no range
    if len(parts) == 2:
        y = year.try_cast("int")
        return every(*(op for p, op in zip(parts, (y >= F.lit(parts[0]).try_cast("int"), y <= F.lit(parts[1]).try_cast("int")), strict=True) if p != "*"), y.isNotNull())
    return year == (parts[0] if parts else "")


def normal_id(parameter: str) -> str:
    """Blanks go; so do hyphens, where ten or thirteen digits remain."""
    bare = parameter.replace(" ", "")
    digits = bare.replace("-", "")
    return digits if re.fullmatch(r"\d{9}[\dXx]|\d{13}", digits) else bare


def by_id(fields: Sequence[Column], parameter: str) -> Column:
    want = normal_id(parameter)
    return some(*(f == want for f in fields))


def agent(label: Column, alt: Column, ids: Column, born: Column, died: Column, parameter: str, id_prefix: str = "") -> Column:
    """Four readings: name with life dates, several ids that all must be there, one id, words of a label."""
    if m := re.fullmatch(r"(.+?)\s*\((\d*)-(\d*)\)", parameter):
        return every(all_terms(label, m[1]), *(f == v for f, v in ((born, m[2]), (died, m[3])) if v))
    parts = [p.strip() for p in parameter.split(",") if p.strip()]
    full = lambda p: p if p.startswith("http") else id_prefix + p
    if parts[-1:] == ["AND"]:
        return every(*(F.array_contains(ids, full(p)) for p in parts[:-1]))
    if re.fullmatch(r"https?://\S+|[\d\-X]{8,}", parameter):
        return F.array_contains(ids, full(parameter))
    return some(all_terms(label, parameter), all_terms(alt, parameter))


def subject(labels: Column, ids: Column, parameter: str, id_prefix: str = "") -> Column:
    """Ids match ids, other words match labels; commas part alternatives only if there is an id."""
    parts = [p.strip() for p in parameter.split(",") if p.strip()]
    both = parts[-1:] == ["AND"]
    parts = parts[:-1] if both else parts
    is_id = lambda p: bool(re.fullmatch(r"https?://\S+|[\d\-X]+", p))
    if not any(map(is_id, parts)):
        return all_terms(labels, " ".join(parts))
    tests = [F.array_contains(ids, p if p.startswith("http") else id_prefix + p) if is_id(p) else all_terms(labels, p) for p in parts]
    strict = both or not all(map(is_id, parts))
    return every(*tests) if strict else some(*tests)


def owner(items: Column, item_owner: Callable[[Column], Column], parameter: str, pre: str = "", post: str = "") -> Column:
    """Some item is held by one of the owners, given as ids or as whole names."""
    want = [p.strip() if p.strip().startswith("http") else f"{pre}{p.strip()}{post}" for p in parameter.split(",") if p.strip()]
    return F.exists(items, lambda i: item_owner(i).isin(*want))


def nested(items: Column, *conditions: Callable[[Column], Column]) -> Column:
    """Some element meets all conditions at once."""
    return F.exists(items, lambda e: reduce(Column.__and__, (F.coalesce(c(e), F.lit(False)) for c in conditions)))


def flat(items: Column, *conditions: Callable[[Column], Column]) -> Column:
    """Every condition is met by some element."""
    return every(*(F.exists(items, c) for c in conditions))


def point(parameter: str) -> tuple[float, float]:
    """``lat,lon``, or the centre of a geohash."""
    if "," in parameter:
        lat, lon = parameter.split(",")
        return float(lat), float(lon)
    lo, hi, even = [-90.0, -180.0], [90.0, 180.0], True
    for c in parameter.lower():
        v = "0123456789bcdefghjkmnpqrstuvwxyz".index(c)
        for b in (16, 8, 4, 2, 1):
            k = 1 if even else 0
            mid = (lo[k] + hi[k]) / 2
            lo[k], hi[k] = (mid, hi[k]) if v & b else (lo[k], mid)
            even = not even
    return (lo[0] + hi[0]) / 2, (lo[1] + hi[1]) / 2


def location(lat: Column, lon: Column, parameter: str, metres: float = 100.0) -> Column:
    """Near one or two points, or within a polygon of three or more; points are parted by blanks."""
    points = [point(p) for p in parameter.split()]
    if len(points) < 3:
        return some(*(C.haversine_m(lat, lon, a, b) <= metres for a, b in points))
    return C.in_polygon(lat, lon, points)


def page(hits: DataFrame, start: int = 0, size: int = 15) -> DataFrame:
    return hits.offset(start).limit(size)


def sorted_hits(hits: DataFrame, order: str, date: str, key: str, score: str | None = None) -> DataFrame:
    """``newest``, ``oldest``, or relevance; missing dates last, ties by key."""
    by = F.desc_nulls_last(date) if order == "newest" else F.asc_nulls_last(date) if order == "oldest" else F.desc_nulls_last(score or key)
    return hits.orderBy(by, F.asc(key))


def record_of(item_id: Column) -> Column:
    """The record of an item id: what stands before the first colon."""
    return F.substring_index(item_id, ":", 1)


def deletions(table: DataFrame, tokens: Column, query: str, date: str, size: int) -> DataFrame:
    """The newest announced deletions whose text has all words of the query; all of them for ``*``."""
    hits = table if query == "*" else table.where(all_terms(tokens, query))
    return hits.orderBy(F.desc_nulls_last(date)).limit(size)


def visible(hits: DataFrame, *internal: str) -> DataFrame:
    """Hits without fields that are for the search alone."""
    return hits.drop(*internal)
