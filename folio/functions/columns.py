"""Value-level operators: the verbs of record transformation as functions from Column to Column.

Everything here is a composition of built-in expressions, so that a whole record transformation stays one
narrow stage. "Absent" means null, an empty string, or an empty array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: else an expression grows with every mention of its input."""
    return F.element_at(F.transform(F.array(x), body), 1)


def present(x: Column) -> Column:
    """The string, or null where it is empty or blank."""
    return let(F.trim(x), lambda v: F.when(v != "", v))


def compacted(values: Column) -> Column:
    """An array without null and empty strings; null where nothing is left."""
    return let(F.filter(values, lambda v: v.isNotNull() & (v != "")), lambda kept: F.when(F.size(kept) > 0, kept))


def replace_all(x: Column, *rules: tuple[str, str]) -> Column:
    """Regular-expression replacements, one after another."""
    for pattern, by in rules:
        x = F.regexp_replace(x, pattern, by)
    return x


def replace_each(values: Column, *rules: tuple[str, str]) -> Column:
    return F.transform(values, lambda v: replace_all(v, *rules))


def paste(*parts: Column | str, sep: str = " ") -> Column:
    """Joins what is present; null if nothing is. Strings are literals."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return let(F.concat_ws(sep, *cols), lambda v: F.when(v != "", v))


def joined(values: Column, sep: str) -> Column:
    return let(F.array_join(values, sep), lambda v: F.when(v != "", v))


def uniq(values: Column) -> Column:
    """Distinct elements in the order of their first."""
    return F.array_distinct(values)


def prefixed(x: Column, prefix: str) -> Column:
    """An affix that leaves missing values missing."""
    return F.concat(F.lit(prefix), x)


def suffixed(x: Column, suffix: str) -> Column:
    return F.concat(x, F.lit(suffix))


def fixed(x: Column, start: int, length: int = 1) -> Column:
    """Positions of a fixed-width field, counted from 0; null beyond its end."""
    return F.nullif(F.substring(x, start + 1, length), F.lit(""))


def full(pattern: str) -> str:
    """The pattern, to be matched as a whole."""
    return f"^(?:{pattern})$"


def any_match(values: Column, pattern: str) -> Column:
    return F.coalesce(F.exists(values, lambda v: v.rlike(full(pattern))), F.lit(False))


def all_match(values: Column, pattern: str) -> Column:
    """False where there is nothing to match."""
    return F.coalesce((F.size(values) > 0) & F.forall(values, lambda v: v.rlike(full(pattern))), F.lit(False))


def none_match(values: Column, pattern: str) -> Column:
    return ~any_match(values, pattern)


def any_equal(values: Column, literal: str) -> Column:
    return F.coalesce(F.array_contains(values, literal), F.lit(False))


def all_equal(values: Column, literal: str) -> Column:
    return F.coalesce((F.size(values) > 0) & F.forall(values, lambda v: v == literal), F.lit(False))


def any_contain(values: Column, literal: str) -> Column:
    return F.coalesce(F.exists(values, lambda v: v.contains(literal)), F.lit(False))


def none_contain(values: Column, literal: str) -> Column:
    return ~any_contain(values, literal)


def occurs_in(a: Column, b: Column) -> Column:
    """Some value of ``a`` is one of ``b``."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def is_repeated(values: Column) -> Column:
    return F.coalesce(F.size(values) > 1, F.lit(False))


def is_empty(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def less_than(x: Column, limit: int) -> Column:
    """Numeric comparison of strings; false where there is no number."""
    return F.coalesce(x.try_cast("int") < limit, F.lit(False))


def greater_than(x: Column, limit: int) -> Column:
    return F.coalesce(x.try_cast("int") > limit, F.lit(False))


def minus(x: Column, n: int | Column) -> Column:
    """String arithmetic: null where there is no number."""
    return (x.try_cast("int") - n).cast("string")


def first_of(rules: Sequence[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    """The value of the first rule whose condition holds."""
    out = None
    for condition, value in rules:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise) if otherwise is not None else out


def labels_of(rules: Sequence[tuple[Column, str]]) -> Column:
    """The labels of all rules whose conditions hold, in the order of the rules."""
    return F.array_compact(F.array(*(F.when(c, F.lit(v)) for c, v in rules)))


def first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def nth(values: Column, n: int) -> Column:
    """Counted from 0."""
    return F.try_element_at(values, F.lit(n + 1))


def zipped(**lists: Column) -> Column:
    """Parallel lists as an array of structs; shorter ones are padded with null."""
    names = list(lists)
    z = F.arrays_zip(*(lists[n].alias(n) for n in names))
    return F.transform(z, lambda s: F.struct(*(s[n].alias(n) for n in names)))


def nested(values: Column, path: Callable[[Column], Column]) -> Column:
    """One list of what ``path`` gives for every element."""
    return F.flatten(F.transform(values, path))


def uri_encoded(x: Column) -> Column:
    """Percent-encoding with %20 for blanks."""
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def mapped(x: Column, table: dict[str, str], keep: bool = False) -> Column:
    """A small fixed map; unmatched keys become null, or stay."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    got = F.try_element_at(F.create_map(*pairs), x)
    return F.coalesce(got, x) if keep else got


# --- standard numbers -------------------------------------------------------------------------------


def isbn_clean(x: Column) -> Column:
    """Digits and a final X of the first thing that looks like an ISBN; null if there is none."""
    bare = F.upper(F.regexp_replace(F.regexp_extract(x, r"([0-9][0-9Xx ‐-―-]{8,})", 1), r"[^0-9Xx]", ""))
    thirteen = lambda b: F.nullif(F.regexp_extract(b, r"^(97[89]\d{10})", 1), F.lit(""))
    ten = lambda b: F.nullif(F.regexp_extract(b, r"^(\d{9}[\dX])$", 1), F.lit(""))
    return let(bare, lambda b: F.coalesce(thirteen(b), ten(b)))


def _digit(x: Column, i: int) -> Column:
    return F.substring(x, i, 1).try_cast("int")


def isbn13(x: Column) -> Column:
    """The 13-digit form of a clean ISBN."""

    def complete(stem: Column) -> Column:
        total = sum((_digit(stem, i) * (3 if i % 2 == 0 else 1) for i in range(1, 13)), F.lit(0))
        return F.concat(stem, F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))

    return let(let(x, lambda v: F.when(F.length(v) == 13, F.substring(v, 1, 12)).when(F.length(v) == 10, F.concat(F.lit("978"), F.substring(v, 1, 9)))), complete)


def isbn10(x: Column) -> Column:
    """The 10-digit form; null for numbers outside 978."""

    def complete(stem: Column) -> Column:
        total = sum((_digit(stem, i) * (11 - i) for i in range(1, 10)), F.lit(0))
        check = F.pmod(11 - F.pmod(total, F.lit(11)), F.lit(11))
        return F.concat(stem, F.when(check == 10, F.lit("X")).otherwise(check.cast("string")))

    return let(let(x, lambda v: F.when(F.length(v) == 10, F.substring(v, 1, 9)).when((F.length(v) == 13) & v.startswith("978"), F.substring(v, 4, 9))), complete)


# --- dates -------------------------------------------------------------------------------------------


def year_of(x: Column) -> Column:
    """The first year from 0000 to 2099 in a text."""
    return F.nullif(F.regexp_extract(x, r"([01]\d{3}|20\d{2})", 1), F.lit(""))


def year_or_guess(x: Column, guess: Column, this_year: int) -> Column:
    """A year in the future gives way to ``guess``, if that isn't in the future itself."""
    y = year_of(x)
    return F.when((y.try_cast("int") > this_year) & (guess.try_cast("int") <= this_year), guess).otherwise(y)


def repaired_date(x: Column) -> Column:
    """Days that a month doesn't have become its last, as in YYYY-MM-DD strings.

    Only leap years from 1800 to 2099 are known; every other February ends on the 28th.
    """
    return let(x, _repaired)


def _repaired(x: Column) -> Column:
    y = F.substring(x, 1, 4).try_cast("int")
    leap = y.between(1800, 2099) & (((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0))
    body = F.substring(x, 1, 8)
    return (
        F.when(x.rlike(r"^\d{4}-02-29$") & ~F.coalesce(leap, F.lit(False)), F.concat(body, F.lit("28")))
        .when(x.rlike(r"^\d{4}-02-3[01]$"), F.concat(body, F.lit("28")))
        .when(x.rlike(r"^\d{4}-(04|06|09|11)-31$"), F.concat(body, F.lit("30")))
        .otherwise(x)
    )


def date_from_six(x: Column) -> Column:
    """YYMMDD as a date string: 00 to 49 are years of this century."""
    century = F.when(F.substring(x, 1, 2).try_cast("int") <= 49, F.lit("20")).otherwise(F.lit("19"))
    return F.when(x.rlike(r"^\d{6}$"), repaired_date(F.concat(century, F.substring(x, 1, 2), F.lit("-"), F.substring(x, 3, 2), F.lit("-"), F.substring(x, 5, 2))))


def padded_year(x: Column) -> Column:
    """Years of life dates with four digits; ``v`` marks years before the common era."""
    bce = F.regexp_extract(x, r"^v(\d+)$", 1)
    return F.when(bce != "", F.concat(F.lit("-"), F.lpad(bce, 4, "0"))).when(x.rlike(r"^\d{1,4}$"), F.lpad(x, 4, "0"))


def life_dates(x: Column) -> tuple[Column, Column]:
    """Birth and death from ``YYYY-YYYY``, either side may be open."""
    born, died = (F.nullif(F.regexp_extract(x, r"^\s*(v?\d{1,4})?\s*-\s*(v?\d{1,4})?\s*$", i), F.lit("")) for i in (1, 2))
    return padded_year(born), padded_year(died)


# --- geometry ----------------------------------------------------------------------------------------


def haversine_m(lat1: Column, lon1: Column, lat2: Column | float, lon2: Column | float) -> Column:
    """Metres between two points of a sphere with the Earth's mean radius."""
    lat2, lon2 = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lat2, lon2))
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_polygon(lat: Column, lon: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Ray casting over (lat, lon) corners, behind a bounding box."""
    lats, lons = [c[0] for c in corners], [c[1] for c in corners]
    inside = F.lit(False)
    for (y1, x1), (y2, x2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1)
            inside = inside != crosses
    return lat.between(min(lats), max(lats)) & lon.between(min(lons), max(lons)) & inside


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """The geohash cell of a point, from the interleaved bits of its scaled coordinates."""
    letters = "0123456789bcdefghjkmnpqrstuvwxyz"
    bits = 5 * precision
    of_lon, of_lat = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180) / 360 * float(1 << of_lon)), F.lit((1 << of_lon) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * float(1 << of_lat)), F.lit((1 << of_lat) - 1)).cast("long")

    def letter(k: int) -> Column:
        value = F.lit(0)
        for b in range(5):
            i = 5 * k + b  # even bits are of the longitude, from the highest on
            source, at = (x, of_lon - 1 - i // 2) if i % 2 == 0 else (y, of_lat - 1 - i // 2)
            value = value + F.shiftright(source, at).bitwiseAND(F.lit(1)) * (1 << (4 - b))
        return F.substring(F.lit(letters), (value + 1).cast("int"), F.lit(1))

    return F.concat(*(letter(k) for k in range(precision)))


# --- text analysis -----------------------------------------------------------------------------------

#: Stop words of titles, German and English.
STOP_WORDS = ("der", "die", "das", "und", "ein", "eine", "des", "dem", "den", "the", "of", "and", "a", "an")
#: Endings that the light stemmer takes off, longest first.
ENDINGS = ("erinnen", "ern", "em", "en", "er", "es", "e", "s", "n")


def folded(x: Column) -> Column:
    """Lower case without accents; umlauts, their transcriptions and their bare vowels are equal."""
    low = F.lower(x)
    for two, one in (("ae", "a"), ("oe", "o"), ("ue", "u"), ("ß", "ss")):
        low = F.replace(low, F.lit(two), F.lit(one))
    return F.translate(low, "äöüàáâãåçèéêëìíîïñòóôõùúûýÿ", "aouaaaaaceeeeiiiinoooouuuyy")


def tokens(x: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Folded words in their order, without stop words."""
    words = F.filter(F.split(folded(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def stemmed(word: Column) -> Column:
    """One ending off, where at least four letters stay."""
    return F.regexp_replace(word, r"^(.{4,}?)(?:%s)$" % "|".join(ENDINGS), "$1")


def stems(x: Column) -> Column:
    return F.transform(tokens(x), stemmed)


def std_number(x: Column) -> Column:
    """A standard number without blanks and hyphens."""
    return F.upper(F.regexp_replace(x, r"[\s-]", ""))
