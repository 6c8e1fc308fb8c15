"""Rules as data: kinds and media of records by a table of tests, compiled to one narrow stage.

A rule gives its labels if any of its tests holds; ``unless`` tests take it back. A test is a tuple: a selector's
name and what to look for. The selectors are values of the record that many tests read, such as the cut-down extents;
they are bound once, whatever the number of rules.

Positions of 008 and 006 are one test: 006 repeats, eighteen characters on, what 008 says of a form, so that
``("fixed", forms, positions, codes)`` looks at both. Where a pattern of the common practice for 006 is
malformed, what was meant holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import columns as C
from folio.functions import marc as M

from . import links

Test = tuple


class Rule(NamedTuple):
    labels: tuple[str, ...]
    tests: tuple[Test, ...]
    unless: tuple[Test, ...] = ()


#: Forms of material, by leader positions 6 and 7, and their letters in 006.
FORMS = (
    ("book", "a[acdm]|t.", "at"), ("continuing", "a[bis]|m[bis]", "s"), ("file", "m[^bis]", "m"), ("music", "[cdij].", "cdij"),
    ("map", "[ef].", "ef"), ("visual", "[gkor].", "gkor"), ("mixed", "p.", "p"),
)
_TEXTUAL, _SHEETS = ("book", "music", "continuing", "mixed"), ("map", "visual")


def _carried(codes: str, *more: str) -> tuple[Test, ...]:
    """The form of item: its position depends on the form of material."""
    return ("fixed", (*_TEXTUAL, *more), (23,), codes), ("fixed", _SHEETS, (29,), codes)


def _contents(codes: str) -> Test:
    return "fixed", ("book", "continuing"), (24, 25, 26, 27), codes


#: Media, the codes and words that speak for each, in the order of the output.
MEDIA = (
    Rule(("Audio-Dokument",), (
        ("lead", "[ij]."), ("form", "ij"), ("007", "s.*"), ("fixed", ("file",), (26,), "h"), ("media", "audio"), ("carrier code", "s"), ("gmd", "[Tt][oO].*|Audio-CD"),
        ("carrier", "Audiodisk|Audiokassette|Audiocartridge|Notenrolle|Phonographenzylinder|Tonbandspule|Sonstige Tonträger"), ("content", ".*(Hörbuch|Hörspiel|Tonträger).*"),
        ("extent", ".*(Tonkassette|Schallplatte|Schallpl.|Magnetbandkassette|Kompaktkassette|Compact-Disk|Compact-Disc|CD |CD$).*"),
    )),
    Rule(("Audio-Kassette",), (("007", "ss.*"), ("gmd", "Kompaktkassette|MC|Tonkassette"), ("extent", ".*Kompaktkassette.*"))),
    Rule(("Video", "Audio-Visuell"), (
        ("007", "[gmv].*"), ("fixed", ("visual",), (33,), "fmstv"), ("gmd", "Bildtonträger"), ("extent", ".*(DVD-Video|Video).*"), ("media", "video"), ("media code", "v"),
        ("carrier", "Video.*|Sonstige Video-Datenträger"), ("carrier code", "vd"), ("content", ".*(DVD-Video|Film|Video[ck]assette).*"),
    )),
    Rule(("Blindenschrift", "Print"), (("007", "fb.*|tc.*"), *_carried("f"), ("language note", ".*Braille.*"), ("content", ".*Blindendruck.*"))),
    Rule(("Print",), (("007", "(k[fhjs]|t.).*"),), (("lead", "[dftgij]."),)),
    Rule(("Print",), (*_carried("dr"), ("gmd", "Plakat"), ("edition", "Nachdruck|Reprint"))),
    Rule(("Print",), (("is", "map"),), (("media code", "c"),)),
    Rule(("Datenträger",), (
        ("lead", "m."), ("form", "m"), ("007", "c.*"), *_carried("sq"), ("media", "Computermedien"), ("carrier code", "c."),
        ("carrier", ".*([Cc]omputer|informatique|Magnetband|Speicherkarte).*"),
        ("material", ".*(Elektronische Ressource|Blu-ray|Cartridge|CD|Computerdatei|Diskette|DVD|E-Books|Einsteckmodul|Festplatte|Kassette|Elektron. Ressource|Funknetz-Karte|Optische|USB-Stick).*"),
    )),
    Rule(("Manuskript",), (("lead", "[dft]."), ("form", "dft"), ("content", ".*(Musikhandschrift|Handschrift).*"))),
    Rule(("Mikroformat",), (
        ("007", "h.*"), *_carried("abc"), ("gmd", ".*Mikrofor.*"), ("edition", ".*Mikro.*"), ("media", "Mikroform|microform"), ("media code", "h"), ("carrier", ".*[Mm]ikro.*"),
        ("carrier code", "he|hj"), ("content", ".*Mikroform.*"),
    )),
    Rule(("Kombination",), (("lead", "[op]."), ("form", "op"), ("007", "o.*"), ("gmd", ".*Medienkombination.*"), ("content", ".*Medienkombination.*"))),
    Rule(("Online-Ressource",), (
        *_carried("o", "file"), ("007", "cr.*"), ("extent", ".*([Oo]nline|ressource en ligne).*"), ("carrier", ".*([Oo]nline|ressource en ligne).*"), ("carrier code", "cr"),
        ("material", "Online-Ressource"), ("content", ".*(Website|Weblog).*"),
    )),
    Rule(("Schallplatte", "Audio-Dokument"), (("extent", ".*Schallpl.*"), ("material", "[Vv]inyl"))),
)

#: Kinds, likewise.
KINDS = (
    Rule(("ArchivedWebPage",), (("archived", "Archivierte Online-Ressource"),), (("no content", "Website"),)),
    Rule(("Bibliography",), (_contents("bknq"), ("fixed", ("file",), (26,), "e"), ("content", ".*Bibliografie.*"))),
    Rule(("Biography",), (("fixed", ("book",), (34,), "abc"), ("fixed", ("music",), (30, 31), "ab"), _contents("h"), ("content", ".*(Autobiographie|Autobiografie|Biographie|Biografie).*"))),
    Rule(("Database",), (("fixed", ("continuing",), (21,), "d"), ("content", ".*[Da]tenbank.*"), ("portfolio", "DATABASE"), ("file code", "a"), ("link note", "DBIS"))),
    Rule(("EditedVolume",), (("content", ".*Aufsatzsammlung.*"),)),
    Rule(("Festschrift",), (("fixed", ("book",), (30,), "1"), ("content", ".*Festschrift.*"))),
    Rule(("Festschrift",), (("any title", ".*Festschrift.*"),), (("lead", ".a"),)),
    Rule(("Image",), (
        ("007", "[kr].*"), ("gmd", ".*Bildli.*"), ("fixed", ("map",), (33, 34), "jo"), ("fixed", ("visual",), (33,), "dikln"),
        ("content", "Bild|Diagramm|Fotografie|Grafik|Plakat|Postkarte|Röntgenbild|Zeichnung|Technische Zeichnung"),
    )),
    Rule(("Game",), (("fixed", ("file",), (26,), "g"), ("fixed", ("map",), (33, 34), "pn"), ("fixed", ("visual",), (33,), "g"), ("content", "Spiel"))),
    Rule(("Map",), (("is", "map"), ("form", "ef"), ("007", "[ad].*"), ("content", ".*(Altkarte|Karte|Stadtplan|Weltkarte).*"))),
    Rule(("Map",), (("extent", ".*(Kt.|[kK]arte).*"),), (("found", "Game"), ("extent", ".*Spiel.*"))),
    Rule(("Legislation",), (_contents("l"),)),
    Rule(("MusicalRecording",), (("lead", "j."), ("form", "j"))),
    Rule(("MultiVolumeBook",), (("whole lead", ".{7}m.{11}a.*"),)),
    Rule(("PublishedScore", "Book"), (("lead", "[cd]m"),), (("extent", ".*(CD|Schallpl).*"),)),
    Rule(("PublishedScore",), (("lead", "[cd]."), ("gmd", ".*Musikdruck.*"), ("music number", ".*"), ("content", "Musikhandschrift"), ("extent", ".*Partitur.*"), ("notation", ".*")), (("extent", ".*(CD|Schallpl).*"),)),
    Rule(("Newspaper", "Periodical"), (("fixed", ("continuing",), (21,), "n"), ("content", ".*Zeitung.*"))),
    Rule(("Standard",), (_contents("u"), ("content", ".*(Norm|Richtlinie).*"))),
    Rule(("Periodical",), (("fixed", ("continuing",), (21,), "p"), ("content", "(?i).*(Zeitschrift|Periodical).*"), ("portal kind", "JOURNAL"))),
    Rule(("Periodical",), (("portfolio", "JOURNAL"),), (("portfolio", "BOOK"),)),
    Rule(("Proceedings",), (("fixed", ("book", "continuing"), (29,), "1"), ("content", ".*(Kongress|Konferenzschrift).*"))),
    Rule(("PublicationIssue",), (("issue", ".*"),)),
    Rule(("ReferenceSource",), (_contents("der"), ("content", ".*(Bestimmungsbuch|Enzyklopädie|Werkverzeichnis|[Ww](ö|(oe))rterbuch).*"))),
    Rule(("Report",), (_contents("t"), ("content", ".*(Bericht|Erlebnisbericht|Forschungsbericht|Literaturbericht|Reisebericht).*"))),
    Rule(("Schoolbook",), (("content", ".*Schulbuch.*"),)),
    Rule(("Series",), (("fixed", ("continuing",), (21,), "m"), ("content", ".*(Monografische Reihe|Schriftenreihe).*"))),
    Rule(("Statistics",), (_contents("s"), ("content", ".*Statistik.*"))),
    Rule(("Thesis",), (_contents("m"), ("content", ".*Hochschulschrift.*"))),
    Rule(("Book",), (
        ("lead", "a[cdm]|t.|[cd]m"), ("form", "at"), ("book code", "[abcdefgh]"),
        ("content", ".*(Adressbuch|Anthologie|Atlas|Auktionskatalog|Ausstellungskatalog|Backbuch|Bestimmungsbuch|Bildband|Bilderbuch|Drehbuch|Jugendbuch|Jugendsachbuch|Kinderbuch|Kindersachbuch|Kochbuch|Künstlerbuch|Lehrbuch|Lehrerhandbuch|Lesebuch|Liederbuch|Sachbilderbuch|Schulbuch|Tagebuch|Telefonbuch|[Ww]örterbuch).*"),
    ), (("serial number", ".*"), ("lead", ".[abis]"), ("found", "Game"), ("found", "ArchivedWebPage"), ("medium", ".*(Video|Audio).*"))),
)


def _selectors(contents: Column, more: dict[str, Column]) -> dict[str, Column]:
    """What tests read: arrays of strings, nulls left out."""
    lead = C.fixed(F.col("leader"), 6, 2)
    form = C.first_of([(lead.rlike(C.full(p)), name) for name, p, _ in FORMS])
    extents = F.transform(F.flatten(F.transform(M.fields("300  "), lambda f: M.sub(f, "a"))), lambda a: F.regexp_replace(a, "[:;].*", ""))
    links_ = M.fields("856??")
    found = {
        "lead": F.array(lead), "whole lead": F.array(F.col("leader")), "is": F.array(form), "007": M.controls("007"), "form": F.transform(M.controls("006"), lambda x: F.substring(x, 1, 1)),
        "008": F.slice(M.controls("008"), 1, 1), "006": M.controls("006"), "gmd": M.values("245[10]0", "h"), "edition": M.values("25[09]??", "a"), "language note": M.values("546 ?", "a"),
        "media": M.values("337  ", "a"), "media code": M.values("337  ", "b"), "carrier": M.values("338  ", "a"), "carrier code": M.values("338  ", "b"), "material": M.values("340  ", "a"),
        "extent": extents, "content": contents, "portfolio": M.values("POR??", "f"), "file code": M.values("090  ", "g"), "book code": M.values("090  ", "h"), "link note": F.flatten(F.transform(links_, lambda f: M.sub(f, "x"))),
        "archived": F.flatten(F.transform(links_, lambda f: M.sub(f, "zx"))), "portal kind": M.controls("906"), "music number": M.values("0242?", "a"), "notation": F.transform(M.fields("348  "), lambda f: f["tag"]),
    }
    return {k: F.array_compact(v) for k, v in (found | more).items()}


def _alternation(tests: Sequence[Test]) -> list[Test]:
    """Tests of one selector as one."""
    out: dict = {}
    for t in tests:
        out.setdefault(t[0] if t[0] != "fixed" else t, []).append(t[1])
    return [k if isinstance(k, tuple) else (k, "|".join(f"(?:{p})" for p in v) if k != "form" else "".join(v)) for k, v in out.items()]


def _holds(test: Test, s: Column, found: Column | None) -> Column:
    name, *said = test
    if name == "fixed":
        forms, positions, codes = said
        letters = "".join(six for f, _, six in FORMS if f in forms)
        is_form = F.exists(s["is"], lambda k: k.isin(*forms))
        at = lambda x, shift: reduce(Column.__or__, (F.substring(x, p - shift + 1, 1).isin(*codes) for p in positions))
        return (is_form & F.exists(s["008"], lambda x: at(x, 0))) | F.exists(s["006"], lambda x: F.substring(x, 1, 1).isin(*letters) & at(x, 17))
    if name == "form":
        return F.exists(s["form"], lambda x: x.isin(*said[0]))
    if name == "found":
        return F.array_contains(found, said[0])
    if name == "no content":
        return ~C.any_equal(s["content"], said[0])
    return C.any_match(s[name], said[0])


def applied(rules: Sequence[Rule], s: Column) -> Column:
    """The labels of all rules that hold, once each, in the order of the rules. Rules that ask what others have
    ``found`` see all labels of the rules that don't; with such rules a label stands where its last rule does."""

    def of(rule: Rule, found: Column | None) -> Column:
        any_of = lambda tests: reduce(Column.__or__, (F.coalesce(_holds(t, s, found), F.lit(False)) for t in tests), F.lit(False))
        return F.when(any_of(_alternation(rule.tests)) & ~any_of(rule.unless), F.array(*map(F.lit, rule.labels)))

    def asks(rule: Rule) -> bool:
        return any(t[0] == "found" for t in (*rule.tests, *rule.unless))

    flat = lambda parts: F.flatten(F.array_compact(F.array(*parts)))
    if not any(map(asks, rules)):
        return C.uniq(flat([of(r, None) for r in rules]))
    first = flat([of(r, None) for r in rules if not asks(r)])
    every = lambda found: F.struct(found.alias("first"), flat([of(r, found) for r in rules if asks(r)]).alias("then"))
    both = C.let(first, every)
    order = list(dict.fromkeys(label for r in reversed(rules) for label in reversed(r.labels)))[::-1]
    return C.let(both, lambda b: F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(b["first"], x) | F.array_contains(b["then"], x)))


def media_and_kinds(serial_number: Column | None = None, issue: Column | None = None, titles: Column | None = None, contents: Column | None = None, media: Sequence[Rule] = MEDIA, kinds: Sequence[Rule] = KINDS) -> Column:
    """A struct of ``medium`` and ``type``: labels of media, and kinds after ``BibliographicResource``.

    Without a medium, books and texts are print, the rest is other; without a kind, a record is miscellaneous, and
    such component parts, biographies and bibliographies too, are articles unless they are heard or seen.
    """
    none = F.array().cast("array<string>")
    listed = lambda x: none if x is None else F.array(x.cast("string"))
    forms = F.transform(links.forms(), lambda f: f["label"]) if contents is None else contents
    more = {"serial number": listed(serial_number), "issue": listed(issue), "any title": none if titles is None else titles}
    selectors = _selectors(forms, more)
    names = {k: k for k in selectors}
    bound = F.struct(*(v.alias(names[k]) for k, v in selectors.items()))

    def decide(s: Column) -> Column:
        def with_media(m: Column) -> Column:
            wider = F.struct(*(s[k].alias(k) for k in selectors), m.alias("medium"))
            return C.let(wider, lambda w: C.let(applied(kinds, w), lambda k: finished(w, m, k)))

        return C.let(applied(media, s), with_media)

    def finished(s: Column, m: Column, k: Column) -> Column:
        shown = C.any_match(m, ".*(Audio|Video).*")
        part = C.any_match(s["lead"], ".a")
        kinds_ = F.when(F.size(k) > 0, k).otherwise(F.array(F.lit("Miscellaneous")))
        article = part & ~shown & F.arrays_overlap(kinds_, F.array(*map(F.lit, ("Miscellaneous", "Biography", "Bibliography"))))
        kinds_ = F.when(article, F.concat(F.array_remove(kinds_, "Miscellaneous"), F.array(F.lit("Article")))).otherwise(kinds_)
        rest = F.when(F.array_contains(kinds_, "Book") | C.any_match(s["lead"], "a."), "Print").otherwise("Sonstige")
        return F.struct(F.when(F.size(m) > 0, m).otherwise(F.array(rest)).alias("medium"), F.concat(F.array(F.lit("BibliographicResource")), kinds_).alias("type"))

    return C.let(bound, decide)


class Membership(NamedTuple):
    """A collection's fields: any value of ``codes`` in ``path`` that matches ``pattern`` puts a record into it.

    ``network``: only records of the network's own. An id or label with ``$1`` takes the pattern's group in.
    """

    path: str
    codes: str
    pattern: str
    iri: str
    label: str
    network: bool = False


def memberships(table: Sequence[Membership], in_network: Column, labels: dict[str, str] | None = None) -> Column:
    """The collections of a record, ``(id, label, type)``, once each by id, in the order of the table.

    ``labels`` knows the labels of ids; a label in it comes before that of the rule.
    """

    def of(m: Membership) -> Column:
        hits = F.filter(M.values(m.path, m.codes), lambda v: v.rlike(C.full(m.pattern)))
        if "$1" in m.iri:
            filled = lambda v, text: F.regexp_replace(v, C.full(m.pattern), text)
            found = F.transform(hits, lambda v: named(filled(v, m.iri), filled(v, m.label)))
        else:
            found = F.transform(F.slice(hits, 1, 1), lambda _: named(F.lit(m.iri), F.lit(m.label)))
        return F.when(in_network, found).otherwise(F.slice(found, 1, 0)) if m.network else found

    def named(iri: Column, label: Column) -> Column:
        known = F.coalesce(C.mapped(iri, labels), label) if labels else label
        return F.struct(iri.alias("id"), known.alias("label"), F.array(F.lit("Collection")).alias("type"))

    every = F.flatten(F.array(*map(of, table)))
    return C.let(every, lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, F.lit(1), i), lambda y: y["id"] == x["id"])))
