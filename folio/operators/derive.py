"""Documents from records: one narrow stage of Column rules over ``read_marcxml`` rows.

Each function gives one property, or a group of them, as Columns. ``documents`` puts them together; lookup
tables come in by joins on the record id or as small fixed maps. Where an input rule is known to have been
a slip, the docstring says what is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import columns as C
from folio.functions import marc as M

BASE = "https://example.org/"
#: The code of the network as a member of its own.
NETWORK = "NETWORK"


def rejected() -> Column:
    """Records flagged as deleted."""
    return C.any_equal(M.values("DEL??", "a"), "Y")


def in_network() -> Column:
    """Held by the network, and not merely as an unowned electronic package."""
    portfolio = F.exists(M.fields("POR??"), lambda f: M.has(f, "A"))
    package = C.any_match(M.values("035??", "a"), r"\(EXLCZ\).*")
    return C.any_equal(M.values("MBD??", "M"), NETWORK) & (portfolio | ~package)


# --- identifiers -------------------------------------------------------------------------------------


def urn() -> Column:
    """From 024 and resolver links; one spelling each."""
    of_024 = M.fields("0247?", where=lambda f: M.sub1(f, "2") == "urn")
    plain = F.transform(of_024, lambda f: F.when(M.sub1(f, "a").contains("http"), C.present(F.regexp_extract(M.sub1(f, "a"), r"^.*(urn:nbn:de.*)$", 1))).otherwise(M.sub1(f, "a")))
    link = r"^http.*(?:urn=|\.(?:org|de)/)(urn:.+)$"
    links = F.transform(M.values("856??", "u"), lambda u: C.present(F.regexp_extract(u, link, 1)))
    every = F.transform(F.concat(plain, links), lambda u: F.regexp_replace(u, r"^(nbn:de:.*\d)$", "urn:$1"))
    return C.compacted(C.uniq(every))


def doi() -> Column:
    """From 024, from DOIs in URN fields, and from resolver links."""
    pattern = r"(10\.\d{4,9}/\S+)"
    of_024 = M.fields("0247?", where=lambda f: M.sub1(f, "2").isin("doi", "urn") & M.sub1(f, "a").rlike(pattern) & ((M.sub1(f, "2") == "doi") | M.sub1(f, "a").contains("doi")))
    plain = F.transform(of_024, lambda f: F.regexp_extract(M.sub1(f, "a"), pattern, 1))
    links = F.transform(F.filter(M.values("856??", "u"), lambda u: u.rlike(r"doi\.org.*10\.\d{4,9}/\S+")), lambda u: F.regexp_extract(u, pattern, 1))
    return C.compacted(C.uniq(F.concat(plain, links)))


def isbn() -> Column:
    """Both forms of every number that can be cleaned."""
    clean = F.transform(M.values("020  ", "a"), C.isbn_clean)
    both = F.flatten(F.transform(clean, lambda n: F.array(n, F.when(F.length(n) == 13, C.isbn10(n)).otherwise(C.isbn13(n)))))
    return C.compacted(C.uniq(both))


def issn() -> Column:
    return C.compacted(C.uniq(C.replace_each(M.values("022? ", "a"), ("-", ""))))


def ismn() -> Column:
    return C.compacted(C.replace_each(M.values("0242?", "a"), ("-", "")))


#: Agency, its prefix in 035, the form of its ids, the short name in the fallback list.
AGENCIES = (
    ("dnbId", "DE-101", r"\d{8,9}[X\d]?", None),
    ("bszId", "DE-576", r".*", "BSZ"),
    ("gbvId", "DE-601", r".*", "GBV"),
    ("kobvId", "DE-602", r".*", None),
    ("k10PlusId", "DE-627", r"\d{8,9}[0-9X]", "KXP"),
    ("bvbId", "DE-604", r"BV\d{9}", "BVB"),
    ("hebisId", "DE-603", r"\d{9,10}", "HEB"),
    ("obvId", "AT-OBV", r"AC\d{8}", "OBV"),
)


def _numbers(prefix: str, form: str) -> Column:
    pattern = rf"^\({prefix}\)({form})$"
    return F.transform(F.filter(M.values("035  ", "a"), lambda a: a.rlike(pattern)), lambda a: F.regexp_extract(a, pattern, 1))


def agency_ids() -> dict[str, Column]:
    """The first number of each agency, its own entry before 016 before the general fallback.

    The fallback's numbers of two agencies lose their prefixes too, as was meant.
    """
    out = {}
    for name, prefix, form, short in AGENCIES:
        tries = [C.first(_numbers(prefix, form))]
        if name == "dnbId":
            at_016 = M.fields("0167 ", where=lambda f: (M.sub1(f, "2") == "DE-101") & M.sub1(f, "a").rlike(C.full(r"\d{8,9}[X\d]?")))
            tries.append(C.first(F.transform(at_016, lambda f: M.sub1(f, "a"))))
        if short:
            tries.append(C.first(_numbers("DE-599", f"{short}.*")))
        found = F.coalesce(*tries)
        out[name] = C.present(F.regexp_replace(found, f"^{short}", "") if short else found)
    return out


def zdb_id() -> Column:
    """With one hyphen before the check digit; anything else is dropped."""
    at_016 = M.fields("0167 ", where=lambda f: M.sub1(f, "2") == "DE-600")
    raw = F.coalesce(C.first(_numbers("DE-600", ".+")), C.first(F.transform(at_016, lambda f: M.sub1(f, "a"))))
    tidy = F.regexp_replace(F.regexp_replace(raw, r"^\(DE-599\)ZDB", ""), r"(\d{1,7})-* ?-*([Xx\d])", "$1-$2")
    return F.when(tidy.rlike(C.full(r"\d{1,7}-[Xx\d]")), tidy)


def local_id() -> Column:
    """The first union-catalogue number; records with several are for the report of repeated ids."""
    return F.when(in_network(), C.first(_numbers("DE-605", r"\D\D.*")))


def oclc() -> Column:
    return C.compacted(_numbers("OCoLC", ".+"))


# --- titles ------------------------------------------------------------------------------------------

_BRACKETS = ("<<|>>", "")


def title() -> Column:
    """Main title, part number after a comma, part title after a colon."""
    main = M.value("245??", "a")
    main = F.when(main.endswith("..."), main).otherwise(F.regexp_replace(main, r"^[©]|\s?[,.:;/=]?$", ""))
    skip = lambda codes: F.filter(M.values("245??", codes), lambda v: v != "[...]")
    number = C.joined(skip("n"), ". ")
    part = C.joined(C.replace_each(skip("p"), (r"\s?\.?\s?$", ""), _BRACKETS), ". ")
    part = F.when(number.isNotNull(), C.prefixed(part, ": ")).otherwise(part)
    return C.paste(F.regexp_replace(main, *_BRACKETS), C.prefixed(C.paste(number, part, sep=""), ", "), sep="")


def _trimmed(values: Column) -> Column:
    return C.compacted(C.uniq(C.replace_each(values, (r"\s?[,.:;/=]?\s?$", ""), _BRACKETS)))


def other_titles() -> dict[str, Column]:
    return {
        "alternativeTitle": _trimmed(M.values("246?[ 345678]", "a")),
        "otherTitleInformation": _trimmed(F.concat(M.values("245??", "b"), M.values("247??", "b"))),
        "edition": _trimmed(M.values("250??", "a")),
        "shortTitle": _trimmed(M.values("210??", "a")),
        "responsibilityStatement": C.compacted(M.values("245??", "c")),
    }


def linked_titles(scripts: dict[str, str]) -> Column:
    """Titles in other scripts: fields 880 that name the occurrence of a title field in ``$6``.

    ``$6`` of a field is ``880-NN``, of its twin ``TTT-NN/script``. Scripts without a name are "Zzzz".
    """
    occurrence = lambda f: F.regexp_extract(M.sub1(f, "6"), r"^\d{3}-(\d{2})", 1)
    own = M.fields("245??", where=lambda f: M.has(f, "6"))

    def twins(f: Column) -> Column:
        return F.filter("data", lambda g: (g["tag"] == "880") & M.sub1(g, "6").startswith("245-") & (occurrence(g) == occurrence(f)))

    def twin(g: Column) -> Column:
        code = C.present(F.regexp_extract(M.sub1(g, "6"), r"/(.+?)(?:/r)?$", 1))
        known = F.coalesce(code, F.lit("Zzzz"))
        text = C.paste(F.regexp_replace(M.sub1(g, "a"), r"\s?[,.:;/=]?$", ""), C.joined(M.sub(g, "n"), ". "), C.joined(M.sub(g, "p"), ". "), sep=", ")
        return F.struct(F.struct(known.alias("id"), C.mapped(known, scripts, keep=True).alias("label")).alias("script"), text.alias("title"))

    return F.flatten(F.transform(own, lambda f: F.transform(twins(f), twin)))


# --- dates and publication ---------------------------------------------------------------------------


def is_continuing() -> Column:
    return C.fixed(F.col("leader"), 7).isin("s", "i", "b")


def _clean_date(d: Column) -> Column:
    """Brackets and "circa" go, the latter as a word only."""
    return F.regexp_replace(d, r"\[|\]|\b(?:ca\.|c|um)\s?(?=\d)", "")


def _event(f: Column, this_year: int) -> Column:
    dates = F.concat(M.sub(f, "c"), M.sub(f, "3"))
    clean = F.transform(dates, _clean_date)
    start = C.first(F.filter(F.transform(clean, lambda d: C.present(F.regexp_extract(d, r"^[^-]*?([01]\d{3}|20\d{2})", 1))), lambda y: y.isNotNull()))
    end = C.first(F.filter(F.transform(clean, lambda d: C.present(F.regexp_extract(d, r"-.*([01]\d{3}|20\d{2}).*$", 1))), lambda y: y.isNotNull()))
    start = C.year_or_guess(start, C.fixed(M.control("008"), 7, 4), this_year)
    return F.struct(
        F.array(F.lit("PublicationEvent")).alias("type"), C.compacted(_ends(M.sub(f, "a"))).alias("location"), C.compacted(_ends(M.sub(f, "b"))).alias("publishedBy"),
        C.first(dates).alias("dateStatement"), start.alias("startDate"), F.when(is_continuing() & (end != "0000"), end).alias("endDate"),
    )


def _ends(values: Column) -> Column:
    return C.replace_each(values, (r"\s?[,:;]\s?$", ""))


def publication(this_year: int) -> Column:
    """264 before 260; current, then intervening, then unmarked statements. Fixed-field dates stand in if there is none."""

    def group(tag: str, second: str) -> Column:
        return F.concat(M.fields(f"{tag}3{second}"), M.fields(f"{tag}2{second}"), M.fields(f"{tag} {second}"))

    found = C.let(group("264", "1"), lambda g: F.when(F.size(g) > 0, g).otherwise(group("260", "?")))
    events = F.transform(found, lambda f: _event(f, this_year))
    year, end = C.fixed(M.control("008"), 7, 4), C.fixed(M.control("008"), 11, 4)
    strings, none = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    bare = F.struct(
        F.array(F.lit("PublicationEvent")).alias("type"), strings.alias("location"), strings.alias("publishedBy"), none.alias("dateStatement"),
        year.alias("startDate"), F.when(is_continuing() & end.rlike(r"^\d{4}$") & (end != "9999"), end).alias("endDate"),
    )
    return C.let(events, lambda e: F.when(F.size(e) > 0, e).when(year.rlike(r"^\d{4}$"), F.array(bare)))


def manufacture(this_year: int) -> Column:
    """Current, intervening and unmarked statements of manufacture; null without one."""
    found = F.concat(M.fields("26433"), M.fields("26423"), M.fields("264 3"))
    events = F.transform(found, lambda f: _event(f, this_year))
    made = lambda e: F.struct(F.array(F.lit("Event")).alias("type"), e["location"].alias("location"), e["publishedBy"].alias("manufacturedBy"), e["dateStatement"].alias("dateStatement"), e["startDate"].alias("startDate"), e["endDate"].alias("endDate"))
    return _some(F.transform(events, made))


def secondary_publications(this_year: int) -> Column:
    """Reproductions of 533. A field with several publishers is several events: its places and publishers go in pairs."""

    def events(f: Column) -> Column:
        dates = F.transform(M.sub(f, "d"), _clean_date)
        year = lambda pattern: C.first(F.filter(F.transform(dates, lambda d: C.present(F.regexp_extract(d, pattern, 1))), lambda y: y.isNotNull()))
        start = C.year_or_guess(year(r"^[^-]*?([01]\d{3}|20\d{2})"), C.fixed(M.control("008"), 7, 4), this_year)
        end = F.when(is_continuing(), year(r"-.*([01]\d{3}|20\d{2}).*$"))

        def event(places: Column, publishers: Column) -> Column:
            return F.struct(
                F.array(F.lit("SecondaryPublicationEvent")).alias("type"), C.compacted(places).alias("location"), C.compacted(M.sub(f, "a")).alias("description"),
                C.compacted(publishers).alias("publishedBy"), start.alias("startDate"), end.alias("endDate"),
            )

        pairs = F.arrays_zip(M.sub(f, "b").alias("b"), M.sub(f, "c").alias("c"))
        several = F.transform(pairs, lambda p: event(F.array(p["b"]), F.array(p["c"])))
        return F.when(F.size(M.sub(f, "c")) > 1, several).otherwise(F.array(event(M.sub(f, "b"), M.sub(f, "c"))))

    return _some(F.flatten(F.transform(M.fields("533  "), events)))


def described_by() -> Column:
    """Dates of the description, with impossible days repaired."""
    created = F.coalesce(C.date_from_six(C.fixed(M.control("008"), 0, 6)), F.substring(M.value("MNG??", "b"), 1, 10))
    return F.struct(created.alias("dateCreated"), F.substring(M.value("MNG??", "d"), 1, 10).alias("dateModified"))


# --- kinds -------------------------------------------------------------------------------------------

#: Leader position 7.
LEVELS = {"a": "Monographic component part", "b": "Serial component part", "c": "Collection", "d": "Subunit", "i": "Integrating resource", "m": "Monograph/Item", "s": "Serial"}


def bibliographic_level() -> Column:
    label = C.mapped(C.fixed(F.col("leader"), 7), LEVELS)
    page = "https://www.loc.gov/marc/bibliographic/bdleader.html#"
    return F.when(label.isNotNull(), F.struct(F.concat(F.lit(page), F.regexp_replace(label, "[ /]", "_")).alias("id"), label.alias("label")))


def kinds() -> Column:
    """Independent chains over the leader, the fixed fields and form terms; first match wins in each."""
    six, level = C.fixed(F.col("leader"), 6), C.fixed(F.col("leader"), 7)
    f8 = M.control("008")
    forms = M.values("655??", "a")
    serial = level.isin("s", "b")
    at = lambda n: C.fixed(f8, n)
    chains = F.array(
        C.first_of([(serial & (at(21) == "n"), "Newspaper"), (serial & (at(21) == "p"), "Journal"), (serial & (at(21) == "m"), "Series"), (serial, "Periodical")]),
        C.first_of([(level.isin("a") | C.any_match(forms, "Aufsatz|Article"), "Article"), (level == "c", "Collection"), (six.isin("a", "t") & (level == "m") & (C.present(M.value("245??", "n")).isNotNull() | (C.fixed(F.col("leader"), 19) == "a")), "MultiVolumeBook"), (six.isin("a", "t") & (level == "m"), "Book")]),
        C.first_of([(six.isin("c", "d"), "PublishedScore"), (six.isin("e", "f"), "Map"), (six == "k", "Image"), (six == "r", "Game"), (six.isin("i", "j", "g"), "Miscellaneous")]),
        F.when(F.exists(M.fields("502??"), lambda f: F.size(f["sub"]) > 0) | C.any_match(forms, "Hochschulschrift"), F.lit("Thesis")),
        F.when(C.any_match(forms, "Bibliogra(f|ph)ie"), F.lit("Bibliography")),
        F.when(C.any_match(forms, "Festschrift"), F.lit("Festschrift")),
        F.when(C.any_match(forms, "Konferenzschrift.*"), F.lit("Proceedings")),
        F.when(C.any_match(forms, "Biogra(f|ph)ie"), F.lit("Biography")),
    )
    found = F.array_compact(chains)
    return F.concat(F.array(F.lit("BibliographicResource")), F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Miscellaneous"))))


def medium() -> Column:
    """Ordered rules on carriers and physical description; print where nothing speaks against it."""
    seven, carriers = F.substring(M.control("007"), 1, 2), M.values("338??", "b")
    online = C.any_equal(carriers, "cr") | seven.startswith("cr") | F.exists(M.fields("POR??"), lambda f: F.size(f["sub"]) > 0)
    found = F.array_compact(F.array(
        F.when(online, F.lit("Online")),
        C.first_of([(C.any_match(carriers, "s.") | seven.startswith("s"), "Audio"), (C.any_match(carriers, "v.") | seven.startswith("v"), "Video")]),
        C.first_of([(C.any_match(carriers, "h.") | seven.startswith("h"), "Microform"), (C.any_match(carriers, "c[^r]"), "Data carrier")]),
    ))
    return F.when(F.size(found) > 0, C.uniq(found)).otherwise(F.array(F.when(C.fixed(F.col("leader"), 6).isin("a", "c", "t", "e"), F.lit("Print")).otherwise(F.lit("Other"))))


def language_codes() -> Column:
    """Codes of 008 and 041, without those that name no language."""
    codes = F.concat(F.array(C.fixed(M.control("008"), 35, 3)), F.flatten(F.transform(M.fields("041[ 01] "), lambda f: M.sub(f, "adj"))))
    return C.uniq(F.filter(codes, lambda c: c.isNotNull() & ~c.rlike(C.full(r"zxx|mul|sgn|und|.*[|#].*|\s*"))))


def extent() -> Column:
    """The physical description, its parts joined by their punctuation."""
    f = C.first(M.fields("300??"))
    part = lambda code: C.present(F.regexp_replace(M.sub1(f, code), r"\s?[:;+]\s?$", ""))
    return C.paste(C.paste(C.paste(C.joined(C.replace_each(M.sub(f, "a"), (r"\s?[:;+]\s?$", "")), ", "), part("b"), sep=" : "), part("c"), sep=" ; "), part("e"), sep=" + ")


def notes() -> dict[str, Column]:
    return {
        "note": C.compacted(C.uniq(M.values("500??", "a"))),
        "abstract": C.compacted(M.values("520??", "a")),
        "thesisInformation": C.compacted(F.transform(M.fields("502??"), lambda f: C.joined(M.sub(f, "abcd"), ", "))),
        "license": C.compacted(C.uniq(M.values("540??", "u"))),
    }


# --- agents and subjects -----------------------------------------------------------------------------

#: Words of a role statement, in the order of the test, and relator codes.
ROLE_WORDS = (
    ("dars", "act"), ("nach", "aft"), ("vorl", "ant"), ("artist|künstler", "art"), ("vorw", "aui"), ("drehb", "aus"), ("author|verfasser", "aut"), ("b(ü|ue)hnenbild", "std"),
    ("choreogr", "chr"), ("mitarb|beitr|komm\\.", "ctb"), ("komp", "cmp"), ("dir|chorleit", "cnd"), ("sammler", "col"), ("kartogra", "ctg"), ("tänzer", "dnc"),
    ("herausgebendes organ", "isb"), ("hrsg|editor|herausg|^ed\\.$", "edt"), ("stecher", "egr"), ("widmungsempfänger", "hnr"), ("ill|zeichn", "ill"), ("interviewter", "ive"), ("interviewer", "ivr"),
    ("instr|cembalo|fagott|flöte|gitarre|guitar|harfe|harp|horn|klarinette|clarinet|klavier|piano|kontrabass|laute|oboe|org|posaune|saxophon|schlagzeug|drums|tromp|violoncello|violine", "itr"),
    ("libr", "lbt"), ("ltg", "ltg"), ("moderation|moderat", "mod"), ("musi", "mus"), ("begr", "org"), ("otogr", "pht"), ("interpr", "prf"), ("prod", "pro"), ("adressat", "rcp"),
    ("gesang|alt|bariton|bass|baß|counterten|mezzosopr|sopr|ten|singer", "sng"), ("sprecher", "spk"), ("bers|transla", "trl"),
)
_EDITED = ("Periodical", "Collection", "Series", "Newspaper", "Journal", "Proceedings", "Festschrift")
_WRITTEN = ("Book", "MultiVolumeBook", "Article", "Thesis", "Biography")


def role_from_words(statement: Column) -> Column:
    low = F.lower(statement)
    return C.first_of([(low.rlike(words), code) for words, code in ROLE_WORDS])


def default_role(kinds_: Column) -> Column:
    any_of = lambda names: F.arrays_overlap(kinds_, F.array(*map(F.lit, names)))
    return C.first_of([(any_of(("PublishedScore", "Game", "Image", "Map", "Bibliography")), "cre"), (any_of(_EDITED), "edt"), (any_of(_WRITTEN), "aut")], "cre")


def contributions(kinds_: Column) -> Column:
    """One for each field and role. Fields with a repeated name are left out; roles are three letters."""
    persons = M.fields("100[01] ", "700[01] ", where=lambda f: F.size(M.sub(f, "a")) == 1)
    bodies = M.fields("1[1]0? ", "7[1]0? ", "1[1]1? ", "7[1]1? ", where=lambda f: F.size(M.sub(f, "a")) == 1)

    def of(person: bool):
        def agents(f: Column) -> Column:
            words = F.filter(F.transform(M.sub(f, "e"), role_from_words), lambda r: r.isNotNull())
            given = C.uniq(F.concat(F.filter(M.sub(f, "4"), lambda r: r.rlike(C.full("[A-Za-z]{3}"))), words))
            roles = F.when(F.size(given) > 0, given).otherwise(F.array(default_role(kinds_)))
            number = C.first(F.transform(F.filter(M.sub(f, "0"), lambda i: i.rlike(r"^\(DE-588\).+$")), lambda i: F.regexp_replace(i, r"^\(DE-588\)", "")))
            born, died = C.life_dates(M.sub1(f, "d")) if person else (F.lit(None).cast("string"),) * 2
            label = C.paste(F.regexp_replace(M.sub1(f, "a"), r"\s?[,:;]?$", ""), M.sub1(f, "b"), M.sub1(f, "c"), sep=", ") if person else C.joined(M.sub(f, "abnpg"), ". ")
            agent = F.struct(
                F.concat(F.lit("https://d-nb.info/gnd/"), number).alias("id"), F.array(F.lit("Person" if person else "CorporateBody")).alias("type"), label.alias("label"),
                born.alias("dateOfBirth"), died.alias("dateOfDeath"), number.alias("gndIdentifier"), alt_labels(M.sub(f, "B")).alias("altLabel"),
            )
            return F.transform(roles, lambda r: F.struct(F.array(F.lit("Contribution")).alias("type"), agent.alias("agent"), r.alias("role")))

        return agents

    return F.concat(F.flatten(F.transform(persons, of(True))), F.flatten(F.transform(bodies, of(False))))


def alt_labels(idns: Column) -> Column:
    """Other names of an authority: enrichment fields of the record with its number in ``$B``."""
    fields = F.filter("data", lambda e: e["tag"].isin("GPN", "GKS", "GEL", "GKT", "GST", "GGN"))
    own = F.filter(fields, lambda e: F.arrays_overlap(M.sub(e, "B"), idns))
    return C.compacted(C.uniq(F.transform(own, lambda e: C.joined(M.sub(e, "abcx"), ", "))))


#: Subject fields by second indicator or source code, and the name of their vocabulary.
VOCABULARIES = ((("?0", None), "Library of Congress Subject Headings"), (("?7", "gnd"), "Gemeinsame Normdatei"), (("?7", "fast"), "Faceted Application of Subject Terminology"), (("?2", None), "Medical Subject Headings"))


def subjects() -> Column:
    """Headings of 600 to 651 by vocabulary, uncontrolled words, and notations of 082 and 084."""
    tags = ("600", "610", "611", "630", "648", "650", "651")

    def headings(heads: Column) -> Column:
        # once for each vocabulary: the fields of one vocabulary in the order of their tags
        def of(ind: str, code: str | None, name: str) -> Column:
            own = M.fields("6??" + ind, where=None if code is None else _of_source(code), of=heads)
            return C.let(own, lambda o: F.flatten(F.transform(F.array(*map(F.lit, tags)), lambda t: F.transform(F.filter(o, lambda f: f["tag"] == t), _heading(name)))))

        return F.concat(*(of(ind, code, name) for (ind, code), name in VOCABULARIES))

    parts = [C.let(F.filter("data", lambda f: f["tag"].isin(*tags)), headings)]
    words = F.transform(M.values("653??", "a"), lambda w: _concept(F.regexp_replace(w, r"\s?[.,]$", ""), None, None, None))
    ddc = F.transform(M.values("082??", "a"), lambda n: _concept(None, F.regexp_replace(n, "/", ""), None, "Dewey Decimal Classification"))
    rvk = F.transform(F.flatten(F.transform(M.fields("084??", where=_of_source("rvk")), lambda f: M.sub(f, "a"))), lambda n: _concept(None, n, None, "Regensburger Verbundklassifikation"))
    return F.concat(words, *parts, ddc, rvk)


def _of_source(code: str):
    return lambda f: M.sub1(f, "2") == code


def _concept(label, notation, iri, source) -> Column:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    return F.struct(text(iri).alias("id"), text(label).alias("label"), text(notation).alias("notation"), text(source).alias("source"))


def _heading(source: str):
    def build(f: Column) -> Column:
        number = C.first(F.transform(F.filter(M.sub(f, "0"), lambda i: i.rlike(r"^\(DE-588\).+$")), lambda i: F.regexp_replace(i, r"^\(DE-588\)", "")))
        label = C.joined(F.concat(F.array(C.joined(M.sub(f, "abcd"), " ")), M.sub(f, "xyzv")), " / ")
        return _concept(label, None, F.concat(F.lit("https://d-nb.info/gnd/"), number), source)

    return build


def subject_chains() -> Column:
    """Chains of 689: the first indicator numbers the chain, components keep their order."""

    def chains(links: Column) -> Column:
        numbers = F.filter(F.array(*(F.lit(str(n)) for n in range(10))), lambda n: F.exists(links, lambda f: f["ind1"] == n))
        return F.transform(numbers, lambda n: C.let(F.transform(F.filter(links, lambda f: f["ind1"] == n), lambda f: C.joined(M.sub(f, "abcx"), ", ")), _chain))

    return C.let(F.filter("data", lambda f: (f["tag"] == "689") & M.has(f, "a")), chains)


def _chain(labels: Column) -> Column:
    return F.struct(labels.alias("componentList"), C.joined(labels, " | ").alias("label"))


def subject_labels(subjects_: Column, chains: Column) -> Column:
    """The labels of all concepts without a notation, then those of the chains' components, once each."""
    own = F.transform(F.filter(subjects_, lambda c: c["notation"].isNull()), lambda c: c["label"])
    return C.compacted(C.uniq(F.concat(own, F.flatten(F.transform(chains, lambda c: c["componentList"])))))


# --- items -------------------------------------------------------------------------------------------


def _item(kind: str, number: Column, library: Column, place: Column, call: Column, mark: Column, link: Column) -> Column:
    return F.struct(
        F.concat(F.lit("items/"), number).alias("id"), F.array(F.lit("Item"), F.lit(kind)).alias("type"), library.alias("currentLibrary"), place.alias("currentLocation"),
        call.alias("callNumber"), mark.alias("inventoryNumber"), link.alias("electronicLocator"),
    )


def items(suppressed: Column | None = None, bridge: str = ".*7830") -> Column:
    """Items from item fields, holdings without items, portfolios, and members with neither.

    ``suppressed``: array of ``member/library/location`` or ``member/library`` keys that stay hidden.
    The call number is the temporary one of a moved item, else the item's, else the holding's.
    """
    none = F.lit(None).cast("string")
    hidden = F.coalesce(suppressed, F.array().cast("array<string>")) if suppressed is not None else F.array().cast("array<string>")
    key = lambda *parts: F.concat_ws("/", *parts)
    shown = lambda m, lib, loc: ~(F.array_contains(hidden, key(m, lib, loc)) | F.array_contains(hidden, key(m, lib)))

    own = M.fields("ITM  ", where=lambda f: ~F.coalesce(M.sub1(f, "a").rlike(C.full(bridge)), F.lit(False)) & shown(M.sub1(f, "M"), M.sub1(f, "w"), M.sub1(f, "x")))
    moved = lambda f: F.coalesce(M.sub1(f, "x") != M.sub1(f, "v"), F.lit(True))
    physical = F.transform(own, lambda f: _item("PhysicalObject", M.sub1(f, "a"), M.sub1(f, "w"), M.sub1(f, "x"), F.coalesce(F.when(moved(f), M.sub1(f, "z")), M.sub1(f, "n"), M.sub1(f, "c")), M.sub1(f, "B"), none))

    with_items = F.flatten(F.transform(own, lambda f: M.sub(f, "H")))
    holdings = M.fields("HOL  ", where=lambda f: ~F.coalesce(M.sub1(f, "8").rlike(C.full(bridge)), F.lit(False)) & ~F.arrays_overlap(M.sub(f, "8"), with_items))

    def places(f: Column) -> Column:
        at = F.filter("data", lambda h: (h["tag"] == "H52") & F.arrays_overlap(M.sub(h, "8"), M.sub(f, "8")) & M.has(h, "b") & shown(M.sub1(f, "M"), M.sub1(h, "b"), M.sub1(h, "c")))
        return F.transform(at, lambda h: _item("PhysicalTitle", M.sub1(f, "8"), M.sub1(h, "b"), M.sub1(h, "c"), M.sub1(h, "h"), none, none))

    portfolios = F.flatten(F.transform(M.fields("POR  ", where=lambda f: ~F.coalesce(M.sub1(f, "a").rlike(C.full(".*6441")), F.lit(False))), lambda f: F.transform(
        F.when(F.size(M.sub(f, "A")) > 0, M.sub(f, "A")).otherwise(M.sub(f, "M")), lambda m: _item("DigitalDocument", M.sub1(f, "a"), m, none, none, none, M.sub1(f, "u")))))
    covered = F.concat(F.flatten(F.transform(M.fields("HOL  "), lambda f: M.sub(f, "M"))), F.flatten(F.transform(M.fields("POR  "), lambda f: F.concat(M.sub(f, "M"), M.sub(f, "A")))))
    members = F.filter(F.array_except(M.values("MBD??", "M"), covered), lambda m: m != NETWORK)
    titles = F.transform(members, lambda m: _item("TitleOnly", m, m, none, none, none, none))
    return F.concat(physical, F.flatten(F.transform(holdings, places)), portfolios, titles)


def holder_count(items_: Column, elsewhere: tuple[str, ...] = ()) -> Column:
    """Distinct holders of physical items, branches counting as their parents."""
    libraries = F.transform(F.filter(items_, lambda i: C.any_equal(i["type"], "PhysicalObject")), lambda i: F.regexp_replace(i["currentLibrary"], r"^([A-Z]+-[^-]+)-.*$", "$1"))
    kept = F.filter(C.uniq(libraries), lambda l: l.isNotNull() & ~l.isin(*elsewhere)) if elsewhere else F.filter(C.uniq(libraries), lambda l: l.isNotNull())
    return F.size(kept)


def last_copy(network: Column, holders: Column, year: Column, kinds_: Column, level: Column, this_year: int) -> Column:
    """One to three holders, printed after 1851 and at least nine years ago, of the kinds that are archived."""
    archived = F.arrays_overlap(kinds_, F.array(*map(F.lit, ("Book", "Map", "PublishedScore"))))
    return network & holders.between(1, 3) & C.greater_than(year, 1851) & C.less_than(year, this_year - 9) & archived & level.isin("Serial component part", "Monograph/Item")


def relation(path: str) -> Column:
    """Linked records of a linking field: label, note, and an IRI by the first usable number."""

    def one(f: Column) -> Column:
        number = lambda prefix: C.first(F.transform(F.filter(M.sub(f, "w"), lambda w: w.startswith(f"({prefix})")), lambda w: F.regexp_replace(w, r"^\([^)]*\)", "")))
        iri = F.coalesce(F.concat(F.lit(BASE + "resources/"), number("DE-605")), F.concat(F.lit("http://ld.zdb-services.de/resource/"), number("DE-600")))
        label = C.paste(F.regexp_replace(M.sub1(f, "a"), r"\s?[,.:;]$", ""), M.sub1(f, "t"), sep=". ")
        return F.struct(iri.alias("id"), label.alias("label"), C.compacted(M.sub(f, "i")).alias("note"))

    return _some(F.transform(M.fields(path), one))


def _some(x: Column) -> Column:
    return C.let(x, lambda v: F.when(F.size(v) > 0, v))


#: Properties of linking fields.
RELATIONS = {"isPartOf": "773??", "supplement": "770??", "primaryForm": "776??", "predecessor": "780??", "successor": "785??", "related": "775??"}


def documents(records: DataFrame, this_year: int, scripts: dict[str, str] | None = None, base: str = BASE, hidden: Column | None = None, collections: Sequence = ()) -> DataFrame:
    """The target documents of all records that aren't rejected, in stages so that no expression grows unbounded.

    ``hidden``: places whose items stay hidden, see ``items``; ``collections``: ``rules.Membership`` rows. What needs a
    table of its own (labels, places, external items, titles in other scripts beyond the record's own) is joined
    by the operators of ``links``, ``lookups`` and ``parts``.
    """
    from . import links, parts, rules

    d = records.where(~rejected())
    d = d.withColumns({"inNetwork": in_network(), "level": bibliographic_level()})
    d = d.withColumns({
        "id": F.concat(F.lit(base + "resources/"), "record_id", F.lit("#!")), "localId": local_id(), "zdbId": zdb_id(), "urn": urn(), "doi": doi(), "isbn": isbn(), "issn": issn(), "ismn": ismn(), "oclcNumber": oclc(), **agency_ids(),
    })
    d = d.withColumns({"title": title(), **other_titles(), "alternateGraphicRepresentation": _some(linked_titles(scripts or {"Arab": "Arabic", "Cyrl": "Cyrillic", "Hebr": "Hebrew"})), "publication": publication(this_year), "manufacture": manufacture(this_year), "secondaryPublication": secondary_publications(this_year), "describedBy": described_by()})
    d = d.withColumns({"natureOfContent": _some(links.forms()), **parts.containment(base), **{n: relation(p) for n, p in RELATIONS.items() if n != "isPartOf"}})
    in_serial = F.exists("isPartOf", lambda p: F.exists(p["hasSuperordinate"], lambda h: h["id"].contains("ZDB-")))
    numbered = M.values("245??", "n")
    issue = F.when(F.size(numbered) > 0, ~F.exists(numbered, lambda n: n.contains("..."))).otherwise(F.size(M.values("77308", "q")) > 0)
    titles = F.concat(F.array("title"), F.coalesce("otherTitleInformation", F.array().cast("array<string>")))
    contents = F.transform(F.coalesce("natureOfContent", F.array().cast(d.schema["natureOfContent"].dataType)), lambda f: f["label"])
    d = d.withColumn("_kinds", rules.media_and_kinds(F.col("zdbId"), F.when(in_serial & issue, "issue"), titles, contents))
    d = d.withColumns({"type": F.col("_kinds.type"), "medium": F.col("_kinds.medium")}).drop("_kinds")
    d = d.withColumns({"language": language_codes(), "extent": extent(), **notes(), **{n: _some(x) for n, x in links.described_links().items()}, "fulltextOnline": _some(links.fulltext()), **links.works()})
    d = d.withColumns({"inCollection": _some(rules.memberships(collections, F.col("inNetwork")))} if collections else {})
    d = d.withColumns({"subject": subjects(), "subjectChain": subject_chains(), "contribution": contributions(F.col("type"))})
    d = d.withColumn("hasItem", items(hidden))
    d = d.withColumn("holders", holder_count(F.col("hasItem"))).withColumn("hasItem", parts.with_custody(F.col("hasItem")))
    d = d.withColumn("subjectLabels", subject_labels(F.col("subject"), F.col("subjectChain")))
    year = C.first(F.col("publication"))["startDate"]
    d = d.withColumn("lastCopy", last_copy(F.col("inNetwork"), F.col("holders"), year, F.col("type"), F.col("level.label"), this_year))
    return d.drop("leader", "control", "data")
