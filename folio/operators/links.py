"""Further derivations: links of a record, collections, forms, works, and joins with tables keyed by record."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import columns as C
from folio.functions import marc as M

from . import lookups

_GND = r"^\(DE-588\)(.+)$"


def _labelled(iri: Column, label: Column | str) -> Column:
    return F.struct(iri.alias("id"), (F.lit(label) if isinstance(label, str) else label).alias("label"))


def same_as(templates: dict[str, tuple[Column, str]]) -> Column:
    """``{prefix: (numbers, label)}``: an entry for every number that is there. Numbers are arrays."""
    def entries(prefix: str, numbers: Column, label: str) -> Column:
        return F.transform(F.filter(numbers, lambda n: n.isNotNull()), lambda n: _labelled(C.prefixed(n, prefix), label))

    return C.uniq(F.concat(*(F.coalesce(entries(p, n, s), F.array()) for p, (n, s) in templates.items())))


def _links(test) -> Column:
    return M.fields("856??", where=lambda f: M.has(f, "u") & F.coalesce(test(f), F.lit(False)))


def described_links() -> dict[str, Column]:
    """Contents, descriptions and further details, by the first letters of the link's note."""
    kinds = {"tableOfContents": "(?i)^inhaltsv.*", "description": "(?i)^inhaltst.*", "seeAlso": "(?i)^zus.*"}
    return {name: F.transform(_noted(pattern), lambda f: _labelled(M.sub1(f, "u"), M.sub1(f, "3"))) for name, pattern in kinds.items()}


def _noted(pattern: str) -> Column:
    return _links(lambda f: M.sub1(f, "3").rlike(pattern))


def fulltext() -> Column:
    """Full texts: free of charge, open access, or by the wording of their notes, in this order. Resolver links are listed elsewhere."""
    free = ".*(Verlag|Agentur|Digitalisierung|Archivierte Online|EZB|Online-Ausg|Resolving-System|Volltext).*"
    other = ".*(Archivierte Online|EZB|Online-Ausg|Resolving-System|Volltext).*"

    def label(f: Column) -> Column:
        x = M.sub(f, "x")
        # of two notes the second is the more telling one
        note = F.coalesce(C.nth(x, 1), C.first(x))
        costless = C.any_equal(M.sub(f, "z"), "kostenfrei")
        return C.first_of([
            (costless & C.any_match(x, free), note), (costless & (F.size(x) == 0), "Online-Ressource"), (costless, F.lit(None).cast("string")),
            (C.any_equal(M.sub(f, "7"), "0"), "Online-Ressource"), (C.any_match(x, other), note), (F.coalesce(M.sub1(f, "3").rlike("(?i)^vol.*"), F.lit(False)), M.sub1(f, "3")),
        ])

    links = _links(lambda f: ~M.sub1(f, "u").rlike(r"doi\.org|urn=urn:|\.(org|de)/urn:"))
    return F.filter(F.transform(links, lambda f: _labelled(M.sub1(f, "u"), label(f))), lambda l: l["label"].isNotNull())


@dataclass(frozen=True)
class Collection:
    """A collection and the condition on a record, as a Column over the record or derived columns."""

    iri: str
    label: str
    holds: Column


def source_code(code: str, tag: str = "084??", start: str = "") -> Column:
    """Some field of a tag is of a source, with a notation that begins so."""
    return F.exists(M.fields(tag, where=lambda f: M.sub1(f, "2") == code), lambda f: F.coalesce(M.sub1(f, "a").startswith(start), F.lit(start == "")))


def link_contains(*parts: str) -> Column:
    return F.exists(M.values("856??", "u"), lambda u: u.rlike("|".join(parts)))


def local_mark(code: str, part: str, tag: str = "960??") -> Column:
    return C.any_contain(M.values(tag, code), part)


def collections(rules: Sequence[Collection]) -> Column:
    """All collections whose condition holds, once each, in the order of the rules."""
    return C.uniq(F.array_compact(F.array(*(F.when(F.coalesce(r.holds, F.lit(False)), _labelled(F.lit(r.iri), r.label)) for r in rules))))


#: Carriers and media, which aren't forms of content.
MEDIA_WORDS = "Audiovisuelles Material|Bildplatte|CD|CD-ROM|Dia|Diskette|DVD-Audio|DVD-ROM|DVD-Video|Elektronische Publikation|Film|Medienkombination|Mikroform|Musikdruck|Online-Publikation|Schallplatte|Text|Tonbildreihe|Tonkassette|Tonträger|Videokassette"


def forms() -> Column:
    """Forms of content of 348, 655 and 689 with their GND numbers, first of each label; media words go."""
    def form(f: Column) -> Column:
        iri = C.first(F.transform(F.filter(M.sub(f, "0"), lambda i: i.rlike(_GND)), lambda i: F.regexp_replace(i, _GND, "https://d-nb.info/gnd/$1")))
        return _labelled(iri, M.sub1(f, "a"))

    terms = M.fields("655 7", where=lambda f: M.has(f, "a") & ~C.any_equal(M.sub(f, "2"), "gnd-carrier"))
    chain = M.fields("689??", where=lambda f: M.has(f, "a") & C.any_match(M.sub(f, "A"), "f|F"))
    every = F.concat(F.transform(M.fields("348  ", where=lambda f: M.has(f, "a")), form), F.filter(F.concat(F.transform(terms, form), F.transform(chain, form)), lambda x: ~x["label"].rlike(MEDIA_WORDS)))
    def firsts(e: Column) -> Column:
        labels = F.array_distinct(F.transform(e, lambda x: x["label"]))
        return F.transform(labels, lambda l: C.first(F.filter(e, lambda x: x["label"] == l)))

    return C.let(every, firsts)


def with_form_ids(df: DataFrame, key: str, forms_col: str, table: DataFrame, out: str) -> DataFrame:
    """Forms without a number get it from a table (label, number); forms unknown there too go."""
    d = lookups.lookup_each(df.withColumn("_labels", F.col(f"{forms_col}.label")), key, "_labels", table, "_ids", keep=True)
    filled = F.transform(
        F.arrays_zip(F.col(forms_col).alias("f"), F.col("_ids").alias("i"), F.col("_labels").alias("l")),
        lambda x: F.struct(F.coalesce(x["f"]["id"], F.when(x["i"] != x["l"], C.prefixed(x["i"], "https://d-nb.info/gnd/"))).alias("id"), x["f"]["label"].alias("label")),
    )
    return d.withColumn(out, F.filter(filled, lambda x: x["id"].isNotNull())).drop("_labels", "_ids")


def works() -> dict[str, Column]:
    """The work a record is an example of, and the works it contains."""
    uniform = C.first(F.concat(M.fields("130??"), M.fields("240??")))
    own = F.when(uniform.isNotNull(), F.struct(C.joined(M.sub(uniform, "anp"), ". ").alias("label"), F.array(F.lit("Work")).alias("type")))
    held = F.transform(M.fields("7[013][01]?2"), lambda f: F.struct(C.joined(M.sub(f, "at"), ". ").alias("label"), F.array(F.lit("Work")).alias("type")))
    return {"exampleOfWork": own, "containsExampleOfWork": F.when(F.size(held) > 0, held)}


def related_by_isbn(known: Column) -> Column:
    """Records of 775 and 776 by their numbers, in both forms; numbers of the record itself are left out."""
    def one(f: Column) -> Column:
        clean = F.transform(M.sub(f, "z"), C.isbn_clean)
        both = C.compacted(C.uniq(F.flatten(F.transform(clean, lambda n: F.array(n, F.when(F.length(n) == 13, C.isbn10(n)).otherwise(C.isbn13(n)))))))
        return F.struct(C.joined(M.sub(f, "t"), ". ").alias("label"), both.alias("isbn"), C.compacted(M.sub(f, "in")).alias("note"))

    found = F.transform(M.fields("775??", "776??"), one)
    return F.filter(found, lambda r: ~C.occurs_in(r["isbn"], known))


def with_notations(docs: DataFrame, key: str, table: DataFrame, valid: str, out: str) -> DataFrame:
    """Notations of a table (key, comma list) by record id, those that are valid; one equi-join."""
    t = table.select(F.col("key").alias(key), F.split("value", r"\s*,\s*").alias("_n"))
    d = docs.join(t, key, "left")
    return d.withColumn(out, C.compacted(F.filter("_n", lambda n: n.rlike(C.full(valid))))).drop("_n")


def with_places(docs: DataFrame, key: str, places: str, table: DataFrame, out: str) -> DataFrame:
    """Places by their numbers: label, kind, and the point of ``Point(lon lat)``. ``table``: key, label, kind, point."""
    number = r"(-?\d+(?:\.\d+)?)"
    point = lambda i: F.regexp_extract("point", rf"Point\({number} {number}\)", i).try_cast("double")
    t = table.select(F.col("key").alias("_p"), F.struct(F.col("key").alias("id"), "label", "kind", F.struct(point(2).alias("lat"), point(1).alias("lon")).alias("geo")).alias("_place"))
    each = docs.select(key, F.posexplode(places).alias("_pos", "_p")).join(t, "_p")
    lists = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_place"))).alias("_l"))
    return docs.join(lists, key, "left").withColumn(out, F.transform("_l", lambda x: x["_place"])).drop("_l")


def with_provenance(docs: DataFrame, code: str, own: DataFrame, old_codes: DataFrame, labels: DataFrame, special: Sequence[tuple[str, str]], out: str) -> DataFrame:
    """The organisation behind an agency code: special cases in their order, then a table of codes, then of
    older codes, then the prefixed code; its label, or that of its parent."""
    d = lookups.lookup(lookups.lookup(docs, code, own, "_own"), code, old_codes, "_old")
    x = F.col(code)
    fixed = C.first_of([(x.rlike(C.full(p)), v) for p, v in special]) if special else F.lit(None).cast("string")
    d = d.withColumn("_isil", F.coalesce(fixed, "_own", C.prefixed(F.col("_old"), "DE-"), F.when(x.rlike("^[A-Z]{2}-"), x).otherwise(C.prefixed(x, "DE-"))))
    d = lookups.with_parent(d, "_isil", F.regexp_replace("_isil", "^([A-Z]+-[^-]+)-.*$", "$1"), labels, "_label")
    return d.withColumn(out, F.struct(F.col("_isil").alias("isil"), F.col("_label").alias("label"))).drop("_own", "_old", "_isil", "_label")


def fallback_label(entries: Column, inner: str, label: str) -> Column:
    """Entries without a label whose IRI is one of our own get a general one."""
    named = lambda e: F.coalesce(e["label"], F.when(e["id"].contains(inner), F.lit(label)))
    return F.transform(entries, lambda e: _labelled(e["id"], named(e)))


def with_external_items(docs: DataFrame, key: str, table: DataFrame, item_schema: str, out: str) -> DataFrame:
    """Holdings that others report, a JSON list for each record id (key, value), whose quotes may be doubled."""
    t = table.select(F.col("key").alias(key), F.from_json(F.replace("value", F.lit('""'), F.lit('"')), f"array<{item_schema}>").alias("_more"))
    d = docs.join(t, key, "left")
    return d.withColumn(out, F.coalesce(F.concat(F.coalesce(out, F.array().cast(d.schema[out].dataType)), "_more"), out)).drop("_more")


def with_catalogue_link(items: DataFrame, holder: str, parent: str, templates: Sequence[tuple[DataFrame, str, str]], out: str) -> DataFrame:
    """A link into the holder's catalogue, else into its parent's. ``templates``: tables (key, value) of link forms, the
    mark in them, and the column of the number to put there; the first that has both gives the link."""
    tries = []
    d = items
    for owner in (holder, parent):
        for i, (table, mark, number) in enumerate(templates):
            name = f"_{owner}{i}"
            d = lookups.lookup(d, owner, table, name)
            tries.append(F.replace(F.col(name), F.lit(mark), F.col(number)))
    return d.withColumn(out, F.coalesce(*tries)).drop(*(f"_{o}{i}" for o in (holder, parent) for i in range(len(templates))))
