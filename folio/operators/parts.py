"""What records are part of, who owned their copies, and what they say in other scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import columns as C
from folio.functions import marc as M

from . import derive

#: Agencies whose numbers link to records, and how their ids begin.
_LINKED = r"^\((DE-600|DE-605)\)(.+)$"


def _iri(number: Column, base: str) -> Column:
    zdb = F.regexp_extract(number, _LINKED, 1) == "DE-600"
    return F.concat(F.lit(base + "resources/"), F.when(zdb, "ZDB-").otherwise(""), F.regexp_extract(number, _LINKED, 2), F.lit("#!"))


def _plain(x: Column) -> Column:
    return C.present(F.regexp_replace(x, "<<|>>", ""))


def _numbering(x: Column) -> Column:
    return C.present(F.regexp_replace(x, r"^[©]|\s?[,.:;/=]?$", ""))


def _part(iri: Column | None, label: Column, numbering: Column, note: Column | None = None) -> Column:
    above = F.struct((F.lit(None).cast("string") if iri is None else iri).alias("id"), label.alias("label"))
    return F.struct(
        F.array(F.lit("IsPartOfRelation")).alias("type"), F.array(above).alias("hasSuperordinate"), _numbering(numbering).alias("numbering"),
        (F.lit(None).cast("array<string>") if note is None else C.compacted(note)).alias("note"),
    )


def _hosts() -> Column:
    return M.fields("773??", where=lambda f: ~C.any_equal(M.sub(f, "9"), "LOCAL"))


def _numbers(f: Column) -> Column:
    return F.filter(M.sub(f, "w"), lambda w: w.rlike(_LINKED))


def containment(base: str = derive.BASE) -> dict[str, Column]:
    """``isPartOf`` and ``containedIn``, by precedence.

    A host with a number of a known agency comes before one without, which counts only until the first of the
    former; 830 replaces its 490; a part without a label takes the record's own title. Component parts are
    contained in their hosts instead, unless they are numbered parts of a whole.
    """
    component = C.fixed(F.col("leader"), 7).isin("a", "d")
    own = F.filter(M.values("245??", "np"), lambda v: v != "[...]")
    numbered = F.size(own) > 0
    main = F.regexp_replace(F.regexp_replace(M.value("245??", "a"), r"^[©]|\s?[,.:;/=]?$", ""), "<<|>>", "")

    def with_title(label: Column) -> Column:
        return F.coalesce(_plain(label), main)

    def hosts(fields: Column) -> Column:
        linked = F.flatten(F.transform(fields, lambda f: F.transform(_numbers(f), lambda w: _part(_iri(w, base), with_title(M.sub1(f, "t")), M.sub1(f, "q"), M.sub(f, "i")))))
        first = F.coalesce(F.array_position(F.transform(fields, lambda f: F.size(_numbers(f)) > 0), True), F.lit(0))
        before = F.filter(fields, lambda f, i: (F.size(_numbers(f)) == 0) & ((first == 0) | (i + 1 < first)))
        unlinked = F.transform(before, lambda f: _part(None, with_title(M.sub1(f, "t")), M.sub1(f, "q"), M.sub(f, "i")))
        return F.concat(unlinked, linked)

    def series(fields: Column) -> Column:
        return F.transform(fields, lambda f: _part(None, with_title(C.joined(M.sub(f, "a"), " / ")), C.joined(M.sub(f, "v"), "")))

    added = M.fields("830??")

    def of_830(f: Column) -> Column:
        number = F.when(C.all_match(M.sub(f, "w"), _LINKED.strip("^$")), M.sub1(f, "w"))
        return _part(F.when(number.isNotNull(), _iri(number, base)), with_title(C.joined(M.sub(f, "a"), " / ")), M.sub1(f, "v"))

    replaced = F.when(F.size(added) > 0, F.slice(added, 1, 0)).otherwise(M.fields("4901?"))
    every = F.concat(F.when(~component | numbered, hosts(_hosts())).otherwise(hosts(F.slice(_hosts(), 1, 0))), series(M.fields("4900?")), series(replaced), F.transform(added, of_830))
    contained = F.flatten(F.transform(M.fields("773??"), lambda f: F.transform(_numbers(f), lambda w: F.struct(_iri(w, base).alias("id"), F.coalesce(_plain(M.sub1(f, "t")), F.lit("Ressource")).alias("label")))))
    some = lambda x: C.let(C.uniq(x), lambda v: F.when(F.size(v) > 0, v))
    return {"isPartOf": some(every), "containedIn": F.when(component & ~numbered, some(contained))}


#: Words before a mark of ownership that say only where it stands.
_MARKS = r"(Nummer|Zugangsnummer|Signatur|Initiale|Monogramm) .+"


def _owned(f: Column) -> Column:
    """An event of a copy's history."""
    gnd = C.first(F.transform(F.filter(M.sub(f, "0"), lambda i: i.rlike(r"^\(DE-588\).+$")), lambda i: F.regexp_replace(i, r"^\(DE-588\)", "https://d-nb.info/gnd/")))
    marked = lambda v: v.rlike(C.full(_MARKS))
    proof = F.transform(M.sub(f, "f"), lambda v: F.when(marked(v), F.regexp_replace(v, C.full(_MARKS), "$1")).otherwise(v))
    return F.struct(
        F.array(F.lit("Event")).alias("type"), F.struct(gnd.alias("id"), M.sub1(f, "a").alias("label")).alias("owner"), C.compacted(M.sub(f, "o")).alias("typeOfOwnership"), C.compacted(proof).alias("proof"),
        C.compacted(F.concat(F.filter(M.sub(f, "f"), marked), M.sub(f, "z"))).alias("note"), F.regexp_replace(M.sub1(f, "k"), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").alias("startDate"),
        M.sub1(f, "l").alias("dateStatement"), C.compacted(M.sub(f, "u")).alias("seeAlso"),
    )


def with_custody(items: Column) -> Column:
    """Items with the events of 361 that name their owner and call number, in the record's order.

    An outer join within the record: events whose copy is no item make one, once for each owner and call
    number; items without events have none.
    """
    key = lambda owner, call: F.concat_ws("\x1f", owner, call)
    events = M.fields("361??")
    of_field = lambda f: key(M.sub1(f, "5"), M.sub1(f, "s"))
    told = lambda k: F.transform(F.filter(events, lambda f: of_field(f) == k), _owned)
    some = derive._some

    def made(k: Column) -> Column:
        f = F.element_at(F.filter(events, lambda g: of_field(g) == k), 1)
        none = F.lit(None).cast("string")
        item = derive._item("Item", F.concat_ws(":", F.col("record_id"), M.sub1(f, "5"), F.url_encode(M.sub1(f, "s"))), M.sub1(f, "5"), none, M.sub1(f, "s"), none, none)
        return item.withField("type", F.array(F.lit("Item"))).withField("custodialHistory", told(k))

    def merged(own: Column) -> Column:
        held = F.transform(own, lambda i: i.withField("custodialHistory", some(told(key(i["currentLibrary"], i["callNumber"])))))
        there = F.transform(own, lambda i: key(i["currentLibrary"], i["callNumber"]))
        return F.concat(held, F.transform(F.array_except(F.transform(events, of_field), there), made))

    return C.let(items, merged)


def shadows(records: DataFrame) -> DataFrame:
    """``(record_id, script, leader, control, data)``: of each script in a record what its fields 880 say, under their own tags.

    A field 880 belongs to the field that its ``$6`` names if that field's ``$6`` names it back. Scripts without a
    code are "Zzzz". All derivations read a shadow as they read a record.
    """
    code = lambda g: F.coalesce(C.present(F.regexp_extract(M.sub1(g, "6"), r"/(.+?)(?:/r)?$", 1)), F.lit("Zzzz"))
    named = lambda f, pattern: F.regexp_extract(M.sub1(f, "6"), pattern, 1)
    links = F.transform(F.filter("data", lambda f: (f["tag"] != "880") & M.has(f, "6")), lambda f: F.concat(f["tag"], F.lit("-"), named(f, r"^880-(\d{2})")))
    twins = C.let(links, lambda known: F.filter("data", lambda g: (g["tag"] == "880") & F.array_contains(known, named(g, r"^(\d{3}-\d{2})"))))
    d = records.select("record_id", "leader", "control", twins.alias("twins")).where(F.size("twins") > 0)
    d = d.select("record_id", "leader", "control", "twins", F.explode(C.uniq(F.transform("twins", code))).alias("script"))
    own = F.filter("twins", lambda g: code(g) == F.col("script"))
    data = F.transform(own, lambda g: g.withField("tag", F.substring(M.sub1(g, "6"), 1, 3)).withField("sub", F.filter(g["sub"], lambda s: s["code"] != "6")))
    return d.select("record_id", "script", "leader", "control", data.alias("data"))


def other_scripts(records: DataFrame, names: dict[str, str], this_year: int) -> DataFrame:
    """``(record_id, alternateGraphicRepresentation)``: of each record its scripts with title, agents, subjects,
    containment, publication and manufacture as they stand in that script. Records without fields 880 have no row."""
    s = shadows(records)
    kinds = F.array(F.lit("BibliographicResource"))
    labels = lambda x: derive._some(C.uniq(C.compacted(x)))
    own = F.array_compact(F.transform(containment()["isPartOf"], lambda p: p))
    record = F.struct(
        derive.title().alias("title"), derive.other_titles()["otherTitleInformation"].alias("otherTitleInformation"), derive.other_titles()["responsibilityStatement"].alias("responsibilityStatement"), derive.other_titles()["edition"].alias("edition"),
        labels(F.transform(derive.contributions(kinds), lambda c: c["agent"]["label"])).alias("contribution"), labels(F.transform(derive.subjects(), lambda c: c["label"])).alias("subject"),
        derive._some(own).alias("isPartOf"), derive._some(F.filter(derive.publication(this_year), lambda p: p["location"].isNotNull() | p["publishedBy"].isNotNull())).alias("publication"), derive.manufacture(this_year).alias("manufacture"),
    )
    each = s.select("record_id", "script", record.alias("record"))
    script = F.struct(F.col("script").alias("id"), C.mapped(F.col("script"), names, keep=True).alias("label"))
    one = F.struct(script.alias("script"), F.col("record"))
    # a handful of scripts a record
    return each.groupBy("record_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["script"]["id"] < b["script"]["id"], -1).when(a["script"]["id"] > b["script"]["id"], 1).otherwise(0)).alias("alternateGraphicRepresentation"))
