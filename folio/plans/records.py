"""Record derivations bound to the star-schema tables.

Every order, part or customer becomes a record whose fields are made from its columns; the derivations read
the record, and the SQL says from the columns alone what they must find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import columns as C
from folio.operators import derive, links, lookups, parts, rules

from .catalogue import Tables

#: Run parameter: years after it are in the future.
THIS_YEAR = 2024

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        _SQL[f.__name__] = sql
        return f

    return add


def _col(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x.cast("string")


def field(tag: str, ind: str, *subs: tuple[str, Column | str], when: Column | None = None) -> Column:
    """A data field; subfields that are null are left out, and so is the field where ``when`` doesn't hold."""
    made = F.array(*(F.struct(F.lit(code).alias("code"), _col(v).alias("value")) for code, v in subs))
    f = F.struct(F.lit(tag).alias("tag"), F.lit(ind[0]).alias("ind1"), F.lit(ind[1]).alias("ind2"), F.filter(made, lambda s: s["value"].isNotNull()).alias("sub"))
    return f if when is None else F.when(when, f)


def records(df: DataFrame, key: str, *data: Column, six: Column | str = "a", seven: Column | str = "m", f007: Column | str | None = None, f008: Column | None = None, f006: Column | str | None = None) -> DataFrame:
    """One record for each row, with the columns of the row beside it.

    The rows are dealt out first: a small file is one task's, but its records are work for many.
    """
    df = df.repartition(key)
    controls = [F.struct(F.lit("001").alias("tag"), F.col(key).cast("string").alias("value"))]
    for tag, v in (("006", f006), ("007", f007), ("008", f008)):
        if v is not None:
            controls.append(F.struct(F.lit(tag).alias("tag"), _col(v).alias("value")))
    leader = F.concat(F.lit("00000n"), _col(six), _col(seven), F.lit(" a2200000 c 4500"))
    return df.select("*", F.col(key).cast("string").alias("record_id"), leader.alias("leader"), F.array(*controls).alias("control"), F.array_compact(F.array(*data)).alias("data"))


def fixed_field(entered: Column | str = "990101", year: Column | str = "1999", end: Column | str = "    ", at21: Column | str = " ", language: Column | str = "ger") -> Column:
    return F.concat(_col(entered), F.lit("s"), _col(year), _col(end), F.lit("gw    "), _col(at21), F.lit(" " * 13), _col(language), F.lit(" c"))


def pick(key: str, *choices: str | None) -> Column:
    """One of the choices by the remainder of a key."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, c in enumerate(choices):
        out = out.when(F.col(key) % len(choices) == i, F.lit(c))
    return out


def _k() -> Column:
    return F.col("o_orderkey")


def _p() -> Column:
    return F.col("p_partkey")


def _year() -> Column:
    return F.year("o_orderdate").cast("string")


def flat(values: Column) -> Column:
    return F.array_join(values, "|")




# --- identifiers -------------------------------------------------------------------------------------


@_query("""
    with p as (select p_partkey, lpad(p_partkey::varchar, 9, '0') as s from part),
    c as (select *, (11 - list_sum([s[i]::int * (11 - i) for i in range(1, 10)]) % 11) % 11 as ten,
                 (10 - (38 + list_sum([s[i]::int * (case when i % 2 = 1 then 3 else 1 end) for i in range(1, 10)])) % 10) % 10 as thirteen from p)
    select p_partkey::varchar as record_id,
           case when p_partkey % 3 = 0 then '978' || s || '0|' || s || (case when ten = 10 then 'X' else (ten::int)::varchar end)
                when p_partkey % 3 = 1 then s || 'X|978' || s || (thirteen::int)::varchar end as isbn
    from c
""")
def record_isbn(t):
    """Both forms of a number, of 13 or 10 digits; every third part has none that can be cleaned."""
    s = F.lpad(_p().cast("string"), 9, "0")
    given = F.when(_p() % 3 == 0, F.concat(F.lit("978-"), s, F.lit("-0"))).when(_p() % 3 == 1, F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 5), F.lit("-X (Pb.)"))).otherwise("none")
    return records(t.part, "p_partkey", field("020", "  ", ("a", given))).select("record_id", flat(derive.isbn()).alias("isbn"))


@_query("""
    select o_orderkey::varchar as record_id,
           nullif(concat_ws('|', case when o_orderkey % 2 = 0 then 'urn:nbn:de:' || o_orderkey end, case when o_orderkey % 3 = 0 then 'urn:nbn:at:' || o_custkey end), '') as urn,
           nullif(concat_ws('|', case when o_orderkey % 5 < 2 then '10.1234/o' || o_orderkey end, case when o_orderkey % 7 = 0 and not (o_orderkey % 5 < 2) then '10.1234/o' || o_orderkey end), '') as doi
    from orders
""")
def record_urn_doi(t):
    r = records(
        t.orders, "o_orderkey",
        field("024", "7 ", ("a", F.concat(F.lit("nbn:de:"), _k())), ("2", "urn"), when=_k() % 2 == 0),
        field("856", "40", ("u", F.concat(F.lit("https://nbn-resolving.org/urn:nbn:at:"), "o_custkey")), when=_k() % 3 == 0),
        field("024", "7 ", ("a", F.concat(F.lit("10.1234/o"), _k())), ("2", "doi"), when=_k() % 5 < 2),
        field("856", "40", ("u", F.concat(F.lit("https://doi.org/10.1234/o"), _k())), when=_k() % 7 == 0),
    )
    return r.select("record_id", flat(derive.urn()).alias("urn"), flat(derive.doi()).alias("doi"))


@_query("""
    with n as (select *, lpad((o_orderkey % 100000000)::varchar, 8, '0') as s, o_orderkey % 6 as m from orders)
    select o_orderkey::varchar as record_id, case when m = 0 then s || 'X' when m = 5 then s || '1' end as dnb, case when m = 1 then s || '7' end as k10plus,
           case when m = 2 then 'AC' || s end as obv, case when m = 3 then s end as gbv, 'oc' || o_custkey as oclc
    from n
""")
def record_agencies(t):
    s = F.lpad((_k() % 100000000).cast("string"), 8, "0")
    m = _k() % 6
    number = F.when(m == 0, F.concat(F.lit("(DE-101)"), s, F.lit("X"))).when(m == 1, F.concat(F.lit("(DE-627)"), s, F.lit("7"))).when(m == 2, F.concat(F.lit("(AT-OBV)AC"), s)).when(m == 3, F.concat(F.lit("(DE-599)GBV"), s)).when(m == 4, F.concat(F.lit("(DE-101)x"), s))
    r = records(t.orders, "o_orderkey", field("035", "  ", ("a", number)), field("035", "  ", ("a", F.concat(F.lit("(OCoLC)oc"), "o_custkey"))), field("016", "7 ", ("a", F.concat(s, F.lit("1"))), ("2", "DE-101"), when=m == 5))
    ids = derive.agency_ids()
    return r.select("record_id", ids["dnbId"].alias("dnb"), ids["k10PlusId"].alias("k10plus"), ids["obvId"].alias("obv"), ids["gbvId"].alias("gbv"), flat(derive.oclc()).alias("oclc"))


@_query("select c_custkey::varchar as record_id, case when c_custkey % 4 < 3 then (c_custkey % 1000000 + 1)::varchar || '-' || (case when c_custkey % 4 = 2 then 'X' else '5' end) end as zdb, replace((c_custkey % 4)::varchar || '234-567X', '-', '') as issn from customer")
def record_zdb(t):
    n, m = (F.col("c_custkey") % 1000000 + 1).cast("string"), F.col("c_custkey") % 4
    at_016 = field("016", "7 ", ("a", F.when(m == 1, F.concat(n, F.lit("--5"))).otherwise(F.lit("none"))), ("2", "DE-600"), when=m.isin(1, 3))
    at_035 = field("035", "  ", ("a", F.when(m == 0, F.concat(F.lit("(DE-600)"), n, F.lit("-5"))).otherwise(F.concat(F.lit("(DE-600)"), n, F.lit("X")))), when=m.isin(0, 2))
    r = records(t.customer, "c_custkey", at_016, at_035, field("022", "0 ", ("a", F.concat(m.cast("string"), F.lit("234-567X")))))
    return r.select("record_id", derive.zdb_id().alias("zdb"), flat(derive.issn()).alias("issn"))


@_query("""
    select o_orderkey::varchar as record_id, o_orderkey % 2 = 0 and (o_orderkey % 5 = 0 or o_orderkey % 3 <> 0) as network,
           case when o_orderkey % 2 = 0 and (o_orderkey % 5 = 0 or o_orderkey % 3 <> 0) then 'HT' || o_orderkey end as local_id
    from orders where o_orderstatus <> 'P'
""")
def record_filter(t):
    """Deleted records go; membership in the network, and its numbers."""
    r = records(
        t.orders, "o_orderkey", field("DEL", "  ", ("a", F.when(F.col("o_orderstatus") == "P", "Y").otherwise("N"))), field("MBD", "  ", ("M", derive.NETWORK), when=_k() % 2 == 0),
        field("POR", "  ", ("A", "M1"), when=_k() % 5 == 0), field("035", "  ", ("a", "(EXLCZ)9"), when=_k() % 3 == 0), field("035", "  ", ("a", F.concat(F.lit("(DE-605)HT"), _k()))),
    )
    return r.where(~derive.rejected()).select("record_id", derive.in_network().alias("network"), derive.local_id().alias("local_id"))


# --- titles and dates --------------------------------------------------------------------------------


@_query("""
    with p as (select *, case when p_partkey % 3 > 0 then p_size::varchar end as n, case when p_partkey % 5 > 0 then p_type end as pt from part)
    select p_partkey::varchar as record_id, 'The ' || p_name || coalesce(', ' || nullif(coalesce(n, '') || case when n is not null then coalesce(': ' || pt, '') else coalesce(pt, '') end, ''), '') as title,
           p_brand as alternative, p_type || '|' || p_name as other, p_size || '. ed' as edition
    from p
""")
def record_titles(t):
    r = records(
        t.part, "p_partkey",
        field("245", "10", ("a", F.concat(F.lit("<<The>> "), "p_name", pick("p_partkey", " :", " /", "", "="))), ("b", F.concat("p_type", F.lit(" /"))), ("n", F.when(_p() % 3 == 0, "[...]").otherwise(F.col("p_size").cast("string"))), ("p", F.when(_p() % 5 > 0, F.concat("p_type", F.lit(" .")))) ),
        field("246", "1 ", ("a", "none"), when=F.lit(False)), field("246", "13", ("a", F.concat(F.lit("<<"), "p_brand", F.lit(">> ;")))), field("247", "10", ("a", "p"), ("b", F.col("p_name"))), field("250", "  ", ("a", F.concat("p_size", F.lit(". ed.")))),
    )
    o = derive.other_titles()
    return r.select("record_id", derive.title().alias("title"), flat(o["alternativeTitle"]).alias("alternative"), flat(o["otherTitleInformation"]).alias("other"), flat(o["edition"]).alias("edition"))


@_query("""
    with n as (select c_custkey, c_name, unnest(case when c_custkey % 3 = 0 then [1] when c_custkey % 3 = 1 then [1, 2] else [3] end) as n from customer)
    select c_custkey::varchar as record_id, case when n = 1 then 'Cyrl' when n = 2 then 'Arab' else 'Zzzz' end as script, case when n = 1 then 'Cyrillic' when n = 2 then 'Arab' else 'Zzzz' end as script_label, c_name || '-' || n as title
    from n
""")
def record_scripts(t):
    """Titles in other scripts: twins in the record by the number of their occurrence."""
    m, name = F.col("c_custkey") % 3, F.col("c_name")
    twin = lambda n, mark, when: field("880", "10", ("6", f"245-01{mark}"), ("a", F.concat(name, F.lit(f"-{n} /"))), when=when)
    r = records(t.customer, "c_custkey", field("245", "10", ("6", "880-01"), ("a", name)), twin(1, "/Cyrl", m < 2), twin(2, "/Arab/r", m == 1), twin(3, "", m == 2), field("880", "10", ("6", "245-02/Cyrl"), ("a", "another")))
    each = r.select("record_id", F.explode(derive.linked_titles({"Cyrl": "Cyrillic"})).alias("x"))
    return each.select("record_id", F.col("x.script.id").alias("script"), F.col("x.script.label").alias("script_label"), F.col("x.title").alias("title"))


_YEARS = """
    select *, year(o_orderdate)::varchar as y, o_orderkey % 5 = 0 as serial, o_orderkey % 4 as m from orders
"""


@_query(f"""
    with d as ({_YEARS})
    select o_orderkey::varchar as record_id, 'City ' || o_custkey as location, o_orderpriority as publisher,
           case m when 0 then '[ca. ' || y || ']' when 1 then y || '-2005' when 2 then 'c' || y else '2077' end as statement, y as start_year, case when serial and m = 1 then '2005' end as end_year,
           case when o_orderkey % 3 = 0 then 'Printer ' || o_custkey || ':1997' end as manufacture
    from d
""")
def record_publication(t):
    """264 before 260, cleaned dates, a future year that gives way to the fixed field's, and manufacture."""
    statement = F.when(_k() % 4 == 0, F.concat(F.lit("[ca. "), _year(), F.lit("]"))).when(_k() % 4 == 1, F.concat(_year(), F.lit("-2005"))).when(_k() % 4 == 2, F.concat(F.lit("c"), _year())).otherwise("2077")
    r = records(
        t.orders, "o_orderkey", field("260", "  ", ("a", "Old place :"), ("c", "1901")), field("264", " 1", ("a", "Earlier"), ("c", "1900"), when=F.lit(False)),
        field("264", "31", ("a", F.concat(F.lit("City "), "o_custkey", F.lit(" :"))), ("b", F.concat("o_orderpriority", F.lit(" ,"))), ("c", statement)),
        field("264", " 3", ("a", "Works :"), ("b", F.concat(F.lit("Printer "), "o_custkey")), ("c", "[1997]"), when=_k() % 3 == 0),
        seven=F.when(_k() % 5 == 0, "s").otherwise("m"), f008=fixed_field(year=_year()),
    )
    r = r.select("record_id", F.element_at(derive.publication(THIS_YEAR), 1).alias("p"), F.try_element_at(derive.manufacture(THIS_YEAR), F.lit(1)).alias("m"))
    return r.select("record_id", flat(F.col("p.location")).alias("location"), flat(F.col("p.publishedBy")).alias("publisher"), F.col("p.dateStatement").alias("statement"), F.col("p.startDate").alias("start_year"), F.col("p.endDate").alias("end_year"), F.concat(flat(F.col("m.manufacturedBy")), F.lit(":"), F.col("m.startDate")).alias("manufacture"))


@_query(f"""
    with d as ({_YEARS}), e as (select *, unnest(case when o_orderkey % 2 = 0 then [1, 2] else [0] end) as n from d)
    select o_orderkey::varchar as record_id, case when n = 0 then 'A|B' when n = 1 then 'A' else 'B' end as location, case when n = 2 then 'Two' else 'One' end as publisher, 'Microform' as description, y as start_year, case when serial then '2007' end as end_year from e
""")
def record_secondary(t):
    r = records(t.orders, "o_orderkey", field("533", "  ", ("a", "Microform"), ("b", "A"), ("b", "B"), ("c", "One"), ("c", F.when(_k() % 2 == 0, "Two")), ("d", F.concat(_year(), F.lit("-2007")))), seven=F.when(_k() % 5 == 0, "s").otherwise("m"), f008=fixed_field(year=_year()))
    each = r.select("record_id", F.explode(derive.secondary_publications(THIS_YEAR)).alias("e"))
    return each.select("record_id", flat(F.col("e.location")).alias("location"), flat(F.col("e.publishedBy")).alias("publisher"), flat(F.col("e.description")).alias("description"), F.col("e.startDate").alias("start_year"), F.col("e.endDate").alias("end_year"))


@_query("""
    with d as (select *, 28 + o_orderkey % 4 as day, day(last_day(o_orderdate)) as days from orders)
    select o_orderkey::varchar as record_id, strftime(o_orderdate, '%Y-%m-') || (case when month(o_orderdate) = 2 and day > 29 then 28 else least(day, days) end)::varchar as created, strftime(o_orderdate, '%Y-%m-%d') as modified from d
""")
def record_dates(t):
    """Days of the description that a month doesn't have are repaired; 30 and 31 February are the 28th in any year."""
    r = records(t.orders, "o_orderkey", field("MNG", "  ", ("b", "1900-01-01"), ("d", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))), f008=fixed_field(entered=F.concat(F.date_format("o_orderdate", "yyMM"), 28 + _k() % 4)))
    return r.select("record_id", derive.described_by().alias("d")).select("record_id", F.col("d.dateCreated").alias("created"), F.col("d.dateModified").alias("modified"))


# --- kinds -------------------------------------------------------------------------------------------


@_query("""
    with d as (select o_orderkey as k, ['a', 't', 'c', 'e', 'k', 'r'][o_orderkey % 6 + 1] as six, ['m', 's', 'a'][(o_orderkey // 6) % 3 + 1] as seven from orders),
    c as (select *, list_filter([
        case when seven = 's' then ['Newspaper', 'Journal', 'Series', 'Periodical'][k % 4 + 1] end,
        case when seven = 'a' then 'Article' when six in ('a', 't') and seven = 'm' then (case when k % 5 = 0 then 'MultiVolumeBook' else 'Book' end) end,
        case six when 'c' then 'PublishedScore' when 'e' then 'Map' when 'k' then 'Image' when 'r' then 'Game' end,
        case when k % 7 = 0 then 'Thesis' end, case when k % 10 = 2 then 'Bibliography' end, case when k % 10 = 0 then 'Festschrift' end, case when k % 10 = 1 then 'Proceedings' end], lambda x: x is not null) as kinds from d)
    select k::varchar as record_id, array_to_string(list_concat(['BibliographicResource'], case when len(kinds) > 0 then kinds else ['Miscellaneous'] end), '|') as kinds,
           case seven when 'm' then 'Monograph/Item' when 's' then 'Serial' else 'Monographic component part' end as level
    from c
""")
def record_kinds(t):
    seven = F.element_at(F.array(F.lit("m"), F.lit("s"), F.lit("a")), (F.floor(_k() / 6) % 3 + 1).cast("int"))
    r = records(
        t.orders, "o_orderkey", field("245", "10", ("a", "T"), ("n", F.when(_k() % 5 == 0, "1"))), field("502", "  ", ("a", "Diss."), when=_k() % 7 == 0),
        field("655", " 7", ("a", F.when(_k() % 10 == 0, "Festschrift").when(_k() % 10 == 1, "Konferenzschrift (1999)").otherwise("Bibliografie")), when=_k() % 10 < 3),
        six=pick("o_orderkey", "a", "t", "c", "e", "k", "r"), seven=seven, f008=fixed_field(at21=pick("o_orderkey", "n", "p", "m", " ")),
    )
    return r.select("record_id", flat(derive.kinds()).alias("kinds"), derive.bibliographic_level()["label"].alias("level"))


@_query("""
    with d as (select o_orderkey as k, o_orderkey % 4 = 1 as cr, list_filter([case when o_orderkey % 6 = 0 or o_orderkey % 4 = 1 then 'Online' end, [null, 'Audio', 'Video', null, null, null][o_orderkey % 6 + 1], [null, null, null, 'Microform', 'Data carrier', null][o_orderkey % 6 + 1]], lambda x: x is not null) as m from orders)
    select k::varchar as record_id, array_to_string(case when len(m) > 0 then m when k % 5 = 0 then ['Other'] else ['Print'] end, '|') as medium from d
""")
def record_medium(t):
    r = records(t.orders, "o_orderkey", field("338", "  ", ("b", pick("o_orderkey", "cr", "sd", "vd", "he", "cd", None))), six=F.when(_k() % 5 == 0, "k").otherwise("a"), f007=F.when(_k() % 4 == 1, "cr |||").otherwise("tu"))
    return r.select("record_id", flat(derive.medium()).alias("medium"))


@_query("""
    with d as (select o_orderkey as k, list_distinct(list_filter([['ger', 'eng', 'und', 'zxx'][o_orderkey % 4 + 1], ['fre', 'mul'][o_orderkey % 2 + 1], case when o_orderkey % 3 = 0 then 'lat' end], lambda x: x is not null and x not in ('und', 'zxx', 'mul'))) as l from orders)
    select k::varchar as record_id, array_to_string(list_sort(l), '|') as languages from d
""")
def record_languages(t):
    r = records(t.orders, "o_orderkey", field("041", "0 ", ("a", pick("o_orderkey", "fre", "mul")), ("d", F.when(_k() % 3 == 0, "lat"))), f008=fixed_field(language=pick("o_orderkey", "ger", "eng", "und", "zxx")))
    return r.select("record_id", flat(F.array_sort(derive.language_codes())).alias("languages"))


@_query("select p_partkey::varchar as record_id, p_size || ' S.' || case when p_partkey % 2 = 0 then ' : Ill.' else '' end || case when p_partkey % 3 = 0 then ' ; 20 cm' else '' end || case when p_partkey % 5 = 0 then ' + 1 CD' else '' end as extent, p_name as note, p_type || ', ' || p_brand as thesis from part")
def record_extent(t):
    r = records(
        t.part, "p_partkey", field("300", "  ", ("a", F.concat("p_size", F.lit(" S. :"))), ("b", F.when(_p() % 2 == 0, "Ill. ;")), ("c", F.when(_p() % 3 == 0, "20 cm +")), ("e", F.when(_p() % 5 == 0, "1 CD"))),
        field("500", "  ", ("a", F.col("p_name"))), field("500", "  ", ("a", F.col("p_name"))), field("502", "  ", ("a", F.col("p_type")), ("b", F.col("p_brand"))),
    )
    n = derive.notes()
    return r.select("record_id", derive.extent().alias("extent"), flat(n["note"]).alias("note"), flat(n["thesisInformation"]).alias("thesis"))


# --- agents and subjects -----------------------------------------------------------------------------

_STATEMENTS = {"Verfasser": "aut", "Hrsg.": "edt", "Herausgebendes Organ": "isb", "Ed.": "edt", "Übersetzer": "trl", "Zeichner": "ill", "Stecher": "egr", "Interviewer": "ivr", "Interviewter": "ive", "Komponist": "cmp", "Meditation": None, "Fotograf": "pht", "Klavier": "itr"}
_ROLE_SQL = "[" + ", ".join(f"'{r}'" if r else "null" for r in _STATEMENTS.values()) + "]"


@_query(f"""
    select c_custkey::varchar as record_id, coalesce(({_ROLE_SQL})[c_custkey % {len(_STATEMENTS)} + 1], 'aut') as role, c_name || case when c_custkey % 2 = 0 then ', II.' else '' end as label, c_custkey::varchar as number,
           case when c_custkey % 3 = 0 then '-' || lpad((c_custkey % 90 + 1)::varchar, 4, '0') else (1800 + c_custkey % 100)::varchar end as born, case when c_custkey % 4 = 0 then null else (1900 + c_custkey % 100)::varchar end as died, 'alias ' || c_nationkey as other_names
    from customer
""")
def record_contributions(t):
    """Roles from statements, else from the kind; life dates; other names of the authority; no repeated names."""
    c = F.col("c_custkey")
    born = F.when(c % 3 == 0, F.concat(F.lit("v"), c % 90 + 1)).otherwise((1800 + c % 100).cast("string"))
    r = records(
        t.customer, "c_custkey",
        field("100", "1 ", ("a", F.concat("c_name", F.lit(","))), ("b", F.when(c % 2 == 0, "II.")), ("d", F.concat(born, F.lit("-"), F.when(c % 4 == 0, "").otherwise((1900 + c % 100).cast("string")))), ("e", pick("c_custkey", *_STATEMENTS)), ("0", F.concat(F.lit("(DE-588)"), c)), ("B", F.concat(F.lit("G"), "c_nationkey"))),
        field("700", "1 ", ("a", "Twice"), ("a", "named")), field("GPN", "  ", ("a", F.concat(F.lit("alias "), "c_nationkey")), ("B", F.concat(F.lit("G"), "c_nationkey"))), field("GPN", "  ", ("a", "stranger"), ("B", "other")),
    )
    each = r.withColumn("type", derive.kinds()).select("record_id", F.explode(derive.contributions(F.col("type"))).alias("x"))
    return each.select("record_id", F.col("x.role").alias("role"), F.col("x.agent.label").alias("label"), F.col("x.agent.gndIdentifier").alias("number"), F.col("x.agent.dateOfBirth").alias("born"), F.col("x.agent.dateOfDeath").alias("died"), flat(F.col("x.agent.altLabel")).alias("other_names"))


@_query("""
    select p_partkey::varchar as record_id, p_name || '|' || p_type || ' / ' || p_brand || '|51' || p_size || '|SK ' || p_size as subjects,
           p_type || ', ' || p_brand || ' | ' || p_name || '|' || p_brand as chains, p_name || '|' || p_type || ' / ' || p_brand || '|' || p_type || ', ' || p_brand || '|' || p_brand as labels
    from part
""")
def record_subjects(t):
    """Uncontrolled words, headings, notations, chains of components, and the labels of them all."""
    r = records(
        t.part, "p_partkey", field("653", "  ", ("a", F.concat("p_name", F.lit(".")))), field("650", " 7", ("a", F.col("p_type")), ("x", F.col("p_brand")), ("2", "gnd"), ("0", F.concat(F.lit("(DE-588)"), _p()))),
        field("650", " 7", ("a", "of another vocabulary"), ("2", "other")), field("082", "0 ", ("a", F.concat(F.lit("51/"), "p_size"))), field("084", "  ", ("a", F.concat(F.lit("SK "), "p_size")), ("2", "rvk")),
        field("689", "00", ("a", F.col("p_type")), ("x", F.col("p_brand"))), field("689", "01", ("a", F.col("p_name"))), field("689", "10", ("a", F.col("p_brand"))), field("689", "1 ", ("5", "owner")),
    )
    r = r.withColumns({"s": derive.subjects(), "c": derive.subject_chains()})
    return r.select("record_id", flat(F.transform("s", lambda x: F.coalesce(x["label"], x["notation"]))).alias("subjects"), flat(F.col("c.label")).alias("chains"), flat(derive.subject_labels(F.col("s"), F.col("c"))).alias("labels"))


@_query("select p_partkey::varchar as record_id, 'https://d-nb.info/gnd/' || p_size as id, p_type as label from part where p_partkey % 4 < 2 union all select p_partkey::varchar, 'https://d-nb.info/gnd/9' || p_size, 'Form ' || p_size from part where p_partkey % 4 > 0")
def record_forms(t):
    """Forms of content without carriers; numbers that are missing come from a table, unknown forms go."""
    r = records(
        t.part, "p_partkey", field("655", " 7", ("a", F.col("p_type")), ("0", F.concat(F.lit("(DE-588)"), "p_size")), when=_p() % 4 < 2), field("655", " 7", ("a", "DVD-Video"), ("0", "(DE-588)1")),
        field("689", "00", ("A", "f"), ("a", F.concat(F.lit("Form "), "p_size")), when=_p() % 4 > 0), field("655", " 7", ("a", "unknown")),
    )
    table = lookups.as_map(t.part.select(F.concat(F.lit("Form "), "p_size").alias("k"), F.concat(F.lit("9"), "p_size").alias("v")), "k", "v")
    d = links.with_form_ids(r.select("record_id", links.forms().alias("forms")), "record_id", "forms", table, "forms")
    return d.select("record_id", F.inline("forms"))


# --- items -------------------------------------------------------------------------------------------


def _held(t: Tables) -> DataFrame:
    """Records of orders whose line items are items of members and libraries, of one order each."""

    def item(l: Column) -> Column:
        supplier = l["l_suppkey"]
        library = F.concat(F.lit("DE-"), supplier % 40, F.lit("-"), supplier)
        subs = {"a": l["l_partkey"], "M": F.lit("M1"), "w": library, "x": F.lit("hall"), "v": F.when(l["l_linestatus"] == "F", "stack").otherwise("hall"), "z": F.concat(F.lit("Z"), supplier), "n": F.when(l["l_returnflag"] != "A", F.concat(F.lit("N"), l["l_partkey"])), "c": F.concat(F.lit("C"), l["l_linenumber"])}
        return field("ITM", "  ", *subs.items())

    # the fields are made of the lines after they have met
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")).alias("lines"))
    items = lines.select("l_orderkey", F.transform("lines", item).alias("items"))
    base = records(t.orders, "o_orderkey", field("MBD", "  ", ("M", derive.NETWORK)), field("MBD", "  ", ("M", "M2"), when=_k() % 3 == 0), f008=fixed_field(year=_year()))
    joined = base.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.withColumn("data", F.concat("data", F.coalesce("items", F.array().cast("array<struct<tag:string,ind1:string,ind2:string,sub:array<struct<code:string,value:string>>>>"))))


_SHOWN = "l_orderkey in (select o_orderkey from orders) and l_suppkey % 40 <> 3 and l_partkey::varchar not like '%7830'"


@_query(f"""
    select l_orderkey::varchar as record_id, 'items/' || l_partkey as id, 'PhysicalObject' as kind, case when l_linestatus = 'F' then 'Z' || l_suppkey when l_returnflag <> 'A' then 'N' || l_partkey else 'C' || l_linenumber end as call_number from lineitem where {_SHOWN}
    union all select o_orderkey::varchar, 'items/M2', 'TitleOnly', null from orders where o_orderkey % 3 = 0
""")
def record_items(t):
    """Items with the call number of their kind, without bridges and hidden locations; members without holdings."""
    hidden = F.transform(F.filter("data", lambda f: f["tag"] == "ITM"), lambda f: F.concat(F.lit("M1/"), F.element_at(F.filter(f["sub"], lambda s: s["code"] == "w"), 1)["value"]))
    hidden = F.filter(hidden, lambda h: h.rlike("^M1/DE-3-"))
    each = _held(t).withColumn("hidden", hidden).select("record_id", F.explode(derive.items(F.col("hidden"))).alias("i"))
    return each.select("record_id", F.col("i.id").alias("id"), F.element_at("i.type", 2).alias("kind"), F.col("i.callNumber").alias("call_number"))


@_query("""
    with h as (select l_orderkey, count(distinct l_suppkey % 40) as n from lineitem where l_partkey::varchar not like '%7830' group by 1)
    select o_orderkey::varchar as record_id, coalesce(n, 0)::int as holders, coalesce(n, 0) between 1 and 3 and year(o_orderdate) < 1996 as last_copy from orders left join h on l_orderkey = o_orderkey
""")
def record_holders(t):
    """Holders, branches counting as their parents, and the last copies."""
    d = _held(t).withColumn("hasItem", derive.items()).withColumn("holders", derive.holder_count(F.col("hasItem")))
    last = derive.last_copy(derive.in_network(), F.col("holders"), _year(), derive.kinds(), derive.bibliographic_level()["label"], 2005)
    return d.select("record_id", "holders", last.alias("last_copy"))


@_query("""
    select o_orderkey::varchar as record_id, 'DE-' || (c_nationkey % 7) || '-' || c_nationkey as holder,
           case when c_nationkey % 2 = 0 then 'https://own.example/' || c_nationkey || '?z=' || o_orderkey when c_nationkey % 3 = 0 then 'https://local.example/' || c_nationkey || '/' || o_custkey || '/x' when c_nationkey % 7 = 1 then 'https://parent.example/' || o_orderkey end as link
    from orders join customer on c_custkey = o_custkey
""")
def record_catalogue_links(t):
    """Link forms of a holder by the number they want, else of its parent."""
    n = F.col("n_nationkey")
    holder, parent = F.concat(F.lit("DE-"), n % 7, F.lit("-"), n), F.concat(F.lit("DE-"), n % 7)
    by_z = t.nation.where(n % 2 == 0).select(holder.alias("key"), F.concat(F.lit("https://own.example/"), n, F.lit("?z={z}")).alias("value"))
    parents = t.nation.where(n % 7 == 1).select(parent.alias("key"), F.lit("https://parent.example/{z}").alias("value")).distinct()
    by_local = t.nation.where(n % 3 == 0).select(holder.alias("key"), F.concat(F.lit("https://local.example/"), n, F.lit("/{id}/x")).alias("value"))
    c = F.col("c_nationkey")
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(_k().cast("string").alias("record_id"), F.col("o_custkey").cast("string").alias("local"), F.concat(F.lit("DE-"), c % 7, F.lit("-"), c).alias("holder"), F.concat(F.lit("DE-"), c % 7).alias("parent"))
    d = links.with_catalogue_link(d, "holder", "parent", [(by_z.unionByName(parents), "{z}", "record_id"), (by_local, "{id}", "local")], "link")
    return d.select("record_id", "holder", "link")


@_query("select c_custkey::varchar as record_id, c_name as id, 'own' as label from customer union all select c_custkey::varchar, 'more ' || c_nationkey, c_mktsegment from customer where c_custkey % 3 = 0")
def record_external_items(t):
    """Holdings that others report as JSON with doubled quotes are appended."""
    c = F.col("c_custkey")
    docs = t.customer.select(c.cast("string").alias("record_id"), F.array(F.struct(F.col("c_name").alias("id"), F.lit("own").alias("label"))).alias("items"))
    told = t.customer.where(c % 3 == 0).select(c.cast("string").alias("key"), F.concat(F.lit('[{""id"":""more '), "c_nationkey", F.lit('"",""label"":""'), "c_mktsegment", F.lit('""}]')).alias("value"))
    return links.with_external_items(docs, "record_id", told, "struct<id:string,label:string>", "items").select("record_id", F.inline("items"))


# --- relations and links -----------------------------------------------------------------------------


@_query("""
    select o_orderkey::varchar as record_id, case when o_orderkey % 3 = 0 then 'https://example.org/resources/HT' || o_custkey when o_orderkey % 3 = 1 then 'http://ld.zdb-services.de/resource/' || o_custkey || '-5' end as id,
           'Author. Whole ' || o_custkey as label, 'In' as note, case when o_orderkey % 3 = 0 then 'a general label' end as fallback, case when o_orderkey % 2 = 0 then 'Before ' || o_custkey end as predecessor
    from orders
""")
def record_relations(t):
    r = records(
        t.orders, "o_orderkey", field("773", "08", ("i", "In"), ("a", "Author,"), ("t", F.concat(F.lit("Whole "), "o_custkey")), ("w", F.when(_k() % 3 == 0, F.concat(F.lit("(DE-605)HT"), "o_custkey"))), ("w", F.when(_k() % 3 < 2, F.concat(F.lit("(DE-600)"), "o_custkey", F.lit("-5")))), ("w", "(XX)1")),
        field("780", "00", ("t", F.concat(F.lit("Before "), "o_custkey")), when=_k() % 2 == 0),
    )
    r = r.select("record_id", derive.relation("773??").alias("w"), F.try_element_at(derive.relation("780??"), F.lit(1))["label"].alias("predecessor"))
    bare = links.fallback_label(F.transform("w", lambda e: F.struct(e["id"].alias("id"), F.lit(None).cast("string").alias("label"))), "example.org", "a general label")
    return r.select("record_id", F.element_at("w", 1).alias("e"), F.element_at(bare, 1)["label"].alias("fallback"), "predecessor").select("record_id", F.col("e.id").alias("id"), F.col("e.label").alias("label"), flat(F.col("e.note")).alias("note"), "fallback", "predecessor")


@_query("""
    select o_orderkey::varchar as record_id, case when o_orderkey % 2 = 0 then 'http://toc/' || o_orderkey end as contents,
           nullif(concat_ws('|', case when o_orderkey % 3 = 0 then 'http://free/' || o_custkey || '=Volltext' end, case when o_orderkey % 5 = 0 then 'http://open/' || o_custkey || '=Online-Ressource' end), '') as fulltext
    from orders
""")
def record_links(t):
    note = F.concat(F.lit("http://free/"), "o_custkey")
    r = records(
        t.orders, "o_orderkey", field("856", "42", ("u", F.concat(F.lit("http://toc/"), _k())), ("3", "Inhaltsverzeichnis"), when=_k() % 2 == 0), field("856", "40", ("u", note), ("z", "kostenfrei"), ("x", "Verlag"), ("x", "Volltext"), when=_k() % 3 == 0),
        field("856", "40", ("u", F.concat(F.lit("http://open/"), "o_custkey")), ("7", "0"), when=_k() % 5 == 0), field("856", "40", ("u", "http://review"), ("x", "Rezension")), field("856", "40", ("u", "https://doi.org/10.1/x"), ("7", "0")),
    )
    full = F.transform(links.fulltext(), lambda l: F.concat(l["id"], F.lit("="), l["label"]))
    return r.select("record_id", F.nullif(flat(F.transform(links.described_links()["tableOfContents"], lambda l: l["id"])), F.lit("")).alias("contents"), F.nullif(flat(full), F.lit("")).alias("fulltext"))


@_query("""
    select p_partkey::varchar as record_id, case when p_partkey % 2 = 0 then 'Work. ' || p_type end as example_of, case when p_partkey % 3 = 0 then p_brand || '. ' || p_name end as contains,
           case when p_partkey % 5 > 0 then 'Other form' end as related, nullif(concat_ws('|', case when p_size % 4 = 0 then 'c:region' end, case when p_partkey % 3 = 0 then 'c:link' end), '') as collections,
           'http://o/' || p_partkey || case when p_partkey % 2 = 0 then '|http://s/' || p_size else '' end as same_as
    from part
""")
def record_works(t):
    """Works, related records without those of the record's own number, collections by rules, and the same elsewhere."""
    r = records(
        t.part, "p_partkey", field("240", "10", ("a", "Work"), ("p", F.col("p_type")), when=_p() % 2 == 0), field("700", "12", ("a", F.col("p_brand")), ("t", F.col("p_name")), when=_p() % 3 == 0), field("700", "1 ", ("a", "an agent")),
        field("776", "08", ("t", "Other form"), ("z", F.when(_p() % 5 == 0, "0-8044-2957-X").otherwise("3161484100"))), field("084", "  ", ("a", "reg 1"), ("2", "reg"), when=F.col("p_size") % 4 == 0), field("856", "40", ("u", "http://portal.example/1"), when=_p() % 3 == 0),
    )
    rules = [links.Collection("c:region", "Region", links.source_code("reg", start="reg")), links.Collection("c:link", "Portal", links.link_contains("portal")), links.Collection("c:none", "None", links.local_mark("n", "q"))]
    w = links.works()
    same = links.same_as({"http://o/": (F.array(_p().cast("string")), "O"), "http://s/": (F.array(F.when(_p() % 2 == 0, F.col("p_size").cast("string"))), "S")})
    d = r.withColumns({"c": w["containsExampleOfWork"], "rel": links.related_by_isbn(F.array(F.lit("080442957X"))), "coll": links.collections(rules), "same": same})
    none = lambda x: F.nullif(flat(x), F.lit(""))
    return d.select("record_id", w["exampleOfWork"]["label"].alias("example_of"), flat(F.col("c.label")).alias("contains"), none(F.col("rel.label")).alias("related"), none(F.col("coll.id")).alias("collections"), flat(F.col("same.id")).alias("same_as"))


@_query("""
    select c_custkey::varchar as record_id, case when c_nationkey % 2 = 0 then 'SK ' || c_nationkey || '|QA 2' else 'QA 2' end as notations, case when c_nationkey % 3 = 0 then n_name else null end as place, case when c_nationkey % 3 = 0 then n_nationkey + 0.5 end as lat,
           case when c_nationkey % 5 = 0 then 'XX-0' when c_nationkey % 5 = 1 then 'DE-' || n_name else 'DE-' || c_nationkey || '-1' end as isil
    from customer join nation on n_nationkey = c_nationkey
""")
def record_tables(t):
    """Notations, places and agencies by tables that are keyed by record, place and code."""
    n, c = F.col("n_nationkey"), F.col("c_nationkey")
    notations = t.customer.select(F.col("c_custkey").cast("string").alias("key"), F.concat(F.when(c % 2 == 0, F.lit("SK ")).otherwise(F.lit("bad")), c, F.lit(", QA 2")).alias("value"))
    places = t.nation.where(n % 3 == 0).select(n.cast("string").alias("key"), F.col("n_name").alias("label"), F.lit("country").alias("kind"), F.concat(F.lit("Point(7.25 "), n, F.lit(".5)")).alias("point"))
    old = t.nation.where(n % 5 == 1).select(F.concat(n, F.lit("-1")).alias("key"), F.col("n_name").alias("value"))
    empty = old.where(F.lit(False))
    d = t.customer.select(F.col("c_custkey").cast("string").alias("record_id"), F.array(c.cast("string")).alias("p"), F.when(c % 5 == 0, F.lit("ZZ9")).otherwise(F.concat(c, F.lit("-1"))).alias("code"))
    d = links.with_notations(d, "record_id", notations, r"[A-Z]{2} \d+", "n")
    d = links.with_places(d, "record_id", "p", places, "spatial")
    d = links.with_provenance(d, "code", empty, old, empty, [("ZZ.*", "XX-0")], "by")
    place = F.try_element_at("spatial", F.lit(1))
    return d.select("record_id", flat(F.col("n")).alias("notations"), place["label"].alias("place"), place["geo"]["lat"].alias("lat"), F.col("by.isil").alias("isil"))


# --- rules as data, containment, custody, scripts -------------------------------------------------------


def _at(position: int, code: Column | str) -> Column:
    """008 with a code at a position, where there is one."""
    return F.coalesce(F.overlay(fixed_field(), _col(code), position + 1), fixed_field())


@_query("""
    select o_orderkey::varchar as record_id,
           ['Audio-Dokument|Audio-Kassette', 'Online-Ressource', 'Video|Audio-Visuell', 'Print', 'Audio-Dokument|Schallplatte', 'Audio-Dokument|Datenträger', 'Print', 'Sonstige'][o_orderkey % 8 + 1] as medium,
           'BibliographicResource|' || ['Miscellaneous', 'Book', 'Miscellaneous', 'Map', 'Miscellaneous', 'Miscellaneous', 'Book', 'Miscellaneous'][o_orderkey % 8 + 1] as kinds
    from orders
""")
def record_media_rules(t):
    m = _k() % 8
    r = records(
        t.orders, "o_orderkey", field("338", "  ", ("b", "vd"), when=m == 2), field("300", "  ", ("a", "1 Schallpl. : 33 UpM"), when=m == 4),
        six=F.when(m == 3, "e").when(m == 7, "k").otherwise("a"), f007=F.when(m == 0, "ss lunjlc").otherwise("|"), f008=_at(23, F.when(m == 1, "o")), f006=F.when(m == 5, "m        h").otherwise("|"),
    )
    both = rules.media_and_kinds()
    return r.select("record_id", both.alias("x")).select("record_id", flat(F.col("x.medium")).alias("medium"), flat(F.col("x.type")).alias("kinds"))


@_query("""
    select o_orderkey::varchar as record_id,
           'BibliographicResource|' || ['Bibliography|Book', 'Biography|Book', 'Newspaper|Periodical', 'Festschrift|Book', 'Map|Book', 'PublishedScore|Book', 'Article', 'Thesis|Book', 'Festschrift|Book'][o_orderkey % 9 + 1] as kinds
    from orders
""")
def record_kind_rules(t):
    m = _k() % 9
    at = lambda n, code: F.when(m == n[0], F.overlay(fixed_field(), F.lit(code), n[1] + 1))
    f008 = F.coalesce(at((0, 24), "b"), at((1, 34), "a"), at((2, 21), "n"), at((3, 30), "1"), fixed_field())
    r = records(
        t.orders, "o_orderkey", field("245", "10", ("a", F.when(m == 8, "Eine Festschrift").otherwise("T"))), field("300", "  ", ("a", "1 Karte"), when=m == 4),
        six=F.when(m == 5, "c").otherwise("a"), seven=F.when(m == 2, "s").when(m == 6, "a").otherwise("m"), f008=f008, f006=F.when(m == 7, "a         m").otherwise("|"),
    )
    return r.select("record_id", flat(rules.media_and_kinds(titles=F.array(derive.title()))["type"]).alias("kinds"))


@_query("""
    with o as (select o_orderkey as k, o_custkey as c, o_orderkey % 5 <> 4 as network from orders)
    select k::varchar as record_id, 'http://c.example/journals' as id, 'Journals' as label from o where k % 2 = 0
    union all select k::varchar, 'http://c.example/PKG-' || c, case when c = 1 then 'The first' else 'Package PKG-' || c end from o where k % 3 = 0
    union all select k::varchar, 'http://c.example/PKG-1', 'The first' from o where k % 3 = 0 and c <> 1
    union all select k::varchar, 'http://c.example/region', 'Region' from o where k % 4 = 1 and network
""")
def record_memberships(t):
    """Packages by number, a collection by a link's note in two fields, one for the network's records only."""
    links_ = [field("856", "40", ("u", "http://x"), ("x", "JNL"), when=_k() % 2 == 0)] * 2
    r = records(
        t.orders, "o_orderkey", *links_, field("912", "  ", ("a", F.concat(F.lit("PKG-"), "o_custkey", F.lit("-extra"))), when=_k() % 3 == 0), field("912", "  ", ("a", "PKG-1"), when=(_k() % 3 == 0) & (F.col("o_custkey") != 1)),
        field("960", "  ", ("r", "a region"), when=_k() % 4 == 1), field("MBD", "  ", ("M", derive.NETWORK), when=_k() % 5 != 4),
    )
    table = (
        rules.Membership("856??", "x", "JNL", "http://c.example/journals", "Journals"), rules.Membership("912  ", "a", "(PKG-[0-9]+).*", "http://c.example/$1", "Package $1"),
        rules.Membership("960??", "r", ".*region.*", "http://c.example/region", "Region", network=True),
    )
    found = rules.memberships(table, derive.in_network(), {"http://c.example/PKG-1": "The first"})
    return r.select("record_id", F.explode(found).alias("x")).select("record_id", "x.id", "x.label")


@_query("""
    with o as (select o_orderkey as k, o_orderkey % 6 as m, 'https://example.org/resources/' as base, 'Title ' || o_orderkey as title, o_custkey as c from orders)
    select k::varchar as record_id, 'isPartOf' as kind, base || 'HT' || c || '#!' as id, 'Host' as label, '3' as numbering from o where m = 0
    union all select k::varchar, 'isPartOf', null, 'Loose', null from o where m = 1
    union all select k::varchar, 'isPartOf', base || 'ZDB-' || c || '#!', title, null from o where m = 1
    union all select k::varchar, 'isPartOf', null, 'Series A / Sub', '7' from o where m = 2
    union all select k::varchar, 'isPartOf', base || 'HT9#!', 'The New', '8' from o where m = 3
    union all select k::varchar, 'isPartOf', null, 'Kept', null from o where m = 4
    union all select k::varchar, 'containedIn', base || 'HT1#!', 'Journal', null from o where m = 5
""")
def record_containment(t):
    """Hosts with and without numbers, series of both kinds, their replacements, and component parts."""
    m = _k() % 6
    r = records(
        t.orders, "o_orderkey", field("245", "10", ("a", F.concat(F.lit("Title "), _k(), F.lit(" /")))),
        field("773", "08", ("w", F.concat(F.lit("(DE-605)HT"), "o_custkey")), ("t", "Host"), ("q", "3 /"), when=m == 0),
        field("773", "08", ("t", "Loose"), when=m == 1), field("773", "08", ("w", F.concat(F.lit("(DE-600)"), "o_custkey")), when=m == 1), field("773", "08", ("t", "Late"), when=m == 1), field("773", "08", ("t", "Hidden"), ("9", "LOCAL"), when=m == 1),
        field("490", "0 ", ("a", "Series A"), ("a", "Sub"), ("v", "7 ;"), when=m == 2), field("490", "1 ", ("a", "Old"), when=m == 3), field("830", " 0", ("a", "<<The>> New"), ("w", "(DE-605)HT9"), ("v", "8"), when=m == 3),
        field("490", "1 ", ("a", "Kept"), when=m == 4), field("773", "08", ("w", "(DE-605)HT1"), ("t", "Journal"), when=m == 5), seven=F.when(m == 5, "a").otherwise("m"),
    )
    found = parts.containment()
    d = r.select("record_id", found["isPartOf"].alias("p"), found["containedIn"].alias("c"))
    p = d.select("record_id", F.explode("p").alias("x")).select("record_id", F.lit("isPartOf").alias("kind"), F.col("x.hasSuperordinate")[0]["id"].alias("id"), F.col("x.hasSuperordinate")[0]["label"].alias("label"), F.col("x.numbering").alias("numbering"))
    c = d.select("record_id", F.explode("c").alias("x")).select("record_id", F.lit("containedIn").alias("kind"), "x.id", "x.label", F.lit(None).cast("string").alias("numbering"))
    return p.unionByName(c)


@_query("""
    with o as (select o_orderkey as k, o_orderkey % 3 as m, 'N' || o_custkey as call_number from orders)
    select k::varchar as record_id, 'DE-1' as library, call_number, case when m = 0 then 1 else 0 end as events, case when m = 0 then '1999-01-02' end as first, case when m = 0 then 'https://d-nb.info/gnd/5' end as owner from o
    union all select k::varchar, 'DE-2', 'X 1', 2, null, null from o where m = 1
""")
def record_custody(t):
    """Owners of an item that is there, of one that isn't, and none. Item numbers end in an institution's, so that none is a bridge's."""
    m, call = _k() % 3, F.concat(F.lit("N"), "o_custkey")
    r = records(
        t.orders, "o_orderkey", field("ITM", "  ", ("a", F.concat(_k(), F.lit("6441"))), ("M", "M1"), ("w", "DE-1"), ("x", "hall"), ("v", "hall"), ("n", call)),
        field("361", "  ", ("5", "DE-1"), ("s", call), ("a", "Owner"), ("0", "(DE-588)5"), ("k", "19990102"), ("f", "Nummer 7"), when=m == 0),
        *(field("361", "  ", ("5", "DE-2"), ("s", "X 1"), ("a", a), when=m == 1) for a in ("One", "Two")),
    )
    each = r.select("record_id", F.explode(parts.with_custody(derive.items())).alias("i"))
    events = F.coalesce("i.custodialHistory", F.array().cast(each.select("i.custodialHistory").schema[0].dataType))
    first = F.try_element_at(events, F.lit(1))
    return each.select("record_id", F.col("i.currentLibrary").alias("library"), F.col("i.callNumber").alias("call_number"), F.size(events).alias("events"), first["startDate"].alias("first"), first["owner"]["id"].alias("owner"))


@_query("""
    with c as (select c_custkey::varchar as record_id, c_custkey % 3 as m, c_name as n from customer)
    select record_id, 'Cyrl' as script, 'Cyrillic' as script_label, n || ' T' as title, n || ' A' as agent, n || ' S' as subject, n || ' P' as part, n || ' L' as place from c where m < 2
    union all select record_id, 'Arab', 'Arab', n || ' AT', null, null, null, null from c where m = 1
""")
def record_other_scripts(t):
    """Titles, agents, subjects, series and places in other scripts, and fields that no field names back."""
    m, n = F.col("c_custkey") % 3, F.col("c_name")
    said = lambda tag, ind, at, x, mark="/Cyrl", when=m < 2: field("880", ind, ("6", f"{tag}-{at}{mark}"), ("a", F.concat(n, F.lit(f" {x}"))), when=when)
    own = lambda tag, ind, at: field(tag, ind, ("6", f"880-{at}"), ("a", "own"))
    r = records(
        t.customer, "c_custkey", own("245", "10", "01"), own("100", "1 ", "02"), own("650", " 0", "03"), own("490", "0 ", "04"), own("264", " 1", "05"),
        said("245", "10", "01", "T"), said("100", "1 ", "02", "A"), said("650", " 0", "03", "S"), said("490", "0 ", "04", "P"), said("264", " 1", "05", "L"),
        said("245", "10", "01", "AT", "/Arab/r", m == 1), said("245", "10", "07", "lost"), said("246", "10", "00", "loose"),
    )
    d = parts.other_scripts(r, {"Cyrl": "Cyrillic"}, THIS_YEAR).select("record_id", F.explode("alternateGraphicRepresentation").alias("x"))
    at = lambda c: F.try_element_at(F.col(f"x.record.{c}"), F.lit(1))
    return d.select(
        "record_id", F.col("x.script.id").alias("script"), F.col("x.script.label").alias("script_label"), F.col("x.record.title").alias("title"), at("contribution").alias("agent"), at("subject").alias("subject"),
        at("isPartOf")["hasSuperordinate"][0]["label"].alias("part"), at("publication")["location"][0].alias("place"),
    )


@_query("""
    with o as (select o_orderkey as k, o_orderkey % 4 as m, o_custkey as c, year(o_orderdate) as y from orders)
    select k::varchar as record_id, 'https://example.org/resources/' || k || '#!' as id, 'Order ' || k as title,
           ['Book', 'Map', 'Periodical', 'MusicalRecording'][m + 1] as kind, case when m = 3 then 'Audio-Dokument' else 'Print' end as medium, case when m = 2 and y > 2024 then null else y::varchar end as year,
           'Roe ' || c as agent, case when m < 3 then 'https://example.org/resources/HT' || c || '#!' end as part, case when k::varchar like '%7830' then 0 else 1 end::bigint as items
    from o
""")
def record_documents(t):
    """Whole target documents of all orders, and a few of their fields."""
    m = _k() % 4
    r = records(
        t.orders, "o_orderkey", field("245", "10", ("a", F.concat(F.lit("Order "), _k(), F.lit(" /")))), field("100", "1 ", ("a", F.concat(F.lit("Roe "), "o_custkey"))), field("650", " 0", ("a", "Orders")), field("264", " 1", ("a", "Bonn :"), ("c", _year())),
        field("300", "  ", ("a", "1 S.")), field("773", "08", ("w", F.concat(F.lit("(DE-605)HT"), "o_custkey")), when=m < 3), field("856", "40", ("u", F.concat(F.lit("http://x.example/"), _k())), ("z", "kostenfrei")), field("MBD", "  ", ("M", derive.NETWORK)), field("ITM", "  ", ("a", _k()), ("M", "M1"), ("w", "L1"), ("x", "h")),
        six=F.when(m == 1, "e").when(m == 3, "j").otherwise("a"), seven=F.when(m == 2, "s").otherwise("m"), f008=F.when(m == 2, fixed_field(year=_year(), at21="p")).otherwise(fixed_field(year=_year())),
    ).select("record_id", "leader", "control", "data")
    d = derive.documents(r, THIS_YEAR)
    kind = C.first(F.filter("type", lambda k: k.isin("Book", "Map", "Periodical", "MusicalRecording")))
    part = C.first(F.col("isPartOf"))["hasSuperordinate"][0]["id"]
    return d.select("record_id", "id", "title", kind.alias("kind"), C.first(F.col("medium")).alias("medium"), C.first(F.col("publication"))["startDate"].alias("year"), C.first(F.col("contribution"))["agent"]["label"].alias("agent"), part.alias("part"), F.size("hasItem").cast("long").alias("items"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
