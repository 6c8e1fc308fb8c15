"""Records to documents, on small records of our own."""

import pytest
from pyspark.sql import functions as F

from folio.functions import columns as C
from folio.operators import derive
from folio.sources import readers


def field(tag, ind, *subs):
    return f'<datafield tag="{tag}" ind1="{ind[0]}" ind2="{ind[1]}">' + "".join(f'<subfield code="{c}">{v}</subfield>' for c, v in subs) + "</datafield>"


BOOK = '<record><leader>01234nam a2200289 c 4500</leader><controlfield tag="001">99001</controlfield><controlfield tag="008">990230s1998    gw            00||| ger c</controlfield>' + "".join([
    field("016", "7 ", ("a", "0123456-7"), ("2", "DE-600")),
    field("020", "  ", ("a", "3-16-148410-0 (Pb.)")),
    field("022", "0 ", ("a", "1234-567X")),
    field("024", "7 ", ("a", "nbn:de:abc:6-123"), ("2", "urn")),
    field("024", "7 ", ("a", "10.1234/abc.5"), ("2", "doi")),
    field("035", "  ", ("a", "(DE-605)HT001234567")),
    field("035", "  ", ("a", "(DE-599)GBV55")),
    field("035", "  ", ("a", "(OCoLC)777")),
    field("041", "0 ", ("a", "eng"), ("a", "und")),
    field("082", "0 ", ("a", "51/0")),
    field("084", "  ", ("a", "SK 110"), ("2", "rvk")),
    field("100", "1 ", ("a", "Roe, Jo,"), ("d", "v45-1901"), ("e", "Verfasser"), ("0", "(DE-588)118"), ("B", "GND-1")),
    field("245", "10", ("6", "880-01"), ("a", "&lt;&lt;The&gt;&gt; numbers :"), ("b", "a story /"), ("n", "2"), ("p", "Primes."), ("c", "Jo Roe")),
    field("264", " 1", ("a", "Bonn :"), ("b", "Press,"), ("c", "[ca. 1999]")),
    field("300", "  ", ("a", "12 S. :"), ("b", "Ill. ;"), ("c", "20 cm")),
    field("650", " 7", ("a", "Zahl"), ("x", "Geschichte"), ("0", "(DE-588)40"), ("2", "gnd")),
    field("689", "00", ("a", "Zahl")), field("689", "01", ("a", "Primzahl")), field("689", "10", ("a", "Kunst")),
    field("773", "08", ("a", "Whole"), ("w", "(DE-605)HT9"), ("i", "In")),
    field("880", "10", ("6", "245-01/Cyrl"), ("a", "Числа /")),
    field("GPN", "  ", ("a", "Roh, Yo"), ("B", "GND-1")),
    field("MBD", "  ", ("M", "NETWORK")), field("MBD", "  ", ("M", "LIB_A")), field("MBD", "  ", ("M", "LIB_B")),
    field("HOL", "  ", ("8", "h1"), ("M", "LIB_A")), field("HOL", "  ", ("8", "h2"), ("M", "LIB_A")),
    field("H52", "  ", ("8", "h2"), ("b", "L2"), ("c", "stack"), ("h", "C 2")),
    field("ITM", "  ", ("a", "i1"), ("H", "h1"), ("w", "L1"), ("x", "x"), ("v", "x"), ("z", "Z"), ("n", "N 1"), ("c", "C 1")),
    field("ITM", "  ", ("a", "i7830"), ("H", "h1"), ("w", "L1")),
]) + "</record>"
GONE = '<record><leader>00000nam a2200000 c 4500</leader><controlfield tag="001">99002</controlfield>' + field("DEL", "  ", ("a", "Y")) + "</record>"
BARE = '<record><leader>00000cas a2200000 c 4500</leader><controlfield tag="001">99003</controlfield><controlfield tag="008">' + f"{'700101c19959999gw':<21}{'p':<14}ger c" + "</controlfield></record>"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("marc") / "r.xml"
    path.write_text(f"<collection>{BOOK}{GONE}{BARE}</collection>", encoding="utf-8")
    d = derive.documents(readers.read_marcxml(spark, str(path)), 2024)
    return {r.record_id: r for r in d.collect()}


def test_identifiers(docs):
    assert set(docs) == {"99001", "99003"}
    b = docs["99001"]
    assert b.localId == "HT001234567" and b.gbvId == "55" and b.zdbId == "0123456-7"
    assert b.urn == ["urn:nbn:de:abc:6-123"] and b.doi == ["10.1234/abc.5"]
    assert b.isbn == ["3161484100", "9783161484100"] and b.issn == ["1234567X"] and b.oclcNumber == ["777"]


def test_titles(docs):
    b = docs["99001"]
    assert b.title == "The numbers, 2: Primes"
    assert b.otherTitleInformation == ["a story"]
    assert b.alternateGraphicRepresentation[0].title == "Числа" and b.alternateGraphicRepresentation[0].script.label == "Cyrillic"


def test_dates(docs):
    p = docs["99001"].publication[0]
    assert (p.location, p.publishedBy, p.startDate, p.endDate) == (["Bonn"], ["Press"], "1999", None)
    assert docs["99001"].describedBy.dateCreated == "1999-02-28"
    q = docs["99003"].publication[0]
    assert q.startDate == "1995" and q.endDate is None


def test_kinds(docs):
    assert docs["99001"].level == ("https://www.loc.gov/marc/bibliographic/bdleader.html#Monograph_Item", "Monograph/Item")
    # no book by its number of a serial, no volume without the mark of one
    assert (docs["99001"].type, docs["99001"].medium) == (["BibliographicResource", "Miscellaneous"], ["Print"])
    assert (docs["99003"].type, docs["99003"].medium) == (["BibliographicResource", "Periodical"], ["Print"])
    assert docs["99001"].language == ["ger", "eng"] and docs["99001"].extent == "12 S. : Ill. ; 20 cm"


def test_agents_and_subjects(docs):
    c = docs["99001"].contribution
    assert len(c) == 1 and c[0].role == "aut" and c[0].agent.label == "Roe, Jo"
    assert (c[0].agent.dateOfBirth, c[0].agent.dateOfDeath, c[0].agent.altLabel) == ("-0045", "1901", ["Roh, Yo"])
    s = docs["99001"].subject
    assert [x.label or x.notation for x in s] == ["Zahl / Geschichte", "510", "SK 110"]
    assert [x.label for x in docs["99001"].subjectChain] == ["Zahl | Primzahl", "Kunst"]
    part = docs["99001"].isPartOf[0]
    assert (part.hasSuperordinate[0].id, part.hasSuperordinate[0].label, part.note) == ("https://example.org/resources/HT9#!", "The numbers", ["In"])


def test_items(docs):
    items = docs["99001"].hasItem
    assert [(i.type[1], i.callNumber) for i in items] == [("PhysicalObject", "N 1"), ("PhysicalTitle", "C 2"), ("TitleOnly", None)]
    assert docs["99001"].holders == 1


def test_concordance_and_archive(spark, tmp_path):
    import io
    import tarfile

    path = tmp_path / "a.tar.gz"
    with tarfile.open(path, "w:gz") as tar:
        data = f"<collection>\n{BOOK}\n{BARE}</collection>".encode()
        info = tarfile.TarInfo("x.xml")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    got = readers.read_marcxml_archive(spark, str(path))
    assert {r.record_id for r in got.collect()} == {"99001", "99003"}

    agg = tmp_path / "agg.xml"
    agg.write_text('<marc:collection xmlns:marc="http://www.loc.gov/MARC21/slim">' + BOOK.replace("<", "<marc:").replace("<marc:/", "</marc:") + "</marc:collection>", encoding="utf-8")
    from folio.functions import marc as M
    from folio.operators import jobs

    r = readers.read_aggregate(spark, str(agg))
    ids = F.transform(F.filter(M.values("035??", "a"), lambda a: a.startswith("(DE-605)")), lambda a: F.regexp_replace(a, r"^\(DE-605\)", ""))
    notations = F.flatten(F.transform(M.fields("084??", where=lambda f: M.sub1(f, "2") == "rvk"), lambda f: M.sub(f, "a")))
    assert [tuple(x) for x in jobs.concordance(r, ids, notations, r"[A-Z]{2} \d+.*").collect()] == [("HT001234567", "SK 110")]


def test_lookup_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("code\tx\tlabel\na\t1\tOne\na\t2\tTwo\nb\t3\t\"q\n")
    got = {r.key: r.value for r in readers.read_lookup_tsv(spark, str(tmp_path / "m.tsv"), 0, 2, header=True).collect()}
    assert got == {"a": "Two", "b": '"q'}
    (tmp_path / "c.ttl").write_text('@prefix skos: <http://w3.org/skos#> .\n@prefix v: <https://v.example/> .\nv:N1 a skos:Concept ;\n  skos:prefLabel "Eins"@de, "One"@en .\n<https://v.example/N2> skos:prefLabel "Zwei"@de .\n')
    got = {r.key: r.value for r in readers.read_skos_labels(spark, str(tmp_path / "c.ttl"), "de").collect()}
    assert got == {"https://v.example/N1": "Eins", "https://v.example/N2": "Zwei"}


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("text,ten,thirteen", [("ISBN 978-3-16-148410-0", "316148410X", "9783161484100"), ("080442957X", "080442957X", "9780804429573"), ("979-10-90636-07-1", None, "9791090636071"), ("no number", None, None)])
def test_isbn(spark, text, ten, thirteen):
    clean = C.isbn_clean(F.lit(text))
    assert one(spark, C.isbn10(clean)) == ten and one(spark, C.isbn13(clean)) == thirteen


@pytest.mark.parametrize("a,b", [("Düsseldorf", "Duesseldorf"), ("Düsseldorf", "Dusseldorf"), ("Straße", "Strasse"), ("Café", "cafe")])
def test_folding(spark, a, b):
    assert one(spark, C.folded(F.lit(a))) == one(spark, C.folded(F.lit(b)))


def test_stems_and_stops(spark):
    assert one(spark, C.stems(F.lit("Der Düsseldorfer"))) == one(spark, C.stems(F.lit("Düsseldorf")))
    assert one(spark, C.tokens(F.lit("der die das"))) == []


def test_geohash(spark):
    assert one(spark, C.geohash(F.lit(57.64911), F.lit(10.40744), 9)) == "u4pruydqq"
    from folio.operators import search

    lat, lon = search.point("u4pruydqq")
    assert abs(lat - 57.64911) < 1e-4 and abs(lon - 10.40744) < 1e-4
    assert one(spark, search.location(F.lit(57.6491), F.lit(10.4074), "u4pruydqq"))


def test_links_forms_and_tables(spark, tmp_path):
    from folio.functions import marc as M
    from folio.operators import links

    rec = '<record><leader>00000nam a2200000 c 4500</leader><controlfield tag="001">1</controlfield>' + "".join([
        field("856", "42", ("3", "Inhaltsverzeichnis"), ("u", "http://a")), field("856", "40", ("u", "http://b"), ("z", "kostenfrei"), ("x", "Verlag"), ("x", "Volltext")),
        field("856", "40", ("u", "http://c"), ("x", "Rezension")), field("856", "40", ("u", "https://doi.org/10.1/x"), ("7", "0")),
        field("655", " 7", ("a", "Biografie"), ("0", "(DE-588)4006804-3")), field("655", " 7", ("a", "DVD-Video")), field("689", "00", ("A", "f"), ("a", "Roman")), field("689", "01", ("A", "f"), ("a", "Nichts")),
        field("084", "  ", ("a", "x1"), ("2", "reg")), field("130", "0 ", ("a", "Work"), ("p", "Part")), field("700", "12", ("a", "Roe"), ("t", "Song")),
        field("776", "08", ("t", "Other"), ("z", "3161484100")), field("776", "08", ("t", "Own"), ("z", "0-8044-2957-X")),
    ]) + "</record>"
    (tmp_path / "r.xml").write_text(rec, encoding="utf-8")
    r = readers.read_marcxml(spark, str(tmp_path / "r.xml"))
    rules = [links.Collection("c:r", "Regional", links.source_code("reg", start="x")), links.Collection("c:n", "None", links.link_contains("nowhere")), links.Collection("c:r", "Regional", links.local_mark("n", "q") | F.lit(True))]
    d = r.withColumns({**links.described_links(), "full": links.fulltext(), "forms": links.forms(), "in": links.collections(rules), **links.works(), "rel": links.related_by_isbn(F.array(F.lit("080442957X")))})
    d = links.with_form_ids(d, "record_id", "forms", readers.inline_map(spark, {"Roman": "99"}), "forms")
    d = links.with_notations(d, "record_id", readers.inline_map(spark, {"1": "SK 1, bad,QA 2"}), r"[A-Z]{2} \d", "rvk")
    places = spark.createDataFrame([("P1", "Bonn", "city", "Point(7.1 50.7)")], "key string, label string, kind string, point string")
    d = links.with_places(d.withColumn("p", F.array(F.lit("P1"), F.lit("P2"))), "record_id", "p", places, "spatial")
    d = d.withColumn("code", F.lit("38-7"))
    d = links.with_provenance(d, "code", readers.inline_map(spark, {"x": "y"}), readers.inline_map(spark, {"x": "y"}), readers.inline_map(spark, {"DE-38": "Library"}), [("ZZ.*", "XX-0")], "by")
    x = d.first()
    assert [tuple(t) for t in x.tableOfContents] == [("http://a", "Inhaltsverzeichnis")] and x.seeAlso == []
    assert [tuple(t) for t in x.full] == [("http://b", "Volltext")]
    assert [tuple(t) for t in x.forms] == [("https://d-nb.info/gnd/4006804-3", "Biografie"), ("https://d-nb.info/gnd/99", "Roman")]
    assert [t.label for t in x["in"]] == ["Regional"] and x.exampleOfWork.label == "Work. Part" and x.containsExampleOfWork[0].label == "Roe. Song"
    assert [t.label for t in x.rel] == ["Other"] and x.rvk == ["SK 1", "QA 2"]
    assert [(t.label, t.geo.lat, t.geo.lon) for t in x.spatial] == [("Bonn", 50.7, 7.1)]
    assert tuple(x.by) == ("DE-38-7", "Library: DE-38-7")
    same = r.select(links.same_as({"http://o/": (F.array(F.lit("1"), F.lit(None)), "O")}).alias("s")).first().s
    assert [tuple(t) for t in same] == [("http://o/1", "O")]
    assert M.value("130??", "a") is not None
