"""Nested documents against SQL and by hand: statements, diffs, schema rules, labels; the store; archives."""

import gzip
import io
import json
import os
import tarfile

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalogue import rows

from folio.functions import nested as N
from folio.operators import graph, jobs, lookups, validate
from folio.plans import documents
from folio.sources import readers
from folio.streaming import store as S

DATA = "/root/testdata/sf0.001"
DOC = "id string, type array<string>, title string, year int, open boolean, agent array<struct<id:string,label:string,type:array<string>,born:string>>, chain struct<label:string,part:array<struct<id:string,note:array<string>>>>, noteOrder array<string>, deep array<array<struct<id:string,x:string>>>"


@pytest.mark.parametrize("name", documents.queries())
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    want = con.execute(documents.oracle_sql()[name]).df()
    got = documents.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert rows(got) == rows(want)


def docs(spark, *given):
    fields = [f.split()[0] for f in ("id", "type", "title", "year", "open", "agent", "chain", "noteOrder", "deep")]
    return spark.createDataFrame([tuple(d.get(f) for f in fields) for d in given], DOC)


FULL = {
    "id": "http://x/1", "type": ["Book", "Unknown", "http://t/Other"], "title": 'a "b"\\\n', "year": 1999, "open": True,
    "agent": [("http://gnd.example/gnd/5", None, None, None), (None, "No id", ["Person"], "1900"), None], "chain": ("L", [("http://c/1", ["n", None]), (None, ["m"])]),
    "noteOrder": ["p", "q"], "deep": [[("http://d/1", "1")], [("http://d/2", "2"), ("http://d/3", None)]],
}
CONTEXT = {
    "Book": graph.Term("http://t/Book"), "Person": graph.Term("http://t/Person"), "title": graph.Term("http://p/title"), "year": graph.Term("http://p/year"), "open": graph.Term("http://p/open"), "agent": graph.Term("http://p/agent", "@list"),
    "label": graph.Term("http://p/label"), "born": graph.Term("http://p/born", None, graph.XSD + "gYear"), "chain": graph.Term("http://p/chain", "@set"), "part": graph.Term("http://p/part", "@list"), "note": graph.Term("http://p/note"), "noteOrder": graph.Term("http://p/see", None, "@id"),
}


def test_statements(spark):
    t = graph.statements(docs(spark, FULL, {"id": "http://x/2", "agent": [], "chain": (None, None)}, {"title": "no id"}), CONTEXT)
    got = [tuple(r) for r in t.collect()]
    assert sorted(got, key=str) == sorted((tuple(r) for r in graph.statements(docs(spark, {"id": "http://x/2", "agent": [], "chain": (None, None)}, FULL).repartition(3), CONTEXT).collect()), key=str)
    of = {}
    for s, p, o, kind, datatype in got:
        of.setdefault((s, p.replace(graph.RDF, "rdf:").replace("http://p/", "")), []).append((o, kind, datatype))
    one = "http://x/1"
    assert of[one, "rdf:type"] == [("http://t/Book", "iri", None), ("http://t/Other", "iri", None)]
    assert of[one, "title"] == [(FULL["title"], "literal", None)] and of[one, "year"] == [("1999", "literal", graph.XSD + "integer")] and of[one, "open"] == [("true", "literal", graph.XSD + "boolean")]
    assert of[one, "see"] == [("p", "iri", None), ("q", "iri", None)]
    # a list of two agents, the null left out
    (head, kind, _), = of[one, "agent"]
    assert kind == "blank" and of[head, "rdf:first"] == [("http://gnd.example/gnd/5", "iri", None)]
    (second, _, _), = of[head, "rdf:rest"]
    (person, kind, _), = of[second, "rdf:first"]
    assert kind == "blank" and of[second, "rdf:rest"] == [(graph.RDF + "nil", "iri", None)]
    assert of[person, "label"] == [("No id", "literal", None)] and of[person, "born"] == [("1900", "literal", graph.XSD + "gYear")] and of[person, "rdf:type"] == [("http://t/Person", "iri", None)]
    # three levels down
    (chain, _, _), = of[one, "chain"]
    (cell, _, _), = of[chain, "part"]
    assert of[cell, "rdf:first"] == [("http://c/1", "iri", None)] and of["http://c/1", "note"] == [("n", "literal", None)]
    # an empty list is nil, a node without anything a blank node
    assert of["http://x/2", "agent"] == [(graph.RDF + "nil", "iri", None)] and len(of["http://x/2", "chain"]) == 1
    lines = {r.value for r in graph.statement_lines(t).collect()}
    assert r'<http://x/1> <http://p/title> "a \"b\"\\\n" .' in lines and f'<http://x/1> <http://p/year> "1999"^^<{graph.XSD}integer> .' in lines and f"{head} <{graph.RDF}first> <http://gnd.example/gnd/5> ." in lines


def test_context_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"@context": {"id": "@id", "a": "http://p/a", "b": {"@id": "http://p/b", "@container": "@list", "@type": "@id"}, "c": None}}))
    assert graph.read_context(spark, str(tmp_path / "c.json")) == {"id": graph.Term("@id"), "a": graph.Term("http://p/a"), "b": graph.Term("http://p/b", "@list", "@id")}


def test_statements_of_target_documents(spark, tmp_path):
    """The documents that records become, by terms made from their own fields."""
    from test_records import BOOK

    from folio.operators import derive

    path = tmp_path / "r.xml"
    path.write_text(f"<collection>\n{BOOK}\n</collection>", encoding="utf-8")
    d = derive.documents(readers.read_marcxml(spark, str(path)), 2024)
    names = {n for p in N.paths(d.schema) for n in p}
    t = graph.statements(d, {n: graph.Term(f"http://p/{n}") for n in names})
    got = {(r.p.removeprefix("http://p/"), r.kind) for r in t.collect()}
    assert {("title", "literal"), ("publication", "blank"), ("contribution", "blank"), ("label", "literal")} <= got


def test_diff(spark):
    old, new = dict(FULL), dict(FULL)
    new["noteOrder"], new["agent"], new["deep"], new["year"] = ["q", "p"], FULL["agent"][::-1], [[("http://d/1", "1")], [("http://d/2", "2"), ("http://d/3", "9")]], None
    got = sorted((tuple(r) for r in jobs.diff_documents(docs(spark, old), docs(spark, new), "id").collect()), key=str)
    one = "http://x/1"
    assert got == sorted([(one, "deep.x", None, "9", "new", 1), (one, "year", None, "1999", "old", 1), *((one, "noteOrder", i, v, s, 1) for s, vs in (("old", "pq"), ("new", "qp")) for i, v in enumerate(vs))], key=str)
    assert jobs.diff_documents(docs(spark, old), docs(spark, old), "id").count() == 0
    # a bag counts repeats; another schema and a missing document differ by their values
    a = spark.createDataFrame([("k", ["x", "x", "y"]), ("l", ["z"])], "id string, v array<string>")
    b = spark.createDataFrame([("k", ["y", "x"], "new")], "id string, v array<string>, w string")
    assert sorted(tuple(r) for r in jobs.diff_documents(a, b, "id").select("key", "path", "value", "side", "copies").collect()) == [("k", "v", "x", "old", 1), ("k", "w", "new", "new", 1), ("l", "v", "z", "old", 1)]


def test_labels(spark):
    table = spark.createDataFrame([("http://gnd.example/gnd/5", "Agent"), ("http://c/1", ""), ("http://d/2", "Host and step"), ("http://d/3/", "no")], "key string, value string")
    got = lookups.label_nodes(docs(spark, FULL, {"id": "http://x/2"}), "id", table).orderBy("id").collect()
    first = got[0]
    assert [(a and (a.id, a.label)) for a in first.agent] == [("http://gnd.example/gnd/5", "Agent"), (None, "No id"), None]
    assert [(p.id, p.label) for p in first.chain.part] == [("http://c/1", "1"), (None, None)] and first.chain.label == "L"
    assert [[x.label for x in y] for y in first.deep] == [["1"], ["Host and step", "3"]]
    assert got[1].agent is None and got[1].chain is None and first.id == FULL["id"]
    keys = spark.createDataFrame([("http://a.b/c/d",), ("http://a.b/",), ("http://a.b",), ("urn:x",)], "i string").select("i", lookups.label_keys(F.col("i")).alias("k"), lookups.last_step(F.col("i")).alias("s"))
    assert [(r.k[1:], r.s) for r in keys.collect()] == [(["http://a.b/c"], "d"), (["http://a.b/"], "a.b"), (["http://a.b/"], "a.b"), ([], "urn:x")]


def test_numbers_without_gaps(spark):
    d = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(20)
    got = jobs.numbered(d, ["k"]).orderBy("k").collect()
    assert [r.number for r in got] == list(range(5000)) and [r.k for r in got] == sorted(r.k for r in got)
    assert jobs.numbered(d.limit(0), ["k"]).count() == 0
    items = spark.createDataFrame([("p", [("http://h/items/1#!", "x", "up")])], "id string, items array<struct<id:string,note:string,itemOf:string>>")
    r = jobs.split_items(items, "id", "items", "id", "http://context").first()
    assert r.asDict() == {"parent_id": "p", "pos": 0, "item_id": "items/1", "id": "http://h/items/1#!", "note": "x", "@context": "http://context"}


def test_schema_rules(spark, tmp_path):
    given = [
        {"id": "http://x/1", "n": 5, "kind": "a", "tags": ["x", "y"], "who": {"id": "u", "extra": 1}, "when": "2024-01-01"},
        {"id": "bad", "n": 50, "kind": "c", "tags": ["x", "x", "zz"], "who": {"id": None}, "when": "1.1.2024"},
        {"n": 5, "kind": "b", "tags": [], "more": True},
    ]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, given)))
    (tmp_path / "s").mkdir()
    (tmp_path / "s/who.json").write_text(json.dumps({"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"$ref": "#/$defs/u"}}, "$defs": {"u": {"maxLength": 3}}}))
    schema = {
        "type": "object", "required": ["id", "who", "absent"], "additionalProperties": False,
        "properties": {
            "id": {"format": "uri", "pattern": "^http"}, "n": {"type": ["integer", "null"], "maximum": 9, "minimum": 1}, "kind": {"oneOf": [{"const": "a"}, {"enum": ["a", "b"]}]}, "when": {"format": "date", "not": {"const": "2024-01-01"}},
            "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "contains": {"const": "y"}, "items": {"type": "string", "maxLength": 1, "minLength": 1}}, "who": {"$ref": "who.json"}, "absent": {},
        },
    }
    d = spark.read.json(str(tmp_path / "d.json")).withColumn("k", F.coalesce("id", F.lit("third")))
    schema["properties"]["k"] = {"allOf": [{"type": "string"}, {"minLength": 1}]}
    got = {(r.key, r.rule) for r in validate.broken_rules(d, "k", schema, validate.read_schemas(spark, str(tmp_path / "s"))).collect()}
    want = {
        "http://x/1": {"absent: required", "kind: oneOf", "when: not", "who: additionalProperties"},
        "bad": {"absent: required", "id: format", "id: pattern", "n: maximum", "kind: oneOf", "tags: uniqueItems", "tags: contains", "tags[]: maxLength", "who.id: required", "when: format"},
        "third": {"absent: required", "id: required", "who: required", "additionalProperties", "tags: minItems", "tags: contains"},
    }
    assert got == {(k, r) for k, rs in want.items() for r in rs}
    shown = {r.rule: (r.records, r.examples) for r in validate.report(d, "k", schema, validate.read_schemas(spark, str(tmp_path / "s")), 2).collect()}
    assert shown["absent: required"] == (3, ["bad", "http://x/1"]) and shown["tags: contains"] == (2, ["bad", "third"])
    assert validate.broken_rules(d, "k", {}).count() == 0
    with pytest.raises(ValueError, match="propertyNames"):
        validate.compiled({"properties": {"who": {"propertyNames": {}}}}, d.schema)


STORED = "id long, v int, title string, gone boolean"


def made(spark, *given):
    return spark.createDataFrame(list(given), STORED)


def content(df):
    return sorted(map(tuple, df.select("id", "v", "title").collect()))


def test_store(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "store"), "id", "v", "gone", buckets=8)
    assert s.read() is None
    s.write(made(spark, *((i, 1, f"t{i}", False) for i in range(400))), 0)
    s.write(made(spark, (1, 2, "new", False), (2, 2, None, True), (2, 1, "again", False), (999, 1, "x", False)), 1)
    want = sorted([(i, 1, f"t{i}") for i in range(400) if i not in (1, 2)] + [(1, 2, "new"), (999, 1, "x")])
    assert content(s.read()) == want
    assert len(content(s.read(0))) == 400  # an earlier batch is still there
    # a replay gives the same; a late old version and a late deletion change nothing
    s.write(made(spark, (1, 2, "new", False), (2, 2, None, True), (2, 1, "again", False), (999, 1, "x", False)), 1)
    s.write(made(spark, (1, 1, "old", False), (2, 1, "old", False), (3, 0, None, True)), 2)
    assert content(s.read()) == want
    # of equal versions the later batch stays, within a batch a deletion
    s.write(made(spark, (5, 1, "later", False), (6, 1, "kept", False), (6, 1, None, True)), 3)
    assert (5, 1, "later") in content(s.read()) and 6 not in {r[0] for r in content(s.read())}
    s.write(made(spark), 4)
    assert (5, 1, "later") in content(s.read())
    # columns may be added
    s.write(made(spark, (7, 9, "seven", False)).withColumn("note", F.lit("n")), 5)
    assert {(r.id, r.note) for r in s.read().where("id < 10 and id > 6").collect()} == {(7, "n"), (8, None), (9, None)}


def test_small_batches_write_little(spark, tmp_path):
    """A batch of 1 % writes about 1 % of the bytes and rewrites no bucket, until a bucket holds a quarter of news."""
    root = tmp_path / "store"
    s = S.Store(spark, str(root), "id", "v", "gone", buckets=16)
    size = lambda name: sum(f.stat().st_size for f in (root / "data" / name).rglob("*.parquet"))
    title = F.sha2(F.concat("id", F.lit(":")), 512)
    rows = lambda lo, hi, v: spark.range(lo, hi).select("id", F.lit(v).alias("v"), title.alias("title"), F.lit(False).alias("gone"))
    s.write(rows(0, 100_000, 1), 0)
    s.write(rows(500, 1500, 2), 1)
    assert size("batch=1") < 0.03 * size("batch=0") and not (root / "data/whole=1").exists()
    s.write(rows(0, 40_000, 3), 2)
    assert (root / "data/whole=2").exists()
    assert s.read().groupBy("v").count().orderBy("v").collect() == [(1, 60_000), (3, 40_000)]
    assert "Window" not in s.read()._jdf.queryExecution().executedPlan().toString()  # rewritten buckets need no merge
    gone = s.forget(1)
    assert {"batch=0", "batch=1", "batch=2"} & set(gone) and s.read().count() == 100_000


def test_a_broken_batch_is_not_seen(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "store"), "id", "v", "gone", buckets=2)
    s.write(made(spark, (1, 1, "a", False)), 0)
    s.write(made(spark, (1, 2, "b", False)), 1)
    (tmp_path / "store/manifest/batch=1/_SUCCESS").unlink()
    assert content(s.read()) == [(1, 1, "a")]
    s.write(made(spark, (1, 2, "b", False)), 1)
    assert content(s.read()) == [(1, 2, "b")]


def test_stream_of_updates_and_deletions(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "store"), "id", "v", "gone", buckets=4)
    for part in ([(1, 1, "a", False), (2, 1, "b", False)], [(1, 3, "c", False), (2, 2, None, True)], [(1, 2, "late", False), (2, 1, "late", False)]):
        made(spark, *part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(STORED).json(str(tmp_path / "in"))
        S.ingest(stream, s, str(tmp_path / "cp")).awaitTermination(180)
    assert content(s.read()) == [(1, 3, "c")]


def tar_of(members, mode="w", **more):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode, **more) as tar:
        for name, text in members:
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, tmp_path):
    record = lambda n: f'<record xmlns="m">\n  <leader>  x</leader>\n <controlfield tag="001">{n}</controlfield>\n<datafield tag="500" ind1=" " ind2=" ">\n<subfield code="a">two\n  lines {n}</subfield><subfield code="b"> </subfield>\n</datafield></record>'
    members = [(f"d/{m}.xml", "<?xml version='1.0'?>\n<collection>" + "\n".join(record(100 * m + k) for k in range(100)) + "</collection>\n") for m in range(30)]
    raw = tar_of(members)
    half = len(raw) // 3
    (tmp_path / "a.tar").write_bytes(raw)
    (tmp_path / "b.tar.gz").write_bytes(gzip.compress(raw[:half]) + gzip.compress(raw[half:]))  # blocks that cut a member
    (tmp_path / "c.tar.bz2").write_bytes(tar_of(members, "w:bz2"))
    for name in ("a.tar", "b.tar.gz", "c.tar.bz2"):
        got = readers.read_marcxml_archive(spark, str(tmp_path / name))
        ids = [r.record_id for r in got.select("record_id").collect()]
        assert sorted(map(int, ids)) == list(range(3000)), name
    one = got.where("record_id = '2042'").first()
    assert one.leader == "  x" and [(x.code, x.value) for x in one.data[0].sub] == [("a", "two\n  lines 2042"), ("b", None)]
    # a plain archive is split among tasks
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        n = spark.read.text(str(tmp_path / "a.tar"), lineSep="</record>").rdd.getNumPartitions()
        assert n > 3 and readers.read_marcxml_archive(spark, str(tmp_path / "a.tar")).count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
