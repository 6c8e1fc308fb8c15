"""The registered queries against DuckDB, and operators without a query."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.operators import graph, jobs, lookups, ranking, search
from folio.plans import catalogue
from folio.plans import records
from folio.sources import writers
from folio.streaming import updates

DATA = "/root/testdata/sf0.001"
QUICK = ("facet_search", "facet_multi", "geohash_grid", "nested_vs_flat", "bm25_top", "isbn13_from_key", "linkage_join", "year_histogram", "diff_snapshots", "deletion_balance", "lookup_each", "top_type", "concordance", "triples")


def rows(df):
    d = df[sorted(df.columns)].copy()
    for c in d.columns:
        d[c] = [None if v is None or v is pd.NA or v != v else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v) for v in d[c].tolist()]
    return sorted(map(str, d.itertuples(index=False, name=None)))


SOURCES = {"catalogue": catalogue, "records": records}


@pytest.mark.parametrize("name", [("catalogue", n) for n in QUICK] + [("records", n) for n in records.queries()], ids=lambda x: x[1])
def test_against_sql(spark, name):
    source, name = SOURCES[name[0]], name[1]
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    want = con.execute(source.oracle_sql()[name]).df()
    got = source.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_a_plan(spark):
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    for name, q in catalogue.queries().items():
        assert q(spark, DATA).columns, name


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1, False), ("b", 1, False)], "id string, v int, gone boolean")
    new = spark.createDataFrame([("a", 2, False), ("b", 2, True), ("c", 1, False)], "id string, v int, gone boolean")
    once = updates.merged(base, new, "id", "v", "gone")
    assert sorted(map(tuple, once.collect())) == [("a", 2, False), ("c", 1, False)]
    assert sorted(map(tuple, updates.merged(updates.merged(base, new, "id", "v"), new, "id", "v", "gone").collect())) == sorted(map(tuple, once.collect()))


def test_stream(spark, tmp_path):
    schema = "id string, v int, t timestamp"
    for n, part in enumerate(([("a", 1, "2024-01-01 00:00:00"), ("a", 1, "2024-01-01 00:00:00")], [("a", 2, "2024-01-01 00:10:00"), ("b", 1, "2024-01-01 00:10:00")])):
        spark.createDataFrame(part, "id string, v int, t string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = updates.without_repeats(updates.feed(spark, str(tmp_path / "in"), schema), "t", ["id", "v"])
        updates.ingest(stream, str(tmp_path / "snap"), "id", "v", str(tmp_path / "cp")).awaitTermination(120)
    last = max(int(p.name[2:]) for p in (tmp_path / "snap").iterdir())
    got = spark.read.parquet(str(tmp_path / "snap" / f"v={last}")).select("id", "v").collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("b", 1)]


def test_nested_and_flat(spark):
    d = spark.createDataFrame([(1, [("x", 1), ("y", 2)]), (2, [("x", 2)])], "id int, items array<struct<k:string,v:int>>")
    conditions = (lambda i: i["k"] == "x", lambda i: i["v"] == 2)
    assert [r.id for r in d.where(search.nested(F.col("items"), *conditions)).collect()] == [2]
    assert sorted(r.id for r in d.where(search.flat(F.col("items"), *conditions)).collect()) == [1, 2]


def test_agent_and_subject(spark):
    d = spark.createDataFrame([(1, ["ro", "jo"], ["roh"], ["p1", "p2"], "1900", "1950")], "id int, l array<string>, a array<string>, i array<string>, b string, d string")
    ask = lambda q: d.where(search.agent(F.col("l"), F.col("a"), F.col("i"), F.col("b"), F.col("d"), q, "p")).count()
    assert [ask(q) for q in ("Roe, Jo (1900-1950)", "Roe, Jo (1901-)", "Roh", "Roe Roh", "1,2,AND", "1,3,AND")] == [1, 0, 1, 0, 1, 0]
    topic = lambda q: d.where(search.subject(F.col("l"), F.col("i"), q, "p")).count()
    assert [topic(q) for q in ("Jo, Roe", "1,9", "1,9,AND", "1,Roe", "9,Roe")] == [1, 1, 0, 1, 0]


def test_lookup_of_repeated_keys_and_nulls(spark):
    m = lookups.as_map(spark.createDataFrame([("a", "1"), ("a", "2"), (None, "3")], "k string, v string"), "k", "v")
    d = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert sorted((r.x or "", r.y) for r in lookups.lookup(d, "x", m, "y").collect()) == [("", None), ("a", "2"), ("b", None)]


def test_lists_as_triples(spark):
    d = spark.createDataFrame([("s", ["a", "b"])], "id string, l array<string>")
    lines = [r.value for r in graph.n_triples(graph.triples(d, "id", {}, {"l": "http://p"}), F.concat(F.lit("http://x/"), "s")).collect()]
    assert len(lines) == 5 and sum("rdf-syntax-ns#nil" in x for x in lines) == 1


def test_sinks(spark):
    d = spark.createDataFrame([("1", "x"), ("2", None)], "id string, title string")
    assert [r.value for r in writers.as_lines(d, "id").collect()] == ['{"id":"1","title":"x"}', '{"id":"2"}']
    assert [r.value for r in writers.bulk_lines(d.limit(1), "id", "i").collect()] == ['{"index":{"_index":"i","_id":"1"}}', '{"id":"1","title":"x"}']
    counts = spark.createDataFrame([("g1", 3), ("g2", 5)], "id string, uses long")
    assert [r.value for r in jobs.beacon(counts, {"FORMAT": "BEACON"}, "2024-01-31").collect()] == ["#FORMAT: BEACON", "#TIMESTAMP: 2024-01-31", "#REVISIT: 2024-03-02", "g2|5", "g1|3"]


def test_sql_functions(spark):
    from folio.functions.registry import register

    assert "isbn13" in register(spark)
    assert spark.sql("select isbn13('3161484100') as x, year_of('c. 1987?') as y, round(haversine_m(0, 0, 0, 1)) as z").first() == ("9783161484100", "1987", 111195.0)


def test_isil_order_and_envelope(spark):
    d = spark.createDataFrame([("DE-10",), ("DE-9",), ("DE-9-2",), ("DE-Sol1",)], "i string")
    assert [r.i for r in d.orderBy(*ranking.isil_order(F.col("i"))).collect()] == ["DE-9", "DE-9-2", "DE-10", "DE-Sol1"]
