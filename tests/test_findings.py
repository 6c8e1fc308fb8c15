"""What reviews found, on small tables that show it."""

import datetime

import pytest

from folio.operators import graph, jobs, lookups
from folio.plans import catalogue, records


@pytest.fixture
def orders(spark, tmp_path):
    """A folder with the orders given as key, customer and status, and with customers 1 to 4."""

    def make(*given):
        rows = [(k, c, s, datetime.datetime(1995, 1, 2), "1-URGENT") for k, c, s in given]
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
        spark.createDataFrame([(n, f"Customer {n}", 3) for n in range(1, 5)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
        return str(tmp_path)

    return make


def test_items_of_all_orders_have_custody(spark, orders):
    """Orders whose keys end like a bridge's number keep their items."""
    d = orders((17830, 1, "F"), (27830, 2, "F"), (7830, 3, "O"), (5, 4, "F"))
    got = sorted(map(tuple, records.queries()["record_custody"](spark, d).collect()), key=str)
    own = ("1999-01-02", "https://d-nb.info/gnd/5")
    assert got == [("17830", "DE-1", "N1", 0, None, None), ("17830", "DE-2", "X 1", 2, None, None), ("27830", "DE-1", "N2", 0, None, None), ("5", "DE-1", "N4", 0, None, None), ("7830", "DE-1", "N3", 1, *own)]


def test_customers_without_any_order(spark, orders):
    """An order of whatever status takes its customer out."""
    d = orders((1, 1, "F"), (2, 2, "O"), (3, 3, "P"))
    assert [r.k for r in catalogue.queries()["set_except"](spark, d).collect()] == [4]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, key", [("record_other_scripts", "c_custkey"), ("record_forms", "p_partkey"), ("record_subjects", "p_partkey")])
def test_records_are_dealt_out(spark, name, key):
    """The records of a small file are no single task's."""
    assert f"hashpartitioning({key}#" in plan(records.queries()[name](spark, "/root/testdata/sf0.001"))


def test_documents_are_compared_by_themselves(spark):
    """No task counts the values of many documents; repeated keys, repeated values and missing sides come out right."""
    old = spark.createDataFrame([(1, ["a", "a", "b"], ["x", "y"]), (1, ["c"], ["z"]), (2, ["p"], ["q"]), (4, ["same"], ["o"]), (None, ["n"], [])], "key int, bag array<string>, itemOrder array<string>")
    new = spark.createDataFrame([(1, ["b", "a", "c"], ["y", "x"]), (3, [], ["r"]), (4, ["same"], ["o"])], "key int, bag array<string>, itemOrder array<string>")
    d = jobs.diff_documents(old, new, "key")
    assert "value" not in "".join(l for l in plan(d).splitlines() if "Aggregate" in l)
    want = [
        (1, "bag", None, "a", "old", 1), (1, "itemOrder", 0, "x", "old", 1), (1, "itemOrder", 0, "y", "new", 1), (1, "itemOrder", 0, "z", "old", 1), (1, "itemOrder", 1, "x", "new", 1), (1, "itemOrder", 1, "y", "old", 1),
        (2, "bag", None, "p", "old", 1), (2, "itemOrder", 0, "q", "old", 1), (3, "itemOrder", 0, "r", "new", 1), (None, "bag", None, "n", "old", 1),
    ]
    assert sorted(map(tuple, d.collect()), key=str) == sorted(want, key=str)


def test_labels_are_found_once_an_id(spark):
    """Ids meet the label table once each, not once for each document that names them."""
    docs = spark.createDataFrame([(k, [("http://x/a", None), ("http://h/k/9", None)]) for k in range(3)], "key int, at array<struct<id:string,label:string>>")
    table = spark.createDataFrame([("http://x/a", "A"), ("http://h/k", "H")], "key string, value string")
    d = lookups.label_nodes(docs, "key", table)
    assert all("key#" not in l.split("functions=")[0] for l in plan(d).splitlines() if "min_by" in l)
    assert {tuple(x.label for x in r["at"]) for r in d.collect()} == {("A", "H")}


def test_names_of_list_nodes_are_made_once(spark):
    """One name a cell and one an item, whatever the number of mentions."""
    docs = spark.createDataFrame([("http://x/1", ["a", "b"])], "id string, at array<string>")
    d = graph.statements(docs, {"at": graph.Term("http://p/at", "@list")})
    got = d.collect()
    assert [r.p.split("/")[-1].split("#")[-1] for r in got] == ["at", "first", "rest", "first", "rest"]
    assert got[0].o == got[1].s == got[2].s and got[2].o == got[3].s == got[4].s and got[4].o.endswith("nil")
    assert plan(d).split("Generate")[1].splitlines()[0].count("md5(") <= 1


def test_lines_are_shipped_bare(spark):
    """Fields of items are made after the lines of an order have met."""
    text = plan(records.queries()["record_holders"](spark, "/root/testdata/sf0.001"))
    assert "ITM" not in "".join(l for l in text.splitlines() if "collect_list" in l)


def test_slices_are_given_back():
    """What a task held is free before its first row is out."""
    import numpy as np
    import pyarrow as pa

    from folio.llm import divergence

    held = [(pa.array(["a", "b"]), np.array([0, 1]), np.array([0, 0]), np.array([2, 1]), np.array([k, k])) for k in (1, 2, 3)]
    got = divergence._summed(held, {("de", "x"): 0}, 3)
    first = next(got)
    assert not held and first.column("n").to_pylist() == [6, 3]
