"""Queries over documents of three levels, and their SQL: statements, diffs, schema reports, labels, ingestion.

Orders are documents, their line items nodes without ids, parts and customers nodes with ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import shared_folder
from folio.operators import graph, jobs, lookups, validate
from folio.plans.catalogue import Tables
from folio.streaming.store import Store

BASE, TERMS = "http://orders.example/", "http://terms.example/"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        _SQL[f.__name__] = sql
        return f

    return add


def documents(t: Tables) -> DataFrame:
    """``key, id, type, status, priority, customer{id,label}, items[{number,quantity,flags[],part{id,label}}], partOrder[]``."""
    iri = lambda kind, k: F.concat(F.lit(BASE + kind), F.col(k).cast("string"))
    none = F.lit(None).cast("string")
    part = lambda k: F.struct(F.concat(F.lit(BASE + "parts/"), k.cast("string")).alias("id"), none.alias("label"))
    # what is shipped is the bare columns; the nodes are made of them afterwards
    item = F.struct(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("k"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    d = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    items = F.transform("items", lambda i: F.struct(i["number"].alias("number"), i["quantity"].alias("quantity"), F.array(i["flag"], i["status"]).alias("flags"), part(i["k"]).alias("part")))
    return d.select(
        F.col("o_orderkey").alias("key"), iri("orders/", "o_orderkey").alias("id"), F.array(F.lit("Order")).alias("type"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.struct(iri("customers/", "o_custkey").alias("id"), none.alias("label")).alias("customer"), items.alias("items"),
        F.transform("items", lambda i: i["k"].cast("string")).alias("partOrder"),
    )


#: The same documents as flat rows: ``i`` is an item's place in its order, ``n`` the number of items.
_LINES = f"""
    lines as (select o_orderkey as key, '{BASE}orders/' || o_orderkey as id, o_orderstatus as status, o_orderpriority as priority,
                     '{BASE}customers/' || o_custkey as customer, l_linenumber as number, l_partkey as part_key, '{BASE}parts/' || l_partkey as part,
                     cast(l_quantity as int) as quantity, l_returnflag as flag, l_linestatus as line_status,
                     row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, cast(l_quantity as int), l_returnflag, l_linestatus) - 1 as i,
                     count(*) over (partition by o_orderkey) as n
              from orders join lineitem on o_orderkey = l_orderkey)
"""

CONTEXT = {
    "status": graph.Term(TERMS + "status"), "customer": graph.Term(TERMS + "customer"), "items": graph.Term(TERMS + "items", "@list"),
    "number": graph.Term(TERMS + "number"), "flags": graph.Term(TERMS + "flags", "@set"), "part": graph.Term(TERMS + "part"), "Order": graph.Term(TERMS + "Order"),
}
_RDF, _XSD = graph.RDF, graph.XSD


@_query(f"""
    with {_LINES},
    o as (select distinct key, id, status, customer, n from lines),
    cells as (select *, '_:b' || md5(id || '/items/cell/' || i) as cell, '_:b' || md5(id || '/items/cell/' || (i + 1)) as following, '_:b' || md5(id || '/items/' || i) as item from lines)
    select id as s, '{_RDF}type' as p, '{TERMS}Order' as o, 'iri' as kind, null::varchar as datatype from o
    union all select id, '{TERMS}status', status, 'literal', null from o
    union all select id, '{TERMS}customer', customer, 'iri', null from o
    union all select id, '{TERMS}items', cell, 'blank', null from cells where i = 0
    union all select cell, '{_RDF}first', item, 'blank', null from cells
    union all select cell, '{_RDF}rest', case when i + 1 < n then following else '{_RDF}nil' end, case when i + 1 < n then 'blank' else 'iri' end, null from cells
    union all select item, '{TERMS}number', cast(number as varchar), 'literal', '{_XSD}integer' from cells
    union all select item, '{TERMS}flags', flag, 'literal', null from cells
    union all select item, '{TERMS}flags', line_status, 'literal', null from cells
    union all select item, '{TERMS}part', part, 'iri', null from cells
""")
def document_statements(t):
    return graph.statements(documents(t), CONTEXT)


@_query(f"""
    with {_LINES},
    changed as (select *, quantity + case when flag = 'R' then 1 else 0 end as quantity2 from lines),
    a as (select key, 'items.quantity' as path, null::int as pos, cast(quantity as varchar) as value from changed
          union all select key, 'partOrder', cast(i as int), cast(part_key as varchar) from changed),
    b as (select key, 'items.quantity' as path, null::int as pos, cast(quantity2 as varchar) as value from changed
          union all select key, 'partOrder', cast(n - 1 - i as int), cast(part_key as varchar) from changed),
    d as (select key, path, pos, value, sum(x) as x from (select *, 1 as x from a union all select *, -1 from b) group by all)
    select key, path, cast(pos as varchar) as pos, value, case when x > 0 then 'old' else 'new' end as side, cast(abs(x) as bigint) as copies from d where x <> 0
""")
def document_diff(t):
    old = documents(t)
    more = lambda i: i.withField("quantity", i["quantity"] + F.array_contains(i["flags"], "R").cast("int"))
    new = old.withColumns({"items": F.reverse(F.transform("items", more)), "partOrder": F.reverse("partOrder")})
    return jobs.diff_documents(old, new, "key").withColumn("pos", F.col("pos").cast("string"))


SCHEMAS = {
    "part.json": {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "string", "format": "uri", "pattern": "/parts/[0-9]*[02468]$"}, "label": {"type": "string"}}},
}
SCHEMA = {
    "type": "object",
    "required": ["id", "status", "customer", "note"],
    "properties": {
        "status": {"enum": ["F", "O"]},
        "priority": {"type": "string", "pattern": "^[1-4]-"},
        "customer": {"type": "object", "required": ["id", "label"], "properties": {"id": {"format": "uri"}}},
        "items": {
            "type": "array", "minItems": 3, "contains": {"properties": {"flags": {"contains": {"const": "R"}}}},
            "items": {"type": "object", "additionalProperties": False, "properties": {"number": {"type": "integer", "maximum": 6}, "flags": {"type": "array"}, "part": {"$ref": "part.json"}}},
        },
        "partOrder": {"anyOf": [{"maxItems": 1}, {"uniqueItems": True, "minItems": 5}]},
    },
}


@_query(f"""
    with {_LINES},
    o as (select key, any_value(status) as status, any_value(priority) as priority, count(*) as n, count(distinct part_key) as parts, bool_or(flag = 'R' or line_status = 'R') as returned,
                 max(number) as number, bool_or(part_key % 2 = 1) as odd from lines group by key),
    broken as (select key, 'note: required' as rule from o
               union all select key, 'customer.label: required' from o
               union all select key, 'status: enum' from o where status not in ('F', 'O')
               union all select key, 'priority: pattern' from o where not regexp_matches(priority, '^[1-4]-')
               union all select key, 'items: minItems' from o where n < 3
               union all select key, 'items: contains' from o where not returned
               union all select key, 'items[]: additionalProperties' from o
               union all select key, 'items[].number: maximum' from o where number > 6
               union all select key, 'items[].part.id: pattern' from o where odd
               union all select key, 'partOrder: anyOf' from o where not (n <= 1 or (parts = n and n >= 5)))
    select rule, count(*) as records, array_to_string((list(key order by key))[1:3], ',') as examples from broken group by rule
""")
def schema_report(t):
    return validate.report(documents(t), "key", SCHEMA, SCHEMAS, 3).withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@_query(f"""
    with {_LINES}
    select key, -1 as i, customer as id, 'Customers' as label from (select distinct key, customer from lines)
    union all
    select key, cast(i as int), part, case when p_size > 25 then p_name else cast(part_key as varchar) end from lines join part on part_key = p_partkey
""")
def document_labels(t):
    part = t.part.where("p_size > 25").select(F.concat(F.lit(BASE + "parts/"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("value"))
    kinds = t.orders.select(F.lit(BASE + "customers").alias("key"), F.lit("Customers").alias("value")).distinct()
    known = t.part.select(F.concat(F.lit(BASE + "parts/"), F.col("p_partkey").cast("string")).alias("id"))
    d = lookups.label_nodes(documents(t), "key", part.unionByName(kinds))
    flat = d.select("key", F.posexplode("items.part").alias("i", "p")).select("key", "i", "p.id", "p.label").join(known, "id")
    return d.select("key", F.lit(-1).alias("i"), "customer.id", "customer.label").unionByName(flat.select("key", "i", "id", "label"))


@_query("""
    with e as (select user_id, event_id, event_type, value, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events)
    select user_id, event_id, event_type, value from e where r = 1 and event_type <> 'error'
""")
def ingest_batches(t):
    """Three batches of events, the oldest last: of each user the latest event stays, an error deletes the user."""
    e = t.events.select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("version"), (F.col("event_type") == "error").alias("deleted"), "ts")
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    store = Store(t.spark, shared_folder(t.spark), "user_id", "version", "deleted", buckets=16)
    third = (ends.b - ends.a) / 3
    cuts = [F.col("ts") > ends.b - third, (F.col("ts") > ends.a + third) & (F.col("ts") <= ends.b - third), F.col("ts") <= ends.a + third]
    for n, part in enumerate(cuts):
        store.write(e.where(part).drop("ts"), n)
    return store.read().select("user_id", "event_id", "event_type", "value")


@_query("""
    select event_id, user_id, case when value >= 50 then cast(user_id as varchar) else cast(row_number() over (partition by value >= 50 order by event_id) - 1 as varchar) end as parent_id from events where value is not null
""")
def item_numbers(t):
    """Items whose parent has no id get a running number, from 0 and without gaps, whatever the partitions."""
    e = t.events.where("value is not null").select("event_id", "user_id", F.when(F.col("value") >= 50, F.col("user_id").cast("string")).alias("parent"))
    return jobs.with_running_parents(e, "parent", ["event_id"]).select("event_id", "user_id", F.col("parent").alias("parent_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
