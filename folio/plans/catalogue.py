"""The catalogue queries bound to the star-schema tables, and their SQL.

Orders with their line items stand for documents with nested items; customers, parts and nations for
authorities; ``documents`` for full texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import columns as C
from folio.operators import jobs, lookups, ranking, search

#: Run parameters of the exercises.
THIS_YEAR = 2000

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _count():
    return F.count(F.lit(1))


def order_documents(t: Tables) -> DataFrame:
    """Orders as documents with their line items nested, in the order of line, part and supplier."""
    item = F.struct(*(F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")))
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    docs = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    return docs.withColumn("year", F.year("o_orderdate").cast("string"))


# --- facets ------------------------------------------------------------------------------------------


@_query("""
    with d as (select distinct o_orderkey, o_orderpriority from orders
               where year(o_orderdate) between 1996 and 1998 and o_orderstatus in ('F', 'O')
                 and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity >= 40))
    select l_returnflag as term, count(distinct o_orderkey) as docs from d join lineitem on l_orderkey = o_orderkey
    group by 1 order by docs desc, term limit 100
""")
def facet_search(t):
    docs = order_documents(t)
    hit = search.every(
        search.issued(F.col("year"), "1996-1998"),
        search.values(F.array("o_orderstatus"), "F,O"),
        search.nested(F.col("items"), lambda i: i["l_returnflag"] == "R", lambda i: i["l_quantity"] >= 40),
    )
    return jobs.facet(docs.where(hit), F.col("items.l_returnflag"), 100)


@_query("select p_type as term, count(*) as docs from part group by 1 order by docs desc, term limit 5")
def facet_type(t):
    return jobs.facet(t.part, F.col("p_type"), 5)


@_query("select cast(year(o_orderdate) as varchar) as term, count(*) as docs from orders group by 1 order by docs desc, term limit 1000")
def facet_year(t):
    return jobs.facet(t.orders, F.year("o_orderdate").cast("string"), 1000)


@_query("""
    with f as (select 'status' as field, o_orderstatus as term, count(*) as docs from orders group by 2
               union all select 'priority', o_orderpriority, count(*) from orders group by 2
               union all select 'year', cast(year(o_orderdate) as varchar), count(*) from orders group by 2)
    select field, term, docs from (select *, row_number() over (partition by field order by docs desc, term) as r from f) where r <= 4
""")
def facet_multi(t):
    return jobs.facets(t.orders, {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate")}, 4)


_LAT, _LON = "(p_partkey % 1800) / 10.0 - 90 + 0.05", "(p_partkey * 7 % 3600) / 10.0 - 180 + 0.05"


@_query(f"""
    with p as (select {_LAT} as lat, {_LON} as lon from part),
    b as (select cast(floor((lon + 180) / 360 * 8192) as bigint) as x, cast(floor((lat + 90) / 180 * 4096) as bigint) as y from p),
    l as (select x, y, list_transform(range(5), lambda k: list_sum(list_transform(range(5), lambda j:
            (((case when (5 * k + j) % 2 = 0 then x >> (12 - (5 * k + j) // 2) else y >> (11 - (5 * k + j) // 2) end) & 1) << (4 - j))))) as v from b)
    select list_aggregate(list_transform(v, lambda i: substr('0123456789bcdefghjkmnpqrstuvwxyz', cast(i as bigint) + 1, 1)), 'string_agg', '') as cell,
           count(*) as docs, round(any_value((y + 0.5) * (180.0 / 4096) - 90), 6) as lat, round(any_value((x + 0.5) * (360.0 / 8192) - 180), 6) as lon
    from l group by 1
""")
def geohash_grid(t):
    p = t.part.select(F.expr(_LAT).cast("double").alias("lat"), F.expr(_LON).cast("double").alias("lon"))
    return jobs.geohash_grid(p, F.col("lat"), F.col("lon"), 5).select("cell", "docs", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


# --- searches ----------------------------------------------------------------------------------------


@_query("select o_orderkey, year(o_orderdate) as y from orders where year(o_orderdate) >= 1997")
def year_range_open(t):
    y = F.year("o_orderdate").cast("string")
    return t.orders.where(search.issued(y, "1997-*")).select("o_orderkey", F.year("o_orderdate").alias("y"))


@_query("select o_orderkey from orders where year(o_orderdate) = 1997")
def year_equality(t):
    return t.orders.where(search.issued(F.year("o_orderdate").cast("string"), "1997-")).select("o_orderkey")


@_query("select l_orderkey, count(*) as lines from lineitem where l_orderkey in (select l_orderkey from lineitem where l_returnflag in ('A', 'N')) group by 1")
def multi_value_or(t):
    d = order_documents(t).where(search.values(F.col("items.l_returnflag"), "A,N"))
    return d.select(F.col("o_orderkey").alias("l_orderkey"), F.size("items").cast("long").alias("lines"))


@_query("select l_orderkey, count(*) as lines from lineitem group by 1 having count(distinct case when l_returnflag in ('A', 'R') then l_returnflag end) = 2")
def multi_value_and(t):
    d = order_documents(t).where(search.values(F.col("items.l_returnflag"), "A,R,AND"))
    return d.select(F.col("o_orderkey").alias("l_orderkey"), F.size("items").cast("long").alias("lines"))


@_query("""
    select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity = 50) as nested,
           exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity = 50) as flat
    from orders where o_orderkey in (select l_orderkey from lineitem)
""")
def nested_vs_flat(t):
    is_r, is_50 = (lambda i: i["l_returnflag"] == "R"), (lambda i: i["l_quantity"] == 50)
    return order_documents(t).select("o_orderkey", search.nested(F.col("items"), is_r, is_50).alias("nested"), search.flat(F.col("items"), is_r, is_50).alias("flat"))


@_query(f"""
    select p_partkey from (select p_partkey, {_LAT} as lat, {_LON} as lon from part)
    where 2 * 6371008.8 * asin(sqrt(pow(sin((radians(50.95) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(50.95)) * pow(sin(radians(6.95 - lon) / 2), 2))) <= 3000000
""")
def geo_within(t):
    p = t.part.select("p_partkey", F.expr(_LAT).cast("double").alias("lat"), F.expr(_LON).cast("double").alias("lon"))
    return p.where(search.location(F.col("lat"), F.col("lon"), "50.95,6.95", 3_000_000)).select("p_partkey")


@_query(f"select p_partkey from (select p_partkey, {_LAT} as lat, {_LON} as lon from part) where lat > -30 and lat < 60 and lon > -100 and lon < 80 and lon < 80 - (lat + 30) * 2")
def polygon_within(t):
    p = t.part.select("p_partkey", F.expr(_LAT).cast("double").alias("lat"), F.expr(_LON).cast("double").alias("lon"))
    return p.where(search.location(F.col("lat"), F.col("lon"), "-30,-100 -30,80 60,-100")).select("p_partkey")


@_query("select c_custkey, c_name from customer where c_name in ('Customer#000000042', 'Customer#000000007')")
def id_normalise(t):
    name = F.col("c_name")
    return t.customer.where(search.some(search.by_id([name], "Customer# 000000042"), search.by_id([name], " Customer#000000007"))).select("c_custkey", "c_name")


@_query("select p_partkey from part where (p_name like '%small%' or lower(p_type) = 'small') and (p_name like '%ring%' or lower(p_type) = 'ring')")
def cross_field_and(t):
    fields = [C.tokens(F.col("p_name")), C.tokens(F.col("p_type"))]
    return t.part.where(search.across(fields, "Small ring")).select("p_partkey")


@_query("select p_partkey from part where regexp_matches(p_name, '(^|[^a-z])red widget([^a-z]|$)')")
def phrase_match(t):
    return t.part.where(search.phrase(C.tokens(F.col("p_name")), "Red Widget")).select("p_partkey")


@_query("select p_partkey from part where regexp_matches(p_name, '(^|[^a-z])wid') and regexp_matches(p_name, '(^|[^a-z])[a-z]e[a-z]([^a-z]|$)')")
def prefix_and_wildcard(t):
    w = C.tokens(F.col("p_name"))
    return t.part.where(search.prefix(w, "Wid") & search.wildcard(w, "?e?")).select("p_partkey")


@_query("select doc_id, length(text) as n from documents where contains(text, 'License') order by n_chars desc nulls last, doc_id limit 15 offset 30")
def page_2(t):
    hits = search.sorted_hits(t.documents.where(C.any_contain(F.array("text"), "License")), "newest", "n_chars", "doc_id")
    return search.page(hits, 30, 15).select("doc_id", F.length("text").cast("long").alias("n"))


@_query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders order by o_orderdate desc, o_orderkey limit 20")
def newest_feed(t):
    hits = search.sorted_hits(t.orders, "newest", "o_orderdate", "o_orderkey")
    return search.page(hits, 0, 20).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@_query("select 'q1' as id, (select count(*) from part where p_size = 7) as \"totalItems\", (select count(*) from (select 1 from part where p_size = 7 limit 10)) as members")
def result_envelope(t):
    hits = t.part.where("p_size = 7")
    page = search.page(search.sorted_hits(hits, "oldest", "p_retailprice", "p_partkey"), 0, 10)
    return ranking.envelope(page, hits, "q1").select("id", "totalItems", F.size("member").cast("long").alias("members"))


@_query("""
    select distinct c_name || ' | ' || c_mktsegment || case when c_acctbal >= 0 then ' | ' || case when c_custkey % 2 = 0 then '1990–1999' else '1990' end else '' end as label,
           case when c_acctbal >= 0 then 'Creditor | Customer' else 'Customer | Debtor' end as category from customer
""")
def suggest_labels(t):
    span = ranking.date_range(F.lit("1990"), F.when(F.col("c_custkey") % 2 == 0, "1999"))
    kinds = F.array(F.lit("Resource"), F.when(F.col("c_acctbal") >= 0, "Creditor").otherwise("Debtor"), F.lit("Customer"))
    label, category = ranking.suggestion([F.col("c_name"), F.col("c_mktsegment"), F.when(F.col("c_acctbal") >= 0, span)], kinds, "Resource")
    return t.customer.select(label.alias("label"), category.alias("category")).distinct()


@_query("""
    with f as (select o_orderpriority as term, count(*) as docs from orders group by 1)
    select term, docs, row_number() over (order by term in ('3-MEDIUM') desc, docs desc, term) as place from f
""")
def facet_display(t):
    f = ranking.facet_order(jobs.facet(t.orders, F.col("o_orderpriority"), 100), ["3-MEDIUM"], by_label=False)
    shown = Window.orderBy((F.col("term") == "3-MEDIUM").desc(), F.desc("docs"), "term")  # a facet is a short list
    return f.withColumn("place", F.row_number().over(shown))


@_query("""
    select s_suppkey, cast(regexp_replace(substr(s_name, 10), '[^0-9]', '9', 'g') as bigint) as main from supplier
""")
def isil_sort(t):
    d = t.supplier.withColumn("isil", F.concat(F.lit("DE-"), F.substring("s_name", 10, 20)))
    main, sub = ranking.isil_order(F.col("isil"))
    return d.withColumn("main", main).orderBy("main", sub, "s_suppkey").select("s_suppkey", "main")


# --- text --------------------------------------------------------------------------------------------

_WORDS_SQL = "list_filter(regexp_split_to_array(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'ä|ae', 'a', 'g'), 'ö|oe', 'o', 'g'), 'ü|ue', 'u', 'g'), 'ß', 'ss', 'g'), 'àáâãåçèéêëìíîïñòóôõùúûýÿ', 'aaaaaceeeeiiiinoooouuuyy'), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@_query(f"""
    with w as (select doc_id, unnest({_WORDS_SQL}) as token from documents)
    select token, count(distinct doc_id) as df, count(*) as tf from w group by 1
""")
def token_df(t):
    return ranking.token_frequencies(t.documents, F.col("text"))


@_query(f"""
    with d as (select doc_id, {_WORDS_SQL} as w from documents),
    c as (select doc_id, len(w) as len, len(list_filter(w, lambda x: x = 'trash')) as t0, len(list_filter(w, lambda x: x = 'license')) as t1 from d where len(w) > 0),
    s as (select count(*) as n, avg(len) as avg_len, count_if(t0 > 0) as d0, count_if(t1 > 0) as d1 from c)
    select doc_id as key, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * len / avg_len))
           + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len / avg_len)), 6) as score
    from c, s where t0 > 0 or t1 > 0 order by score desc, key limit 50
""")
def bm25_top(t):
    scored = ranking.bm25(t.documents, "doc_id", F.col("text"), ["trash", "license"])
    return scored.select("key", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "key").limit(50)


@_query("select doc_id from documents where regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])(über|ueber|uber)([^\\p{L}\\p{N}]|$)') or regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])license([^\\p{L}\\p{N}]|$)')")
def text_fold_match(t):
    w = C.tokens(F.col("text"))
    return t.documents.where(search.some(search.any_term(w, "Über"), search.any_term(w, "Ueber"), search.all_terms(w, "LICENSE"))).select("doc_id")


@_query(f"""
    with w as (select distinct unnest({_WORDS_SQL}) as word from documents)
    select word, regexp_replace(word, '^(.{{4,}}?)(erinnen|ern|em|en|er|es|e|s|n)$', '\\1') as stem from w
""")
def stem_words(t):
    w = t.documents.select(F.explode(C.tokens(F.col("text"), ())).alias("word")).distinct()
    return w.select("word", C.stemmed(F.col("word")).alias("stem"))


# --- value-level verbs -------------------------------------------------------------------------------


@_query("select c_custkey, nullif(trim(case when c_acctbal < 0 then '' else c_mktsegment end), '') as segment from customer where c_acctbal is not null")
def vacuum_nulls(t):
    return t.customer.select("c_custkey", C.present(F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment"))).alias("segment"))


@_query("select p_partkey, regexp_replace(regexp_replace('<<' || p_name || '>> /', '\\s?[,.:;/=]?$', ''), '<<|>>', '', 'g') as title from part")
def clean_title(t):
    return t.part.select("p_partkey", C.replace_all(F.concat(F.lit("<<"), "p_name", F.lit(">> /")), (r"\s?[,.:;/=]?$", ""), ("<<|>>", "")).alias("title"))


@_query("select s_suppkey, coalesce(n_name, cast(s_nationkey as varchar)) as label from supplier left join (select * from nation where n_regionkey <> 2) on s_nationkey = n_nationkey")
def lookup_keep(t):
    m = lookups.as_map(t.nation.where("n_regionkey <> 2").withColumn("k", F.col("n_nationkey").cast("string")), "k", "n_name")
    return lookups.lookup(t.supplier.withColumn("k", F.col("s_nationkey").cast("string")), "k", m, "label", keep=True).select("s_suppkey", "label")


@_query("select s_suppkey, n_name as label from supplier join nation on s_nationkey = n_nationkey where n_regionkey <> 2")
def lookup_delete(t):
    m = lookups.as_map(t.nation.where("n_regionkey <> 2"), "n_nationkey", "n_name")
    return lookups.lookup(t.supplier, "s_nationkey", m, "label").where("label is not null").select("s_suppkey", "label")


@_query("""
    select o_orderkey, string_agg(n, '|' order by pos) as names from (
      select o_orderkey, pos, case k when 0 then p_type else p_brand end as n from (
        select o_orderkey, o_orderkey % 1000 as pk, unnest([0, 1]) as k, unnest([1, 2]) as pos from orders) join part on p_partkey = pk) group by 1
""")
def lookup_each(t):
    m = t.part.select(F.explode(F.create_map(F.concat(F.lit("t"), "p_partkey"), "p_type", F.concat(F.lit("b"), "p_partkey"), "p_brand")))
    d = t.orders.select("o_orderkey", F.array(F.concat(F.lit("t"), F.col("o_orderkey") % 1000), F.concat(F.lit("b"), F.col("o_orderkey") % 1000)).alias("keys"))
    out = lookups.lookup_each(d, "o_orderkey", "keys", m, "names")
    return out.where(F.size("names") > 0).select("o_orderkey", F.array_join("names", "|").alias("names"))


@_query("select c_custkey, case when c_nationkey = 1 then c_name else c_name || ' (' || c_nationkey || ')' end as label from customer")
def paste_label(t):
    extra = F.when(F.col("c_nationkey") != 1, F.concat(F.lit("("), "c_nationkey", F.lit(")")))
    return t.customer.select("c_custkey", C.paste(F.col("c_name"), extra).alias("label"))


@_query("select l_orderkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags from lineitem group by 1")
def join_sorted(t):
    return t.lineitem.groupBy("l_orderkey").agg(C.joined(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@_query("select o_orderkey, len(list_distinct(list(l_returnflag))) as n from orders join lineitem on l_orderkey = o_orderkey group by 1")
def uniq_flags(t):
    return order_documents(t).select("o_orderkey", F.size(C.uniq(F.col("items.l_returnflag"))).cast("long").alias("n"))


@_query("select l_orderkey, count(distinct l_suppkey) as holders from lineitem group by 1")
def count_holders(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("holders"))


@_query("select p_partkey, 'https://example.org/brand/' || p_brand as iri from part")
def iri_prefix(t):
    return t.part.select("p_partkey", C.prefixed(F.col("p_brand"), "https://example.org/brand/").alias("iri"))


@_query("select c_custkey, upper(substr(c_mktsegment, 3, 4)) as code from customer")
def fixed_pos(t):
    return t.customer.select("c_custkey", F.upper(C.fixed(F.col("c_mktsegment"), 2, 4)).alias("code"))


_STEM = "'978' || lpad(cast(p_partkey as varchar), 9, '0')"


@_query(f"""
    with s as (select p_partkey, {_STEM} as s from part),
    c as (select p_partkey, s, list_sum(list_transform(range(1, 13), lambda i: cast(substr(s, i, 1) as int) * (case when i % 2 = 0 then 3 else 1 end))) as c13,
          list_sum(list_transform(range(1, 10), lambda i: cast(substr(s, i + 3, 1) as int) * (11 - i))) as c10 from s)
    select p_partkey, s || cast((10 - cast(c13 as int) % 10) % 10 as varchar) as isbn13,
           substr(s, 4) || case (11 - cast(c10 as int) % 11) % 11 when 10 then 'X' else cast((11 - cast(c10 as int) % 11) % 11 as varchar) end as isbn10 from c
""")
def isbn13_from_key(t):
    stem = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    ten = C.isbn10(F.concat(stem, F.lit("0")))
    thirteen = C.isbn13(C.isbn_clean(F.concat(F.lit("ISBN "), F.substring(ten, 1, 1), F.lit("-"), F.substring(ten, 2, 9), F.lit(" (pbk.)"))))
    return t.part.select("p_partkey", thirteen.alias("isbn13"), C.isbn10(thirteen).alias("isbn10"))


@_query("select p_partkey, replace(p_name, ' ', '%20') || '%3A' as uri from part")
def uri_encode(t):
    return t.part.select("p_partkey", C.uri_encoded(F.concat("p_name", F.lit(":"))).alias("uri"))


@_query("select o_orderkey, cast(year(o_orderdate) - 9 as varchar) as y from orders")
def minus_years(t):
    return t.orders.select("o_orderkey", C.minus(F.year("o_orderdate").cast("string"), 9).alias("y"))


@_query("select o_orderkey, bool_or(regexp_full_match(l_returnflag, '[AR]')) as some, bool_and(regexp_full_match(l_returnflag, '[AR]')) as every from orders join lineitem on l_orderkey = o_orderkey group by 1")
def any_match_rule(t):
    f = F.col("items.l_returnflag")
    return order_documents(t).select("o_orderkey", C.any_match(f, "[AR]").alias("some"), C.all_match(f, "[AR]").alias("every"))


@_query("select doc_id from documents where contains(text, 'trash')")
def any_contain(t):
    return t.documents.where(C.any_contain(F.array("text"), "trash")).select("doc_id")


@_query("select p_partkey, p_size > 25 as has, coalesce(p_brand, '') = '' as bare from part")
def presence_flags(t):
    return t.part.select("p_partkey", search.exists(F.when(F.col("p_size") > 25, F.lit("x"))).alias("has"), C.is_empty(F.col("p_brand")).alias("bare"))


@_query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_suppkey in (1, 5, 9))")
def in_list(t):
    keys = F.array(*(F.lit(k).cast("long") for k in (1, 5, 9)))
    return order_documents(t).where(C.occurs_in(F.col("items.l_suppkey"), keys)).select("o_orderkey")


@_query("select o_orderkey from orders where year(o_orderdate) > 1995 and year(o_orderdate) < 1998")
def year_window(t):
    y = F.year("o_orderdate").cast("string")
    return t.orders.where(C.greater_than(y, 1995) & C.less_than(y, 1998)).select("o_orderkey")


@_query("select p_partkey, case when p_type = 'ECONOMY' then 'cheap' when p_size > 40 then 'large' when p_size > 20 then 'medium' else 'other' end as kind from part")
def first_rule_wins(t):
    size = F.col("p_size")
    return t.part.select("p_partkey", C.first_of([(F.col("p_type") == "ECONOMY", "cheap"), (size > 40, "large"), (size > 20, "medium")], "other").alias("kind"))


@_query("select o_orderkey, sum(case when l_returnflag = 'N' then l_quantity * 2 else 0 end) as n from orders join lineitem on l_orderkey = o_orderkey group by 1")
def nested_transform(t):
    doubled = F.transform(F.filter("items", lambda i: i["l_returnflag"] == "N"), lambda i: i["l_quantity"] * 2)
    return order_documents(t).select("o_orderkey", F.aggregate(doubled, F.lit(0.0), lambda a, x: a + x).alias("n"))


@_query("select c_custkey, i, case i when 1 then c_name when 2 then 'b' end as a, case i when 1 then 'x' when 2 then 'y' when 3 then 'z' end as b from customer, (select unnest([1, 2, 3]) as i)")
def zip_lists(t):
    z = C.zipped(a=F.array("c_name", F.lit("b")), b=F.array(*map(F.lit, "xyz")))
    return t.customer.select("c_custkey", F.posexplode(z).alias("i", "z")).select("c_custkey", (F.col("i") + 1).alias("i"), "z.a", "z.b")


@_query("select c_custkey from customer where not (c_acctbal < 0 or c_mktsegment = 'BUILDING')")
def reject_flagged(t):
    return t.customer.where(~((F.col("c_acctbal") < 0) | C.any_equal(F.array("c_mktsegment"), "BUILDING"))).select("c_custkey")


@_query("""
    select l_orderkey as o_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) as first_part, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey)) as last_part from lineitem
    where l_orderkey in (select o_orderkey from orders) group by 1
""")
def first_last(t):
    p = F.col("items.l_partkey")
    return order_documents(t).select("o_orderkey", C.first(p).alias("first_part"), C.last(p).alias("last_part"))


@_query("select o_orderkey, case o_orderpriority when '1-URGENT' then 'dringend' when '2-HIGH' then 'hoch' else o_orderpriority end as label from orders")
def case_map(t):
    return t.orders.select("o_orderkey", C.mapped(F.col("o_orderpriority"), {"1-URGENT": "dringend", "2-HIGH": "hoch"}, keep=True).alias("label"))


@_query("select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def json_column(t):
    return t.events.select("event_id", F.from_json(F.regexp_replace("props", '""', '"'), "k int")["k"].alias("k"))


# --- cores of the derivations ------------------------------------------------------------------------


@_query("select s_suppkey, coalesce(case when n_regionkey = 0 then 'N-' || n_name end, case when s_suppkey % 2 = 0 then 'S-' || s_name end, 'K-' || s_suppkey) as id from supplier join nation on s_nationkey = n_nationkey")
def agency_fallback(t):
    j = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select("s_suppkey", F.coalesce(F.when(F.col("n_regionkey") == 0, C.prefixed(F.col("n_name"), "N-")), F.when(F.col("s_suppkey") % 2 == 0, C.prefixed(F.col("s_name"), "S-")), C.prefixed(F.col("s_suppkey").cast("string"), "K-")).alias("id"))


@_query("""
    select a.l_orderkey as o_orderkey, count(*) as links, sum(b.l_linenumber)::bigint as n from lineitem a join lineitem b
    on a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey and a.l_returnflag = 'N' and b.l_returnflag = 'R'
    where a.l_orderkey in (select o_orderkey from orders) group by 1
""")
def linkage_join(t):
    links = F.flatten(F.transform(F.filter("items", lambda i: i["l_returnflag"] == "N"), lambda i: F.filter("items", lambda r: (r["l_returnflag"] == "R") & (r["l_suppkey"] == i["l_suppkey"]))))
    d = order_documents(t).withColumn("links", links).where(F.size("links") > 0)
    return d.select("o_orderkey", F.size("links").cast("long").alias("links"), F.aggregate("links", F.lit(0).cast("long"), lambda a, x: a + x["l_linenumber"]).alias("n"))


@_query(f"select o_orderkey, case when year(o_orderdate) + 2 > {THIS_YEAR} and year(o_orderdate) <= {THIS_YEAR} then year(o_orderdate) else year(o_orderdate) + 2 end::varchar as y from orders")
def year_clean(t):
    y = F.year("o_orderdate")
    text = F.concat(F.lit("[ca. "), (y + 2).cast("string"), F.lit("?]"))
    return t.orders.select("o_orderkey", C.year_or_guess(text, y.cast("string"), THIS_YEAR).alias("y"))


@_query("""
    with d as (select o_orderkey, 1796 + o_orderkey % 9 as y, 1 + o_orderkey % 12 as m, 28 + o_orderkey % 4 as d from orders)
    select o_orderkey, printf('%04d-%02d-%02d', y, m, case
      when m = 2 and d = 29 and not (y >= 1800 and (y % 4 = 0 and y % 100 <> 0 or y % 400 = 0)) then 28 when m = 2 and d > 29 then 28
      when m in (4, 6, 9, 11) and d = 31 then 30 else d end) as day from d
""")
def date_repair(t):
    k = F.col("o_orderkey")
    raw = F.format_string("%04d-%02d-%02d", 1796 + k % 9, 1 + k % 12, 28 + k % 4)
    return t.orders.select("o_orderkey", C.repaired_date(raw).alias("day"))


@_query("""
    select p_partkey, unnest(list_filter([case when p_type in ('ECONOMY', 'PROMO') then 'Cheap' end, case when contains(p_name, 'ring') then 'Jewel' when contains(p_name, 'widget') then 'Device' end,
      case when p_size > 40 then 'Large' end], lambda x: x is not null)) as kind from part
""")
def rule_chain_type(t):
    name = F.col("p_name")
    chains = F.array(
        F.when(C.any_match(F.array("p_type"), "ECONOMY|PROMO"), F.lit("Cheap")),
        C.first_of([(name.contains("ring"), "Jewel"), (name.contains("widget"), "Device")]),
        F.when(F.col("p_size") > 40, F.lit("Large")),
    )
    return t.part.select("p_partkey", F.explode(F.array_compact(chains)).alias("kind"))


@_query("select l_orderkey as o_orderkey, string_agg(cast(l_partkey as varchar), ' | ' order by l_linenumber, l_partkey, l_suppkey) as chain from lineitem where l_orderkey in (select o_orderkey from orders) group by 1")
def chain_components(t):
    return order_documents(t).select("o_orderkey", F.array_join("items.l_partkey", " | ").alias("chain"))


@_query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def anti_members(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@_query("select s_suppkey from supplier join nation on s_nationkey = n_nationkey where not (n_regionkey = 1 and n_nationkey in (1, 6)) and n_regionkey <> 3")
def anti_two_level(t):
    d = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    fine, coarse = t.nation.where("n_regionkey = 1 and n_nationkey in (1, 6)"), t.nation.where("n_regionkey = 3")
    return lookups.without_suppressed(d, fine, coarse, ["n_regionkey", "n_nationkey"], ["n_regionkey"]).select("s_suppkey")


@_query("""
    with c as (select c_custkey as k, c_name from customer where c_custkey % 3 <> 0), o as (select o_custkey as k, count(*) as n from orders group by 1)
    select coalesce(c.k, o.k) as k, c_name, n, case when c.k is null then 'created' when o.k is null then 'plain' else 'matched' end as origin from c full join o on c.k = o.k
""")
def match_or_create(t):
    items = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), "c_name")
    return jobs.match_or_create(items, t.orders.groupBy(F.col("o_custkey").alias("k")).agg(_count().alias("n")), ["k"])


@_query("select l_partkey, count(distinct l_suppkey) as holders from lineitem group by 1 having holders between 1 and 25")
def holder_count(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("holders")).where("holders between 1 and 25")


@_query("""
    select p_partkey from part join lineitem on l_partkey = p_partkey where p_type in ('ECONOMY', 'PROMO') group by 1
    having count(distinct l_suppkey) <= 28 and max(year(l_shipdate)) > 1851 and min(year(l_shipdate)) < 2000 - 2
""")
def last_copies(t):
    g = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_suppkey").alias("holders"), F.min(F.year("l_shipdate")).alias("a"), F.max(F.year("l_shipdate")).alias("b"))
    d = t.part.join(g, "p_partkey")
    wanted = search.every(F.col("holders").between(1, 28), F.col("b") > 1851, C.less_than(F.col("a").cast("string"), THIS_YEAR - 2), search.values(F.array("p_type"), "ECONOMY,PROMO"))
    return d.where(wanted).select("p_partkey")


@_query("""
    select distinct o_orderkey, unnest(list_filter([case when o_orderstatus = 'F' then 'Closed' end, case when o_totalprice > 300000 then 'Large' end, case when year(o_orderdate) < 1995 then 'Old' end, case when o_orderstatus in ('F', 'P') then 'Closed' end], lambda x: x is not null)) as collection from orders
""")
def membership_rules(t):
    s = F.col("o_orderstatus")
    labels = C.labels_of([(s == "F", "Closed"), (F.col("o_totalprice") > 300000, "Large"), (F.year("o_orderdate") < 1995, "Old"), (s.isin("F", "P"), "Closed")])
    return t.orders.select("o_orderkey", F.explode(C.uniq(labels)).alias("collection"))


@_query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, role from (select *, unnest(string_split(case when l_returnflag = 'A' then 'aut,edt' else 'ctb' end, ',')) as role from lineitem)")
def role_expand(t):
    codes = F.split(F.when(F.col("l_returnflag") == "A", "aut,edt").otherwise("ctb"), ",")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(codes).alias("role"))


@_query("select c_custkey, case when c_custkey % 5 = 0 then '-' || lpad(cast(c_custkey % 900 as varchar), 4, '0') else lpad(cast(c_custkey % 2000 as varchar), 4, '0') end as born, case when c_custkey % 2 = 0 then lpad(cast(c_custkey % 2000 as varchar), 4, '0') end as died from customer")
def life_dates(t):
    k = F.col("c_custkey")
    born = F.when(k % 5 == 0, F.concat(F.lit("v"), (k % 900).cast("string"))).otherwise((k % 2000).cast("string"))
    a, b = C.life_dates(F.concat(born, F.lit("-"), F.when(k % 2 == 0, (k % 2000).cast("string")).otherwise("")))
    return t.customer.select("c_custkey", a.alias("born"), b.alias("died"))


@_query("select s_suppkey, 'https://opac.example.org/' || n_name || '?id=' || s_suppkey as link from supplier join nation on s_nationkey = n_nationkey")
def template_iri(t):
    d = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("template", F.concat(F.lit("https://opac.example.org/"), "n_name", F.lit("?id={id}")))
    return d.select("s_suppkey", F.replace(F.col("template"), F.lit("{id}"), F.col("s_suppkey").cast("string")).alias("link"))


@_query("select c_custkey, case when c_nationkey < 10 then n_name when c_nationkey < 20 then r_name else cast(c_nationkey as varchar) end as label from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def fallback_label(t):
    second = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey < 20")
    key = F.col("n_nationkey").cast("string")
    tables = [lookups.as_map(t.nation.where("n_nationkey < 10").withColumn("k", key), "k", "n_name"), lookups.as_map(second.withColumn("k", key), "k", "r_name")]
    return lookups.resolved(t.customer.withColumn("k", F.col("c_nationkey").cast("string")), "k", tables, "label").select("c_custkey", "label")


@_query("select c_custkey, case when n_nationkey < 5 then n_name else coalesce(r_name || ': ', '') || cast(n_nationkey as varchar) end as label from customer join nation on c_nationkey = n_nationkey left join (select * from region where r_regionkey <> 2) on n_regionkey = r_regionkey")
def parent_fallback(t):
    own = lookups.as_map(t.nation.where("n_nationkey < 5").withColumn("k", F.col("n_nationkey").cast("string")), "k", "n_name")
    up = lookups.as_map(t.region.where("r_regionkey <> 2").withColumn("k", F.concat(F.lit("r"), "r_regionkey")), "k", "r_name")
    d = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey", F.col("n_nationkey").cast("string").alias("k"))
    return lookups.with_parent(d, "k", F.concat(F.lit("r"), "n_regionkey"), own.unionByName(up), "label").select("c_custkey", "label")


# --- whole-catalogue jobs ----------------------------------------------------------------------------


@_query("select o_custkey as id, count(*) as uses from (select o_custkey from orders union all select o_custkey from orders where o_orderdate >= timestamp '1998-01-01') group by 1")
def beacon_counts(t):
    # the full dump, and what was updated since
    return jobs.usage_counts([t.orders, t.orders.where("o_orderdate >= timestamp '1998-01-01'")], "o_custkey")


@_query("""
    with y as (select year(l_shipdate) as year, count(*) as docs from lineitem where l_shipdate is not null and year(l_shipdate) between 1 and 2000 group by 1)
    select s.year, coalesce(docs, 0) as docs from (select cast(unnest(range((select min(year) from y), (select max(year) from y) + 1)) as int) as year) s left join y on s.year = y.year
""")
def year_histogram(t):
    return jobs.year_histogram(t.lineitem, F.year("l_shipdate"), THIS_YEAR)


@_query("select o_orderkey, s_nationkey, count(*) as items from orders join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey group by 1, 2")
def items_by_owner(t):
    flat = jobs.split_items(order_documents(t), "o_orderkey", "items", "l_linenumber")
    return flat.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("parent_id").alias("o_orderkey"), "s_nationkey").agg(_count().alias("items"))


@_query("""
    with g as (select l_orderkey, list_sort(list_distinct(list(p_brand) filter (p_brand like 'Brand#1%'))) as b, list_distinct(list(l_suppkey)) as s from lineitem join part on p_partkey = l_partkey group by 1)
    select l_orderkey, unnest(s) as id, array_to_string(b, ',') as notations from g where len(b) > 0
""")
def concordance(t):
    g = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("b"), F.collect_set("l_suppkey").alias("s"))
    ids = F.transform("s", lambda s: F.struct("l_orderkey", s.alias("id")))
    return jobs.concordance(g, ids, F.col("b"), r"Brand#1\d?").select("id.l_orderkey", "id.id", "notations")


@_query("select 'docs' as \"check\", count(*)::double as value, 100.0::double as least, count(*) > 100 as passed from orders union all select 'urgent', count_if(o_orderpriority = '1-URGENT')::double, 1e9::double, count_if(o_orderpriority = '1-URGENT') > 1e9 from orders")
def sanity_checks(t):
    return jobs.sanity_checks(t.orders, {"docs": (_count(), 100), "urgent": (F.count_if(F.col("o_orderpriority") == "1-URGENT"), 1e9)})


@_query("select count(*) as records, count(*) >= 20 as enough, count_if(c_custkey = 7) = 1 as sentinel from customer")
def guard_counts(t):
    from folio.sources.readers import guarded

    return guarded(t.customer, least=20, sentinel=F.col("c_custkey") == 7)


@_query("""
    with o as (select count(*) as gone from orders where o_orderkey % 50 = 0 or o_orderkey % 7 = 0), d as (select count(*) as deletions from orders where o_orderkey % 7 = 0)
    select gone, deletions, gone - deletions - ((deletions + 1) // 50 + 10) as excess, gone - deletions - ((deletions + 1) // 50 + 10) <= 0 as passed from o, d
""")
def deletion_balance(t):
    return jobs.deletion_balance(t.orders, t.orders.where("o_orderkey % 50 <> 0 and o_orderkey % 7 <> 0"), t.orders.where("o_orderkey % 7 = 0"), "o_orderkey")


@_query("select l_orderkey, count(distinct l_returnflag) as n_ids, min(l_returnflag) as first_id from lineitem group by 1 having n_ids > 1")
def multi_id(t):
    return jobs.repeated_ids(t.lineitem, "l_orderkey", "l_returnflag")


@_query("""
    select rule, count(*) as records from (select unnest(list_filter([case when not o_orderstatus in ('F', 'O') then 'status' end, case when not o_totalprice between 1000 and 400000 then 'price' end,
      case when not regexp_full_match(o_orderpriority, '[1-4]-.*') then 'priority' end], lambda x: x is not null)) as rule from orders) group by 1
""")
def validate_rows(t):
    return jobs.violations(t.orders, {"status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice").between(1000, 400000), "priority": C.any_match(F.array("o_orderpriority"), "[1-4]-.*")})


@_query("""
    with a as (select c_custkey as key, 'segment' as path, c_mktsegment as value from customer union all select c_custkey, 'nation', cast(c_nationkey as varchar) from customer),
    b as (select c_custkey as key, 'segment' as path, case when c_custkey % 10 = 0 then 'NEW' else c_mktsegment end as value from customer where c_custkey % 97 <> 0
          union all select c_custkey, 'nation', cast(c_nationkey as varchar) from customer where c_custkey % 97 <> 0)
    select *, 'old' as side from (select * from a except all select * from b) union all select *, 'new' from (select * from b except all select * from a)
""")
def diff_snapshots(t):
    old = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    new = old.where("c_custkey % 97 <> 0").withColumn("segment", F.when(F.col("c_custkey") % 10 == 0, "NEW").otherwise(F.col("segment")))
    return jobs.diff(old, new, "c_custkey", ["segment", "nation"])


@_query("select user_id, count(*) as errors, min(event_id) as first_error from events where event_type = 'error' group by 1")
def event_errors(t):
    errors = F.when(F.col("event_type") == "error", F.array("event_type")).otherwise(F.array().cast("array<string>"))
    return t.events.withColumn("_errors", errors).select("user_id", "event_id", F.explode("_errors").alias("e")).groupBy("user_id").agg(_count().alias("errors"), F.min("event_id").alias("first_error"))


@_query("select o_orderkey, coalesce(c_name, cast(o_custkey as varchar)) as label from orders left join (select * from customer where c_custkey % 4 <> 0) on o_custkey = c_custkey")
def resolve_labels(t):
    m = lookups.as_map(t.customer.where("c_custkey % 4 <> 0").withColumn("k", F.col("c_custkey").cast("string")), "k", "c_name")
    return lookups.resolved(t.orders.withColumn("k", F.col("o_custkey").cast("string")), "k", [m], "label").select("o_orderkey", "label")


@_query("select o_custkey, arg_min(o_orderpriority, o_orderkey) as label from orders group by 1")
def label_from_usage(t):
    return jobs.label_from_usage(t.orders, "o_custkey", "o_orderpriority", "o_orderkey")


@_query("""
    select l_suppkey, arg_max(p_type, (p_type <> 'STANDARD', r, p_type)) as top from (select distinct l_suppkey, p_type, length(p_type) as r from lineitem join part on p_partkey = l_partkey where p_type <> 'PROMO') group by 1
""")
def top_type(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    ranks = t.part.where("p_type <> 'PROMO'").select(F.col("p_type").alias("key"), F.length("p_type").alias("value")).distinct()
    return jobs.most_specific(d, "l_suppkey", "p_type", ranks, "STANDARD")


@_query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def upsert_latest(t):
    return jobs.latest(t.events, "user_id", "ts", "event_id").select("event_id", "user_id", "event_type")


@_query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r > 3")
def keep_last_n(t):
    return jobs.keep_last(t.orders, "o_custkey", 3, "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@_query("select o_orderkey from orders where o_orderdate::date > date '1998-06-01'")
def updates_since(t):
    return jobs.updates_since(t.orders, "1998-06-01", "o_orderdate").select("o_orderkey")


@_query("select year(o_orderdate) as year, count(*) as docs from orders group by 1")
def period_counts(t):
    return jobs.period_counts(t.orders, "o_orderdate")


@_query("select l_orderkey as parent_id, count(*) as items, sum(l_partkey)::bigint as parts from lineitem where l_orderkey in (select o_orderkey from orders) group by 1")
def split_lines(t):
    return jobs.split_items(order_documents(t), "o_orderkey", "items", "l_linenumber").groupBy("parent_id").agg(_count().alias("items"), F.sum("l_partkey").alias("parts"))


@_query("select o_custkey as k from orders union select c_custkey from customer where c_nationkey = 3")
def set_union(t):
    return t.orders.select(F.col("o_custkey").alias("k")).union(t.customer.where("c_nationkey = 3").select("c_custkey")).distinct()


@_query("select c_custkey as k from customer except select o_custkey from orders")
def set_except(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


@_query("select c_custkey as k from customer where c_nationkey = 3 intersect select o_custkey from orders")
def set_intersect(t):
    return t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("k")).intersect(t.orders.select("o_custkey"))


@_query("select l_returnflag, count(distinct l_suppkey) as holders, count(distinct l_partkey) as parts from lineitem group by 1")
def distinct_holders(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("holders"), F.count_distinct("l_partkey").alias("parts"))


@_query("""
    with q as (select cast(c_custkey as varchar) as want from customer where c_custkey % 2 = 0 union all select c_name from customer where c_custkey % 2 = 1 union all select 'nobody')
    select want, coalesce(a.c_custkey, b.c_custkey) as found from q left join customer a on want = cast(a.c_custkey as varchar) left join customer b on want = b.c_name
""")
def id_resolution(t):
    want = t.customer.select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_name")).alias("want")).unionByName(t.customer.limit(1).select(F.lit("nobody").alias("want")))
    by_key = lookups.as_map(t.customer.withColumn("k", F.col("c_custkey").cast("string")), "k", "c_custkey")
    by_name = lookups.as_map(t.customer, "c_name", "c_custkey")
    d = lookups.lookup(lookups.lookup(want, "want", by_key, "a"), "want", by_name, "b")
    return d.select("want", F.coalesce("a", "b").alias("found"))


@_query("select o_orderkey as s, 'customer' as p, 'c' || o_custkey as o from orders union all select o_orderkey, 'status', o_orderstatus from orders")
def triples(t):
    from folio.operators import graph

    d = t.orders.select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))
    return graph.triples(d, "o_orderkey", {"customer": "customer", "status": "status"}).select("s", "p", "o")


@_query("select l_orderkey as src, 'part' as rel, l_partkey as dst from lineitem where l_orderkey in (select o_orderkey from orders) union all select l_orderkey, 'supplier', l_suppkey from lineitem where l_orderkey in (select o_orderkey from orders)")
def edges(t):
    from folio.operators import graph

    return graph.edges(order_documents(t), "o_orderkey", {"part": F.col("items.l_partkey"), "supplier": F.col("items.l_suppkey")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
