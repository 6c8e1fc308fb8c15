"""Whole-catalogue jobs: facets, counts, checks, reports, merges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio import shared_folder
from folio.functions import columns as C
from folio.functions import nested as N


def facet(df: DataFrame, terms: Column, top: int) -> DataFrame:
    """Documents for each term, most first, then by term. ``terms`` is an array or a single value; a document counts once for a term."""
    kind = df.select(terms.alias("t")).schema["t"].dataType.typeName()
    each = F.explode(F.array_distinct(terms)) if kind == "array" else terms
    found = df.select(each.alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    return found.orderBy(F.desc("docs"), F.asc("term")).limit(top)


def facets(df: DataFrame, fields: dict[str, Column], top: dict[str, int] | int) -> DataFrame:
    """``(field, term, docs)`` of several facets, in one pass over the documents."""

    def named(name: str, terms: Column) -> Column:
        kind = df.select(terms.alias("t")).schema["t"].dataType.typeName()
        values = F.array_distinct(terms) if kind == "array" else F.array(terms)
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("field"), v.cast("string").alias("term")))

    arrays = [named(*f) for f in fields.items()]
    flat = df.select(F.explode(F.concat(*arrays)).alias("f")).select("f.*").where("term is not null")
    counts = flat.groupBy("field", "term").agg(F.count(F.lit(1)).alias("docs"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("docs"), F.asc("term")))
    limits = F.create_map(*(F.lit(x) for n in fields for x in (n, top if isinstance(top, int) else top[n])))
    # the literal bound lets each task drop what can't be among the first
    most = top if isinstance(top, int) else max(top.values())
    return counts.withColumn("rank", rank).where((F.col("rank") <= most) & (F.col("rank") <= limits[F.col("field")])).drop("rank")


def geohash_grid(df: DataFrame, lat: Column, lon: Column, precision: int = 9) -> DataFrame:
    """Documents for each geohash cell, and the cell's centre."""
    bits = 5 * precision
    w, h = 360.0 / (1 << (bits + 1) // 2), 180.0 / (1 << bits // 2)
    x, y = F.floor((lon + 180) / w), F.floor((lat + 90) / h)
    g = df.where(lat.isNotNull() & lon.isNotNull()).groupBy(C.geohash(lat, lon, precision).alias("cell"), x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("docs"))
    return g.select("cell", "docs", ((F.col("y") + 0.5) * h - 90).alias("lat"), ((F.col("x") + 0.5) * w - 180).alias("lon"))


def usage_counts(snapshots: list[DataFrame], ids: str) -> DataFrame:
    """How often each id is used over several snapshots: a document in two of them counts twice."""
    both = reduce(DataFrame.unionByName, (s.select(ids) for s in snapshots))
    return both.where(F.col(ids).isNotNull()).groupBy(F.col(ids).alias("id")).agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), F.asc("id"))


def beacon(counts: DataFrame, header: dict[str, str], time: str, revisit_days: int = 31) -> DataFrame:
    """Lines of a link dump: header fields with their dates, then ``id|count``."""
    spark = counts.sparkSession
    t = F.to_date(F.lit(time))
    head = spark.createDataFrame([(0, i, f"#{k}: {v}") for i, (k, v) in enumerate(header.items())], "part int, n long, value string")
    dates = spark.range(1).select(F.posexplode(F.array(F.concat(F.lit("#TIMESTAMP: "), t.cast("string")), F.concat(F.lit("#REVISIT: "), F.date_add(t, revisit_days).cast("string")))).alias("n", "value"))
    body = counts.select(F.lit(2).alias("part"), (-F.col("uses")).alias("n"), F.concat_ws("|", "id", "uses").alias("value"))
    return head.unionByName(dates.select(F.lit(1).alias("part"), F.col("n").cast("long").alias("n"), "value")).unionByName(body).orderBy("part", "n", "value").select("value")


def year_histogram(df: DataFrame, year: Column, this_year: int) -> DataFrame:
    """Documents for each year from the first to the last valid one, zero where there are none."""
    y = df.select(year.cast("int").alias("year")).where(F.col("year").between(1, this_year)).groupBy("year").agg(F.count(F.lit(1)).alias("docs"))
    span = y.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    return span.join(y, "year", "left").select("year", F.coalesce("docs", F.lit(0)).cast("long").alias("docs"))


def concordance(df: DataFrame, ids: Column, notations: Column, valid: str, sep: str = ",") -> DataFrame:
    """``(id, notations)``: for every id of a record its valid distinct notations; records without either go."""
    good = F.array_distinct(F.filter(notations, lambda n: n.rlike(C.full(valid))))
    d = df.select(F.array_distinct(ids).alias("ids"), good.alias("good")).where((F.size("ids") > 0) & (F.size("good") > 0))
    return d.select(F.explode("ids").alias("id"), F.array_join("good", sep).alias("notations"))


def sanity_checks(df: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """``(check, value, least, passed)`` for aggregates and the values they must exceed, in one pass."""
    row = df.agg(*(a.cast("double").alias(n) for n, (a, _) in checks.items()))
    items = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("value"), F.lit(float(m)).alias("least")) for n, (_, m) in checks.items()))
    return row.select(F.inline(items)).withColumn("passed", F.col("value") > F.col("least"))


def deletion_balance(old: DataFrame, new: DataFrame, deletions: DataFrame, key: str) -> DataFrame:
    """Whether documents vanished beyond the announced deletions, within a tolerance of a fiftieth and ten."""
    gone = old.join(new, key, "left_anti").agg(F.count(F.lit(1)).alias("gone"))
    told = deletions.agg(F.count(F.lit(1)).alias("deletions"))
    t = gone.join(told)  # two single rows
    slack = F.floor((F.col("deletions") + 1) / 50) + 10
    return t.withColumn("excess", F.col("gone") - F.col("deletions") - slack).withColumn("passed", F.col("excess") <= 0)


def repeated_ids(df: DataFrame, record: str, ids: str) -> DataFrame:
    """Records with more than one distinct id."""
    g = df.groupBy(record).agg(F.count_distinct(ids).alias("n_ids"), F.min(ids).alias("first_id"))
    return g.where("n_ids > 1")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, records)`` of the rules that records break; a null condition breaks its rule too."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())))
    return df.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("records"))


def flattened(df: DataFrame, key: str, columns: list[str], skip: tuple[str, ...] = ("@context",)) -> DataFrame:
    """``(key, path, value)``: one row for each present value."""
    items = F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in columns if c not in skip))
    return df.select(F.col(key).alias("key"), F.inline(items)).where("value is not null")


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, path, value, side)`` of values in one snapshot only, as bags of values."""
    a, b = flattened(old, key, columns), flattened(new, key, columns)
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


def by_paths(df: DataFrame, key: str, ordered: Callable[[tuple[str, ...]], bool], skip: tuple[str, ...] = ("@context",)) -> DataFrame:
    """``(key, path, pos, value)``: every value of documents of any depth, by its path without array indices.

    ``pos`` is the value's place among those of its path where the path is ordered, else null.
    """
    def placed(path: tuple[str, ...]) -> Column:
        place = (lambda i: i) if ordered(path) else (lambda _: F.lit(None).cast("int"))
        return F.transform(N.top_values(df.schema, path), lambda v, i: F.struct(F.lit(".".join(path)).alias("path"), place(i).alias("pos"), v.alias("value")))

    parts = [F.array().cast("array<struct<path:string,pos:int,value:string>>"), *(placed(p) for p in N.paths(df.schema, (key, *skip)))]
    return df.select(F.col(key).alias("key"), F.inline(F.concat(*parts)))


def diff_documents(old: DataFrame, new: DataFrame, key: str, ordered: Callable[[tuple[str, ...]], bool] = lambda p: p[-1].endswith("Order"), skip: tuple[str, ...] = ("@context",)) -> DataFrame:
    """``(key, path, pos, value, side, copies)`` of what only one of two snapshots of nested documents has.

    Values of a path are a bag, of an ordered path a sequence: a list in another order differs on ordered
    paths only. The documents of a key meet, from both snapshots, and are compared by themselves, so that no task
    counts the values of many; the schemas may differ.
    """
    sides = [(d, n, list(N.paths(d.schema, (key, *skip)))) for d, n in ((old, 1), (new, -1))]
    every = list(dict.fromkeys(p for *_, ps in sides for p in ps))
    if not every:
        return by_paths(old, key, ordered, skip).select("*", F.lit("old").alias("side"), F.lit(0).cast("long").alias("copies"))
    none = F.array().cast("array<string>")
    rows = [d.select(F.col(key).alias("key"), F.lit(n).alias("n"), *((N.top_values(d.schema, p) if p in ps else none).alias(f"_p{i}") for i, p in enumerate(every))) for d, n, ps in sides]
    met = reduce(DataFrame.unionByName, rows).groupBy("key").agg(F.collect_list(F.struct("n", *(f"_p{i}" for i in range(len(every))))).alias("_docs"))
    found = F.concat(*(_unequal(F.col("_docs"), f"_p{i}", ".".join(p), ordered(p)) for i, p in enumerate(every)))
    return met.select("key", F.inline(found)).select("key", "path", "pos", "value", F.when(F.col("n") > 0, "old").otherwise("new").alias("side"), F.abs("n").alias("copies"))


def _unequal(docs: Column, name: str, path: str, ordered: bool) -> Column:
    """``[{path, pos, value, n}]``: what the documents of both sides don't have alike at a path; ``n`` is negative for the new side.

    The values are sorted, and the sides of equal ones, which are neighbours then, added up.
    """
    place = (lambda i: i) if ordered else (lambda _: F.lit(None).cast("int"))
    side = lambda n: F.flatten(F.transform(F.filter(docs, lambda d: d["n"] == n), lambda d: F.transform(d[name], lambda v, i: F.struct(place(i).alias("pos"), v.alias("value")))))

    def counted(s: Column) -> Column:
        same = lambda a, b: a["pos"].eqNullSafe(b["pos"]) & (a["value"] == b["value"])
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | ~same(x, F.get(s, F.greatest(i - 1, F.lit(0)))), i)), lambda i: i.isNotNull())
        run = lambda a, b: F.struct(F.lit(path).alias("path"), s[a]["pos"].alias("pos"), s[a]["value"].alias("value"), F.aggregate(F.slice(s, a + 1, b - a), F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("n"))
        runs = lambda at: F.transform(at, lambda a, j: run(a, F.coalesce(F.get(at, j + 1), F.size(s))))
        return F.filter(C.let(starts, runs), lambda r: r["n"] != 0)

    def compared(x: Column) -> Column:
        signed = lambda a, n: F.transform(a, lambda v: F.struct(v["pos"].alias("pos"), v["value"].alias("value"), F.lit(n).alias("n")))
        c = F.sort_array(F.concat(signed(x["a"], 1), signed(x["b"], -1)))
        return F.when(x["a"] == x["b"], F.array().cast("array<struct<path:string,pos:int,value:string,n:bigint>>")).otherwise(C.let(c, counted))

    return C.let(F.struct(F.sort_array(side(1)).alias("a"), F.sort_array(side(-1)).alias("b")), compared)


def label_from_usage(df: DataFrame, iri: str, label: str, order: str) -> DataFrame:
    """The label that the first document carrying an id gives it, else the id."""
    g = df.groupBy(iri).agg(F.min_by(label, F.struct(order, label)).alias("label"))
    return g.select(iri, F.coalesce("label", F.col(iri).cast("string")).alias("label"))


def most_specific(df: DataFrame, key: str, kind: str, ranks: DataFrame, unspecific: str) -> DataFrame:
    """Of each key the kind of highest rank among those that have one; ``unspecific`` loses to any other."""
    r = df.select(key, kind).distinct().join(ranks.select(F.col("key").alias(kind), F.col("value").alias("rank")), kind)
    return r.groupBy(key).agg(F.max_by(kind, F.struct((F.col(kind) != unspecific).alias("s"), "rank", kind)).alias("top"))


def latest(df: DataFrame, key: str, *version: str) -> DataFrame:
    """Keyed upsert: of each key the row of the latest version, ties by the columns given after it."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(v) for v in version)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, group: str, n: int, *order: str) -> DataFrame:
    """The rows beyond the last ``n`` of each group: what may be dropped. ``order`` tells the rows of a group apart.

    The n-th newest row of each group is found first, from ``n`` rows of every task, and the others are held
    against it, so that no task ever sorts a whole group.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*(F.desc(o) for o in order)))
    last = df.select(group, *order).withColumn("_rank", rank).where(F.col("_rank") <= n).where(F.col("_rank") == n)
    bound = last.select(F.col(group).alias("_group"), F.struct(*order).alias("_bound"))
    j = df.join(bound, df[group].eqNullSafe(F.col("_group")))
    return j.where(F.struct(*order) < F.col("_bound")).drop("_group", "_bound")


def updates_since(df: DataFrame, since: str, *dates: str) -> DataFrame:
    """Documents with a date strictly after the day given."""
    return df.where(reduce(Column.__or__, (F.coalesce(F.to_date(d) > F.lit(since).cast("date"), F.lit(False)) for d in dates)))


def period_counts(df: DataFrame, date: str, expected: DataFrame | None = None) -> DataFrame:
    """Documents for each year, and against ``expected(year, expected)`` if given."""
    got = df.groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("docs"))
    if expected is None:
        return got
    j = expected.join(got, "year", "full").select("year", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("docs", F.lit(0)).alias("docs"))
    return j.withColumn("complete", F.col("expected") == F.col("docs"))


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Numbers the rows from 0 without gaps by a total order, with no task that sees them all.

    Rows are dealt out by ranges of the order and written once; a range starts where the sizes of those before it end.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    d = spark.read.schema(ranged.schema).parquet(path)
    # a row a range
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = d.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return d.withColumn("_place", place).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def with_running_parents(df: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """Rows without a parent's id get a running number in its stead."""
    bare = numbered(df.where(F.col(parent).isNull()), order, "_number").withColumn(parent, F.col("_number").cast("string")).drop("_number")
    return df.where(F.col(parent).isNotNull()).unionByName(bare.select(*df.columns))


def split_items(df: DataFrame, parent: str, items: str, item_id: str, context: str | None = None, strip: tuple[str, ...] = ("itemOf", "describedBy", "@context")) -> DataFrame:
    """One row for each embedded item, with its parent's id, its position and its own id without host and fragment mark.

    ``context`` is added to every item; fields of ``strip`` go. Items whose parent has no id: ``with_running_parents``.
    """
    e = df.select(F.col(parent).alias("parent_id"), F.posexplode(items).alias("pos", "item"))
    bare = F.regexp_replace(F.regexp_replace(F.col(f"item.{item_id}").cast("string"), r"^https?://[^/]+/", ""), r"#!$", "")
    kept = [f"item.{n}" for n in e.schema["item"].dataType.names if n not in strip]
    more = [F.lit(context).alias("@context")] if context else []
    return e.select("parent_id", "pos", bare.alias("item_id"), *kept, *more)


def match_or_create(left: DataFrame, right: DataFrame, keys: list[str], marks: str = "origin") -> DataFrame:
    """Items with the events that match them; events without an item create one."""
    l, r = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    j = l.join(r, keys, "full")
    return j.withColumn(marks, F.when(F.col("_l").isNull(), "created").when(F.col("_r").isNull(), "plain").otherwise("matched")).drop("_l", "_r")
