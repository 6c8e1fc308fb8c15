"""Token tables, relevance with global statistics, suggestions and result envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import columns as C


def token_table(df: DataFrame, key: str, text: Column, field: str = "text", stop: Sequence[str] = ()) -> DataFrame:
    """``(key, field, pos, token)``."""
    return df.select(F.col(key).alias("key"), F.lit(field).alias("field"), F.posexplode(C.tokens(text, stop)).alias("pos", "token"))


def token_frequencies(df: DataFrame, text: Column, stop: Sequence[str] = ()) -> DataFrame:
    """``(token, df, tf)``: documents with each token, and its places.

    A document's tokens are sorted inside the row, so that equal ones are a run, and each distinct token is dealt out
    once with its run's length: one shuffle, pre-aggregated.
    """

    def counted(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))
        return C.let(starts, lambda s: F.transform(s, lambda at, k: F.struct(F.get(w, at - 1).alias("token"), (F.coalesce(F.get(s, k + 1), F.size(w) + 1) - at).alias("n"))))

    runs = C.let(F.array_sort(C.tokens(text, stop)), lambda w: F.when(F.size(w) > 0, counted(w)))
    each = df.select(F.explode(runs).alias("x"))
    return each.groupBy(F.col("x.token").alias("token")).agg(F.count(F.lit(1)).alias("df"), F.sum("x.n").alias("tf"))


def bm25(df: DataFrame, key: str, text: Column, query: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(key, score)`` with document frequencies and lengths of the whole collection.

    A document is one row: its length and counts are taken inside it, and the statistics are one global aggregate.
    """
    is_ = lambda q: lambda x: x == q
    counts = C.let(C.tokens(text, ()), lambda w: F.struct(F.size(w).alias("len"), *(F.size(F.filter(w, is_(q))).alias(f"tf{i}") for i, q in enumerate(query))))
    # a generator keeps filters above it, so that a text is split once a pass
    lengths = df.select(F.col(key).alias("key"), F.inline(F.array(counts))).where("len > 0")
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))))
    hits = lengths.where(" or ".join(f"tf{i} > 0" for i in range(len(query)))).join(F.broadcast(stats))  # a single row
    parts = []
    for i in range(len(query)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        parts.append(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))))
    return hits.select("key", sum(parts[1:], parts[0]).alias("score"))


def suggestion(fields: Sequence[Column], kinds: Column, base_kind: str) -> tuple[Column, Column]:
    """Label: the fields that are present, joined by bars. Category: sorted kinds without the base one."""
    label = C.paste(*fields, sep=" | ")
    category = F.array_join(F.array_sort(F.array_remove(kinds, base_kind)), " | ")
    return label, category


def several(values: Column) -> Column:
    return F.nullif(F.array_join(values, "; "), F.lit(""))


def date_range(start: Column, end: Column) -> Column:
    return F.when(end.isNotNull(), F.concat_ws("–", start, end)).otherwise(start)


def envelope(hits: DataFrame, all_hits: DataFrame, search_id: str) -> DataFrame:
    """One row: id, number of hits, and a page of hits as JSON lines in their order."""
    n = all_hits.agg(F.count(F.lit(1)).alias("totalItems"))
    page = hits.select(F.to_json(F.struct("*")).alias("member")).agg(F.collect_list("member").alias("member"))  # one page
    return n.join(page).select(F.lit(search_id).alias("id"), "totalItems", "member")


def facet_order(facets: DataFrame, selected: Sequence[str], by_label: bool) -> DataFrame:
    """Selected terms first; then years by label, other terms by count."""
    chosen = F.col("term").isin(*selected) if selected else F.lit(False)
    rest = [F.desc("term")] if by_label else [F.desc("docs"), F.asc("term")]
    return facets.orderBy(chosen.desc(), *rest)


def isil_order(isil: Column) -> list[Column]:
    """Sort keys: main and sub part by number, in which every other character counts as nine."""
    parts = F.split(F.regexp_replace(isil, r"^[A-Z]+-", ""), "-")
    as_number = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"\D", "9").try_cast("long")
    return [F.coalesce(as_number(F.try_element_at(parts, F.lit(i))), F.lit(0)) for i in (1, 2)]
