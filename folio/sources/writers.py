"""Sinks: bulk lines, concordances, feeds and snapshots. Writing is what Spark's writers do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_lines(df: DataFrame, *order: str) -> DataFrame:
    """One JSON document a line, without null fields."""
    d = df.sort(*order) if order else df
    return d.select(F.to_json(F.struct(*map(F.col, df.columns))).alias("value"))


def export_jsonl(df: DataFrame, path: str) -> None:
    as_lines(df).write.option("compression", "gzip").text(path)


def concordance_lines(df: DataFrame) -> DataFrame:
    """``id``, tab, notations."""
    return df.select(F.concat_ws("\t", "id", "notations").alias("value"))


def bulk_lines(df: DataFrame, key: str, index: str) -> DataFrame:
    """An action line before every document line."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(key).cast("string").alias("_id")).alias("index")))
    doc = F.to_json(F.struct(*map(F.col, df.columns)))
    return df.select(F.explode(F.array(action, doc)).alias("value"))


def feed_items(df: DataFrame, title: Column, fallback: Column, link: Column, date: str, n: int = 15) -> DataFrame:
    """The newest documents as feed entries; those without a title go by their id."""
    return df.select(F.coalesce(title, fallback).alias("title"), link.alias("link"), F.col(date).alias("pubDate")).orderBy(F.desc_nulls_last("pubDate"), "link").limit(n)


def write_snapshot(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)
