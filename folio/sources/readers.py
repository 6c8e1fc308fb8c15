"""Sources: MARC-XML, lookup tables, concept labels, dumps, and guards against short inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SUB = "subfield array<struct<_code:string,_VALUE:string>>"
_RECORD = f"leader string, controlfield array<struct<_tag:string,_VALUE:string>>, datafield array<struct<_tag:string,_ind1:string,_ind2:string,{_SUB.replace('subfield ', 'subfield:')}>>"


def _reshaped(df: DataFrame, pre: str = "") -> DataFrame:
    """Leader, control fields and data fields under plain names; the record id is field 001."""
    lead, ctl, dat, sub = (F.col(f"`{pre}{n}`") if n != "subfield" else f"{pre}{n}" for n in ("leader", "controlfield", "datafield", "subfield"))
    control = F.transform(ctl, lambda c: F.struct(c["_tag"].alias("tag"), c["_VALUE"].alias("value")))
    data = F.transform(
        F.coalesce(dat, F.array()),
        lambda d, i: F.struct(
            i.alias("pos"), d["_tag"].alias("tag"), d["_ind1"].alias("ind1"), d["_ind2"].alias("ind2"),
            F.transform(F.coalesce(d[sub], F.array()), lambda s: F.struct(s["_code"].alias("code"), s["_VALUE"].alias("value"))).alias("sub"),
        ),
    )
    d = df.select(lead.alias("leader"), control.alias("control"), data.alias("data"))
    of = F.filter("control", lambda c: c["tag"] == "001")
    return d.select(F.try_element_at(of, F.lit(1))["value"].alias("record_id"), "leader", "control", "data")


def read_marcxml(spark: SparkSession, paths: str | Sequence[str], row_tag: str = "record", prefix: str = "") -> DataFrame:
    """One row for each record. Blank indicators and leading blanks of fixed fields stay.

    Several inputs may be given as a list or parted by semicolons. Files of many parts split well; a single
    gzip file is read by one task, so repartition and persist after it.
    """
    paths = paths.split(";") if isinstance(paths, str) else list(paths)
    schema = _RECORD
    if prefix:
        schema = schema.replace("leader string", f"`{prefix}leader` string").replace("controlfield array", f"`{prefix}controlfield` array").replace("datafield array", f"`{prefix}datafield` array").replace("subfield:", f"`{prefix}subfield`:")
    df = spark.read.format("xml").option("rowTag", prefix + row_tag).option("ignoreSurroundingSpaces", "false").schema(schema).load(paths)
    return _reshaped(df, prefix)


def read_aggregate(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Aggregate MARC, whose elements are in the namespace ``marc:``."""
    return read_marcxml(spark, paths, prefix="marc:")


def read_marcxml_archive(spark: SparkSession, path: str, row_tag: str = "record") -> DataFrame:
    """Records of the XML files in tar archives, plain, ``.gz`` or ``.bz2``, concatenated gzip blocks included.

    The archive is read as text that the records' end tags part, so it streams: a task holds a record at a time, whatever
    the archive's size, and plain and bzip2 archives are split among tasks. What stands between two records (headers of
    members, padding, prologues) goes. Values stay as they are, line breaks too, but values of
    white space alone are null; white space that breaks lines between elements goes. A gzip archive is read by one task; its records are dealt out before they are parsed.
    """
    end = f"</{row_tag}>"
    chunks = spark.read.text(path, lineSep=end)
    # of a chunk what follows the last start tag
    record = F.regexp_extract("value", rf"(?s)^.*(<{row_tag}[\s>].*)$", 1)
    text = chunks.select(record.alias("value")).where("value <> ''").repartition(2 * spark.sparkContext.defaultParallelism)
    whole = F.concat(F.regexp_replace("value", r">\s*\n\s*<", "><"), F.lit(end))
    parsed = F.from_xml(whole, _RECORD, {"ignoreSurroundingSpaces": "false"})
    return _reshaped(text.select(parsed.alias("r")).select("r.*"))


def read_lookup_tsv(spark: SparkSession, path: str, key: int, value: int, header: bool = False) -> DataFrame:
    """``(key, value)`` of two columns of a tab-separated file, gzip included; of repeated keys the last line stays."""
    n = max(key, value) + 1
    schema = ", ".join(f"c{i} string" for i in range(n))
    df = spark.read.option("sep", "\t").option("quote", "").option("header", header).option("enforceSchema", True).schema(schema).csv(path)
    # Spark deals splits out by size: a line's place is its file, the split's start there, and its place in the split
    line = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    d = df.select(F.trim(f"c{key}").alias("key"), F.trim(f"c{value}").alias("value"), line.alias("line"))
    return d.where("key <> '' and value is not null").groupBy("key").agg(F.max_by("value", "line").alias("value"))


def read_skos_labels(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """``(key, value)``: concept IRIs and their preferred labels in one language, from Turtle.

    Statements end with a dot at the end of a line; prefixes are those declared in the files.
    """
    lines = spark.read.text(path, lineSep=" .\n")
    prefixes = spark.read.text(path).select(F.regexp_extract("value", r"^@prefix\s+([\w-]*):\s+<([^>]*)>", 1).alias("p"), F.regexp_extract("value", r"^@prefix\s+([\w-]*):\s+<([^>]*)>", 2).alias("iri")).where("iri <> ''").distinct()
    one = lines.select(F.regexp_extract("value", r"(?m)^\s*(<[^>]+>|[\w-]*:[\w./-]+)\s", 1).alias("s"), F.regexp_extract("value", r'skos:prefLabel[^;]*?"((?:[^"\\]|\\.)*)"@' + lang, 1).alias("label"))
    one = one.where("s <> '' and label <> ''").withColumn("p", F.when(~F.col("s").startswith("<"), F.split_part("s", F.lit(":"), F.lit(1))))
    d = one.join(F.broadcast(prefixes), "p", "left")  # a handful of declarations
    iri = F.when(F.col("p").isNull(), F.substring_index(F.substring_index("s", "<", -1), ">", 1)).otherwise(F.concat("iri", F.expr("substring(s, length(p) + 2)")))
    return d.select(iri.alias("key"), F.regexp_replace("label", r"\\(.)", "$1").alias("value")).groupBy("key").agg(F.min("value").alias("value"))


def inline_map(spark: SparkSession, table: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(table.items()), "key string, value string")


def read_dump(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Full and update dumps, one JSON document a line."""
    return spark.read.schema(schema).json(list(paths))


def guarded(df: DataFrame, least: int, sentinel: Column | None = None) -> DataFrame:
    """``(records, enough, sentinel)``: whether an input has at least so many rows and its sentinel once."""
    seen = F.count_if(sentinel) == 1 if sentinel is not None else F.lit(True)
    return df.agg(F.count(F.lit(1)).alias("records"), seen.alias("sentinel")).select("records", (F.col("records") >= least).alias("enough"), "sentinel")
