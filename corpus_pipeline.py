"""A training-corpus pipeline: five stages over the table ``documents``, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last return the columns
of ``documents``; the last returns the packed pieces. Rows are told apart by their place in the files they are
read from, so ids may repeat or be null, and no stage writes its texts a second time.

Defined cases, in all stages: null and empty texts are documents of size 0, equal to each other, near nothing,
scored by the intercept alone, taken 0 times by the mix and so never packed; very long texts go through
whole; rows with the same id are documents of their own; repeated rows are equal texts, of which one stays; an empty table gives
an empty result; columns beyond those of ``documents`` are dropped, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from folio import ship
from folio.llm.common import cut, drop, release, scratch, with_row
from folio.llm.exact_dedup import exact_dedup
from folio.llm.mixing import mix
from folio.llm.near_dedup import near_dedup
from folio.llm.packing import pack
from folio.llm.toxicity import toxicity as scored

#: No SQL for MinHash trees, label models and packing; tests hold the stages against brute force.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEY = "_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key that a second read gives again: a hash of the file, plus the place in it.

    Two files' ranges of keys meet with a probability of about files^2 * rows of a file / 2^63.
    """
    ship(docs.sparkSession)
    place = F.shiftright(F.xxhash64("_metadata.file_path"), 1) + F.col("_metadata.row_index")
    try:
        return docs.select(*COLUMNS, place.alias(KEY))
    except AnalysisException:  # no files below: a key of our own, written before use
        return cut(with_row(docs.select(*COLUMNS), KEY))


def _only(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    return keyed.join(rows.select(KEY), KEY, "left_semi").select(*COLUMNS)


def _after(previous: str | None):
    """A stage starts once the one before it is written, so that one's intermediate tables go."""

    def wrap(stage):
        @functools.wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            with scratch(spark, stage.__name__, previous):
                out = stage(spark, docs, sf_dir)
            release(spark)
            return out

        return run_stage

    return wrap


@_after(None)
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the others pass through the one task that scores them."""
    ship(spark)
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


@_after("toxicity")
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    keyed = _keyed(docs)
    return _only(keyed, exact_dedup(keyed, row_col=KEY).where("kept"))


@_after("exact")
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, similarity 0.8) the smallest id stays."""
    keyed = _keyed(docs)
    return _only(keyed, near_dedup(keyed, row_col=KEY).where("kept"))


@_after("near")
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    keyed = _keyed(docs)
    copies = mix(keyed, row_col=KEY).where("copies > 0").select(KEY, "copies")
    return keyed.join(copies, KEY).select(*COLUMNS, F.explode(F.expr("array_repeat(0, int(copies))")).alias("copy")).drop("copy")


@_after("mixing")
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of what is left."""
    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        written = cut(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)  # nothing reads it any more
        docs = before = written
    return STAGES[-1][1](spark, docs, sf_dir)
