"""What the operators share: the shared folder, lineage cuts, row keys, edges to components."""

from __future__ import annotations

import contextlib
import gc
import os
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space splits words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a session on one machine (tests) names none, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or "file://" + os.path.join(tempfile.gettempdir(), "folio-checkpoint")


_open: list[list[str]] = []
_left: dict[str, list[str]] = {}


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str, done: str | None = None):
    """Keeps account of the tables that are cut inside, under ``name``, and drops those of ``done``.

    For chains of steps whose results are written before the next step starts: the next one drops what
    the one before it left.
    """
    for path in _left.pop(done, []):
        _delete(spark, path)
    _left[name] = []
    _open.append(_left[name])
    try:
        yield
    finally:
        _open.pop()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def drop(written: DataFrame) -> None:
    """Deletes the table that ``cut`` wrote."""
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        _delete(written.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here, and lost executors
    cost a re-read, not a re-run."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/folio/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """A unique key for each row, for tables whose ids may repeat or be null. Stable only once cut."""
    return df.withColumn(name, F.monotonically_increasing_id())


def placed(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` with ``_file`` and ``_at``, by which a second read tells each row again: a hash of the file and
    the place in it. Two of a million files share a hash with a probability of 3e-8. A table that isn't
    read from files is written first."""
    try:
        return docs.select(*columns, F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return cut(with_row(docs.select(*columns, F.lit(0).cast("long").alias("_file")), "_at"))


def slices(batches, rows: int = 512):
    """Arrow batches of fewer rows, so that few texts are Python objects at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(df[column], F.lit(""))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)``: the smallest node id that each node of ``edges(a, b)`` reaches.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each round is two grouped
    minima over the edges, every round is cut, and only a count comes back to the driver. Nodes
    without edges are not returned. An empty edge table gives an empty result.
    """
    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = mark(e)
    for _ in range(max_rounds if seen[0] else 0):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u > v").distinct())
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = cut(nxt.where("u > v").distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
