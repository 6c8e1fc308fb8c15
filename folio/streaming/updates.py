"""Updates as a stream: files of new documents are merged into the snapshot as they come."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folio.operators import jobs


def feed(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path)


def without_repeats(updates: DataFrame, time: str, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """Repeats of a version within the watermark go."""
    return updates.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def merged(base: DataFrame | None, updates: DataFrame, key: str, version: str, deleted: str | None = None) -> DataFrame:
    """The latest version of each document; documents whose latest version is a deletion go."""
    every = updates if base is None else base.unionByName(updates, allowMissingColumns=True)
    out = jobs.latest(every, key, version)
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def ingest(updates: DataFrame, snapshots: str, key: str, version: str, checkpoint: str, deleted: str | None = None) -> StreamingQuery:
    """Merges every batch into a new snapshot folder ``v=<batch>``; replaying a batch gives the same one.

    Deletions stay in the snapshot as rows, so that an older version that comes late can't return.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        base = spark.read.parquet(f"{snapshots}/v={n - 1}") if n else None
        merged(base, batch, key, version).write.mode("overwrite").parquet(f"{snapshots}/v={n}")

    return updates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(base: DataFrame, updates: DataFrame, since: str, key: str, version: str, dates: Sequence[str]) -> DataFrame:
    """A full rebuild with the updates since a day on top."""
    return merged(base, jobs.updates_since(updates, since, *dates), key, version)
