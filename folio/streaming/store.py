"""A snapshot that takes updates and deletions in batches: buckets of keys, tombstones, and a manifest.

    root/data/batch=<n>/bucket=<b>   the rows of batch n in bucket b
    root/data/whole=<n>/bucket=<b>   bucket b rewritten by batch n: all its rows so far
    root/manifest/batch=<n>          for each bucket the folders that hold its rows, oldest first

A batch writes its own rows only. A bucket whose batches hold more than a share of its rows is rewritten, so a
small batch costs in proportion to its size, and a reader has few rows to merge. Deletions are rows too,
tombstones, hidden by the reader: an older version that comes late doesn't return.

A batch starts from the manifest before it and overwrites what it wrote itself, so a replay gives the same store. Readers
see a batch once its manifest is complete; a batch that breaks off leaves the one before it in force.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folio.operators import jobs

_MANIFEST = "bucket int, folders array<string>, whole long, more long, schema string"


class Store:
    """``key`` names the rows, the largest ``version`` stays; of equal versions that of the later batch. ``deleted``
    names a boolean column. ``buckets`` never changes once a store exists."""

    def __init__(self, spark: SparkSession, root: str, key: str, version: str, deleted: str, buckets: int = 256, share: float = 0.25):
        self.spark, self.root, self.key, self.version, self.deleted = spark, root.rstrip("/"), key, version, deleted
        self.buckets, self.share = buckets, share

    # --- manifests

    def _batches(self) -> list[int]:
        """The batches with a complete manifest."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(hadoop):
            return []
        found = [s.getPath() for s in fs.listStatus(hadoop)]
        done = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def manifest(self, batch: int | None = None) -> tuple[dict[int, dict], T.StructType]:
        """The buckets and columns of the newest complete manifest, or of the newest before ``batch``."""
        known = [n for n in self._batches() if batch is None or n < batch]
        if not known:
            return {}, T.StructType()
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest/batch={known[-1]}").collect()  # a row a bucket
        columns = T.StructType.fromJson(json.loads(rows[0].schema)) if rows else T.StructType()
        return {r.bucket: {"folders": r.folders, "whole": r.whole, "more": r.more} for r in rows}, columns

    # --- rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _rows(self, state: dict[int, dict], buckets: list[int], columns: T.StructType) -> DataFrame:
        """All rows of some buckets, with the batch ``_age`` of the folder they lie in."""
        paths = [f"{self.root}/data/{f}/bucket={b}" for b in buckets for f in state[b]["folders"]]
        read = self.spark.read.schema(columns).parquet(*paths)
        age = F.regexp_extract("_metadata.file_path", r"/(?:batch|whole)=(\d+)/", 1).cast("long")
        return read.withColumn("_age", age)

    def _latest(self, rows: DataFrame) -> DataFrame:
        return jobs.latest(rows, self.key, self.version, "_age").drop("_age")

    def _written(self, rows: DataFrame, folder: str) -> dict[int, int]:
        """Writes rows by their buckets; how many each bucket got."""
        path, put = f"{self.root}/data/{folder}", rows.withColumn("bucket", self._bucket()).repartition("bucket")
        put.write.mode("overwrite").partitionBy("bucket").parquet(path)
        got = self.spark.read.schema("bucket int").option("basePath", path).parquet(path).groupBy("bucket").count()
        return {r.bucket: r["count"] for r in got.collect()}

    def write(self, batch: DataFrame, n: int) -> None:
        """Takes a batch of new versions and deletions as number ``n``."""
        state, columns = self.manifest(n)
        rows = jobs.latest(batch, self.key, self.version, self.deleted)
        # new columns are added; rows of older folders have null there
        columns = T.StructType([*columns.fields, *(f for f in rows.schema.fields if f.name not in columns.names)])
        name = f"batch={n}"
        counts = self._written(rows, name)
        for b, c in counts.items():
            s = state.setdefault(b, {"folders": [], "whole": 0, "more": 0})
            s["folders"].append(name)
            s["more"] += c
        full = sorted(b for b in counts if len(state[b]["folders"]) > 1 and state[b]["more"] > self.share * state[b]["whole"])
        if full:
            held = self._written(self._latest(self._rows(state, full, columns)), f"whole={n}")
            for b in full:
                state[b] = {"folders": [f"whole={n}"], "whole": held[b], "more": 0}
        for b in counts:
            if len(state[b]["folders"]) == 1 and state[b]["more"]:
                state[b] |= {"whole": state[b]["more"], "more": 0}
        table = [(b, s["folders"], s["whole"], s["more"], columns.json()) for b, s in sorted(state.items())]
        self.spark.createDataFrame(table, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/{name}")

    def read(self, batch: int | None = None) -> DataFrame | None:
        """The documents that are there, as of the newest batch, or of an earlier one; None before the first.

        Buckets in one folder hold each key once and are read as they are; the others are merged.
        """
        state, columns = self.manifest(None if batch is None else batch + 1)
        if not state:
            return None
        clean = [b for b, s in state.items() if len(s["folders"]) == 1]
        dirty = [b for b, s in state.items() if len(s["folders"]) > 1]
        parts = []
        if clean:
            parts.append(self._rows(state, clean, columns).drop("_age"))
        if dirty:
            parts.append(self._latest(self._rows(state, dirty, columns)))
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return out.where(~F.coalesce(F.col(self.deleted), F.lit(False))).drop(self.deleted)

    def forget(self, keep: int = 2) -> list[str]:
        """Deletes the manifests but the last ``keep``, and the folders that none of these names."""
        last = self._batches()[-keep:]
        used = {f for n in last for s in self.manifest(n + 1)[0].values() for f in s["folders"]}
        jvm, gone = self.spark._jvm.org.apache.hadoop.fs, []
        for top in ("data", "manifest"):
            path = jvm.Path(f"{self.root}/{top}")
            fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
            for s in fs.listStatus(path):
                name = s.getPath().getName()
                number = int(name.split("=")[1])
                # folders of a batch beyond the newest manifest are being written
                if number <= last[-1] and name not in used and (top == "data" or number not in last):
                    fs.delete(s.getPath(), True)
                    gone.append(name)
        return gone


def ingest(updates: DataFrame, store: Store, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """A stream of updates and deletions into a store; a batch that is replayed gives the same store."""
    step = lambda batch, n: store.write(prepare(batch) if prepare else batch, n)
    return updates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
