"""folio: catalogue analytics on Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile


def shared_folder(spark) -> str:
    """A new folder below the one of ``spark.checkpoint.dir``; only a session on one machine may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or 'file://' + tempfile.gettempdir()).rstrip('/')}/folio/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def ship(spark) -> None:
    """Sends this package to the Python workers of the session, once for each context."""
    sc, name = spark.sparkContext, "folio_package.zip"
    if name in sc._python_includes:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="folio-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    at = os.path.join(folder, f)
                    z.write(at, os.path.relpath(at, os.path.dirname(top)))
    sc.addPyFile(path)
