"""Shared-folder helpers: every intermediate table and file lives where all executors can reach it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local temporary one only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet in the shared folder and reading it back.

    A lost executor costs only the tasks it ran: the written table has no lineage.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize`, and aggregates over the rows that were written, by name: ``rows`` (their number) and ``figures``.

    They come with the write itself. A job that counts the table again takes plans, stages and threads of the driver each time.
    """
    seen = Observation()
    made = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in figures.items()]), name)
    return made, {"rows": 0} | seen.get


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def open_filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI, usable inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def publish(uri: str, chunks) -> int:
    """Write the byte strings in ``chunks`` to ``uri`` and move the file in place when it is whole.

    A retried or speculative task writes its own temporary file, so a half-written file never
    carries the final name. Returns the file's length.
    """
    filesystem, path = open_filesystem(uri)
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with filesystem.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    filesystem.move(part, path)
    return size
