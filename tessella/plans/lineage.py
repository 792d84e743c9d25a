"""Cuts of lineage that outlive a lost executor."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: The folder that holds the package.
ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> None:
    """Lets Python workers that start from here on import the package from where the driver did.

    Workers on machines where it isn't at this path need it installed or in --py-files.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; only a local master may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


#: What was written for this session alone, to be removed when the driver's Python ends.
_WRITTEN: list[tuple[SparkSession, str]] = []


#: Rows of one checkpoint file, where it is known about how many there are.
FILE_ROWS = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` behind a reliable checkpoint in the shared folder; with about how many `rows` it has, in no more files than these need."""
    sc = df.sparkSession.sparkContext
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
        _WRITTEN.append((df.sparkSession, sc.getCheckpointDir()))  # a folder of this session's own below the shared one
    return df.checkpoint(eager=True)


@atexit.register
def sweep() -> None:
    """Removes what `cut`, `stored` and `scratch` have written; frames that read it can't be used after that."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Exception):  # the session may be gone; the folder is scratch
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder, to be removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tessella-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes one small file from the driver, by Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content))
    out.close()


def stored(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back; it stays there until the driver ends."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of what runs meanwhile have at most so many rows: for rows that hold whole texts, whose batches of 10,000 take hundreds of MB in each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
