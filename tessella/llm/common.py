"""What the operators of this package share: reading, lineage cuts, the two word definitions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.lineage import cut, reachable, shared_dir, stored

__all__ = ["NO_ID", "WORD", "cut", "filled", "free", "reachable", "shared_dir", "stored", "table", "text_bytes"]

#: A word is a run of bytes outside space and 0x09-0x0D; other Unicode spaces are part of words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows without an identifier keep it null in results; inside, they are joined under this one.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a scale-factor folder."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is the empty text."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def filled(name: str | Column = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


def free(df: DataFrame, name: str) -> str:
    """`name`, with underscores until `df` has no column of it; Spark tells names apart without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
