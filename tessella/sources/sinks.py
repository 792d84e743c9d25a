"""Writes that a later reader can trust: appended once, complete or absent, replaced by section."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(rows: DataFrame, path: str, key: Sequence[str]) -> int:
    """Appends the rows whose key isn't there yet; how many these were."""
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path).select(*key)
        rows = rows.join(there, [*key], "left_anti")
    except AnalysisException:
        if exists(spark, path):
            raise
    new = rows.dropDuplicates([*key])
    count = new.count()
    if count:
        new.write.mode("append").parquet(path)
    return count


def _folder(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_atomic(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replaces a table as a whole: written beside it first, so that a run that stops leaves the old one as it was."""
    spark = rows.sparkSession
    beside, before = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.format(kind).save(beside)
    fs, p = _folder(spark, path)
    there = fs.exists(p)
    if there:
        fs.rename(p, _folder(spark, before)[1])
    if not fs.rename(_folder(spark, beside)[1], p):
        raise OSError(f"can't rename {beside} to {path}")
    if there:
        fs.delete(_folder(spark, before)[1], True)


def drop_records(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, f"{path}/records")
    fs.delete(p, True)


def write_run(predictions: DataFrame, records: DataFrame, path: str) -> None:
    """Predictions first, records last: a run without records isn't complete. Old records go before anything is written."""
    drop_records(predictions.sparkSession, path)
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    records.write.mode("overwrite").parquet(f"{path}/records")


def is_complete(spark: SparkSession, path: str, records: int) -> bool:
    """Whether both parts were committed and as many records are there as there should be."""
    if not all(exists(spark, f"{path}/{x}/_SUCCESS") for x in ("predictions", "records")):
        return False
    return spark.read.parquet(f"{path}/records").count() == records


def replace_section(rows: DataFrame, path: str, section: str) -> None:
    """Replaces one section of a report; the others stay as they are."""
    held = rows.withColumn("section", F.lit(section))
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section").parquet(path)


def markdown(rows: DataFrame, columns: Sequence[str], digits: int = 3) -> str:
    """A small result as a Markdown table, in the order of its rows."""
    show = lambda v: "n/a" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows.select(*columns).collect()])


def latex(rows: DataFrame, columns: Sequence[str], digits: int = 3) -> str:
    show = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    head = " & ".join(c.replace("_", r"\_") for c in columns) + r" \\ \hline"
    body = [" & ".join(show(r[c]) for c in columns) + r" \\" for r in rows.select(*columns).collect()]
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", head, *body, r"\end{tabular}"])
