"""Labels kept up to date as reviews come in; over all reviews they equal the batch result.

The state is severity counts of units, so it grows with units, not with reviews. Repeated records
(one id) within the watermark count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.labels import aggregated, severity_counts


def unit_stream(reviews: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of (sample, smell, votes, c0 to c3, rank) from a stream of reviews with a timestamp `ts`."""
    once = reviews.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])
    return aggregated(severity_counts(once))


def counts_by_window(reviews: DataFrame, size: str = "7 days", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Reviews and positives of each smell in tumbling or sliding windows; a window is final once the watermark has passed it."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = reviews.withWatermark("ts", delay).groupBy(window.alias("w"), "smell").agg(F.count("*").alias("reviews"), F.count_if(F.col("severity") > 0).alias("positive"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "smell", "reviews", "positive")


def sessions(reviews: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of reviewers: reviews no further than `gap` apart."""
    out = reviews.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "reviewer").agg(F.count("*").alias("reviews"))
    return out.select("reviewer", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "reviews")


def upsert(stream: DataFrame, path: str, checkpoint: str, compact_every: int = 20) -> StreamingQuery:
    """Keeps the last state of each unit below `path`; `state` reads it.

    Each batch writes a folder of its own, and every so many batches all that stands is written as one
    base, after which older folders go; so a reader has at most `compact_every` folders and a base.
    """

    def batch(rows: DataFrame, number: int) -> None:
        # the folder's name is the batch's number, so a batch that runs again replaces itself
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % compact_every == compact_every - 1:
            compact(rows.sparkSession, path, number)

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def _folders(spark: SparkSession, path: str) -> tuple[int, list[int], list[int]]:
    """The number of the newest complete base (-1 without any), older bases, and batches, by name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    bases, batches = [], []
    for x in fs.listStatus(p) if fs.exists(p) else []:
        kind, _, number = x.getPath().getName().partition("=")
        done = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))
        if number.isdigit() and done and kind in ("base", "batch"):
            (bases if kind == "base" else batches).append(int(number))
    newest = max(bases, default=-1)
    return newest, sorted(x for x in bases if x != newest), sorted(batches)


def state(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each unit."""
    base, _, batches = _folders(spark, path)
    names = [f"{path}/base={base}"] * (base >= 0) + [f"{path}/batch={x}" for x in batches if x > base]
    return latest(spark.read.parquet(*names))


def compact(spark: SparkSession, path: str, number: int) -> None:
    """Writes the state after batch `number` as a base; folders that it makes needless go when it is complete."""
    base, _, batches = _folders(spark, path)
    names = [f"{path}/base={base}"] * (base >= 0) + [f"{path}/batch={x}" for x in batches if base < x <= number]
    latest(spark.read.parquet(*names)).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/base={number}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    newest, older, batches = _folders(spark, path)
    for name in [*(f"base={x}" for x in older), *(f"batch={x}" for x in batches if x <= newest)]:
        fs.delete(fs_path(f"{path}/{name}"), True)


def latest(rows: DataFrame) -> DataFrame:
    """Of each unit the row of its last batch."""
    last = rows.groupBy("sample", "smell").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("sample", "smell", "batch")]), "batch").alias("x"))
    return last.select("sample", "smell", "x.*")
