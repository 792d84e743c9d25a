"""Queries that run as streams, and as SQL texts over registered views and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.plans.lineage import scratch
from tessella.streaming import labels as stream
from tessella.views import register, reviews, with_views

_V = with_views("reviews")
_P = with_views("predictions")


def _live(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Reviews as a stream of four files, one at a time, and a folder for what comes of it."""
    path = scratch(spark)
    rows = reviews(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.withColumn("_file", F.col("id") % 4).repartition(4, "_file").drop("_file").write.parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path


@query(_V + """, u AS (SELECT sample, smell, count(*) AS votes, list_sort(list(severity) FILTER (severity IS NOT NULL)) AS s FROM reviews GROUP BY sample, smell)
  SELECT sample, smell, votes, CAST(coalesce(s[len(s) // 2 + 1], 0) AS INTEGER) AS rank FROM u""")  # fmt: skip
def stream_unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels kept up to date by a stream, as they stand when it has ended."""
    live, path = _live(spark, sf_dir)
    stream.upsert(stream.unit_stream(live, "4000 days"), f"{path}/out", f"{path}/check", compact_every=3).awaitTermination()
    return stream.state(spark, f"{path}/out").select("sample", "smell", "votes", F.col("rank").cast("int").alias("rank"))


def _final(found: DataFrame, path: str) -> DataFrame:
    """What a stream with a watermark has given out as final, as a table."""
    found.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return found.sparkSession.read.schema(found.schema).parquet(f"{path}/out")


# with everything in one file, a window is final once the next run of the watermark has passed it
@query(_V + """, m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM reviews), w AS (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, smell, severity FROM reviews)
  SELECT CAST(epoch(start) AS BIGINT) AS start, smell, count(*) AS reviews, count(*) FILTER (severity > 0) AS positive FROM w, m WHERE start + INTERVAL 7 DAY <= mark GROUP BY start, smell""")  # fmt: skip
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly counts that the watermark has made final."""
    path = scratch(spark)
    rows = reviews(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"{path}/in")
    live = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    out = _final(stream.counts_by_window(live), path)
    return out.select(F.col("start").cast("long").alias("start"), "smell", "reviews", "positive")


@query(_P + """, c AS (SELECT seed, count(*) FILTER (y = 1 AND prob >= 0.5) AS tp, count(*) FILTER (y = 0 AND prob >= 0.5) AS fp, count(*) FILTER (y = 1 AND prob < 0.5) AS fn, count(*) FILTER (y = 0 AND prob < 0.5) AS tn FROM predictions WHERE part = 'test' GROUP BY seed)
  SELECT seed, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE)) * sqrt(CAST(tp + fn AS DOUBLE)) * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn AS DOUBLE)), 0), 0), 6) AS mcc FROM c""", signed=("mcc",))  # fmt: skip
def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL text over a registered view with registered functions."""
    register(spark, sf_dir)
    return spark.sql("""SELECT seed, round(f1_score(tp, fp, fn), 6) AS f1, round(mcc_score(tp, fp, fn, tn), 6) AS mcc FROM (
      SELECT seed, count_if(y = 1 AND prob >= 0.5) AS tp, count_if(y = 0 AND prob >= 0.5) AS fp, count_if(y = 1 AND prob < 0.5) AS fn, count_if(y = 0 AND prob < 0.5) AS tn FROM predictions WHERE part = 'test' GROUP BY seed)""")


@query("SELECT 'predictions' AS name, count(*) AS rows FROM lineitem UNION ALL SELECT 'reviews', count(*) FROM events UNION ALL SELECT 'scores', 3 * count(*) FROM lineitem UNION ALL SELECT 'snippets', count(*) FROM documents")
def sql_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered views, as the session's catalog has them, with their rows."""
    register(spark, sf_dir)
    names = sorted(t.name for t in spark.catalog.listTables() if t.name in ("predictions", "reviews", "scores", "snippets"))
    counts = [spark.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in names]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionAll(more)
    return out
