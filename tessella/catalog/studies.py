"""Queries that compose the operators into studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.functions.scalar import f1, ratio
from tessella.operators import labels, metrics, splits
from tessella.views import predictions, read, reviews, scores, with_views

_P = with_views("predictions")
_F1 = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"


# a text cites evidence if it names a number; its outcome is the quality label against a guess by length
@query(r"""WITH d AS (SELECT l.quality AS y, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS said, regexp_matches(coalesce(d.text, ''), '[0-9]{3,}') AS cites, length(coalesce(d.text, '')) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
  SELECT CASE WHEN y = 1 AND said = 1 THEN 'TP' WHEN y = 1 THEN 'FN' WHEN said = 1 THEN 'FP' ELSE 'TN' END AS outcome, count(*) AS n, round(avg(CASE WHEN cites THEN 1.0 ELSE 0.0 END), 6) AS cites, CAST(sum(n) AS BIGINT) AS chars FROM d GROUP BY 1""")  # fmt: skip
def outcome_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    y, said = F.col("quality") == 1, F.col("n_chars") >= 1000
    outcome = F.when(y & said, "TP").when(y, "FN").when(said, "FP").otherwise("TN")
    text = F.coalesce("text", F.lit(""))
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg(text.rlike("[0-9]{3,}").cast("double")), 6).alias("cites"), F.sum(F.char_length(text)).alias("chars"))


@query("""WITH p AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY source), s AS (SELECT *, ntile(4) OVER (ORDER BY size, source) AS stratum FROM p),
  r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || source), source) AS r FROM s) SELECT source, size, stratum FROM r WHERE r <= 2""")  # fmt: skip
def project_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = read(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("size"))
    return splits.stratum_sample(projects, "source", "size", 4, 2)


@query("""WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('0:' || doc_id), doc_id) AS r, (SELECT sum(toxic) FROM labels) AS p FROM labels) SELECT doc_id, toxic FROM r WHERE toxic = 1 OR r <= floor(1.5 * p)""")
def positives_with_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.with_negatives(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 1.5)


# members of an order are its own if they come from its first supplier
@query("""WITH f AS (SELECT l_orderkey, min(l_suppkey) AS own FROM lineitem GROUP BY l_orderkey), c AS (SELECT l.l_orderkey, count(*) FILTER (l_suppkey = own) AS own_access, count(*) FILTER (l_suppkey <> own) AS foreign_access,
    count(DISTINCT l_suppkey) FILTER (l_suppkey <> own) AS providers FROM lineitem l JOIN f ON f.l_orderkey = l.l_orderkey GROUP BY l.l_orderkey)
  SELECT l_orderkey, own_access, foreign_access, providers, round(foreign_access / (own_access + foreign_access), 6) AS foreign_share, foreign_access > own_access AND providers <= 2 AS envies FROM c""")  # fmt: skip
def access_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    own = items.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("own"))
    foreign = F.col("l_suppkey") != F.col("own")
    counts = items.join(own, "l_orderkey").groupBy("l_orderkey").agg(F.count_if(~foreign).alias("own_access"), F.count_if(foreign).alias("foreign_access"), F.countDistinct(F.when(foreign, F.col("l_suppkey"))).alias("providers"))
    a, b = F.col("own_access"), F.col("foreign_access")
    return counts.withColumns({"foreign_share": F.round(ratio(b, a + b), 6), "envies": (b > a) & (F.col("providers") <= 2)})


# rows of small effort stand for the minor positives
@query(_P + """, k AS (SELECT seed, fold, y, prob FROM predictions WHERE part = 'test' AND NOT (y = 1 AND effort < 10)),
  c AS (SELECT seed, fold, count(*) FILTER (y = 1 AND prob >= 0.5) AS tp, count(*) FILTER (y = 0 AND prob >= 0.5) AS fp, count(*) FILTER (y = 1 AND prob < 0.5) AS fn FROM k GROUP BY seed, fold),
  s AS (SELECT seed, avg(""" + _F1 + """) AS f FROM c GROUP BY seed) SELECT count(*) AS seeds, round(avg(f), 6) AS f1, round(stddev_samp(f), 6) AS f1_sd FROM s""")  # fmt: skip
def without_minor_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).where("part = 'test' and not (y = 1 and effort < 10)")
    cells = metrics.confusion(rows, ["seed", "fold"], F.col("prob") >= 0.5).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    out = metrics.seed_average(cells.withColumn("all", F.lit(1)), ["all"], ["f1"])
    return out.select("seeds", F.round("f1", 6).alias("f1"), F.round("f1_sd", 6).alias("f1_sd"))


@query(with_views("scores") + """, e AS (SELECT model, seed, CAST(floor(effort / 10) AS BIGINT) AS bin, avg(CASE WHEN (p >= 0.5) <> (y = 1) THEN 1.0 ELSE 0.0 END) AS err, count(*) AS n FROM scores WHERE part = 'test' GROUP BY 1, 2, 3)
  SELECT model, bin, CAST(sum(n) AS BIGINT) AS rows, round(avg(err), 6) AS error FROM e GROUP BY model, bin""")  # fmt: skip
def error_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).where("part = 'test'").withColumn("bin", F.floor(F.col("effort") / 10))
    wrong = ((F.col("p") >= 0.5) != (F.col("y") == 1)).cast("double")
    seeds = rows.groupBy("model", "bin", "seed").agg(F.avg(wrong).alias("error"), F.count("*").alias("n"))
    return seeds.groupBy("model", "bin").agg(F.sum("n").alias("rows"), F.round(F.avg("error"), 6).alias("error"))


@query(with_views("reviews") + """, r AS (SELECT *, row_number() OVER (PARTITION BY sample, smell, reviewer ORDER BY ts DESC, id DESC, severity DESC) AS n FROM reviews WHERE severity IS NOT NULL),
  s AS (SELECT sample, smell, avg(CASE WHEN severity > 0 THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM r WHERE n = 1 GROUP BY sample, smell HAVING count(*) >= 2),
  u AS (SELECT sample, smell, list_sort(list(severity)) AS s FROM reviews WHERE severity IS NOT NULL GROUP BY sample, smell), y AS (SELECT sample, smell, CASE WHEN s[len(s) // 2 + 1] > 0 THEN 1 ELSE 0 END AS y FROM u)
  SELECT smell, count(*) AS units, round(avg(2 * abs(y - share)), 6) AS manhattan, round(avg(pow(y - share, 2)), 6) AS brier, round(avg(share), 6) AS mean_share, round(avg(y), 6) AS consensus FROM s JOIN y USING (sample, smell) GROUP BY smell""")  # fmt: skip
def share_vs_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    both = labels.review_share(rows).where("reviewers >= 2").join(labels.unit_labels(rows), ["sample", "smell"])
    gap = F.col("y") - F.col("share")
    mean = lambda c: F.round(F.avg(c), 6)
    return both.groupBy("smell").agg(F.count("*").alias("units"), mean(2 * F.abs(gap)).alias("manhattan"), mean(gap * gap).alias("brier"), mean("share").alias("mean_share"), mean("y").alias("consensus"))


@query(with_views("reviews") + """, f AS (SELECT sample, smell, severity, lead(severity) OVER (PARTITION BY sample, smell ORDER BY ts, id) AS next FROM reviews WHERE severity IS NOT NULL)
  SELECT severity, next, count(*) AS n FROM f WHERE next IS NOT NULL GROUP BY severity, next""")  # fmt: skip
def severity_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    after = F.lead("severity").over(Window.partitionBy("sample", "smell").orderBy("ts", "id"))
    rows = reviews(spark, sf_dir).where("severity is not null").withColumn("next", after).where("next is not null")
    return rows.groupBy("severity", "next").agg(F.count("*").alias("n"))
