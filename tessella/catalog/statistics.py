"""Queries on association, quantiles, dynamics, neighbours and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.functions.scalar import rounded
from tessella.operators import cartography, neighbours, splits, statistics
from tessella.plans.lineage import stored
from tessella.views import predictions, read, snippets, with_views

_P = with_views("predictions")


@query(_P + """, r AS (SELECT seed, rank() OVER (PARTITION BY seed ORDER BY prob) + (count(*) OVER (PARTITION BY seed, prob) - 1) / 2 AS a,
  rank() OVER (PARTITION BY seed ORDER BY effort) + (count(*) OVER (PARTITION BY seed, effort) - 1) / 2 AS b FROM predictions)
  SELECT seed, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY seed""", signed=("rho",))  # fmt: skip
def spearman_score_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.spearman(predictions(spark, sf_dir), ["seed"], "prob", "effort").withColumn("rho", F.round("rho", 6))


def _smd_sql(c: str) -> str:
    return f"round((avg({c}) FILTER (y = 1) - avg({c}) FILTER (y = 0)) / nullif(sqrt((var_samp({c}) FILTER (y = 1) + var_samp({c}) FILTER (y = 0)) / 2), 0), 6) AS {c}"


@query(_P + f" SELECT seed, {', '.join(map(_smd_sql, ('prob', 'prob2', 'effort')))} FROM predictions GROUP BY seed", signed=("prob", "prob2", "effort"))
def smd_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.smd(predictions(spark, sf_dir), ["seed"], ["prob", "prob2", "effort"])
    return out.withColumns({c: F.round(c, 6) for c in ("prob", "prob2", "effort")})


@query(_P + " SELECT seed, round(quantile_cont(prob, 0.25), 8) AS q25, round(quantile_cont(prob, 0.5), 8) AS q50, round(quantile_cont(prob, 0.95), 8) AS q95 FROM predictions GROUP BY seed")
def linear_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.quantile_ranks(predictions(spark, sf_dir), ["seed"], "prob", [0.25, 0.5, 0.95])
    return out.withColumns({c: F.round(c, 8) for c in ("q25", "q50", "q95")})


def _rank_quantiles(at: str) -> str:
    picks = ", ".join(f"max(prob) FILTER (r = {at.format(q=q)}) AS q{round(100 * q)}" for q in (0.5, 0.9, 0.99))
    return _P + f", r AS (SELECT seed, prob, row_number() OVER (PARTITION BY seed ORDER BY prob) - 1 AS r, count(*) OVER (PARTITION BY seed) AS n FROM predictions) SELECT seed, {picks} FROM r GROUP BY seed"


@query(_rank_quantiles("round_even({q} * (n - 1), 0)"))
def half_even_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.quantile_ranks(predictions(spark, sf_dir), ["seed"], "prob", [0.5, 0.9, 0.99], "half_even")


@query(_rank_quantiles("floor({q} * (n - 1))"))
def floor_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.quantile_ranks(predictions(spark, sf_dir), ["seed"], "prob", [0.5, 0.9, 0.99], "floor")


# a lineitem's order stands for the sample, its seed for the epoch, the model for the item
_DYN = with_views("scores") + """, i AS (SELECT k1, model, CASE WHEN y = 1 THEN p ELSE 1 - p END AS r FROM scores),
  c AS (SELECT k1, model, avg(r) AS c, stddev_pop(r) AS v, avg(CASE WHEN r >= 0.5 THEN 1.0 ELSE 0.0 END) AS k FROM i GROUP BY k1, model),
  s AS (SELECT k1, count(*) AS items, round(avg(c), 9) AS confidence, round(avg(v), 9) AS variability, round(avg(k), 9) AS correctness FROM c GROUP BY k1)"""  # fmt: skip


@query(_DYN + """, q AS (SELECT quantile_cont(confidence, 0.25) AS l, quantile_cont(confidence, 0.75) AS h, quantile_cont(variability, 0.75) AS v FROM s)
  SELECT CASE WHEN variability > q.v THEN 'ambiguous' WHEN confidence <= q.l THEN 'hard' WHEN confidence >= q.h THEN 'easy' ELSE 'other' END AS region, count(*) AS samples,
  round(avg(confidence), 6) AS confidence, round(avg(correctness), 6) AS correctness FROM s, q GROUP BY 1""")  # fmt: skip
def cartography_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an order's lines meet before they become three rows each, and its items stay where they are
    lines = predictions(spark, sf_dir).select("k1", "y", "prob", "prob2", "prob3").repartition("k1")
    items = F.inline(F.array(*[F.struct(F.lit(m).alias("item"), F.col(c).alias("p")) for m, c in (("a", "prob"), ("b", "prob2"), ("c", "prob3"))]))
    told = cartography.dynamics(lines.select("k1", "y", items), ["k1"])
    samples = stored(told.select(*[rounded(c, 9).alias(c) for c in ("confidence", "variability", "correctness")])).withColumn("all", F.lit(1))
    out = cartography.regions(samples, ["all"]).groupBy("region")
    return out.agg(F.count("*").alias("samples"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("correctness"), 6).alias("correctness"))


_KNN = """WITH p AS (SELECT a.vec_id, b.vec_id AS other, b.label, list_reduce(list_concat([0.0::DOUBLE], list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), lambda s, x: s + x) AS d2
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, other) AS rank FROM p)"""  # fmt: skip


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 5, 16)


@query(_KNN + " SELECT vec_id, other, rank, round(d2, 6) AS d2 FROM r WHERE rank <= 5")
def knn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir).withColumn("d2", F.round("d2", 6))


@query(_KNN + """, v AS (SELECT vec_id, label, count(*) AS n FROM r WHERE rank <= 5 GROUP BY vec_id, label), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS k FROM v)
  SELECT vec_id, label AS said, n AS votes FROM b WHERE k = 1""")  # fmt: skip
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.vote(_knn(spark, sf_dir), read(spark, sf_dir, "embeddings"), "vec_id", "label")


@query(_P + """, b AS (SELECT (prob >= 0.25)::INT + (prob >= 0.5)::INT + (prob >= 0.75)::INT AS bin_prob, (effort >= 10)::INT + (effort >= 25)::INT AS bin_effort, y FROM predictions)
  SELECT bin_prob, bin_effort, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg, round(count(*) FILTER (y = 1) / count(*) FILTER (y = 0), 6) AS weight FROM b GROUP BY bin_prob, bin_effort
  HAVING count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0""")  # fmt: skip
def coarsened_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbours.coarsened(predictions(spark, sf_dir), {"prob": [0.25, 0.5, 0.75], "effort": [10, 25]})
    return out.withColumn("weight", F.round("weight", 6))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS st, o_totalprice AS v, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders),
  p AS (SELECT a.id, b.id AS other, abs(a.v - b.v) AS gap, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.v - b.v), b.id) AS n FROM o a JOIN o b ON a.st = b.st AND a.y = 1 AND b.y = 0 AND abs(a.v - b.v) <= 20)
  SELECT id, other, round(gap, 6) AS gap FROM p WHERE n = 1""")  # fmt: skip
def caliper_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("st"), F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return neighbours.caliper(rows, "id", "st", "v", 20.0).withColumn("gap", F.round("gap", 6))


# a reviewer's monthly mean stands for an epoch's validation score
_HIST = """WITH h AS (SELECT user_id AS run, CAST(floor(event_id / 500) AS BIGINT) AS epoch, round(avg(value), 9) AS score FROM events GROUP BY 1, 2),
  b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM h),
  m AS (SELECT *, max(CASE WHEN past IS NULL OR score > past THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM b),
  s AS (SELECT run, min(epoch) AS stop FROM m WHERE epoch - last >= 5 GROUP BY run)"""  # fmt: skip


@query(_HIST + """ SELECT m.run, max(m.epoch) AS epoch, round(max(m.score), 6) AS score FROM m LEFT JOIN s ON s.run = m.run WHERE (stop IS NULL OR epoch <= stop) AND (past IS NULL OR score > past) GROUP BY m.run""")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), F.floor(F.col("event_id") / 500).alias("epoch")).agg(F.round(F.avg("value"), 9).alias("score"))
    return statistics.best_epoch(history, ["run"], "epoch", "score", 5).withColumn("score", F.round("score", 6))


_S = with_views("snippets")
_FOLDS = _S + ", f AS (SELECT json_index, repo, level, y0, y1, (row_number() OVER (PARTITION BY y0, y1, level ORDER BY md5('0:' || json_index), json_index) - 1) % 5 AS fold FROM snippets)"


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snippets(spark, sf_dir).select("json_index", "repo", "level", "y0", "y1")
    return splits.stratified_folds(rows, "json_index", ["y0", "y1", "level"], 5)


@query(_FOLDS + " SELECT * FROM f")
def stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds(spark, sf_dir)


@query(_S + """, g AS (SELECT repo, (dense_rank() OVER (ORDER BY md5('0:' || repo), repo) - 1) % 5 AS fold FROM (SELECT DISTINCT repo FROM snippets)) SELECT json_index, s.repo, fold FROM snippets s JOIN g ON g.repo = s.repo""")
def group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_folds(snippets(spark, sf_dir).select("json_index", "repo"), "repo", 5).select("json_index", "repo", "fold")


@query(_S + " SELECT json_index, repo, dense_rank() OVER (ORDER BY repo) - 1 AS fold FROM snippets")
def leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leave_one_group_out(snippets(spark, sf_dir).select("json_index", "repo"), "repo").select("json_index", "repo", "fold")


@query(_S + """, r AS (SELECT json_index, level, row_number() OVER (PARTITION BY level ORDER BY md5('3:' || json_index), json_index) AS r, count(*) OVER (PARTITION BY level) AS n FROM snippets)
  SELECT json_index, level FROM r WHERE r <= ceil(0.3 * n)""")  # fmt: skip
def nested_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.nested_subset(snippets(spark, sf_dir).select("json_index", "level"), "json_index", ["level"], 0.3, 3)


@query(_FOLDS + """, p AS (SELECT (SELECT count(*) FROM snippets s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.json_index = s.json_index)) AS missing,
  (SELECT count(*) FROM (SELECT json_index FROM f GROUP BY json_index HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM f WHERE NOT EXISTS (SELECT 1 FROM snippets s WHERE s.json_index = f.json_index)) AS unknown) SELECT * FROM p""")  # fmt: skip
def split_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_problems(folds(spark, sf_dir), "json_index", snippets(spark, sf_dir))


@query("""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('1:' || doc_id), doc_id) AS r FROM labels) SELECT doc_id, quality FROM r WHERE quality <> 1 OR r <= 50""")
def capped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.capped(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", {1: 50}, 1)


@query("SELECT doc_id, quality FROM labels WHERE doc_id % 4 = 1")
def round_robin_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.round_robin(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", 4, 1)
