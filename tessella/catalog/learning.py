"""Queries on trained models and what surrounds them: SQL for what training doesn't decide, repeated runs for the rest."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.functions.scalar import rounded
from tessella.operators import conditional, metrics, models, skipgram, splits, text
from tessella.views import predictions, read, reviews, snippets, with_views

_N = with_views("snippets")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size FROM part), m AS (SELECT median(size) AS m FROM p WHERE p_partkey % 2 = 1)
  SELECT CAST(p_partkey AS BIGINT) AS p_partkey, coalesce(size, m) AS size FROM p, m""")  # fmt: skip
def median_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values as the median of the training rows, which here are the odd ones."""
    missing = F.when(F.col("p_partkey") % 12 == 0, F.lit(float("nan")))
    size = F.when(F.col("p_partkey") % 6 != 0, F.col("p_size").cast("double")).otherwise(missing)
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), size.alias("size"))
    return models.imputed(rows, rows.where("p_partkey % 2 = 1"), ["size"])


@query("WITH c AS (SELECT quality, count(*) AS k FROM labels GROUP BY quality), n AS (SELECT sum(k) AS n, count(*) AS c FROM c) SELECT CAST(doc_id AS BIGINT) AS doc_id, round(n / (n.c * k), 6) AS weight FROM labels JOIN c ON c.quality = labels.quality, n")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    return models.class_weights(rows, "quality").select("doc_id", F.round("weight", 6).alias("weight"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 0.5::DOUBLE * p_size AS size, round(-0.001::DOUBLE * p_retailprice, 6) AS price, round(0.5::DOUBLE * p_size - 0.001::DOUBLE * p_retailprice, 6) AS total FROM part", signed=("price", "total"))
def linear_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's part of a linear score, and the score."""
    parts = models.linear_contributions({"p_size": 0.5, "p_retailprice": -0.001})
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), parts.alias("c"))
    return rows.select("p_partkey", F.col("c")["p_size"].alias("size"), F.round(F.col("c")["p_retailprice"], 6).alias("price"), F.round(F.col("c")["p_size"] + F.col("c")["p_retailprice"], 6).alias("total"))


_TOKEN = text.TOKEN.replace("'", "''")


@query(_N + f""", w AS (SELECT json_index, unnest(regexp_extract_all(coalesce(code, ''), '{_TOKEN}')) AS t FROM snippets), v AS (SELECT t FROM w GROUP BY t HAVING count(*) >= 2)
  SELECT CAST(w.json_index AS BIGINT) AS json_index, round(avg(CASE WHEN v.t IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unknown, 16 AS width FROM w LEFT JOIN v ON v.t = w.t GROUP BY w.json_index""")  # fmt: skip
def attached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip-gram vectors of tokens that occur twice, averaged over each text, with the share of tokens without one."""
    # labels only matter where they repeat a text; without such, texts don't move to meet them
    again = read(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    found = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("json_index"), F.col("text").alias("code")) if again.isEmpty() else snippets(spark, sf_dir)
    rows = found.select(F.col("json_index").cast("long").alias("json_index"), text.tokens(F.col("code")).alias("tokens"))
    return skipgram.text_vectors(rows, "json_index", "tokens", 16, 2).select("json_index", rounded("unknown").alias("unknown"), F.size("vector").alias("width")).where("unknown is not null")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated texts with four numbers and a seeded fold."""
    rows = snippets(spark, sf_dir).where("y0 is not null and code is not null")
    code = F.col("code")
    marks = F.char_length(F.regexp_replace(code, r"[^!|#$%&*]", "")).cast("double") / F.greatest(F.lit(1), F.char_length(code))
    held = rows.select(F.col("json_index").cast("long").alias("json_index"), "level", F.col("y0").alias("y"), F.char_length(code).cast("double").alias("chars"), F.size(F.split(code, "\n", -1)).cast("double").alias("lines"), marks.alias("marks"))
    return splits.stratified_folds(held, "json_index", ["y"], 3)


_FEATURES = ["chars", "lines", "marks"]


def _auc(rows: DataFrame) -> float:
    return metrics.roc_auc(rows.withColumn("all", F.lit(1)), ["all"]).first().roc_auc or 0.0


@query()
def transfer_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of a model trained on one level's texts on every level's."""
    rows = _sized(spark, sf_dir)
    out = []
    for a in ("class", "method"):
        train = rows.where((F.col("level") == a) & (F.col("fold") > 0))
        fitted = models.fit(train, _FEATURES, "y", "logistic")
        out += [(a, b, round(_auc(models.predicted(fitted, rows.where((F.col("level") == b) & (F.col("fold") == 0)), train, _FEATURES)), 4)) for b in ("class", "method")]
    return spark.createDataFrame(out, "trained_on string, tested_on string, auc double")


@query()
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each fold the model that validates best on the next fold, and its AUC on the fold itself."""
    rows = _sized(spark, sf_dir)
    out = []
    for fold in range(2):
        test, val = rows.where(F.col("fold") == fold), rows.where(F.col("fold") == (fold + 1) % 3)
        train = rows.where(F.col("fold") == (fold + 2) % 3)
        name, score = models.select(train, val, _FEATURES, "y", ["logistic", "tree"])
        out.append((fold, name, round(score, 4), round(_auc(models.predicted(models.fit(train, _FEATURES, "y", name), test, train, _FEATURES)), 4)))
    return spark.createDataFrame(out, "fold int, model string, validation double, auc double")


@query()
def surrogate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a tree of two levels on the features says what the model says."""
    rows = _sized(spark, sf_dir)
    said = models.predicted(models.fit(rows, _FEATURES, "y", "logistic"), rows, rows, _FEATURES).withColumn("label", (F.col("p") >= 0.5).cast("double"))
    held = VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(said)
    tree = DecisionTreeClassifier(maxDepth=2, seed=0).fit(held)
    agree = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return tree.transform(held).agg(F.count("*").alias("n"), F.round(agree, 4).alias("fidelity")).withColumn("nodes", F.lit(tree.numNodes))


@query()
def threshold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold rules bred for F1 on the rated texts."""
    rules = models.evolve(_sized(spark, sf_dir), _FEATURES, "y", generations=2, population=8)
    return spark.createDataFrame([(i, c, op, round(v, 4)) for i, (c, op, v) in enumerate(rules)], "rule int, feature string, op string, value double")


@query()
def learned_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a model sends to the costly judge, a quarter of each seed: where the cheap one errs and the costly one doesn't."""
    rows = predictions(spark, sf_dir).where("part = 'test' and seed <= 2").withColumns({"sure": F.abs(F.col("prob") - 0.5), "better": (((F.col("prob") >= 0.5) != (F.col("y") == 1)) & ((F.col("prob2") >= 0.5) == (F.col("y") == 1))).cast("int")})
    train = rows.where("fold < 4")
    fitted = models.fit(train, ["prob", "sure", "effort"], "better", "logistic")
    told = models.predicted(fitted, rows.where("fold = 4"), train, ["prob", "sure", "effort"]).select("seed", "y", "prob", "prob2", "p")
    cut = told.groupBy("seed").agg(F.percentile("p", F.lit(0.75)).alias("cut"))
    routed = told.join(F.broadcast(cut), "seed").withColumn("routed", F.col("p") > F.col("cut"))  # a row for each seed
    after = F.when(F.col("routed"), F.col("prob2")).otherwise(F.col("prob")) >= 0.5
    return routed.groupBy("seed").agg(F.count("*").alias("n"), F.count_if("routed").alias("routed"), F.count_if((F.col("prob") >= 0.5) == (F.col("y") == 1)).alias("right_before"), F.count_if(after == (F.col("y") == 1)).alias("right_after"))


@query()
def reviewer_adjusted_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether groups of reviewers differ once units and the order of reviews in them are taken into account."""
    order = Window.partitionBy("smell", "sample").orderBy("ts", "id")
    rows = reviews(spark, sf_dir).where("severity is not null and smell < 2")
    held = rows.select((F.col("sample") * 4 + F.col("smell")).alias("unit"), (F.col("reviewer") % 6).alias("reviewer"), (F.col("severity") > 0).cast("int").alias("y"), (F.row_number().over(order) > 1).cast("double").alias("later"))
    got = conditional.reviewer_test(held, "unit", "reviewer", "y", ["later"], 5)
    return spark.createDataFrame([(got["reviewers"], got["dof"], round(got["statistic"], 4), round(got["p"], 4), got["units"])], "reviewers int, dof int, statistic double, p double, units int")
