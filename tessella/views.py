"""The driver's tables in the shapes that the operators take, as DataFrames and as SQL.

reviews: one reviewer's severity (0 to 3, null if unknown) for one smell of one sample.
predictions: one model's probability for one sample in a fold of a seed, with its label and effort.
scores: the three models' probabilities of each prediction row, one below the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalar import rounded
from tessella.plans.lineage import reachable

#: SQL of each view; `with_views` puts those a query needs before it.
SQL = {
    "reviews": """SELECT event_id AS id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS sample, user_id % 4 AS smell, user_id AS reviewer, ts,
      CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 END AS severity FROM events""",
    "predictions": """SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, CAST(l_linenumber AS BIGINT) AS seed, l_orderkey % 5 AS fold,
      CASE WHEN l_partkey % 3 = 0 THEN 'val' ELSE 'test' END AS part, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
      least(1.0, round(l_extendedprice / 1e5, 6)) AS prob, least(1.0, round(l_discount * 10, 6)) AS prob2, least(1.0, round(l_tax * 12.5, 6)) AS prob3, l_quantity AS effort FROM lineitem""",
    "scores": """SELECT 'a' AS model, k1, k2, k3, k4, seed, fold, part, y, prob AS p, effort FROM predictions
      UNION ALL SELECT 'b', k1, k2, k3, k4, seed, fold, part, y, prob2, effort FROM predictions
      UNION ALL SELECT 'c', k1, k2, k3, k4, seed, fold, part, y, prob3, effort FROM predictions""",
    "snippets": """SELECT d.doc_id AS json_index, d.text AS code, d.source AS repo, CASE WHEN d.lang = 'en' THEN 'method' ELSE 'class' END AS level, l.quality AS y0, l.toxic AS y1
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
}
NEEDS = {"scores": ("predictions",)}


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause, without what follows it, of the named views and those they need."""
    order: list[str] = []
    for name in names:
        order += [x for x in (*NEEDS.get(name, ()), name) if x not in order]
    return "WITH " + "RECURSIVE " * recursive + ", ".join(f"{x} AS ({SQL[x]})" for x in order)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in {"view": 0, "click": 1, "purchase": 2, "error": 3}.items() for x in kv]), F.col("event_type"))
    known = F.when(F.col("event_type").isin("view", "click", "purchase", "error"), severity)
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("sample"), (F.col("user_id") % 4).alias("smell"), F.col("user_id").alias("reviewer"), "ts", known.alias("severity")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1.0)
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"),
        F.col("l_linenumber").cast("long").alias("seed"), (F.col("l_orderkey") % 5).alias("fold"),
        F.when(F.col("l_partkey") % 3 == 0, "val").otherwise("test").alias("part"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.least(one, rounded(F.col("l_extendedprice") / 1e5)).alias("prob"), F.least(one, rounded(F.col("l_discount") * 10)).alias("prob2"), F.least(one, rounded(F.col("l_tax") * 12.5)).alias("prob3"),
        F.col("l_quantity").alias("effort"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpivoted with one scan."""
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in (("a", "prob"), ("b", "prob2"), ("c", "prob3"))])).alias("m")
    rows = predictions(spark, sf_dir).select("k1", "k2", "k3", "k4", "seed", "fold", "part", "y", "effort", models)
    return rows.select("m.model", "k1", "k2", "k3", "k4", "seed", "fold", "part", "y", "m.p", "effort")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y0"), F.col("toxic").alias("y1"))
    docs = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("json_index"), F.col("text").alias("code"), F.col("source").alias("repo"), F.when(F.col("lang") == "en", "method").otherwise("class").alias("level"), "y0", "y1")


#: Functions for SQL texts, by the expressions that the operators use.
FUNCTIONS = {
    "f1_score": "(tp BIGINT, fp BIGINT, fn BIGINT) RETURNS DOUBLE RETURN CASE WHEN 2 * tp + fp + fn <> 0 THEN 2D * tp / (2 * tp + fp + fn) ELSE 0D END",
    "mcc_score": "(tp BIGINT, fp BIGINT, fn BIGINT, tn BIGINT) RETURNS DOUBLE RETURN CASE WHEN sqrt(double(tp + fp)) * sqrt(double(tp + fn)) * sqrt(double(tn + fp)) * sqrt(double(tn + fn)) <> 0 THEN (double(tp) * tn - double(fp) * fn) / (sqrt(double(tp + fp)) * sqrt(double(tp + fn)) * sqrt(double(tn + fp)) * sqrt(double(tn + fn))) ELSE 0D END",
    "repo_slug": "(url STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(regexp_replace(trim(url), '^(?:[a-zA-Z+]+://)?(?:[^/@]*@)?', ''), '(?:\\\\.git)?/*$', ''), '^([^/:]+):', '$1/')",
}


def register(spark: SparkSession, sf_dir: str) -> None:
    """The views and functions under their names, for SQL texts of this session: reviews, predictions, scores, snippets."""
    for f in (reviews, predictions, scores, snippets):
        f(spark, sf_dir).createOrReplaceTempView(f.__name__)
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
