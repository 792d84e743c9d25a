"""Queries on filters and checked joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.operators import filters, joins, labels, metrics
from tessella.views import predictions, read, reviews, scores, with_views

_LINK = """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0)"""


@query(_LINK + """ SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS linked, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS left_only, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS right_only""")
def linkage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return joins.linkage(left, read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


_M = with_views("reviews") + """, u AS (SELECT sample, smell, list_sort(list(severity) FILTER (severity IS NOT NULL)) AS s FROM reviews GROUP BY sample, smell),
  a AS (SELECT sample, smell, CASE WHEN coalesce(s[len(s) // 2 + 1], 0) > 0 THEN 1 ELSE 0 END AS y FROM u), b AS (SELECT sample, smell, CASE WHEN coalesce(s[len(s) // 2 + 1], 0) > 1 THEN 1 ELSE 0 END AS y FROM u)"""  # fmt: skip


@query(_M + """ SELECT coalesce(a.sample, b.sample) AS sample, coalesce(a.smell, b.smell) AS smell, CASE WHEN a.y IS NULL THEN 'added' WHEN b.y IS NULL THEN 'missing' ELSE 'changed' END AS status,
  CASE WHEN a.y IS NOT NULL AND b.y IS NOT NULL THEN 'y' ELSE '' END AS columns FROM a FULL JOIN b ON a.sample = b.sample AND a.smell = b.smell WHERE a.y IS DISTINCT FROM b.y""")  # fmt: skip
def label_rule_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    return joins.differences(labels.unit_labels(rows), labels.unit_labels(rows, rule="ds2"), ["sample", "smell"], ["y"])


@query(with_views("scores") + """, h AS (SELECT * FROM scores WHERE part = 'test' AND p > 0),
  c AS (SELECT k1, k2, k3, k4 FROM h GROUP BY ALL HAVING count(DISTINCT model) = 3) SELECT model, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM h SEMI JOIN c USING (k1, k2, k3, k4) GROUP BY model""")  # fmt: skip
def common_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = scores(spark, sf_dir).where("part = 'test' and p > 0")
    return joins.in_all(held, ["k1", "k2", "k3", "k4"], "model", 3).groupBy("model").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"))


_Y = with_views("reviews") + """, u AS (SELECT sample, smell, list_sort(list(severity) FILTER (severity IS NOT NULL)) AS s FROM reviews GROUP BY sample, smell), y AS (SELECT sample, smell, smell // 2 AS level, CASE WHEN coalesce(s[len(s) // 2 + 1], 0) > 0 THEN 1 ELSE 0 END AS y FROM u)"""


@query(_Y + """ SELECT a.smell, b.smell AS other, count(*) AS n, CAST(sum(a.y * b.y) AS BIGINT) AS both_positive FROM y a JOIN y b ON a.sample = b.sample AND a.level = b.level AND a.smell <> b.smell GROUP BY a.smell, b.smell""")
def sibling_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.unit_labels(reviews(spark, sf_dir)).withColumn("level", F.floor(F.col("smell") / 2))
    return joins.siblings(rows, "sample", "level", "smell", "y").groupBy("smell", "other").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y_other")).cast("long").alias("both_positive"))


@query("""WITH o AS (SELECT lang, source, md5('0:' || source) AS p, min(doc_id) AS f FROM documents GROUP BY lang, source),
  r AS (SELECT lang, source, coalesce(lead(f) OVER w, first_value(f) OVER (PARTITION BY lang ORDER BY p, source)) AS donor, count(*) OVER (PARTITION BY lang) AS n FROM o WINDOW w AS (PARTITION BY lang ORDER BY p, source))
  SELECT d.doc_id, r.donor FROM documents d JOIN r ON r.lang = d.lang AND r.source = d.source WHERE n > 1""")  # fmt: skip
def donor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.donors(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang"], "source")


@query("""WITH m AS (SELECT o_custkey, max(o_totalprice) AS x, sum(o_totalprice) AS s, avg(o_totalprice) AS a, count(*) AS n FROM orders GROUP BY o_custkey)
  SELECT c_custkey, round(coalesce(x, 0), 4) AS price_max, round(coalesce(s, 0), 4) AS price_sum, round(coalesce(a, 0), 4) AS price_avg, coalesce(n, 0) AS method_count FROM customer LEFT JOIN m ON o_custkey = c_custkey""")  # fmt: skip
def method_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("price"))
    out = joins.method_aggregates(read(spark, sf_dir, "customer").select("c_custkey"), methods, "c_custkey", ["price"])
    return out.withColumns({c: F.round(c, 4) for c in ("price_max", "price_sum", "price_avg")})


@query("""WITH r AS (SELECT o_custkey % 20 AS arch, o_orderkey, o_totalprice, o_custkey % 50 AS epochs FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY arch ORDER BY o_totalprice DESC, o_orderkey) AS n FROM r WHERE epochs >= 10)
  SELECT arch, o_orderkey, o_totalprice, epochs FROM b WHERE n = 1""")  # fmt: skip
def best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("arch"), "o_orderkey", "o_totalprice", (F.col("o_custkey") % 50).alias("epochs"))
    return joins.best_runs(runs, "arch", "o_totalprice", "o_orderkey", "epochs", 10)


@query(with_views("scores") + """, e AS (SELECT *, k3 % 2 AS level FROM scores WHERE part = 'test'), f AS (SELECT * FROM e WHERE (model = 'a' AND level = 0) OR (model = 'b' AND level = 1) OR model = 'c')
  SELECT model, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM f GROUP BY model""")  # fmt: skip
def eligible_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).where("part = 'test'").withColumn("level", (F.col("k3") % 2).cast("string"))
    held = filters.eligible(rows, {"a": "0", "b": "1", "c": None}, "model")
    return metrics.confusion(held, ["model"], F.col("p") >= 0.5)


@query(with_views("predictions") + """, g AS (SELECT k1, count(*) AS n, min(y) AS a, max(y) AS b FROM predictions GROUP BY k1) SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS rows FROM g WHERE a < b""")
def single_class_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = filters.both_classes(predictions(spark, sf_dir).select("k1", "y"), ["k1"])
    return held.groupBy("k1").agg(F.count("*").alias("n")).agg(F.count("*").alias("cells"), F.sum("n").alias("rows"))


@query("""WITH r AS (SELECT source, lang, doc_id, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM documents),
  o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS m FROM r WHERE n <= 3) SELECT source, lang, doc_id FROM o WHERE m <= 8""")  # fmt: skip
def capped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return filters.capped_lists(rows, "source", "lang", [F.desc("n_chars"), F.col("doc_id")], 3, 8).select("source", "lang", "doc_id")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages), o AS (SELECT min(p) AS own FROM p)
  SELECT page_id, CAST(CASE WHEN p = own THEN 0 WHEN regexp_replace(p, '[^/]*$', '') = regexp_replace(own, '[^/]*$', '') THEN 1 WHEN split_part(p, '/', 1) = split_part(own, '/', 1) THEN 2 ELSE 3 END AS INTEGER) AS distance FROM p, o""")  # fmt: skip
def proximity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("p"))
    own = rows.agg(F.min("p").alias("own"))
    return rows.join(F.broadcast(own)).select("page_id", filters.proximity(F.col("p"), F.col("own")).alias("distance"))
