"""Queries on effort-aware ranking, routing and size control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.functions.scalar import ppv
from tessella.operators import effort, metrics, statistics
from tessella.views import predictions, scores, with_views

_P = with_views("predictions") + ", t AS (SELECT seed, fold, k1, k2, k3, k4, y, prob AS p, prob2, greatest(effort, 1.0) AS e FROM predictions WHERE part = 'test')"
KEY = ["k1", "k2", "k3", "k4"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).where("part = 'test'")
    return rows.select("seed", "fold", *KEY, "y", F.col("prob").alias("p"), "prob2", effort.effort(F.col("effort")).alias("effort"))


def _rank_sql(order: str) -> str:
    return _P + f""", o AS (SELECT *, sum(e) OVER c AS te, sum(y) OVER c AS tp, count(*) OVER c AS n,
    row_number() OVER s AS rk, sum(e) OVER s AS sx, sum(y) OVER s AS sp, sum(e) OVER b AS bx, sum(y) OVER b AS bp, sum(y) OVER w AS wp FROM t
    WINDOW c AS (PARTITION BY seed, fold), s AS (PARTITION BY seed, fold ORDER BY {order}, k1, k2, k3, k4 ROWS UNBOUNDED PRECEDING),
    b AS (PARTITION BY seed, fold ORDER BY y / e DESC, e, k1, k2, k3, k4 ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY seed, fold ORDER BY y / e, e DESC, k1, k2, k3, k4 ROWS UNBOUNDED PRECEDING)),
  m AS (SELECT seed, fold, sum(CASE WHEN sx / te <= 0.2 + 1e-12 THEN y ELSE 0 END) / max(tp) AS r, avg(CASE WHEN sx / te <= 0.2 + 1e-12 THEN 1.0 ELSE 0.0 END) AS pci,
    sum(e * (2 * sp - y) / 2) / (max(te) * max(tp)) AS a, sum(e * (2 * bp - y) / 2) / (max(te) * max(tp)) AS b, sum(e * (2 * wp - y) / 2) / (max(te) * max(tp)) AS w,
    min(rk) FILTER (y = 1) - 1 AS ifa, avg(y) FILTER (rk <= ceil(0.1 * n)) AS pt FROM o WHERE tp > 0 AND tp < n GROUP BY seed, fold)
  SELECT seed, fold, round(r, 6) AS recall_at_budget, round(pci, 6) AS pci_at_budget, round((a - w) / (b - w), 6) AS popt, ifa, round(pt, 6) AS precision_at_top FROM m"""  # fmt: skip


def _rank(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("recall_at_budget", "pci_at_budget", "popt", "precision_at_top")})


@query(_rank_sql("p DESC"))
def effort_recall_popt_ifa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(effort.rank_metrics(_rows(spark, sf_dir), ["seed", "fold"], KEY))


@query(_rank_sql("e ASC"))
def effort_smallest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(effort.rank_metrics(_rows(spark, sf_dir), ["seed", "fold"], KEY, order=F.col("effort")))


def _alberg_sql(n: int, digits: int = 6) -> str:
    """Shares at n even parts of the effort."""
    return _P + f""", o AS (SELECT seed, y, e, sum(e) OVER s / sum(e) OVER (PARTITION BY seed) AS x1, sum(y) OVER s AS p1, sum(e) OVER (PARTITION BY seed) AS te, sum(y) OVER (PARTITION BY seed) AS tp
    FROM t WINDOW s AS (PARTITION BY seed ORDER BY p DESC, k1, k2, k3, k4 ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT i FROM range(1, {n + 1}) r(i)), h AS (SELECT seed, i, min(x1) AS x1 FROM o JOIN g ON x1 >= (i - 1e-9) / {n} GROUP BY seed, i),
  k AS (SELECT o.seed, h.i, o.x1, o.p1 / o.tp AS q1, o.x1 - o.e / o.te AS x0, (o.p1 - o.y) / o.tp AS q0 FROM h JOIN o ON o.seed = h.seed AND o.x1 = h.x1)
  SELECT seed, i / {n} AS grid, round(q0 + (q1 - q0) * least(1.0, (i / {n} - x0) / (x1 - x0)), {digits}) AS share FROM k
  UNION ALL SELECT DISTINCT seed, 0.0, 0.0 FROM t"""


@query(_alberg_sql(10))
def alberg_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effort.alberg(_rows(spark, sf_dir), ["seed"], KEY, 11).withColumn("share", F.round("share", 6))


@query(_alberg_sql(100, 4))
def alberg_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve on 101 points."""
    return effort.alberg(_rows(spark, sf_dir), ["seed"], KEY).withColumn("share", F.round("share", 4))


@query(_P + """, c AS (SELECT seed, count(*) FILTER (y = 1 AND p >= 0.5) / count(*) FILTER (y = 1) AS se, count(*) FILTER (y = 0 AND p < 0.5) / count(*) FILTER (y = 0) AS sp FROM t GROUP BY seed)
  SELECT seed, i / 20 AS prevalence, round(se * (i / 20) / nullif(se * (i / 20) + (1 - sp) * (1 - i / 20), 0), 6) AS ppv FROM c CROSS JOIN range(1, 20) r(i)""")  # fmt: skip
def ppv_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.confusion(_rows(spark, sf_dir), ["seed"], F.col("p") >= 0.5)
    each = counts.withColumn("prevalence", F.explode(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: i / 20)))
    tp, fp, fn, tn = map(F.col, metrics.COUNTS)
    return each.select("seed", "prevalence", F.round(ppv(tp / (tp + fn), tn / (tn + fp), F.col("prevalence")), 6).alias("ppv"))


@query(_P + """, r AS (SELECT *, row_number() OVER (PARTITION BY seed, fold ORDER BY abs(p - 0.5), k1, k2, k3, k4) AS rk, count(*) OVER (PARTITION BY seed, fold) AS n FROM t),
  q AS (SELECT *, rk <= round_even(0.25 * n, 0) AS routed FROM r)
  SELECT seed, fold, count(*) AS n, count(*) FILTER (routed) AS routed, count(*) FILTER ((CASE WHEN routed THEN prob2 ELSE p END >= 0.5) = (y = 1)) AS right_after FROM q GROUP BY seed, fold""")  # fmt: skip
def route_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = effort.route(_rows(spark, sf_dir), ["seed", "fold"], -F.abs(F.col("p") - 0.5), [F.col(k) for k in KEY], 0.25)
    after = F.when(F.col("routed"), F.col("prob2")).otherwise(F.col("p")) >= 0.5
    return rows.groupBy("seed", "fold").agg(F.count("*").alias("n"), F.count_if("routed").alias("routed"), F.count_if(after == (F.col("y") == 1)).alias("right_after"))


@query(_P + """, c AS (SELECT seed, count(*) AS n, count(*) FILTER (y = 1 AND p < 0.5 AND prob2 >= 0.5) AS xn, count(*) FILTER (y = 0 AND p >= 0.5 AND prob2 < 0.5) AS xp,
    count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM t GROUP BY seed),
  k AS (SELECT *, least(CAST(round_even(0.1 * n, 0) AS BIGINT), xn + xp) AS k FROM c), e AS (SELECT *, unnest(range(greatest(0, k - xp), least(k, xn) + 1)) AS a FROM k),
  v AS (SELECT seed, k, a, round((CAST(tp + a AS DOUBLE) * (tn + k - a) - CAST(fp - k + a AS DOUBLE) * (fn - a)) / nullif(sqrt(CAST(tp + fp - k + 2 * a AS DOUBLE)) * sqrt(CAST(tp + fn AS DOUBLE)) * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn + k - 2 * a AS DOUBLE)), 0), 9) AS m FROM e)
  SELECT seed, k AS routed, round(max(coalesce(m, 0)), 6) AS mcc FROM v GROUP BY seed, k""", signed=("mcc",))  # fmt: skip
def oracle_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = effort.oracle_route(_rows(spark, sf_dir), ["seed"], F.col("p") >= 0.5, F.col("prob2") >= 0.5, 0.1)
    return out.select("seed", "routed", F.round("mcc", 6).alias("mcc"))


@query(_P + """, s AS (SELECT seed, CAST(floor(e / 10) AS BIGINT) AS st, p, y FROM t),
  d AS (SELECT seed, st, p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY seed, st, p),
  w AS (SELECT seed, st, pos * (sum(neg) OVER (PARTITION BY seed, st ORDER BY p) - neg / 2) AS w FROM d), a AS (SELECT seed, sum(w) AS w FROM w GROUP BY seed),
  n AS (SELECT seed, st, sum(y) * sum(1 - y) AS n FROM s GROUP BY seed, st), b AS (SELECT seed, sum(n) AS n FROM n GROUP BY seed)
  SELECT seed, round(w / nullif(n, 0), 6) AS auc FROM a JOIN b USING (seed)""")  # fmt: skip
def stratified_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("stratum", F.floor(F.col("effort") / 10))
    return effort.stratified_auc(rows, ["seed"], "stratum").withColumn("auc", F.round("auc", 6))


@query(with_views("scores") + """, c AS (SELECT model, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS acc, avg(pow(p - y, 2)) AS brier FROM scores WHERE part = 'test' GROUP BY model)
  SELECT model, rank() OVER (ORDER BY round(acc, 9) DESC) AS by_accuracy, rank() OVER (ORDER BY round(brier, 9)) AS by_brier FROM c""")  # fmt: skip
def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = scores(spark, sf_dir).where("part = 'test'").groupBy("model").agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("acc"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    # as many rows as there are models
    return rows.select("model", F.rank().over(Window.orderBy(F.round("acc", 9).desc())).cast("long").alias("by_accuracy"), F.rank().over(Window.orderBy(F.round("brier", 9))).cast("long").alias("by_brier"))


@query(_P + """, d AS (SELECT e AS p, sum(y) AS pos, sum(1 - y) AS neg FROM t GROUP BY e), w AS (SELECT pos * (sum(neg) OVER (ORDER BY p) - neg / 2) AS w FROM d)
  SELECT (SELECT CAST(sum(y) AS BIGINT) FROM t) AS n1, (SELECT CAST(sum(1 - y) AS BIGINT) FROM t) AS n0, round(sum(w), 6) AS u FROM w""")  # fmt: skip
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("all", F.lit(1))
    return statistics.mann_whitney(rows, ["all"], "effort").select("n1", "n0", F.round("u", 6).alias("u"))
