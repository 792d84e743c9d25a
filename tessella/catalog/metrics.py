"""Queries over predictions: metrics, thresholds, ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.functions.scalar import rounded
from tessella.operators import metrics, statistics, thresholds
from tessella.views import predictions, scores, with_views

_S = with_views("scores")
CELL = ["model", "seed", "fold"]
KEY = ["k1", "k2", "k3", "k4"]


def _test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where("part = 'test'")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in names})


_T = _S + ", t AS (SELECT * FROM scores WHERE part = 'test')"
_C = _T + """, c AS (SELECT model, seed, fold, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
  count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM t GROUP BY model, seed, fold)"""  # fmt: skip
_MCC = """coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE)) * sqrt(CAST(tp + fn AS DOUBLE)) * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn AS DOUBLE)), 0), 0)"""
_F1 = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"
_METRICS = f"""round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round({_F1}, 6) AS f1, round({_MCC}, 6) AS mcc,
  round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_acc, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy"""  # fmt: skip


@query(_C + f" SELECT *, {_METRICS} FROM c", signed=('mcc',))
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.from_counts(metrics.confusion(_test(spark, sf_dir), CELL, F.col("p") >= 0.5))
    return _rounded(out, "precision", "recall", "f1", "mcc", "balanced_acc", "accuracy")


# pairs of one cell, by ranks with ties sharing their mean
_AUC = """, r AS (SELECT *, rank() OVER (PARTITION BY model, seed, fold ORDER BY p) + (count(*) OVER (PARTITION BY model, seed, fold, p) - 1) / 2 AS rk FROM t),
  a AS (SELECT model, seed, fold, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(CAST(sum(y) AS DOUBLE) * (count(*) - sum(y)), 0) AS auc FROM r GROUP BY model, seed, fold)"""  # fmt: skip
_AP = """, d AS (SELECT model, seed, fold, p, sum(y) AS pos, count(*) AS n FROM t GROUP BY model, seed, fold, p),
  e AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY model, seed, fold) AS all_pos FROM d WINDOW w AS (PARTITION BY model, seed, fold ORDER BY p DESC)),
  b AS (SELECT model, seed, fold, sum(coalesce(pos / nullif(all_pos, 0), 0) * tp / seen) AS ap FROM e GROUP BY model, seed, fold)"""  # fmt: skip


@query(_T + _AUC + " SELECT model, seed, fold, round(auc, 6) AS roc_auc FROM a")
def roc_auc_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_test(spark, sf_dir), CELL), "roc_auc")


@query(_T + _AP + " SELECT model, seed, fold, round(ap, 6) AS average_precision FROM b")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.average_precision(_test(spark, sf_dir), CELL), "average_precision")


@query(_C + _AUC + _AP + f""" SELECT c.*, {_METRICS}, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision FROM c JOIN a USING (model, seed, fold) JOIN b USING (model, seed, fold)""", signed=('mcc',))
def full_metrics_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.full(_test(spark, sf_dir), CELL, F.lit(0.5)), "precision", "recall", "f1", "mcc", "balanced_acc", "accuracy", "roc_auc", "average_precision")


@query(_T + """, d AS (SELECT model, seed, fold, p, sum(y) AS pos, count(*) AS n FROM t GROUP BY model, seed, fold, p),
  e AS (SELECT *, coalesce(sum(pos) OVER w / nullif(sum(pos) OVER (PARTITION BY model, seed, fold), 0), 0) AS r, sum(pos) OVER w / sum(n) OVER w AS q FROM d WINDOW w AS (PARTITION BY model, seed, fold ORDER BY p DESC)),
  g AS (SELECT model, seed, fold, (r - coalesce(lag(r) OVER v, 0)) * (q + coalesce(lag(q) OVER v, 1)) / 2 AS a FROM e WINDOW v AS (PARTITION BY model, seed, fold ORDER BY p DESC))
  SELECT model, seed, fold, round(sum(a), 6) AS pr_auc FROM g GROUP BY model, seed, fold""")  # fmt: skip
def pr_auc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.pr_trapezoid(_test(spark, sf_dir), CELL), "pr_auc")


@query(_T + """, d AS (SELECT seed, p, sum(y) AS pos, sum(1 - y) AS neg FROM t WHERE model = 'b' GROUP BY seed, p)
  SELECT seed, p, round(sum(neg) OVER w / nullif(sum(neg) OVER (PARTITION BY seed), 0), 6) AS fpr, round(sum(pos) OVER w / nullif(sum(pos) OVER (PARTITION BY seed), 0), 6) AS tpr
  FROM d WINDOW w AS (PARTITION BY seed ORDER BY p DESC)""")  # fmt: skip
def roc_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_points(_test(spark, sf_dir).where("model = 'b'"), ["seed"]), "fpr", "tpr")


_GRID = ", g AS (SELECT i AS step, CAST(CAST(i / 100.0 AS FLOAT) AS DOUBLE) AS t FROM range(101) r(i))"
_VAL = _S + _GRID + """, v AS (SELECT model, seed, fold, p, sum(y) AS pos, sum(1 - y) AS neg FROM scores WHERE part = 'val' GROUP BY model, seed, fold, p),
  k AS (SELECT model, seed, fold, step, g.t, CAST(coalesce(sum(pos) FILTER (p >= g.t), 0) AS BIGINT) AS tp, CAST(coalesce(sum(neg) FILTER (p >= g.t), 0) AS BIGINT) AS fp,
    CAST(coalesce(sum(pos) FILTER (p < g.t), 0) AS BIGINT) AS fn, CAST(coalesce(sum(neg) FILTER (p < g.t), 0) AS BIGINT) AS tn FROM v CROSS JOIN g GROUP BY model, seed, fold, step, g.t)"""  # fmt: skip


def _best_sql(value: str) -> str:
    return _VAL + f""", s AS (SELECT *, {value} AS v FROM k), b AS (SELECT *, row_number() OVER (PARTITION BY model, seed, fold ORDER BY v DESC, t) AS n FROM s)"""


def _val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where("part = 'val'")


_PICK = " SELECT model, seed, fold, round(CASE WHEN tp + fn = 0 THEN 0.5 ELSE t END, 6) AS threshold, round(v, 6) AS score FROM b WHERE n = 1"


@query(_best_sql(_F1) + _PICK)
def threshold_max_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(thresholds.tuned(_val(spark, sf_dir), CELL), "threshold", "score")


@query(_best_sql(f"round({_MCC}, 12)") + _PICK, signed=('score',))
def threshold_max_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # scores equal but for rounding count as ties
    tp, fp, fn, tn = map(F.col, metrics.COUNTS)
    swept = thresholds.sweep(_val(spark, sf_dir), CELL, thresholds.grid())
    value = F.round(metrics.mcc(tp, fp, fn, tn), 12)
    out = swept.groupBy(*CELL).agg(F.max(F.struct(value.alias("v"), (-F.col("step")).alias("s"), "t")).alias("m"), F.max(tp + fn).alias("pos"))
    return _rounded(out.select(*CELL, F.when(F.col("pos") == 0, 0.5).otherwise(F.col("m.t")).alias("threshold"), F.col("m.v").alias("score")), "threshold", "score")


@query(_VAL + f" SELECT model, seed, fold, CAST(step AS INTEGER) AS step, round(t, 6) AS t, tp, fp, fn, tn, round({_F1}, 6) AS f1 FROM k")
def f1_threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = thresholds.sweep(_val(spark, sf_dir), CELL, thresholds.grid())
    return _rounded(out.withColumn("f1", metrics.f1(F.col("tp"), F.col("fp"), F.col("fn"))), "t", "f1")


@query(_best_sql(_F1) + """, p AS (SELECT model, seed, fold, CASE WHEN tp + fn = 0 THEN 0.5 ELSE t END AS th FROM b WHERE n = 1) SELECT model, round(median(th), 6) AS threshold FROM p GROUP BY model""")
def median_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = thresholds.tuned(_val(spark, sf_dir), CELL)
    return _rounded(out.groupBy("model").agg(F.median("threshold").alias("threshold")), "threshold")


@query(_best_sql(_F1) + f""", p AS (SELECT model, seed, fold, CASE WHEN tp + fn = 0 THEN 0.5 ELSE t END AS th FROM b WHERE n = 1),
  c AS (SELECT x.model, x.seed, x.fold, count(*) FILTER (y = 1 AND x.p >= th) AS tp, count(*) FILTER (y = 0 AND x.p >= th) AS fp, count(*) FILTER (y = 1 AND x.p < th) AS fn, count(*) FILTER (y = 0 AND x.p < th) AS tn,
    count(*) FILTER (y = 1 AND x.p >= 0.5) AS ftp, count(*) FILTER (y = 0 AND x.p >= 0.5) AS ffp, count(*) FILTER (y = 1 AND x.p < 0.5) AS ffn
    FROM scores x JOIN p USING (model, seed, fold) WHERE part = 'test' GROUP BY x.model, x.seed, x.fold)
  SELECT model, seed, fold, tp, fp, fn, tn, round({_F1}, 6) AS f1, round(coalesce(2.0 * ftp / nullif(2 * ftp + ffp + ffn, 0), 0), 6) AS frozen_f1 FROM c""")  # fmt: skip
def frozen_vs_retuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned = thresholds.tuned(_val(spark, sf_dir), CELL)
    rows = _test(spark, sf_dir).join(tuned, CELL)
    new = metrics.confusion(rows, CELL, F.col("p") >= F.col("threshold"))
    old = metrics.confusion(rows, CELL, F.col("p") >= 0.5).select(*CELL, metrics.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("frozen_f1"))
    out = new.withColumn("f1", metrics.f1(F.col("tp"), F.col("fp"), F.col("fn"))).join(old, CELL)
    return _rounded(out, "f1", "frozen_f1")


_Q = ", ".join(f"{i / 10!r}" for i in range(11))


@query(_S + f""", v AS (SELECT seed, effort AS p, y FROM scores WHERE part = 'val' AND model = 'a'), q AS (SELECT seed, unnest(quantile_disc(p, [{_Q}])) AS t, sum(y) AS all_pos FROM v GROUP BY seed),
  k AS (SELECT q.seed, q.t, max(all_pos) AS a, count(*) FILTER (y = 1 AND p >= q.t) AS tp, count(*) FILTER (y = 0 AND p >= q.t) AS fp FROM (SELECT DISTINCT * FROM q) q JOIN v ON v.seed = q.seed GROUP BY q.seed, q.t),
  s AS (SELECT *, coalesce(2.0 * tp / nullif(2 * tp + fp + a - tp, 0), 0) AS v FROM k), b AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY v DESC, t) AS n FROM s)
  SELECT seed, t AS threshold, round(v, 6) AS score FROM b WHERE n = 1""")  # fmt: skip
def quantile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).where("part = 'val'").select("seed", "y", F.col("effort").alias("p"))
    return _rounded(thresholds.at_quantiles(rows, ["seed"], 10), "score")


@query(_C + f""", m AS (SELECT model, seed, fold, {_F1} AS f1, {_MCC} AS mcc FROM c), s AS (SELECT model, seed, avg(f1) AS f1, avg(mcc) AS mcc, count(*) AS folds FROM m GROUP BY model, seed)
  SELECT model, count(*) AS seeds, CAST(sum(folds) AS BIGINT) AS folds, round(avg(f1), 6) AS f1, round(avg(mcc), 6) AS mcc, round(stddev_samp(f1), 6) AS f1_sd, round(stddev_samp(mcc), 6) AS mcc_sd FROM s GROUP BY model""", signed=('mcc',))  # fmt: skip
def seed_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = metrics.from_counts(metrics.confusion(_test(spark, sf_dir), CELL, F.col("p") >= 0.5))
    return _rounded(metrics.seed_average(cells, ["model"], ["f1", "mcc"]), "f1", "mcc", "f1_sd", "mcc_sd")


def _cell_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.from_counts(metrics.confusion(_test(spark, sf_dir), CELL, F.col("p") >= 0.5)).select(*CELL, "f1")


_D = _C + f""", m AS (SELECT model, seed, fold, {_F1} AS f1 FROM c), d AS (SELECT a.seed, a.fold, b.model AS other, a.f1 - b.f1 AS delta FROM m a JOIN m b ON a.seed = b.seed AND a.fold = b.fold AND a.model = 'a' AND b.model <> 'a')"""


@query(_D + """, s AS (SELECT other, count(*) AS n, avg(delta) AS m, var_samp(delta) AS v FROM d GROUP BY other)
  SELECT other, n, round(m, 6) AS mean_delta, round(CASE WHEN n > 1 AND v > 0 THEN m / sqrt((1.0 / n + 0.25) * v) END, 6) AS t FROM s""", signed=('mean_delta', 't'))  # fmt: skip
def paired_delta_corrected_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cell_f1(spark, sf_dir)
    both = [statistics.paired(cells, "a", m, ["seed", "fold"], "f1").withColumn("other", F.lit(m)) for m in "bc"]
    return _rounded(statistics.corrected_t(both[0].unionByName(both[1]), 0.25, ["other"]), "mean_delta", "t")


@query(_D + """, w AS (SELECT other, CASE WHEN delta > 0 THEN 1.0 WHEN delta = 0 THEN 0.5 ELSE 0.0 END AS w FROM d) SELECT other, round(avg(w), 6) AS a12 FROM w GROUP BY other""")
def a12_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cell_f1(spark, sf_dir)
    both = [statistics.paired(cells, "a", m, ["seed", "fold"], "f1").withColumns({"other": F.lit(m), "zero": F.lit(0.0)}) for m in "bc"]
    return _rounded(statistics.a12(both[0].unionByName(both[1]), ["other"], "delta", "zero"), "a12")


# scores of the models as p values of one family
@query(_T + """, f AS (SELECT seed, fold, round(avg(p), 9) / 30 AS pv FROM t WHERE model = 'b' GROUP BY seed, fold),
  s AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY pv, seed, fold) + 1) * pv) AS s FROM f)
  SELECT seed, fold, pv, round(max(s) OVER (ORDER BY pv, seed, fold ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s""")  # fmt: skip
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _test(spark, sf_dir).where("model = 'b'").groupBy("seed", "fold").agg((F.round(F.avg("p"), 9) / 30).alias("pv"))
    return _rounded(statistics.holm(tests, "pv", ["seed", "fold"]), "p_holm")


@query(_T + """, e AS (SELECT k1, k2, k3, k4, seed, fold, y, avg(p) AS p FROM t GROUP BY k1, k2, k3, k4, seed, fold, y HAVING count(DISTINCT model) = 3)
  SELECT seed, fold, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM
  (SELECT seed, fold, y, round(p, 9) AS p FROM e) GROUP BY seed, fold""")  # fmt: skip
def ensemble_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = metrics.ensemble(_test(spark, sf_dir), [*KEY, "seed", "fold"], 3)
    return metrics.confusion(mean.withColumn("p", F.round("p", 9)), ["seed", "fold"], F.col("p") >= 0.5)


@query(_T + """, s AS (SELECT k1, k2, k3, k4, max(y) AS y, count(*) FILTER ((p >= 0.5) = (y = 1)) AS r FROM t GROUP BY k1, k2, k3, k4)
  SELECT y, count(*) AS samples, count(*) FILTER (r > 0) AS found_by_any, count(*) FILTER (r = 3) AS found_by_all, round(avg(3 - r), 6) AS mean_wrong FROM s GROUP BY y""")  # fmt: skip
def oracle_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = metrics.model_overlap(_test(spark, sf_dir), KEY, F.col("p") >= 0.5)
    return each.groupBy("y").agg(F.count("*").alias("samples"), F.count_if(F.col("right") > 0).alias("found_by_any"), F.count_if(F.col("right") == 3).alias("found_by_all"), F.round(F.avg("wrong"), 6).alias("mean_wrong"))


@query(_T + """, w AS (SELECT k1, k2, k3, k4, model, CASE WHEN (p >= 0.5) <> (y = 1) THEN 1 ELSE 0 END AS e FROM t),
  j AS (SELECT a.model AS a, b.model AS b, count(*) AS n, avg(CASE WHEN a.e = b.e THEN 1.0 ELSE 0.0 END) AS s, avg(a.e) AS pa, avg(b.e) AS pb FROM w a JOIN w b USING (k1, k2, k3, k4) WHERE a.model < b.model GROUP BY a.model, b.model),
  k AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM j) SELECT a, b, n, round(CASE WHEN pe < 1 THEN (s - pe) / (1 - pe) END, 6) AS kappa FROM k""", signed=('kappa',))  # fmt: skip
def pairwise_error_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.error_kappa(_test(spark, sf_dir), KEY, F.col("p") >= 0.5, ["a", "b", "c"]), "kappa")


@query(_T + """ SELECT model, CAST(least(9, floor(p * 10)) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS share FROM t GROUP BY 1, 2""")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.calibration(_test(spark, sf_dir), ["model"]), "mean_p", "share")


@query(_T + """, c AS (SELECT model, y, least(1 - 1e-7, greatest(1e-7, p)) AS q, p FROM t), l AS (SELECT *, CASE WHEN y = 1 THEN q ELSE 1 - q END AS pt FROM c)
  SELECT model, count(*) AS n, round(avg(-ln(pt)), 6) AS bce, round(avg(-pow(1 - pt, 2) * ln(pt)), 6) AS focal, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(2 * abs(p - y)), 6) AS manhattan,
  round(coalesce(sum(-ln(pt)) FILTER (y = 1), 0) / (2 * count(*) FILTER (y = 1)) + coalesce(sum(-ln(pt)) FILTER (y = 0), 0) / (2 * count(*) FILTER (y = 0)), 6) AS weighted_bce FROM l GROUP BY model""")  # fmt: skip
def prediction_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.losses(_test(spark, sf_dir), ["model"]), "bce", "focal", "brier", "manhattan", "weighted_bce")


@query(_T + """, r AS (SELECT seed, k1, k2, k3, k4, y, model, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS s FROM t),
  w AS (SELECT seed, k1, k2, k3, k4, sum(CASE WHEN y <> s THEN 1 ELSE 0 END) AS w, count(*) AS n FROM r GROUP BY ALL),
  h AS (SELECT seed, sum(w) / sum(n) AS h, avg(CASE WHEN w = 0 THEN 1.0 ELSE 0.0 END) AS a FROM w GROUP BY seed),
  c AS (SELECT seed, model, count(*) FILTER (y = 1 AND s = 1) AS tp, count(*) FILTER (y = 0 AND s = 1) AS fp, count(*) FILTER (y = 1 AND s = 0) AS fn FROM r GROUP BY seed, model),
  f AS (SELECT seed, avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS ma, 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS mi FROM c GROUP BY seed)
  SELECT seed, round(h, 6) AS hamming_loss, round(a, 6) AS subset_accuracy, round(ma, 6) AS f1_macro, round(mi, 6) AS f1_micro FROM h JOIN f USING (seed)""")  # fmt: skip
def multi_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _test(spark, sf_dir).select("seed", *KEY, "y", F.col("model").alias("label"), (F.col("p") >= 0.5).cast("int").alias("said"))
    return _rounded(metrics.multi_label(rows, ["seed"], KEY), "hamming_loss", "subset_accuracy", "f1_macro", "f1_micro")
