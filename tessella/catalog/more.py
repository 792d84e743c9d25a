"""Queries on filters, coercions, thresholds, tests, summaries, splits and source texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.catalog.draws import uniform_sql
from tessella.functions import scalar, tails
from tessella.operators import code, effort, filters, joins, metrics, neighbours, splits, statistics, summaries, thresholds
from tessella.views import predictions, read, reviews, scores, snippets, with_views

_P = with_views("predictions")
_S = with_views("scores")
_V = with_views("reviews")
_N = with_views("snippets")
_F1 = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- filters and coercions ------------------------------------------------------------------


@query(_S + " SELECT model, seed, fold, count(*) AS n FROM scores WHERE model IN ('a', 'c') AND fold IN (0, 3) GROUP BY model, seed, fold")
def config_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.in_lists(scores(spark, sf_dir), {"model": ["a", "c"], "fold": [0, 3], "seed": None})
    return rows.groupBy("model", "seed", "fold").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 1 GROUP BY o_orderpriority")
def subset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose options have all that is wanted, whatever else they have."""
    combo = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("part"), (F.col("o_orderkey") % 3).cast("string"), F.lit("clerk"), F.col("o_orderpriority"))
    return filters.matching(read(spark, sf_dir, "orders").withColumn("combo", combo), "combo", {"status": "F", "part": 1}).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS size, CAST(p_retailprice AS DOUBLE) AS p_retailprice, 0.0::DOUBLE AS absent FROM part")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in a given order as doubles; a missing value and a missing column are 0."""
    rows = read(spark, sf_dir, "part").withColumn("size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")))
    return filters.feature_matrix(rows, ["size", "p_retailprice", "absent"]).select(F.col("p_partkey").cast("long").alias("p_partkey"), "size", "p_retailprice", "absent")


@query("SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN event_id % 5 IN (0, 1, 2, 3) THEN 0.0 ELSE value END AS clean FROM events")
def sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN, infinity, null and the sentinel become 0."""
    k = F.col("event_id") % 5
    raw = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, F.lit(None).cast("double")).when(k == 3, -1.0).otherwise(F.col("value"))
    return read(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), scalar.sanitize(raw).alias("clean"))


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, quality = 1 AS y0, toxic = 1 AS y1 FROM labels")
def label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth values out of the text of a list."""
    said = F.concat(F.lit("["), *[x for c, end in (("quality", ", "), ("toxic", "]")) for x in (F.when(F.col(c) == 1, "True").otherwise("False"), F.lit(end))])
    y = scalar.label_array(said)
    return read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), y[0].alias("y0"), y[1].alias("y1"))


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN event_id % 4 = 3 THEN 0 ELSE CAST(regexp_extract(props, '[0-9]+') AS INTEGER) END AS k, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 0 END AS yes,
  round(CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 9 + (event_id % 12) / 12 END, 6) AS years FROM events""")  # fmt: skip
def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, truth values and durations out of texts; what isn't one has a default or is null."""
    number = F.when(F.col("event_id") % 4 == 3, "n/a").otherwise(F.regexp_extract("props", "[0-9]+", 0))
    yes = F.when(F.col("event_type") == "view", " YES ").when(F.col("event_type") == "click", "false").otherwise("maybe")
    span = F.when(F.col("event_type") == "error", "long").otherwise(F.format_string("%dY %dM", F.col("event_id") % 9, F.col("event_id") % 12))
    return read(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), scalar.safe_int(number).alias("k"), scalar.truth(yes).alias("yes"), F.round(scalar.years(span), 6).alias("years"))


@query("""SELECT '{"fold":' || (l_orderkey % 5) || ',"model":"' || l_returnflag || '","seed":' || l_linenumber || '}' AS combo, count(*) AS runs, round(avg(l_discount), 6) AS score_mean, round(stddev_pop(l_discount), 6) AS score_std FROM lineitem GROUP BY combo""")
def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by their options as one JSON text, with means and deviations."""
    rows = read(spark, sf_dir, "lineitem").withColumn("score", F.col("l_discount"))
    out = summaries.by_configuration(rows, {"seed": F.col("l_linenumber"), "model": F.col("l_returnflag"), "fold": F.col("l_orderkey") % 5}, ["score"])
    return _rounded(out, "score_mean", "score_std")


@query("SELECT sha1(c_name) AS sha1, sha256(c_name) AS sha256, md5(c_name) AS md5 FROM customer")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests that names of files, stages and draws are made of."""
    name = F.col("c_name").cast("binary")
    return read(spark, sf_dir, "customer").select(F.sha1(name).alias("sha1"), F.sha2(name, 256).alias("sha256"), F.md5(name).alias("md5"))


# --- thresholds -----------------------------------------------------------------------------


def _sweep_sql(view: str, cell: str, grid: str, where: str = "") -> str:
    return f"""{view}, g AS ({grid}), k AS (SELECT {cell}, g.step, g.t, count(*) FILTER (y = 1 AND p >= g.t) AS tp, count(*) FILTER (y = 0 AND p >= g.t) AS fp, count(*) FILTER (y = 1 AND p < g.t) AS fn FROM scores CROSS JOIN g WHERE part = 'val' {where} GROUP BY {cell}, g.step, g.t),
  b AS (SELECT *, row_number() OVER (PARTITION BY {cell} ORDER BY {_F1} DESC, step) AS r FROM k)"""


@query(_sweep_sql(_S, "model, seed", "SELECT i AS step, i / 100.0::DOUBLE AS t FROM range(101) r(i)", "AND (model <> 'c' OR y = 0)") + f" SELECT model, seed, round(t, 6) AS threshold, round({_F1}, 6) AS score FROM b WHERE r = 1")
def threshold_float64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The double-precision grid; without positives the first threshold, 0, is as good as any."""
    rows = scores(spark, sf_dir).where("part = 'val' and (model <> 'c' or y = 0)")
    return _rounded(thresholds.tuned(rows, ["model", "seed"], thresholds=thresholds.grid(single=False), empty=None), "threshold", "score")


@query(_sweep_sql(_S, "model, seed", "SELECT i AS step, 0.05 + i * (0.95 - 0.05) / 90 AS t FROM range(91) r(i)") + f" SELECT model, seed, round(t, 6) AS threshold, round({_F1}, 6) AS score FROM b WHERE r = 1")
def threshold_91_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """91 steps from 0.05 to 0.95, no default without positives."""
    rows = scores(spark, sf_dir).where("part = 'val'")
    return _rounded(thresholds.tuned(rows, ["model", "seed"], thresholds=thresholds.grid(91, 0.05, 0.95, single=False), empty=None), "threshold", "score")


@query(_sweep_sql(_S, "model", "SELECT i AS step, CAST(CAST(i / 100.0 AS FLOAT) AS DOUBLE) AS t FROM range(101) r(i)", "AND (seed <= 3) = (fold < 2)") + f" SELECT model, round(CASE WHEN tp + fn = 0 THEN 0.5 ELSE t END, 6) AS threshold, round({_F1}, 6) AS score FROM b WHERE r = 1")
def threshold_on_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds chosen on the rows whose level is the one of their label."""
    rows = scores(spark, sf_dir).where("part = 'val'").withColumns({"label": F.when(F.col("seed") <= 3, "x").otherwise("y"), "level": F.when(F.col("fold") < 2, "class").otherwise("method")})
    held = filters.eligible(rows, {"x": "class", "y": "method"})
    return _rounded(thresholds.tuned(held, ["model"]), "threshold", "score")


# --- tests ----------------------------------------------------------------------------------


def _binomial_sql(k: str, n: str) -> str:
    """Two-sided tail of a fair coin; the smaller count's tail, twice."""
    return f"CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(CAST(least({k}, {n} - {k}) AS BIGINT) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2)))) - CASE WHEN 2 * {k} = {n} THEN exp(lgamma({n} + 1) - 2 * lgamma({k} + 1) - {n} * ln(2)) ELSE 0 END) END"


@query(_P + """, c AS (SELECT seed, fold, count(*) FILTER ((prob >= 0.5) = (y = 1) AND (prob2 >= 0.5) <> (y = 1)) AS b, count(*) FILTER ((prob >= 0.5) <> (y = 1) AND (prob2 >= 0.5) = (y = 1)) AS c FROM predictions WHERE part = 'test' GROUP BY seed, fold)
  SELECT seed, fold, b AS only_a, c AS only_b, round(""" + _binomial_sql("b", "(b + c)") + ", 6) AS p FROM c")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two models err on different rows equally often."""
    a, b, y = F.col("prob") >= 0.5, F.col("prob2") >= 0.5, F.col("y") == 1
    counts = predictions(spark, sf_dir).where("part = 'test'").groupBy("seed", "fold").agg(F.count_if((a == y) & (b != y)).alias("only_a"), F.count_if((a != y) & (b == y)).alias("only_b"))
    p = F.udf(tails.mcnemar, "double")  # a row for each cell
    return counts.withColumn("p", F.round(p("only_a", "only_b"), 6))


@query(_V + """, c AS (SELECT smell, count(*) AS n, count(*) FILTER (severity > 0) AS k FROM reviews WHERE severity IS NOT NULL GROUP BY smell) SELECT smell, n, k, round(""" + _binomial_sql("k", "n") + ", 6) AS p FROM c")
def binomial_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reviews(spark, sf_dir).where("severity is not null").groupBy("smell").agg(F.count("*").alias("n"), F.count_if(F.col("severity") > 0).alias("k"))
    return counts.withColumn("p", F.round(F.udf(lambda k, n: tails.binomial_test(k, n), "double")("k", "n"), 6))  # a row for each smell


@query(_P + """, c AS (SELECT seed, fold, avg(CASE WHEN (prob >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN (prob2 >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS d FROM predictions WHERE part = 'test' GROUP BY seed, fold),
  r AS (SELECT *, round(abs(d), 12) AS a FROM c WHERE abs(d) > 1e-12), k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS rk FROM r), s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS plus FROM k)
  SELECT n, round(least(plus, n * (n + 1) / 2 - plus), 4) AS w FROM s""")  # fmt: skip
def wilcoxon_signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller sum of signed ranks of two models' accuracy over cells."""
    right = lambda p: F.avg(((F.col(p) >= 0.5) == (F.col("y") == 1)).cast("double"))
    cells = predictions(spark, sf_dir).where("part = 'test'").groupBy("seed", "fold").agg((right("prob") - right("prob2")).alias("d"))
    return statistics.signed_ranks(cells, "d").withColumn("w", F.round("w", 4))


@query(_P + """, c AS (SELECT seed, fold, avg(CASE WHEN (prob >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN (prob2 >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS d FROM predictions WHERE part = 'test' GROUP BY seed, fold),
  s AS (SELECT count(*) AS n, avg(d) AS m, sqrt((1.0 / count(*) + 0.25) * var_samp(d)) AS se FROM c)
  SELECT n, round(m, 6) AS mean, round(m / se, 6) AS t, round(m - 2.032244509317719 * se, 6) AS low, round(m + 2.032244509317719 * se, 6) AS high FROM s""", signed=("mean", "t", "low", "high"))  # fmt: skip
def corrected_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected resampled t of 35 cells with its 95 % interval."""
    right = lambda p: F.avg(((F.col(p) >= 0.5) == (F.col("y") == 1)).cast("double"))
    cells = predictions(spark, sf_dir).where("part = 'test'").groupBy("seed", "fold").agg((right("prob") - right("prob2")).alias("delta"))
    n = F.count("*")
    error = F.sqrt((1 / n + 0.25) * F.var_samp("delta"))
    out = cells.agg(n.alias("n"), F.avg("delta").alias("mean"), error.alias("se"))
    reach = F.udf(lambda df: tails.t_quantile(0.975, df), "double")(F.col("n") - 1) * F.col("se")  # one row
    return _rounded(out.select("n", "mean", (F.col("mean") / F.col("se")).alias("t"), (F.col("mean") - reach).alias("low"), (F.col("mean") + reach).alias("high")), "mean", "t", "low", "high")


# --- summaries ------------------------------------------------------------------------------

_COUNTS = "count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn"
_CELLS = _S + f", c AS (SELECT model, seed, fold, {_COUNTS} FROM scores WHERE part = 'test' GROUP BY model, seed, fold)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scores(spark, sf_dir).where("part = 'test'"), ["model", "seed", "fold"], F.col("p") >= 0.5)


@query(_CELLS + f""", f AS (SELECT model, fold, seed, tp, fp, fn, tn, {_F1} AS f1 FROM c)
  SELECT model, fold, count(*) AS seeds, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn FROM f GROUP BY model, fold""")  # fmt: skip
def classical_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("f1", scalar.f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return _rounded(summaries.over_seeds(cells, ["model", "fold"], ["f1"]), "f1_mean", "f1_std")


@query(_CELLS + """, s AS (SELECT 'label:' || fold AS scope, * FROM c UNION ALL SELECT 'level:' || CASE WHEN fold < 2 THEN 'class' ELSE 'method' END, * FROM c UNION ALL SELECT 'all', * FROM c)
  SELECT scope, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn FROM s GROUP BY scope""")  # fmt: skip
def scope_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds stand for labels, two of them of classes and three of methods."""
    return summaries.by_scope(_cells(spark, sf_dir).withColumn("level", F.when(F.col("fold") < 2, "class").otherwise("method")), "fold", "level")


@query(_CELLS + f""" SELECT model, seed, round(avg({_F1}), 6) AS macro_f1, round(coalesce(2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 6) AS micro_f1, count(*) AS labels, CAST(sum(tp + fp + fn + tn) AS BIGINT) AS support FROM c GROUP BY model, seed""")
def macro_and_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summaries.composed(_cells(spark, sf_dir), ["model", "seed"]), "macro_f1", "micro_f1")


_AUC = "(SELECT sum(CASE WHEN a.{0} > b.{0} THEN 1.0 WHEN a.{0} = b.{0} THEN 0.5 ELSE 0 END) / count(*) FROM t a JOIN t b ON a.seed = b.seed AND a.y = 1 AND b.y = 0 WHERE a.seed = s.seed)"
_MCC = "coalesce((CAST(tp{0} AS DOUBLE) * tn{0} - CAST(fp{0} AS DOUBLE) * fn{0}) / nullif(sqrt(CAST(tp{0} + fp{0} AS DOUBLE)) * sqrt(CAST(tp{0} + fn{0} AS DOUBLE)) * sqrt(CAST(tn{0} + fp{0} AS DOUBLE)) * sqrt(CAST(tn{0} + fn{0} AS DOUBLE)), 0), 0)"


@query(_P + """, t AS (SELECT * FROM predictions WHERE part = 'test' AND fold = 2), s AS (SELECT seed, """
  + ", ".join(f"count(*) FILTER ({p} >= 0.5 AND y = 1) AS tp{i}, count(*) FILTER ({p} >= 0.5 AND y = 0) AS fp{i}, count(*) FILTER ({p} < 0.5 AND y = 1) AS fn{i}, count(*) FILTER ({p} < 0.5 AND y = 0) AS tn{i}" for i, p in ((1, "prob"), (2, "prob2")))
  + f" FROM t GROUP BY seed) SELECT seed, round({_MCC.format(2)} - {_MCC.format(1)}, 6) AS mcc_change, round({_AUC.format('prob2')} - {_AUC.format('prob')}, 6) AS auc_change FROM s", signed=("mcc_change", "auc_change"))
def variant_metric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What MCC and AUC lose or gain on the variants of a fold's rows."""
    rows = predictions(spark, sf_dir).where("part = 'test' and fold = 2")
    out = []
    for name, p in (("a", "prob"), ("b", "prob2")):
        held = rows.withColumn("p", F.col(p))
        counts = metrics.confusion(held, ["seed"], F.col("p") >= 0.5)
        out.append(counts.select("seed", metrics.mcc(*map(F.col, metrics.COUNTS)).alias(f"m{name}")).join(metrics.roc_auc(held, ["seed"]).withColumnRenamed("roc_auc", f"r{name}"), "seed"))
    both = out[0].join(out[1], "seed")
    return both.select("seed", F.round(F.col("mb") - F.col("ma"), 6).alias("mcc_change"), F.round(F.col("rb") - F.col("ra"), 6).alias("auc_change"))


# --- ranking --------------------------------------------------------------------------------

_KEY = ["k1", "k2", "k3", "k4"]


@query(_P + """, t AS (SELECT *, greatest(effort, 1) AS e FROM predictions WHERE part = 'test'), o AS (SELECT seed, fold, y, sum(e) OVER w AS upto, sum(e) OVER (PARTITION BY seed, fold) AS te, sum(y) OVER (PARTITION BY seed, fold) AS tp
    FROM t WINDOW w AS (PARTITION BY seed, fold ORDER BY e DESC, k1, k2, k3, k4 ROWS UNBOUNDED PRECEDING))
  SELECT seed, fold, round(sum(CASE WHEN upto <= 0.2 * te THEN y ELSE 0 END) / max(tp), 6) AS recall_at_budget FROM o GROUP BY seed, fold""")  # fmt: skip
def effort_largest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).where("part = 'test'").withColumn("p", F.col("prob"))
    out = effort.rank_metrics(rows, ["seed", "fold"], _KEY, order=-F.greatest("effort", F.lit(1.0)))
    return out.select("seed", "fold", F.round("recall_at_budget", 6).alias("recall_at_budget"))


@query(_P + """, t AS (SELECT seed, fold, y, greatest(effort, 1) AS e FROM predictions WHERE part = 'test') SELECT seed, fold, round(0.2, 6) AS expected_recall, CAST(sum(y) AS BIGINT) AS positives, round((count(*) + 1) / (sum(y) + 1) - 1, 6) AS expected_ifa FROM t GROUP BY seed, fold""")
def effort_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a random order is expected to give: recall as the budget's share, and the false alarms before the first hit."""
    return _rounded(effort.random_expectation(predictions(spark, sf_dir).where("part = 'test'"), ["seed", "fold"]), "expected_recall", "expected_ifa")


# --- splits ---------------------------------------------------------------------------------


@query("""WITH RECURSIVE g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY source),
  s AS (SELECT 0::BIGINT AS r, [0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT] AS held, NULL::VARCHAR AS source, NULL::BIGINT AS fold
    UNION ALL SELECT g.r, list_transform(range(5), lambda i: CASE WHEN i + 1 = list_position(s.held, list_min(s.held)) THEN s.held[i + 1] + g.n ELSE s.held[i + 1] END), g.source, CAST(list_position(s.held, list_min(s.held)) - 1 AS BIGINT) FROM s JOIN g ON g.r = s.r + 1)
  SELECT source, fold FROM s WHERE source IS NOT NULL""")  # fmt: skip
def greedy_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, largest first, each to the fold with the fewest rows."""
    return splits.greedy_groups(read(spark, sf_dir, "documents"), "source", 5).select("source", "fold")


@query(_N + """, r AS (SELECT json_index, y0, y1, row_number() OVER (PARTITION BY y0, y1 ORDER BY md5('0:' || json_index), json_index) - 1 AS r FROM snippets WHERE y0 IS NOT NULL),
  f AS (SELECT *, r % 5 AS fold FROM r), i AS (SELECT *, row_number() OVER (PARTITION BY fold, y0, y1 ORDER BY md5('1:' || json_index), json_index) AS q, count(*) OVER (PARTITION BY y0, y1) AS k FROM f)
  SELECT t.fold AS fold, CAST(i.json_index AS BIGINT) AS json_index, CASE WHEN i.fold = t.fold THEN 'test' WHEN (i.q - 1) % 10 = t.fold % 10 AND i.fold = (t.fold + 1) % 5 THEN 'val' ELSE 'train' END AS part FROM i CROSS JOIN range(5) t(fold)""")  # fmt: skip
def kfold_with_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's part in each fold: test, a stratified tenth of the next fold for validation, train."""
    rows = snippets(spark, sf_dir).where("y0 is not null").select(F.col("json_index").cast("long").alias("json_index"), "y0", "y1")
    return splits.with_validation(splits.stratified_folds(rows, "json_index", ["y0", "y1"], 5), "json_index", ["y0", "y1"], 5, 10)


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def flagged_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a table of flags chooses; a row without a flag is an error."""
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"))
    flags = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "true").otherwise("0").alias("flag"))
    return splits.flagged(rows, "doc_id", flags, "id", "flag")


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, 1 AS y, 0.25 + quality * 0.5 AS weight FROM labels UNION ALL SELECT CAST(doc_id AS BIGINT), 0, 0.75 - quality * 0.5 FROM labels")
def oversampled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft labels as two weighted rows each."""
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), (0.25 + F.col("quality") * 0.5).alias("share"))
    return splits.oversampled(rows, "share").select("doc_id", "y", "weight")


@query("SELECT (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS shard, CAST(doc_id AS BIGINT) AS doc_id FROM labels")
def round_robin_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the shard that takes it: positions in turn."""
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"))
    return splits.round_robin_all(rows, "doc_id", 4).select("shard", "doc_id")


@query("""WITH o AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || source), source, doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents),
  s AS (SELECT lang, source, min(place) AS f, count(*) AS k FROM o GROUP BY lang, source),
  a AS (SELECT o.doc_id, o.lang, (s.f + s.k - 1 + CAST(floor(""" + uniform_sql(0, "o.doc_id") + """ * (o.n - s.k)) AS BIGINT)) % o.n + 1 AS place FROM o JOIN s ON s.lang = o.lang AND s.source = o.source WHERE o.n > s.k)
  SELECT a.doc_id, o.doc_id AS donor FROM a JOIN o ON o.lang = a.lang AND o.place = a.place""")  # fmt: skip
def seeded_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document a drawn one of its language from another source."""
    return joins.seeded_donors(read(spark, sf_dir, "documents"), "doc_id", ["lang"], "source")


# --- source texts ---------------------------------------------------------------------------

_JAVA = "'package a.b;' || chr(10) || 'import x.Y;' || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'public class ' || replace(n_name, ' ', '_') || ' {' || chr(10) || '  ' || replace(n_name, ' ', '_') || '(int x) { new ' || replace(n_name, ' ', '_') || '(1); }' || chr(10) || '}' ELSE 'int f() { return ' || n_nationkey || '; }' END"


@query("""SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'public class Snip {' || chr(10) || '  Snip(int x) { new Snip(1); }' || chr(10) || '}' ELSE 'class Snip {' || chr(10) || 'int f() { return ' || n_nationkey || '; }' || chr(10) || '}' END AS unit FROM nation""")
def snippet_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets as units of their own: types renamed with their constructors, fragments wrapped."""
    name = F.replace("n_name", F.lit(" "), F.lit("_"))
    typed = F.concat(F.lit("public class "), name, F.lit(" {\n  "), name, F.lit("(int x) { new "), name, F.lit("(1); }\n}"))
    fragment = F.concat(F.lit("int f() { return "), F.col("n_nationkey").cast("string"), F.lit("; }"))
    text = F.concat(F.lit("package a.b;\nimport x.Y;\n"), F.when(F.col("n_nationkey") % 2 == 0, typed).otherwise(fragment))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), code.made_whole(text, "Snip").alias("unit"))


@query(_N + r""", t AS (SELECT json_index, CASE WHEN length(code) <= 200 THEN code ELSE code[1:140] || chr(10) || '/* ... ' || (length(code) - 200) || ' characters omitted ... */' || chr(10) || code[length(code) - 59:] END AS body, level FROM snippets WHERE code IS NOT NULL)
  SELECT CAST(json_index AS BIGINT) AS json_index, length(body) AS chars, sha256(length('system') || ':system' || length(level) || ':' || level || length(body) || ':' || body) AS fingerprint FROM t""")  # fmt: skip
def prompt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated texts, and digests of the prompts they make."""
    rows = snippets(spark, sf_dir).where("code is not null").withColumn("body", code.truncated_middle(F.col("code"), 200))
    return rows.select(F.col("json_index").cast("long").alias("json_index"), F.char_length("body").cast("long").alias("chars"), code.fingerprint([F.lit("system"), F.col("level"), F.col("body")]).alias("fingerprint"))


# files are orders; a package is a priority; type names are short part numbers
_TYPES = """types AS (SELECT o_orderkey AS file, o_orderpriority AS package, 'T' || (o_custkey % 400) AS name, o_orderpriority || '.' || 'T' || (o_custkey % 400) AS type FROM orders WHERE o_orderkey % 3 = 0),
  imports AS (SELECT o_orderkey AS file, CASE WHEN o_orderkey % 4 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS package, CASE WHEN o_orderkey % 4 = 0 THEN '*' ELSE 'T' || (o_custkey % 400 + 1) END AS name FROM orders WHERE o_orderkey % 5 < 3),
  uses AS (SELECT o_orderkey AS file, o_orderpriority AS package, 'T' || (o_custkey % 400 + k) AS name FROM orders, range(3) r(k))"""


@query("WITH " + _TYPES + """, u AS (SELECT DISTINCT file, package, name FROM uses),
  r AS (SELECT u.*, (SELECT min(type) FROM types t WHERE t.file = u.file AND t.name = u.name) AS r1,
    (SELECT min(t.type) FROM imports i JOIN types t ON t.package = i.package AND t.name = i.name WHERE i.file = u.file AND i.name = u.name AND i.name <> '*') AS r2,
    (SELECT min(type) FROM types t WHERE t.package = u.package AND t.name = u.name) AS r3,
    (SELECT min(t.type) FROM imports i JOIN types t ON t.package = i.package AND t.name = u.name WHERE i.file = u.file AND i.name = '*') AS r4,
    (SELECT min(type) FROM types t WHERE t.package = '2-HIGH' AND t.name = u.name) AS r5, (SELECT count(DISTINCT type) FROM types t WHERE t.name = u.name) AS n, (SELECT min(type) FROM types t WHERE t.name = u.name) AS sole FROM u)
  SELECT CASE WHEN r1 IS NOT NULL THEN 'same file' WHEN r2 IS NOT NULL THEN 'import' WHEN r3 IS NOT NULL THEN 'same package' WHEN r4 IS NOT NULL THEN 'wildcard' WHEN r5 IS NOT NULL THEN 'implicit' WHEN n = 1 THEN 'unique name' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS rule,
    count(*) AS n, count(DISTINCT coalesce(r1, r2, r3, r4, r5, CASE WHEN n = 1 THEN sole END)) AS types FROM r GROUP BY rule""")  # fmt: skip
def type_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    name = lambda k: F.concat(F.lit("T"), (F.col("o_custkey") % 400 + k).cast("string"))
    key, package = F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("package")
    types = o.where("o_orderkey % 3 = 0").select(key, package, name(F.lit(0)).alias("name"), F.concat_ws(".", "o_orderpriority", name(F.lit(0))).alias("type"))
    all_of = F.col("o_orderkey") % 4 == 0
    imports = o.where("o_orderkey % 5 < 3").select(key, F.when(all_of, "1-URGENT").otherwise("5-LOW").alias("package"), F.when(all_of, "*").otherwise(name(F.lit(1))).alias("name"))
    uses = o.select(key, package, F.explode(F.array(*[name(F.lit(k)) for k in range(3)])).alias("name"))
    return code.resolved(uses, types, imports, ["2-HIGH"]).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("type").alias("types"))


@query("""WITH t AS (SELECT o_custkey % 20 AS g, o_orderkey % 97 AS line, o_orderkey % 13 AS col, 'x' || (o_orderkey % 5) AS text, o_orderkey FROM orders), e AS (SELECT DISTINCT o_custkey % 20 AS g, o_orderkey % 97 AS line, o_orderkey % 13 AS col, 'x' || (o_orderkey % 4) AS text, 'get' AS event FROM orders WHERE o_orderkey % 2 = 0)
  SELECT t.g, count(*) AS tokens, count(e.event) AS linked FROM t LEFT JOIN e ON e.g = t.g AND e.line = t.line AND e.col = t.col AND e.text = t.text GROUP BY t.g""")  # fmt: skip
def token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with the access event at their place, if it says the same text."""
    o = read(spark, sf_dir, "orders")
    place = [(F.col("o_custkey") % 20).alias("g"), (F.col("o_orderkey") % 97).alias("line"), (F.col("o_orderkey") % 13).alias("col")]
    said = lambda k: F.concat(F.lit("x"), (F.col("o_orderkey") % k).cast("string")).alias("text")
    tokens = o.select(*place, said(5), "o_orderkey")
    events = o.where("o_orderkey % 2 = 0").select(*place, said(4), F.lit("get").alias("event"))
    return code.at_positions(tokens, events, "g").groupBy("g").agg(F.count("*").alias("tokens"), F.count("event").alias("linked"))


@query("""WITH v AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
  m AS (SELECT label, avg(e[1]) AS mean0, avg(e[64]) AS mean63, max(e[1]) FILTER (r = 1) AS cls0, max(e[1]) FILTER (r = n) AS last0 FROM v GROUP BY label)
  SELECT label, round(mean0, 5) AS mean0, round(mean63, 5) AS mean63, round(cls0, 5) AS cls0, round(last0, 5) AS last0 FROM m""", signed=("mean0", "mean63", "cls0", "last0"))  # fmt: skip
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one text pooled by mean, first and last; a label's vectors stand for a text's."""
    rows = read(spark, sf_dir, "embeddings").select("label", F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e")).alias("x"))
    lists = rows.groupBy("label").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["e"]).alias("v"))
    mean, cls, last = (code.pooled(F.col("v"), how, 64) for how in ("mean", "cls", "last"))
    return lists.select("label", F.round(mean[0], 5).alias("mean0"), F.round(mean[63], 5).alias("mean63"), F.round(cls[0], 5).alias("cls0"), F.round(last[0], 5).alias("last0"))


@query("SELECT CAST(vec_id AS BIGINT) AS vec_id, 10 + 2 + 64 AS width, round(list_sum(list_transform(range(10), lambda i: CASE WHEN i = label THEN i + 1.0 ELSE 0 END)) + label + vec_id / 1000.0 + list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings", signed=("total",))
def node_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind indicators, numbers and the token's vector as one vector; checked by its width and a weighted sum."""
    v = code.composed_features(F.col("label"), 10, [F.col("label"), F.col("vec_id") / 1000.0], F.col("embedding"))
    total = F.aggregate(F.transform("v", lambda x, i: F.when(i < 10, x * (i + 1)).otherwise(x)), F.lit(0.0), lambda s, x: s + x)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).select("vec_id", F.size("v").alias("width"), F.round(total, 4).alias("total"))


# --- studies --------------------------------------------------------------------------------


@query(_V + """, r AS (SELECT smell, sample, reviewer, severity > 0 AS present FROM reviews WHERE severity IS NOT NULL), p AS (SELECT smell, sample, count(*) AS n, count(*) FILTER (present) AS k FROM r GROUP BY smell, sample)
  SELECT smell, CASE WHEN n < 3 THEN 'few' ELSE 'panel' END AS panel, count(*) AS units, count(*) FILTER (2 * k > n) AS positive, count(*) FILTER (2 * k = n) AS split, round(avg(greatest(k, n - k) / n), 6) AS agreement FROM p GROUP BY smell, panel""")  # fmt: skip
def panel_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict majorities of a panel: more than half must see it; panels of fewer than three stand apart."""
    units = reviews(spark, sf_dir).where("severity is not null").groupBy("smell", "sample").agg(F.count("*").alias("n"), F.count_if(F.col("severity") > 0).alias("k"))
    panel = F.when(F.col("n") < 3, "few").otherwise("panel").alias("panel")
    return units.groupBy("smell", panel).agg(F.count("*").alias("units"), F.count_if(2 * F.col("k") > F.col("n")).alias("positive"), F.count_if(2 * F.col("k") == F.col("n")).alias("split"), F.round(F.avg(F.greatest("k", F.col("n") - F.col("k")) / F.col("n")), 6).alias("agreement"))


@query(_V + """, f AS (SELECT sample, smell, ts, id, row_number() OVER (PARTITION BY sample ORDER BY ts, id) AS r FROM reviews), a AS (SELECT sample, smell AS first_smell FROM f WHERE r = 1),
  l AS (SELECT a.first_smell, count(*) AS later, count(*) FILTER (f.smell <> a.first_smell) AS other FROM f JOIN a ON a.sample = f.sample WHERE r > 1 GROUP BY a.first_smell)
  SELECT first_smell, later, other, round(other / later, 6) AS share FROM l""")  # fmt: skip
def later_by_other_smell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a sample's later reviews are of another smell than its first."""
    w = Window.partitionBy("sample").orderBy("ts", "id")
    rows = reviews(spark, sf_dir).withColumns({"r": F.row_number().over(w), "first_smell": F.first("smell").over(w)}).where("r > 1")
    return rows.groupBy("first_smell").agg(F.count("*").alias("later"), F.count_if(F.col("smell") != F.col("first_smell")).alias("other")).withColumn("share", F.round(F.col("other") / F.col("later"), 6))


@query(_V + """, s AS (SELECT DISTINCT reviewer, reviewer % 9 + (reviewer % 12) / 12 AS years FROM reviews WHERE reviewer % 11 <> 0), r AS (SELECT reviewer, count(*) AS n, avg(CASE WHEN severity > 0 THEN 1.0 ELSE 0.0 END) AS rate FROM reviews WHERE severity IS NOT NULL GROUP BY reviewer),
  j AS (SELECT s.years, round(r.rate, 9) AS rate FROM s JOIN r ON r.reviewer = s.reviewer), k AS (SELECT rank() OVER (ORDER BY years) + (count(*) OVER (PARTITION BY years) - 1) / 2 AS a, rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2 AS b FROM j)
  SELECT count(*) AS reviewers, round(corr(a, b), 6) AS rho FROM k""", signed=("rho",))  # fmt: skip
def survey_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of what reviewers say of their years with how often they see a smell; those without an answer are left out."""
    said = F.when(F.col("reviewer") % 11 != 0, F.format_string("%dY%dM", F.col("reviewer") % 9, F.col("reviewer") % 12)).otherwise("prefer not to say")
    answers = reviews(spark, sf_dir).select("reviewer").distinct().withColumn("years", scalar.years(said)).where("years is not null")
    rates = reviews(spark, sf_dir).where("severity is not null").groupBy("reviewer").agg(F.round(F.avg((F.col("severity") > 0).cast("double")), 9).alias("rate"))
    both = answers.join(rates, "reviewer").withColumn("one", F.lit(1))
    out = statistics.spearman(both, ["one"], "years", "rate")
    return out.select(F.col("n").alias("reviewers"), F.round("rho", 6).alias("rho"))


@query("""WITH m AS (SELECT p_partkey, p_size AS cc, p_retailprice AS loc FROM part), c AS (SELECT p_partkey, CASE WHEN cc BETWEEN 10 AND 20 THEN 1 ELSE 0 END AS by_rule, CASE WHEN cc > 10 AND cc < 20 THEN 1 ELSE 0 END AS stored FROM m)
  SELECT by_rule, stored, count(*) AS n FROM c GROUP BY by_rule, stored""")  # fmt: skip
def sampling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by a window with its bounds against stored ones without them."""
    size = F.col("p_size")
    rows = read(spark, sf_dir, "part").select(size.between(10, 20).cast("int").alias("by_rule"), ((size > 10) & (size < 20)).cast("int").alias("stored"))
    return rows.groupBy("by_rule", "stored").agg(F.count("*").alias("n"))


@query(_V + """, d AS (SELECT smell, id, reviewer, severity, severity IS NULL AND reviewer % 3 = 0 AS lost, severity = 0 AND reviewer % 7 = 0 AS odd FROM reviews)
  SELECT smell, count(*) AS n, count(*) FILTER (lost) AS lost, count(*) FILTER (odd) AS odd, count(*) FILTER (lost OR odd) AS affected FROM d GROUP BY smell""")  # fmt: skip
def impossible_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose flags can't all hold, by rule."""
    rules = {"lost": F.col("severity").isNull() & (F.col("reviewer") % 3 == 0), "odd": F.coalesce((F.col("severity") == 0) & (F.col("reviewer") % 7 == 0), F.lit(False))}
    some = reduce(lambda a, b: a | b, rules.values())
    return reviews(spark, sf_dir).groupBy("smell").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in rules.items()], F.count_if(some).alias("affected"))


@query("""WITH v AS (SELECT seed AS region, y = 1 AS y, prob2 >= 0.5 AS hard FROM (""" + _P + """ SELECT * FROM predictions WHERE part = 'test' AND fold = 1) t), c AS (SELECT region, count(*) FILTER (y AND hard) AS a, count(*) FILTER (y AND NOT hard) AS b, count(*) FILTER (NOT y AND hard) AS c, count(*) FILTER (NOT y AND NOT hard) AS d FROM v GROUP BY region),
  p AS (SELECT c.region, a, x, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS l FROM c, range(100000) r(x) WHERE x BETWEEN greatest(0, a - d) AND least(a + b, a + c)),
  e AS (SELECT region, exp(l) AS p FROM p WHERE x = a)
  SELECT c.region, max(c.a) AS both_hold, round(max(c.a * c.d / nullif(c.b * c.c, 0)), 6) AS odds_ratio, round(least(1.0, sum(exp(p.l)) FILTER (exp(p.l) <= e.p * (1 + 1e-7))), 6) AS p FROM c JOIN p ON p.region = c.region JOIN e ON e.region = c.region GROUP BY c.region""")  # fmt: skip
def region_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether positives are more often hard than others in each region: Fisher's exact test and the odds ratio."""
    rows = predictions(spark, sf_dir).where("part = 'test' and fold = 1").select(F.col("seed").alias("region"), (F.col("y") == 1).alias("y"), (F.col("prob2") >= 0.5).alias("hard"))
    y, hard = F.col("y"), F.col("hard")
    c = rows.groupBy("region").agg(F.count_if(y & hard).alias("a"), F.count_if(y & ~hard).alias("b"), F.count_if(~y & hard).alias("c"), F.count_if(~y & ~hard).alias("d"))
    p = F.udf(tails.fisher, "double")  # a row for each region
    return c.select("region", F.col("a").alias("both_hold"), F.round(scalar.ratio(F.col("a") * F.col("d"), F.col("b") * F.col("c"), None), 6).alias("odds_ratio"), F.round(p("a", "b", "c", "d"), 6).alias("p"))


@query(_P + """, t AS (SELECT k1 * 10000000 + k3 * 1000 + k2 * 100 + k4 % 100 AS id, fold, y, effort, prob2 * 10 AS d FROM predictions WHERE part = 'val' AND seed = 1 AND k4 % 3 = 0),
  c AS (SELECT covar_samp(effort, effort) AS a, covar_samp(effort, d) AS b, covar_samp(d, d) AS e FROM t), i AS (SELECT e / (a * e - b * b) AS ia, -b / (a * e - b * b) AS ib, a / (a * e - b * b) AS ie FROM c),
  j AS (SELECT p.id, sqrt(ia * pow(p.effort - n.effort, 2) + 2 * ib * (p.effort - n.effort) * (p.d - n.d) + ie * pow(p.d - n.d, 2)) AS far FROM t p JOIN t n ON n.fold = p.fold AND p.y = 1 AND n.y = 0 AND abs(p.effort - n.effort) <= 2 CROSS JOIN i)
  SELECT id, round(min(far), 4) AS distance FROM j GROUP BY id""")  # fmt: skip
def mahalanobis_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each positive is from its nearest negative of the fold, by two correlated numbers."""
    number = F.col("k1") * 10000000 + F.col("k3") * 1000 + F.col("k2") * 100 + F.col("k4") % 100
    rows = predictions(spark, sf_dir).where("part = 'val' and seed = 1 and k4 % 3 = 0").select(number.alias("id"), "fold", "y", "effort", (F.col("prob2") * 10).alias("d"))
    return neighbours.mahalanobis(rows, "id", "fold", ["effort", "d"], "effort", 2.0).select("id", F.round("distance", 4).alias("distance"))
