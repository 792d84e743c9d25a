"""Queries over reviews: labels, prevalence, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.functions.scalar import rounded
from tessella.operators import agreement, labels
from tessella.views import reviews, with_views

_V = with_views("reviews")
_SCORED = """, u AS (SELECT sample, smell, count(*) AS votes, list_sort(list(severity) FILTER (severity IS NOT NULL)) AS s FROM reviews GROUP BY sample, smell)"""
_MEDIAN = _V + _SCORED + ", l AS (SELECT sample, smell, votes, coalesce(s[len(s) // 2 + 1], 0) AS r FROM u), y AS (SELECT *, CASE WHEN r >= 1 THEN 1 ELSE 0 END AS y FROM l)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.unit_labels(reviews(spark, sf_dir))


@query(_MEDIAN + " SELECT sample, smell, votes, CAST(r AS INTEGER) AS rank, y FROM y")
def label_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


@query(_V + _SCORED + ", l AS (SELECT sample, smell, votes, CAST(coalesce(list_max(s), 0) AS INTEGER) AS rank FROM u) SELECT *, CASE WHEN rank >= 1 THEN 1 ELSE 0 END AS y FROM l")
def label_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.unit_labels(reviews(spark, sf_dir), "max")


@query(_V + _SCORED + ", l AS (SELECT sample, smell, votes, CASE WHEN 2 * len(list_filter(s, lambda x: x > 0)) > len(s) THEN 1 ELSE 0 END AS rank FROM u) SELECT *, rank AS y FROM l")
def label_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.unit_labels(reviews(spark, sf_dir), "majority")


@query(_MEDIAN + " SELECT sample, smell, votes, CAST(r AS INTEGER) AS rank, CASE WHEN r >= 2 THEN 1 ELSE 0 END AS y FROM y")
def label_ds2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.unit_labels(reviews(spark, sf_dir), rule="ds2")


@query(_V + """ SELECT sample, smell, count(*) AS votes, count(*) FILTER (severity > 0) AS positive,
  CASE WHEN 2 * count(*) FILTER (severity > 0) >= count(*) THEN 1 ELSE 0 END AS y,
  CASE WHEN count(*) FILTER (severity > 0) IN (0, count(*)) THEN 1 ELSE 0 END AS unanimous
  FROM reviews WHERE severity IS NOT NULL GROUP BY sample, smell""")  # fmt: skip
def label_vote_rule_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.vote_rule(reviews(spark, sf_dir))


_LATEST = _V + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY sample, smell, reviewer ORDER BY ts DESC, id DESC, severity DESC) AS n
  FROM reviews WHERE severity IS NOT NULL), last AS (SELECT sample, smell, reviewer, ts, id, severity FROM ranked WHERE n = 1)"""  # fmt: skip


@query(_LATEST + " SELECT * FROM last")
def review_latest_per_reviewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.latest_reviews(reviews(spark, sf_dir))


@query(_LATEST + " SELECT sample, smell, count(*) AS reviewers, round(avg(CASE WHEN severity > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM last GROUP BY sample, smell")
def review_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.review_share(reviews(spark, sf_dir)).withColumn("share", F.round("share", 6))


_Z = "1.959963984540054"
_WILSON = """round((p + z*z/(2*n)) / (1 + z*z/n) - z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n)), 6) AS low,
  round((p + z*z/(2*n)) / (1 + z*z/n) + z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n)), 6) AS high"""  # fmt: skip


@query(_MEDIAN + f""", c AS (SELECT smell, count(*) AS units, CAST(sum(y) AS BIGINT) AS positives FROM y GROUP BY smell),
  w AS (SELECT *, positives / units AS p, CAST(units AS DOUBLE) AS n, {_Z} AS z FROM c) SELECT smell, units, positives, round(p, 6) AS share, {_WILSON} FROM w""")  # fmt: skip
def prevalence_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.prevalence(_labels(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("share", "low", "high")})


@query(_MEDIAN + " SELECT smell, votes, count(*) AS units, CAST(sum(y) AS BIGINT) AS positives FROM y GROUP BY GROUPING SETS ((smell, votes), (smell), ())")
def prevalence_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.prevalence_sets(_labels(spark, sf_dir), "smell", "votes")


@query(_V + _SCORED + """, r AS (SELECT smell, coalesce(s[len(s) // 2 + 1], 0) AS m, coalesce(list_max(s), 0) AS x, len(list_filter(s, lambda x: x > 0)) AS a, len(s) AS n FROM u)
  SELECT smell, count(*) FILTER (m >= 1) AS median_ds1, count(*) FILTER (m >= 2) AS median_ds2, count(*) FILTER (x >= 1) AS "any", count(*) FILTER (x >= 2) AS any_ds2,
  count(*) FILTER (2 * a > n) AS majority, count(*) FILTER (n > 0 AND a = n) AS "all" FROM r GROUP BY smell""")  # fmt: skip
def rule_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.rule_sensitivity(reviews(spark, sf_dir))


@query(_MEDIAN + """, p AS (SELECT a.smell AS a, b.smell AS b, count(*) AS n, CAST(sum(a.y) AS BIGINT) AS na, CAST(sum(b.y) AS BIGINT) AS nb, CAST(sum(a.y * b.y) AS BIGINT) AS "both"
  FROM y a JOIN y b ON a.sample = b.sample AND a.smell < b.smell GROUP BY a.smell, b.smell)
  SELECT *, round((CAST(n AS DOUBLE) * "both" - CAST(na AS DOUBLE) * nb) / nullif(sqrt(CAST(na AS DOUBLE) * (n - na)) * sqrt(CAST(nb AS DOUBLE) * (n - nb)), 0), 6) AS phi FROM p""", signed=('phi',))  # fmt: skip
def cooccurrence_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.cooccurrence(_labels(spark, sf_dir)).withColumn("phi", F.round("phi", 6))


@query(_V + """, s AS (SELECT sample, array_to_string(list_sort(list(DISTINCT smell)), '+') AS smells FROM reviews GROUP BY sample) SELECT smells, count(*) AS samples FROM s GROUP BY smells""")
def reviewed_combination_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.combinations(reviews(spark, sf_dir))


@query(_V + """, k AS (SELECT *, row_number() OVER (PARTITION BY sample, smell ORDER BY ts, id) AS n FROM reviews WHERE severity IS NOT NULL),
  u AS (SELECT sample, smell, max(severity) FILTER (n = 1) AS f, count(DISTINCT reviewer) AS r, list_sort(list(severity)) AS s FROM k GROUP BY sample, smell),
  t AS (SELECT smell, CASE WHEN f > 0 THEN 'above_none' ELSE 'none' END AS first_review, CASE WHEN r >= 4 THEN '4+' ELSE CAST(r AS VARCHAR) END AS reviewers,
    CASE WHEN s[len(s) // 2 + 1] > 0 THEN 1 ELSE 0 END AS y FROM u)
  SELECT smell, first_review, reviewers, count(*) AS units, CAST(sum(y) AS BIGINT) AS final_positive, CAST(count(*) - sum(y) AS BIGINT) AS final_negative FROM t GROUP BY smell, first_review, reviewers""")  # fmt: skip
def first_review_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.transitions(reviews(spark, sf_dir))


_PHASES = (("p1", "1900-01-01", "2024-01-31"), ("p2", "2024-02-01", "2024-06-30"), ("p3", "2024-07-01", "2999-12-31"))


@query(_V + """, p AS (SELECT *, CASE WHEN CAST(ts AS DATE) <= DATE '2024-01-31' THEN 'p1' WHEN CAST(ts AS DATE) <= DATE '2024-06-30' THEN 'p2' ELSE 'p3' END AS phase FROM reviews)
  SELECT phase, count(*) AS reviews, count(DISTINCT sample) AS samples, count(DISTINCT reviewer) AS reviewers FROM p GROUP BY phase""")  # fmt: skip
def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.phases(reviews(spark, sf_dir), _PHASES)
    return out.groupBy("phase").agg(F.count("*").alias("reviews"), F.countDistinct("sample").alias("samples"), F.countDistinct("reviewer").alias("reviewers"))


@query(_V + """, s AS (SELECT reviewer, sample, min(ts) AS st FROM reviews GROUP BY reviewer, sample),
  g AS (SELECT reviewer, CAST(trunc(epoch_us(st) / 1e6 - epoch_us(lag(st) OVER (PARTITION BY reviewer ORDER BY st, sample)) / 1e6) AS BIGINT) AS gap FROM s)
  SELECT reviewer, count(*) AS sessions, round(avg(gap), 4) AS mean_gap, max(gap) AS max_gap FROM g GROUP BY reviewer""")  # fmt: skip
def session_gap_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.session_gaps(reviews(spark, sf_dir)).withColumn("mean_gap", F.round("mean_gap", 4))


@query(_V + """, p AS (SELECT smell, id, CASE WHEN severity > 0 THEN 1 ELSE 0 END AS v FROM reviews WHERE severity IS NOT NULL),
  n AS (SELECT *, row_number() OVER (PARTITION BY smell ORDER BY id) - row_number() OVER (PARTITION BY smell, v ORDER BY id) AS g FROM p),
  r AS (SELECT smell, v, g, count(*) AS n FROM n GROUP BY smell, v, g) SELECT smell, v, max(n) AS longest FROM r GROUP BY smell, v""")  # fmt: skip
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).where("severity is not null").withColumn("v", (F.col("severity") > 0).cast("int"))
    return labels.longest_runs(rows, "smell", ["id"], "v")


_COUNTS = _V + ", c AS (SELECT smell, sample, count(*) AS v FROM reviews GROUP BY smell, sample)"


def _per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).groupBy("smell", "sample").agg(F.count("*").alias("v"))


@query(_COUNTS + """, o AS (SELECT smell, v, sum(v) OVER (PARTITION BY smell ORDER BY v, sample ROWS UNBOUNDED PRECEDING) AS run FROM c)
  SELECT smell, count(*) AS n, round((count(*) + 1 - 2.0 * sum(run) / sum(v)) / count(*), 6) AS gini FROM o GROUP BY smell""")  # fmt: skip
def gini_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.concentration(_per_sample(spark, sf_dir), "smell", "v").withColumn("gini", F.round("gini", 6))


@query(_COUNTS + """ SELECT smell, sample, round(row_number() OVER (PARTITION BY smell ORDER BY v, sample) / count(*) OVER (PARTITION BY smell), 6) AS x,
  round(sum(v) OVER (PARTITION BY smell ORDER BY v, sample ROWS UNBOUNDED PRECEDING) / sum(v) OVER (PARTITION BY smell), 6) AS y FROM c""")  # fmt: skip
def lorenz_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.lorenz(_per_sample(spark, sf_dir), "smell", "v", "sample").withColumns({c: F.round(c, 6) for c in "xy"})


_PAIRS = _V + """, m AS (SELECT smell, sample, count(*) AS m FROM reviews WHERE severity IS NOT NULL GROUP BY smell, sample HAVING count(*) > 1),
  o AS (SELECT a.smell, a.severity AS c, b.severity AS k, sum(1.0 / (m.m - 1)) AS o FROM reviews a JOIN reviews b ON a.smell = b.smell AND a.sample = b.sample AND a.id <> b.id
    JOIN m ON m.smell = a.smell AND m.sample = a.sample WHERE a.severity IS NOT NULL AND b.severity IS NOT NULL GROUP BY a.smell, a.severity, b.severity),
  n AS (SELECT smell, c AS v, sum(o) AS n FROM o GROUP BY smell, c)"""  # fmt: skip


def _alpha_sql(delta: str) -> str:
    return _PAIRS + f""", g AS (SELECT a.smell, a.n AS nc, b.n AS nk, coalesce(o.o, 0) AS o, {delta} AS d FROM n a JOIN n b ON a.smell = b.smell LEFT JOIN o ON o.smell = a.smell AND o.c = a.v AND o.k = b.v),
  t AS (SELECT smell, sum(n) AS s FROM n GROUP BY smell)
  SELECT g.smell, round(max(t.s), 6) AS "values", round(1 - (max(t.s) - 1) * sum(g.o * g.d) / nullif(sum(g.nc * g.nk * g.d), 0), 6) AS alpha FROM g JOIN t ON t.smell = g.smell GROUP BY g.smell"""  # fmt: skip


def _alpha(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    out = agreement.krippendorff_alpha(agreement.coincidences(reviews(spark, sf_dir)), metric)
    return out.withColumns({c: F.round(c, 6) for c in ("values", "alpha")})


@query(_alpha_sql("CASE WHEN a.v <> b.v THEN 1.0 ELSE 0.0 END"), signed=('alpha',))
def krippendorff_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alpha(spark, sf_dir, "nominal")


@query(_alpha_sql("CAST((a.v - b.v) * (a.v - b.v) AS DOUBLE)"), signed=('alpha',))
def krippendorff_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alpha(spark, sf_dir, "interval")


@query(_alpha_sql("pow((SELECT sum(x.n) FROM n x WHERE x.smell = a.smell AND x.v BETWEEN least(a.v, b.v) AND greatest(a.v, b.v)) - (a.n + b.n) / 2, 2)"), signed=('alpha',))
def krippendorff_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alpha(spark, sf_dir, "ordinal")


@query(_LATEST + """, p AS (SELECT a.reviewer AS a, b.reviewer AS b, count(*) AS units, avg(CASE WHEN (a.severity > 0) = (b.severity > 0) THEN 1.0 ELSE 0.0 END) AS agree,
  avg(CASE WHEN a.severity > 0 THEN 1.0 ELSE 0.0 END) AS pa, avg(CASE WHEN b.severity > 0 THEN 1.0 ELSE 0.0 END) AS pb
  FROM last a JOIN last b ON a.sample = b.sample AND a.smell = b.smell AND a.reviewer < b.reviewer GROUP BY a.reviewer, b.reviewer HAVING count(*) >= 2),
  e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM p) SELECT a, b, units, round(agree, 6) AS agree, round(CASE WHEN pe < 1 THEN (agree - pe) / (1 - pe) END, 6) AS kappa FROM e""", signed=('kappa',))  # fmt: skip
def cohen_kappa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.rater_pairs(labels.latest_reviews(reviews(spark, sf_dir))).withColumns({c: rounded(c) for c in ("agree", "kappa")})


@query(_V + """, k AS (SELECT * FROM reviews WHERE severity IS NOT NULL),
  h AS (SELECT a.smell, a.id, a.severity > 0 AS said, list_sort(list(b.severity)) AS s FROM k a JOIN k b ON a.sample = b.sample AND a.smell = b.smell AND a.id <> b.id GROUP BY a.smell, a.id, a.severity > 0),
  t AS (SELECT smell, said, s[len(s) // 2 + 1] > 0 AS truth FROM h),
  c AS (SELECT smell, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn, count(*) FILTER (NOT truth AND NOT said) AS tn FROM t GROUP BY smell)
  SELECT *, round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE)) * sqrt(CAST(tp + fn AS DOUBLE)) * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn AS DOUBLE)), 0), 0), 6) AS mcc FROM c""", signed=('mcc',))  # fmt: skip
def heldout_reviewer_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.held_out_reviewer(reviews(spark, sf_dir)).withColumn("mcc", F.round("mcc", 6))


@query(_V + """, u AS (SELECT smell, sample, min(severity) = max(severity) AS e FROM reviews WHERE severity IS NOT NULL GROUP BY smell, sample HAVING count(*) > 1)
  SELECT smell, count(*) AS units, round(avg(CASE WHEN e THEN 1.0 ELSE 0.0 END), 6) AS unanimous FROM u GROUP BY smell""")  # fmt: skip
def unanimity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.unanimity(reviews(spark, sf_dir)).withColumn("unanimous", F.round("unanimous", 6))


@query(_V + """, k AS (SELECT smell, severity FROM reviews WHERE severity IS NOT NULL), a AS (SELECT smell, count(*) AS na FROM k GROUP BY smell), b AS (SELECT severity, count(*) AS nb FROM k GROUP BY severity),
  c AS (SELECT smell, severity, count(*) AS o FROM k GROUP BY smell, severity), n AS (SELECT count(*) AS n FROM k),
  g AS (SELECT a.smell, b.severity, coalesce(o, 0) AS o, na * nb / n AS e, n FROM a CROSS JOIN b CROSS JOIN n LEFT JOIN c ON c.smell = a.smell AND c.severity = b.severity),
  s AS (SELECT sum(pow(o - e, 2) / e) AS chi2, count(DISTINCT smell) AS r, count(DISTINCT severity) AS k, max(n) AS n FROM g)
  SELECT round(chi2, 6) AS chi2, (r - 1) * (k - 1) AS dof, round(sqrt(chi2 / (n * (least(r, k) - 1))), 6) AS cramer_v FROM s""")  # fmt: skip
def chi_square_smell_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).where("severity is not null")
    return agreement.contingency(rows, "smell", "severity").withColumns({c: F.round(c, 6) for c in ("chi2", "cramer_v")})


@query(_MEDIAN + """, r AS (SELECT reviewer, sample, smell, severity FROM reviews WHERE severity IS NOT NULL)
  SELECT reviewer, count(*) AS reviews, count(*) FILTER ((severity > 0) <> (y.y = 1)) AS against, round(avg(CASE WHEN severity > 0 THEN 1.0 ELSE 0.0 END), 6) AS rate
  FROM r JOIN y ON y.sample = r.sample AND y.smell = r.smell GROUP BY reviewer""")  # fmt: skip
def reviewer_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).where("severity is not null").join(_labels(spark, sf_dir), ["sample", "smell"])
    above = F.col("severity") > 0
    return rows.groupBy("reviewer").agg(F.count("*").alias("reviews"), F.count_if(above != (F.col("y") == 1)).alias("against"), F.round(F.avg(above.cast("double")), 6).alias("rate"))


@query(_V + """, s AS (SELECT sample, list_sort(list(DISTINCT CASE WHEN smell < 2 THEN 'class' ELSE 'method' END)) AS l FROM reviews GROUP BY sample)
  SELECT sample, CASE len(l) WHEN 1 THEN l[1] ELSE 'mixed' END AS level FROM s""")  # fmt: skip
def sample_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("smell") < 2, "class").otherwise("method")
    out = reviews(spark, sf_dir).groupBy("sample").agg(F.min(level).alias("a"), F.max(level).alias("b"))
    return out.select("sample", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("level"))
