"""Reviews to labels: severities, shares, rules, prevalence. A unit is a (sample, smell) pair.

All aggregates are counts or maxima, so they combine before the shuffle and no unit's reviews meet
as a list, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import ratio, wilson

#: Severities in order.
SEVERITIES = ("none", "minor", "major", "critical")
#: Severities that count as positive under each rule.
RULES = {"ds1": ("minor", "major", "critical"), "ds2": ("major", "critical")}
UNIT = ("sample", "smell")


def severity_rank(name: Column) -> Column:
    """0 to 3; null for a severity that isn't known."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), name) - 1
    return F.when(at >= 0, at.cast("int"))


def rule_ranks(rule: str) -> list[int]:
    """Ranks that a rule counts as positive: a name in RULES or severities with commas between."""
    names = RULES.get(rule) or tuple(x.strip() for x in rule.split(",") if x.strip())
    unknown = sorted(set(names) - set(SEVERITIES))
    if unknown or not names:
        raise ValueError(f"not a rule: {rule!r}")
    return [SEVERITIES.index(x) for x in names]


def severity_counts(reviews: DataFrame, by: Sequence[str] = UNIT) -> DataFrame:
    """votes (all reviews) and c0 to c3 (those of each severity) of each unit."""
    return reviews.groupBy(*by).agg(F.count("*").alias("votes"), *[F.count_if(F.col("severity") == k).alias(f"c{k}") for k in range(4)])


def aggregated(counts: DataFrame, method: str = "median") -> DataFrame:
    """`rank` of each unit from its severity counts; unknown severities don't count, a unit without others gets none."""
    c = [F.col(f"c{k}") for k in range(4)]
    n = c[0] + c[1] + c[2] + c[3]
    if method == "max":
        rank = F.when(c[3] > 0, 3).when(c[2] > 0, 2).when(c[1] > 0, 1).otherwise(0)
    elif method == "majority":
        rank = F.when(n - c[0] > c[0], 1).otherwise(0)
    elif method == "median":  # the upper one of two
        at = F.floor(n / 2)
        rank = F.when((n == 0) | (at < c[0]), 0).when(at < c[0] + c[1], 1).when(at < c[0] + c[1] + c[2], 2).otherwise(3)
    else:
        raise ValueError(f"unknown method: {method}")
    return counts.withColumn("rank", rank)


def unit_labels(reviews: DataFrame, method: str = "median", rule: str = "ds1", by: Sequence[str] = UNIT) -> DataFrame:
    """(unit, votes, rank, y)"""
    out = aggregated(severity_counts(reviews, by), method)
    return out.select(*by, "votes", "rank", F.col("rank").isin(rule_ranks(rule)).cast("int").alias("y"))


def vote_rule(reviews: DataFrame, by: Sequence[str] = UNIT) -> DataFrame:
    """Positive if at least half of the known votes are (a tie is), and whether all votes agree."""
    known = reviews.where("severity is not null").groupBy(*by).agg(F.count("*").alias("votes"), F.count_if(F.col("severity") > 0).alias("positive"))
    return known.withColumns({"y": (2 * F.col("positive") >= F.col("votes")).cast("int"), "unanimous": ((F.col("positive") == 0) | (F.col("positive") == F.col("votes"))).cast("int")})


def latest_reviews(reviews: DataFrame, by: Sequence[str] = (*UNIT, "reviewer")) -> DataFrame:
    """Each reviewer's last review of a unit: the largest time, then id."""
    last = reviews.where("severity is not null").groupBy(*by).agg(F.max(F.struct("ts", "id", "severity")).alias("r"))
    return last.select(*by, "r.ts", "r.id", "r.severity")


def review_share(reviews: DataFrame) -> DataFrame:
    """Share of a unit's reviewers whose last review is positive."""
    last = latest_reviews(reviews)
    return last.groupBy(*UNIT).agg(F.count("*").alias("reviewers"), F.avg((F.col("severity") > 0).cast("double")).alias("share"))


def prevalence(labels: DataFrame, by: str = "smell") -> DataFrame:
    """Units, positives, and their share with an interval."""
    out = labels.groupBy(by).agg(F.count("*").alias("units"), F.sum("y").cast("long").alias("positives"))
    low, high = wilson(F.col("positives"), F.col("units"))
    return out.withColumns({"share": ratio(F.col("positives"), F.col("units")), "low": low, "high": high})


def prevalence_sets(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Units and positives by (a, b), by a, and in all."""
    return labels.groupingSets([[a, b], [a], []], a, b).agg(F.count("*").alias("units"), F.sum("y").cast("long").alias("positives"))


def rule_sensitivity(reviews: DataFrame) -> DataFrame:
    """Positive units of each smell under six rules."""
    c = severity_counts(reviews)
    n = F.col("c0") + F.col("c1") + F.col("c2") + F.col("c3")
    above = n - F.col("c0")
    median = aggregated(c)
    both = median.withColumn("most", F.when(F.col("c3") > 0, 3).when(F.col("c2") > 0, 2).when(F.col("c1") > 0, 1).otherwise(0)).withColumns({"above": above, "known": n})
    rules = {"median_ds1": F.col("rank") >= 1, "median_ds2": F.col("rank") >= 2, "any": F.col("most") >= 1, "any_ds2": F.col("most") >= 2, "majority": F.col("above") * 2 > F.col("known"), "all": (F.col("known") > 0) & (F.col("above") == F.col("known"))}
    return both.groupBy("smell").agg(*[F.count_if(x).alias(k) for k, x in rules.items()])


def cooccurrence(labels: DataFrame) -> DataFrame:
    """For each pair of smells: samples with both labels, how often each and both are positive, phi."""
    a = labels.select("sample", F.col("smell").alias("a"), F.col("y").alias("ya"))
    b = labels.select("sample", F.col("smell").alias("b"), F.col("y").alias("yb"))
    pairs = a.join(b, "sample").where("a < b").groupBy("a", "b")
    out = pairs.agg(F.count("*").alias("n"), F.sum("ya").cast("long").alias("na"), F.sum("yb").cast("long").alias("nb"), F.sum(F.col("ya") * F.col("yb")).cast("long").alias("both"))
    n, na, nb, both = (F.col(x).cast("double") for x in ("n", "na", "nb", "both"))
    return out.withColumn("phi", ratio(n * both - na * nb, F.sqrt(na * (n - na)) * F.sqrt(nb * (n - nb)), None))


def combinations(reviews: DataFrame) -> DataFrame:
    """How many samples have just these smells reviewed."""
    smells = F.array_join(F.array_sort(F.collect_set("smell")), "+")  # as many as there are smells
    return reviews.groupBy("sample").agg(smells.alias("smells")).groupBy("smells").agg(F.count("*").alias("samples"))


def first_reviews(reviews: DataFrame) -> DataFrame:
    """Of each unit: severity of the first review by (time, id), number of reviewers, final label."""
    known = reviews.where("severity is not null")
    per = known.groupBy(*UNIT).agg(F.min(F.struct("ts", "id", "severity")).alias("first"), F.countDistinct("reviewer").alias("reviewers"), *[F.count_if(F.col("severity") == k).alias(f"c{k}") for k in range(4)])
    return aggregated(per).select(*UNIT, F.col("first.severity").alias("first"), "reviewers", (F.col("rank") > 0).cast("int").alias("y"))


def transitions(reviews: DataFrame) -> DataFrame:
    """Final labels by first review and number of reviewers, four and more together."""
    first = F.when(F.col("first") > 0, "above_none").otherwise("none")
    pooled = F.when(F.col("reviewers") >= 4, "4+").otherwise(F.col("reviewers").cast("string"))
    out = first_reviews(reviews).groupBy("smell", first.alias("first_review"), pooled.alias("reviewers"))
    return out.agg(F.count("*").alias("units"), F.sum("y").cast("long").alias("final_positive")).withColumn("final_negative", F.col("units") - F.col("final_positive"))


def phases(reviews: DataFrame, bounds: Sequence[tuple[str, str, str]]) -> DataFrame:
    """`phase` of each review, by days from and to, both included; an error for a day outside all."""
    day = F.to_date("ts")
    phase = None
    for name, start, end in bounds:
        inside = day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        phase = F.when(inside, name) if phase is None else phase.when(inside, name)
    return reviews.withColumn("phase", phase.otherwise(F.when(day.isNotNull(), F.raise_error(F.concat(F.lit("no phase holds "), day.cast("string"))))))


def session_gaps(reviews: DataFrame) -> DataFrame:
    """Per reviewer: sessions (one for each sample), and mean and largest seconds between their starts."""
    sessions = reviews.groupBy("reviewer", "sample").agg(F.min("ts").alias("start"))
    before = F.lag("start").over(Window.partitionBy("reviewer").orderBy("start", "sample"))
    gap = F.timestamp_diff("SECOND", before, F.col("start"))
    return sessions.withColumn("gap", gap).groupBy("reviewer").agg(F.count("*").alias("sessions"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))


def longest_runs(rows: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    """The longest run of equal values of each kind, in order."""
    w = Window.partitionBy(by).orderBy(*order)
    change = (F.col(value) != F.lag(value).over(w)).cast("int")
    runs = rows.withColumn("_change", F.coalesce(change, F.lit(0))).withColumn("_run", F.sum("_change").over(w))
    return runs.groupBy(by, value, "_run").agg(F.count("*").alias("n")).groupBy(by, value).agg(F.max("n").alias("longest"))


def concentration(counts: DataFrame, by: str, value: str) -> DataFrame:
    """Gini index of a value in each group, by its rank sum; null for none or only zeros."""
    w = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.withColumn("_run", F.sum(value).over(w))
    out = run.groupBy(by).agg(F.count("*").alias("n"), F.sum("_run").cast("double").alias("_runs"), F.sum(value).cast("double").alias("total"))
    gini = (F.col("n") + 1 - 2 * F.col("_runs") / F.col("total")) / F.col("n")
    return out.select(by, "n", F.when(F.col("total") != 0, gini).alias("gini"))


def lorenz(counts: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """Points of the Lorenz curve: share of rows against share of the value, smallest first."""
    order = Window.partitionBy(by).orderBy(value, key)
    run, all_rows = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(by)
    x = F.row_number().over(order) / F.count("*").over(all_rows)
    y = ratio(F.sum(value).over(run), F.sum(value).over(all_rows), None)
    return counts.select(by, key, x.alias("x"), y.alias("y"))
