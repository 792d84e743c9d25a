"""Effort-aware ranking, routing to an expensive judge, and size control.

The rank metrics follow one total order: score descending, then a hash of the row's key, so that
ties fall the same way on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import mcc, ratio
from tessella.operators.ordered import running


def effort(loc: Column, overhead: float = 0.0) -> Column:
    return F.greatest(loc.cast("double"), F.lit(1.0)) + overhead


def _said(rows: DataFrame, by: Sequence[str], key: Sequence[str], order: Column) -> DataFrame:
    """Rows with rank, effort and positives up to them in the order of a number, then of the key, and the cell's totals."""
    sums = {"rank": F.lit(1), "x": F.col("effort"), "p_up": F.col("y")}
    return running(rows, by, order, sums, [F.col(k) for k in key]).withColumnsRenamed({"all_rank": "n", "all_x": "all_effort", "all_p_up": "all_pos"})


def _extremes(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, b, w): areas of the best and the worst order, all effort and positives as 1.

    Rows without a positive add nothing but their effort, before or after all others; of equal efforts
    n positives after k others add n * k + n * n / 2 efforts. So both follow from counts of efforts.
    """
    counts = rows.groupBy(*by, "effort").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    held = running(counts, by, F.col("effort"), {"upto": F.col("k"), "e": F.col("effort") * F.col("n"), "z": F.col("effort") * (F.col("n") - F.col("k"))})
    k, e, total = F.col("k"), F.col("effort"), F.col("all_upto")
    up = lambda first: F.sum(e * (k * first + k * k / 2))
    whole = F.max("all_e") * F.max(total)
    return held.groupBy(*by).agg(((up(F.col("upto") - k) + F.max("all_z") * F.max(total)) / whole).alias("b"), (up(total - F.col("upto")) / whole).alias("w"))


def rank_metrics(rows: DataFrame, by: Sequence[str], key: Sequence[str], budget: float = 0.2, top: float = 0.1, order: Column | None = None) -> DataFrame:
    """recall_at_budget, pci_at_budget, popt, ifa, precision_at_top of rows (y, p, effort) with both classes, inspected in ascending `order` (by default the largest p first)."""
    held = _said(rows, by, key, -F.col("p") if order is None else order).where("all_pos > 0 and all_pos < n")
    inside = F.col("x") / F.col("all_effort") <= budget + 1e-12
    above = F.col("rank") <= F.ceil(top * F.col("n"))
    area = F.sum(F.col("effort") * (2 * F.col("p_up") - F.col("y")) / 2) / (F.max("all_effort") * F.max("all_pos"))
    out = held.groupBy(*by).agg(
        ratio(F.sum(F.when(inside, F.col("y")).otherwise(0)), F.max("all_pos")).alias("recall_at_budget"), F.avg(inside.cast("double")).alias("pci_at_budget"), area.alias("a"),
        (F.min(F.when(F.col("y") == 1, F.col("rank"))) - 1).cast("long").alias("ifa"), F.avg(F.when(above, F.col("y"))).alias("precision_at_top"),
    )
    out = out.join(_extremes(rows, by), [*by])
    return out.select(*by, "recall_at_budget", "pci_at_budget", ratio(F.col("a") - F.col("w"), F.col("b") - F.col("w"), None).alias("popt"), "ifa", "precision_at_top")


def alberg(rows: DataFrame, by: Sequence[str], key: Sequence[str], points: int = 101) -> DataFrame:
    """Share of positives found at even shares of effort, interpolated between inspected rows."""
    held = _said(rows, by, key, -F.col("p")).where("all_pos > 0")
    x1, p1 = F.col("x") / F.col("all_effort"), F.col("p_up") / F.col("all_pos")
    held = held.withColumns({"x1": x1, "p1": p1, "x0": (F.col("x") - F.col("effort")) / F.col("all_effort"), "p0": (F.col("p_up") - F.col("y")) / F.col("all_pos")})
    # grid points in (x0, x1]: each belongs to one row, the first point to none
    n = points - 1
    first, last = F.floor(F.col("x0") * n + 1e-9) + 1, F.floor(F.col("x1") * n + 1e-9)
    hit = held.where(first <= last).withColumn("g", F.explode(F.sequence(first, last)))
    share = F.col("p0") + (F.col("p1") - F.col("p0")) * F.least(F.lit(1.0), (F.col("g") / n - F.col("x0")) / (F.col("x1") - F.col("x0")))
    zero = held.select(*by).distinct().withColumns({"grid": F.lit(0.0), "share": F.lit(0.0)})
    return hit.select(*by, (F.col("g") / n).alias("grid"), share.alias("share")).unionAll(zero)


def route(rows: DataFrame, by: Sequence[str], priority: Column, tie: Sequence[Column], share: float) -> DataFrame:
    """`routed`: whether a row is among the round(share * n) of highest priority; halves round to even."""
    n = F.bround(share * F.count("*").over(Window.partitionBy(*by)))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(priority.desc(), *tie))
    return rows.withColumn("routed", rank <= n)


def oracle_route(rows: DataFrame, by: Sequence[str], cheap: Column, costly: Column, share: float) -> DataFrame:
    """Best MCC when at most round(share * n) rows go to the costly judge and only errors that it fixes do.

    Every split of the budget between false negatives and false positives is scored from counts.
    """
    y = F.col("y") == 1
    fix = (cheap != y) & (costly == y)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(fix & y).alias("fix_fn"), F.count_if(fix & ~y).alias("fix_fp"),
        F.count_if(y & cheap).alias("tp"), F.count_if(~y & cheap).alias("fp"), F.count_if(y & ~cheap).alias("fn"), F.count_if(~y & ~cheap).alias("tn"),
    )
    out = out.withColumn("k", F.least(F.bround(share * F.col("n")).cast("long"), F.col("fix_fn") + F.col("fix_fp")))
    splits = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("k") - F.col("fix_fp")), F.least("k", "fix_fn"))
    a = F.col("a")
    rest = F.col("k") - a
    score = mcc(F.col("tp") + a, F.col("fp") - rest, F.col("fn") - a, F.col("tn") + rest)
    each = out.withColumn("a", F.explode(splits)).withColumn("score", score)
    return each.groupBy(*by).agg(F.max(F.struct("score", (-a).alias("m"))).alias("x"), F.max("k").alias("routed")).select(*by, "routed", (-F.col("x.m")).alias("false_negatives"), F.col("x.score").alias("mcc"))


def stratified_auc(rows: DataFrame, by: Sequence[str], stratum: str) -> DataFrame:
    """ROC-AUC over pairs of one stratum only."""
    from tessella.operators.metrics import score_steps

    steps = score_steps(rows, [*by, stratum])
    above = F.col("fp") - F.col("neg")
    won = F.col("pos") * (F.col("all_neg") - above - F.col("neg") / 2)
    strata = steps.groupBy(*by, stratum).agg(F.sum(won).alias("won"), F.max(F.col("all_pos") * F.col("all_neg")).alias("pairs"))
    return strata.groupBy(*by).agg(ratio(F.sum("won"), F.sum("pairs"), None).alias("auc"))


def random_expectation(rows: DataFrame, by: Sequence[str], budget: float = 0.2) -> DataFrame:
    """(by, expected_recall, positives, expected_ifa) of a random order: recall grows with effort, and k positives part the n - k others into k + 1 equal stretches."""
    n, k = F.count("*"), F.sum("y").cast("long")
    return rows.groupBy(*by).agg(F.lit(budget).alias("expected_recall"), k.alias("positives"), ((n + 1) / (k + 1) - 1).alias("expected_ifa"))
