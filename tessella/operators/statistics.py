"""Tests and effect sizes over tables of metrics or samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import ratio
from tessella.operators.ordered import ranked, running


def paired(cells: DataFrame, a: str, b: str, key: Sequence[str], metric: str) -> DataFrame:
    """(key, delta): model a less model b where both have the cell."""
    value = lambda m: F.max(F.when(F.col("model") == m, F.col(metric)))
    return cells.where(F.col("model").isin(a, b)).groupBy(*key).agg(value(a).alias("va"), value(b).alias("vb")).where("va is not null and vb is not null").select(*key, (F.col("va") - F.col("vb")).alias("delta"))


def corrected_t(deltas: DataFrame, test_train: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean difference and the t statistic corrected for overlapping training sets; null below two or without variance."""
    out = deltas.groupBy(*by).agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.var_samp("delta").alias("variance"))
    t = F.col("mean_delta") / F.sqrt((1 / F.col("n") + test_train) * F.col("variance"))
    return out.select(*by, "n", "mean_delta", F.when((F.col("n") > 1) & (F.col("variance") > 0), t).alias("t"))


def holm(tests: DataFrame, p: str, key: Sequence[str]) -> DataFrame:
    """Step-down adjusted p values of one family (as many rows as there are tests)."""
    order = Window.orderBy(p, *key)
    m, rank = F.count("*").over(Window.partitionBy()), F.row_number().over(order)
    scaled = tests.withColumn("_s", F.least(F.lit(1.0), (m - rank + 1) * F.col(p)))
    return scaled.withColumn("p_holm", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")


def spearman(rows: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    both = ranked(ranked(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()), by, a, "_a"), by, b, "_b")
    # null where one of them doesn't vary
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")).alias("rho"))


def smd(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Standardised mean difference of positives less negatives of each value, over the pooled deviation."""
    out = rows.groupBy(*by)
    aggs = []
    for v in values:
        pos, neg = F.when(F.col("y") == 1, F.col(v)), F.when(F.col("y") == 0, F.col(v))
        sd = F.sqrt((F.var_samp(pos) + F.var_samp(neg)) / 2)
        aggs.append(F.when(sd == 0, 0.0).otherwise((F.avg(pos) - F.avg(neg)) / sd).alias(v))
    return out.agg(*aggs)


def a12(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Share of paired cells where a is higher, ties half."""
    won = F.when(F.col(a) > F.col(b), 1.0).when(F.col(a) == F.col(b), 0.5).otherwise(0.0)
    return pairs.groupBy(*by).agg(F.avg(won).alias("a12"))


def mann_whitney(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """U of positives, from counts at distinct values."""
    from tessella.operators.metrics import score_steps

    steps = score_steps(rows.withColumn("p", F.col(value)), by)
    won = F.col("pos") * (F.col("all_neg") - (F.col("fp") - F.col("neg")) - F.col("neg") / 2)
    return steps.groupBy(*by).agg(F.max("all_pos").alias("n1"), F.max("all_neg").alias("n0"), F.sum(won).alias("u"))


def quantile_ranks(rows: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], rule: str = "linear") -> DataFrame:
    """Quantiles by interpolation, or of the value at the rank that half-even or floor rounding gives."""
    if rule == "linear":
        return rows.groupBy(*by).agg(*[F.percentile(value, F.lit(q)).alias(f"q{round(100 * q)}") for q in quantiles])
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_k"))
    places = running(counts, by, F.col(value), {"_upto": F.col("_k")})
    n = F.col("all__upto")
    at = (lambda q: F.bround(q * (n - 1))) if rule == "half_even" else (lambda q: F.floor(q * (n - 1)))
    there = lambda q: (F.col("_upto") - F.col("_k") <= at(q)) & (at(q) < F.col("_upto"))
    return places.groupBy(*by).agg(*[F.max(F.when(there(q), F.col(value))).alias(f"q{round(100 * q)}") for q in quantiles])


def best_epoch(history: DataFrame, by: Sequence[str], epoch: str, metric: str, patience: int) -> DataFrame:
    """The epoch that early stopping keeps: the last strict improvement before `patience` epochs without one."""
    w = Window.partitionBy(*by).orderBy(epoch)
    past = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = (past.isNull() | (F.col(metric) > past)).cast("int")
    marked = history.withColumn("_better", better).withColumn("_at", F.max(F.when(F.col("_better") == 1, F.col(epoch))).over(w))
    stopped = F.max(((F.col(epoch) - F.col("_at")) >= patience).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    live = marked.withColumn("_stop", F.coalesce(stopped, F.lit(0))).where("_stop = 0 and _better = 1")
    return live.groupBy(*by).agg(F.max(F.struct(metric, epoch)).alias("m")).select(*by, F.col(f"m.{epoch}").alias(epoch), F.col(f"m.{metric}").alias(metric))


def signed_ranks(rows: DataFrame, d: str, zero: float = 1e-12) -> DataFrame:
    """(n, w): differences that aren't 0, and the smaller sum of the ranks of their sizes by sign; sizes equal to 12 digits are tied."""
    held = rows.where(F.abs(d) > zero).select(F.col(d).alias("_d"), F.round(F.abs(d), 12).alias("_a")).withColumn("_one", F.lit(1))
    out = ranked(held, ["_one"], "_a", "_r").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_r"))), F.lit(0.0)).alias("plus"))
    return out.select("n", F.least("plus", F.col("n") * (F.col("n") + 1) / 2 - F.col("plus")).alias("w"))
