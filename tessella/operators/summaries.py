"""Summaries of runs: by configuration, over seeds, by scope, over labels with different supports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalar import canonical, f1, ratio

COUNTS = ("tp", "fp", "fn", "tn")


def by_configuration(runs: DataFrame, options: dict[str, Column], metrics: Sequence[str]) -> DataFrame:
    """(combo, runs, mean and population deviation of each metric): runs whose options are equal, as one JSON text in the order of names."""
    held = runs.withColumn("combo", canonical(options))
    aggs = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return held.groupBy("combo").agg(F.count("*").alias("runs"), *aggs)


def over_seeds(cells: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means and population deviations over seeds, and the confusion counts added up."""
    aggs = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return cells.groupBy(*by).agg(F.count("*").alias("seeds"), *aggs, *[F.sum(c).cast("long").alias(c) for c in COUNTS])


def by_scope(counts: DataFrame, label: str, level: str) -> DataFrame:
    """Confusion counts of each label, of all labels of a level, and of all: (scope, tp, fp, fn, tn)."""
    scopes = F.explode(F.array(F.concat(F.lit("label:"), F.col(label).cast("string")), F.concat(F.lit("level:"), F.col(level).cast("string")), F.lit("all"))).alias("scope")
    return counts.select("*", scopes).groupBy("scope").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])


def composed(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Macro F1 over labels, whatever their supports, over those that have any row; micro F1 of the counts added up; labels and support."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    support = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    held = counts.where(support > 0)
    total = [F.sum(c) for c in ("tp", "fp", "fn")]
    return held.groupBy(*by).agg(F.avg(f1(tp, fp, fn)).alias("macro_f1"), ratio(2 * total[0], 2 * total[0] + total[1] + total[2]).alias("micro_f1"), F.count("*").alias("labels"), F.sum(support).cast("long").alias("support"))
