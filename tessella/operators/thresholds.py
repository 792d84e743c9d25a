"""Choice of thresholds on validation rows (y, p) of each cell.

A threshold's counts are sums from its place in the grid up, so rows are counted by grid step and
one window runs over the steps: rows aren't joined with the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import f1, mcc


def grid(steps: int = 101, low: float = 0.0, high: float = 1.0, single: bool = True) -> list[float]:
    """Evenly spaced thresholds; `single` rounds them to single precision, as they are compared then."""
    return [float(x) for x in np.linspace(low, high, steps, dtype=np.float32 if single else np.float64)]


def step_of(p: Column, thresholds: Sequence[float]) -> Column:
    """Number of the largest threshold that p reaches; -1 below all.

    The even spacing gives the step up to rounding, the thresholds themselves decide.
    """
    n, low, high = len(thresholds), thresholds[0], thresholds[-1]
    held = F.split(F.lit(",".join(map(repr, thresholds))), ",").cast("array<double>")
    guess = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.round((p - low) / (high - low) * (n - 1)).cast("int")))
    return F.when(F.get(held, guess) <= p, F.when((guess < n - 1) & (F.get(held, guess + 1) <= p), guess + 1).otherwise(guess)).otherwise(guess - 1)


def sweep(rows: DataFrame, by: Sequence[str], thresholds: Sequence[float], weight: str | None = None) -> DataFrame:
    """(by, step, t, tp, fp, fn, tn) of every threshold of the grid; with `weight`, rows count so many times."""
    times = F.lit(1) if weight is None else F.col(weight)
    counts = rows.groupBy(*by, step_of(F.col("p"), thresholds).alias("at")).agg(F.sum(F.col("y") * times).cast("long").alias("pos"), F.sum((1 - F.col("y")) * times).cast("long").alias("neg"))
    whole = Window.partitionBy(*by)
    counts = counts.withColumns({"all_pos": F.sum("pos").over(whole), "all_neg": F.sum("neg").over(whole)})
    # a row for each step that has rows, the first also for those below; steps between two take the counts of the upper one
    order = Window.partitionBy(*by).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counts.withColumns({"tp": F.sum("pos").over(order), "fp": F.sum("neg").over(order), "below": F.lag("at", -1, -1).over(Window.partitionBy(*by).orderBy(F.desc("at")))})
    steps = reached.where("at >= 0").withColumn("step", F.explode(F.sequence(F.greatest(F.col("below"), F.lit(-1)) + 1, F.col("at"))))
    top = counts.groupBy(*by).agg(F.max("at").alias("last"), F.max("all_pos").alias("all_pos"), F.max("all_neg").alias("all_neg")).where(F.col("last") < len(thresholds) - 1)
    rest = top.withColumn("step", F.explode(F.sequence(F.col("last") + 1, F.lit(len(thresholds) - 1)))).withColumns({"tp": F.lit(0).cast("long"), "fp": F.lit(0).cast("long")})
    columns = [*by, "step", "tp", "fp", "all_pos", "all_neg"]
    held = F.split(F.lit(",".join(map(repr, thresholds))), ",").cast("array<double>")
    out = steps.select(*columns).unionAll(rest.select(*columns))
    return out.select(*by, "step", F.get(held, F.col("step")).alias("t"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"))


def best(swept: DataFrame, by: Sequence[str], objective: str = "f1", empty: float | None = 0.5) -> DataFrame:
    """(by, threshold, score): the lowest threshold with the best value; `empty` where there is no positive, null to go by the scores."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    value = f1(tp, fp, fn) if objective == "f1" else mcc(tp, fp, fn, tn)
    out = swept.groupBy(*by).agg(F.max(F.struct(value.alias("v"), (-F.col("step")).alias("s"), F.col("t"))).alias("m"), F.max(tp + fn).alias("positives"))
    t = F.col("m.t") if empty is None else F.when(F.col("positives") == 0, F.lit(empty)).otherwise(F.col("m.t"))
    return out.select(*by, t.alias("threshold"), F.col("m.v").alias("score"))


def tuned(rows: DataFrame, by: Sequence[str], objective: str = "f1", thresholds: Sequence[float] | None = None, empty: float | None = 0.5) -> DataFrame:
    return best(sweep(rows, by, thresholds or grid()), by, objective, empty)


def at_quantiles(rows: DataFrame, by: Sequence[str], quantiles: int = 20) -> DataFrame:
    """For unbounded scores: the thresholds are the score's lower quantiles; best F1, lowest threshold first."""
    at = [i / quantiles for i in range(quantiles + 1)]
    cuts = rows.groupBy(*by).agg(F.array(*[F.expr(f"percentile_disc({q!r}) within group (order by p)") for q in at]).alias("cuts"))
    # quantiles + 1 rows for each cell, and each row is counted once between two of them
    held = rows.join(cuts, [*by]).withColumn("at", F.size(F.filter("cuts", lambda c: c <= F.col("p"))))
    counts = held.groupBy(*by, "cuts", "at").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    cell = counts.groupBy(*by, "cuts").agg(F.collect_list(F.struct("at", "pos", "neg")).alias("c"), F.sum("pos").alias("all_pos"))
    each = cell.select(*by, "all_pos", "c", F.posexplode("cuts").alias("i", "t"))
    total = lambda part: F.aggregate(F.filter("c", lambda x: x["at"] > F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x[part])
    tp, fp = total("pos"), total("neg")
    scored = each.withColumn("v", f1(tp, fp, F.col("all_pos") - tp))
    return scored.groupBy(*by).agg(F.max(F.struct("v", (-F.col("t")).alias("s"))).alias("m")).select(*by, (-F.col("m.s")).alias("threshold"), F.col("m.v").alias("score"))
