"""Training dynamics: confidence, variability and correctness of samples over epochs, and their regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordered import quantiles, same_cells


def dynamics(rows: DataFrame, by: Sequence[str], item: str = "item") -> DataFrame:
    """Of rows (by, item, epoch, y, p): mean and population deviation of the probability of the label, and the share of right epochs; by item first, then the mean over items."""
    right = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    items = rows.withColumn("_r", right).groupBy(*by, item).agg(F.avg("_r").alias("c"), F.stddev_pop("_r").alias("v"), F.avg((F.col("_r") >= 0.5).cast("double")).alias("k"))
    return items.groupBy(*by).agg(F.count("*").alias("items"), F.avg("c").alias("confidence"), F.avg("v").alias("variability"), F.avg("k").alias("correctness"))


def regions(samples: DataFrame, by: Sequence[str], low: float = 0.25, high: float = 0.75, vary: float = 0.75) -> DataFrame:
    """`region` by quantiles of the group: ambiguous before hard before easy before other. `samples` is read more than once."""
    cuts = same_cells(quantiles(samples, by, "confidence", {"_low": low, "_high": high}), quantiles(samples, by, "variability", {"_vary": vary}), by)
    region = F.when(F.col("variability") > F.col("_vary"), "ambiguous").when(F.col("confidence") <= F.col("_low"), "hard").when(F.col("confidence") >= F.col("_high"), "easy").otherwise("other")
    return samples.join(cuts, [*by]).withColumn("region", region).drop("_low", "_high", "_vary")
