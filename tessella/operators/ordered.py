"""Running sums over the rows of a cell in the order of a number, without one task for the cell.

The number's range is cut into buckets in order; sums of buckets are added up in a table of one row
for each bucket, and a window adds up the rows inside a bucket. Buckets are fixed by the number
alone (its signed logarithm in steps), so nothing is sampled or written in between.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each unit of the signed logarithm: some 700 between 0 and 1.
STEPS = 1024


def bucket(value: Column) -> Column:
    """Grows with the value; null is the smallest."""
    v = value.cast("double")
    return F.coalesce(F.floor(F.signum(v) * F.log1p(F.abs(v)) * STEPS), F.lit(-(2**40)))


def same_cells(rows: DataFrame, told: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows` with the columns of `told` for their keys; null keys are equal, as they are in windows and groups."""
    names = {k: f"_of{i}" for i, k in enumerate(keys)}
    held = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return rows.join(told.withColumnsRenamed(names), held).drop(*names.values())


def running(rows: DataFrame, by: Sequence[str], value: Column, sums: dict[str, Column], then: Sequence[Column] = (), at: Column | None = None) -> DataFrame:
    """`rows` with, for each name, the sum over the rows of the cell up to and with this one, and `all_` of the name over all.

    Rows are in ascending order of `value`, then of `then`. `at` is the bucket of a value that isn't a number.
    """
    held = rows.withColumns({"_v": value, "_bucket": bucket(value) if at is None else at})
    totals = held.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    cell = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = cell.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    told = [x for k in sums for x in (F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}"), F.sum(f"_t_{k}").over(cell).alias(f"all_{k}"))]
    starts = totals.select(*by, "_bucket", *told)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v", *then).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = same_cells(held, starts, [*by, "_bucket"]).withColumns({k: F.col(f"_s_{k}") + F.sum(c).over(inside) for k, c in sums.items()})
    return out.drop("_v", "_bucket", *[f"_s_{k}" for k in sums])


def dealt(rows: DataFrame, by: Sequence[str], digest: Column, key: str, name: str) -> DataFrame:
    """`rows` with their place from 1 in the order of a hexadecimal digest in their cell, and the cell's rows as `all_` of the name; 4096 buckets by its first digits."""
    return running(rows, by, digest, {name: F.lit(1)}, [F.col(key)], F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"))


def ranked(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """`rows` with the rank of `value` in their cell, from 1, ties sharing their mean rank; a row's value mustn't be null."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_k"))
    places = running(counts, by, F.col(value), {"_upto": F.col("_k")})
    places = places.select(*by, value, (F.col("_upto") - (F.col("_k") - 1) / 2).alias(name))
    return same_cells(rows, places, [*by, value])


def quantiles(rows: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(by, names of `wanted`): interpolated quantiles of the values that aren't null, without a cell's values in one task."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    places = running(counts, by, F.col(value), {"_upto": F.col("_k")})
    there = lambda at: F.max(F.when((F.col("_upto") - F.col("_k") <= at) & (at < F.col("_upto")), F.col(value)))
    sides = {name: F.lit(q) * (F.col("all__upto") - 1) for name, q in wanted.items()}
    held = places.groupBy(*by).agg(*[x for name, at in sides.items() for x in (there(F.floor(at)).alias(f"_l_{name}"), there(F.ceil(at)).alias(f"_h_{name}"))], F.max("all__upto").alias("all__upto"))
    return held.select(*by, *[(F.col(f"_l_{name}") + (F.col(f"_h_{name}") - F.col(f"_l_{name}")) * (at - F.floor(at))).alias(name) for name, at in sides.items()])
