"""Joins that check what they join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ordered import running, same_cells
from tessella.operators.resampling import uniform


def unique(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """`rows`; a key that comes twice is an error when they are read."""
    n = F.count("*").over(Window.partitionBy(*key))
    said = F.concat_ws(",", *[F.col(k).cast("string") for k in key])
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key: "), said)).cast("boolean")).otherwise(True)
    return rows.withColumn("_once", checked).where("_once").drop("_once")


def linkage(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row of counts: keys in both, in the left only, in the right only."""
    a, b = (df.select(*key).distinct().withColumn(name, F.lit(1)) for df, name in ((left, "_l"), (right, "_r")))
    both = a.join(b, [*key], "full_outer")
    return both.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("linked"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"))


def differences(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, status, columns that differ): rows of two versions that aren't equal; nulls are equal."""
    a = old.select(*key, F.struct(*columns).alias("_a"))
    b = new.select(*key, F.struct(*columns).alias("_b"))
    both = a.join(b, [*key], "full_outer")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "missing").otherwise("changed")
    unlike = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]))
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, status.alias("status"), F.when(status == "changed", F.array_join(unlike, ",")).otherwise("").alias("columns"))


def matched(left: DataFrame, right: DataFrame, key: Sequence[str], no_right: str, no_left: str) -> DataFrame:
    """Both sides by key with a `status`: both, or which of them is missing."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    status = F.when(F.col("_r").isNull(), no_right).when(F.col("_l").isNull(), no_left).otherwise("both")
    return a.join(b, [*key], "full_outer").withColumn("status", status).drop("_l", "_r")


def in_all(rows: DataFrame, key: Sequence[str], source: str, sources: int) -> DataFrame:
    """Rows whose key every source has."""
    common = rows.groupBy(*key).agg(F.countDistinct(source).alias("_n")).where(F.col("_n") == sources).drop("_n")
    return rows.join(common, [*key], "left_semi")


def siblings(labels: DataFrame, key: str, group: str, label: str, y: str) -> DataFrame:
    """Pairs of different labels of one key in one group: (key, label, y, other, y_other)."""
    a = labels.select(key, group, label, y)
    b = labels.select(key, group, F.col(label).alias("other"), F.col(y).alias("y_other"))
    return a.join(b, [key, group]).where(F.col(label) != F.col("other")).select(key, label, y, "other", "y_other")


def donors(rows: DataFrame, key: str, kind: Sequence[str], owner: str, seed: int = 0) -> DataFrame:
    """(key, donor): for each row one of the same kind with another owner, by hash; rows without one are left out.

    Rows of a kind stand in a ring by hash, those of one owner together; a row's donor is the first after its owner's,
    so that no pairs are made.
    """
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col(owner).cast("string")))
    owners = rows.withColumn("_p", place).groupBy(*kind, owner, "_p").agg(F.min(key).alias("_first"))
    ring = Window.partitionBy(*kind).orderBy("_p", owner)
    after = F.coalesce(F.lead("_first").over(ring), F.first("_first").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    given = owners.withColumns({"donor": after, "_n": F.count("*").over(Window.partitionBy(*kind))}).where("_n > 1")
    return rows.join(given.select(*kind, owner, "donor"), [*kind, owner]).select(key, "donor")


def seeded_donors(rows: DataFrame, key: str, kind: Sequence[str], owner: str, seed: int = 0) -> DataFrame:
    """(key, donor): for each row a row of the same kind with another owner, each of them equally likely, drawn by hash; rows without one are left out.

    Rows of a kind stand in a ring by owner; a row's draw counts on from the end of its own owner's
    stretch, so it never falls inside, and one join by place finds the donor.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(owner).cast("string")))
    plain = rows.select(key, *kind, owner)
    placed = running(plain, kind, digest, {"_at": F.lit(1)}, [F.col(owner), F.col(key)], F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")).withColumnRenamed("all__at", "_n")
    stretch = placed.groupBy(*kind, owner).agg(F.min("_at").alias("_first"), F.count("*").alias("_own"))
    held = same_cells(placed.drop("_at"), stretch, [*kind, owner]).where("_n > _own")
    draw = F.floor(uniform(key, seed=seed) * (F.col("_n") - F.col("_own")))
    asked = held.withColumn("_at", F.pmod(F.col("_first") + F.col("_own") - 1 + draw, F.col("_n")) + 1)
    return same_cells(asked.select(key, *kind, "_at"), placed.select(F.col(key).alias("donor"), *kind, "_at"), [*kind, "_at"]).select(key, "donor")


def method_aggregates(types: DataFrame, methods: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Largest, sum and mean of each column over a type's methods, and their number; zeros for a type without any."""
    aggs = [f(c).cast("double").alias(f"{c}_{name}") for c in columns for name, f in (("max", F.max), ("sum", F.sum), ("avg", F.avg))]
    out = methods.groupBy(key).agg(*aggs, F.count("*").alias("method_count"))
    return types.join(out, key, "left").na.fill(0, [x for x in out.columns if x != key])


def best_runs(runs: DataFrame, by: str, score: str, key: str, epochs: str, least: int) -> DataFrame:
    """Of each kind the run with the best score among those of enough epochs, the smallest key at ties."""
    held = runs.where(F.col(epochs) >= least)
    return held.groupBy(by).agg(F.max(F.struct(score, (-F.col(key)).alias("m"), key, epochs)).alias("x")).select(by, f"x.{key}", f"x.{score}", f"x.{epochs}")
