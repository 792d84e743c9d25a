"""Row filters that configuration or other rows decide."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_lists(rows: DataFrame, lists: dict[str, Sequence | None]) -> DataFrame:
    """Rows whose columns are in the lists given; a column without a list isn't looked at."""
    for name, values in lists.items():
        if values is not None:
            rows = rows.where(F.col(name).isin(*values))
    return rows


def matching(rows: DataFrame, combo: str, wanted: dict[str, Any]) -> DataFrame:
    """Rows whose map of text has all wanted entries, whatever else it has."""
    for k, v in wanted.items():
        rows = rows.where(F.try_element_at(combo, F.lit(k)).eqNullSafe(F.lit(str(v))))
    return rows


def eligible(rows: DataFrame, levels: dict[Any, str | None], label: str = "label", level: str = "level") -> DataFrame:
    """Rows whose level is the one of their label; None stands for any level, a label that isn't listed has none."""
    holds = F.lit(False)
    for name, at in levels.items():
        holds = holds | ((F.col(label) == F.lit(name)) & (F.lit(True) if at is None else F.col(level) == at))
    return rows.where(holds)


def both_classes(rows: DataFrame, by: Sequence[str], y: str = "y") -> DataFrame:
    """Rows of the cells that have both classes."""
    w = Window.partitionBy(*by)
    held = rows.withColumns({"_low": F.min(y).over(w), "_high": F.max(y).over(w)})
    return held.where("_low < _high").drop("_low", "_high")


def feature_matrix(rows: DataFrame, columns: Sequence[str], missing: float | None = 0.0) -> DataFrame:
    """The columns as doubles, those that aren't there as `missing`; an error for these if it is None."""
    absent = [c for c in columns if c not in rows.columns]
    if absent and missing is None:
        raise ValueError(f"no such columns: {absent}")
    pick = lambda c: F.lit(missing) if c in absent else F.coalesce(F.col(c).cast("double"), F.lit(missing)) if missing is not None else F.col(c).cast("double")
    return rows.withColumns({c: pick(c) for c in columns})


def top_of(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; only k of a task's rows of a group go to the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def capped_lists(rows: DataFrame, group: str, part: str, order: Sequence[Column], per_part: int, overall: int) -> DataFrame:
    """Of each part of a group the first rows, and of these the first of the group."""
    return top_of(top_of(rows, [group, part], order, per_part), [group], order, overall)


def proximity(path: Column, own: Column) -> Column:
    """0 for the own file, 1 for its folder, 2 for its top folder, 3 for the rest."""
    folder, top = F.regexp_replace(own, "[^/]*$", ""), F.substring_index(own, "/", 1)
    return F.when(path == own, 0).when(F.regexp_replace(path, "[^/]*$", "") == folder, 1).when(F.substring_index(path, "/", 1) == top, 2).otherwise(3)
