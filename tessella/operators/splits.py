"""Folds, subsets and shards; order inside a stratum is a hash of seed and key, so it is the same everywhere."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions.scalar import truth
from tessella.operators.ordered import dealt
from tessella.plans.lineage import cut


def hashed(seed: int, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_folds(rows: DataFrame, key: str, strata: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """`fold` from 0: rows of a stratum are dealt in turn."""
    placed = dealt(rows, strata, hashed(seed, key), key, "_at")
    return placed.withColumn("fold", F.pmod(F.col("_at") - 1, F.lit(k)).cast("long")).drop("_at", "all__at")


def group_folds(rows: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """`fold` by group: no group is in two folds."""
    placed = dealt(rows.select(group).distinct(), [], hashed(seed, group), group, "_at")
    return rows.join(placed.select(group, F.pmod(F.col("_at") - 1, F.lit(k)).cast("long").alias("fold")), group)


def leave_one_group_out(rows: DataFrame, group: str) -> DataFrame:
    """`fold` numbers the groups in order."""
    numbered = rows.select(group).distinct().withColumn("fold", (F.dense_rank().over(Window.orderBy(group)) - 1).cast("long"))
    return rows.join(numbered, group)


def nested_subset(rows: DataFrame, key: str, strata: Sequence[str], fraction: float, seed: int = 0) -> DataFrame:
    """The first ceil(fraction * n) rows of each stratum: smaller fractions are subsets of larger ones."""
    placed = dealt(rows, strata, hashed(seed, key), key, "_r")
    return placed.where(F.col("_r") <= F.ceil(F.lit(fraction) * F.col("all__r"))).drop("_r", "all__r")


def capped(rows: DataFrame, key: str, label: str, caps: dict[int, int], seed: int = 0) -> DataFrame:
    """At most so many rows of each label value; values without a cap stay whole."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(label))
    placed = dealt(rows, [label], hashed(seed, key), key, "_r")
    return placed.where(limit.isNull() | (F.col("_r") <= limit)).drop("_r", "all__r")


def round_robin(rows: DataFrame, position: str, shards: int, index: int) -> DataFrame:
    if not 0 <= index < shards:
        raise ValueError(f"no shard {index} of {shards}")
    return rows.where(F.pmod(F.col(position), F.lit(shards)) == index)


def oversampled(rows: DataFrame, share: str) -> DataFrame:
    """Soft labels as weighted rows: one with y 1 and weight share, one with y 0 and the rest; rows of weight 0 go."""
    both = F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col(share).alias("weight")), F.struct(F.lit(0).alias("y"), (1 - F.col(share)).alias("weight")))).alias("x")
    return rows.select("*", both).select("*", "x.y", "x.weight").drop("x").where("weight > 0")


def split_problems(folds: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """One row of counts: keys in no fold, in several, and in folds only; all 0 for a sound split."""
    times = folds.groupBy(key).agg(F.count("*").alias("n"))
    both = rows.select(key, F.lit(1).alias("there")).join(times, key, "full_outer")
    return both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("there").isNull()).alias("unknown"))


def stratum_sample(rows: DataFrame, key: str, size: str, strata: int, each: int, seed: int = 0) -> DataFrame:
    """`stratum` by size in equal parts, and of each the first rows by hash; as many rows as there are projects."""
    held = rows.withColumn("stratum", F.ntile(strata).over(Window.orderBy(size, key)).cast("long"))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(hashed(seed, key), key))
    return held.withColumn("_r", rank).where(F.col("_r") <= each).drop("_r")


def with_negatives(rows: DataFrame, key: str, y: str, ratio: float, seed: int = 0) -> DataFrame:
    """All positives and, by hash, so many times as many negatives."""
    positives = F.broadcast(rows.agg(F.coalesce(F.sum(y), F.lit(0)).alias("_p")))  # one row
    placed = dealt(rows, [y], hashed(seed, key), key, "_r").join(positives)
    return placed.where((F.col(y) == 1) | (F.col("_r") <= F.floor(F.lit(ratio) * F.col("_p")))).drop("_r", "all__r", "_p")


def round_robin_all(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """Every row with the `shard` that takes it: its position in the order of keys, in turn.

    Positions are counted range by range, so no task has all rows.
    """
    ranges = rows.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id())
    held = cut(ranges)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range
    starts = held.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1 + F.col("_before")
    return held.join(F.broadcast(starts), "_range").withColumn("shard", F.pmod(at, F.lit(shards)).cast("long")).drop("_range", "_before")


def greedy_groups(rows: DataFrame, group: str, k: int) -> DataFrame:
    """(group, rows, fold): groups, largest first, each to the fold that has the fewest rows, the first of equal ones.

    The sizes of groups meet in one task, a row for each group.
    """
    kind = rows.schema[group].dataType.simpleString()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(-n, g) for b in batches for g, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        folds, out = [0] * k, []
        for n, g in sorted(held, key=lambda x: (x[0], x[1] is not None, x[1])):
            at = folds.index(min(folds))
            folds[at] -= n
            out.append((g, -n, at))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], types[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], [group, "rows", "fold"])

    types = [to_arrow_type(rows.schema[group].dataType)]
    sizes = rows.groupBy(group).agg(F.count("*").alias("rows")).coalesce(1)
    return sizes.mapInArrow(dealt, f"`{group}` {kind}, rows bigint, fold bigint")


def greedy_labels(rows: DataFrame, key: str, labels: Sequence[str], parts: dict[str, float], seed: int = 0) -> DataFrame:
    """(key, part): rows with many rare labels first, each to the part that needs its labels most, has room, and comes first by name.

    Rows of one label pattern are alike but for their hash order, so the plan is made from the counts
    of patterns: pattern by pattern, the rarest labels first, each part takes its share, and the row
    left over goes to the part whose labels are furthest from their shares.
    """
    pattern = F.concat_ws("", *[F.coalesce(F.col(c), F.lit(0)).cast("string") for c in labels])
    held = rows.select(key, pattern.alias("_pattern"))
    counts = {r["_pattern"]: r["n"] for r in held.groupBy("_pattern").agg(F.count("*").alias("n")).collect()}  # 2 ** labels at most
    total = [sum(n for p, n in counts.items() if p[i] == "1") for i in range(len(labels))]
    names = sorted(parts)
    need = {a: [parts[a] * t for t in total] for a in names}
    room = {a: parts[a] * sum(counts.values()) for a in names}
    rank = lambda p: (min((total[i] for i in range(len(labels)) if p[i] == "1"), default=1 << 60), -p.count("1"), p)
    cuts = []
    for p in sorted(counts, key=rank):
        left, at = counts[p], 0
        shares = {a: int(parts[a] * counts[p]) for a in names}
        ask = lambda a, p=p: (sum(need[a][i] for i in range(len(labels)) if p[i] == "1"), room[a])
        while sum(shares.values()) < left:
            best = max(names, key=lambda a: (*(x - shares[a] for x in ask(a)), a))
            shares[best] += 1
        for a in names:
            n = shares[a]
            cuts.append((p, at, at + n, a))
            at += n
            room[a] -= n
            need[a] = [x - n * (p[i] == "1") for i, x in enumerate(need[a])]
    plan = rows.sparkSession.createDataFrame(cuts or [("", 0, 0, "")], "_p string, _from long, _to long, part string")  # parts x patterns
    placed = dealt(held, ["_pattern"], hashed(seed, key), key, "_at").withColumn("_at", F.col("_at") - 1).join(F.broadcast(plan), (F.col("_pattern") == F.col("_p")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    return placed.select(key, "part")


def with_validation(folds: DataFrame, key: str, strata: Sequence[str], k: int, tenth: int, seed: int = 1) -> DataFrame:
    """(fold, key, part): each row's part in every fold; of the next fold one row in `tenth` of each stratum validates."""
    each = dealt(folds, ["fold", *strata], hashed(seed, key), key, "_q").withColumn("_q", F.col("_q") - 1).withColumn("_test", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    inner = (F.col("fold") == (F.col("_test") + 1) % k) & (F.col("_q") % tenth == F.col("_test") % tenth)
    part = F.when(F.col("fold") == F.col("_test"), "test").when(inner, "val").otherwise("train")
    return each.select(F.col("_test").alias("fold"), key, part.alias("part"))


def flagged(rows: DataFrame, key: str, flags: DataFrame, flag_key: str, flag: str) -> DataFrame:
    """`rows` whose flag is true; a row without a flag, or with one that is neither, is an error when it is read."""
    held = flags.select(F.col(flag_key).alias("_k"), truth(F.col(flag)).alias("_flag"))
    checked = F.when(F.col("_flag").isNull(), F.raise_error(F.concat(F.lit("no flag: "), F.col(key).cast("string"))).cast("int")).otherwise(F.col("_flag"))
    return rows.join(held, F.col(key) == F.col("_k"), "left").withColumn("_flag", checked).where("_flag = 1").drop("_k", "_flag")
