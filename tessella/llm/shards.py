"""Sharding by sampled splitters, by DataFrame functions only.

A size-weighted sample of keys gives quantile boundaries; they part the records into ranges of the
key. Ranges that turn out overfull are subdivided by quantiles of their own rows until none is, and a range that
is one repeated key by the records' numbers. Ranges have exact sizes then, and running sums over
ranges and inside each range place every record: shard i takes the records whose middle lies in
the i-th part of all bytes. So shards differ by less than the size of two records.

Records are ordered by key, null first; rows with equal keys by number. Null text: size 1, CRC of
the empty text. Repeated rows keep a place each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import NO_ID, cut

#: Rows that a range should have, and the bounds on the number of ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 20_000, 256, 65_536
#: Sampled keys for each range.
SAMPLED = 16
#: A range is overfull beyond so many times the mean rows or bytes.
OVERFULL = 2


def _keys(values: list[int]) -> Column:
    """A constant array of numbers, as one literal after constant folding."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many of the sorted splitters are at most `key`, by binary search."""
    if not splitters:
        return F.lit(0)
    held = _keys(splitters)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        inside = s["lo"] < s["hi"]
        below = inside & (F.get(held, middle) <= key)
        return F.struct(F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(inside & ~below, middle).otherwise(s["hi"]).alias("hi"))

    steps = len(splitters).bit_length()
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi")), halve)["lo"]


def split_ranges(items: DataFrame, rows: int, total: int) -> tuple[DataFrame, DataFrame]:
    """items (key, size, number) with its range and part, and the exact (range, part, rows, bytes) of each."""
    n = min(MOST_RANGES, max(LEAST_RANGES, -(-rows // RANGE_ROWS)))
    draws = SAMPLED * n
    # a record is drawn with a probability in proportion to its size
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(draws / total))
    luck = F.shiftrightunsigned(F.xxhash64("number", F.lit(0)), 11) / F.lit(float(2**53))
    quantiles = [i / n for i in range(1, n)]
    got = items.where(luck < chance).agg(F.percentile_approx("key", quantiles, 100_000).alias("q")).first().q
    splitters = sorted(set(got or []))

    def counted(splitters: list[int]) -> tuple[DataFrame, list]:
        held = items.withColumn("range", _range_of(F.col("key"), splitters))
        return held, held.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).collect()

    held, stats = counted(splitters)
    crowded = lambda r: max(r.rows / max(1, rows / n), r.bytes / max(1, total / n))
    while over := [r.range for r in stats if crowded(r) > OVERFULL and r.low < r.high]:
        finer = held.where(F.col("range").isin(over)).groupBy("range").agg(F.percentile_approx("key", [i / 16 for i in range(1, 17)], 10_000).alias("q"), F.min("key").alias("low"))
        # both sides of a frequent key become boundaries, so that it has a range of its own
        splitters = sorted({*splitters, *(x for r in finer.collect() for q in r.q for x in (q, q + 1) if x > r.low)})
        held, stats = counted(splitters)
    parts = {r.range: int(crowded(r)) for r in stats if crowded(r) > OVERFULL and r.low == r.high}
    part = F.lit(0)
    if parts:
        many = F.coalesce(F.get(_keys([parts.get(i, 1) for i in range(len(splitters) + 1)]), F.col("range")), F.lit(1))
        part = F.pmod(F.xxhash64("number", F.lit(1)), many).cast("int")
    held = held.withColumn("part", part)
    cells = held.groupBy("range", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    return held, cells


def shard_by_bytes(records: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every record."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    plain = records.select(F.col(key).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    # numbers are drawn once and kept, so that a lost task can't change them
    items = cut(plain.select("*", F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("key"), F.monotonically_increasing_id().alias("number")))
    rows, total = items.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    held, cells = split_ranges(items, rows, max(1, total))
    upto = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as there are ranges and parts of ranges: a few times MOST_RANGES
    starts = cells.select("range", "part", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("row0"), F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("byte0"))
    inside = Window.partitionBy("range", "part").orderBy("key", "number")
    before = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    middle = 2 * (F.col("byte0") + F.col("before")) + F.col("size")
    placed = (
        held.withColumns({"at": F.row_number().over(inside), "before": before})
        .join(F.broadcast(starts), ["range", "part"])
        .withColumn("shard", F.least(F.lit(shards - 1), F.call_function("div", middle * shards, F.lit(2 * max(1, total)))).cast("int"))
        .withColumn("position", F.col("row0") + F.col("at") - 1)
    )
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
