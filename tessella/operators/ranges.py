"""Joins of positions with the spans that hold them, and batches under a budget."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def innermost(points: DataFrame, spans: DataFrame, group: str, at: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Each point of a group with the tightest span that holds it (start and end included), null without one; of equal spans the first.

    Spans are listed in all buckets of `width` positions that they touch, so points meet only spans near them.
    Repeated points stay repeated: a place is looked up once and its span joined back.
    """
    rows = points.select(group, at)
    listed = spans.select(F.col(group).alias("_g"), F.col(start).alias("span_start"), F.col(end).alias("span_end"), _buckets(F.col(start), F.col(end), width).alias("_b"))
    places = rows.distinct()
    near = places.join(listed, (F.col(group) == F.col("_g")) & (F.floor(F.col(at) / width) == F.col("_b")) & F.col(at).between(F.col("span_start"), F.col("span_end")))
    tight = F.min(F.struct((F.col("span_end") - F.col("span_start")).alias("size"), "span_start", "span_end")).alias("_tight")
    found = near.groupBy(F.col(group).alias("_of"), F.col(at).alias("_at")).agg(tight)
    held = rows.join(found, (F.col(group) == F.col("_of")) & (F.col(at) == F.col("_at")), "left")
    return held.select(group, at, "_tight.span_start", "_tight.span_end")


def best_overlap(a: DataFrame, b: DataFrame, group: str, start: str, end: str, width: int = 64) -> DataFrame:
    """(group, a_start, a_end, b_start, b_end, iou): of each span of `a` the span of `b` that overlaps it best, the first at ties.

    Spans meet in buckets of `width` positions; of those that two share, the one where the later of both begins counts.
    """
    x = a.select(group, F.col(start).alias("a_start"), F.col(end).alias("a_end")).distinct().withColumn("_b", _buckets(F.col("a_start"), F.col("a_end"), width))
    y = b.select(group, F.col(start).alias("b_start"), F.col(end).alias("b_end")).distinct().withColumn("_b", _buckets(F.col("b_start"), F.col("b_end"), width))
    both = F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1
    either = F.greatest("a_end", "b_end") - F.least("a_start", "b_start") + 1
    met = x.join(y, [group, "_b"]).where((F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")) & (F.floor(F.greatest("a_start", "b_start") / width) == F.col("_b")))
    best = met.withColumn("iou", both / either).groupBy(group, "a_start", "a_end").agg(F.max(F.struct("iou", (-F.col("b_start")).alias("m"), (-F.col("b_end")).alias("e"), "b_start", "b_end")).alias("x"))
    return best.select(group, "a_start", "a_end", "x.b_start", "x.b_end", "x.iou")


def budget_batches(rows: DataFrame, group: str, key: str, size: str, most_rows: int, most_padded: int) -> DataFrame:
    """(group, key, batch): rows of a group, longest first, in batches of so many rows and so much padded size; a longer row is a batch alone.

    A batch is as wide as its first row, so where batches begin follows from how many rows have each
    size. One task plans a group from these counts, at most two entries for a size; rows find their
    batch by their rank among the rows of their size.
    """
    kind = rows.schema[group].dataType.simpleString()
    counts = rows.groupBy(F.col(group).alias("g"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("s")).agg(F.count("*").alias("n"))

    def planned(table: pa.Table) -> pa.Table:
        entries, batch, room = [], -1, 0  # (size, first rank, batch there, rows of a batch)
        for s, n in sorted(zip(table.column("s").to_pylist(), table.column("n").to_pylist(), strict=True), key=lambda x: -x[0]):
            held = min(room, n)
            if held:
                entries.append((s, 0, batch, most_rows + n))
                room -= held
            if n > held:
                each = max(1, min(most_rows, most_padded // s if s > 0 else most_rows))
                entries.append((s, held, batch + 1, each))
                batch += -(-(n - held) // each)
                room = -(n - held) % each
        columns = list(zip(*entries, strict=True)) or [[]] * 4
        arrays = [pa.array(c, pa.int64()) for c in columns]
        return pa.table({"g": pa.array([table.column("g")[0].as_py()] * len(entries), table.schema.field("g").type), "s": arrays[0], "rank0": arrays[1], "batch0": arrays[2], "each": arrays[3]})

    plan = counts.groupBy("g").applyInArrow(planned, f"g {kind}, s bigint, rank0 bigint, batch0 bigint, each bigint").withColumnsRenamed({"g": "_g", "s": "_of"})
    held = rows.select(group, key, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_s"))
    ranks = held.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_s").orderBy(key)) - 1)
    found = ranks.join(plan, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_of")) & (F.col("_rank") >= F.col("rank0")))
    # of a size's two entries the later one that has begun
    last = found.groupBy(group, key, "_s", "_rank").agg(F.max(F.struct("rank0", "batch0", "each")).alias("x"))
    return last.select(group, key, (F.col("x.batch0") + F.call_function("div", F.col("_rank") - F.col("x.rank0"), F.col("x.each"))).cast("int").alias("batch"))
