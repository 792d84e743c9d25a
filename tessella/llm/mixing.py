"""Mixing sources to target weights by temperature, by DataFrame functions only.

A source of T tokens gets the weight T ** exponent / sum of these. The exponent is the largest one
up to 1 whose weights have the target entropy; if that would repeat a source more than `repeats`
times, it is raised until it doesn't. Both are found by sectioning the range of the exponent. The
target entropy is `entropy` times that of equal weights or, if that is more, what lies at `gain` (0
to 1) of the way from the entropy of the natural shares to that of equal weights; so with a gain
above 0 the target binds and the exponent is below 1 as soon as shares differ. A source's budget
is its weight's share of `budget` tokens, by default all that there are.

Budgets are realised in blocks: a hash deals the documents of a source over BLOCKS blocks, each
epoch runs through the blocks in a permutation of its own, and the last epoch ends inside a block,
where documents are taken by hash as long as the budget allows. `position` (0 to 1) tells where in
the mixture a document stands; ordered by it, sources follow each other in proportion.

Tokens are words. Null texts are empty. Documents without a token go with their block. A null source
is a source. Rows with equal key and text share their fate. A source without tokens has no
weight, and with no tokens at all no row is taken. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, cut, filled, free, stored

#: Blocks of each source.
BLOCKS = 1024
ENTROPY, REPEATS = 0.9, 4.0
#: What the query and the pipeline take: half of the way to equal weights.
GAIN = 0.5
#: Up to so many rows of a plan (some 50 bytes each) are broadcast.
PLANNED = 500_000
#: Points that one job looks at when an exponent is sought, and how often.
POINTS, ROUNDS = 16, 7


@dataclass
class Mix:
    exponent: float
    budget: float
    shares: DataFrame  # source, tokens, natural, weight, quota: share of all tokens before and after, quota in tokens


def luck(key: str, text: str) -> Column:
    """A number that only key and text of a row decide."""
    return F.xxhash64(F.col(key).cast("string"), filled(text))


def slim(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, tokens, luck, block), written once."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.regexp_count(filled(text), F.lit(WORD)).cast("long").alias("tokens"), luck(key, text).alias("luck"))
    return stored(rows.withColumn("block", block_of(F.col("luck"))))


def block_of(number: Column) -> Column:
    return F.pmod(F.xxhash64(number, F.lit(1)), F.lit(BLOCKS)).cast("int")


def _sought(sources: DataFrame, holds: str, low: float) -> float:
    """The largest exponent from `low` to 1 for which `holds`, a test of the sums s (of T ** x) and v, is true; it is true at first."""
    high = 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * (i + 1) / POINTS for i in range(POINTS)]
        sums = [F.expr(holds.format(x=x, s=f"sum(pow(t, {x!r}))", v=f"sum(pow(t, {x!r}) * ln(t))")).alias(f"p{i}") for i, x in enumerate(points)]
        got = [bool(x) for x in sources.agg(*sums).first()]
        last = next((i for i, x in enumerate(got) if not x), POINTS)
        if last == POINTS:
            return high
        low, high = (points[last - 1] if last else low), points[last]
    return low


def mixture(rows: DataFrame, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, gain: float = 0.0) -> Mix | None:
    """Exponent and quotas for the sources of `rows` (source, tokens); None if there is no token."""
    sources = cut(rows.groupBy("source").agg(F.sum("tokens").cast("double").alias("t")).where("t > 0"))
    n, total, least, natural = sources.agg(F.count("*"), F.sum("t"), F.min("t"), F.expr("ln(sum(t)) - sum(t * ln(t)) / sum(t)")).first()
    if not n:
        return None
    budget = float(total) if budget is None else float(budget)
    # the entropy of weights t ** x / s is ln(s) - x * v / s and falls as x grows
    target = max(entropy * math.log(n), natural + gain * (math.log(n) - natural))
    exponent = _sought(sources, f"ln({{s}}) - {{x!r}} * {{v}} / {{s}} >= {target!r} - 1e-12", 0.0)
    # the smallest source is repeated most; from some exponent on, it isn't too often
    if budget <= repeats * total:
        over = f"{budget!r} * pow({least!r}, {{x!r}} - 1) / {{s}} > {repeats!r} * (1 + 1e-9)"
        if sources.agg(F.expr(over.format(x=exponent, s=f"sum(pow(t, {exponent!r}))"))).first()[0]:
            exponent = min(1.0, _sought(sources, over, exponent) + (1 - exponent) / POINTS**ROUNDS)
    norm = sources.agg(F.sum(F.pow("t", F.lit(exponent)))).first()[0]
    weight = F.pow("t", F.lit(exponent)) / F.lit(norm)
    shares = sources.select("source", F.col("t").cast("long").alias("tokens"), (F.col("t") / total).alias("natural"), weight.alias("weight"), F.floor(weight * budget + 1e-6).alias("quota"))
    return Mix(exponent, budget, shares)


def taken_blocks(rows: DataFrame, mix: Mix) -> DataFrame:
    """(source, block, epoch, place, last, position0, step): what is taken of each block in each epoch.

    `last` is the largest luck of which documents are taken, null for all. A document's position is
    position0 + step * its luck's share of the range of luck.
    """
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    shares = mix.shares.where("quota > 0").withColumnRenamed("source", "of")
    epochs = blocks.join(shares, F.col("source").eqNullSafe(F.col("of"))).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("quota div tokens"))))
    # at most BLOCKS rows for each source and epoch
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("source", "epoch", "block", F.lit(3)), "block")
    epochs = epochs.withColumns({"place": F.row_number().over(order) - 1, "upto": F.sum("size").over(order), "blocks": F.count("*").over(Window.partitionBy("source", "epoch"))})
    left = F.col("quota") - F.col("epoch") * F.col("tokens")
    epochs = epochs.withColumn("room", left - F.col("upto") + F.col("size"))  # what is left of the budget before the block
    taken = cut(epochs.where("room > 0").drop("of"))
    # blocks that the budget ends in: documents by luck as long as they fit
    ends = taken.where("size > room").select(F.col("source").alias("s2"), F.col("block").alias("b2"), F.col("epoch").alias("e2"), "room")
    inside = rows.join(ends, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2"))).groupBy("s2", "b2", "e2", "room", "luck").agg(F.sum("tokens").alias("n"))
    sums = F.sum("n").over(Window.partitionBy("s2", "b2", "e2").orderBy("luck"))
    cuts = inside.withColumn("sum", sums).groupBy("s2", "b2", "e2").agg(F.max(F.when(F.col("sum") <= F.col("room"), F.col("luck"))).alias("last"), F.lit(True).alias("cut"))
    both = taken.join(cuts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")) & (F.col("epoch") == F.col("e2")), "left")
    rounds = F.col("quota") / F.col("tokens")
    return both.where("cut is null or last is not null").select(
        "source", "block", "epoch", "last", ((F.col("epoch") + F.col("place") / F.col("blocks")) / rounds).alias("position0"), (1 / F.col("blocks") / rounds).alias("step"), "quota", "natural", "weight"
    )


def sized(plan: DataFrame) -> DataFrame:
    """`plan` to be broadcast if it is small: at most BLOCKS rows for each source and epoch, but sources can be many."""
    return F.broadcast(plan) if plan.count() <= PLANNED else plan


def mixed(docs: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    """`docs` (with luck and block) once for each time they are taken, with _epoch, _position and the plan's weight and quota."""
    told = sized(cut(plan.select(*[F.col(c).alias(f"_{c}") for c in plan.columns])))
    took = docs.join(told, F.col(source).eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).where("_last is null or luck <= _last")
    within = (F.col("luck").cast("double") / 2.0**64) + 0.5
    return took.withColumn("_position", F.least(F.lit(1.0), F.col("_position0") + F.col("_step") * within)).drop("_source", "_block", "_last", "_position0", "_step")


def mix_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **limits: float) -> DataFrame:
    """(key, source, tokens, epoch, position, exponent, natural, weight, quota) of every document, once for each time it is taken."""
    rows = slim(docs, key, text, source)
    mix = mixture(rows, **limits)
    exponent = F.lit(mix.exponent if mix else 1.0).alias("exponent")
    names = [F.col("key").alias(key), F.col("source").alias(source), "tokens", F.col("_epoch").alias("epoch"), F.col("_position").alias("position"), exponent, F.col("_natural").alias("natural"), F.col("_weight").alias("weight"), F.col("_quota").alias("quota")]
    if mix is None:
        none = rows.where("false").withColumns({"_epoch": F.lit(0).cast("long"), "_quota": F.lit(0).cast("long")} | {c: F.lit(0.0) for c in ("_position", "_natural", "_weight")})
        return none.select(*names)
    return mixed(rows, taken_blocks(rows, mix)).select(*names)


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **limits: float) -> DataFrame:
    """The rows of `docs`, all their columns, once for each time they are taken."""
    rows = slim(docs, key, text, source)
    mix = mixture(rows, **limits)
    if mix is None:
        return docs.where("false")
    at = {c: free(docs, f"_mix_{c}") for c in ("source", "block", "last", "luck", "at")}
    plan = sized(cut(taken_blocks(rows, mix).select(*[F.col(c).alias(at[c]) for c in ("source", "block", "last")])))
    held = docs.withColumn(at["luck"], luck(key, text))
    held = held.withColumn(at["at"], block_of(F.col(at["luck"])))
    took = held.join(plan, F.col(source).eqNullSafe(F.col(at["source"])) & (F.col(at["at"]) == F.col(at["block"])))
    took = took.where(F.col(at["last"]).isNull() | (F.col(at["luck"]) <= F.col(at["last"])))
    return took.select(*[F.col(f"`{c}`") for c in docs.columns])
