"""Similarity join of sets by a blocked sparse matrix product.

Rows of the matrix are distinct sets of 64-bit hashes, columns are hashes. The columns are parted
into blocks by hash, more blocks than a linked pair of a size class can differ in; so the rows of a
linked pair agree in some blocks, and each block a row has anything in gives it a mark. Of the rows
that have a mark in common one stands for the mark, the one with the smallest number, and all rows that
share marks with it make a row block: rows that agree in a mark meet in the block of its
representative, and nothing is closed transitively. Large row blocks are tiled by size and hash. The
incidence matrices of two tiles are multiplied block of columns by block of columns, overlap counts
accumulate, and pairs below the bounds that the two sizes set are discarded: rows that can't reach
their own bound with the columns that others have go before the product, pairs after it. A pair that
meets in several row blocks counts in the smallest one of both.

Two sets link when 100 * |A and B| >= percent * |A or B|. Empty sets link with nothing.

Exactness. A linked pair agrees in SPARE blocks at least; it would be missed only if all it shares lay
outside these, which for the smallest sets that can link without being equal (9 at 90 percent) has a
chance below 1e-6, and far less for larger ones. Sets of more than MARKS blocks mark only the first
MARKS of them: as the differing hashes of a pair fall into blocks at random, a pair just at the bound
agrees in 0.36 of these on average, 29 of 80. Sets of COUNTED hashes and more leave out the row blocks
that their fewest marks lead to, up to `rule.left_out` marks of a class; so pairs must agree in twice
as many marks and one, 5, which fails with a chance below 1e-8. Equal sets are linked by a hash of the
set and its size. Sets below `blocked` are found by their first hashes in order, one of which a
linked pair always has in common.

Scale. Marks are shuffled, 160 for a set at most; whole sets travel only from rows that a row block
wants, once to each pair of tiles, and all other rows stay where they are. Marks that many rows have are found in a sample of the rows, MOST_HOT at
most, and represented by the smallest sampled row; this is broadcast, so that no task gets all rows
of a mark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessella.operators.components import components
from tessella.plans.lineage import cut, stored

#: Column blocks beyond those that a linked pair can differ in.
SPARE = 6
#: Column blocks that give marks, of as many as there are.
MARKS = 80
#: Rows of one tile, as long as they have THOUSAND shingles at most; longer rows count as several.
TILE, THOUSAND = 1024, 1000
#: Up to so many keys (8 bytes each) are broadcast to leave out texts that nothing is to be compared with.
LISTED = 1_000_000
#: Up to so many row blocks of several tiles are broadcast, a few hundred bytes each.
LARGE = 50_000
#: Columns of one block of the product.
COLUMNS = 4096
#: Sets from this size on leave out row blocks that few of their marks lead to.
COUNTED = 121
#: One row in SAMPLE tells which marks are hot: those that HOT sampled rows have, MOST_HOT at most.
SAMPLE, HOT, MOST_HOT = 64, 16, 50_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class Rule:
    """When two sets link, and how pairs that may link are found."""

    percent: int = 90
    #: Column blocks in which large sets must agree to be compared; odd.
    agree: int = 5
    #: Pairs whose smaller set is below this size are found by first shingles, not by column blocks.
    blocked: int = 9

    @property
    def smallest(self) -> int:
        """Sets below this size only link with equal ones."""
        return -(-self.percent // (100 - self.percent))

    @property
    def left_out(self) -> int:
        """Marks of a class that a large set may leave out."""
        return (self.agree - 1) // 2


RULE = Rule()
#: Makes, in each task, what turns a batch's column into its rows' sets: sorted arrays of distinct 64-bit hashes.
Maker = Callable[[], Callable[[pa.Array], list[np.ndarray]]]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def set_number(sets: np.ndarray) -> int:
    """A signed 64-bit number of a set."""
    return int((mixed(np.array([np.bitwise_xor.reduce(mixed(sets + _C))]) + np.uint64(len(sets)))).view(np.int64)[0])


def size_class(n: int, rule: Rule = RULE) -> tuple[int, int]:
    """Class of a set size and the smallest size of that class; classes grow by half."""
    c, low = 0, rule.blocked
    while n >= (high := low * 3 // 2):
        c, low = c + 1, high
    return c, low


def column_blocks(low: int, rule: Rule = RULE) -> int:
    """Into how many column blocks the class that starts at `low` parts the shingles."""
    most = low * 3 // 2 - 1
    # the smaller set of a linked pair is in the class; the larger one has 100 / percent of its size at most
    both = most + most * 100 // rule.percent
    return both * (100 - rule.percent) // (100 + rule.percent) + SPARE


def block_marks(sets: np.ndarray, rule: Rule = RULE) -> np.ndarray:
    """A number for what the set has in each marked column block, for each class it is compared in.

    The last bit is 1 for classes of large sets, of whose marks a pair has `agree` in common; the five
    bits before it tell the class. Small sets have their first shingles.
    """
    n = len(sets)
    out = [np.empty(0, np.uint64)]
    tag = np.uint64(63)
    if rule.smallest <= n and n * rule.percent < rule.blocked * 100 and rule.smallest < rule.blocked:
        out.append(mixed(sets[: n + 1 - -(-rule.percent * n // 100)] + _A) & ~tag | np.uint64(62))
    if n < rule.blocked:
        return np.concatenate(out)
    c, low = size_class(n, rule)
    kinds = [(c, low)]
    if c and (low - 1) * 100 >= rule.percent * n:
        kinds.append(size_class(low - 1, rule))
    spread = mixed(sets + _B)
    for k, at in kinds:
        block = (sets >> np.uint64(32)) * np.uint64(column_blocks(at, rule)) >> np.uint64(32)  # grows with the hash
        block = block[: np.searchsorted(block, MARKS)]
        if not len(block):
            continue
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        marks = mixed(np.add.reduceat(spread[: len(block)], first) + mixed(block[first] * _A + np.uint64(k)))
        out.append(marks & ~tag | np.uint64(2 * (k % 31) + (rule.left_out > 0 and at >= COUNTED)))
    return np.concatenate(out)


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int = 90) -> np.ndarray:
    """The overlap from which sets of these sizes link."""
    return -(-(percent * (a + b)) // (100 + percent))


def reachable_rows(row: np.ndarray, column: np.ndarray, sizes: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The (row, column) entries that can matter: of columns that a partner has too, of rows that enough such columns are left of."""
    least = -(-percent * sizes // 100)  # a linked set shares so much of its own size
    while len(row):
        width = int(column.max()) + 1
        if side.any():
            use = (np.bincount(column[side[row] == 1], minlength=width) > 0) & (np.bincount(column[side[row] == 2], minlength=width) > 0)
        else:
            use = np.bincount(column, minlength=width) > 1
        held = use[column]
        held &= (np.bincount(row[held], minlength=len(sizes)) >= least)[row]
        if held.all():
            break
        row, column = row[held], column[held]
    return row, column


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, percent: int = 90) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All i and j of linked rows, i < j, and their overlaps; with sides 1 and 2, only pairs of rows on different sides.

    The columns of the tiles' incidence matrices are ordered by the first row that has them and
    parted into blocks; of each block only the rows that have anything in it are multiplied.
    """
    sizes = np.array([len(x) for x in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row, column = reachable_rows(np.repeat(np.arange(len(sets)), sizes), column, sizes, side, percent)
    if not len(row):
        return row, row, row
    there, row = np.unique(row, return_inverse=True)
    sizes, side = sizes[there], side[there]
    first = np.full(int(column.max()) + 1, len(there))
    np.minimum.at(first, column, row)
    column = np.argsort(np.argsort(first, kind="stable"), kind="stable")[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    exact = np.float32 if sizes.max() < 1 << 24 else np.float64
    overlap = np.zeros((len(there), len(there)), exact)
    for block in np.split(np.arange(len(row)), np.flatnonzero(np.diff(column // COLUMNS)) + 1):
        r, c = row[block], column[block]
        _, c = np.unique(c, return_inverse=True)
        active, at = np.unique(r, return_inverse=True)
        tile = np.zeros((len(active), int(c.max()) + 1), exact)
        tile[at, c] = 1
        if side.any():
            one, two = side[active] == 1, side[active] == 2
            overlap[np.ix_(active[one], active[two])] += tile[one] @ tile[two].T
        else:
            overlap[np.ix_(active, active)] += tile @ tile.T
    linked = overlap >= least_overlap(sizes[:, None], sizes[None, :], percent)
    i, j = np.nonzero(linked & (overlap > 0))
    keep = i != j if side.any() else i < j
    both = overlap[i[keep], j[keep]].astype(np.int64)
    i, j = there[i[keep]], there[j[keep]]
    return np.minimum(i, j), np.maximum(i, j), both


def met_before(i: np.ndarray, j: np.ndarray, blocks: list[np.ndarray], this: int) -> np.ndarray:
    """Whether rows i and j of `this` row block are in a smaller one together too."""
    flat = np.concatenate(blocks)
    row = np.repeat(np.arange(len(blocks)), [len(x) for x in blocks])
    names, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    use = (names < this) & (times > 1)
    width = int(use.sum())
    if not width:
        return np.zeros(len(i), bool)
    held = use[number]
    number, row = (np.cumsum(use) - 1)[number[held]], row[held]
    bits = np.zeros((len(blocks), -(-width // 64)), np.uint64)
    np.bitwise_or.at(bits, (row, number // 64), np.uint64(1) << (number % 64).astype(np.uint64))
    out = np.zeros(len(i), bool)
    for word in range(bits.shape[1]):
        out |= (bits[i, word] & bits[j, word]) != 0
    return out


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of n rows is connected with."""
    root, before = np.arange(n), None
    while before is None or (root != before).any():
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
    return root


def marked(rows: DataFrame, key: str, column: str, make: Maker, rule: Rule = RULE) -> DataFrame:
    """(id, n, node, marks) of each row: its key, set size, number of the set (null: an empty set), marks of its column blocks.

    A task leaves out the marks of sets it has had before, so copies don't multiply.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_of, seen = make(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, nodes, marks = [], [], []
                for held in sets_of(part.column(1)):
                    node = set_number(held) if len(held) else None
                    new = node is not None and node not in seen
                    if new:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(node)
                    sizes.append(len(held))
                    nodes.append(node)
                    marks.append(block_marks(held, rule).view(np.int64) if new else [])
                arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(marks, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "node", "marks"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("id"), F.col(column).alias("of")).mapInArrow(told, f"id {kind}, n bigint, node bigint, marks array<bigint>")


def agreeing(rows: DataFrame) -> DataFrame:
    """(a, b, kind, times): node a has so many marks of a kind in common with b, the node that stands for these marks."""
    sampled = rows.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SAMPLE)) == 0).select("node", F.explode("marks").alias("hot"))
    hot = sampled.groupBy("hot").agg(F.count("*").alias("n"), F.min("node").alias("of")).where(F.col("n") >= HOT)
    hot = cut(hot.orderBy(F.desc("n"), "hot").limit(MOST_HOT).select("hot", "of"))
    marks = rows.where("node is not null").select("node", F.explode("marks").alias("mark")).join(F.broadcast(hot), F.col("mark") == F.col("hot"), "left")
    # rows of a hot mark know its representative and needn't meet
    salt = F.when(F.col("of").isNotNull(), F.col("node")).otherwise(F.lit(0).cast("long"))
    least = F.min("node").over(Window.partitionBy("mark", "salt"))
    edges = marks.withColumn("salt", salt).select(F.col("node").alias("a"), F.coalesce("of", least).alias("b"), "mark")
    kind = F.col("mark").bitwiseAND(F.lit(63)).cast("int").alias("kind")
    return edges.where("a <> b").groupBy("a", "b", kind).agg(F.count("*").alias("times"))


def row_blocks(edges: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(node, block): the row blocks of each node, less those that up to `left_out` marks of a large set's class lead to."""
    if rule.left_out:
        # as many rows as a node has marks of one class, MARKS at most
        fewest = Window.partitionBy("a", "kind").orderBy("times", "b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edges = edges.withColumn("upto", F.sum("times").over(fewest)).where((F.col("kind") % 2 == 0) | (F.col("upto") > rule.left_out))
    held = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("block")), F.struct(F.col("b").alias("node"), F.col("b").alias("block"))))
    return edges.select(held.alias("x")).select("x.*").distinct()


def tiled(rows: DataFrame, percent: int = 90) -> DataFrame:
    """rows (block, node, n, ...) with `units`, the tile pairs that each takes part in and on which side.

    A row block that fits one tile is one. Others are parted by size band, so that linked rows are
    in one band or in neighbouring ones, and by hash inside a band.
    """
    width = float(np.log(100 / percent) * 1.0001)
    banded = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    load = F.sum(F.greatest(F.lit(1.0), F.col("n") / THOUSAND)) / TILE
    counts = banded.groupBy("block", "band").agg(load.alias("load"))
    # one entry for each band: a few hundred for any sizes
    tiles = F.map_from_entries(F.collect_list(F.struct("band", F.ceil("load").cast("int").alias("k"))))
    large = counts.groupBy(F.col("block").alias("of")).agg(F.sum("load").alias("all"), tiles.alias("tiles")).where("all > 1")
    large = cut(large)
    held = banded.join(F.broadcast(large) if large.count() <= LARGE else large, F.col("block") == F.col("of"), "left")
    b = F.col("band")

    def many(band: Column) -> Column:
        return F.coalesce(F.try_element_at("tiles", band), F.lit(0))

    def each(band: Column, unit: Callable[[Column], Column]) -> Column:
        k = many(band)
        return F.transform(F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>")), unit)

    def unit(b1: Column, t1: Column, b2: Column, t2: Column, side: Column) -> Column:
        return F.struct("block", b1.alias("b1"), t1.alias("t1"), b2.alias("b2"), t2.alias("t2"), side.alias("side"))

    t = F.pmod(F.xxhash64("node"), F.greatest(many(b), F.lit(1)).cast("long")).cast("int")
    one, two = F.lit(1), F.lit(2)
    same = each(b, lambda o: unit(b, F.least(t, o), b, F.greatest(t, o), F.when(o == t, F.lit(0)).when(t < o, one).otherwise(two)))
    above = each(b + 1, lambda o: unit(b, t, b + 1, o, one))
    below = each(b - 1, lambda o: unit(b - 1, o, b, t, two))
    alone = F.array(unit(F.lit(-1), F.lit(0), F.lit(-1), F.lit(0), F.lit(0)))
    return held.withColumn("units", F.when(F.col("of").isNull(), alone).otherwise(F.concat(same, above, below))).drop("band", "of", "all", "tiles")


def met(rows: DataFrame, key: str, column: str, make: Maker, rule: Rule, marks: DataFrame, copies: DataFrame) -> DataFrame:
    """A row for each tile pair that a set takes part in: block, b1, t1, b2, t2, side, node, first, copies, blocks, set."""
    blocks = cut(row_blocks(agreeing(marks), rule)).select(F.col("node").alias("of"), "block")  # read twice
    in_blocks = tiled(copies.join(blocks, F.col("node") == F.col("of")).select("node", "first", "n", "copies", "block"), rule.percent)
    # as many blocks as a node has marks, 160 at most
    wanted = in_blocks.groupBy("node", "first", "copies").agg(F.sort_array(F.collect_list("block")).alias("blocks"), F.flatten(F.collect_list("units")).alias("units"))
    wanted = stored(wanted)
    held = rows.select(F.col(key).alias("k2"), F.col(column).alias("t2"))
    if wanted.count() <= LISTED:  # else the join below shuffles all rows
        held = held.join(F.broadcast(wanted.select(F.col("first").alias("k3"))), F.col("k2").eqNullSafe(F.col("k3")), "left_semi")
    held = held.join(wanted, F.col("k2").eqNullSafe(F.col("first"))).select("t2", "node", "first", "copies", "blocks", "units")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_of = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = sets_of(part.column(0))
                # a key with several rows brings them all; only the row of this set counts
                keep = [bool(len(s)) and set_number(s) == node for s, node in zip(sets, part.column(1).to_pylist(), strict=True)]
                arrays = [*part.columns[1:], pa.array([s.view(np.int64) if k else [] for s, k in zip(sets, keep, strict=True)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names[1:], "set"]).filter(pa.array(keep, pa.bool_()))

    schema = StructType([*held.schema.fields[1:], StructField("set", ArrayType(LongType()))])
    sets = held.mapInArrow(with_sets, schema).withColumn("u", F.explode("units"))
    return sets.select("u.block", "u.b1", "u.t1", "u.b2", "u.t2", "u.side", "node", "first", "copies", "blocks", "set")


def _lists(column: pa.ChunkedArray, at: np.ndarray) -> list[np.ndarray]:
    flat = column.combine_chunks()
    offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    return [values[offsets[i] : offsets[i + 1]] for i in at]


def tile_links(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one tile pair: the rows that count, their sizes, and the places i and j among them and the overlap of each linked pair that no smaller row block has."""
    _, at = np.unique(table.column("node").to_numpy(), return_index=True)  # repeated rows of a key bring a set twice
    held = [x.view(np.uint64) for x in _lists(table.column("set"), at)]
    i, j, both = linked_pairs(held, table.column("side").to_numpy()[at], percent)
    new = ~met_before(i, j, _lists(table.column("blocks"), at), table.column("block")[0].as_py())
    return at, np.array([len(x) for x in held], np.int64), i[new], j[new], both[new]


TILED = ("block", "b1", "t1", "b2", "t2")


def distinct_sets(marks: DataFrame) -> DataFrame:
    """(node, first, n, copies): each distinct set with the smallest key of its rows."""
    return marks.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.max("n").alias("n"), F.count("*").alias("copies"))


def pairs(rows: DataFrame, key: str, column: str, make: Maker, rule: Rule = RULE) -> DataFrame:
    """(a, b, both, either): each linked pair of distinct sets, a < b the smallest keys of their rows."""
    marks = stored(marked(rows, key, column, make, rule))
    kind = rows.schema[key].dataType.simpleString()

    def product(table: pa.Table) -> pa.Table:
        at, sizes, i, j, both = tile_links(table, rule.percent)
        first = table.column("first").combine_chunks().take(at)
        return pa.table({"x": first.take(i), "y": first.take(j), "both": both, "either": sizes[i] + sizes[j] - both})

    units = met(rows, key, column, make, rule, marks, distinct_sets(marks))
    found = units.groupBy(*TILED).applyInArrow(product, f"x {kind}, y {kind}, both bigint, either bigint")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "both", "either")


def classes(rows: DataFrame, key: str, column: str, make: Maker, rule: Rule = RULE) -> DataFrame:
    """(id, n, component, links) of every row: its key, set size, the smallest key it is connected with, and how many other rows it links with, copies included.

    Rows with an empty set are a component of their own. A component's smallest key leaves nulls out.
    """
    marks = stored(marked(rows, key, column, make, rule))
    copies = distinct_sets(marks)

    def product(table: pa.Table) -> pa.Table:
        """Each row's root among the rows it is connected with here, and its links here."""
        at, _, i, j, _ = tile_links(table, rule.percent)
        nodes, times = table.column("node").to_numpy()[at], table.column("copies").to_numpy()[at]
        links = np.zeros(len(at), np.int64)
        np.add.at(links, i, times[j])
        np.add.at(links, j, times[i])
        linked = np.flatnonzero(links)
        return pa.table({"a": nodes[linked], "b": nodes[roots(len(at), i, j)[linked]], "links": links[linked]})

    found = cut(met(rows, key, column, make, rule, marks, copies).groupBy(*TILED).applyInArrow(product, "a bigint, b bigint, links bigint"))
    linked = components(found.select("a", "b")).select(F.col("node").alias("of"), "root")
    counts = found.groupBy(F.col("a").alias("with")).agg(F.sum("links").alias("links"))
    each = copies.join(linked, F.col("node") == F.col("of"), "left").join(counts, F.col("node") == F.col("with"), "left")
    each = each.select("node", "first", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least = each.groupBy(F.col("root").alias("r2")).agg(F.min("first").alias("component"))
    # dealt anew, so that the join can split the rows of a large component
    held = each.join(least.repartition(F.xxhash64("r2")), F.col("root") == F.col("r2")).select(F.col("node").alias("of"), "component", (F.col("links") + F.col("copies") - 1).alias("links"))
    full = marks.where("node is not null").join(held, F.col("node") == F.col("of")).select("id", "n", "component", "links")
    none = F.lit(0).cast("long")
    return full.unionAll(marks.where("node is null").select("id", none.alias("n"), F.col("id").alias("component"), none.alias("links")))
