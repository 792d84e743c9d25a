"""Chat formatting: reply trees to conversations, by DataFrame functions only.

Messages name their parent. Self-joins that double their reach each time give every message its
root, its depth and the sum of scores on its path, and with that each leaf's root-to-leaf path and
score. The best leaves of each tree are taken, their paths are listed by the same joins run
backwards, and each path becomes one formatted text with a loss mask.

A message whose parent isn't in its tree counts as a root. Messages on a cycle belong to no path.
Of equal scores the longer path wins, then the smaller leaf. Null score: 0. Null text or role:
empty. Null trees are one tree. Of repeated (tree, node) rows one counts: the one with the smallest
parent, null first, then the smallest score; its text is the one with the smallest role and text of
them all. A message without a node can't be answered and is left out. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut

#: How a turn of each role is opened and closed. Other roles: OTHER, the role, SAYS, the text.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER, SAYS = ("[TURN]", "[/TURN]"), "[SAYS]"
#: Control strings, split after their first character: there a text's own copies get a backslash.
CONTROL = r"([<\[])(/?s>|/?INST\]|/?SYS\]|/?TURN\]|SAYS\])"
#: One turn of a formatted text: what opens it, and all up to what closes it.
TURN = r"(?s)(<s>|\[INST\]|\[SYS\]|\[TURN\])(.*?)(?:</s>|\[/INST\]|\[/SYS\]|\[/TURN\])"

#: Characters of one chunk of a formatted text.
CHUNK = 4096


def escape(text: Column) -> Column:
    """Backslashes are doubled and control strings broken by one; `unescape` undoes both."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _doubled(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """links (tree, node, up, total, depth) carried to the roots, and its open rows before each doubling."""
    hops: list[DataFrame] = []
    links, before = cut(links), None
    done, active = links.where("up is null"), links.where("up is not null")
    while (n := active.count()) and n != before:  # as many as before: only cycles are left
        before = n
        hops.append(active.select("tree", "node", "up"))
        # only rows that haven't come to a root take part
        far = done.unionAll(active).select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        joined = active.join(far, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2")))
        links = cut(joined.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth")), n)
        done, active = done.unionAll(links.where("up is null")), links.where("up is not null")
    return done, hops


def best_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, node, depth) of the messages on the `per_tree` best root-to-leaf paths of each tree.

    messages: tree, node, parent (null at a root), score; all else is left out.
    """
    one = messages.where("node is not null").select("tree", "node", F.struct("parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total")).alias("x"))
    m = cut(one.groupBy("tree", "node").agg(F.min("x").alias("x")).select("tree", "node", "x.*"))
    there = m.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    linked = m.join(there, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("parent") == F.col("n2")), "left")
    paths, hops = _doubled(linked.select("tree", "node", F.col("n2").alias("up"), "total", F.lit(1).alias("depth")))
    parents = m.where("parent is not null").select(F.col("tree").alias("t2"), F.col("parent").alias("n2")).distinct()
    leaves = paths.join(parents, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node")
    on = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_tree).select("tree", F.col("node").alias("leaf"), "node")
    # distances below 2**k are sums of the hops' lengths, each used once
    for hop in reversed(hops):
        hop = hop.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up")
        both = on.join(hop, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")), "left")
        on = both.select("tree", "leaf", F.explode(F.array_compact(F.array("node", "up"))).alias("node"))
    depths = paths.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "depth")
    return on.join(depths, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2"))).select("tree", "leaf", "node", "depth")


def _by_role(role: Column, k: int) -> Column:
    other = F.lit(OTHER[k]) if k else F.concat(F.lit(OTHER[0]), escape(role), F.lit(SAYS))
    return reduce(lambda rest, x: F.when(role == x[0], F.lit(x[1][k])).otherwise(rest), MARKS.items(), other)


def format_trees(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """One row for each chosen path: tree, leaf, n_turns, formatted, loss_spans.

    messages: tree, node, parent, score, role, text. A loss span (start, length) counts characters
    of `formatted` from 0 and covers one assistant text in its escaped form.
    """
    texts = messages.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = best_paths(messages, per_tree).join(texts, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")))
    turns = chosen.select("tree", "leaf", "depth", "role", _by_role(F.col("role"), 0).alias("head"), escape(F.col("text")).alias("body"), _by_role(F.col("role"), 1).alias("tail"))
    # repeated rows bring a depth several times; the first of them counts
    order = Window.partitionBy("tree", "leaf").orderBy("depth", "role", "body")
    turns = turns.withColumn("above", F.lag("depth").over(order)).where("above is null or above < depth").drop("above")
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = [F.char_length(x) for x in ("head", "body", "tail")]
    turns = turns.withColumn("end", F.sum(sum(sizes, F.lit(0)).cast("long")).over(before))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("end") - sizes[2] - sizes[1]).alias("start"), sizes[1].cast("long").alias("length")))
    turn = F.struct("depth", F.concat("head", "body", "tail").alias("chunk"), span.alias("span"))
    rows = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return rows.select(
        "tree", "leaf", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.chunk", "").alias("formatted"),
        F.array_compact("turns.span").alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, read back: array of (role, text), both unescaped."""
    pairs = F.arrays_zip(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)).alias("mark"), F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2)).alias("body"))

    def turn(x: Column) -> Column:
        role = reduce(lambda rest, y: F.when(x["mark"] == y[1][0], F.lit(y[0])).otherwise(rest), MARKS.items(), unescape(F.substring_index(x["body"], SAYS, 1)))
        text = F.when(x["mark"] == OTHER[0], F.substring_index(x["body"], SAYS, -1)).otherwise(x["body"])
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pairs, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between.

    The text is cut into chunks once, and each span only looks at its own, so long conversations take
    time in proportion to their length.
    """

    def of(chunks: Column) -> Column:
        def piece(s: Column) -> Column:
            first = F.floor(s["start"] / CHUNK).cast("int")
            many = F.ceil((s["start"] + s["length"]) / CHUNK).cast("int") - first
            near = F.array_join(F.slice(chunks, first + 1, F.greatest(many, F.lit(0))), "")
            return unescape(F.substring(near, (s["start"] - F.lit(CHUNK) * first + 1).cast("int"), s["length"].cast("int")))

        return F.array_join(F.transform(spans, piece), "")

    # bound by an outer lambda, so that the text is cut once
    return F.transform(F.array(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))), of)[0]


def threads(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations kept as numbered rows, as reply trees of one branch: each row answers the one before.

    Rows of one turn number follow each other by role, then text; a null turn comes first.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    plain = rows.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), "role", "text")
    numbered = plain.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")
