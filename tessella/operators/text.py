"""Tokens, vocabularies, encodings, line kinds and sizes of source texts."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import padded
from tessella.plans.lineage import cut

#: What counts as one token of code. Letters of any script continue an identifier, and numbers have the digits of any script.
TOKEN = r"""[a-zA-Z_][\p{L}\p{N}_]*|[{}()\[\];,.<>=!&|+\-*/:%^~?@#]|"[^"]*"|'[^']*'|\p{Nd}+"""
#: The first two ids of a vocabulary.
PAD, UNKNOWN = 0, 1
#: Short lists that a vocabulary is hashed into.
SLOTS = 8192
#: Kinds of code lines with the patterns that tell them, in the order they are tried.
KINDS = {
    "braces only": (r"^[{}();]*$",),
    "comment or annotation": (r"^(//|/\*|\*|@)",),
    "return": (r"^return",),
    "condition, loop or try": (r"^(if|else|for|while|switch|case|do|try|catch|finally)\b",),
    "declaration": (r"^(final\s+)?[A-Z][\w<>\[\], ?]*\s+\w+\s*(=|;)", r"^(int|long|boolean|double|float|char|byte|short)\b"),
}


def tokens(text: Column, cap: int | None = None) -> Column:
    """All tokens of a text in order, or the first `cap`."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return found if cap is None else F.slice(found, 1, cap)


def vocabulary(rows: DataFrame, text: str, order: str, size: int = 10_000, least: int = 2, cap: int = 512) -> DataFrame:
    """(token, id, n): the size - 2 most frequent tokens, of these the ones that occur `least` times; earlier tokens first at equal counts. Rows without an order are left out.

    Counts and the first text of each token add up in hash tables; where in that text a token stands only
    matters for the few that may be taken, so only their first texts are read again.
    """
    plain = rows.where(F.col(order).isNotNull()).select(F.col(order).alias("o"), F.col(text).alias("t"))
    seen = plain.select("o", F.explode(tokens(F.col("t"), cap)).alias("token"))
    counts = cut(seen.groupBy("token").agg(F.count("*").alias("n"), F.min("o").alias("o1")).where(F.col("n") >= least))
    last = counts.orderBy(F.desc("n"), "o1").limit(size - 2).agg(F.max(F.struct((-F.col("n")).alias("m"), "o1")).alias("x")).first().x
    if last is None:
        return counts.select("token", F.lit(0).cast("long").alias("id"), "n").where("false")
    # the taken ones and those of one text that have the same count as the last
    held = counts.where((F.col("n") > -last.m) | ((F.col("n") == -last.m) & (F.col("o1") <= F.lit(last.o1))))
    firsts = held.select(F.col("o1").alias("of")).distinct()
    again = plain.join(F.broadcast(firsts), F.col("o") == F.col("of"), "left_semi").select("o", F.posexplode(tokens(F.col("t"), cap)).alias("at", "token"))
    places = again.join(F.broadcast(held), "token").where(F.col("o") == F.col("o1")).groupBy("token", "n", "o1").agg(F.min("at").alias("at"))
    top = places.orderBy(F.desc("n"), "o1", "at").limit(size - 2)  # bounded from here on
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "o1", "at"))
    return top.select("token", (rank + 1).cast("long").alias("id"), "n")


def encoded(rows: DataFrame, key: str, text: str, vocab: DataFrame, length: int = 512) -> DataFrame:
    """(key, ids): token ids, unknown ones as 1, filled up with 0; the vocabulary has a bounded size.

    The vocabulary becomes a constant, hashed into short lists, that each text's tokens are looked up in
    where the text is; nothing is shuffled.
    """
    entries = [(r.token, r.id, r.at) for r in vocab.select("token", "id", F.pmod(F.xxhash64("token"), F.lit(SLOTS)).alias("at")).collect()]
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    for token, number, at in entries:
        slots[at].append({"t": token, "i": number})
    held = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<t:string,i:bigint>>>")  # folded into one constant

    def id_of(token: Column) -> Column:
        slot = F.get(held, F.pmod(F.xxhash64(token), F.lit(SLOTS)).cast("int"))
        return F.coalesce(F.get(F.filter(slot, lambda e: e["t"] == token), 0)["i"], F.lit(UNKNOWN).cast("long"))

    return rows.select(key, padded(F.transform(tokens(F.col(text), length), id_of), length, F.lit(PAD).cast("long")).alias("ids"))


def chunk_stats(rows: DataFrame, by: Sequence[str], text: str, chunk: int = 512) -> DataFrame:
    n = F.size(tokens(F.col(text)))
    held = rows.withColumn("_n", n).withColumn("_chunks", F.greatest(F.lit(1), F.ceil(F.col("_n") / chunk)).cast("long"))
    return held.groupBy(*by).agg(F.count("*").alias("texts"), F.sum("_n").cast("long").alias("tokens"), F.max("_n").cast("long").alias("longest"), F.sum("_chunks").alias("chunks"), F.count_if(F.col("_chunks") > 1).alias("chunked"))


def line_kind(line: Column, first: Column) -> Column:
    """What a line of code is; the first rule that holds decides."""
    s = F.regexp_replace(line, r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")
    kind = F.when(first, "signature")
    for name, patterns in KINDS.items():
        for p in patterns:
            kind = kind.when(s.rlike(p), name)
    return kind.when(s.contains("=") & ~s.contains("=="), "assignment").when(s.contains("("), "call").otherwise("other")


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) from 0."""
    return rows.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))


def sizes(text: Column) -> dict[str, Column]:
    """Counts that the text alone gives: lines, lines with more than white space, characters, tokens."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, "\n", -1)
    return {"loc_physical": F.size(parts).cast("long"), "loc_nonblank": F.size(F.filter(parts, lambda x: x.rlike(r"[^ \t\r\f\x0B]"))).cast("long"), "chars": F.char_length(t).cast("long"), "n_tokens": F.size(tokens(t)).cast("long")}


def blank_removed(text: Column) -> Column:
    """Without lines of white space only."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\r\f\x0B]")), "\n")


def blank_inflated(text: Column) -> Column:
    """With an empty line after each line but the last."""
    return F.array_join(F.split(text, "\n", -1), "\n\n")


def commented(text: Column, comment: str, every: int = 5) -> Column:
    """With a comment line before every so many lines, the first included."""
    parts = F.split(text, "\n", -1)
    return F.array_join(F.flatten(F.transform(parts, lambda x, i: F.when(i % every == 0, F.array(F.lit(comment), x)).otherwise(F.array(x)))), "\n")
