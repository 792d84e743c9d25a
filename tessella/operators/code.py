"""Source texts around a sample: snippets made whole, prompts, types resolved by name, vectors pooled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import java
from tessella.operators.filters import top_of

#: What a fragment must begin with to be a type of its own.
TYPE = r"(?s)^\s*(?:(?:public|protected|private|abstract|final|static|strictfp)\s+)*(?:class|interface|enum)\b"


def made_whole(snippet: Column, name: str) -> Column:
    """A snippet as a compilation unit of its own: without package and imports, its first type and the constructors named `name`; a fragment is put into a class of that name."""
    bare = F.regexp_replace(snippet, r"(?m)^[ \t]*(?:package|import)\b[^;\n]*;[ \t]*\n?", "")
    own = F.regexp_extract(bare, r"\b(?:class|interface|enum)\s+([A-Za-z_]\w*)", 1)
    # a name is letters, digits and underscores, so it stands for itself in a pattern
    renamed = F.regexp_replace(bare, F.concat(F.lit(r"\b"), own, F.lit(r"\b(?=\s*(?:\(|\{|extends\b|implements\b|<))")), F.lit(name))
    return F.when(bare.rlike(TYPE) & (own != ""), renamed).otherwise(F.concat(F.lit(f"class {name} {{\n"), bare, F.lit("\n}")))


def truncated_middle(text: Column, most: int, head: float = 0.7) -> Column:
    """At most so many characters: the head, a note of how many are left out, the tail."""
    first, n = int(most * head), F.char_length(text)
    last = most - first
    note = F.format_string("\n/* ... %d characters omitted ... */\n", n - most)
    return F.when(n <= most, text).otherwise(F.concat(F.substring(text, 1, first), note, F.right(text, F.lit(last))))


def fingerprint(parts: Sequence[Column]) -> Column:
    """SHA-256 of a prompt's parts with their lengths, so that no two lists of parts have the same text."""
    said = F.concat(*[F.concat(F.char_length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts])
    return F.sha2(said.cast("binary"), 256)


def resolved(uses: DataFrame, types: DataFrame, imports: DataFrame, implicit: Sequence[str] = ("java.lang",)) -> DataFrame:
    """uses (file, package, name) with `type` and `rule`: the type a simple name stands for, by the first rule that gives one.

    Rules: a type of the same file; one that is imported by name; one of the own package; of a package
    imported whole (the smallest if several); of an implicit package; the only type of that name.
    A name that several types have and no rule decides is ambiguous, one that none has is unknown.
    types: file, package, name, type. imports: file, package, name (`*` for the whole package).
    """
    t = types.select(F.col("file").alias("_f"), F.col("package").alias("_p"), F.col("name").alias("_n"), F.col("type").alias("_t"))
    asked = uses.select("file", "package", "name").distinct()
    own = t.groupBy(F.col("_f").alias("file"), F.col("_n").alias("name")).agg(F.min("_t").alias("r1"))
    known = t.groupBy("_p", "_n").agg(F.min("_t").alias("_t"))
    one = imports.where("name <> '*'").join(known, (F.col("package") == F.col("_p")) & (F.col("name") == F.col("_n"))).groupBy("file", "name").agg(F.min("_t").alias("r2"))
    near = known.select(F.col("_p").alias("package"), F.col("_n").alias("name"), F.col("_t").alias("r3"))
    whole = imports.where("name = '*'").select("file", "package").distinct()
    wide = asked.select("file", "name").distinct().join(whole, "file").join(known, (F.col("package") == F.col("_p")) & (F.col("name") == F.col("_n"))).groupBy("file", "name").agg(F.min("_t").alias("r4"))
    free = known.where(F.col("_p").isin(*implicit)).groupBy(F.col("_n").alias("name")).agg(F.min("_t").alias("r5"))
    named = t.groupBy(F.col("_n").alias("name")).agg(F.countDistinct("_t").alias("_types"), F.min("_t").alias("_only"))
    held = asked.join(own, ["file", "name"], "left").join(one, ["file", "name"], "left").join(near, ["package", "name"], "left").join(wide, ["file", "name"], "left").join(free, "name", "left").join(named, "name", "left")
    rules = ("same file", "import", "same package", "wildcard", "implicit")
    rule = F.coalesce(*[F.when(F.col(f"r{i}").isNotNull(), r) for i, r in enumerate(rules, 1)], F.when(F.col("_types") == 1, "unique name"), F.when(F.col("_types") > 1, "ambiguous"), F.lit("unknown"))
    return held.select("file", "package", "name", F.coalesce("r1", "r2", "r3", "r4", "r5", F.when(F.col("_types") == 1, F.col("_only"))).alias("type"), rule.alias("rule"))


def at_positions(tokens: DataFrame, events: DataFrame, group: str) -> DataFrame:
    """tokens (group, line, col, text, ...) with the event at their place; an event whose text differs from the token's doesn't count. Of several events the smallest."""
    place = [group, "line", "col", "text"]
    held = events.groupBy(*[F.col(c).alias(f"_{c}") for c in place]).agg(F.min("event").alias("event"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    return tokens.join(held, same[0] & same[1] & same[2] & same[3], "left").drop(*[f"_{c}" for c in place])


def pooled(vectors: Column, how: str, size: int) -> Column:
    """One vector of a list of vectors: their mean, the first (`cls`) or the last; null of an empty list."""
    if how == "cls":
        return F.get(vectors, F.lit(0))
    if how == "last":
        return F.try_element_at(vectors, F.lit(-1))
    if how != "mean":
        raise ValueError(f"unknown pooling: {how}")
    n = F.size(vectors)
    total = F.aggregate(vectors, F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def composed_features(kinds: Column, known: int, numbers: Sequence[Column], tokens: Column) -> Column:
    """A node's feature vector: its kind as one of `known` indicators, its numbers, its token vector."""
    indicator = F.transform(F.sequence(F.lit(0), F.lit(known - 1)), lambda i: (i == kinds).cast("double"))
    return F.concat(indicator, F.array(*[x.cast("double") for x in numbers]), F.transform(tokens, lambda x: x.cast("double")))


def context_packages(rows: DataFrame, key: str, text: str, most: int = 20) -> DataFrame:
    """(key, type, package): what a judge is shown of a text's surroundings, as JSON: its first type, the types of other texts it names, the types that name it, its skeleton.

    Lists hold the first `most` names; only so many of a task's go to the shuffle, so a type that
    everyone uses doesn't gather all its users.
    """
    found = java.nodes(rows, key, text)
    declared = found.where((F.col("node_kind") == "rule") & F.col("node_type").isin(*java.TYPES))
    own = declared.groupBy(key).agg(F.min_by("token_text", "node_index").alias("type"))
    named = found.where("node_kind = 'token' and node_type = 'word'").where(F.col("token_text").rlike("^[A-Z]")).select(key, F.col("token_text").alias("name")).distinct()
    known = declared.select(F.col(key).alias("_of"), F.col("token_text").alias("name")).distinct()
    met = named.join(known, "name").where(F.col(key) != F.col("_of"))
    users = met.join(own.select(F.col(key).alias("_user"), F.col("type").alias("by")), F.col(key) == F.col("_user"))
    lists = lambda df, by, name, out: top_of(df.select(by, name).distinct(), [by], [F.col(name)], most).groupBy(F.col(by).alias(key)).agg(F.sort_array(F.collect_list(name)).alias(out))
    none = F.array().cast("array<string>")
    held = rows.select(key, java.skeleton_column(text).alias("skeleton")).join(own, key, "left").join(lists(met, key, "name", "references"), key, "left").join(lists(users, "_of", "by", "usages"), key, "left")
    return held.select(key, "type", F.to_json(F.struct("type", F.coalesce("references", none).alias("references"), F.coalesce("usages", none).alias("usages"), "skeleton")).alias("package"))


def access_lines(rows: DataFrame, key: str, text: str, names: Column) -> DataFrame:
    """(key, line_no): lines of a text that access a member of one of `names`, an array of words."""
    lines = rows.select(key, names.alias("_names"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    owners = F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_]\w*)\s*\.\s*[A-Za-z_]"), F.lit(1))
    return lines.where(F.arrays_overlap(owners, F.col("_names"))).select(key, "line_no")
