"""Exact and near duplicates by token sets, leakage between splits, decontamination."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import collapsed, squashed
from tessella.operators import set_join
from tessella.plans.lineage import stored

#: A word of code: an identifier or a number; letters of any script go on an identifier.
WORD = r"[a-zA-Z_][\p{L}\p{N}_]*|\p{Nd}+"
#: Up to so many runs of the reference (16 bytes each) are broadcast.
LISTED = 2_000_000


def exact_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, n, first): groups of texts equal after white space is collapsed."""
    digest = F.sha2(collapsed(F.coalesce(F.col(text), F.lit(""))), 256)
    return rows.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first"))


def token_sets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens): hashes of the distinct tokens of each text. Written once."""
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)), lambda t: F.xxhash64(t))
    return stored(rows.select(key, F.array_distinct(found).alias("tokens")))


def _hash_sets():
    def sets(column: pa.Array) -> list[np.ndarray]:
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        return [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    return sets


def jaccard_pairs(sets: DataFrame, key: str, percent: int = 90) -> DataFrame:
    """(a, b, both, either): pairs of distinct token sets, each stood for by its smallest key, from this similarity on. Empty sets pair with nothing."""
    return set_join.pairs(sets, key, "tokens", _hash_sets, set_join.Rule(percent=percent))


def duplicate_classes(rows: DataFrame, key: str, text: str, percent: int = 90) -> DataFrame:
    """(key, class): the smallest key that a row is connected with by equal or similar token sets."""
    found = set_join.classes(token_sets(rows, key, text), key, "tokens", _hash_sets, set_join.Rule(percent=percent))
    return found.select(F.col("id").alias(key), F.col("component").alias("class"))


def leakage(folds: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Per fold: test rows, and the share of them with a row of their class outside the fold."""
    held = folds.join(classes, key)
    inside = held.groupBy("class", "fold").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("class"))
    out = inside.withColumn("leaks", F.when(whole > F.col("n"), F.col("n")).otherwise(0))
    return out.groupBy("fold").agg(F.sum("n").cast("long").alias("rows"), F.sum("leaks").cast("long").alias("leaking"))


def decontaminated(rows: DataFrame, reference: DataFrame, text: str, ref_text: str, repo: str | None = None, repos: Sequence[str] = ()) -> DataFrame:
    """Rows whose text without white space isn't in the reference, and whose repository isn't listed."""
    held = rows if repo is None or not repos else rows.where(~F.col(repo).isin(*repos))
    known = reference.select(_digest(F.col(ref_text)).alias("_digest")).distinct()
    return held.withColumn("_digest", _digest(F.col(text))).join(known, "_digest", "left_anti").drop("_digest")


def _digest(text: Column) -> Column:
    return F.sha2(squashed(F.coalesce(text, F.lit(""))), 256)


def passages_of(rows: DataFrame, reference: DataFrame, key: str, text: str, ref_key: str, ref_text: str, words: int = 8) -> DataFrame:
    """(key, ref_key, hits): runs of so many words that a row has of a reference passage, by hash."""

    def runs(df: DataFrame, k: str, t: str) -> DataFrame:
        said = F.split(F.lower(collapsed(F.coalesce(F.col(t), F.lit("")))), " ")

        def hashes(w: Column) -> Column:
            n = F.size(w) - words
            return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)])))

        # bound by an outer lambda, so that a text is split once
        return df.select(k, F.explode(F.array_distinct(F.transform(F.array(said), hashes)[0])).alias("run"))

    wanted = stored(runs(reference, ref_key, ref_text))
    small = wanted.count() <= LISTED
    found = runs(rows, key, text)
    # hits are few, so little of a large table's runs is left to shuffle when the reference's are at hand
    return found.join(F.broadcast(wanted) if small else wanted, "run").groupBy(key, ref_key).agg(F.count("*").alias("hits"))
