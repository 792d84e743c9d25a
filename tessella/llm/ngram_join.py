"""N-gram Jaccard join of whole texts by a blocked sparse matrix product.

Rows of the matrix are distinct sets of word shingles, columns are shingles; `operators.set_join` says
how row blocks are found and tiles multiplied, and how certain it is that no link is lost. Two sets
link when 100 * |A and B| >= percent * |A or B|; a component is what links connect. By themselves
shingles have 3 words and the percentage is 90.

Null and empty texts: 0 shingles, a component of their own, no links. Texts with fewer words than a
shingle are one shingle. Repeated rows and equal sets are links of each other. Rows with a null key
take part; a component's smallest key leaves nulls out. An empty table gives no rows. Other columns
of the table are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import text_bytes
from tessella.operators import set_join
from tessella.operators.set_join import RULE, Maker, Rule, mixed

#: Shingles are this many words; texts with fewer words are one shingle.
SHINGLE = 3
#: Words whose hashes a task keeps.
WORDS = 200_000
_A = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept for the next text; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(raw: bytes, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingles, as 64-bit hashes."""
    said = raw.lower().split()  # bytes: A-Z only, and just the white space that parts words
    if not said:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, said), np.uint64, len(said))
    if len(said) < size:
        return mixed(np.array([np.bitwise_xor.reduce(mixed(h + np.arange(1, len(h) + 1, dtype=np.uint64))) ^ np.uint64(len(h))]))
    many = len(h) - size + 1
    run = h[:many]
    for i in range(1, size):
        run = (run ^ (run >> np.uint64(32))) * _A + h[i : i + many]
    return np.unique(mixed(run))


def shingle_sets(size: int) -> Maker:
    def make():
        words = WordHashes()
        return lambda texts: [shingles(raw, words, size) for raw in text_bytes(texts)]

    return make


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = RULE, shingle: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, component_id, n_links) of every row.

    n_links counts the other rows it links with, copies included.
    """
    found = set_join.classes(docs, key, text, shingle_sets(shingle), rule)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))
