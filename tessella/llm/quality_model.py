"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold k - w . x) with one weight for each hashed word or trait of a
text, shared by all grades, and ordered thresholds. The expected grade is the sum of the tail
probabilities; a text is kept if the probability of the best grade is at least the model's `least`.

A text's features are the words it has, each once, and bins of a few traits of the whole text, each
TRAIT times, so that the words of a long text don't outweigh them.
Training takes at most about `bound` texts of each grade (default 2500), drawn by a hash of their
key; features that fewer than `times` of these have (default 5) get no weight. All three are
parameters. One in HELD of the drawn texts, by another hash, is held out: a model of the others
scores them, and `least` is the largest probability by which `keep` (default 0.97) of the held-out
texts of the best grade stay; the weights are then fitted on all. With fewer than FEW of these
held out, `least` is LEAST. Prediction reads whole texts.

Grades from `labels`: toxic 0, of low quality 1, others 2; rows without a rating are left out, of
several ratings of a text the lowest counts. Null and empty texts have no features and aren't kept.
With fewer than two grades to learn from, every text with a word is kept and gets the one grade
there is. Repeated rows get equal values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, IntegerType

from tessella.llm.common import text_bytes

GRADES = 3
#: How many words a trait weighs as much as.
TRAIT = 8
#: Words are hashed to so many bits.
BITS = 24
#: The least probability of the best grade where too few texts are held out to choose one. Grades weigh
#: alike in training though the best one is the most frequent, so a small one will do.
LEAST = 0.1
#: One drawn text in so many is held out; so many of the best grade are needed to choose by.
HELD, FEW = 4, 30
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_LOWER = bytes(b for b in range(256) if not 97 <= b <= 122)
_SYMBOL = bytes(b for b in range(256) if b not in b"#*$%&|<>!")


class Hashed(dict):
    """Numbers of words, kept for the next text."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = xxhash.xxh32_intdigest(word) >> (32 - BITS)
        return got


def traits(raw: bytes, words: list[bytes], distinct: int) -> list[bytes]:
    """Bins of whole-text traits, as words that no text has."""
    n = len(words)
    upper, lower = len(raw.translate(None, _UPPER)), len(raw.translate(None, _LOWER))
    symbols, bars = len(raw.translate(None, _SYMBOL)), raw.count(b"|")
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    bins = {
        "upper": min(9, 10 * upper // (upper + lower + 1)),
        "symbols": min(9, 40 * symbols // (len(raw) + 1)),
        "bars": min(9, 10 * bars // (n + 1)),
        "stutter": min(9, 10 * stutter // n),
        "distinct": 10 * distinct // n,
        "words": min(9, n.bit_length()),
    }
    return [f"\0{k} {v}".encode() for k, v in bins.items()]


def features(raw: bytes, hashed: Hashed) -> list[int]:
    words = raw.translate(_WORDS).split()
    if not words:
        return []
    distinct = set(words)
    return [*{hashed[w] for w in distinct}, *(hashed[t] for t in traits(raw, words, len(distinct)) for _ in range(TRAIT))]


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: list[float]  # between grades, ascending
    only: int | None = None  # the one grade there is
    least: float = LEAST  # probability of the best grade from which a text is kept

    def tails(self, found: list[int]) -> np.ndarray:
        """P(grade >= k) for k from 1 up."""
        if self.only is not None:
            return (np.arange(1, GRADES) <= self.only).astype(float)
        z = sum(map(self.weights.get, found, [0.0] * len(found)))
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - z, -500, 500)))


def fit(rows: list[list[int]], grades: list[int], rounds: int = 120, penalty: float = 2e-4, least_times: int = 5) -> Model:
    """Weights and thresholds that maximise the penalised likelihood; grades weigh alike, however many rows have them."""
    y = np.array(grades, int)
    counts = np.bincount(y, minlength=GRADES)
    if (counts > 0).sum() < 2:
        return Model({}, [], int(y[0]) if len(y) else GRADES - 1)
    flat = np.concatenate([np.array(r, np.int64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    use = times >= least_times
    number = np.cumsum(use) - 1
    held = use[column]
    column, row, names = number[column[held]], row[held], names[use]
    per = (1 / (np.maximum(counts, 1) * (counts > 0).sum()))[y]  # sums to 1 over all rows
    # thresholds are kept apart by an exponent, so they stay in order
    p = np.zeros(len(names) + GRADES - 1)
    p[-GRADES + 1] = -1.0
    p[-GRADES + 2 :] = np.log(2.0)
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, t = p[: len(names)], np.cumsum(np.concatenate((p[-GRADES + 1 : len(names) + 1], np.exp(p[len(names) + 1 :]))))
        z = np.bincount(row, weights=w[column], minlength=len(rows))
        edge = np.concatenate(([-np.inf], t, [np.inf]))
        with np.errstate(over="ignore"):
            upper, lower = 1 / (1 + np.exp(z - edge[y + 1])), 1 / (1 + np.exp(z - edge[y]))
        share = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / share * per, lower * (1 - lower) / share * per
        g = np.zeros_like(p)
        g[: len(names)] = np.bincount(column, weights=(dl - du)[row], minlength=len(names)) - penalty * w
        gt = np.array([du[y == k].sum() - dl[y == k + 1].sum() for k in range(GRADES - 1)])
        g[len(names) :] = np.cumsum(gt[::-1])[::-1]
        g[len(names) + 1 :] *= np.exp(p[len(names) + 1 :])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        p = p + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    t = np.cumsum(np.concatenate((p[len(names) : len(names) + 1], np.exp(p[len(names) + 1 :]))))
    keep = np.abs(p[: len(names)]) > 1e-4
    return Model(dict(zip(names[keep].tolist(), p[: len(names)][keep].tolist(), strict=True)), t.tolist())


@F.arrow_udf(ArrayType(IntegerType()))
def hashed_features(texts: pa.Array) -> pa.Array:
    hashed = Hashed()
    return pa.array([features(raw, hashed) for raw in text_bytes(texts)], pa.list_(pa.int32()))


def graded(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(k, y): the lowest grade of each rated key."""
    y = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 2)
    return labels.select(F.col(key).alias("k"), y.alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.min("y").alias("y"))


def chosen_least(model: Model, rows: list[list[int]], grades: list[int], keep: float) -> float:
    """The largest probability of the best grade by which so many of its texts stay."""
    best = np.sort([model.tails(x)[-1] for x, y in zip(rows, grades, strict=True) if y == GRADES - 1])
    return float(best[int((1 - keep) * len(best) + 1e-9)]) if len(best) >= FEW else LEAST


def train(docs: DataFrame, grades: DataFrame, key: str = "doc_id", text: str = "text", bound: int = 2500, times: int = 5, keep: float = 0.97) -> Model:
    """A model from the texts of `docs` that `grades` (k, y) has a grade of; of texts with one key, the smallest counts."""
    counts = {r.y: r.n for r in grades.groupBy("y").agg(F.count("*").alias("n")).collect()}
    luck = F.shiftrightunsigned(F.xxhash64("k", F.lit(11)), 11) / F.lit(float(2**53))
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, bound / n))]) if counts else None
    drawn = grades.where(luck < F.try_element_at(share, F.col("y"))) if counts else grades
    held = F.pmod(F.xxhash64("k", F.lit(12)), F.lit(HELD)) == 0
    texts = docs.select(F.col(key).alias("k2"), F.col(text).alias("t")).join(F.broadcast(drawn), F.col("k2") == F.col("k"))  # bound rows of each grade
    one = texts.groupBy("k", "y").agg(F.min("t").alias("t"))
    found = one.select("k", "y", held.alias("held"), hashed_features("t").alias("x")).toPandas().sort_values("k")
    rows = [(list(x), int(y), bool(h)) for x, y, h in zip(found.x, found.y, found.held, strict=True) if len(x)]
    least = LEAST
    if sum(h and y == GRADES - 1 for _, y, h in rows) >= FEW:
        first = fit([x for x, _, h in rows if not h], [y for _, y, h in rows if not h], least_times=times)
        least = chosen_least(first, [x for x, _, h in rows if h], [y for _, y, h in rows if h], keep)
    model = fit([x for x, _, _ in rows], [y for _, y, _ in rows], least_times=times)
    model.least = least
    return model


_GRADE = pa.struct([("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("kept", pa.bool_())])


def grade(model: Model, least: float | None = None):
    """A column function: text to struct of expected grade, probability of the best grade, and the decision, by the model's `least` or another."""
    bound = model.least if least is None else least

    @F.arrow_udf(from_arrow_type(_GRADE))
    def said(texts: pa.Array) -> pa.Array:
        hashed, out = Hashed(), []
        for raw in text_bytes(texts):
            found = features(raw, hashed)
            tails = model.tails(found)
            out.append({"expected_grade": float(tails.sum()), "tail_probability": float(tails[-1]), "kept": bool(found) and bool(tails[-1] >= bound)})
        return pa.array(out, _GRADE)

    return said
