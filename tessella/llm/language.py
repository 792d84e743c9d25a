"""Language ID by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier weighs hashed byte trigrams by their
log-odds between languages with that bit and without. Up to EXHAUSTIVE languages get the exhaustive
code: every way to part them in two is one bit, 7 for four languages, any two of which then differ
in 4, so that one wrong classifier is put right. More languages get as many random splits as keep
any two far apart. A text's margins are compared with every codeword: the loss of a bit weighs more
the better its classifier did in training, the codeword with the least loss wins, and a small lead
over the next flags the text as ambiguous.

Training takes at most about `bound` texts of each language (default 2000), drawn by a hash of
their key, and the `most` most frequent languages (default 256); prediction reads whole texts. A null
text or one without a letter is `und` with score 0, as is every text when nothing can be learned
from. With one language every text with a letter is of it. Repeated rows get equal values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tessella.llm.common import cut

UNKNOWN = "und"
#: Hashed trigrams.
BITS = 13
#: Below this lead of the best codeword over the next, as a share of the loss of both, a text is ambiguous.
LEAD = 0.2
#: No margin counts for more than this, so that one classifier can't outvote the others.
SUREST = 8.0
#: ASCII letters stay, other ASCII bytes become spaces.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


#: Up to so many languages have a bit for every way to part them.
EXHAUSTIVE = 6
#: Random codes that are drawn for more languages; the one whose codewords are farthest apart is taken.
DRAWN = 50


@cache
def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language. No two bits part the languages in the same way, and none leaves them together.

    With n languages up to EXHAUSTIVE any two rows differ in 2 ** (n - 2) of 2 ** (n - 1) - 1 bits.
    """
    if languages < 2:
        return np.ones((languages, 1), int)
    if languages <= EXHAUSTIVE:
        # the first language is always on the one side; the others' side is a number's bits, not all 1
        return np.array([[1 if r == 0 or split >> (r - 1) & 1 else -1 for split in range(2 ** (languages - 1) - 1)] for r in range(languages)])
    rng = np.random.default_rng(languages)
    bits = 10 * (languages - 1).bit_length()
    best, apart = None, -1
    for _ in range(DRAWN):
        splits: set[bytes] = set()
        while len(splits) < bits:
            side = rng.permutation(languages) < languages // 2
            splits.add((side ^ side[0]).tobytes())  # one of a split and its mirror image
        code = np.array([np.frombuffer(x, bool) for x in sorted(splits)]).T
        least = (code[:, None] != code[None]).sum(2)[~np.eye(languages, dtype=bool)].min()
        if least > apart:
            best, apart = np.where(code, -1, 1), least
    return best


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed trigrams of lower-cased letters, with a space where words end."""
    x = np.frombuffer(b" " + text.lower().encode().translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    code = ((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:])[x[1:-1] != 32]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # trigram by bit
    scale: np.ndarray  # of each bit's margins
    trust: np.ndarray  # of each bit's classifier

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.weights / max(1, counts.sum())

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """The weighted loss of each language's codeword: a bit on the wrong side costs more the surer its margin, up to a bound."""
        sure = np.clip(margins / self.scale, -SUREST, SUREST)
        return np.logaddexp(0, -codewords(len(self.languages)) * sure) @ self.trust


def readable(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(texts: list[str | None], model: Model) -> list[dict]:
    out = []
    for text in texts:
        if not model.languages or not readable(text):
            out.append({"lang_pred": UNKNOWN, "score": 0.0, "ambiguous": True})
            continue
        loss = model.losses(model.margins(trigrams(text)))
        best = int(loss.argmin())
        share = np.exp(loss[best] - loss)
        rest = np.delete(loss, best)
        lead = (rest.min() - loss[best]) / (rest.min() + loss[best]) if len(rest) else 1.0
        out.append({"lang_pred": model.languages[best], "score": float(1 / share.sum()), "ambiguous": bool(lead < LEAD)})
    return out


def held_out(key: str | Column) -> Column:
    """Whether a key belongs to the fold that nothing is learned from: crc32 of its text modulo 4 is 2."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = 2000, most: int = 256) -> Model:
    """A model from the rows of `docs`, which are all that it may learn from. Null languages are left out."""
    told = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = {r.l: r.n for r in told.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(most).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1 << BITS, 1)), np.ones(1), np.ones(1))
    luck = F.shiftrightunsigned(F.xxhash64("k", "t", F.lit(7)), 11) / F.lit(float(2**53))
    share = F.try_element_at(F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, bound / counts[name]))]), F.col("l"))
    drawn = sum(min(bound, n) for n in counts.values())
    sample = cut(told.where(luck < share).repartition(1 + drawn // 1000, F.xxhash64("k", "t")))
    codes = codewords(len(languages))
    place = {name: i for i, name in enumerate(languages)}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BITS), np.int64)
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[place[name]] += trigrams(t)
        yield pa.RecordBatch.from_arrays([pa.array(languages), pa.array(list(total), pa.list_(pa.int64()))], ["l", "c"])

    total = np.zeros((len(languages), 1 << BITS))
    for r in sample.select("t", "l").mapInArrow(summed, "l string, c array<bigint>").collect():  # a row for each language and task
        total[place[r.l]] += r.c
    weights = np.zeros((1 << BITS, codes.shape[1]))
    # languages weigh alike, however many texts they have
    shares = (total + 0.5) / (total.sum(1, keepdims=True) + 0.5 * (1 << BITS))
    for b in range(codes.shape[1]):
        yes, no = codes[:, b] > 0, codes[:, b] < 0
        if yes.any() and no.any():
            weights[:, b] = np.log(shares[yes].mean(0)) - np.log(shares[no].mean(0))
    model = Model(languages, weights, np.ones(codes.shape[1]), np.ones(codes.shape[1]))

    @F.arrow_udf(from_arrow_type(pa.list_(pa.float64())))
    def margins(texts: pa.Array) -> pa.Array:
        return pa.array([list(model.margins(trigrams(t))) for t in texts.to_pylist()], pa.list_(pa.float64()))

    seen = sample.select("l", margins("t").alias("m")).collect()
    m, y = np.array([r.m for r in seen]), codes[[place[r.l] for r in seen]]
    model.scale = np.maximum(np.median(np.abs(m), axis=0), 1e-6) / 4
    wrong = np.clip(((m * y) <= 0).mean(0), 0.01, 0.49)
    model.trust = np.log((1 - wrong) / wrong) / 2
    return model


_SAID = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def language_of(model: Model):
    """A column function: text to struct of language, score (the share of the best codeword, 0 to 1) and ambiguity."""

    @F.arrow_udf(from_arrow_type(_SAID))
    def said(texts: pa.Array) -> pa.Array:
        return pa.array(predict(texts.to_pylist(), model), _SAID)

    return said
