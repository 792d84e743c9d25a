"""Quality rules: Viterbi decoding of a linear-chain conditional random field over the lines of a text.

Each line that has a word gets a set of binary features; the field scores label sequences by the
weights of features and of neighbouring labels; the best sequence marks every line as content or
boilerplate. A text stays if the content lines hold at least `least_share` of its word characters.

`fit` learns the weights by stochastic gradient ascent on the penalised likelihood of partly labelled
line sequences, starting from PRIOR: what the field expects with the known labels held fixed, less
what it expects freely, for the features and for the change of label between neighbours. Labels are
weak and belong to lines, not to texts (`labelled`): a line that stands between different
neighbours in SHARED training texts or more is boilerplate, as is one that equals an earlier line of its
text; a line of a text rated good is content otherwise, and a line of a text rated bad is
boilerplate if it looks like junk and unknown if not. The field itself only sees the line's own
features, its neighbours and whether it repeats an earlier line, so decoding needs no other text.

`training_lines` takes at most `bound` rated texts (default 3000, those with the lowest hash of
their id), and of a text of more than `window` lines with words (default 200) a run of that many,
whose start a hash of the text draws; both are parameters. Decoding reads whole texts. With no rated
text the weights are PRIOR.

Null and empty texts have no words: base_failed, share 0, not kept. Repeated rows get equal values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tessella.llm.common import text_bytes

CONTENT, BOILERPLATE, UNKNOWN = 0, 1, -1
#: Names of the binary features of a line, by bit.
FEATURES = ("any", "ends_sentence", "shouts", "symbols", "bars", "capitals", "stutters", "few_distinct", "short", "long", "repeated", "digits", "long_words", "bullet", "notice", "first", "last")
#: Weights that hold before any training: of boilerplate against content, then what it costs when neighbours differ.
PRIOR = np.array([-0.5, -1.0, 1.5, 2.0, 1.5, 1.0, 1.5, 1.0, 0.3, -0.3, 1.0, 0.5, 0.3, 0.5, 1.0, 0.0, 0.0, 1.0])
#: Features that make a line look like junk.
JUNK = sum(1 << FEATURES.index(k) for k in ("shouts", "symbols", "bars", "capitals", "stutters", "few_distinct", "bullet"))
#: A line between different neighbours in so many training texts is boilerplate.
SHARED = 3
#: Words of legal notices and navigation, in lower case.
NOTICE = frozenset({b"license", b"licensed", b"license.", b"license,", b"copyright", b"rights", b"reserved.", b"reserved", b"cookies", b"subscribe", b"login", b"privacy"})
LEAST_SHARE = 0.3
SYMBOLS = bytes(b"#*$%&|<>")
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LOWER = bytes(b for b in range(256) if not 97 <= b <= 122)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_TRAILING = bytes(range(0x80, 0xC0))


#: The bit of the last line of several.
LAST = 1 << FEATURES.index("last")


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.translate(None, _TRAILING))


def line_features(line: bytes, words: list[bytes], repeated: bool, first: bool = False) -> int:
    """The features of one line that has words, as bits in the order of FEATURES; `last` is for the caller to set."""
    n, size = len(words), len(line)
    distinct = len(set(words))
    upper, lower = len(line.translate(None, _NOT_UPPER)), len(line.translate(None, _NOT_LOWER))
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    bars = line.count(b"|")
    flags = (
        True,
        words[-1][-1:] in b".?" or words[-1][-2:] in (b'."', b".)"),
        b"!!" in line,
        len(line.translate(None, _NOT_SYMBOL)) * 25 > size,
        bars * 6 > n,
        upper > lower,
        n > 3 and stutter * 4 > n,
        n > 7 and distinct * 2 < n,
        n < 4,
        n > 19,
        repeated,
        len(line.translate(None, _NOT_DIGIT)) * 4 > size,
        size > 14 * n,
        words[0] in (b"-", b"*", b"|", b"\xe2\x80\xa2"),
        n < 30 and not NOTICE.isdisjoint(line.lower().split()),
        first,
    )
    return sum(1 << k for k, x in enumerate(flags) if x)


def sequence_of(raw: bytes) -> tuple[list[int], list[int], int]:
    """Features and word characters of each line with a word, and how many of these equal an earlier line."""
    bits, chars, seen, twice = [], [], set(), 0
    for line in raw.split(b"\n"):
        if words := line.split():
            again = line in seen
            seen.add(line)
            twice += again
            bits.append(line_features(line, words, again, not bits))
            joined = b"".join(words)
            chars.append(code_points(joined))
    if len(bits) > 1:
        bits[-1] |= LAST
    return bits, chars, twice


def _scores(weights: np.ndarray) -> tuple[list[float], float]:
    return weights[:-1].tolist(), float(weights[-1])


def emission(bits: int, w: list[float], known: dict[int, float]) -> float:
    got = known.get(bits)
    if got is None:
        got = known[bits] = sum(x for k, x in enumerate(w) if bits >> k & 1)
    return got


def viterbi(bits: Sequence[int], weights: np.ndarray, known: dict[int, float] | None = None) -> list[int]:
    """The best label of each line; of equal sequences the one with content earlier from the end."""
    w, change = _scores(weights)
    known = {} if known is None else known
    back: list[tuple[int, int]] = []
    a = b = 0.0  # best score of a prefix that ends in content, in boilerplate
    for k, x in enumerate(bits):
        e = emission(x, w, known)
        if k:
            back.append((0 if a >= b - change else 1, 1 if b >= a - change else 0))
            a, b = max(a, b - change), max(b, a - change) + e
        else:
            b = e
    labels = [0 if a >= b else 1] if bits else []
    for to_content, to_boilerplate in reversed(back):
        labels.append(to_content if labels[-1] == 0 else to_boilerplate)
    return labels[::-1]


def forward_backward(weights: list[tuple[float, float]], same: float) -> tuple[np.ndarray, float]:
    """Probability of boilerplate at each line, and the expected number of changes between neighbours.

    weights: of each line, what its two labels are worth; `same` is what equal neighbours are worth
    against different ones.
    """
    forward = [weights[0]]
    for x, y in weights[1:]:
        a, b = forward[-1]
        a, b = (a * same + b) * x, (a + b * same) * y
        z = a + b
        forward.append((a / z, b / z))
    backward = [(1.0, 1.0)]
    for x, y in reversed(weights[1:]):
        p, q = backward[-1]
        p, q = p * x * same + q * y, p * x + q * y * same
        z = p + q
        backward.append((p / z, q / z))
    backward.reverse()
    second, changes = np.empty(len(weights)), 0.0
    for k, ((a, b), (p, q)) in enumerate(zip(forward, backward, strict=True)):
        second[k] = b * q / (a * p + b * q)
        if k:
            (c, d), (x, y) = forward[k - 1], weights[k]
            stay, go = (c * x * p + d * y * q) * same, c * y * q + d * x * p
            changes += go / (stay + go)
    return second, changes


def gradient(bits: Sequence[int], labels: Sequence[int], w: np.ndarray, masks: dict[int, np.ndarray]) -> np.ndarray:
    """Of the log likelihood of what is known of the labels of one sequence."""
    e = [math.exp(min(30.0, max(-30.0, float(masks[x] @ w[:-1])))) for x in bits]
    same = math.exp(min(30.0, max(-30.0, float(w[-1]))))
    free, changes = forward_backward([(1.0, x) for x in e], same)
    known, told = forward_backward([(float(y != BOILERPLATE), x * (y != CONTENT)) for x, y in zip(e, labels, strict=True)], same)
    grad = np.empty(len(w))
    grad[:-1] = (known - free) @ np.array([masks[x] for x in bits])
    grad[-1] = changes - told
    return grad


def fit(sequences: list[tuple[list[int], list[int]]], rounds: int = 6, rate: float = 0.5, penalty: float = 1e-3) -> np.ndarray:
    """Weights from (features of lines, labels of lines) pairs; a label may be UNKNOWN.

    No known label of one of the two kinds: PRIOR. The cost of a change is learned like any weight.
    """
    w = PRIOR.copy()
    held = [(b, y) for b, y in sequences if b]
    if not all(any(k in y for _, y in held) for k in (CONTENT, BOILERPLATE)):
        return w
    masks = {x: np.array([x >> k & 1 for k in range(len(FEATURES))], float) for bits, _ in held for x in bits}
    order = np.random.default_rng(0)
    mean, steps = np.zeros_like(w), 0
    for r in range(rounds):
        step = rate / (1 + r)
        for i in order.permutation(len(held)):
            bits, labels = held[i]
            w += step * (gradient(bits, labels, w, masks) / len(bits) - penalty * (w - PRIOR))
            if r:  # the mean of all weights but those of the first round
                mean, steps = mean + w, steps + 1
    return mean / steps if steps else w


_LINES = pa.struct([("bits", pa.list_(pa.int32())), ("names", pa.list_(pa.int64()))])


def line_names(window: int):
    """A column function: features and hashes of a text's lines with words, of a run of `window` of them if there are more."""

    @F.arrow_udf(from_arrow_type(_LINES))
    def lines(texts: pa.Array) -> pa.Array:
        out = []
        for raw in text_bytes(texts):
            bits, _, _ = sequence_of(raw)
            names = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in raw.split(b"\n") if x.split()]
            at = xxhash.xxh3_64_intdigest(raw) % (len(bits) - window + 1) if len(bits) > window else 0
            out.append({"bits": bits[at : at + window], "names": names[at : at + window]})
        return pa.array(out, _LINES)

    return lines


def labelled(texts: list[tuple[list[int], list[int], bool]]) -> list[tuple[list[int], list[int]]]:
    """(features, labels) of (features, hashes of lines, rated good) texts, by the rules that the module states."""
    before: dict[int, set] = {}
    after: dict[int, set] = {}
    for _, names, _ in texts:
        for k, x in enumerate(names):
            before.setdefault(x, set()).add(names[k - 1] if k else None)
            after.setdefault(x, set()).add(names[k + 1] if k + 1 < len(names) else None)
    repeated = 1 << FEATURES.index("repeated")

    def label(bits: int, name: int, good: bool) -> int:
        if bits & repeated or max(len(before[name]), len(after[name])) >= SHARED:
            return BOILERPLATE
        return CONTENT if good else BOILERPLATE if bits & JUNK else UNKNOWN

    return [(bits, [label(b, x, good) for b, x in zip(bits, names, strict=True)]) for bits, names, good in texts]


def training_lines(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", rating: str = "quality", bound: int = 3000, window: int = 200) -> list[tuple[list[int], list[int]]]:
    """At most `bound` rated texts as (features, labels) of lines; rating 0 is bad, others good, null is left out. Of texts with one key, the smallest counts."""
    rated = ratings.select(F.col(key).alias("k"), F.col(rating).alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.min("y").alias("y"))
    # each rating takes half of the bound; the lowest hashes of ids are a sample that depends on no order of rows
    chosen = [rated.where(c).orderBy(F.xxhash64("k"), "k").limit(bound // 2) for c in (F.col("y") == 0, F.col("y") != 0)]
    both = F.broadcast(chosen[0].unionAll(chosen[1]))  # bound rows at most
    found = docs.select(F.col(key).alias("k2"), F.col(text).alias("t")).join(both, F.col("k2") == F.col("k")).groupBy("k", "y").agg(F.min("t").alias("t"))
    rows = found.select("k", "y", line_names(window)("t").alias("x")).collect()
    return labelled([(list(r.x.bits), list(r.x.names), r.y != 0) for r in sorted(rows, key=lambda r: r.k)])


def base_numbers(raw: bytes) -> tuple[int, int, int, int]:
    """n_words, word_chars, n_symbols, n_repeat_words of one text."""
    words = raw.split()
    n = len(words)
    chars = code_points(b"".join(words))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    if n < 4:
        return n, chars, symbols, 0
    ids: dict[bytes, int] = {}
    x = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int64, n)
    # numbers of pairs first, so that a window's number stays below 2**63 for any text
    _, pair = np.unique(x[:-1] * len(ids) + x[1:], return_inverse=True)
    _, which, times = np.unique(pair[:-1] * len(ids) + x[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return n, chars, symbols, int(covered.sum())


_VERDICT = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()), ("n_content_lines", pa.int64()), ("n_boilerplate_lines", pa.int64())])


def judge(raw: bytes, weights: np.ndarray, least_share: float = LEAST_SHARE, known: dict[int, float] | None = None) -> dict:
    n, chars, symbols, repeats = base_numbers(raw)
    bits, sizes, twice = sequence_of(raw)
    labels = viterbi(bits, weights, known)
    content = sum(c for c, y in zip(sizes, labels, strict=True) if y == CONTENT)
    share = content / chars if chars else 0.0
    failed = n < 50 or 100 * repeats > 50 * n
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": twice, "n_repeat_words": repeats, "base_failed": failed, "kept": not failed and share >= least_share, "content_share": share, "n_content_lines": labels.count(CONTENT), "n_boilerplate_lines": labels.count(BOILERPLATE)}


def line_rules(weights: np.ndarray | None = None, least_share: float = LEAST_SHARE):
    """A column function: text to struct of base numbers, base_failed, kept, content share and counts of lines."""
    w = PRIOR if weights is None else weights

    @F.arrow_udf(from_arrow_type(_VERDICT))
    def verdict(texts: pa.Array) -> pa.Array:
        known: dict[int, float] = {}
        return pa.array([judge(raw, w, least_share, known) for raw in text_bytes(texts)], _VERDICT)

    return verdict
