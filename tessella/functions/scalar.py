"""Scalar column functions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b in doubles; `empty` when b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(empty).cast("double"))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Half away from zero of the scaled double, as SQL engines on doubles round; Spark's own goes by the shortest decimal text."""
    x, scale = F.col(x) if isinstance(x, str) else x, float(10**digits)
    return F.round(x * scale, 0) / scale


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation from counts; 0 when a margin is empty."""
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    return ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the score interval of a share; null without trials."""
    n, p = n.cast("double"), ratio(k, n, None)
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return mid - half, mid + half


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))
    return F.ln(q / (1 - q))


def sigmoid(x: Column, temperature: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-x / temperature))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def ppv(sensitivity: Column, specificity: Column, prevalence: Column) -> Column:
    """Precision of a detector where positives have this prevalence; null when it raises no alert."""
    hits = sensitivity * prevalence
    return ratio(hits, hits + (1 - specificity) * (1 - prevalence), None)


def sanitize(x: Column, missing: float = -1.0) -> Column:
    """NaN, infinities, null and the sentinel become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x == missing), 0.0).otherwise(x)


def label_array(text: Column) -> Column:
    """The text of a list of truth values, whatever its case, as an array."""
    return F.from_json(F.lower(text), "array<boolean>")


def safe_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(text.try_cast("double").cast("int"), F.lit(default))


def truth(text: Column) -> Column:
    """true/1/yes as 1, false/0/no as 0, else null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "yes"), 1).when(t.isin("false", "0", "no"), 0)


def years(text: Column) -> Column:
    """A duration like 1Y2M in years; a missing part is 0, text without either null."""
    y, m = (F.regexp_extract(text, rf"(?i)([0-9]+)\s*{u}", 1).try_cast("double") for u in "YM")
    return F.when(y.isNotNull() | m.isNotNull(), F.coalesce(y, F.lit(0.0)) + F.coalesce(m, F.lit(0.0)) / 12)


def repo_slug(url: Column) -> Column:
    """host/path of a URL or scp-like address, without scheme, user, suffix .git and trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?:[a-zA-Z+]+://)?(?:[^/@]*@)?", ""), r"(?:\.git)?/*$", "")
    return F.regexp_replace(bare, r"^([^/:]+):", "$1/")


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def squashed(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", "")


def truncated(text: Column, lines: int) -> Column:
    """The first lines, and how many are left out."""
    parts = F.split(text, "\n", -1)
    over = F.size(parts) - lines
    return F.when(over > 0, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.format_string("\n... (%d lines omitted)", over))).otherwise(text)


def file_stem(name: Column) -> Column:
    """Only letters, digits, dot, dash and underscore; runs of others become one underscore."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def dot_escape(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(F.replace(plain, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def dot_unescape(text: Column) -> Column:
    kept = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for short, char in (("\\n", "\n"), ("\\r", "\r"), ('\\"', '"')):
        kept = F.replace(kept, F.lit(short), F.lit(char))
    return F.replace(kept, F.lit("\x00"), F.lit("\\"))


def canonical(columns: dict[str, Column]) -> Column:
    """One JSON text of named values, in the order of their names."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def padded(items: Column, size: int, filler: Column) -> Column:
    """The first `size` items, filled up at the end."""
    return F.slice(F.concat(items, F.array_repeat(filler, size)), 1, size)


def windows(items: Column, size: int, stride: int) -> Column:
    """Windows of an array; the last one is the first that reaches the end."""
    n = F.size(items)
    count = F.greatest(F.lit(0), F.ceil((n - size) / stride).cast("int")) + 1
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(items, i * stride + 1, size))
