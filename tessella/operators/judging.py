"""What judges said: answer probabilities, tool calls, base against variant, line attributions, costs."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tessella.functions.scalar import logit, ratio


def answer_share(tokens: DataFrame, by: Sequence[str], word: Column, logprob: str) -> DataFrame:
    """p_yes, p_no and their share from the log-probabilities of first tokens; null if neither word is among them."""
    said = F.lower(F.trim(word))
    mass = lambda w: F.sum(F.when(said == w, F.exp(logprob)).otherwise(0.0))
    out = tokens.groupBy(*by).agg(mass("yes").alias("p_yes"), mass("no").alias("p_no"))
    return out.withColumn("score", ratio(F.col("p_yes"), F.col("p_yes") + F.col("p_no"), None))


def parsed_call(body: str) -> dict:
    """Name, arguments (JSON text) and error of one call, written as a JSON object or as <function=name> with <parameter=name> parts."""
    said = body.strip()
    bad = lambda why, name=None: {"name": name, "arguments": "{}", "error": why}
    if said.startswith("{"):
        try:
            call, _ = json.JSONDecoder().raw_decode(said)
        except ValueError:
            return bad("not JSON")
        name = call.get("name")
        if not isinstance(name, str):
            return bad("no name")
        args = call.get("arguments", call.get("parameters")) or {}
        if isinstance(args, str):
            try:
                args = json.loads(args)
            except ValueError:
                args = None
        return {"name": name, "arguments": json.dumps(args, sort_keys=True), "error": None} if isinstance(args, dict) else bad("arguments are no object", name)
    head = re.match(r"[\s\S]*?<function=([^>\n]+)>", said)
    if not head:
        return bad("no call" if said else "empty")
    name, rest = head[1].strip(), said[head.end() :]
    if "</function>" not in rest:
        return bad("not closed", name)
    parts = re.findall(r"<parameter=([^>\n]+)>([\s\S]*?)</parameter>", rest.partition("</function>")[0])
    return {"name": name, "arguments": json.dumps({k.strip(): v.strip("\n") for k, v in parts}, sort_keys=True), "error": None}


_CALLS = pa.list_(pa.struct([("name", pa.string()), ("arguments", pa.string()), ("error", pa.string())]))


@F.arrow_udf(from_arrow_type(_CALLS))
def tool_calls(texts: pa.Array) -> pa.Array:
    """All <tool_call> blocks of each message, in order; a block that doesn't end goes up to the end."""
    return pa.array([[parsed_call(p.partition("</tool_call>")[0]) for p in (t or "").split("<tool_call>")[1:]] for t in texts.to_pylist()], _CALLS)


def last_attempts(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the last attempt."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return last.select(*key, "x.*")


def flips(rows: DataFrame, by: Sequence[str], base: str, new: str, threshold: float = 0.5) -> DataFrame:
    """Shares of decisions that turn from right to wrong, wrong to right, up and down, and the mean change of the logit."""
    a, b, y = F.col(base) >= threshold, F.col(new) >= threshold, F.col("y") == 1
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), share((a == y) & (b != y)).alias("right_to_wrong"), share((a != y) & (b == y)).alias("wrong_to_right"),
        share(~a & b).alias("up"), share(a & ~b).alias("down"), F.avg(logit(F.col(new)) - logit(F.col(base))).alias("logit_change"),
    )


def localization(lines: DataFrame, by: Sequence[str], item: str, least: int = 3) -> DataFrame:
    """Rows (by, item, line_no, score, marked): how much positive score lies on marked lines against their share, and how often the top line is one.

    Items of fewer lines or without a marked one are left out; without positive score no mass is anywhere. The first of equal top lines counts.
    """
    positive = F.greatest(F.col("score"), F.lit(0.0))
    items = lines.groupBy(*by, item).agg(
        F.count("*").alias("n"), F.count_if("marked").alias("k"), F.sum(positive).alias("all"), F.sum(F.when(F.col("marked"), positive).otherwise(0.0)).alias("on"),
        F.max(F.struct("score", (-F.col("line_no")).alias("m"), F.col("marked").cast("double").alias("hit"))).alias("top"),
    )
    held = items.where((F.col("n") >= least) & (F.col("k") > 0))
    out = held.groupBy(*by).agg(F.count("*").alias("items"), F.avg(ratio(F.col("on"), F.col("all"))).alias("mass"), F.avg(F.col("k") / F.col("n")).alias("share"), F.avg("top.hit").alias("pointing"))
    return out.withColumn("lift", ratio(F.col("mass"), F.col("share"), None))


def costs(rows: DataFrame, by: Sequence[str], seconds: str, tokens: str) -> DataFrame:
    """Median and total seconds, and tokens a second."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.median(seconds).alias("median_seconds"), F.sum(seconds).alias("seconds"), ratio(F.sum(tokens), F.sum(seconds), None).alias("tokens_per_second"))


def alert_rates(rows: DataFrame, by: Sequence[str], alerts: str, lines: str, units: str) -> DataFrame:
    """Alerts for 1,000 and 10,000 lines and for 100 units."""
    a, n, u = F.sum(alerts), F.sum(lines), F.sum(units)
    return rows.groupBy(*by).agg(a.alias("alerts"), (1000 * ratio(a, n, None)).alias("per_kloc"), (10000 * ratio(a, n, None)).alias("per_10kloc"), (100 * ratio(a, u, None)).alias("per_100_units"))


def top_share(counts: DataFrame, by: str, value: str, key: str, k: int) -> DataFrame:
    """Share of the value that the k largest rows of a group hold; ties by key."""
    ranked = counts.withColumns({"_r": F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), key))})
    return ranked.groupBy(by).agg(F.count("*").alias("n"), ratio(F.sum(F.when(F.col("_r") <= k, F.col(value)).otherwise(0)), F.sum(value), None).alias("top_share"))
