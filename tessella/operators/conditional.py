"""Conditional logistic regression with one intercept for each unit, and the test of reviewers that it gives.

Given how many of a unit's rows are positive, the chance of which ones they are is a ratio of
products of weights exp(x . beta), summed over all choices of as many rows. These sums are elementary
symmetric polynomials, so they follow from a recursion over the rows instead of a list of choices.
Newton's method takes one pass over the units for each step; a task hands on sums only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.tails import likelihood_ratio
from tessella.plans.lineage import cut


@dataclass
class Fit:
    deviance: float
    beta: np.ndarray
    units: int  # with both outcomes; the others tell nothing


def _polynomials(weights: np.ndarray, upto: int) -> np.ndarray:
    """e_0 to e_upto of the weights."""
    e = np.zeros(upto + 1)
    e[0] = 1.0
    for w in weights:
        e[1:] += w * e[:-1].copy()
    return e


def unit_terms(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of one unit's outcomes given their number, its gradient and its negative second derivative."""
    k = int(y.sum())
    score = x @ beta
    top = score.max()
    w = np.exp(score - top)  # scaled alike, so that ratios stay
    e = _polynomials(w, k)[k]
    without = [np.delete(w, i) for i in range(len(w))]
    p = np.array([wi * _polynomials(v, k - 1)[k - 1] for wi, v in zip(w, without, strict=True)]) / e
    both = np.diag(p)
    if k > 1:
        for i in range(len(w)):
            for j in range(i):
                both[i, j] = both[j, i] = w[i] * w[j] * _polynomials(np.delete(without[i], j), k - 2)[k - 2] / e
    return float(score[y == 1].sum() - np.log(e) - k * top), x[y == 1].sum(0) - p @ x, x.T @ (both - np.outer(p, p)) @ x


def fit(rows: DataFrame, unit: str, y: str, features: Sequence[str], rounds: int = 30) -> Fit:
    """Of rows with a unit, a 0/1 outcome and features; units without both outcomes are left out."""
    n = len(features)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).cast("array<double>")
    held = rows.groupBy(unit).agg(F.collect_list(F.struct(F.col(y).cast("int").alias("y"), x.alias("x"))).alias("r"), F.sum(y).alias("k"), F.count("*").alias("m"))
    units = cut(held.where((F.col("k") > 0) & (F.col("k") < F.col("m"))).select("r"))  # a unit has as many rows as raters

    def summed(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(1 + n + n * n), 0
            for batch in batches:
                for r in batch.column(0).to_pylist():
                    a = np.array([v["x"] for v in r], float).reshape(len(r), n)
                    value, gradient, curve = unit_terms(a, np.array([v["y"] for v in r]), beta)
                    total += np.concatenate(([value], gradient, curve.ravel()))
                    count += 1
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([count], pa.int64())], ["t", "n"])

        got = units.mapInArrow(part, "t array<double>, n bigint").collect()  # a row for each task
        t = np.sum([r.t for r in got], axis=0) if got else np.zeros(1 + n + n * n)
        return float(t[0]), t[1 : n + 1], t[n + 1 :].reshape(n, n), sum(r.n for r in got)

    beta = np.zeros(n)
    value, gradient, curve, count = summed(beta)
    for _ in range(rounds if n and count else 0):
        step = np.linalg.solve(curve + 1e-9 * np.eye(n), gradient)
        size = 1.0
        while size > 1e-4:  # a step that makes it worse is halved
            new = summed(beta + size * step)
            if new[0] >= value - 1e-12:
                break
            size /= 2
        beta = beta + size * step
        gain = new[0] - value
        value, gradient, curve, _ = new
        if gain < 1e-9:
            break
    return Fit(-2 * value, beta, count)


def reviewer_test(rows: DataFrame, unit: str, reviewer: str, y: str, adjust: Sequence[str], least: int, most: int = 50) -> dict:
    """Whether reviewers differ beyond their units and the `adjust` columns: the deviance that an indicator of each of them takes away, its degrees of freedom and p.

    Reviewers with fewer than `least` reviews in units with both outcomes are pooled, as are those beyond the `most` busiest.
    """
    both = rows.groupBy(unit).agg(F.sum(y).alias("_k"), F.count("*").alias("_m")).where((F.col("_k") > 0) & (F.col("_k") < F.col("_m"))).select(F.col(unit).alias("_u"))
    held = cut(rows.join(both, F.col(unit) == F.col("_u")).drop("_u"))
    busy = [r[0] for r in held.groupBy(reviewer).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), reviewer).limit(most).collect()]
    if len(busy) < 2:
        return {"reviewers": len(busy), "statistic": 0.0, "dof": 0, "p": 1.0, "units": 0}
    names = [f"_r{i}" for i in range(1, len(busy))]
    with_all = held.withColumns({name: (F.col(reviewer) == F.lit(who)).cast("double") for name, who in zip(names, busy[1:], strict=True)})
    if held.where(~F.col(reviewer).isin(busy)).limit(1).count():
        with_all = with_all.withColumn("_pooled", (~F.col(reviewer).isin(busy)).cast("double"))
        names.append("_pooled")
    small, large = fit(held, unit, y, adjust), fit(with_all, unit, y, [*adjust, *names])
    drop, p = likelihood_ratio(small.deviance, large.deviance, len(names))
    return {"reviewers": len(busy), "statistic": drop, "dof": len(names), "p": p, "units": small.units}
