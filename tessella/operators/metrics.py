"""Classification metrics of prediction rows (y 0 or 1, probability p) by cells of grouping columns.

Threshold-free metrics come from counts at each distinct score, so ties are exact and a cell's rows
combine before the shuffle: a window runs over distinct scores, not over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import f1, mcc, ratio
from tessella.operators.ordered import running

COUNTS = ("tp", "fp", "fn", "tn")


def confusion(rows: DataFrame, by: Sequence[str], said: Column, weight: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn of each cell; with a weight, its sums."""
    y = F.col("y") == 1
    cells = {"tp": y & said, "fp": ~y & said, "fn": y & ~said, "tn": ~y & ~said}
    count = (lambda c: F.count_if(c)) if weight is None else (lambda c: F.sum(F.when(c, weight).otherwise(0)))
    return rows.groupBy(*by).agg(*[count(c).alias(k) for k, c in cells.items()])


def from_counts(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, mcc, balanced accuracy, accuracy; the last but one null without both classes."""
    tp, fp, fn, tn = map(F.col, COUNTS)
    return counts.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1(tp, fp, fn), "mcc": mcc(tp, fp, fn, tn),
        "balanced_acc": (ratio(tp, tp + fn, None) + ratio(tn, tn + fp, None)) / 2, "accuracy": ratio(tp + tn, tp + fp + fn + tn),
    })


def score_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, p, pos, neg): rows of both classes at each distinct score."""
    return rows.groupBy(*by, "p").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def score_steps(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Score counts with what lies above each score (tp, fp, itself included) and the totals of the cell."""
    return running(score_counts(rows, by), by, -F.col("p"), {"tp": F.col("pos"), "fp": F.col("neg")}).withColumnsRenamed({"all_tp": "all_pos", "all_fp": "all_neg"})


def roc_auc(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; null with one class."""
    above = F.col("fp") - F.col("neg")  # negatives with larger scores
    won = F.col("pos") * (F.col("all_neg") - above - F.col("neg") / 2)
    out = score_steps(rows, by).groupBy(*by).agg(F.sum(won).alias("won"), F.max(F.col("all_pos") * F.col("all_neg")).alias("pairs"))
    return out.select(*by, ratio(F.col("won"), F.col("pairs"), None).alias("roc_auc"))


def average_precision(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum over distinct scores of gained recall times precision; 0 without positives."""
    step = ratio(F.col("pos"), F.col("all_pos")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return score_steps(rows, by).groupBy(*by).agg(F.sum(step).alias("average_precision"))


def pr_trapezoid(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area under the precision-recall curve by trapezoids over distinct scores, from (0, 1); 0 without positives."""
    order = Window.partitionBy(*by).orderBy(F.desc("p"))
    recall, precision = ratio(F.col("tp"), F.col("all_pos")), ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    points = score_steps(rows, by).withColumns({"r": recall, "q": precision})
    area = (F.col("r") - F.coalesce(F.lag("r").over(order), F.lit(0.0))) * (F.col("q") + F.coalesce(F.lag("q").over(order), F.lit(1.0))) / 2
    return points.withColumn("a", area).groupBy(*by).agg(F.sum("a").alias("pr_auc"))


def roc_points(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """False and true positive rate at each distinct score."""
    return score_steps(rows, by).select(*by, "p", ratio(F.col("fp"), F.col("all_neg"), None).alias("fpr"), ratio(F.col("tp"), F.col("all_pos"), None).alias("tpr"))


def full(rows: DataFrame, by: Sequence[str], threshold: Column) -> DataFrame:
    """Counts, all threshold metrics, roc_auc and average_precision of each cell."""
    return from_counts(confusion(rows, by, F.col("p") >= threshold)).join(roc_auc(rows, by), [*by]).join(average_precision(rows, by), [*by])


def multi_label(rows: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Hamming loss, subset accuracy, micro and macro F1 of rows (by, key, label, y, said)."""
    wrong = (F.col("y") != F.col("said")).cast("int")
    samples = rows.groupBy(*by, *key).agg(F.sum(wrong).alias("wrong"), F.count("*").alias("labels"))
    shares = samples.groupBy(*by).agg(ratio(F.sum("wrong"), F.sum("labels")).alias("hamming_loss"), F.avg((F.col("wrong") == 0).cast("double")).alias("subset_accuracy"))
    counts = confusion(rows, [*by, "label"], F.col("said") == 1)
    each = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    scores = counts.withColumn("f", each).groupBy(*by).agg(F.avg("f").alias("f1_macro"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("f1_micro"))
    return shares.join(scores, [*by])


def calibration(rows: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean probability and share of positives in equal bins of [0, 1]; 1 goes to the last bin."""
    at = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int")
    return rows.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("share"))


def losses(rows: DataFrame, by: Sequence[str], gamma: float = 2.0, eps: float = 1e-7) -> DataFrame:
    """Mean cross entropy, the same weighted by class (n / (2 * count)), focal loss, Brier score, Manhattan distance."""
    p = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), F.col("p")))
    pt = F.when(F.col("y") == 1, p).otherwise(1 - p)
    terms = {"bce": -F.ln(pt), "focal": -F.pow(1 - pt, F.lit(gamma)) * F.ln(pt), "brier": F.pow(F.col("p") - F.col("y"), 2), "manhattan": 2 * F.abs(F.col("p") - F.col("y"))}
    of_pos, of_neg = F.sum(F.when(F.col("y") == 1, -F.ln(pt))), F.sum(F.when(F.col("y") == 0, -F.ln(pt)))
    n, pos, neg = F.count("*"), F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    # each class's sum times n / (2 * count), over n
    weighted = (ratio(F.coalesce(of_pos, F.lit(0.0)), 2 * pos) + ratio(F.coalesce(of_neg, F.lit(0.0)), 2 * neg)).alias("weighted_bce")
    return rows.groupBy(*by).agg(n.alias("n"), *[F.avg(t).alias(k) for k, t in terms.items()], weighted)


def seed_average(cells: DataFrame, by: Sequence[str], metrics: Sequence[str], sample: bool = True) -> DataFrame:
    """Mean over a seed's folds first, then mean and standard deviation over seeds."""
    sd = F.stddev_samp if sample else F.stddev_pop
    seeds = cells.groupBy(*by, "seed").agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("folds"))
    return seeds.groupBy(*by).agg(F.count("*").alias("seeds"), F.sum("folds").cast("long").alias("folds"), *[F.avg(m).alias(m) for m in metrics], *[sd(m).alias(f"{m}_sd") for m in metrics])


def ensemble(rows: DataFrame, key: Sequence[str], models: int) -> DataFrame:
    """Mean probability of the rows that all models have."""
    return rows.groupBy(*key, "y").agg(F.avg("p").alias("p"), F.countDistinct("model").alias("models")).where(F.col("models") == models).drop("models")


def model_overlap(rows: DataFrame, key: Sequence[str], said: Column) -> DataFrame:
    """Of each sample: how many models are right and wrong."""
    right = (said == (F.col("y") == 1)).cast("int")
    return rows.groupBy(*key).agg(F.sum(right).cast("long").alias("right"), F.sum(1 - right).cast("long").alias("wrong"), F.max("y").alias("y"))


def error_kappa(rows: DataFrame, key: Sequence[str], said: Column, models: Sequence[str]) -> DataFrame:
    """Kappa of the errors of each two models, from one pivoted row for each sample."""
    wrong = (said != (F.col("y") == 1)).cast("int")
    wide = rows.groupBy(*key).agg(*[F.max(F.when(F.col("model") == m, wrong)).alias(m) for m in models])
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("ea"), F.col(b).alias("eb")) for i, a in enumerate(models) for b in models[i + 1 :]])).alias("x")
    long = wide.select(pairs).select("x.*").where("ea is not null and eb is not null")
    out = long.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("ea") == F.col("eb")).cast("double")).alias("same"), F.avg("ea").alias("pa"), F.avg("eb").alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return out.select("a", "b", "n", F.when(chance < 1, (F.col("same") - chance) / (1 - chance)).alias("kappa"))
