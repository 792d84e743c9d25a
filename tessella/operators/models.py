"""Classical models, one for each label, by name; preparation of features; threshold rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Makes a classifier for so many features. Models of their own can be put in.
MODELS: dict[str, Callable[[int], object]] = {
    "logistic": lambda n: LogisticRegression(maxIter=50, regParam=0.01),
    "random_forest": lambda n: RandomForestClassifier(numTrees=50, maxDepth=8, seed=0),
    "svm": lambda n: LinearSVC(maxIter=50, regParam=0.01),
    "boosting": lambda n: GBTClassifier(maxIter=20, maxDepth=4, seed=0),
    "tree": lambda n: DecisionTreeClassifier(maxDepth=8, seed=0),
    "entropy_tree": lambda n: DecisionTreeClassifier(maxDepth=8, impurity="entropy", seed=0),
    "perceptron": lambda n: MultilayerPerceptronClassifier(layers=[n, 16, 2], maxIter=60, seed=0),
    "naive_bayes": lambda n: NaiveBayes(modelType="gaussian"),
}
#: Those that take row weights.
WEIGHTED = ("logistic", "random_forest", "svm", "boosting", "tree", "entropy_tree", "naive_bayes")


def imputed(rows: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing and NaN values become the training rows' median."""
    known = train.select(*[F.percentile(F.when(~F.isnan(c), F.col(c)), F.lit(0.5)).alias(c) for c in columns]).first()
    return rows.withColumns({c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(float(known[c] or 0.0))) for c in columns})


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """`weight` of each row: n / (classes * rows of its class)."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # as many as there are classes
    n = sum(counts.values())
    weight = F.create_map(*[F.lit(x) for y, k in counts.items() for x in (y, n / (len(counts) * k))])
    return rows.withColumn("weight", F.try_element_at(weight, F.col(label)))


def fit(train: DataFrame, columns: Sequence[str], label: str, model: str, balanced: bool = True) -> PipelineModel:
    train = class_weights(imputed(train, train, columns), label).withColumn("label", F.col(label).cast("double"))
    steps = [VectorAssembler(inputCols=[*columns], outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="features")]
    classifier = MODELS[model](len(columns))
    if balanced and model in WEIGHTED:
        classifier.setWeightCol("weight")
    return Pipeline(stages=[*steps, classifier]).fit(train)


def predicted(model: PipelineModel, rows: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`p` of the positive class; of a margin classifier the logistic function of its margin."""
    out = model.transform(imputed(rows, train, columns))
    p = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.withColumn("p", p).drop("raw", "features", "rawPrediction", "probability", "prediction")


def select(train: DataFrame, val: DataFrame, columns: Sequence[str], label: str, names: Sequence[str]) -> tuple[str, float]:
    """The model with the best average precision on validation rows; the first of equal ones."""
    from tessella.operators.metrics import average_precision

    best = ("", -1.0)
    for name in names:
        rows = predicted(fit(train, columns, label, name), val, train, columns).withColumn("y", F.col(label))
        score = average_precision(rows.withColumn("all", F.lit(1)), ["all"]).first().average_precision
        best = max(best, (name, score), key=lambda x: x[1])
    return best


def rule_score(rules: Sequence[tuple[str, str, float]]) -> Column:
    """Share of threshold rules (column, < or >=, value) that hold."""
    holds = [(F.col(c) < v) if op == "<" else (F.col(c) >= v) for c, op, v in rules]
    return sum([F.coalesce(h.cast("int"), F.lit(0)) for h in holds], F.lit(0)) / len(rules)


def evolve(rows: DataFrame, columns: Sequence[str], label: str, generations: int = 4, population: int = 12, size: int = 3, seed: int = 0) -> list[tuple[str, str, float]]:
    """Threshold rules bred for F1: a generation is scored in one pass, values come from quantiles."""
    import random

    rng = random.Random(seed)
    cuts = rows.agg(*[F.percentile(c, F.array(*[F.lit(q / 20) for q in range(1, 20)])).alias(c) for c in columns]).first()
    fresh = lambda: (c := rng.choice(list(columns)), rng.choice(("<", ">=")), float(rng.choice(cuts[c])))
    people = [[fresh() for _ in range(size)] for _ in range(population)]
    scored: list[tuple[float, list]] = []
    for _ in range(generations):
        y = F.col(label) == 1
        cells = []
        for i, rules in enumerate(people):
            said = rule_score(rules) >= 0.5
            cells += [F.count_if(y & said).alias(f"tp{i}"), F.count_if(y != said).alias(f"miss{i}")]
        got = rows.agg(*cells).first()
        f1 = lambda i: 2 * got[f"tp{i}"] / max(1, 2 * got[f"tp{i}"] + got[f"miss{i}"])
        scored = sorted([*scored, *((f1(i), r) for i, r in enumerate(people))], key=lambda x: -x[0])[: population // 2]
        people = []
        while len(people) < population:
            a, b = rng.choice(scored)[1], rng.choice(scored)[1]
            child = [rng.choice(pair) for pair in zip(a, b, strict=True)]
            child[rng.randrange(size)] = fresh() if rng.random() < 0.5 else child[0]
            people.append(child)
    return scored[0][1]


def linear_contributions(weights: dict[str, float]) -> Column:
    """Each feature's part of a linear score."""
    return F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*[F.col(c) * w for c, w in weights.items()]))
