"""Classifiers: aggregates for naive Bayes, ``pyspark.ml`` for the trained ones."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import number_rows, stable
from ..features import class_weights
from .scores import classification_scores

KEY = "customer_id"


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def add_weights(df: DataFrame, weights: Mapping[int, float] | str | None) -> DataFrame:
    """Row weight from the class, as ``weight``."""
    w = class_weights(df, "label", weights).select("label", "weight")
    return df.join(w, "label")


def stratified_folds(df: DataFrame, n_folds: int = 3, seed: int = 22, key: str = KEY) -> DataFrame:
    """Add ``fold``: classes dealt out evenly in a hash order."""
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(f"fold{seed}"), F.col(key).cast("string"))))
    numbered = number_rows(hashed, ["_h", key], "_pos", by=["label"])
    return numbered.withColumn("fold", F.pmod("_pos", F.lit(n_folds)).cast("int")).drop("_h", "_pos")


# ---- naive Bayes ----------------------------------------------------------------------------------


def gaussian_nb(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    priors: Mapping[int, float] | Sequence[float] | None = None,
    smoothing: float = 1e-9,
    key: str = KEY,
) -> DataFrame:
    """(key, label, prediction, scores): Gaussian naive Bayes with given class priors.

    The model is one aggregate: mean and variance per class and feature, variances raised by
    ``smoothing`` times the largest feature variance.
    """
    features = list(features)
    stats = (
        train.groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(f).alias(f"m_{f}") for f in features],
            *[F.var_pop(f).alias(f"v_{f}") for f in features],
        )
        .orderBy("label")
        .collect()
    )
    total = sum(r["n"] for r in stats)
    spread = train.agg(F.greatest(*[F.var_pop(f) for f in features]) if len(features) > 1 else F.var_pop(features[0])).first()[0]
    floor = smoothing * spread
    if priors is None:
        prior = {int(r["label"]): r["n"] / total for r in stats}
    else:  # a sequence is by label 0, 1, 2 ...; classes absent from training are never predicted
        prior = dict(priors) if isinstance(priors, Mapping) else dict(enumerate(priors))
        unknown = sorted({int(r["label"]) for r in stats} - set(prior))
        if unknown:
            raise ValueError(f"no prior for the classes {unknown}")

    def score(r, prior: float) -> str:
        expr = f"({math.log(prior)!r}D)"
        for f in features:
            var, mean = r[f"v_{f}"] + floor, f"({float(r[f'm_{f}'])!r}D)"
            expr += f" - ({0.5 * math.log(2 * math.pi * var)!r}D) - (`{f}` - {mean}) * (`{f}` - {mean}) / ({2 * var!r}D)"
        return expr

    scored = test.withColumn("scores", F.expr(f"array({', '.join(score(r, p) for r, p in ((r, prior[int(r["label"])]) for r in stats))})"))
    classes = F.array(*[F.lit(int(r["label"])) for r in stats])
    best = classes[(F.array_position("scores", F.array_max("scores")) - 1).cast("int")]
    return scored.select(key, "label", best.alias("prediction"), "scores")


# ---- trained classifiers --------------------------------------------------------------------------


def decision_tree(
    train: DataFrame,
    features: Sequence[str],
    impurity: str = "gini",
    max_depth: int = 10,
    min_instances: int = 1,
    weights: Mapping[int, float] | str | None = "balanced",
    seed: int = 22,
) -> PipelineModel:
    """Tree on assembled features. There is no cap on the number of leaves; depth limits it."""
    tree = DecisionTreeClassifier(
        impurity=impurity, maxDepth=max_depth, minInstancesPerNode=min_instances, weightCol="weight", seed=seed, leafCol="leaf"
    )
    steps = [VectorAssembler(inputCols=list(features), outputCol="features"), tree]
    return Pipeline(stages=steps).fit(add_weights(train, weights))


def random_forest(
    train: DataFrame,
    features: Sequence[str],
    n_trees: int = 30,
    max_depth: int = 15,
    min_instances: int = 1,
    impurity: str = "gini",
    bootstrap: bool = True,
    weights: Mapping[int, float] | str | None = "balanced",
    seed: int = 22,
) -> PipelineModel:
    forest = RandomForestClassifier(
        numTrees=n_trees,
        maxDepth=max_depth,
        minInstancesPerNode=min_instances,
        impurity=impurity,
        bootstrap=bootstrap,
        featureSubsetStrategy="sqrt",
        weightCol="weight",
        seed=seed,
    )
    steps = [VectorAssembler(inputCols=list(features), outputCol="features"), forest]
    return Pipeline(stages=steps).fit(add_weights(train, weights))


def fourier_features(df: DataFrame, features: Sequence[str], gamma: float, size: int = 128, seed: int = 22) -> DataFrame:
    """Random features whose inner product approximates exp(-gamma * |x - y|^2) (Rahimi & Recht, 2007)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), (size, len(features)))
    b = rng.uniform(0.0, 2 * math.pi, size)
    scale = math.sqrt(2.0 / size)
    # one array of weights per feature keeps the expression small
    total = _doubles(b)
    for j, f in enumerate(features):
        total = f"zip_with({total}, {_doubles(w[:, j])}, (acc, v) -> acc + v * `{f}`)"
    return df.withColumn("features", array_to_vector(F.expr(f"transform({total}, v -> cos(v) * {scale!r}D)")))


def _doubles(values: Sequence[float]) -> str:
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


def rbf_gamma(train: DataFrame, features: Sequence[str], how: str = "scale") -> float:
    """``scale``: 1 / (features * variance over all values); ``auto``: 1 / features."""
    if how == "auto":
        return 1.0 / len(features)
    long = train.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "f", "v")
    return 1.0 / (len(features) * long.agg(F.var_pop("v")).first()[0])


def rbf_svm(
    train: DataFrame,
    tests: Sequence[DataFrame],
    features: Sequence[str],
    c: float = 1.0,
    gamma: float | str = "scale",
    size: int = 128,
    max_iter: int = 100,
    weights: Mapping[int, float] | str | None = None,
    seed: int = 22,
    key: str = KEY,
) -> list[DataFrame]:
    """Kernel machine by random features: (key, label, prediction, scores) for each test frame.

    One linear machine per class on the features; probabilities by a logistic fit on the margins.
    """
    g = gamma if isinstance(gamma, float) else rbf_gamma(train, features, gamma)
    n = train.count()
    mapped = add_weights(fourier_features(train, features, g, size, seed), weights)
    svc = LinearSVC(maxIter=max_iter, regParam=1.0 / (n * c))
    model = OneVsRest(classifier=svc, weightCol="weight").fit(mapped)
    margins = model.transform(mapped).select("label", F.col("rawPrediction").alias("margins"))
    calibration = LogisticRegression(featuresCol="margins", regParam=1e-6, maxIter=50).fit(margins)
    out = []
    for t in tests:
        scored = model.transform(fourier_features(t, features, g, size, seed)).select(
            key, F.col("label"), F.col("prediction").cast("int").alias("prediction"), F.col("rawPrediction").alias("margins")
        )
        proba = calibration.transform(
            scored.withColumnRenamed("prediction", "svm_prediction")
        )
        out.append(
            proba.select(
                key, "label", F.col("svm_prediction").alias("prediction"), vector_to_array("probability").alias("scores")
            )
        )
    return out


def mlp(
    train: DataFrame,
    features: Sequence[str],
    hidden: Sequence[int] = (512, 256),
    n_classes: int = 3,
    max_iter: int = 200,
    seed: int = 22,
) -> tuple[PipelineModel, DataFrame]:
    """Network with sigmoid hidden layers and softmax output: (model, loss per iteration).

    Even a few thousand rows cost much in every iteration, so they are spread over all cores.
    """
    net = MultilayerPerceptronClassifier(layers=[len(features), *hidden, n_classes], maxIter=max_iter, seed=seed)
    steps = [VectorAssembler(inputCols=list(features), outputCol="features"), net]
    cores = train.sparkSession.sparkContext.defaultParallelism
    model = Pipeline(stages=steps).fit(stable(train.repartition(cores, *features)))
    history = [(i, float(x)) for i, x in enumerate(model.stages[-1].summary().objectiveHistory)]
    return model, train.sparkSession.createDataFrame(history, "iteration int, loss double")


def predict(model: Model, df: DataFrame, key: str = KEY) -> DataFrame:
    """(key, label, prediction, scores)."""
    return model.transform(df).select(
        key, "label", F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability").alias("scores")
    )


def train_test_scores(model: Model, train: DataFrame, test: DataFrame, key: str = KEY) -> DataFrame:
    """Scores on both sets, one row per ``split``."""
    both = predict(model, train, key).withColumn("split", F.lit("train")).unionByName(
        predict(model, test, key).withColumn("split", F.lit("test"))
    )
    return classification_scores(both, by=["split"])


def grid_search(
    train: DataFrame,
    features: Sequence[str],
    estimator: str,
    grid: Mapping[str, Sequence],
    weights: Mapping[int, float] | str | None = None,
    n_folds: int = 3,
    parallelism: int = 4,
    seed: int = 22,
    key: str = KEY,
) -> tuple[CrossValidatorModel, DataFrame]:
    """Exhaustive search with stratified folds: (best model refitted, one row per setting)."""
    est = {
        "decision_tree": lambda: DecisionTreeClassifier(weightCol="weight", seed=seed),
        "random_forest": lambda: RandomForestClassifier(numTrees=30, weightCol="weight", seed=seed),
        "mlp": lambda: MultilayerPerceptronClassifier(seed=seed),
    }[estimator]()
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), list(values))
    maps = builder.build()
    data = assemble(add_weights(stratified_folds(train, n_folds, seed, key), weights), features)
    if estimator == "decision_tree" and "maxDepth" in grid:
        model = _search_depths(data, est, maps, n_folds, parallelism)
    else:
        cv = CrossValidator(
            estimator=est,
            estimatorParamMaps=maps,
            evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
            numFolds=n_folds,
            foldCol="fold",
            parallelism=parallelism,
        )
        model = cv.fit(data)
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)), float(a))
        for m, a in zip(maps, model.avgMetrics)
    ]
    schema = "setting string, accuracy double"
    return model, train.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("accuracy"), "setting")


def _search_depths(
    data: DataFrame, tree: DecisionTreeClassifier, maps: Sequence[dict], n_folds: int, parallelism: int
) -> CrossValidatorModel:
    """Cross-validation of single trees that fits only the deepest of settings that differ in ``maxDepth`` alone.

    A node's split does not depend on how deep its tree may grow, so the deepest tree cut at a depth is the tree of that
    depth. (A forest draws features for its nodes in an order that depends on the depth, so this is for single trees.)
    """
    groups: dict[tuple, list[int]] = {}
    for i, m in enumerate(maps):
        groups.setdefault(tuple(sorted((p.name, v) for p, v in m.items() if p.name != "maxDepth")), []).append(i)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    accuracy = np.zeros((n_folds, len(maps)))

    def run(task: tuple[int, list[int]]) -> None:
        fold, own = task
        depths = [maps[i][tree.maxDepth] for i in own]
        model = tree.fit(data.where(F.col("fold") != fold), maps[own[int(np.argmax(depths))]])
        accuracy[fold, own] = _depth_accuracies(model, data.where(F.col("fold") == fold), depths)

    with ThreadPool(min(parallelism, n_folds * len(groups))) as pool:
        pool.map(inheritable_thread_target(data.sparkSession)(run), [(f, own) for f in range(n_folds) for own in groups.values()], 1)
    mean = accuracy.mean(axis=0)
    best = tree.fit(data, maps[int(mean.argmax())])
    data.unpersist()
    return CrossValidatorModel(best, mean.tolist())


def _depth_accuracies(model: DecisionTreeClassificationModel, df: DataFrame, depths: Sequence[int]) -> list[float]:
    """Accuracy of a fitted tree cut at each of the depths."""
    feature, edge, child, label = _nodes(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, at, hits = np.array(batch["x"].tolist()), np.zeros(len(batch), dtype=int), {}
            for depth in range(max(depths) + 1):
                hits[depth] = int((label[at] == batch["label"].to_numpy()).sum())
                at = child[at, (x[np.arange(len(x)), feature[at]] > edge[at]).astype(int)]
            yield pd.DataFrame({"depth": hits.keys(), "hits": hits.values(), "n": len(batch)})

    seen = df.select("label", vector_to_array("features").alias("x")).mapInPandas(run, "depth int, hits long, n long")
    found = {r["depth"]: r["a"] for r in seen.groupBy("depth").agg((F.sum("hits") / F.sum("n")).alias("a")).collect()}
    return [found[d] for d in depths]


def _nodes(model: DecisionTreeClassificationModel) -> tuple[np.ndarray, ...]:
    """(feature, threshold, children, prediction) of a tree's nodes, the root first; a leaf is its own child."""
    nodes = [model._java_obj.rootNode()]
    feature, edge, child, label = [], [], [], []
    for i, node in enumerate(nodes):  # grows while it is read
        label.append(node.prediction())
        if node.subtreeDepth():
            split = node.split()
            feature.append(split.featureIndex())
            edge.append(split.threshold())
            child.append((len(nodes), len(nodes) + 1))
            nodes += [node.leftChild(), node.rightChild()]
        else:
            feature.append(0)
            edge.append(0.0)
            child.append((i, i))
    return np.array(feature), np.array(edge), np.array(child), np.array(label)


def svm_grid_search(
    train: DataFrame,
    features: Sequence[str],
    cs: Sequence[float],
    gammas: Sequence[str | float] = ("scale", "auto"),
    size: int = 128,
    max_iter: int = 100,
    n_folds: int = 3,
    parallelism: int = 4,
    seed: int = 22,
    key: str = KEY,
) -> DataFrame:
    """(gamma, c, accuracy) of the kernel machine by cross-validation on stratified folds, best first."""
    if min(cs) <= 0:
        raise ValueError("c must be positive")
    data = stratified_folds(train, n_folds, seed, key)
    n = train.count() * (n_folds - 1) / n_folds
    rows = []
    for how in gammas:
        g = how if isinstance(how, float) else rbf_gamma(train, features, how)
        mapped = stable(fourier_features(data, features, g, size, seed).select("label", "fold", "features"))
        each = OneVsRest()
        machines = [LinearSVC(maxIter=max_iter, regParam=1.0 / (n * c)) for c in cs]
        cv = CrossValidator(
            estimator=each,
            estimatorParamMaps=ParamGridBuilder().addGrid(each.classifier, machines).build(),
            evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
            numFolds=n_folds,
            foldCol="fold",
            parallelism=parallelism,
        )
        rows += [(str(how), float(c), float(a)) for c, a in zip(cs, cv.fit(mapped).avgMetrics, strict=True)]
    out = train.sparkSession.createDataFrame(rows, "gamma string, c double, accuracy double")
    return out.orderBy(F.desc("accuracy"), "gamma", "c")


def leaf_profile(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per leaf of a fitted tree: size, class counts, majority class, feature ranges."""
    at = model.transform(df)
    counts = at.groupBy("leaf", "label").agg(F.count(F.lit(1)).alias("n"))
    classes = counts.groupBy("leaf").agg(
        F.sum("n").alias("n"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("class_counts"),
        F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("majority"),
    )
    ranges = at.groupBy("leaf").agg(
        *[F.min(f).alias(f"min_{f}") for f in features], *[F.max(f).alias(f"max_{f}") for f in features]
    )
    return classes.join(ranges, "leaf")
