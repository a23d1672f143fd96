"""Training of flow classifiers with Spark ML: selection, binning, forests, search, pruning, cascades and updates."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, QuantileDiscretizer, VarianceThresholdSelector, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.keys import uniform
from rivulet.operators import metrics, models


@dataclass
class FlowModel:
    """Columns that were selected, the fitted steps, and the threshold at which trees vote."""

    selected: list[str]
    steps: PipelineModel
    threshold: float = 0.5

    @property
    def forest(self) -> RandomForestClassificationModel:
        return self.steps.stages[-1]

    def scores(self, rows: DataFrame) -> DataFrame:
        """Adds proba, rounded to 5 places, so that curves have a bounded number of points."""
        out = self.steps.transform(rows)
        return out.withColumn("proba", F.round(vector_to_array("probability")[1], 5)).select(*rows.columns, "proba")

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.scores(rows).withColumn("predicted", (F.col("proba") >= self.threshold).cast("int"))


def select_features(rows: DataFrame, features: list[str], trees: int = 20, depth: int = 10, seed: int = 42) -> list[str]:
    """Features of at least mean importance in a small forest."""
    v = VectorAssembler(inputCols=features, outputCol="__x").transform(rows)
    model = RandomForestClassifier(featuresCol="__x", labelCol="heavy", numTrees=trees, maxDepth=depth, seed=seed).fit(v)
    weight = model.featureImportances.toArray()
    return [f for f, w in zip(features, weight, strict=True) if w >= weight.mean()] or features


def fit(rows: DataFrame, features: list[str], aggregates: list[str], trees: int = 20, depth: int = 8, bins: int = 8, select: bool = True, seed: int = 42, **forest) -> FlowModel:
    """Selection, quantile bins of the aggregates as one-hot columns, columns without variance dropped, then a forest."""
    chosen = select_features(rows, features, seed=seed) if select else features
    binned, plain = [c for c in chosen if c in aggregates], [c for c in chosen if c not in aggregates]
    steps = [QuantileDiscretizer(inputCols=binned, outputCols=[f"__b_{c}" for c in binned], numBuckets=bins, handleInvalid="keep")] if binned else []
    steps += [OneHotEncoder(inputCols=[f"__b_{c}" for c in binned], outputCols=[f"__o_{c}" for c in binned], dropLast=False, handleInvalid="keep")] if binned else []
    steps += [
        VectorAssembler(inputCols=[*plain, *(f"__o_{c}" for c in binned)], outputCol="__all", handleInvalid="keep"),
        VarianceThresholdSelector(featuresCol="__all", outputCol="__kept", varianceThreshold=0.0),
        RandomForestClassifier(featuresCol="__kept", labelCol="heavy", numTrees=trees, maxDepth=depth, seed=seed, **forest),
    ]
    return FlowModel(chosen, Pipeline(stages=steps).fit(rows))


def slicer(features: list[str], chosen: list[str]) -> VectorSlicer:
    """The same selection on an assembled vector."""
    return VectorSlicer(inputCol="features", outputCol="selected", indices=[features.index(c) for c in chosen])


def random_search(rows: DataFrame, features: list[str], aggregates: list[str], space: dict[str, list], draws: int = 50, folds: int = 2, seed: int = 42) -> DataFrame:
    """(draw, params, ap, rank): the mean average precision over folds for settings drawn from the space."""
    rng = random.Random(seed)
    split = models.folds(rows, folds, seed).persist()
    out = []
    for k in range(draws):
        params = {name: rng.choice(values) for name, values in space.items()}
        ap = 0.0
        for f in range(folds):
            model = fit(split.where(F.col("fold") != f), features, aggregates, select=False, seed=seed, **params)
            ap += (metrics.average_precision(model.scores(split.where(F.col("fold") == f))).first()["ap"] or 0.0) / folds
        out.append((k, str(sorted(params.items())), ap))
    split.unpersist()
    ranked = {k: r + 1 for r, (k, _, _) in enumerate(sorted(out, key=lambda x: (-x[2], x[0])))}
    return rows.sparkSession.createDataFrame([(*x, ranked[x[0]]) for x in out], "draw int, params string, ap double, rank int")


def tree_scores(model: FlowModel, rows: DataFrame, key: str = "flow_id") -> DataFrame:
    """(flow_id, tree, proba) of each tree, from one pass over the rows."""
    prepared = PipelineModel(model.steps.stages[:-1]).transform(rows)
    for k, tree in enumerate(model.forest.trees):
        prepared = tree.setFeaturesCol("__kept").setPredictionCol(f"__p{k}").setProbabilityCol(f"__pr{k}").setRawPredictionCol(f"__r{k}").transform(prepared)
    each = F.array(*(F.struct(F.lit(k).alias("tree"), vector_to_array(f"__pr{k}")[1].alias("proba")) for k in range(len(model.forest.trees))))
    return prepared.select(key, F.explode(each).alias("t")).select(key, "t.tree", "t.proba")


def tree_nodes(spark: SparkSession, model: RandomForestClassificationModel, path: str) -> DataFrame:
    """(tree, node, is_leaf) of a forest, read from the form in which it is saved."""
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    node = data.select("treeID", "nodeData.*") if "nodeData" in data.columns else data
    return node.select(F.col("treeID").alias("tree"), F.col("id").alias("node"), (F.col("leftChild") < 0).alias("is_leaf"))


def prune(model: FlowModel, rows: DataFrame, nodes: DataFrame, max_bits: int, feature_bits: int = 7, threshold_bits: int = 32) -> DataFrame:
    """Trees kept under a size bound: by average precision, best first, until the bound is passed, two at least."""
    s = tree_scores(model, rows).join(rows.select("flow_id", "heavy"), "flow_id").withColumn("proba", F.round("proba", 3)).persist()
    ap = [(k, metrics.average_precision(s.where(F.col("tree") == k)).first()["ap"]) for k in range(len(model.forest.trees))]
    s.unpersist()
    scored = rows.sparkSession.createDataFrame(ap, "tree int, score double")
    bits = models.full_tree_bits(nodes, feature_bits, threshold_bits).select("tree", F.col("bits").cast("long").alias("bits"))
    return models.prune_to_size(scored.join(bits, "tree"), max_bits)


def relabel_by_cost(rows: DataFrame, features: list[str], cost, rounds: int = 10, share: float = 0.5, seed: int = 42) -> DataFrame:
    """MetaCost: forests of bootstrap samples score all rows; each row gets the class of least expected cost."""
    parts = None
    for k in range(rounds):
        model = fit(rows.sample(True, share, seed + k), features, [], trees=5, select=False, seed=seed + k)
        s = model.scores(rows).select("flow_id", F.lit(k).alias("model"), "proba")
        parts = s if parts is None else parts.unionByName(s)
    new = models.meta_cost(parts, cost).select("flow_id", F.col("label").alias("__label"))
    return rows.join(new, "flow_id").withColumn("heavy", F.col("__label")).drop("__label")


def cascade(stages: list[DataFrame], features: list[list[str]], threshold: float = 0.5) -> tuple[list[FlowModel], DataFrame]:
    """A model for each stage (rows of flows with more packets each): what a stage predicts as elephant goes on to the
    next one, if it is there. Returns the models and the last stage's predictions."""
    out, rows = [], stages[0]
    for k, stage in enumerate(stages):
        rows = stage if k == 0 else stage.join(passed, "flow_id", "left_semi")  # noqa: F821
        if not rows.limit(1).count():
            break
        model = fit(rows, features[k], [], trees=1, select=False)
        model.threshold = threshold
        out.append(model)
        last = model.predict(rows)
        passed = last.where("predicted = 1").select("flow_id")
    return out, last


@dataclass
class Continual:
    """Scores each minute with the model at hand, keeps samples, and trains anew every `every` minutes."""

    train: Callable[[DataFrame], FlowModel]
    policy: str = "update-fifo"
    every: int = 1
    keep: int = 10_000
    reset_at: int | None = None
    min_agreement: float = 0.6
    history: list[tuple[int, float]] = field(default_factory=list)

    def run(self, first: DataFrame, minutes: Iterable[tuple[int, DataFrame]]) -> list[tuple[int, float]]:
        """(minute, average precision) of the model that was there when the minute came."""
        buffer, model = first, self.train(first)
        for minute, rows in minutes:
            if self.reset_at == minute:
                buffer = buffer.limit(1)
            self.history.append((minute, metrics.average_precision(model.scores(rows)).first()["ap"]))
            votes = tree_scores(model, rows).withColumn("vote", (F.col("proba") >= model.threshold).cast("int"))
            hard = models.agreement(votes).where(F.col("agreement") < self.min_agreement)
            new = rows.join(hard, "flow_id")
            old = buffer if "agreement" in buffer.columns else buffer.withColumn("agreement", F.lit(1.0))
            buffer = models.replay_buffer(old, new.select(*old.columns), self.policy, self.keep)
            if minute % self.every == 0:
                model = self.train(buffer)
        return self.history


def distill(teacher: DataFrame, features: list[str], depth: int = 5, rounds: int = 10, share: float = 0.7, keep: int = 3, seed: int = 42) -> tuple[DecisionTreeClassificationModel, DataFrame]:
    """A small tree that explains a classifier: (tree, report) of rows (flow_id, features, predicted).

    In each round a tree learns what the teacher says of a share of the rows; the rest tells its fidelity, the F1 of its
    answers against the teacher's. The `keep` most faithful trees answer for the rows held out of all of them, and the
    tree that agrees best with the others, on average, is the explanation; ties by fidelity. The report has a row for
    each round: round, fidelity, agreement (null where the tree wasn't kept).
    """
    rows = VectorAssembler(inputCols=features, outputCol="__x").transform(teacher.select("flow_id", "predicted", *features))
    u = uniform("flow_id", f"test{seed}")
    train, test = rows.where(u < share), rows.where(u >= share).persist()
    students = []
    for k in range(rounds):
        part = train.where(uniform("flow_id", f"round{seed}-{k}") < share)
        tree = DecisionTreeClassifier(featuresCol="__x", labelCol="predicted", maxDepth=depth, seed=seed + k).fit(part)
        students.append((k, tree, _f1(tree.transform(test), "predicted", "prediction")))
    best = sorted(students, key=lambda s: (-s[2], s[0]))[:keep]
    answers = test
    for k, tree, _ in best:
        answers = tree.copy().setPredictionCol(f"__p{k}").setProbabilityCol(f"__q{k}").setRawPredictionCol(f"__r{k}").transform(answers)
    agreed = {}
    for k, _, _ in best:
        agreed[k] = sum(_f1(answers, f"__p{j}", f"__p{k}") for j, _, _ in best) / len(best)
    test.unpersist()
    chosen = max(best, key=lambda s: (agreed[s[0]], s[2], -s[0]))
    report = [(k, f, agreed.get(k)) for k, _, f in students]
    return chosen[1], teacher.sparkSession.createDataFrame(report, "round int, fidelity double, agreement double")


def _f1(rows: DataFrame, truth: str, answer: str) -> float:
    pairs = rows.select(F.col(truth).cast("int").alias("heavy"), F.col(answer).cast("int").alias("predicted"))
    return metrics.precision_recall_f1(metrics.confusion(pairs)).first()["f1"]
