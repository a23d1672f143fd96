"""Classifiers as columns and relations: looked up, synthetic, voting; thresholds, sampling and model sizes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.keys import uniform


class Scorer(Protocol):
    """A model by batches: rows of features to probabilities."""

    def __call__(self, features: pd.DataFrame) -> pd.Series: ...


def score(flows: DataFrame, make: Callable[[], Scorer], features: list[str], threshold: float, strict: bool = False) -> DataFrame:
    """Adds proba, rounded to 5 places, and predicted. `make` is run once in each task and gives the model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            yield pdf.assign(proba=model(pdf[features]).astype(float))

    out = flows.mapInPandas(run, flows.schema.add("proba", "double")).withColumn("proba", F.round("proba", 5))
    p = F.col("proba")
    return out.withColumn("predicted", ((p > threshold) if strict else (p >= threshold)).cast("int"))


def onnx_scorer(model: bytes) -> Callable[[], Scorer]:
    """A model in ONNX form as `make` for `score`: one float32 input tensor, class probabilities or labels out."""

    def make() -> Scorer:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name

        def run(features: pd.DataFrame) -> pd.Series:
            out = session.run(None, {name: features.to_numpy("float32")})[-1]
            return pd.Series([x[1] for x in out] if isinstance(out, list) else out.reshape(len(features), -1)[:, -1])

        return run

    return make


def truth(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """Predicted as the labels (flow_id, heavy) say; a flow without a label is an error."""
    found = flows.join(labels.select("flow_id", "heavy"), "flow_id", "left")
    sure = F.when(F.col("heavy").isNull(), F.raise_error(F.concat(F.lit("no label of flow "), F.col("flow_id")))).otherwise(F.col("heavy"))
    return found.withColumn("predicted", sure.cast("int")).drop("heavy")


def constant(flows: DataFrame, label: int = 0) -> DataFrame:
    return flows.withColumn("predicted", F.lit(label))


def cached(flows: DataFrame, cache: DataFrame, fallback: Column, threshold: float) -> DataFrame:
    """Probabilities from (flow_id, proba), where there is one, else `fallback`; predicted above the threshold."""
    got = flows.join(cache.select("flow_id", F.col("proba").alias("__hit")), "flow_id", "left")
    p = F.coalesce("__hit", fallback)
    return got.withColumn("proba", p).withColumn("from_cache", F.col("__hit").isNotNull()).withColumn("predicted", (p > threshold).cast("int")).drop("__hit")


def synthetic_rates(labelled: DataFrame, fnr: float, fpr: float) -> DataFrame:
    """A classifier of given error rates, drawn by a hash of the flow: the same for the same flow."""
    u = uniform("flow_id")
    return labelled.withColumn("predicted", F.when(F.col("heavy") == 1, u > fnr).otherwise(u < fpr).cast("int"))


def beta_quantile(u: Column, alpha: float, beta: int = 3, steps: int = 45) -> Column:
    """The u-quantile of Beta(alpha, beta) with a whole beta, whose distribution function is a finite sum: by halving."""

    def below(x: Column) -> Column:
        term, total = 1.0, F.lit(1.0)
        for j in range(1, beta):
            term *= (alpha + j - 1) / j
            total = total + F.lit(term) * F.pow(1 - x, F.lit(j))
        return F.pow(x, F.lit(alpha)) * total

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        less = below(mid) < u
        return F.struct(F.when(less, mid).otherwise(s["low"]).alias("low"), F.when(less, s["high"]).otherwise(mid).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["low"] + s["high"]) / 2)


def synthetic_scores(labelled: DataFrame, alpha: float, beta: int = 3) -> DataFrame:
    """Adds proba, Beta(alpha, beta) for mice and one less that for elephants, drawn by a hash of the flow: the same on
    each run. alpha sets how far the classes are apart."""
    x = beta_quantile(uniform("flow_id", "beta"), alpha, beta)
    return labelled.withColumn("proba", F.round(F.when(F.col("heavy") == 1, 1 - x).otherwise(x), 5))


def score_thresholds(labelled: DataFrame, alpha_of: dict[float, float], share: float) -> DataFrame:
    """(ap, threshold): for each average precision and its alpha, the score above which a share of the flows lies."""
    out = None
    for ap, alpha in alpha_of.items():
        t = synthetic_scores(labelled, alpha).agg(F.percentile("proba", F.lit(1 - share)).alias("threshold")).select(F.lit(ap).alias("ap"), "threshold")
        out = t if out is None else out.unionByName(t)
    return out


def nearest_alphas(aps: list[tuple[float, float]], targets: list[float], tolerance: float = 0.015) -> dict[float, float]:
    """For each target the mean of the alphas of (alpha, ap) whose ap is within the tolerance; targets without any go."""
    near = {t: [a for a, ap in aps if abs(ap - t) <= tolerance] for t in targets}
    return {t: sum(found) / len(found) for t, found in near.items() if found}


def calibrate_alpha(labelled: DataFrame, alphas: list[float]) -> list[tuple[float, float]]:
    """(alpha, average precision) of the synthetic classifier for each alpha."""
    from rivulet.operators.metrics import average_precision

    return [(a, average_precision(synthetic_scores(labelled, a)).first()["ap"]) for a in alphas]


def rate_table(labelled: DataFrame, predicted: float, fnrs: list[float]) -> DataFrame:
    """(fnr, fpr): the FPR that goes with each FNR if a share `predicted` is predicted; the share of elephants is measured."""
    heavy = labelled.agg(F.avg("heavy").alias("h"))
    grid = heavy.select("h", F.explode(F.array(*(F.lit(f) for f in fnrs))).alias("fnr"))
    return grid.select("fnr", ((predicted - F.col("h") * (1 - F.col("fnr"))) / (1 - F.col("h"))).alias("fpr"))


def inverse_rate_table(labelled: DataFrame, predicted: float, deltas: list[float]) -> DataFrame:
    """(fpr, fnr): from the least FPR at which a share `predicted` can be predicted, in steps of a half percent, upwards;
    an FPR above that share counts as the share."""
    heavy = labelled.agg(F.avg("heavy").alias("h"))
    least = (predicted - F.col("h")) / (1 - F.col("h"))
    halves = F.round(least * 2, 2) / 2
    grid = heavy.select("h", F.when(halves < least, halves + 0.005).otherwise(halves).alias("low"), F.explode(F.array(*(F.lit(x) for x in deltas))).alias("delta"))
    fpr = F.col("low") + F.col("delta")
    return grid.select(fpr.alias("fpr"), (((1 - F.col("h")) * fpr - F.greatest(F.lit(predicted), fpr) + F.col("h")) / F.col("h")).alias("fnr"))


def binary_average_precision(labelled: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ap to (fnr, fpr): the average precision of the synthetic classifier with those rates, whose scores are 0 or
    1. The rates, a short grid, go to each flow as one array."""
    grid = rates.agg(F.collect_list(F.struct("fnr", "fpr")).alias("grid"))
    x = labelled.select("heavy", uniform("flow_id").alias("u")).crossJoin(F.broadcast(grid)).select("heavy", "u", F.inline("grid"))  # a single row
    y = F.when(F.col("heavy") == 1, F.col("u") > F.col("fnr")).otherwise(F.col("u") < F.col("fpr"))
    c = x.groupBy("fnr", "fpr").agg(F.sum("heavy").alias("p"), F.count("*").alias("n"), F.count(F.when(y, 1)).alias("k"), F.count(F.when(y & (F.col("heavy") == 1), 1)).alias("tp"))
    recall = F.col("tp") / F.col("p")
    return c.select("fnr", "fpr", (recall * F.coalesce(F.try_divide(F.col("tp"), F.col("k")), F.lit(0.0)) + (1 - recall) * F.col("p") / F.col("n")).alias("ap"))


def vote(tree_scores: DataFrame, threshold: float) -> DataFrame:
    """(flow_id, share, predicted) of (flow_id, tree, proba): trees vote at the threshold; half of them is enough."""
    share = F.avg((F.col("proba") >= threshold).cast("double"))
    return tree_scores.groupBy("flow_id").agg(share.alias("share")).withColumn("predicted", (F.col("share") >= 0.5).cast("int"))


def agreement(votes: DataFrame, as_published: bool = True) -> DataFrame:
    """(flow_id, agreement) of (flow_id, tree, vote): |votes for less votes against| / trees.

    As published, z votes for the mouse count as z + 1, and where all agree as 1 against n - 1.
    """
    n, ones = F.count("*"), F.sum("vote")
    c = votes.groupBy("flow_id").agg(n.alias("n"), ones.alias("ones"))
    zeros = F.col("n") - F.col("ones")
    if not as_published:
        return c.select("flow_id", (F.abs(F.col("ones") - zeros) / F.col("n")).alias("agreement"))
    against = F.when((zeros == 0) | (zeros == F.col("n")), F.lit(1)).otherwise(zeros + 1)
    return c.select("flow_id", (F.abs(F.col("n") - 2 * against) / F.col("n")).alias("agreement"))


def hardest(votes_agreement: DataFrame, n: int) -> DataFrame:
    """The n rows the trees agree on least; ties by id."""
    return votes_agreement.orderBy("agreement", "flow_id").limit(n)


def search_threshold(tree_scores: DataFrame, target: int, tolerance: float = 0.05, least_step: float = 0.0005) -> float:
    """The vote threshold at which about `target` flows are predicted: bisection, a count on the cluster for each step."""
    low, high, at = 0.0, 1.0, 0.5
    while high - low > least_step:
        n = vote(tree_scores, at).where("predicted = 1").count()
        if abs(n - target) <= tolerance * target:
            break
        low, high = (at, high) if n > target else (low, at)
        at = (low + high) / 2
    return at


def buffer_rows(agreements: DataFrame, how: str, least: float, rate: float, salt: str = "buffer") -> DataFrame:
    """(flow_id) of (flow_id, agreement) to keep for training: active takes those the trees agree on less than `least`,
    random a share of all, both the first and a share of the rest, as many rows of it as of all. Where the rest has no
    more rows than that, both adds none."""
    hard, u = F.col("agreement") < least, uniform("flow_id", salt)
    if how == "active":
        return agreements.where(hard).select("flow_id")
    if how == "random":
        return agreements.where(u < rate).select("flow_id")
    if how != "both":
        raise ValueError(f"unknown way to keep rows: {how}")
    n = agreements.agg(F.count("*").alias("n"), F.count(F.when(~hard, 1)).alias("rest"))
    of_rest = F.col("n") * rate / F.col("rest")
    return agreements.crossJoin(F.broadcast(n)).where(hard | ((of_rest < 1) & (u < of_rest))).select("flow_id")  # a single row


def sample_share(rows: DataFrame, share: float, salt: str = "sample") -> DataFrame:
    """Rows whose hash of flow_id is below the share: the same ones on each run."""
    return rows.where(uniform("flow_id", salt) < share)


def zero_evicted(scores: DataFrame, share: float) -> DataFrame:
    """proba 0 for int(share * n) flows, those of least hash: what would be if they had been evicted."""
    n = scores.agg(F.floor(F.count("*") * share).alias("cut"))
    order = scores.withColumn("u", uniform("flow_id", "evict")).crossJoin(F.broadcast(n))  # a single row
    # Ranks within 4096 ranges of the hash, and counts of the ranges before: no sort of all rows in one task.
    order = order.withColumn("range", F.floor(F.col("u") * 4096))
    counts = order.groupBy("range").agg(F.count("*").alias("c"))
    base = counts.select("range", F.coalesce(F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = order.join(base, "range").withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("u", "flow_id")) + F.col("before"))
    return ranked.select("flow_id", F.when(F.col("rank") <= F.col("cut"), 0.0).otherwise(F.col("proba")).alias("proba"))


def stratified(rows: DataFrame, share_heavy: float, n: int, seed: int = 42) -> DataFrame:
    """n rows of which share_heavy are elephants, as far as there are as many."""
    heavy = int(n * share_heavy)
    pick = lambda label, m: rows.where(F.col("heavy") == label).orderBy(uniform("flow_id", str(seed)), "flow_id").limit(m)
    return pick(1, heavy).unionByName(pick(0, n - heavy))


def undersample(rows: DataFrame, seed: int = 42) -> DataFrame:
    """As many rows of each class as the smaller one has, about: by hash, at the rate that its count gives."""
    counts = {r["heavy"]: r["count"] for r in rows.groupBy("heavy").count().collect()}  # a row for each class
    least = min(counts.values(), default=0)
    rate = F.create_map(*(F.lit(x) for k, v in counts.items() for x in (k, least / v))) if counts else F.lit(None)
    return rows.where(uniform("flow_id", str(seed)) < rate[F.col("heavy")]) if counts else rows


def folds(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Adds fold, 0..n-1, by hash: rows of a flow stay together."""
    return rows.withColumn("fold", F.floor(uniform("flow_id", f"fold{seed}") * n).cast("int"))


def stratified_folds(rows: DataFrame, n: int, seed: int = 42, ranges: int = 4096) -> DataFrame:
    """Adds fold, 0..n-1: rows of each class are dealt in turn, in order of a hash, so folds have equal shares of it.

    Ranks are taken within ranges of the hash, over the counts of those before, so that no class is sorted in one task.
    """
    r = rows.withColumn("__u", uniform("flow_id", f"fold{seed}")).withColumn("__r", F.floor(F.col("__u") * ranges))
    c = r.groupBy("heavy", "__r").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy("heavy").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = r.join(c.select("heavy", "__r", before.alias("__b")), ["heavy", "__r"])
    nth = F.col("__b") + F.row_number().over(Window.partitionBy("heavy", "__r").orderBy("__u", "flow_id")) - 1
    return at.withColumn("fold", (nth % n).cast("int")).drop("__u", "__r", "__b")


def time_splits(rows: DataFrame, n: int, minutes: int) -> DataFrame:
    """A row for each split, 0..n-1, and row (minute, ...) in it, with side: a split tests one of the last n of n + 1
    equal stretches of minutes and trains on all before it."""
    length = minutes // (n + 1)
    split = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    begins = F.lit(minutes) - length * (n - F.col("split"))
    side = F.when(F.col("minute") < begins, "train").when(F.col("minute") < begins + length, "test")
    return split.withColumn("side", side).where("side IS NOT NULL")


def apart(split: DataFrame, salt: str = "apart") -> DataFrame:
    """Rows (split, flow_id, side, ...) of which no flow is on both sides: one that was stays in training with the
    chance that testing has of a row, else in the test, by its hash."""
    n = split.groupBy("split").agg(F.avg((F.col("side") == "test").cast("int")).alias("__share"))
    both = split.groupBy("split", "flow_id").agg((F.countDistinct("side") == 2).alias("__both"))
    j = split.join(both, ["split", "flow_id"]).join(n, "split")
    trains = uniform(F.concat_ws("#", "split", "flow_id"), salt) < F.col("__share")
    return j.where(~F.col("__both") | ((F.col("side") == "train") == trains)).drop("__both", "__share")


def full_tree_bits(nodes: DataFrame, feature_bits: int, threshold_bits: int, label_bits: int = 1) -> DataFrame:
    """Bits of each tree of (tree, is_leaf): inner nodes hold a feature, a threshold and a child pointer, leaves a label."""
    n = F.count("*")
    pointer = F.ceil(F.log2(n))
    inner = F.sum((~F.col("is_leaf")).cast("long"))
    leaves = F.sum(F.col("is_leaf").cast("long"))
    return nodes.groupBy("tree").agg(inner.alias("inner"), leaves.alias("leaves"), (inner * (feature_bits + threshold_bits + pointer) + leaves * label_bits).alias("bits"))


def structure_bits(nodes: DataFrame, binary: int, wide: int, width: int = 16) -> DataFrame:
    """(tree, full, table, hybrid) bits of (tree, depth, is_leaf, feature, threshold), by three ways to lay out a forest.

    `full` holds every place of a complete tree; `table` a row for each leaf, over the features and the coded ranges of
    the wide ones; `hybrid` complete layers as far as the widest layer of any tree needs them, and layers of that width
    below. Features at `binary` and above are the wide ones; ranges and the widest layer are of the whole forest.
    """
    entry = math.ceil(math.log2(binary + wide)) + width + 1
    cut = nodes.where(~F.col("is_leaf") & (F.col("feature") >= binary)).agg(F.countDistinct("threshold").alias("ranges"))
    widest = nodes.groupBy("tree", "depth").agg(F.count("*").alias("n")).agg(F.max("n").alias("widest"))
    trees = nodes.groupBy("tree").agg(F.max("depth").alias("depth"), F.sum(F.col("is_leaf").cast("long")).alias("leaves"))
    t = trees.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(widest))  # single rows
    code = F.when(F.col("ranges") > 0, F.ceil(F.log2(F.col("ranges") + 1))).otherwise(0)
    layers = F.floor(F.log2("widest")) + 1
    full = (F.pow(F.lit(2.0), F.col("depth") + 1) - 1) * entry
    table = F.col("leaves") * (binary + wide * code + 1) + wide * ((F.col("ranges") + 1) * (width + code))
    hybrid = (F.pow(F.lit(2.0), layers) - 1) * entry + F.col("widest") * (F.col("depth") + 1 - layers) * entry
    return t.select("tree", full.cast("long").alias("full"), table.cast("long").alias("table"), hybrid.cast("long").alias("hybrid"))


def binary_structure_bits(nodes: DataFrame, binary: int) -> DataFrame:
    """(tree, dense, hybrid, table) bits in hardware of trees over binary features alone."""
    entry = math.ceil(math.log2(binary)) + 1
    widest = nodes.groupBy("tree", "depth").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    t = nodes.groupBy("tree").agg(F.max("depth").alias("depth"), F.sum(F.col("is_leaf").cast("long")).alias("leaves")).crossJoin(F.broadcast(widest))  # a single row
    layers = F.floor(F.log2("n")) + 1
    dense = (F.pow(F.lit(2.0), F.col("depth")) - 1) * entry
    hybrid = (F.pow(F.lit(2.0), layers) - 1) * entry + F.col("n") * (F.col("depth") - layers) * (entry + F.col("n"))
    return t.select("tree", dense.cast("long").alias("dense"), hybrid.cast("long").alias("hybrid"), (F.col("leaves") * (2 * binary + 1)).alias("table"))


def best_trees(scored: DataFrame, n: int) -> DataFrame:
    """Trees of (tree, score) whose score is among the n best, ties and all."""
    return scored.withColumn("r", F.rank().over(Window.orderBy(F.desc("score")))).where(F.col("r") <= n).drop("r")


def prune_to_size(trees: DataFrame, max_bits: int, at_least: int = 2) -> DataFrame:
    """Best trees of (tree, score, bits) by score, until they pass max_bits, and at least two."""
    w = Window.orderBy(F.desc("score"), "tree")  # a row for each tree
    run = F.sum("bits").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bits")
    return trees.withColumn("before", run).withColumn("nth", F.row_number().over(w)).where((F.col("before") < max_bits) | (F.col("nth") <= at_least)).drop("before", "nth")


def meta_cost(probabilities: DataFrame, cost: tuple[tuple[float, float], tuple[float, float]]) -> DataFrame:
    """(flow_id, label): of (flow_id, model, proba), the class of least expected cost[predicted][true] by the mean."""
    p = probabilities.groupBy("flow_id").agg(F.avg("proba").alias("p1"))
    of = lambda c: cost[c][0] * (1 - F.col("p1")) + cost[c][1] * F.col("p1")
    return p.select("flow_id", "p1", F.when(of(1) < of(0), 1).otherwise(0).alias("label"))


def power_space(low: float, high: float, n: int, power: float) -> Column:
    """n points from low to high, denser about the middle: signed powers of evenly spaced ones, scaled. An array."""
    at = lambda i: -1.0 + 2.0 * i / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.signum(at(i)) * F.pow(F.abs(at(i)), F.lit(power)) * ((high - low) / 2) + (low + high) / 2)


def coupled_fpr(fnr: Column, heavy: float, predicted: float) -> Column:
    """The FPR at which a share `predicted` is predicted, given the FNR and the share of elephants."""
    return (predicted - heavy * (1 - fnr)) / (1 - heavy)


def coupled_fnr(fpr: Column, heavy: float, predicted: float) -> Column:
    return 1 - (predicted - fpr * (1 - heavy)) / heavy


def cascade_split(stage: DataFrame, later: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a stage with `matched`: whether they are in the later stage."""
    return stage.join(later.select(*on).distinct().withColumn("__in", F.lit(True)), on, "left").withColumn("matched", F.col("__in").isNotNull()).drop("__in")


def replay_buffer(buffer: DataFrame, new: DataFrame, policy: str, n: int) -> DataFrame:
    """The buffer (minute, flow_id, agreement, ...) after new rows: keep, add, add-fifo, update-fifo, update-agreement, discard."""
    if policy == "keep":
        return buffer
    if policy == "discard":
        return new
    both = buffer.unionByName(new)
    if policy == "add":
        return both
    order = {"add-fifo": [F.desc("minute"), "flow_id"], "update-fifo": [F.desc("minute"), "flow_id"], "update-agreement": ["agreement", F.desc("minute"), "flow_id"]}[policy]
    return both.orderBy(*order).limit(n)
