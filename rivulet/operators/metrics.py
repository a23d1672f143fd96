"""Estimates against truth, and classifier quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.keys import uniform


def resolve(truth: DataFrame, table: DataFrame, cms: DataFrame, manager: DataFrame, discarded: DataFrame, k: int, drop_both: bool = False, drop_missing: bool = False) -> DataFrame:
    """(flow_id, v, estimate, sector): discarded flows count as exact; else the table and the sketch, if it is there too;
    else the sketch and what the manager holds below k; else the manager; else 0. Inputs are (flow_id, size). With
    drop_both flows that are in the table and in the sketch go, with drop_missing those that are nowhere."""
    j = truth.select("flow_id", F.col("size").alias("v"))
    for name, df in (("ht", table), ("cms", cms), ("fm", manager), ("out", discarded)):
        j = j.join(df.select("flow_id", F.col("size").alias(name)), "flow_id", "left")
    fm = F.when(F.col("fm") < k, F.col("fm")).otherwise(0)
    est = (
        F.when(F.col("out").isNotNull(), F.col("v"))
        .when(F.col("ht").isNotNull(), F.col("ht") + F.coalesce("cms", F.lit(0)))
        .when(F.col("cms").isNotNull(), F.col("cms") + F.coalesce(fm, F.lit(0)))
        .otherwise(F.coalesce("fm", F.lit(0)))
    )
    sector = F.when(F.col("out").isNotNull(), "discarded").when(F.col("ht").isNotNull(), "ht").when(F.col("cms").isNotNull(), "cms").when(F.col("fm").isNotNull(), "fm").otherwise("none")
    if drop_both:
        j = j.where("out IS NOT NULL OR ht IS NULL OR cms IS NULL")
    if drop_missing:
        j = j.where("coalesce(out, ht, cms, fm) IS NOT NULL")
    return j.select("flow_id", "v", est.cast("long").alias("estimate"), sector.alias("sector"))


def resolve_gaps(truth: DataFrame, heavy: DataFrame, mice: DataFrame, resident: DataFrame, drop_resident: bool = False) -> DataFrame:
    """(flow_id, q, v, estimate, sector) of truth (flow_id, q, v): by the larger sketch, else the smaller one; resident
    flows (flow_id) count as exact, or go. A flow that is in none of them is an error."""
    j = truth.select("flow_id", "q", "v")
    for name, df in (("heavy", heavy), ("mice", mice)):
        j = j.join(df.select("flow_id", "q", F.col("value").alias(name)), ["flow_id", "q"], "left")
    j = j.join(resident.select("flow_id", F.lit(True).alias("here")), "flow_id", "left")
    sector = F.when(F.col("heavy").isNotNull(), "heavy").when(F.col("mice").isNotNull(), "mice").when(F.col("here"), "manager")
    sure = F.when(sector.isNull(), F.raise_error(F.concat(F.lit("no estimate of flow "), F.col("flow_id")))).otherwise(sector)
    out = j.select("flow_id", "q", "v", F.coalesce("heavy", "mice", F.when(F.col("here"), F.col("v"))).alias("estimate"), sure.alias("sector"))
    return out.where("sector <> 'manager'") if drop_resident else out


def _off() -> Column:
    return F.abs(F.col("v") - F.col("estimate"))


def errors(resolved: DataFrame) -> DataFrame:
    """awae: errors weighted by size; aae, are: mean absolute and relative error."""
    n = F.count("*")
    return resolved.agg((F.sum(F.col("v") * _off()) / F.sum("v")).alias("awae"), (F.sum(_off()) / n).alias("aae"), (F.sum(_off() / F.col("v")) / n).alias("are"))


def errors_by_sector(resolved: DataFrame) -> DataFrame:
    total = F.sum(F.sum("v")).over(Window.partitionBy())
    return resolved.groupBy("sector").agg(F.count("*").alias("flows"), (F.sum(F.col("v") * _off()) / total).alias("share_of_awae"))


def mean_relative_error(pairs: DataFrame) -> DataFrame:
    """(q, n_inf, mre) of (q, v, estimate): |v - e| / v; where v is 0 it is 0 or, if e isn't, infinite. The infinite
    ones are counted beside the mean of the others."""
    e = F.when(F.col("v") == 0, F.when(F.col("estimate") == 0, 0.0)).otherwise(_off() / F.col("v"))
    return pairs.withColumn("e", e).groupBy("q").agg(F.sum(F.col("e").isNull().cast("long")).alias("n_inf"), F.avg("e").alias("mre"))


def misplaced(table: DataFrame, cms: DataFrame) -> DataFrame:
    """Flows of the table that are in the sketch too."""
    return table.join(cms.select("flow_id"), "flow_id", "left_semi").agg(F.count("*").alias("n"))


def confusion(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    y, p = F.col("heavy") == 1, F.col("predicted") == 1
    n = lambda c: F.count(F.when(c, 1))
    return predictions.groupBy(*(by or [])).agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(~y & ~p).alias("tn"), n(y & ~p).alias("fn"))


def rates(matrix: DataFrame) -> DataFrame:
    """tpr, tnr, fpr, fnr of each row of a confusion table; null where a class is missing."""
    over = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return matrix.select("*", over("tp", "fn").alias("tpr"), over("tn", "fp").alias("tnr"), over("fp", "tn").alias("fpr"), over("fn", "tp").alias("fnr"))


def mean_rates(matrix: DataFrame) -> DataFrame:
    """The rates of each row of a confusion table, such as one for each minute, as plain means."""
    return rates(matrix).agg(*(F.avg(c).alias(c) for c in ("tpr", "tnr", "fpr", "fnr")))


def rounded_map(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Adds `value` of the table's row whose key is the same at three places; values are rounded to as many. Of rows
    with the same rounded key the last one by key counts."""
    t = table.groupBy(F.round(key, 3).alias("__key")).agg(F.round(F.max_by(value, key), 3).alias(value))
    return rows.withColumn("__key", F.round(key, 3)).join(t, "__key", "left").drop("__key")


def precision_recall_f1(matrix: DataFrame) -> DataFrame:
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return matrix.select(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def pr_curve(scores: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at each distinct score of (proba, heavy); scores are rounded, so they are few."""
    per = scores.groupBy("proba").agg(F.sum("heavy").alias("pos"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("proba")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy()
    c = per.select("proba", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("k"), F.sum("pos").over(all_).alias("p"))
    return c.select(F.col("proba").alias("threshold"), (F.col("tp") / F.col("k")).alias("precision"), F.try_divide(F.col("tp"), F.col("p")).alias("recall"))


def average_precision(scores: DataFrame) -> DataFrame:
    """Sum of precision times the step of recall, over thresholds from high to low."""
    w = Window.orderBy(F.desc("threshold"))
    step = F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0))
    return pr_curve(scores).withColumn("s", step).agg(F.sum(F.col("s") * F.col("precision")).alias("ap"))


def slowdown(flows: DataFrame, p: float = 99) -> DataFrame:
    """Mean of `slowdown` of all flows, of elephants (size at or above the percentile) and of mice; 0 without any."""
    cut = flows.agg(F.percentile("size", F.lit(p / 100)).alias("cut"))
    f = flows.crossJoin(F.broadcast(cut))  # a single row
    big = F.col("size") >= F.col("cut")
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("slowdown"))), F.lit(0.0))
    return f.agg(mean(F.lit(True)).alias("overall"), mean(big).alias("elephants"), mean(~big).alias("mice"))


def priority(flows: DataFrame, threshold: Column, k: int) -> DataFrame:
    """0 below k packets, else 1 for mice and 2 for elephants, which are those at or above the threshold."""
    return flows.withColumn("priority", F.when(F.col("size") < k, 0).when(F.col("size") >= threshold, 2).otherwise(1))


def size_threshold(flows: DataFrame, q: float, k: int) -> DataFrame:
    """(threshold): the floor-rank quantile of the sizes of flows with k packets or more, from counts of each size."""
    h = flows.where(F.col("size") >= k).groupBy("size").agg(F.count("*").alias("n"))
    run = h.select("size", F.sum("n").over(Window.orderBy("size")).alias("run"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return run.where(F.col("run") >= F.floor(F.lit(q) * (F.col("total") - 1)) + 1).agg(F.min("size").alias("threshold"))


def predicted_priority(flows: DataFrame, threshold: Column, k: int, heavy_tpr: float, mice_tpr: float) -> DataFrame:
    """Priorities of an oracle that errs: an elephant turns mouse where the flow's draw is above heavy_tpr, and then what
    is a mouse turns elephant where the same draw is above mice_tpr."""
    u = uniform("flow_id", "priority")
    first = F.when((F.col("priority") == 2) & (u > heavy_tpr), 1).otherwise(F.col("priority"))
    both = F.when((F.col("turned") == 1) & (u > mice_tpr), 2).otherwise(F.col("turned"))
    return priority(flows, threshold, k).withColumn("turned", first).withColumn("priority", both).drop("turned")


def mean_slowdowns(results: DataFrame) -> DataFrame:
    """(load, overall, elephants, mice) of a row for each load and iteration: means over the iterations."""
    return results.groupBy("load").agg(*(F.avg(c).alias(c) for c in ("overall", "elephants", "mice")))
