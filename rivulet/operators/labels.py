"""Cutoffs, labels, ranks and distributions of flow sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cutoff(sizes: DataFrame, p: float, by: list[str] | None = None) -> DataFrame:
    """The p-th percentile of size, interpolated, of all rows or for each group."""
    return sizes.groupBy(*(by or [])).agg(F.percentile(F.col("size"), F.lit(p / 100)).alias("cutoff"))


def label_elephants(sizes: DataFrame, p: float, by: list[str] | None = None, at_least: int = 0) -> DataFrame:
    """Adds cutoff and heavy (size above it, strictly). The cutoff is of all flows; flows below `at_least` then go.

    The cutoff is a row for all, or one for each group.
    """
    cut = cutoff(sizes, p, by)
    out = sizes.join(cut, by) if by else sizes.crossJoin(F.broadcast(cut))  # a single row
    return out.where(F.col("size") >= at_least).withColumn("heavy", (F.col("size") > F.col("cutoff")).cast("int"))


def floor_rank(rows: DataFrame, by: list[str], value: str, qs: list[float], out: str = "value") -> DataFrame:
    """(*by, q, out): the value at rank floor(q * (n - 1)) of the sorted values of each group.

    Equal values are counted first and ranks found by running sums, so no group is gathered into a row.
    """
    n = rows.groupBy(*by, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    run = F.sum("__n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    at = n.select(*by, value, run.alias("__run"), F.sum("__n").over(w).alias("__all"))
    ranked = at.groupBy(*by).agg(*(F.min(F.when(F.col("__run") > F.floor(F.lit(q) * (F.col("__all") - 1)), F.col(value))).alias(f"__{k}") for k, q in enumerate(qs)))
    found = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"__{k}").alias(out)) for k, q in enumerate(qs)))).alias("__x")
    return ranked.select(*by, found).select(*by, "__x.q", f"__x.{out}")


def size_cdf(sizes: DataFrame) -> DataFrame:
    """(size, n_flows, cdf): a row for each distinct size, far fewer than flows, so one window over all is enough."""
    n = sizes.groupBy("size").agg(F.count("*").alias("n_flows"))
    run = F.sum("n_flows").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    return n.select("size", "n_flows", (run / F.sum("n_flows").over(Window.partitionBy())).alias("cdf"))


def traffic_share(sizes: DataFrame) -> DataFrame:
    """(size, n_flows, share, cum_share) of the packets that flows of each size send."""
    n = sizes.groupBy("size").agg(F.count("*").alias("n_flows"))
    sent = n.withColumn("packets", F.col("size") * F.col("n_flows"))
    total = F.sum("packets").over(Window.partitionBy())
    run = F.sum("packets").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    return sent.select("size", "n_flows", (F.col("packets") / total).alias("share"), (run / total).alias("cum_share"))
