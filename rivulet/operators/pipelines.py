"""End-to-end estimates: flow sizes through table, sketch and manager, and gap quantiles through quantile sketches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.keys import flow_id
from rivulet.operators import labels, sketches
from rivulet.operators.flows import ordered


@dataclass(frozen=True)
class FseConfig:
    """Structure sizes of the flow-size estimation."""

    k: int = 5
    cms_rows: int = 2
    cms_cols: int = 64
    tables: int = 2
    table_rows: int = 4
    slots: int = 2


def sizes(packets: DataFrame) -> DataFrame:
    return packets.groupBy(flow_id().alias("flow_id")).agg(F.count("*").alias("size"))


@dataclass(frozen=True)
class Estimate:
    table: DataFrame
    cms: DataFrame
    manager: DataFrame
    discarded: DataFrame
    cells: DataFrame


def estimate_sizes(truth: DataFrame, outcomes: DataFrame, predicted: DataFrame, config: FseConfig) -> Estimate:
    """The relations of the size pipeline, by sets.

    A flow reaches the table only after its k-th packet and never returns to the manager, so the manager runs alone;
    table slots are never freed, so admission is by rank of arrival; and each packet is counted just once: of a flow
    in the table by the table, of one resident in the manager there, of any other in the sketch.
    """
    collected = outcomes.where("outcome = 'collected'").join(predicted.select("flow_id", "predicted"), "flow_id")
    placed = sketches.admit(collected.where("predicted = 1"), config.tables, config.table_rows, config.slots)
    inside = placed.where("table_idx IS NOT NULL")
    resident = outcomes.where("outcome = 'resident'").select("flow_id", F.col("n_pkts").cast("long").alias("size"))
    table = truth.join(inside.select("flow_id"), "flow_id", "left_semi")
    counted = truth.join(inside.select("flow_id"), "flow_id", "left_anti").join(resident.select("flow_id"), "flow_id", "left_anti")
    cells = sketches.cms_cells(counted, config.cms_rows, config.cms_cols)
    cms = sketches.cms_estimates(counted, cells, config.cms_rows, config.cms_cols).withColumnRenamed("estimate", "size")
    # Discarded flows are counted by the sketch as well; the list of them is what the control plane is told.
    discarded = placed.where("table_idx IS NULL").select("flow_id").join(truth, "flow_id")
    return Estimate(table, cms, resident, discarded, cells)


def gaps(packets: DataFrame) -> DataFrame:
    """(flow_id, seq, x): gaps in seconds."""
    return ordered(packets).where("gap_us IS NOT NULL").select(flow_id().alias("flow_id"), "seq", (F.col("gap_us") / 1e6).alias("x"))


def exact_quantiles(values: DataFrame, flows: DataFrame, qs: list[float]) -> DataFrame:
    """(flow_id, q, value): floor-rank quantiles of each flow's gaps; 0 for flows without any."""
    every = flows.select("flow_id", F.explode(F.array(*(F.lit(q) for q in qs))).alias("q"))
    return every.join(labels.floor_rank(values, ["flow_id"], "x", qs), ["flow_id", "q"], "left").select("flow_id", "q", F.coalesce("value", F.lit(0.0)).alias("value"))


def admitted_elephants(collected: DataFrame, max_heavy: int) -> DataFrame:
    """Adds heavy_sketch: the first max_heavy + 1 predicted elephants get the larger sketches, as the room is looked at
    before each enters."""
    first = collected.where("predicted = 1").orderBy("seq").limit(max_heavy + 1).select("flow_id", F.lit(True).alias("__in"))
    return collected.join(first, "flow_id", "left").withColumn("heavy_sketch", F.coalesce("__in", F.lit(False))).drop("__in")


def gap_estimates(packets: DataFrame, outcomes: DataFrame, predicted: DataFrame, max_heavy: int, heavy: sketches.LogBins, mice: sketches.LogBins, qs: list[float]) -> DataFrame:
    """(flow_id, q, value, sector): by the sketch of a flow's class, or exact while it is resident in the manager."""
    g = gaps(packets)
    collected = outcomes.where("outcome = 'collected'").join(predicted.select("flow_id", "predicted"), "flow_id")
    placed = admitted_elephants(collected, max_heavy)
    big = placed.where("heavy_sketch").select("flow_id")
    resident = outcomes.where("outcome = 'resident'").select("flow_id")
    small = outcomes.select("flow_id").join(big, "flow_id", "left_anti").join(resident, "flow_id", "left_anti")
    parts = []
    for flows, bins, bits, name in ((big, heavy, 16, "heavy"), (small, mice, 8, "mice")):
        cells = sketches.quantile_bins(g.join(flows, "flow_id", "left_semi"), bins, bits)
        est = sketches.quantiles(cells, bins, qs)
        every = flows.select("flow_id", F.explode(F.array(*(F.lit(q) for q in qs))).alias("q"))
        parts.append(every.join(est, ["flow_id", "q"], "left").select("flow_id", "q", F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(name).alias("sector")))
    parts.append(exact_quantiles(g.join(resident, "flow_id", "left_semi"), resident, qs).withColumn("sector", F.lit("manager")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def routes(packets: DataFrame, outcomes: DataFrame, predicted: DataFrame, max_heavy: int) -> DataFrame:
    """(seq, flow_id, route): where each packet goes as it comes. A flow's packets go to the manager up to that with
    which it leaves it, and then to the larger or the smaller sketch, by the decision; evicted flows to the smaller."""
    left = outcomes.where("outcome <> 'resident'").select("flow_id", F.col("seq").alias("decided"), "outcome")
    collected = outcomes.where("outcome = 'collected'").join(predicted.select("flow_id", "predicted"), "flow_id")
    big = admitted_elephants(collected, max_heavy).where("heavy_sketch").select("flow_id", F.lit("heavy").alias("sketch"))
    decisions = left.join(big, "flow_id", "left").select("flow_id", "decided", F.coalesce("sketch", F.lit("mice")).alias("sketch"))
    p = packets.select("seq", flow_id().alias("flow_id")).join(decisions, "flow_id", "left")
    return p.select("seq", "flow_id", F.when(F.col("seq") > F.col("decided"), F.col("sketch")).otherwise("manager").alias("route"))
