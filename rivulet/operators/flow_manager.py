"""Flow managers: where the first packets of flows wait until there are k of them.

Unbounded, it is a window. Bounded, order matters: a bucket of the table is a small state machine, and buckets are
independent, so each is replayed by itself. Only the first k packets of a flow can matter to a manager, so the others
go before the shuffle by bucket; buckets are then read in order, a batch at a time.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.keys import bucket, flow_id
from rivulet.operators.flows import ordered

OUTCOME = "flow_id string, outcome string, seq long, ts_us long, n_pkts int"


def keyed(packets: DataFrame) -> DataFrame:
    return packets.withColumn("flow_id", flow_id())


def infinite(packets: DataFrame, k: int) -> DataFrame:
    """Flows of k packets or more are collected at the k-th, others stay resident to the end."""
    p = ordered(packets).where(F.col("rn") <= k).withColumn("flow_id", flow_id())
    last = p.groupBy("flow_id").agg(F.max("rn").alias("n_pkts"), F.max("seq").alias("seq"), F.max_by("ts_us", "seq").alias("ts_us"))
    return last.select("flow_id", F.when(F.col("n_pkts") == k, "collected").otherwise("resident").alias("outcome"), "seq", "ts_us", "n_pkts")


def passed_on(packets: DataFrame, k: int) -> DataFrame:
    """Packets after the k-th of their flow: they don't enter the manager."""
    return ordered(packets).where(F.col("rn") > k)


def fifo_bucket(rows: Iterator[tuple], slots: int, k: int, remove_at_k: bool = True) -> Iterator[tuple]:
    """One bucket: (flow_id, seq, ts_us) in order to rows of OUTCOME.

    A flow enters once. When there are more than `slots`, the one that came first leaves, however recent its packets:
    the age that decides is read from the packet that comes in, so it is the same for all. With remove_at_k off,
    collected flows stay and hold their slot until they leave without notice.
    """
    held: OrderedDict[str, list] = OrderedDict()
    seen: set[str] = set()
    for f, seq, ts in rows:
        if f in held:
            e = held[f]
            e[0], e[1], e[2] = e[0] + 1, seq, ts
            if e[0] == k:
                yield f, "collected", seq, ts, k
                if remove_at_k:
                    del held[f]
        elif f not in seen:
            seen.add(f)
            held[f] = [1, seq, ts]
            if k == 1:
                yield f, "collected", seq, ts, 1
                if remove_at_k:
                    del held[f]
            if len(held) > slots:
                old, e = held.popitem(last=False)
                if e[0] < k:
                    yield old, "evicted", seq, ts, e[0]
    for f, e in held.items():
        if e[0] < k:
            yield f, "resident", e[1], e[2], e[0]


def _replayed(p: DataFrame, rows: int, slots: int, k: int) -> DataFrame:
    """Rows of OUTCOME from (flow_id, seq, ts_us): the first k packets of each flow, through its bucket."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("flow_id").orderBy("seq"))
    first = p.select("flow_id", "seq", "ts_us", nth.alias("rn")).where(F.col("rn") <= k)
    dealt = first.select(bucket("flow_id", rows, "fm").alias("bucket"), "flow_id", "seq", "ts_us").repartition("bucket").sortWithinPartitions("bucket", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrivals = chain.from_iterable(pdf[["bucket", "flow_id", "seq", "ts_us"]].itertuples(index=False, name=None) for pdf in batches)
        out = chain.from_iterable(fifo_bucket((r[1:] for r in some), slots, k) for _, some in groupby(arrivals, key=itemgetter(0)))
        while part := list(islice(out, 10_000)):
            yield pd.DataFrame(part, columns=["flow_id", "outcome", "seq", "ts_us", "n_pkts"])

    return dealt.mapInPandas(run, OUTCOME)


def _by_rank(p: DataFrame, rows: int, slots: int, k: int) -> DataFrame:
    """Rows of OUTCOME where collected flows keep their slots: then a flow leaves as the `slots`-th flow after it in its
    bucket comes, whatever happens in between, so that ranks of arrival decide and nothing is replayed."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("flow_id").orderBy("seq"))
    first = p.select("flow_id", "seq", "ts_us", nth.alias("rn")).where(F.col("rn") <= k)
    flow = first.groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ts_us"))).alias("at")).withColumn("bucket", bucket("flow_id", rows, "fm"))
    out = F.lead(F.element_at("at", 1), slots).over(Window.partitionBy("bucket").orderBy(F.element_at("at", 1)["seq"]))
    e = flow.withColumn("out", out).withColumn("n", F.when(F.col("out").isNull(), F.size("at")).otherwise(F.size(F.filter("at", lambda x: x["seq"] < F.col("out.seq")))))
    got, last = F.col("n") == k, F.element_at("at", -1)
    outcome = F.when(got, "collected").when(F.col("out").isNull(), "resident").otherwise("evicted")
    end = F.when(got | F.col("out").isNull(), last).otherwise(F.col("out"))
    return e.select("flow_id", outcome.alias("outcome"), end["seq"].alias("seq"), end["ts_us"].alias("ts_us"), F.col("n").alias("n_pkts"))


def evict_oldest(packets: DataFrame, rows: int, slots: int, k: int, remove_at_k: bool = True) -> DataFrame:
    """Rows of OUTCOME, one for each flow; with remove_at_k off flows that were collected have just that row."""
    p = keyed(packets)
    return _replayed(p, rows, slots, k) if remove_at_k else _by_rank(p, rows, slots, k)


def evict_timeout(packets: DataFrame, rows: int, slots: int, k: int, timeout_us: int | None = None) -> DataFrame:
    """As evict_oldest without removal at k. A timeout, where given, first ends flows by gaps longer than it: what
    comes later is as a new flow (`flow_id` then has `+n` at its end)."""
    if timeout_us is None:
        return evict_oldest(packets, rows, slots, k, remove_at_k=False)
    from pyspark.sql import Window

    p = ordered(packets).withColumn("flow_id", flow_id())
    late = (F.col("gap_us") > timeout_us).cast("int")
    turn = F.sum(F.coalesce(late, F.lit(0))).over(Window.partitionBy("flow_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("turn", turn).withColumn("flow_id", F.when(F.col("turn") > 0, F.concat("flow_id", F.lit("+"), F.col("turn"))).otherwise(F.col("flow_id")))
    return _by_rank(p, rows, slots, k)


def layer_rows(proportions: list[float], total: int, k: int) -> list[int]:
    """Rows of each of k - 1 layers: the first k - 1 proportions, scaled to a sum of 1, of the total."""
    p = proportions[: k - 1]
    return [int(total * x / sum(p)) for x in p]


def layer_bucket(rows: Iterator[tuple], slots: int) -> Iterator[tuple]:
    """One bucket of a layer: (flow_id, nth, seq, ts_us) of arrivals (nth = i) and departures (nth = i + 1), in order.

    A full bucket evicts the flow that came least recently; of equal times the one that came first.
    """
    held: OrderedDict[str, tuple] = OrderedDict()
    for f, arrives, seq, ts in rows:
        if arrives:
            if len(held) >= slots:
                old = min(held, key=lambda x: held[x][1])
                del held[old]
                yield old, "evicted", seq, ts
            held[f] = (seq, ts)
        elif f in held:
            del held[f]
            yield f, "moved", seq, ts
    for f, (seq, ts) in held.items():
        yield f, "resident", seq, ts


def _layer(i: int, k: int, slots: int):
    """The i-th layer, a bucket at a time: rows with an outcome pass, `next` rows are the flows' next packets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf["outcome"].notna() & (pdf["outcome"] != "next")
        here = pdf[~left].sort_values("seq")
        got = layer_bucket(zip(here["flow_id"], here["outcome"].isna(), here["seq"], here["ts_us"], strict=True), slots)
        ended = pd.DataFrame(list(got), columns=["flow_id", "outcome", "seq", "ts_us"])
        moved = ended["outcome"] == "moved"
        ended["n_pkts"] = i + moved.astype(int)
        ended["outcome"] = ended["outcome"].where(~moved, "collected" if i == k - 1 else None)
        return pd.concat([pdf.loc[left, list(ended.columns)], ended], ignore_index=True)

    return run


def hierarchical(packets: DataFrame, layers: list[int], slots: int, k: int) -> DataFrame:
    """k - 1 layers, the i-th for flows with i packets; a flow's next packet moves it on, at the k-th it is collected.

    A layer never looks at later ones, so they are stages, each with its own shuffle by bucket. Flows that have left
    go through later stages as they are, so that no stage is read twice.
    """
    p = ordered(packets).where(F.col("rn") <= k).withColumn("flow_id", flow_id()).select("flow_id", "rn", "seq", "ts_us")
    flows = p.where("rn = 1").select("flow_id", "seq", "ts_us", F.lit(None).cast("string").alias("outcome"), F.lit(1).alias("n_pkts"))
    for i in range(1, k):
        nexts = p.where(F.col("rn") == i + 1).select("flow_id", "seq", "ts_us", F.lit("next").alias("outcome"), F.lit(0).alias("n_pkts"))
        at = flows.unionByName(nexts).withColumn("bucket", bucket("flow_id", max(1, layers[i - 1]), f"layer{i}"))

        flows = at.groupBy("bucket").applyInPandas(_layer(i, k, slots), "flow_id string, outcome string, seq long, ts_us long, n_pkts int")
    return flows


def new_flows_until(packets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(flow_id, new_flows) of flows that left a manager: how many flows began between their first packet and their exit.

    C counts the flows that have begun before a packet, and the number is C at the exit less C after the entry; the flow
    that drives another one out isn't counted. C is a running count: within stretches of packet numbers first, then
    over the stretches. Every manager admits a flow at its first packet, so one function does for all.
    """
    from pyspark.sql import Window

    from rivulet.operators.flows import STRETCH

    starts = packets.groupBy(flow_id().alias("flow_id")).agg(F.min("seq").alias("seq")).withColumn("begins", F.lit(1))
    exits = outcomes.where("outcome <> 'resident'").select("flow_id", "seq", F.lit(0).alias("begins"))
    p = starts.unionByName(exits).withColumn("part", F.floor(F.col("seq") / STRETCH))
    # Exits come before the start at the same packet, which is the start of the flow that drove them out.
    inside = F.sum("begins").over(Window.partitionBy("part").orderBy("seq", "begins").rowsBetween(Window.unboundedPreceding, 0))
    sums = p.groupBy("part").agg(F.sum("begins").alias("n"))
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    at = p.withColumn("inside", inside).join(base, "part").withColumn("c", F.col("inside") + F.col("base"))
    at_exit, at_start = (F.max(F.when(F.col("begins") == b, F.col("c"))) for b in (0, 1))
    ends = at.groupBy("flow_id").agg(F.count("*").alias("n"), F.greatest(at_exit - at_start, F.lit(0)).alias("new_flows"))
    return ends.where("n = 2").select("flow_id", "new_flows")


def new_flows_while_cached(packets: DataFrame, k: int) -> DataFrame:
    """(flow_id, new_flows): of the flows that the unbounded manager collects, how many flows began while they waited."""
    return new_flows_until(packets, infinite(packets, k))
