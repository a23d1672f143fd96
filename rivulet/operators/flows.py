"""Flow aggregations: sizes, times, gaps, and features of the first packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.keys import ACK, GRANULARITY, KEY, PSH, RST, SYN, flag_set


def ordered(packets: DataFrame) -> DataFrame:
    """Adds rn, the packet's number in its flow, and gap_us, the time since the packet before it."""
    w = Window.partitionBy(*KEY).orderBy("seq")
    return packets.withColumn("rn", F.row_number().over(w)).withColumn("gap_us", F.col("ts_us") - F.lag("ts_us").over(w))


def flow_size(packets: DataFrame, granularity: int = 5) -> DataFrame:
    return packets.groupBy(*GRANULARITY[granularity]).agg(F.count("*").alias("size"))


def time_bounds(packets: DataFrame) -> DataFrame:
    return packets.groupBy(*KEY).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("size"))


def gap_bounds(packets: DataFrame) -> DataFrame:
    """Least and largest gap in seconds; -1 for flows of one packet."""
    return ordered(packets).groupBy(*KEY).agg(F.coalesce(F.min("gap_us") / 1e6, F.lit(-1.0)).alias("min_iat"), F.coalesce(F.max("gap_us") / 1e6, F.lit(-1.0)).alias("max_iat"))


def _in_order(values: Column) -> Column:
    """Array of `values` by seq; nulls go."""
    return F.transform(F.array_sort(F.collect_list(F.struct("seq", values.alias("v")))), lambda x: x["v"])


def time_lists(packets: DataFrame) -> DataFrame:
    return packets.groupBy(*KEY).agg(_in_order(F.col("ts_us")).alias("times_us"))


def gap_lists(packets: DataFrame) -> DataFrame:
    """Gaps of flows of two packets or more, in order."""
    return ordered(packets).where("gap_us IS NOT NULL").groupBy(*KEY).agg(_in_order(F.col("gap_us")).alias("gaps_us"))


def oracle_row(packets: DataFrame, n: int) -> DataFrame:
    """The wide row of a flow: bounds, size, and of the first n packets gaps, flags (TCP alone) and sizes; the rest null."""
    p = ordered(packets)
    at = lambda k, c: F.max(F.when(F.col("rn") == k, c))
    flags = F.when(F.col("protocol") == 6, F.col("flags"))
    return p.groupBy(*KEY).agg(
        F.coalesce(F.min("gap_us") / 1e6, F.lit(-1.0)).alias("min_iat"),
        F.coalesce(F.max("gap_us") / 1e6, F.lit(-1.0)).alias("max_iat"),
        (F.min("ts_us") / 1e6).alias("first_ts"),
        (F.max("ts_us") / 1e6).alias("last_ts"),
        F.count("*").alias("flow_size"),
        *(at(k + 1, F.col("gap_us") / 1e6).alias(f"iat_{k}") for k in range(1, n)),
        *(at(k, flags).alias(f"flags_{k}") for k in range(1, n + 1)),
        *(at(k, F.col("size")).alias(f"pk_size_{k}") for k in range(1, n + 1)),
    )


def first_k_features(packets: DataFrame, k: int) -> DataFrame:
    """Mean and population deviation of sizes and gaps over the first k packets of flows that have as many."""
    p = ordered(packets).where(F.col("rn") <= k)
    gap = F.col("gap_us") / 1e6
    return (
        p.groupBy(*KEY)
        .agg(
            F.count("*").alias("n"),
            F.avg("size").alias("mean_size"),
            F.stddev_pop("size").alias("std_size"),
            F.coalesce(F.avg(gap), F.lit(0.0)).alias("mean_iat"),
            F.coalesce(F.stddev_pop(gap), F.lit(0.0)).alias("std_iat"),
            F.max(F.when(F.col("rn") == k, F.col("seq"))).alias("seq_k"),
            F.max(F.when(F.col("rn") == k, F.col("ts_us"))).alias("ts_k_us"),
        )
        .where(F.col("n") == k)
        .drop("n")
    )


def _five(x: Column, name: str) -> list[Column]:
    return [
        F.min(x).alias(f"{name}_min"),
        F.max(x).alias(f"{name}_max"),
        F.coalesce(F.sum(x), F.lit(0)).alias(f"{name}_sum"),
        F.avg(x).alias(f"{name}_mean"),
        F.stddev_pop(x).alias(f"{name}_std"),
    ]


def sequence_features(packets: DataFrame, low: int, high: int) -> DataFrame:
    """For each m in [low, high): five aggregates of the first m sizes and of the first m - 1 gaps, in one pass."""
    p = ordered(packets).where(F.col("rn") < high)
    gap = F.col("gap_us") / 1e6
    out = []
    for m in range(low, high):
        seen = F.col("rn") <= m
        out += _five(F.when(seen, F.col("size")), f"pk_size_{m}") + _five(F.when(seen, gap), f"iat_{m}")
    return p.groupBy(*KEY).agg(*out)


def aggregate_matrix(packets: DataFrame, low: int, high: int) -> DataFrame:
    """For each m in [low, high): counts of flags among the first m - 1 packets, five aggregates of the first m sizes and
    of the first m - 1 gaps, in one pass over the packets."""
    p = ordered(packets).where(F.col("rn") < high)
    f, gap, tcp = F.col("flags"), F.col("gap_us") / 1e6, F.col("protocol") == 6
    synack, pshrst = flag_set(f, SYN) * flag_set(f, ACK), F.greatest(flag_set(f, PSH), flag_set(f, RST))
    out = []
    for m in range(low, high):
        seen = F.col("rn") <= m
        out += [F.coalesce(F.sum(F.when((F.col("rn") < m) & tcp, x)), F.lit(-1)).alias(f"{name}_{m}") for x, name in ((synack, "count_synack"), (pshrst, "count_pshecerst"))]
        out += _five(F.when(seen, F.col("size")), f"pk_size_{m}") + _five(F.when(seen, gap), f"iat_{m}")
    return p.groupBy(*KEY).agg(*out)


def flag_counts(packets: DataFrame, m: int) -> DataFrame:
    """Packets with SYN and ACK, and those with PSH or ECE or RST, among the first m - 1; -1 for other protocols.

    ECE is never decoded, so it adds nothing.
    """
    f = F.col("flags")
    synack, pshrst = flag_set(f, SYN) * flag_set(f, ACK), F.greatest(flag_set(f, PSH), flag_set(f, RST))
    p = ordered(packets).where(F.col("rn") < m)
    tcp = F.col("protocol") == 6
    return p.groupBy(*KEY).agg(F.sum(synack).alias("a"), F.sum(pshrst).alias("b")).select(*KEY, F.when(tcp, F.col("a")).otherwise(-1).alias("count_synack"), F.when(tcp, F.col("b")).otherwise(-1).alias("count_pshecerst"))


def cache_span(packets: DataFrame, k: int = 5) -> DataFrame:
    """Time of the first packet and of the k-th, or the last where there are fewer."""
    return ordered(packets).where(F.col("rn") <= k).groupBy(*KEY).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("kth_us"))


def max_gap(packets: DataFrame) -> DataFrame:
    return ordered(packets).agg(F.coalesce(F.greatest(F.max("gap_us") / 1e6, F.lit(0.0)), F.lit(0.0)).alias("max_iat"))


def open_flow_steps(packets: DataFrame, k: int = 5) -> DataFrame:
    """(seq, ts_us, step): a flow opens with its first packet unless that ends it, and closes at its k-th packet and
    with each earlier packet but the first that has FIN or RST."""
    first, end = F.col("rn") == 1, F.col("has_fin_rst")
    step = F.when(first & ~end, 1).when((F.col("rn") == k) | ((F.col("rn") < k) & ~first & end), -1).otherwise(0)
    return ordered(packets).where(F.col("rn") <= k).select("seq", "ts_us", step.alias("step"))


#: Packets of a stretch whose running sums are taken in one task.
STRETCH = 65_536


def max_concurrent(packets: DataFrame, k: int = 5, stretch: int = STRETCH) -> DataFrame:
    """The most flows open at a time: running sums within stretches of packet numbers, then over the stretches."""
    steps = open_flow_steps(packets, k).withColumn("part", F.floor(F.col("seq") / stretch))
    inside = F.sum("step").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    parts = steps.withColumn("run", inside).groupBy("part").agg(F.max("run").alias("peak"), F.sum("step").alias("total"))
    # A row for each stretch, 1 / STRETCH of the packets.
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select((F.col("peak") + before).alias("open")).agg(F.greatest(F.max("open"), F.lit(0)).alias("max_open"))

