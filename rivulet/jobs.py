"""Jobs from capture files to result relations: `python -m rivulet.jobs features|sizes|records CAPTURES OUT [n]`."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions.keys import KEY, flow_id, ip_text
from rivulet.operators import flow_manager, flows, labels, pipelines, sketches
from rivulet.sources.packets import captures, key_records
from rivulet.sources.relations import write_relations

#: Protocols that have results of their own, by number.
PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1}


def _key_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: ip_text(c) for c in ("src_ip", "dst_ip")})


def feature_relations(packets: DataFrame, n: int) -> dict[str, DataFrame]:
    """For each protocol its flows' timestamps, gaps and wide rows of the first n packets, named `oracle_tcp` and so on."""
    out = {}
    for name, number in PROTOCOLS.items():
        p = packets.where(F.col("protocol") == number)
        lists = {"timestamps": (flows.time_lists(p), "times_us"), "interarrival": (flows.gap_lists(p), "gaps_us")}
        for kind, (df, column) in lists.items():
            text = F.array_join(F.transform(column, lambda x: F.format_string("%.6f", x / 1e6)), ",")
            out[f"{kind}_{name}"] = _key_text(df.select(*KEY, text.alias(column)))
        out[f"oracle_{name}"] = _key_text(flows.oracle_row(p, n))
    return out


def size_relations(packets: DataFrame, outcomes: DataFrame, predicted: DataFrame, config: pipelines.FseConfig, settings: dict[str, object] | None = None) -> dict[str, DataFrame]:
    """The relations that a run of the size pipeline leaves: truth, cache spans, table, discarded flows, sketch estimates,
    what the manager holds, evicted and collected flows, what the control plane is told, predictions and settings.

    `outcomes` are the manager's, `predicted` is (flow_id, predicted) and may have proba. Times are in microseconds.
    """
    truth = pipelines.sizes(packets)
    e = pipelines.estimate_sizes(truth, outcomes, predicted, config)
    waits = flow_manager.new_flows_until(packets, outcomes)
    left = outcomes.where("outcome <> 'resident'").join(waits, "flow_id").select("ts_us", "flow_id", "new_flows", "n_pkts", "outcome")
    collected = outcomes.where("outcome = 'collected'").select("flow_id", "seq", "ts_us")
    told = sketches.admit(collected.join(predicted.where("predicted = 1"), "flow_id", "left_semi"), config.tables, config.table_rows, config.slots)
    proba = F.col("proba") if "proba" in predicted.columns else F.col("predicted").cast("double")
    spark = packets.sparkSession
    lines = [f"{k}: {v}" for k, v in {**vars(config), **(settings or {})}.items()]
    return {
        "gt": truth,
        "cache_spans": flows.cache_span(packets, config.k).select(flow_id().alias("flow_id"), "first_us", "kth_us"),
        "ht": e.table,
        "ht_discarded": e.discarded.select("flow_id"),
        "cms": e.cms,
        "fm": e.manager,
        "fm_evicted": left.where("outcome = 'evicted'").drop("outcome"),
        "fm_collected": left.where("outcome = 'collected'").drop("outcome"),
        "control_plane": told.where("table_idx IS NULL").join(collected.drop("seq"), "flow_id").select("ts_us", "flow_id"),
        "model_predictions": collected.join(predicted, "flow_id").select("flow_id", "ts_us", proba.alias("proba")),
        "simulation_configuration": spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "line int, text string"),
    }


def write_key_records(packets: DataFrame, path: str) -> DataFrame:
    """Key records as Parquet, and (n_packets, n_flows) of them. Each task writes its own file, in order of packets; a file
    holds a column of 13-byte records, from which `records_of` gives the bytes."""
    key_records(packets).repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(path)
    return packets.sparkSession.read.parquet(path).agg(F.count("*").alias("n_packets"), F.countDistinct("record").alias("n_flows"))


def records_of(spark: SparkSession, path: str, stretch: int = 65_536) -> DataFrame:
    """(part, data): the records of each stretch of packets, one after the other; parts in order make the whole file."""
    r = spark.read.parquet(path).withColumn("nth", F.col("seq") % stretch).withColumn("part", F.floor(F.col("seq") / stretch))
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "record"))), lambda x: F.hex(x["record"])), ""))
    return r.groupBy("part").agg(joined.alias("data")).orderBy("part")


def consecutive(packets: DataFrame) -> DataFrame:
    """Packets with seq 0, 1, 2, ... in the same order: places within files, after the packets of the files before."""
    n = packets.groupBy("file").agg(F.count("*").alias("__n"), F.min("seq").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = n.select("file", "__first", before.alias("__before"))  # a row for each file
    return packets.join(base, "file").withColumn("seq", F.col("seq") - F.col("__first") + F.col("__before")).drop("__first", "__before")


def run(spark: SparkSession, job: str, path: str, out: str, n: int = 25, p: float = 99) -> None:
    """features: wide rows and lists for each protocol; sizes: the size pipeline with labels of the p-th percentile for
    predictions; records: key records. Results are CSV, but for records."""
    packets = consecutive(captures(spark, path, keep_icmp=job == "features"))
    if job == "features":
        write_relations(feature_relations(packets, n), out, "csv")
    elif job == "sizes":
        config = pipelines.FseConfig()
        truth = labels.label_elephants(pipelines.sizes(packets), p).select("flow_id", F.col("heavy").alias("predicted"))
        write_relations(size_relations(packets, flow_manager.evict_oldest(packets, 1024, 8, config.k), truth, config, {"captures": path}), out, "csv")
    elif job == "records":
        write_key_records(packets, out).show()
    else:
        raise ValueError(f"unknown job: {job}")


if __name__ == "__main__":
    if len(sys.argv) < 4:
        sys.exit(__doc__)
    run(SparkSession.builder.appName("rivulet").getOrCreate(), *sys.argv[1:4], *map(int, sys.argv[4:5]))
