"""The flow operators on unbounded packets, by Structured Streaming."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rivulet.functions.keys import KEY, bucket, flow_id
from rivulet.sources.packets import packets_from_events

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, and what comes beside it later, as a stream of packets."""
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return packets_from_events(events)


def windowed_sizes(packets: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Flow sizes by windows of event time; windows end, and their state goes, once packets may no longer come."""
    timed = packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), *KEY).agg(F.count("*").alias("size"))


def sessions(packets: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Flows that end by a gap: a real timeout."""
    timed = packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), *KEY).agg(F.count("*").alias("size"))


FEATURES = "flow_id string, seq_k long, mean_size double, std_size double, mean_iat double, std_iat double"
_STATE = "n int, s double, ss double, g double, gg double, last long"


def first_k_features(packets: DataFrame, k: int) -> DataFrame:
    """Features of the first k packets, sent out as the k-th comes; a flow's state is six numbers. Packets of a flow
    are taken in order of seq within a batch; batches come in order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s, ss, g, gg, last = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0)
        pdf = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, ts, size in zip(pdf["seq"], pdf["ts_us"], pdf["size"], strict=True):
            if n >= k:
                break
            gap = (ts - last) / 1e6 if n else 0.0
            n, s, ss, g, gg, last = n + 1, s + size, ss + size * size, g + gap, gg + gap * gap, ts
            if n == k:
                std = lambda m, a, b: max(0.0, b / m - (a / m) ** 2) ** 0.5 if m else 0.0
                out.append((key[0], seq, s / k, std(k, s, ss), g / (k - 1) if k > 1 else 0.0, std(k - 1, g, gg)))
        state.update((int(n), float(s), float(ss), float(g), float(gg), int(last)))
        if out:
            yield pd.DataFrame(out, columns=["flow_id", "seq_k", "mean_size", "std_size", "mean_iat", "std_iat"])

    rows = packets.select(flow_id().alias("flow_id"), "seq", "ts_us", "size")
    return rows.groupBy("flow_id").applyInPandasWithState(step, FEATURES, _STATE, "append", GroupStateTimeout.NoTimeout)


def bounded_manager(packets: DataFrame, rows: int, slots: int, k: int) -> DataFrame:
    """The bounded manager with eviction of the oldest: the state of a bucket is what it holds and the ids it has seen.
    Flows still held are not sent out."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, counts, seen = map(list, state.get) if state.exists else ([], [], [])
        held, known = dict(zip(ids, counts, strict=True)), set(seen)
        pdf = pd.concat(list(batches)).sort_values("seq")
        out = []
        for f, seq, ts in zip(pdf["flow_id"], pdf["seq"], pdf["ts_us"], strict=True):
            if f in held:
                held[f] += 1
            elif f not in known:
                known.add(f)
                held[f] = 1
                if len(held) > slots:
                    old = next(iter(held))
                    out.append((old, "evicted", seq, ts, held.pop(old)))
            if held.get(f) == k:
                out.append((f, "collected", seq, ts, k))
                del held[f]
        state.update((list(held), [int(x) for x in held.values()], sorted(known)))
        if out:
            yield pd.DataFrame(out, columns=["flow_id", "outcome", "seq", "ts_us", "n_pkts"])

    b = packets.select(flow_id().alias("flow_id"), "seq", "ts_us").withColumn("bucket", bucket("flow_id", rows, "fm"))
    state = "ids array<string>, counts array<int>, seen array<string>"
    return b.groupBy("bucket").applyInPandasWithState(step, "flow_id string, outcome string, seq long, ts_us long, n_pkts int", state, "append", GroupStateTimeout.NoTimeout)


def work_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share: spark.checkpoint.dir. Where that is unset, a session of one
    process has one of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rivulet-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is now, into Parquet under `path`, and reads the result. Started again with the
    same path it goes on where it was."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def each_minute(packets: DataFrame, path: str, handle) -> None:
    """Hands each micro-batch, with its number, to `handle(batch, number)`: retraining and sinks hang on here."""
    packets.writeStream.foreachBatch(handle).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
