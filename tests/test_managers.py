import random
from collections import Counter

from rivulet.operators import flow_manager as M
from rivulet.sources.packets import PACKET
from rivulet.streaming import flows as S


def test_fifo_evicts_the_first_though_refreshed():
    rows = [("a", 1, 1), ("b", 2, 2), ("a", 3, 3), ("c", 4, 4), ("a", 5, 5)]
    got = list(M.fifo_bucket(iter(rows), 2, 5))
    assert got == [("a", "evicted", 4, 4, 2), ("b", "resident", 2, 2, 1), ("c", "resident", 4, 4, 1)]


def test_a_flow_enters_once_and_leaves_at_k():
    rows = [("a", k, k) for k in range(1, 8)]
    assert list(M.fifo_bucket(iter(rows), 1, 5)) == [("a", "collected", 5, 5, 5)]
    kept = [("a", 1, 1), ("a", 2, 2), ("b", 3, 3), ("a", 4, 4)]
    assert list(M.fifo_bucket(iter(kept), 1, 2, remove_at_k=False)) == [("a", "collected", 2, 2, 2), ("b", "resident", 3, 3, 1)]


def test_layer_evicts_least_recent():
    rows = [("a", True, 1, 5), ("b", True, 2, 3), ("c", True, 3, 6), ("a", False, 4, 7)]
    assert list(M.layer_bucket(iter(rows), 2)) == [("b", "evicted", 3, 6), ("a", "moved", 4, 7), ("c", "resident", 3, 6)]


def packets(spark, n=400, seed=5):
    rng = random.Random(seed)
    return spark.createDataFrame([(k, k * 1000, rng.choice([1, 2, 3] + list(range(60))), 9, 1, 80, 6, 40, 0, False) for k in range(n)], PACKET)


def simulate_layers(rows, layers, slots, k, place):
    """A plain replay, packet by packet."""
    held = [dict() for _ in layers]
    seen, out = {}, {}
    for f, seq, ts in rows:
        seen[f] = seen.get(f, 0) + 1
        i = seen[f]
        if i > k or f in out:
            continue
        if i > 1:
            held[i - 2].pop((place(f, i - 2), f))
        if i == k:
            out[f] = ("collected", k)
            continue
        b = place(f, i - 1)
        inside = {key: v for key, v in held[i - 1].items() if key[0] == b}
        if len(inside) >= slots:
            old = min(inside, key=lambda x: inside[x])
            held[i - 1].pop(old)
            out[old[1]] = ("evicted", i)
        held[i - 1][b, f] = (ts, seq)
    for i, layer in enumerate(held):
        for _, f in layer:
            out[f] = ("resident", i + 1)
    return out


def test_layers_match_a_replay(spark):
    p = packets(spark)
    layers, slots, k = [3, 2, 2, 1], 2, 5
    got = {r["flow_id"]: (r["outcome"], r["n_pkts"]) for r in M.hierarchical(p, layers, slots, k).collect()}
    keyed = M.keyed(p)
    for i in range(4):
        keyed = keyed.withColumn(f"b{i}", M.bucket("flow_id", layers[i], f"layer{i + 1}"))
    rows = keyed.orderBy("seq").collect()
    at = {(r["flow_id"], i): r[f"b{i}"] for r in rows for i in range(4)}
    assert got == simulate_layers([(r["flow_id"], r["seq"], r["ts_us"]) for r in rows], layers, slots, k, lambda f, i: at[f, i])


def test_each_flow_has_one_outcome(spark):
    p = packets(spark)
    flows = M.keyed(p).select("flow_id").distinct().count()
    for out in (M.infinite(p, 5), M.evict_oldest(p, 4, 3, 5), M.hierarchical(p, [4, 3, 2, 1], 2, 5), M.evict_timeout(p, 4, 3, 5)):
        rows = [r["flow_id"] for r in out.collect()]
        assert len(rows) == flows == len(set(rows))


def test_stream_agrees_with_batch(spark, tmp_path):
    p = packets(spark)
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    got = S.drain(S.bounded_manager(stream, 4, 3, 5), str(tmp_path / "s"))
    batch = M.evict_oldest(p, 4, 3, 5).where("outcome <> 'resident'")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, batch.collect()))


def test_timeout_splits_flows(spark):
    rows = [(0, 0, 1, 9, 1, 80, 6, 40, 0, False), (1, 10, 1, 9, 1, 80, 6, 40, 0, False), (2, 10_000, 1, 9, 1, 80, 6, 40, 0, False)]
    got = M.evict_timeout(spark.createDataFrame(rows, PACKET), 1, 8, 5, timeout_us=100).collect()
    assert sorted(r["n_pkts"] for r in got) == [1, 2]


def test_sessions_and_windows_have_a_watermark(spark, tmp_path):
    p = packets(spark, 50)
    p.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    for s in (S.sessions(stream), S.windowed_sizes(stream)):
        assert S.drain(s, str(tmp_path / f"o{id(s)}")).count() >= 0
    batches = []
    S.each_minute(stream, str(tmp_path / "state"), lambda df, k: batches.append(df.count()))
    assert sum(batches) == 50
