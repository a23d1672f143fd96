"""Operators whose queries run over one setting alone, held against plain replays; jobs from captures to relations."""

import random

import pytest
from pyspark.sql import functions as F
from test_sources import ETH, capture, ipv4, tcp

from rivulet import jobs
from rivulet.functions.keys import bucket
from rivulet.operators import flow_manager, metrics, models, sketches, training
from rivulet.sources.packets import PACKET, read_key_records


def packets(spark, n, flows, seed=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(k, k * 1000, rng.randrange(flows), 9, 1, 80, 6, 40, 0, False) for k in range(n)], PACKET)


@pytest.mark.parametrize("k", [1, 3])
def test_timeouts_by_rank_match_a_replay(spark, k):
    p = packets(spark, 500, 60)
    got = sorted(tuple(r) for r in flow_manager.evict_timeout(p, 4, 3, k).collect())
    want = []
    rows = flow_manager.keyed(p).select(bucket("flow_id", 4, "fm").alias("b"), "flow_id", "seq", "ts_us").orderBy("seq").collect()
    for b in range(4):
        want += flow_manager.fifo_bucket(((r["flow_id"], r["seq"], r["ts_us"]) for r in rows if r["b"] == b), 3, k, remove_at_k=False)
    assert got == sorted(want)


def test_new_flows_until_exit(spark):
    p = packets(spark, 300, 80)
    out = flow_manager.evict_oldest(p, 2, 2, 4)
    starts = {r["flow_id"]: r["s"] for r in flow_manager.keyed(p).groupBy("flow_id").agg(F.min("seq").alias("s")).collect()}
    want = {r["flow_id"]: sum(starts[r["flow_id"]] < s < r["seq"] for s in starts.values()) for r in out.collect() if r["outcome"] != "resident"}
    assert {r["flow_id"]: r["new_flows"] for r in flow_manager.new_flows_until(p, out).collect()} == want


def replay_epoch(tables, events, place, slots):
    """Tables as {(t, bucket): [[flow, size, live], ...]} through (flow, arrives) in order."""
    for f, arrives in events:
        if arrives:
            for t in (0, 1):
                held = tables.setdefault((t, place[t][f]), [])
                if len(held) < slots:
                    held.append([f, 1, True])
                    break
                if not held[0][2]:
                    held.pop(0)
                    held.append([f, 1, True])
                    break
            continue
        for t in (0, 1):
            for e in tables.get((t, place[t][f]), []):
                if e[0] == f:
                    e[1], e[2] = (e[1] + 1 if e[2] else 1), True
    return {f: (size, live) for held in tables.values() for f, size, live in held}


@pytest.mark.parametrize("seed", range(3))
def test_new_epoch_matches_a_replay(spark, seed):
    rng = random.Random(seed)
    names = [f"f{k}" for k in range(40)]
    df = spark.createDataFrame([(n,) for n in names], "flow_id string")
    place = [{r["flow_id"]: r["b"] for r in df.select("flow_id", bucket("flow_id", 3, f"t{t}").alias("b")).collect()} for t in (0, 1)]
    tables = {}
    for f in names[:14]:
        for t in (0, 1):
            held = tables.setdefault((t, place[t][f]), [])
            if len(held) < 2 + t:
                held.append([f, rng.randrange(1, 9), False])
                break
    rows = [(f, t, b, k + 1, size) for (t, b), held in tables.items() for k, (f, size, _) in enumerate(held)]
    slots = 3
    inside = {r[0] for r in rows}
    events, first = [], set()
    for f in (rng.choice(names) for _ in range(50)):
        events.append((f, f not in inside and f not in first))
        first.add(f)
    want = replay_epoch(tables, events, place, slots)
    met = spark.createDataFrame([(f, k) for k, (f, _) in enumerate(events)], "flow_id string, seq long")
    arrivals = spark.createDataFrame([(f, k) for k, (f, new) in enumerate(events) if new], "flow_id string, seq long")
    entries = spark.createDataFrame(rows, "flow_id string, table_idx int, bucket long, slot int, size long")
    got = sketches.new_epoch(entries, met, arrivals, 2, 3, slots)
    assert {r["flow_id"]: (r["size"], r["live"]) for r in got.collect()} == want
    assert {r["flow_id"] for r in sketches.dump_live(got).collect()} == {f for f, (_, live) in want.items() if live}


def test_margins(spark):
    plain = sketches.MarginBins(100.0, 1.0, 8, 1000.0, 0.1)
    wide = sketches.MarginBins(100.0, 1.0, 8, 1000.0, 0.1, left=4, right=4)
    df = spark.createDataFrame([(x,) for x in (0.05, 0.5, 1.0, 50.0, 100.0, 1000.0, 5000.0)], "x double")
    assert [r["p"] for r in df.select(plain.part(F.col("x")).alias("p")).collect()] == ["zero"] + ["center"] * 6
    got = df.select(wide.part(F.col("x")).alias("p"), wide.bin(F.col("x")).alias("b")).collect()
    assert [r["p"] for r in got] == ["zero", "left", "left", "center", "right", "right", "center"]
    assert got[0]["b"] == sketches.ZERO and got[-1]["b"] == wide.center.high


def test_gaps_need_an_estimate(spark):
    one = lambda *rows: spark.createDataFrame(list(rows), "flow_id string, q double, value double")
    truth = spark.createDataFrame([("a", 0.5, 2.0), ("b", 0.5, 4.0), ("c", 0.5, 5.0)], "flow_id string, q double, v double")
    here = spark.createDataFrame([("c",)], "flow_id string")
    got = metrics.resolve_gaps(truth, one(("a", 0.5, 1.0)), one(("a", 0.5, 9.0), ("b", 0.5, 3.0)), here)
    assert sorted((r["flow_id"], r["estimate"], r["sector"]) for r in got.collect()) == [("a", 1.0, "heavy"), ("b", 3.0, "mice"), ("c", 5.0, "manager")]
    assert metrics.resolve_gaps(truth, one(("a", 0.5, 1.0)), one(("b", 0.5, 3.0)), here, drop_resident=True).count() == 2
    with pytest.raises(Exception, match="no estimate of flow b"):
        metrics.resolve_gaps(truth, one(("a", 0.5, 1.0)), one(("a", 0.5, 9.0)), here).collect()


def test_beta_draws_have_their_mean_and_order(spark):
    u = spark.range(1, 200).select((F.col("id") / 200).alias("u"))
    x = [r["x"] for r in u.select(models.beta_quantile(F.col("u"), 0.5).alias("x")).collect()]
    assert x == sorted(x) and abs(sum(x) / len(x) - 0.5 / 3.5) < 0.005


def test_buffer_kinds_and_alphas(spark):
    a = spark.range(400).select(F.concat(F.lit("f"), "id").alias("flow_id"), ((F.col("id") % 10) / 10).alias("agreement"))
    hard = {r["flow_id"] for r in models.buffer_rows(a, "active", 0.3, 0.0).collect()}
    assert len(hard) == 120
    some = models.buffer_rows(a, "random", 0.0, 0.25).count()
    assert 60 < some < 140
    both = {r["flow_id"] for r in models.buffer_rows(a, "both", 0.3, 0.25).collect()}
    assert hard < both and 60 < len(both - hard) < 140
    assert models.buffer_rows(a, "both", 0.9, 0.5).count() == 360
    assert models.nearest_alphas([(0.1, 0.9), (0.2, 0.91), (2.0, 0.3)], [0.9, 0.5]) == {0.9: pytest.approx(0.15)}


def test_distilled_tree_is_faithful(spark):
    rows = spark.range(600).select(F.concat(F.lit("f"), "id").alias("flow_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    teacher = rows.withColumn("predicted", ((F.col("a") > 3) & (F.col("b") > 1)).cast("int"))
    tree, report = training.distill(teacher, ["a", "b"], depth=3, rounds=3, keep=2)
    got = report.collect()
    assert tree.depth <= 3 and all(r["fidelity"] == 1.0 for r in got)
    assert sorted(r["agreement"] is None for r in got) == [False, False, True]


def test_jobs_from_captures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    frames = [ETH + ipv4(6, tcp(1 + k % 3, 80, 16)) for k in range(20)] + [ETH + ipv4(1, b"\x08\0")]
    (tmp_path / "in/a.pcap").write_bytes(capture(frames[:12]))
    (tmp_path / "in/b.pcap").write_bytes(capture(frames[12:]))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    jobs.run(spark, "features", path, f"{out}/f", n=3)
    assert spark.read.csv(f"{out}/f/oracle_tcp").count() == 3 and spark.read.csv(f"{out}/f/oracle_icmp").count() == 1
    jobs.run(spark, "sizes", path, f"{out}/s", p=60)
    read = lambda name: spark.read.csv(f"{out}/s/{name}")
    assert read("gt").count() == 3 and read("fm_collected").count() == 3 and read("model_predictions").count() == 3
    assert read("simulation_configuration").count() == 7
    p = jobs.consecutive(jobs.captures(spark, path))
    assert sorted(r["seq"] for r in p.collect()) == list(range(20))
    n = jobs.write_key_records(p, f"{out}/r").first()
    assert (n["n_packets"], n["n_flows"]) == (20, 3)
    data = b"".join(bytes(r["data"]) for r in jobs.records_of(spark, f"{out}/r", stretch=6).collect())
    assert [r[2] for r in read_key_records(data)] == [1 + k % 3 for k in range(20)]
    with pytest.raises(ValueError, match="unknown job"):
        jobs.run(spark, "other", path, out)
