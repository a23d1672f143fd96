import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.operators import labels, models, sketches
from rivulet.plans import sizing
from pyspark.sql import functions as F


def counts(spark, rows):
    return spark.createDataFrame(rows, "flow_id string, size long")


def test_count_min_never_underestimates(spark):
    rng = random.Random(1)
    truth = counts(spark, [(f"f{k}", rng.randint(1, 50)) for k in range(200)])
    cells = sketches.cms_cells(truth, 2, 32)
    bad = truth.join(sketches.cms_estimates(truth, cells, 2, 32), "flow_id").where("estimate < size")
    assert bad.count() == 0
    assert sketches.cms_cells(counts(spark, []), 2, 32).count() == 0


def test_full_cells_are_passed_over_but_in_row_0(spark):
    truth = counts(spark, [("x", 70_000)])
    cells = sketches.cms_cells(truth, 2, 1)
    assert {(r["row"], r["cnt"]) for r in cells.collect()} == {(0, 70_000), (1, 65_535)}
    assert sketches.cms_estimates(truth, cells, 2, 1).first()["estimate"] == 70_000


def test_bloom_has_no_false_negatives(spark):
    m, k = sketches.bloom_size(100, 0.01)
    keys = counts(spark, [(f"f{i}", 1) for i in range(100)])
    probes = sketches.bloom_probe(keys, sketches.bloom_bits(keys, m, k), m, k)
    assert probes.where("NOT hit").count() == 0
    assert sketches.bloom_probe(keys, sketches.bloom_bits(keys.limit(0), m, k), m, k).where("hit").count() == 0


def test_admission_keeps_within_slots_and_in_order(spark):
    flows = spark.createDataFrame([(f"f{k}", k) for k in range(40)], "flow_id string, seq long")
    got = sketches.admit(flows, 2, 3, 2).collect()
    assert len(got) == 40
    used = {}
    for r in got:
        if r["table_idx"] is not None:
            used.setdefault((r["table_idx"], r["bucket"]), []).append(r["seq"])
    assert all(len(v) <= 2 for v in used.values())
    assert sum(r["table_idx"] is None for r in got) == 40 - sum(map(len, used.values())) > 0
    assert sketches.delete_keys(flows, flows.limit(3)).count() == 37


@settings(max_examples=40, deadline=None)
@given(st.floats(1.1, 1e6), st.integers(8, 40))
def test_bins_span_the_range(ratio, n):
    b = sketches.LogBins(ratio, 1.0, n)
    assert b.gamma > 1 and b.low <= b.high
    assert len(b.edges()) == b.high - b.low + 1


def test_published_bins():
    for n, gamma, low, high in ((32, 1.7820016624158848, -23, 8), (31, 1.8166518621032595, -23, 7), (16, 3.3002239880832396, -11, 4)):
        b = sketches.LogBins(60, 1e-6, n)
        assert (b.low, b.high) == (low, high) and math.isclose(b.gamma, gamma, rel_tol=1e-9)


def test_frozen_sketch_ignores_later_values(spark):
    b = sketches.LogBins(60.0, 1e-6, 32)
    rows = [("f", k, 1.0) for k in range(255)] + [("f", 255 + k, 30.0) for k in range(10)]
    cells = sketches.quantile_bins(spark.createDataFrame(rows, "flow_id string, seq long, x double"), b, 8)
    assert [r["cnt"] for r in cells.collect()] == [255]
    zero = spark.createDataFrame([("g", 1, 0.0), ("g", 2, 0.0), ("g", 3, 1.0)], "flow_id string, seq long, x double")
    q = sketches.quantiles(sketches.quantile_bins(zero, b, 8), b, [0.5, 0.99]).orderBy("q").collect()
    assert q[0]["value"] == 0.0


def test_relative_error_of_quantiles(spark):
    b = sketches.LogBins(60.0, 1e-6, 32)
    rng = random.Random(2)
    xs = sorted(math.exp(rng.uniform(-8, 3)) for _ in range(301))
    cells = sketches.quantile_bins(spark.createDataFrame([("f", k, x) for k, x in enumerate(xs)], "flow_id string, seq long, x double"), b, 16)
    for r in sketches.quantiles(cells, b, [0.25, 0.5, 0.9]).collect():
        exact = xs[math.floor(r["q"] * 300)]
        assert abs(r["value"] - exact) / exact <= (b.gamma - 1) / (b.gamma + 1) + 1e-9


def test_labels_are_strict_and_ranks_floor(spark):
    s = counts(spark, [(f"f{k}", 10) for k in range(5)])
    assert labels.label_elephants(s, 99).where("heavy = 1").count() == 0
    seven = spark.createDataFrame([(k,) for k in range(1, 8)], "x int")
    assert labels.floor_rank(seven, [], "x", [0.9]).first()["value"] == 6


def test_sizes_from_budget():
    s = sizing.flow_sizes(1.0, sizing.trace_of("caida-1"))
    assert s.manager == "layers" and s.table_rows == 20_024 // 64 and s.cms_cols > 0 and sum(s.layers) <= s.manager_rows
    base = sizing.flow_sizes(1.0, sizing.trace_of("caida-1"), baseline=True)
    assert base.cms_cols == 1024 * 1024 // 5
    small = sizing.flow_sizes(0.01, sizing.trace_of("uni1"))
    assert small.manager == "oldest" and small.layers == []
    assert sizing.gap_sizes(sizing.trace_of("mawi"), cascade=True)[0] < 9_494
    assert sizing.memory_report(s)["table_entries"] == 64 * s.table_rows
    try:
        sizing.flow_sizes(0.001, sizing.trace_of("caida"))
        raise AssertionError("no error")
    except ValueError:
        pass
    assert sizing.run_name("synth", ap=0.9, fnr=None) == "synth_ap-0.9"


def test_samples_and_buffers(spark):
    rows = spark.createDataFrame([(f"1.2.3.{k},5.6.7.8,1,2,6", k % 4 == 0, k, 0.5, k) for k in range(40)], "flow_id string, h boolean, minute int, agreement double, size long").withColumn("heavy", F.col("h").cast("int"))
    assert models.stratified(rows, 0.5, 10).groupBy("heavy").count().orderBy("heavy").collect()[1]["count"] == 5
    assert models.undersample(rows).where("heavy = 1").count() == 10
    assert models.replay_buffer(rows, rows, "update-fifo", 5).count() == 5
    assert models.replay_buffer(rows, rows.limit(1), "discard", 5).count() == 1
    assert models.replay_buffer(rows, rows, "add", 5).count() == 80
    labelled = rows.select("flow_id", "heavy", "size")
    (_, low), (_, high) = models.calibrate_alpha(labelled, [0.05, 3.0])
    assert low > high


def test_floor_rank_matches_brute_force(spark):
    rng = random.Random(3)
    groups = {g: [rng.randrange(12) for _ in range(rng.randrange(1, 40))] for g in "abcde"}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x long")
    qs = [0.0, 0.5, 0.9, 0.99, 1.0]
    got = {(r["g"], r["q"]): r["value"] for r in labels.floor_rank(df, ["g"], "x", qs).collect()}
    assert got == {(g, q): sorted(xs)[int(q * (len(xs) - 1))] for g, xs in groups.items() for q in qs}
    assert labels.floor_rank(df.limit(0), ["g"], "x", qs).count() == 0


def test_log_bins_without_a_gamma_are_refused():
    with pytest.raises(ValueError):
        sketches.LogBins(1.0000001, 1.0, 1 << 20)
