"""Further queries: calibration tables, sample plans, epochs, margins, sizes of forests, switches of the error metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.functions.keys import uniform
from rivulet.operators import flow_manager, flows, metrics, models, pipelines, sketches
from rivulet.plans.queries import BIT, BUCKET, CONFIG, IAT, LABELLED, MRE, SYNTH, TREES, UNIFORM, _G, _exact, _fse_sql, _iat, _synth, _trees, fk, labelled, packets, query, r6, sized, table
from rivulet.plans.replays import recursive

# -- feature matrix ----------------------------------------------------------------------------------------------------

LOW, HIGH = 2, 22


def _matrix_sql() -> str:
    out = []
    for m in range(LOW, HIGH):
        for name, x in (("count_synack", f"{BIT(2)} * {BIT(16)}"), ("count_pshecerst", f"greatest({BIT(8)}, {BIT(4)})")):
            out.append(f"CAST(coalesce(sum(CASE WHEN rn < {m} AND protocol = 6 THEN {x} END), -1) AS BIGINT) AS {name}_{m}")
        for c, name, digits in (("s", f"pk_size_{m}", 4), ("gap_us / 1e6", f"iat_{m}", 2)):
            x = f"CASE WHEN rn <= {m} THEN {c} END"
            out += [f"round(min({x}), 6) AS {name}_min", f"round(max({x}), 6) AS {name}_max", f"round(coalesce(sum({x}), 0), 6) AS {name}_sum", f"round(avg({x}), {digits}) AS {name}_mean", f"round(stddev_pop({x}), {digits}) AS {name}_std"]
    return f"SELECT flow_id, {', '.join(out)} FROM (SELECT *, CAST(size AS DOUBLE) AS s FROM ordered WHERE rn < {HIGH}) GROUP BY flow_id"


@query(_matrix_sql())
def aggregate_matrix(spark, d):
    f = flows.aggregate_matrix(packets(spark, d).withColumn("size", F.col("size").cast("double")), LOW, HIGH)

    def shown(c: str):
        if c.startswith("count"):
            return F.col(c).cast("long").alias(c)
        return F.round(c, 6 if c.rpartition("_")[2] in ("min", "max", "sum") else 2 if c.startswith("iat") else 4).alias(c)

    return f.select(fk(), *(shown(c) for c in f.columns if c.startswith(("count", "pk_size", "iat"))))


# -- synthetic scores and calibration ----------------------------------------------------------------------------------


def _beta_sql(alpha: float, name: str = "scores") -> str:
    """Relation (flow_id, heavy, proba): quantiles of Beta(alpha, 3) by halving, a step of the recursion for each."""
    mid = "((low + high) / 2)"
    below = f"pow({mid}, {alpha}) * (1 + {alpha} * (1 - {mid}) + {alpha * (alpha + 1) / 2!r} * pow(1 - {mid}, 2)) < u"
    return f"""{name}_h(flow_id, heavy, u, low, high, step) AS (SELECT flow_id, heavy, {UNIFORM("'beta' || flow_id")}, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM labelled
  UNION ALL SELECT flow_id, heavy, u, CASE WHEN {below} THEN {mid} ELSE low END, CASE WHEN {below} THEN high ELSE {mid} END, step + 1 FROM {name}_h WHERE step < 45),
{name} AS (SELECT flow_id, heavy, round(CASE WHEN heavy = 1 THEN 1 - (low + high) / 2 ELSE (low + high) / 2 END, 5) AS proba FROM {name}_h WHERE step = 45)"""


@recursive(f"{LABELLED}, {_beta_sql(0.5)} SELECT flow_id, proba FROM scores")
def synthetic_scores(spark, d):
    return models.synthetic_scores(labelled(spark, d), 0.5).select("flow_id", "proba")


@recursive(f"{LABELLED}, {_beta_sql(0.25, 'a')}, {_beta_sql(1.5, 'b')} SELECT 0.9::DOUBLE AS ap, round(quantile_cont(proba, 0.95), 6) AS threshold FROM a UNION ALL SELECT 0.4, round(quantile_cont(proba, 0.95), 6) FROM b")
def score_thresholds(spark, d):
    return models.score_thresholds(labelled(spark, d), {0.9: 0.25, 0.4: 1.5}, 0.05).select("ap", r6("threshold", "threshold"))


_GRID = [x / 100 for x in range(0, 105, 5)]
_RATES = f"h AS (SELECT avg(heavy) AS h FROM labelled), grid AS (SELECT f::DOUBLE AS fnr, (0.08 - h * (1 - f)) / (1 - h) AS fpr FROM h, unnest({_GRID}::DOUBLE[]) AS t(f))"


@query(f"""{LABELLED}, {_RATES}, x AS (SELECT fnr, fpr, heavy, CASE WHEN heavy = 1 THEN {UNIFORM('flow_id')} > fnr ELSE {UNIFORM('flow_id')} < fpr END AS yes FROM labelled, grid),
c AS (SELECT fnr, fpr, sum(heavy) AS p, count(*) AS n, count(CASE WHEN yes THEN 1 END) AS k, count(CASE WHEN yes AND heavy = 1 THEN 1 END) AS tp FROM x GROUP BY fnr, fpr)
SELECT fnr, round(fpr, 6) AS fpr, round(tp / p * coalesce(tp / nullif(k, 0), 0) + (1 - tp / p) * p / n, 6) AS ap FROM c""")
def fnr_to_fpr_ap(spark, d):
    x = labelled(spark, d)
    return models.binary_average_precision(x, models.rate_table(x, 0.08, _GRID)).select("fnr", r6("fpr", "fpr"), r6("ap", "ap"))


_DELTAS = [0.0, 0.005, 0.01, 0.015, 0.02, 0.025]


@query(f"""{LABELLED}, h AS (SELECT avg(heavy) AS h FROM labelled), l AS (SELECT h, (0.08 - h) / (1 - h) AS least FROM h), m AS (SELECT h, CASE WHEN round(least * 2, 2) / 2 < least THEN round(least * 2, 2) / 2 + 0.005 ELSE round(least * 2, 2) / 2 END AS low FROM l),
g AS (SELECT h, low + x AS fpr FROM m, unnest({_DELTAS}::DOUBLE[]) AS t(x)) SELECT round(fpr, 6) AS fpr, round(((1 - h) * fpr - greatest(0.08, fpr) + h) / h, 6) AS fnr FROM g""")
def fpr_to_fnr(spark, d):
    return models.inverse_rate_table(labelled(spark, d), 0.08, _DELTAS).select(r6("fpr", "fpr"), r6("fnr", "fnr"))


@query(f"{LABELLED}, {_RATES}, asked AS (SELECT DISTINCT round({UNIFORM('flow_id')}, 2) AS fnr FROM labelled) SELECT a.fnr, round(g.fpr, 3) AS fpr FROM asked a LEFT JOIN grid g ON round(a.fnr, 3) = round(g.fnr, 3)")
def rounded_rates(spark, d):
    x = labelled(spark, d)
    asked = x.select(F.round(uniform("flow_id"), 2).alias("fnr")).distinct()
    return metrics.rounded_map(asked, models.rate_table(x, 0.08, _GRID), "fnr", "fpr").select("fnr", "fpr")


@query(f"{SYNTH}, r AS (SELECT protocol, count(CASE WHEN heavy = 1 AND predicted = 1 THEN 1 END) AS tp, count(CASE WHEN heavy = 0 AND predicted = 1 THEN 1 END) AS fp, count(CASE WHEN heavy = 0 AND predicted = 0 THEN 1 END) AS tn, count(CASE WHEN heavy = 1 AND predicted = 0 THEN 1 END) AS fn FROM pred JOIN (SELECT flow_id, protocol FROM sizes) USING (flow_id) GROUP BY protocol) SELECT round(avg(tp / nullif(tp + fn, 0)), 6) AS tpr, round(avg(tn / nullif(tn + fp, 0)), 6) AS tnr, round(avg(fp / nullif(fp + tn, 0)), 6) AS fpr, round(avg(fn / nullif(fn + tp, 0)), 6) AS fnr FROM r")
def mean_rates(spark, d):
    return metrics.mean_rates(metrics.confusion(_synth(spark, d), ["protocol"])).select(*(r6(c, c) for c in ("tpr", "tnr", "fpr", "fnr")))


# -- priorities and slowdowns ------------------------------------------------------------------------------------------


@query(f"""t AS (SELECT list_sort(list(size))[CAST(floor(0.9 * (count(*) - 1)) AS INTEGER) + 1] AS threshold FROM sizes WHERE size >= 5),
p AS (SELECT flow_id, {UNIFORM("'priority' || flow_id")} AS u, CASE WHEN size < 5 THEN 0 WHEN size >= threshold THEN 2 ELSE 1 END AS a FROM sizes, t),
b AS (SELECT flow_id, u, CASE WHEN a = 2 AND u > 0.7 THEN 1 ELSE a END AS b FROM p) SELECT flow_id, CASE WHEN b = 1 AND u > 0.8 THEN 2 ELSE b END AS priority FROM b""")
def predicted_priority(spark, d):
    s = sized(spark, d)
    t = metrics.size_threshold(s, 0.9, 5)
    return metrics.predicted_priority(s.crossJoin(F.broadcast(t)), F.col("threshold"), 5, 0.7, 0.8).select("flow_id", "priority")  # a single row


_LOADS = "runs AS (SELECT CAST(o_orderkey % 3 AS BIGINT) AS load, CAST(o_custkey % 4 AS BIGINT) AS iteration, o_totalprice AS slowdown, o_totalprice >= 200000 AS big FROM orders), each_ AS (SELECT load, iteration, avg(slowdown) AS overall, coalesce(avg(CASE WHEN big THEN slowdown END), 0) AS elephants, coalesce(avg(CASE WHEN NOT big THEN slowdown END), 0) AS mice FROM runs GROUP BY load, iteration)"


@query(f"{_LOADS} SELECT load, round(avg(overall), 4) AS overall, round(avg(elephants), 4) AS elephants, round(avg(mice), 4) AS mice FROM each_ GROUP BY load")
def mean_slowdowns(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("load"), (F.col("o_custkey") % 4).alias("iteration"), F.col("o_totalprice").alias("x"))
    big = F.col("x") >= 200_000
    each = o.groupBy("load", "iteration").agg(F.avg("x").alias("overall"), F.coalesce(F.avg(F.when(big, F.col("x"))), F.lit(0.0)).alias("elephants"), F.coalesce(F.avg(F.when(~big, F.col("x"))), F.lit(0.0)).alias("mice"))
    return metrics.mean_slowdowns(each).select("load", *(F.round(c, 4).alias(c) for c in ("overall", "elephants", "mice")))


# -- samples and folds -------------------------------------------------------------------------------------------------

_AGREE = f"{TREES}, v AS (SELECT flow_id, count(*) AS n, count(*) - sum(CAST(proba >= 0.5 AS INTEGER)) AS z FROM trees GROUP BY flow_id), ag AS (SELECT flow_id, abs(n - 2 * (CASE WHEN z = 0 OR z = n THEN 1 ELSE z + 1 END)) / n AS agreement, {UNIFORM(chr(39) + 'buffer' + chr(39) + ' || flow_id')} AS u FROM v)"


@query(f"{_AGREE}, c AS (SELECT count(*) * 0.2 / count(CASE WHEN agreement >= 0.3 THEN 1 END) AS of_rest FROM ag) SELECT flow_id FROM ag, c WHERE agreement < 0.3 OR (of_rest < 1 AND u < of_rest)")
def buffer_both(spark, d):
    v = _trees(spark, d).withColumn("vote", (F.col("proba") >= 0.5).cast("int"))
    return models.buffer_rows(models.agreement(v), "both", 0.3, 0.2)


@query(f"{LABELLED} SELECT flow_id, heavy, CAST((row_number() OVER (PARTITION BY heavy ORDER BY {UNIFORM(chr(39) + 'fold42' + chr(39) + ' || flow_id')}, flow_id) - 1) % 5 AS INTEGER) AS fold FROM labelled")
def stratified_folds(spark, d):
    return models.stratified_folds(labelled(spark, d), 5).select("flow_id", "heavy", "fold")


_SPLITS = """mins AS (SELECT CAST(floor(ts_us / 86400000000) AS BIGINT) % 24 AS minute, flow_id, CAST(count(*) AS BIGINT) AS size FROM packets GROUP BY 1, 2),
sp AS (SELECT minute, flow_id, size, k AS split, CASE WHEN minute < 24 - 6 * (3 - k) THEN 'train' WHEN minute < 24 - 6 * (3 - k) + 6 THEN 'test' END AS side FROM mins, range(3) t(k)),
s AS (SELECT * FROM sp WHERE side IS NOT NULL)"""


def _splits(spark, d):
    m = packets(spark, d).groupBy((F.floor(F.col("ts_us") / 86_400_000_000) % 24).alias("minute"), fk()).agg(F.count("*").alias("size"))
    return models.time_splits(m, 3, 24)


@query(f"{_SPLITS} SELECT CAST(split AS INTEGER) AS split, side, minute, flow_id, size FROM s")
def time_splits(spark, d):
    return _splits(spark, d).select("split", "side", "minute", "flow_id", "size")


@query(f"""{_SPLITS}, n AS (SELECT split, avg(CAST(side = 'test' AS INTEGER)) AS share FROM s GROUP BY split), b AS (SELECT split, flow_id, count(DISTINCT side) = 2 AS both_ FROM s GROUP BY split, flow_id)
SELECT CAST(s.split AS INTEGER) AS split, s.side, s.minute, s.flow_id, s.size FROM s JOIN n ON n.split = s.split JOIN b ON b.split = s.split AND b.flow_id = s.flow_id
WHERE NOT both_ OR (side = 'train') = ({UNIFORM("'apart' || concat_ws('#', s.split, s.flow_id)")} < share)""")
def splits_apart(spark, d):
    return models.apart(_splits(spark, d)).select("split", "side", "minute", "flow_id", "size")


# -- tables over epochs, sketches with margins -------------------------------------------------------------------------

ER, ES = 8, 3  # rows and slots
_EPOCH = f"""mid AS (SELECT quantile_disc(seq, 0.5) AS mid FROM packets),
old AS (SELECT flow_id, min(seq) AS seq, CAST(count(*) AS BIGINT) AS size FROM packets, mid WHERE seq < mid AND src_ip % 3 = 0 GROUP BY flow_id),
later AS (SELECT flow_id, min(seq) AS seq, CAST(count(*) AS BIGINT) AS hits FROM packets, mid WHERE seq >= mid GROUP BY flow_id),
entries0 AS (SELECT *, {BUCKET("'t0'", 'flow_id', ER)} AS bucket FROM old), entries1 AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS slot FROM entries0),
entries AS MATERIALIZED (SELECT * FROM entries1 WHERE slot <= {ES}),
arrive AS (SELECT l.flow_id, l.seq, true AS comes FROM later l JOIN packets p ON p.seq = l.seq WHERE p.src_ip % 3 = 1),
steps0 AS (SELECT *, {BUCKET("'t0'", 'flow_id', ER)} AS bucket FROM (SELECT * FROM arrive UNION ALL SELECT flow_id, seq, false FROM later WHERE flow_id IN (SELECT flow_id FROM entries))),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS i FROM steps0),
run(bucket, i, held) AS (
  SELECT b, 0::BIGINT, coalesce((SELECT list({{'f': flow_id, 'live': false}} ORDER BY slot) FROM entries WHERE bucket = b), []::STRUCT(f VARCHAR, live BOOLEAN)[]) FROM range({ER}) t(b)
  UNION ALL SELECT r.bucket, s.i, CASE WHEN NOT s.comes THEN list_transform(r.held, lambda x: {{'f': x.f, 'live': x.live OR x.f = s.flow_id}})
    WHEN len(r.held) < {ES} THEN list_append(r.held, {{'f': s.flow_id, 'live': true}}) WHEN NOT r.held[1].live THEN list_append(r.held[2:], {{'f': s.flow_id, 'live': true}}) ELSE r.held END
  FROM run r JOIN steps s ON s.bucket = r.bucket AND s.i = r.i + 1),
final AS (SELECT bucket, unnest(max_by(held, i)) AS x FROM run GROUP BY bucket)"""


@recursive(f"{_EPOCH} SELECT x.f AS flow_id, l.hits AS size FROM final JOIN later l ON l.flow_id = x.f WHERE x.live")
def epoch_dump(spark, d):
    p = packets(spark, d).select("seq", "src_ip", fk())
    mid = p.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seq)").alias("mid"))
    p = p.crossJoin(F.broadcast(mid))  # a single row
    before, after = p.where("seq < mid AND src_ip % 3 = 0"), p.where("seq >= mid")
    old = before.groupBy("flow_id").agg(F.min("seq").alias("seq"), F.count("*").alias("size"))
    placed = sketches.admit(old, 1, ER, ES).where("table_idx IS NOT NULL").withColumn("slot", F.row_number().over(Window.partitionBy("table_idx", "bucket").orderBy("seq")))
    entries = placed.drop("seq").join(old.select("flow_id", "size"), "flow_id")
    arrivals = after.where("src_ip % 3 = 1").groupBy("flow_id").agg(F.min("seq").alias("seq"))
    return sketches.dump_live(sketches.new_epoch(entries, after.select("flow_id", "seq"), arrivals, 1, ER, ES))


MARGIN = sketches.MarginBins(500_000.0, 1_000.0, 16, 2_592_000.0, 1.0, left=8, right=8)


def _log_bin(b) -> str:
    import math

    return f"CAST(greatest(least(ceil(log2(x) / {math.log2(b.gamma)!r}), {b.high}), {b.low}) AS INTEGER)"


@query(f"""{_G}, b AS (SELECT flow_id, CASE WHEN x < 1 THEN 'zero' WHEN x <= 1000 THEN 'left' WHEN x >= 500000 AND x <= 2592000 THEN 'right' ELSE 'center' END AS part,
  CASE WHEN x < 1 THEN {sketches.ZERO} WHEN x <= 1000 THEN {_log_bin(MARGIN.left)} WHEN x >= 500000 AND x <= 2592000 THEN {_log_bin(MARGIN.right)} ELSE {_log_bin(MARGIN.center)} END AS bin FROM gaps)
SELECT flow_id, part, bin, CAST(count(*) AS BIGINT) AS cnt FROM b GROUP BY flow_id, part, bin""")
def margin_bins(spark, d):
    x = F.col("x")
    return pipelines.gaps(packets(spark, d)).groupBy("flow_id", MARGIN.part(x).alias("part"), MARGIN.bin(x).alias("bin")).agg(F.count("*").alias("cnt"))


# -- sizes of forests --------------------------------------------------------------------------------------------------

_NODES = "nodes AS (SELECT CAST(l_suppkey % 5 AS BIGINT) AS tree, l_linenumber - 1 AS depth, l_linenumber >= 6 AS is_leaf, l_partkey % 40 AS feature, l_quantity AS threshold FROM lineitem)"
_WIDEST = "w AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM nodes GROUP BY tree, depth))"
_TREE = "t AS (SELECT tree, max(depth) AS depth, count(CASE WHEN is_leaf THEN 1 END) AS leaves FROM nodes GROUP BY tree)"


def _nodes(spark, d):
    n = table(spark, d, "lineitem")
    return n.select((F.col("l_suppkey") % 5).alias("tree"), (F.col("l_linenumber") - 1).alias("depth"), (F.col("l_linenumber") >= 6).alias("is_leaf"), (F.col("l_partkey") % 40).alias("feature"), F.col("l_quantity").alias("threshold"))


@query(f"""{_NODES}, {_WIDEST}, {_TREE}, r AS (SELECT count(DISTINCT threshold) AS r FROM nodes WHERE NOT is_leaf AND feature >= 32), k AS (SELECT r, CASE WHEN r > 0 THEN ceil(log2(r + 1)) ELSE 0 END AS code, floor(log2(n)) + 1 AS layers, n FROM r, w)
SELECT tree, CAST((pow(2, depth + 1) - 1) * 23 AS BIGINT) AS full, CAST(leaves * (32 + 8 * code + 1) + 8 * ((r + 1) * (16 + code)) AS BIGINT) AS table, CAST((pow(2, layers) - 1) * 23 + n * (depth + 1 - layers) * 23 AS BIGINT) AS hybrid FROM t, k""".replace(" AS full,", ' AS "full",').replace(" AS table,", ' AS "table",'))
def structure_bits(spark, d):
    return models.structure_bits(_nodes(spark, d), 32, 8)


@query(f"""{_NODES}, {_WIDEST}, {_TREE} SELECT tree, CAST((pow(2, depth) - 1) * 8 AS BIGINT) AS dense, CAST((pow(2, floor(log2(n)) + 1) - 1) * 8 + n * (depth - floor(log2(n)) - 1) * (8 + n) AS BIGINT) AS hybrid, CAST(leaves * 209 AS BIGINT) AS "table" FROM t, w""")
def hardware_bits(spark, d):
    return models.binary_structure_bits(_nodes(spark, d), 104)


# -- switches of the error metrics -------------------------------------------------------------------------------------


@query(f"""{_fse_sql(SYNTH)}, twice AS (SELECT p.flow_id FROM placed p JOIN cms c USING (flow_id) WHERE p.table_idx IS NOT NULL)
SELECT flow_id, v, estimate, sector FROM resolved WHERE sector <> 'none' AND (sector = 'discarded' OR flow_id NOT IN (SELECT flow_id FROM twice))""")
def fse_estimates_strict(spark, d):
    s = pipelines.sizes(packets(spark, d))
    e = pipelines.estimate_sizes(s, flow_manager.infinite(packets(spark, d), 5), _synth(spark, d), CONFIG)
    return metrics.resolve(s, e.table, e.cms, e.manager, e.discarded, 5, drop_both=True, drop_missing=True)


@query(f"{IAT}, told AS (SELECT * FROM estimates WHERE sector <> 'manager') {MRE.format(e='told')}")
def iat_mre_without_resident(spark, d):
    e = _iat(spark, d)
    heavy, mice = (e.where(F.col("sector") == s) for s in ("heavy", "mice"))
    resident = e.where("sector = 'manager'").select("flow_id").distinct()
    r = metrics.resolve_gaps(_exact(spark, d), heavy, mice, resident, drop_resident=True)
    return metrics.mean_relative_error(r).select("q", "n_inf", r6("mre", "mre"))
