"""Registry of the engine's own queries and of the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions import keys
from rivulet.functions.keys import KEY, flow_id
from rivulet.operators import flow_manager, flows, labels, metrics, models, pipelines, sketches
from rivulet.sources.packets import key_records, packets, table
from rivulet.streaming import flows as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# -- SQL shared by the oracles -----------------------------------------------------------------------------------------
IP = lambda c: f"concat_ws('.', ({c} >> 24) & 255, ({c} >> 16) & 255, ({c} >> 8) & 255, {c} & 255)"
FID = f"concat_ws(',', {IP('src_ip')}, {IP('dst_ip')}, src_port, dst_port, protocol)"
K = "src_ip, dst_ip, src_port, dst_port, protocol"
PACKETS = f"""packets0 AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts_us, 167772160 + user_id AS src_ip, 3232235520 + user_id % 16 AS dst_ip,
    CASE WHEN event_type = 'error' THEN 0 ELSE CAST(1024 + user_id % 60000 AS INTEGER) END AS src_port,
    CASE event_type WHEN 'view' THEN 80 WHEN 'click' THEN 443 WHEN 'purchase' THEN 8443 WHEN 'signup' THEN 53 ELSE 0 END AS dst_port,
    CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 17 ELSE 6 END AS protocol,
    40 + CAST(floor(value) AS INTEGER) AS size, CAST(json_extract_string(props, '$.k') AS INTEGER) AS flags FROM events),
packets AS (SELECT *, protocol = 6 AND (flags & 5) <> 0 AS has_fin_rst, {FID} AS flow_id FROM packets0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY seq) AS rn, ts_us - lag(ts_us) OVER (PARTITION BY {K} ORDER BY seq) AS gap_us FROM packets),
sizes AS (SELECT flow_id, any_value(protocol) AS protocol, CAST(count(*) AS BIGINT) AS size FROM packets GROUP BY flow_id)"""
BUCKET = lambda salt, t, n: f"(CAST('0x' || substr(md5({salt} || '#' || {t}), 1, 8) AS BIGINT) % {n})"
UNIFORM = lambda t: f"(CAST('0x' || substr(sha256({t}), 1, 8) AS BIGINT) / 4294967296.0)"
P = 95  # percentile of the labels: sizes here have light tails
QS = [0.5, 0.75, 0.9, 0.95, 0.99]
QSQL = "(VALUES (0.5::DOUBLE), (0.75), (0.9), (0.95), (0.99)) AS qs(q)"
LABELLED = f"labelled AS (SELECT flow_id, protocol, size, quantile_cont(size, {P / 100}) OVER () AS cutoff, CAST(size > quantile_cont(size, {P / 100}) OVER () AS INTEGER) AS heavy FROM sizes)"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle: `WITH PACKETS, ...` is put before the SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {PACKETS}{', ' if sql.lstrip()[:6].upper() != 'SELECT' else ' '}{sql}"
        return f

    return put


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flow_id, protocol, size)."""
    return packets(spark, sf_dir).groupBy(flow_id().alias("flow_id"), "protocol").agg(F.count("*").alias("size"))


def labelled(spark: SparkSession, sf_dir: str, p: float = P) -> DataFrame:
    return labels.label_elephants(sized(spark, sf_dir), p)


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def fk():
    return flow_id().alias("flow_id")


# -- sources and sinks -------------------------------------------------------------------------------------------------


@query("SELECT seq, ts_us, src_ip, dst_ip, src_port, dst_port, protocol, size, flags, has_fin_rst FROM packets")
def packet_stream(spark, d):
    return packets(spark, d)


@query(f"SELECT ts_us, concat_ws(',', {IP('src_ip')}, {IP('dst_ip')}, src_port, dst_port) AS flow_key FROM packets WHERE protocol = 6")
def tcp_keys(spark, d):
    return packets(spark, d).where("protocol = 6").select("ts_us", flow_id(4).alias("flow_key"))


@query("SELECT seq, lower(printf('%08x%08x%04x%04x%02x', src_ip, dst_ip, src_port, dst_port, protocol)) AS record FROM packets")
def key_record_hex(spark, d):
    return key_records(packets(spark, d)).select("seq", F.lower(F.hex("record")).alias("record"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_packets, CAST(count(DISTINCT flow_id) AS BIGINT) AS n_flows FROM packets")
def record_counts(spark, d):
    return packets(spark, d).groupBy().agg(F.count("*").alias("n_packets"), F.countDistinct(*KEY).alias("n_flows"))


@query("SELECT CAST(floor(ts_us / 86400000000) AS BIGINT) AS day, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT flow_id) AS BIGINT) AS n_flows FROM packets GROUP BY 1")
def day_epochs(spark, d):
    return packets(spark, d).groupBy(F.floor(F.col("ts_us") / 86_400_000_000).alias("day")).agg(F.count("*").alias("n"), F.countDistinct(*KEY).alias("n_flows"))


@query("SELECT protocol, CAST(count(*) AS BIGINT) AS n FROM (SELECT protocol FROM packets WHERE protocol = 6 UNION ALL SELECT protocol FROM packets WHERE protocol = 17 UNION ALL SELECT protocol FROM packets WHERE protocol = 1) GROUP BY protocol")
def union_protocols(spark, d):
    p = packets(spark, d)
    return p.where("protocol = 6").unionByName(p.where("protocol = 17")).unionByName(p.where("protocol = 1")).groupBy("protocol").agg(F.count("*").alias("n"))


@query("SELECT CAST(regexp_extract(line, 'Total: ([0-9.]+)', 1) AS DOUBLE) AS total FROM (SELECT 'Total: ' || size || ' end' AS line FROM sizes)")
def parse_report(spark, d):
    lines = sized(spark, d).select(F.concat(F.lit("Total: "), F.col("size"), F.lit(" end")).alias("line"))
    return lines.select(F.regexp_extract("line", r"Total: ([0-9.]+)", 1).cast("double").alias("total"))


# -- keys and scalar functions -----------------------------------------------------------------------------------------


@query("SELECT DISTINCT flow_id FROM packets")
def flow_id_string(spark, d):
    return packets(spark, d).select(*KEY).distinct().select(fk())


@query(f"SELECT DISTINCT (src_ip << 32) | dst_ip AS high, (CAST(src_port AS BIGINT) << 24) | (CAST(dst_port AS BIGINT) << 8) | protocol AS low FROM packets".replace("(src_ip << 32)", "CAST((CAST(src_ip AS HUGEINT) << 32) AS BIGINT)"))
def packed_keys(spark, d):
    return packets(spark, d).select(keys.packed_high().alias("high"), keys.packed_low().alias("low")).distinct()


@query(f"SELECT DISTINCT {K} FROM packets")
def unpacked_keys(spark, d):
    p = packets(spark, d).select(keys.packed_high().alias("h"), keys.packed_low().alias("x")).distinct()
    return p.select(*keys.unpacked("h", "x"))


@query("SELECT DISTINCT src_ip FROM packets")
def ip_numbers(spark, d):
    return packets(spark, d).select(keys.ip_text("src_ip").alias("t")).distinct().select(keys.ip_number("t").alias("src_ip"))


def _granular(n):
    cols = keys.GRANULARITY[n]
    sql = f"SELECT {', '.join(cols)}, CAST(count(*) AS BIGINT) AS size FROM packets GROUP BY {', '.join(cols)}"
    return cols, sql


@query(_granular(1)[1])
def key_src_only(spark, d):
    return flows.flow_size(packets(spark, d), 1)


@query(_granular(2)[1])
def key_ip_pair(spark, d):
    return flows.flow_size(packets(spark, d), 2)


@query(_granular(4)[1])
def key_four_tuple(spark, d):
    return flows.flow_size(packets(spark, d), 4)


@query("SELECT DISTINCT src_ip, " + ", ".join(f"CAST((src_ip >> {31 - k}) & 1 AS INTEGER) AS src_ip_{k}" for k in range(32)) + " FROM packets")
def ip_bits(spark, d):
    return packets(spark, d).select("src_ip").distinct().select("src_ip", *keys.bits("src_ip", 32))


@query("SELECT DISTINCT src_port, " + ", ".join(f"CAST((src_port >> {15 - k}) & 1 AS INTEGER) AS src_port_{k}" for k in range(16)) + " FROM packets")
def port_bits(spark, d):
    return packets(spark, d).select("src_port").distinct().select("src_port", *keys.bits("src_port", 16))


@query("SELECT seq, CAST(protocol = 1 AS INTEGER) AS protocol_icmp, CAST(protocol = 17 AS INTEGER) AS protocol_udp, CAST(protocol = 6 AS INTEGER) AS protocol_tcp FROM packets")
def protocol_onehot(spark, d):
    return packets(spark, d).select("seq", *keys.one_hot_protocol())


_VEC = " || ".join(f"CAST(({c} >> {n - 1 - k}) & 1 AS VARCHAR)" for c, n in (("src_ip", 32), ("dst_ip", 32), ("src_port", 16), ("dst_port", 16)) for k in range(n))


@query(f"SELECT DISTINCT flow_id, {_VEC} || CAST(CAST(protocol = 6 AS INTEGER) AS VARCHAR) || CAST(CAST(protocol = 17 AS INTEGER) AS VARCHAR) || CAST(CAST(protocol = 1 AS INTEGER) AS VARCHAR) AS vec FROM packets")
def key_vector(spark, d):
    v = packets(spark, d).select(*KEY).distinct().select(fk(), keys.model_input([]).alias("v"))
    return v.select("flow_id", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), "").alias("vec"))


@query(f"SELECT DISTINCT flow_id, {_VEC} || '1' AS vec FROM packets")
def key_vector_plain(spark, d):
    v = packets(spark, d).select(*KEY).distinct().select(fk(), keys.model_input([], key_only=True).alias("v"))
    return v.select("flow_id", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), "").alias("vec"))


@query("SELECT seq FROM packets WHERE protocol IN (6, 17) AND size >= 48")
def packet_filter(spark, d):
    return packets(spark, d).where(F.col("protocol").isin(6, 17) & (F.col("size") >= 48)).select("seq")


@query("SELECT flow_id, size FROM sizes WHERE size >= 10")
def min_packet_flows(spark, d):
    return sized(spark, d).where("size >= 10").select("flow_id", "size")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS clean FROM events")
def clean_non_finite(spark, d):
    x = F.when(F.col("event_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", F.when(F.abs(x) != float("inf"), x).alias("clean"))


@query("SELECT CAST(i AS INTEGER) AS i, round(sign(-1 + 2 * i / 9.0) * pow(abs(-1 + 2 * i / 9.0), 2.0) * 1.245 + 1.255, 6) AS x FROM range(10) t(i)")
def power_space(spark, d):
    a = spark.range(1).select(F.posexplode(models.power_space(0.01, 2.5, 10, 2.0)).alias("i", "x"))
    return a.select("i", r6("x", "x"))


@query("SELECT round(f, 2) AS fnr, round((0.05 - 0.02 * (1 - f)) / 0.98, 6) AS fpr, round(1 - (0.05 - ((0.05 - 0.02 * (1 - f)) / 0.98) * 0.98) / 0.02, 6) AS back FROM (SELECT i / 20.0 AS f FROM range(20) t(i))")
def coupled_rates(spark, d):
    t = spark.range(20).select((F.col("id") / 20.0).alias("f"))
    fpr = models.coupled_fpr(F.col("f"), 0.02, 0.05)
    return t.select(F.round("f", 2).alias("fnr"), r6(fpr, "fpr"), r6(models.coupled_fnr(fpr, 0.02, 0.05), "back"))


# -- aggregations ------------------------------------------------------------------------------------------------------


@query("SELECT flow_id, size FROM sizes")
def flow_size(spark, d):
    return flows.flow_size(packets(spark, d)).select(fk(), "size")


@query("SELECT flow_id, min(ts_us) AS first_us, max(ts_us) AS last_us, CAST(count(*) AS BIGINT) AS size FROM packets GROUP BY flow_id")
def flow_time_bounds(spark, d):
    return flows.time_bounds(packets(spark, d)).select(fk(), "first_us", "last_us", "size")


@query("SELECT seq, flow_id, CAST(rn AS INTEGER) AS rn, gap_us FROM ordered")
def flow_iat(spark, d):
    return flows.ordered(packets(spark, d)).select("seq", fk(), "rn", "gap_us")


@query("SELECT flow_id, round(coalesce(min(gap_us) / 1e6, -1), 6) AS min_iat, round(coalesce(max(gap_us) / 1e6, -1), 6) AS max_iat FROM ordered GROUP BY flow_id")
def iat_min_max(spark, d):
    return flows.gap_bounds(packets(spark, d)).select(fk(), r6("min_iat", "min_iat"), r6("max_iat", "max_iat"))


@query("SELECT flow_id, array_to_string(list(ts_us ORDER BY seq), ' ') AS times FROM packets GROUP BY flow_id")
def time_lists(spark, d):
    return flows.time_lists(packets(spark, d)).select(fk(), F.array_join(F.transform("times_us", lambda x: x.cast("string")), " ").alias("times"))


@query("SELECT flow_id, array_to_string(list(gap_us ORDER BY seq), ' ') AS gaps FROM ordered WHERE gap_us IS NOT NULL GROUP BY flow_id")
def iat_lists(spark, d):
    return flows.gap_lists(packets(spark, d)).select(fk(), F.array_join(F.transform("gaps_us", lambda x: x.cast("string")), " ").alias("gaps"))


def _oracle_row(n):
    at = lambda k, c: f"max(CASE WHEN rn = {k} THEN {c} END)"
    cols = [f"round({at(k + 1, 'gap_us / 1e6')}, 6) AS iat_{k}" for k in range(1, n)]
    cols += [f"{at(k, 'CASE WHEN protocol = 6 THEN flags END')} AS flags_{k}" for k in range(1, n + 1)] + [f"{at(k, 'size')} AS pk_size_{k}" for k in range(1, n + 1)]
    return f"SELECT flow_id, round(coalesce(min(gap_us) / 1e6, -1), 6) AS min_iat, round(coalesce(max(gap_us) / 1e6, -1), 6) AS max_iat, round(min(ts_us) / 1e6, 6) AS first_ts, round(max(ts_us) / 1e6, 6) AS last_ts, CAST(count(*) AS BIGINT) AS flow_size, {', '.join(cols)} FROM ordered GROUP BY flow_id"


@query(_oracle_row(5))
def oracle_row_5(spark, d):
    o = flows.oracle_row(packets(spark, d), 5)
    return o.select(fk(), *(r6(c, c) if "iat" in c or c.endswith("_ts") else F.col(c) for c in o.columns if c not in KEY))


@query("SELECT flow_id, round(avg(size), 6) AS mean_size, round(stddev_pop(size), 4) AS std_size, round(coalesce(avg(gap_us / 1e6), 0), 4) AS mean_iat, round(coalesce(stddev_pop(gap_us / 1e6), 0), 2) AS std_iat FROM ordered WHERE rn <= 5 GROUP BY flow_id HAVING count(*) = 5")
def first5_features(spark, d):
    f = flows.first_k_features(packets(spark, d), 5)
    return f.select(fk(), r6("mean_size", "mean_size"), F.round("std_size", 4).alias("std_size"), F.round("mean_iat", 4).alias("mean_iat"), F.round("std_iat", 2).alias("std_iat"))


def _seq_features(lo, hi):
    out = []
    for m in range(lo, hi):
        for c, name, dig in (("size", f"pk_size_{m}", 4), ("gap_us / 1e6", f"iat_{m}", 2)):
            x = f"CASE WHEN rn <= {m} THEN {c} END"
            out += [f"round(min({x}), 6) AS {name}_min", f"round(max({x}), 6) AS {name}_max", f"round(coalesce(sum({x}), 0), 6) AS {name}_sum", f"round(avg({x}), {dig}) AS {name}_mean", f"round(stddev_pop({x}), {dig}) AS {name}_std"]
    return f"SELECT flow_id, {', '.join(out)} FROM (SELECT *, CAST(size AS DOUBLE) AS s FROM ordered WHERE rn < {hi}) GROUP BY flow_id".replace("THEN size", "THEN s")


@query(_seq_features(2, 6))
def seq_agg_features(spark, d):
    f = flows.sequence_features(packets(spark, d).withColumn("size", F.col("size").cast("double")), 2, 6)
    dig = lambda c: 6 if c.rpartition("_")[2] in ("min", "max", "sum") else 2 if c.startswith("iat") else 4
    return f.select(fk(), *(F.round(c, dig(c)).alias(c) for c in f.columns if c not in KEY))


BIT = lambda b: f"CAST(flags >= 64 OR (flags & {b}) <> 0 AS INTEGER)"


@query(f"SELECT flow_id, CAST(CASE WHEN any_value(protocol) = 6 THEN sum({BIT(2)} * {BIT(16)}) ELSE -1 END AS BIGINT) AS count_synack, CAST(CASE WHEN any_value(protocol) = 6 THEN sum(greatest({BIT(8)}, {BIT(4)})) ELSE -1 END AS BIGINT) AS count_pshecerst FROM ordered WHERE rn < 6 GROUP BY flow_id")
def flag_counts(spark, d):
    f = flows.flag_counts(packets(spark, d), 6)
    return f.select(fk(), F.col("count_synack").cast("long").alias("count_synack"), F.col("count_pshecerst").cast("long").alias("count_pshecerst"))


@query(f"{LABELLED} SELECT flow_id, size, cutoff, heavy FROM labelled")
def elephant_labels(spark, d):
    return labelled(spark, d).select("flow_id", "size", "cutoff", "heavy")


@query(f"{LABELLED} SELECT flow_id, size, heavy FROM labelled WHERE size >= 5")
def label_min5(spark, d):
    return labels.label_elephants(sized(spark, d), P, at_least=5).select("flow_id", "size", "heavy")


_DAYS = "days AS (SELECT CAST(floor(ts_us / 86400000000) AS BIGINT) AS day, flow_id, CAST(count(*) AS BIGINT) AS size FROM packets GROUP BY 1, 2)"


@query(f"{_DAYS} SELECT d.day, d.flow_id, d.size, CAST(d.size > c.cutoff AS INTEGER) AS heavy FROM days d JOIN (SELECT day, quantile_cont(size, 0.95) AS cutoff FROM days GROUP BY day) c ON d.day = c.day")
def per_day_cutoff(spark, d):
    s = packets(spark, d).groupBy(F.floor(F.col("ts_us") / 86_400_000_000).alias("day"), fk()).agg(F.count("*").alias("size"))
    return labels.label_elephants(s, 95, ["day"]).select("day", "flow_id", "size", "heavy")


@query(f"SELECT flow_id, q, round(list_sort(list(gap_us))[CAST(floor(q * (count(*) - 1)) AS INTEGER) + 1] / 1e6, 6) AS iat FROM ordered, {QSQL} WHERE gap_us IS NOT NULL GROUP BY flow_id, q")
def iat_floor_quantiles(spark, d):
    g = labels.floor_rank(flows.ordered(packets(spark, d)).where("gap_us IS NOT NULL"), list(KEY), "gap_us", QS)
    return g.select(fk(), "q", F.round(F.col("value") / 1e6, 6).alias("iat"))


@query("SELECT size, CAST(n AS BIGINT) AS n_flows, round(sum(n) OVER (ORDER BY size) / sum(n) OVER (), 6) AS cdf FROM (SELECT size, count(*) AS n FROM sizes GROUP BY size)")
def size_cdf(spark, d):
    return labels.size_cdf(sized(spark, d)).select("size", "n_flows", r6("cdf", "cdf"))


@query("SELECT size, CAST(n AS BIGINT) AS n_flows, round(size * n / sum(size * n) OVER (), 6) AS share, round(sum(size * n) OVER (ORDER BY size) / sum(size * n) OVER (), 6) AS cum_share FROM (SELECT size, count(*) AS n FROM sizes GROUP BY size)")
def traffic_share(spark, d):
    return labels.traffic_share(sized(spark, d)).select("size", "n_flows", r6("share", "share"), r6("cum_share", "cum_share"))


@query("SELECT protocol, CAST(count(*) AS BIGINT) AS n_flows, CAST(count(CASE WHEN size >= 5 THEN 1 END) AS BIGINT) AS n_flows_5 FROM sizes GROUP BY protocol")
def protocol_mix(spark, d):
    return sized(spark, d).groupBy("protocol").agg(F.count("*").alias("n_flows"), F.count(F.when(F.col("size") >= 5, 1)).alias("n_flows_5"))


@query("SELECT protocol, heavy5, quantile_cont(size, 0.99) AS cutoff, CAST(count(*) AS BIGINT) AS n FROM (SELECT protocol, size >= 5 AS heavy5, size FROM sizes) GROUP BY GROUPING SETS ((), (protocol), (protocol, heavy5))")
def cutoff_grouping_sets(spark, d):
    s = sized(spark, d).withColumn("heavy5", F.col("size") >= 5)
    return s.groupingSets([[], ["protocol"], ["protocol", "heavy5"]], "protocol", "heavy5").agg(F.percentile("size", F.lit(0.99)).alias("cutoff"), F.count("*").alias("n"))


@query("SELECT protocol, round(avg(CAST(size < 10 AS INTEGER)), 6) AS share FROM sizes GROUP BY protocol")
def share_below_k(spark, d):
    return sized(spark, d).groupBy("protocol").agg(r6(F.avg((F.col("size") < 10).cast("int")), "share"))


@query("SELECT flow_id, size FROM sizes ORDER BY size DESC, flow_id LIMIT 10")
def top10_flows(spark, d):
    return sized(spark, d).select("flow_id", "size").orderBy(F.desc("size"), "flow_id").limit(10)


@query("s AS (SELECT seq, CASE WHEN rn = 1 AND NOT has_fin_rst THEN 1 WHEN rn = 5 OR (rn < 5 AND rn > 1 AND has_fin_rst) THEN -1 ELSE 0 END AS step FROM ordered WHERE rn <= 5) SELECT CAST(greatest(max(run), 0) AS BIGINT) AS max_open FROM (SELECT sum(step) OVER (ORDER BY seq) AS run FROM s)")
def max_concurrent(spark, d):
    return flows.max_concurrent(packets(spark, d))


@query("SELECT round(coalesce(greatest(max(gap_us) / 1e6, 0), 0), 6) AS max_iat FROM ordered")
def max_iat(spark, d):
    return flows.max_gap(packets(spark, d)).select(r6("max_iat", "max_iat"))


@query("SELECT flow_id, min(ts_us) AS first_us, max(ts_us) AS kth_us FROM ordered WHERE rn <= 5 GROUP BY flow_id")
def cache_span(spark, d):
    return flows.cache_span(packets(spark, d)).select(fk(), "first_us", "kth_us")


@query("SELECT protocol, quantile_cont(size, 0.5) AS median, round(avg(size), 6) AS mean FROM sizes GROUP BY protocol")
def median_and_mean(spark, d):
    return sized(spark, d).groupBy("protocol").agg(F.median("size").alias("median"), r6(F.avg("size"), "mean"))


@query("SELECT CAST(count(DISTINCT flow_id) AS BIGINT) AS n_flows, CAST(count(DISTINCT src_ip) AS BIGINT) AS n_sources FROM packets")
def distinct_flows(spark, d):
    return packets(spark, d).agg(F.countDistinct(*KEY).alias("n_flows"), F.countDistinct("src_ip").alias("n_sources"))


_SLOW = "slow AS (SELECT flow_id, size, 1 + (size % 7) / 2.0 AS slowdown FROM sizes)"


@query(f"{_SLOW}, c AS (SELECT quantile_cont(size, 0.99) AS cut FROM slow) SELECT round(avg(slowdown), 6) AS overall, round(coalesce(avg(CASE WHEN size >= cut THEN slowdown END), 0), 6) AS elephants, round(coalesce(avg(CASE WHEN size < cut THEN slowdown END), 0), 6) AS mice FROM slow, c")
def slowdown_by_class(spark, d):
    s = sized(spark, d).withColumn("slowdown", 1 + (F.col("size") % 7) / 2.0)
    return metrics.slowdown(s).select(*(r6(c, c) for c in ("overall", "elephants", "mice")))


@query(f"{_SLOW} SELECT CAST(size % 3 AS BIGINT) AS load, round(avg(slowdown), 6) AS slowdown FROM slow GROUP BY 1")
def slowdown_by_load(spark, d):
    s = sized(spark, d).withColumn("slowdown", 1 + (F.col("size") % 7) / 2.0)
    return s.groupBy((F.col("size") % 3).alias("load")).agg(r6(F.avg("slowdown"), "slowdown"))


@query("t AS (SELECT list_sort(list(size))[CAST(floor(0.99 * (count(*) - 1)) AS INTEGER) + 1] AS threshold FROM sizes WHERE size >= 5) SELECT flow_id, CASE WHEN size < 5 THEN 0 WHEN size >= threshold THEN 2 ELSE 1 END AS priority FROM sizes, t")
def flow_priority(spark, d):
    s = sized(spark, d)
    t = metrics.size_threshold(s, 0.99, 5)
    return metrics.priority(s.crossJoin(F.broadcast(t)), F.col("threshold"), 5).select("flow_id", "priority")  # a single row


# -- joins, set operations and samples ---------------------------------------------------------------------------------


@query("SELECT flow_id FROM sizes WHERE protocol = 6 AND size >= 10 INTERSECT SELECT flow_id FROM packets WHERE flags >= 90")
def flows_intersect(spark, d):
    return sized(spark, d).where("protocol = 6 AND size >= 10").select("flow_id").intersect(packets(spark, d).where("flags >= 90").select(fk()))


@query(f"{LABELLED} SELECT flow_id FROM sizes EXCEPT SELECT flow_id FROM labelled WHERE heavy = 1")
def flows_except_elephants(spark, d):
    x = labelled(spark, d)
    return x.select("flow_id").subtract(x.where("heavy = 1").select("flow_id"))


@query("SELECT s.flow_id, s.size, t.flow_id IS NOT NULL AS matched FROM sizes s LEFT JOIN (SELECT flow_id FROM sizes WHERE size >= 12) t USING (flow_id)")
def cascade_match_split(spark, d):
    s = sized(spark, d).select("flow_id", "size")
    return models.cascade_split(s, s.where("size >= 12"), ["flow_id"])


@query(f"c AS (SELECT flow_id, 0.75 AS proba FROM sizes WHERE size % 2 = 0) SELECT s.flow_id, c.flow_id IS NOT NULL AS from_cache, round(coalesce(c.proba, s.size / 100.0), 6) AS proba, CAST(coalesce(c.proba, s.size / 100.0) > 0.5 AS INTEGER) AS predicted FROM sizes s LEFT JOIN c USING (flow_id)")
def cached_predictions(spark, d):
    s = sized(spark, d)
    c = s.where("size % 2 = 0").select("flow_id", F.lit(0.75).alias("proba"))
    return models.cached(s, c, F.col("size") / 100.0, 0.5).select("flow_id", "from_cache", r6("proba", "proba"), "predicted")


@query(f"{LABELLED} SELECT flow_id, heavy AS predicted FROM labelled")
def oracle_predictions(spark, d):
    x = labelled(spark, d)
    return models.truth(sized(spark, d), x).select("flow_id", "predicted")


@query("SELECT flow_id, 0 AS predicted FROM sizes")
def constant_predictions(spark, d):
    return models.constant(sized(spark, d)).select("flow_id", "predicted")


@query(f"SELECT flow_id FROM sizes WHERE {UNIFORM(chr(39) + 'sample' + chr(39) + ' || flow_id')} < 0.3")
def hash_sample(spark, d):
    return models.sample_share(sized(spark, d), 0.3).select("flow_id")


@query(f"{LABELLED} SELECT flow_id, CAST(floor({UNIFORM(chr(39) + 'fold42' + chr(39) + ' || flow_id')} * 5) AS INTEGER) AS fold FROM labelled")
def hash_folds(spark, d):
    return models.folds(sized(spark, d), 5).select("flow_id", "fold")


@query(f"SELECT flow_id, CASE WHEN row_number() OVER (ORDER BY {UNIFORM(chr(39) + 'evict' + chr(39) + ' || flow_id')}, flow_id) <= floor(count(*) OVER () * 0.2) THEN 0.0::DOUBLE ELSE round(size / 100.0, 6) END AS proba FROM sizes")
def zeroed_evictions(spark, d):
    s = sized(spark, d).select("flow_id", r6(F.col("size") / 100.0, "proba"))
    return models.zero_evicted(s, 0.2)


@query("SELECT flow_id, CAST(dense_rank() OVER (ORDER BY protocol) AS INTEGER) AS grp FROM sizes")
def group_ids(spark, d):
    s = sized(spark, d)
    ids = s.select("protocol").distinct().select("protocol", F.dense_rank().over(Window.orderBy("protocol")).alias("grp"))
    return s.join(F.broadcast(ids), "protocol").select("flow_id", "grp")  # a row for each protocol number, 256 at most


# -- sketches and bounded structures -----------------------------------------------------------------------------------

R, C = 2, 64
CELLS = f"""hits AS (SELECT flow_id, size, r AS row, {BUCKET('r', 'flow_id', C)} AS col FROM sizes, range({R}) t(r)),
cells AS (SELECT CAST(row AS INTEGER) AS row, col, CAST(least(sum(size), CASE WHEN row = 0 THEN 16777215 ELSE 65535 END) AS BIGINT) AS cnt FROM hits GROUP BY row, col)"""
EST = f"{CELLS}, est AS (SELECT h.flow_id, min(CASE WHEN h.row = 0 OR c.cnt < 65535 THEN c.cnt END) AS estimate FROM hits h JOIN cells c ON h.row = c.row AND h.col = c.col GROUP BY h.flow_id)"


def _cells(spark, d):
    return sketches.cms_cells(sized(spark, d), R, C)


@query(f"{CELLS} SELECT row, col, cnt FROM cells")
def cms_cells(spark, d):
    return _cells(spark, d)


@query(f"{EST} SELECT flow_id, estimate FROM est")
def cms_estimates(spark, d):
    return sketches.cms_estimates(sized(spark, d), _cells(spark, d), R, C)


@query(f"{CELLS} SELECT round(count(*) / {R * C}.0, 6) AS load, CAST(count(DISTINCT col) AS BIGINT) AS used_cols FROM cells WHERE cnt > 0")
def cms_load(spark, d):
    return sketches.cms_load(_cells(spark, d), R, C).select(r6("load", "load"), "used_cols")


@query(f"""h AS (SELECT flow_id, r AS row, {BUCKET('r', 'flow_id', C)} AS col, size FROM sizes, range({R}) t(r)),
on_ AS (SELECT DISTINCT row, col FROM h WHERE size >= 15) SELECT h.flow_id, bool_and(o.col IS NOT NULL) AS present FROM h LEFT JOIN on_ o ON h.row = o.row AND h.col = o.col GROUP BY h.flow_id""")
def cms_as_filter(spark, d):
    s = sized(spark, d)
    return sketches.cms_member(s, sketches.cms_cells(s.where("size >= 15"), R, C), R, C)


BM, BK = sketches.bloom_size(200, 0.05)
BLOOM = f"""asked AS (SELECT flow_id, size, k AS part, {BUCKET("'b' || k", 'flow_id', BM // BK)} AS idx FROM sizes, range({BK}) t(k)),
bits AS (SELECT DISTINCT part, idx FROM asked WHERE size >= 15),
probe AS (SELECT a.flow_id, bool_and(b.idx IS NOT NULL) AS hit FROM asked a LEFT JOIN bits b ON a.part = b.part AND a.idx = b.idx GROUP BY a.flow_id)"""


@query(f"{BLOOM} SELECT flow_id, hit FROM probe")
def bloom_probe(spark, d):
    s = sized(spark, d)
    return sketches.bloom_probe(s, sketches.bloom_bits(s.where("size >= 15"), BM, BK), BM, BK)


@query(f"{BLOOM} SELECT CAST(count(*) AS BIGINT) AS probed, CAST(coalesce(sum(CAST(hit AS BIGINT)), 0) AS BIGINT) AS false_hits FROM probe JOIN sizes USING (flow_id) WHERE size < 15")
def bloom_fp(spark, d):
    s = sized(spark, d)
    members = s.where("size >= 15")
    return sketches.bloom_false_positives(sketches.bloom_probe(s, sketches.bloom_bits(members, BM, BK), BM, BK), members)


T, TR, TS = 2, 4, 2
ADMIT = f"""a0 AS (SELECT flow_id, seq, {BUCKET("'t0'", 'flow_id', TR)} AS bucket FROM arrive),
b0 AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS slot FROM a0),
a1 AS (SELECT flow_id, seq, {BUCKET("'t1'", 'flow_id', TR)} AS bucket FROM b0 WHERE slot > {TS}),
b1 AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS slot FROM a1),
placed AS (SELECT flow_id, seq, 0 AS table_idx, bucket FROM b0 WHERE slot <= {TS} UNION ALL SELECT flow_id, seq, 1, bucket FROM b1 WHERE slot <= {TS}
  UNION ALL SELECT flow_id, seq, NULL, NULL FROM b1 WHERE slot > {TS})"""
ARRIVE = f"{LABELLED}, arrive AS (SELECT o.flow_id, o.seq FROM ordered o JOIN labelled l USING (flow_id) WHERE o.rn = 5 AND l.heavy = 1)"


def _placed(spark, d):
    fm = flow_manager.infinite(packets(spark, d), 5).where("outcome = 'collected'")
    return sketches.admit(fm.join(labelled(spark, d).where("heavy = 1").select("flow_id"), "flow_id", "left_semi"), T, TR, TS)


@query(f"{ARRIVE}, {ADMIT} SELECT flow_id, seq, table_idx, bucket FROM placed")
def ht_admission(spark, d):
    return _placed(spark, d)


@query(f"{ARRIVE}, {ADMIT} SELECT round(count(table_idx) / {T * TR * TS}.0, 6) AS load, CAST(coalesce(sum(CAST(table_idx IS NULL AS BIGINT)), 0) AS BIGINT) AS discarded FROM placed")
def ht_load(spark, d):
    return sketches.table_load(_placed(spark, d), T, TR, TS).select(r6("load", "load"), F.coalesce("discarded", F.lit(0)).alias("discarded"))


BINS, MICE = sketches.LogBins(2_592_000.0, 1.0, 32), sketches.LogBins(2_592_000.0, 1.0, 31)
_G = "gaps AS (SELECT flow_id, seq, gap_us / 1e6 AS x FROM ordered WHERE gap_us IS NOT NULL)"


def _dd(bins, bits, source="gaps", name="dd"):
    import math

    b = f"CASE WHEN x < {bins.least} THEN {sketches.ZERO} ELSE CAST(greatest(least(ceil(log2(x) / {math.log2(bins.gamma)!r}), {bins.high}), {bins.low}) AS INTEGER) END"
    return f"""{name}_v AS (SELECT *, {b} AS bin FROM {source}),
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY flow_id, bin ORDER BY seq) AS nth FROM {name}_v),
{name}_f AS (SELECT *, min(CASE WHEN bin <> {sketches.ZERO} AND nth = {(1 << bits) - 1} THEN seq END) OVER (PARTITION BY flow_id) AS froze FROM {name}_n),
{name}_c AS (SELECT flow_id, bin, CAST(count(*) AS BIGINT) AS cnt FROM {name}_f WHERE froze IS NULL OR seq <= froze GROUP BY flow_id, bin),
{name}_r AS (SELECT *, sum(cnt) OVER (PARTITION BY flow_id ORDER BY bin) AS run, sum(cnt) OVER (PARTITION BY flow_id) AS n FROM {name}_c),
{name}_q AS (SELECT flow_id, q, min(bin) AS bin FROM {name}_r, {QSQL} WHERE run > q * (n - 1) GROUP BY flow_id, q),
{name} AS (SELECT flow_id, q, CASE WHEN bin = {sketches.ZERO} THEN 0 ELSE 2 * pow({bins.gamma!r}, bin) / {bins.gamma + 1!r} END AS value FROM {name}_q)"""


@query(f"{_G}, {_dd(BINS, 16)} SELECT flow_id, bin, cnt FROM dd_c")
def ddsketch_bins(spark, d):
    return sketches.quantile_bins(pipelines.gaps(packets(spark, d)), BINS, 16)


@query(f"{_G}, {_dd(BINS, 16)} SELECT flow_id, q, round(value, 4) AS value FROM dd")
def ddsketch_quantiles(spark, d):
    c = sketches.quantile_bins(pipelines.gaps(packets(spark, d)), BINS, 16)
    return sketches.quantiles(c, BINS, QS).select("flow_id", "q", F.round("value", 4).alias("value"))


@query(f"{_G}, {_dd(BINS, 2)} SELECT flow_id, any_value(froze) AS froze, CAST(count(CASE WHEN froze IS NULL OR seq <= froze THEN 1 END) AS BIGINT) AS kept FROM dd_f GROUP BY flow_id")
def ddsketch_frozen(spark, d):
    f = sketches.freeze_seq(pipelines.gaps(packets(spark, d)), BINS, 2)
    return f.groupBy("flow_id").agg(F.max("froze").alias("froze"), F.count(F.when(F.col("froze").isNull() | (F.col("seq") <= F.col("froze")), 1)).alias("kept"))


@query(f"{_G}, {_dd(BINS, 16)} SELECT flow_id, CAST(count(*) AS BIGINT) AS used, round(count(*) / 32.0, 6) AS share FROM dd_c WHERE bin <> {sketches.ZERO} GROUP BY flow_id")
def ddsketch_sparsity(spark, d):
    c = sketches.quantile_bins(pipelines.gaps(packets(spark, d)), BINS, 16)
    return sketches.sparsity(c, 32).where("used > 0").select("flow_id", "used", r6("share", "share"))


# -- flow managers -----------------------------------------------------------------------------------------------------


@query("SELECT flow_id, CASE WHEN max(rn) = 5 THEN 'collected' ELSE 'resident' END AS outcome, max(seq) AS seq, max_by(ts_us, seq) AS ts_us, CAST(max(rn) AS INTEGER) AS n_pkts FROM ordered WHERE rn <= 5 GROUP BY flow_id")
def infinite_fm_outcome(spark, d):
    return flow_manager.infinite(packets(spark, d), 5)


@query("SELECT flow_id, CAST(count(*) AS BIGINT) AS passed FROM ordered WHERE rn > 5 GROUP BY flow_id")
def fm_passed_on(spark, d):
    return flow_manager.passed_on(packets(spark, d), 5).groupBy(fk()).agg(F.count("*").alias("passed"))


@query("c AS (SELECT flow_id, rn, sum(CAST(rn = 1 AS BIGINT)) OVER (ORDER BY seq) AS c FROM ordered) SELECT flow_id, CAST(max(c) - min(c) AS BIGINT) AS new_flows FROM c WHERE rn IN (1, 5) GROUP BY flow_id HAVING count(*) = 2")
def fm_new_flows_while_cached(spark, d):
    return flow_manager.new_flows_while_cached(packets(spark, d), 5)


@query("SELECT flow_id, round(avg(size), 6) AS mean_size, round(stddev_pop(size), 4) AS std_size, round(coalesce(avg(gap_us / 1e6), 0), 4) AS mean_iat FROM ordered WHERE rn <= 5 GROUP BY flow_id HAVING count(*) = 5")
def stream_first5_features(spark, d):
    f = streams.drain(streams.first_k_features(streams.packet_stream(spark, d), 5), streams.work_dir(spark))
    return f.select("flow_id", r6("mean_size", "mean_size"), F.round("std_size", 4).alias("std_size"), F.round("mean_iat", 4).alias("mean_iat"))


@query("SELECT flow_id, CAST(sum(size) AS BIGINT) AS size FROM sizes GROUP BY flow_id")
def stream_day_sizes(spark, d):
    """Daily sizes of the stream, added up; the complete table is written by the last batch."""
    path = streams.work_dir(spark)
    daily = streams.windowed_sizes(streams.packet_stream(spark, d), "1 day")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/sizes")

    daily.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/sizes").groupBy(flow_id().alias("flow_id")).agg(F.sum("size").alias("size"))


# -- classifiers and their quality -------------------------------------------------------------------------------------

FNR, FPR = 0.2, 0.1
SYNTH = f"{LABELLED}, pred AS (SELECT flow_id, size, heavy, CAST(CASE WHEN heavy = 1 THEN {UNIFORM('flow_id')} > {FNR} ELSE {UNIFORM('flow_id')} < {FPR} END AS INTEGER) AS predicted FROM labelled)"
TREES = f"trees AS (SELECT flow_id, t AS tree, round({UNIFORM(chr(39) + 'tree' + chr(39) + ' || t || flow_id')}, 3) AS proba FROM sizes, range(7) x(t))"
SCORES = f"{LABELLED}, scores AS (SELECT flow_id, heavy, round(0.3 * heavy + 0.7 * {UNIFORM(chr(39) + 'score' + chr(39) + ' || flow_id')}, 2) AS proba FROM labelled)"


def _synth(spark, d):
    return models.synthetic_rates(labelled(spark, d), FNR, FPR)


def _trees(spark, d):
    s = sized(spark, d).select("flow_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("tree"))
    return s.withColumn("proba", F.round(keys.uniform(F.concat(F.lit("tree"), F.col("tree"), F.col("flow_id"))), 3))


def _scores(spark, d):
    return labelled(spark, d).select("flow_id", "heavy", F.round(0.3 * F.col("heavy") + 0.7 * keys.uniform("flow_id", "score"), 2).alias("proba"))


@query(f"{SYNTH} SELECT flow_id, predicted FROM pred")
def synthetic_rates(spark, d):
    return _synth(spark, d).select("flow_id", "predicted")


MATRIX = "m AS (SELECT CAST(count(CASE WHEN heavy = 1 AND predicted = 1 THEN 1 END) AS BIGINT) AS tp, CAST(count(CASE WHEN heavy = 0 AND predicted = 1 THEN 1 END) AS BIGINT) AS fp, CAST(count(CASE WHEN heavy = 0 AND predicted = 0 THEN 1 END) AS BIGINT) AS tn, CAST(count(CASE WHEN heavy = 1 AND predicted = 0 THEN 1 END) AS BIGINT) AS fn FROM pred)"


@query(f"{SYNTH}, {MATRIX} SELECT * FROM m")
def confusion(spark, d):
    return metrics.confusion(_synth(spark, d))


@query(f"{SYNTH}, {MATRIX} SELECT round(tp / nullif(tp + fn, 0), 6) AS tpr, round(tn / nullif(tn + fp, 0), 6) AS tnr, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS fnr FROM m")
def rates(spark, d):
    return metrics.rates(metrics.confusion(_synth(spark, d))).select(*(r6(c, c) for c in ("tpr", "tnr", "fpr", "fnr")))


@query(f"{SYNTH}, {MATRIX}, x AS (SELECT coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM m) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM x")
def precision_recall_f1(spark, d):
    return metrics.precision_recall_f1(metrics.confusion(_synth(spark, d))).select(*(r6(c, c) for c in ("precision", "recall", "f1")))


@query(f"{SYNTH} SELECT round(avg(predicted), 6) AS share FROM pred")
def predicted_share(spark, d):
    return _synth(spark, d).agg(r6(F.avg("predicted"), "share"))


CURVE = "per AS (SELECT proba, sum(heavy) AS pos, count(*) AS n FROM scores GROUP BY proba), cum AS (SELECT proba, sum(pos) OVER (ORDER BY proba DESC) AS tp, sum(n) OVER (ORDER BY proba DESC) AS k, sum(pos) OVER () AS p FROM per), curve AS (SELECT proba AS threshold, tp / k AS precision, tp / nullif(p, 0) AS recall FROM cum)"


@query(f"{SCORES}, {CURVE} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve")
def pr_curve(spark, d):
    return metrics.pr_curve(_scores(spark, d)).select("threshold", r6("precision", "precision"), r6("recall", "recall"))


@query(f"{SCORES}, {CURVE} SELECT round(sum((recall - before) * precision), 6) AS ap FROM (SELECT *, coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0) AS before FROM curve)")
def average_precision(spark, d):
    return metrics.average_precision(_scores(spark, d)).select(r6("ap", "ap"))


@query(f"{TREES} SELECT flow_id, round(avg(CAST(proba >= 0.5 AS INTEGER)), 6) AS share, CAST(avg(CAST(proba >= 0.5 AS INTEGER)) >= 0.5 AS INTEGER) AS predicted FROM trees GROUP BY flow_id")
def voting_vote(spark, d):
    return models.vote(_trees(spark, d), 0.5).select("flow_id", r6("share", "share"), "predicted")


@query(f"{TREES}, v AS (SELECT flow_id, count(*) AS n, count(*) - sum(CAST(proba >= 0.5 AS INTEGER)) AS z FROM trees GROUP BY flow_id) SELECT flow_id, round(abs(n - 2 * (CASE WHEN z = 0 OR z = n THEN 1 ELSE z + 1 END)) / n, 6) AS agreement FROM v")
def tree_agreement(spark, d):
    v = _trees(spark, d).withColumn("vote", (F.col("proba") >= 0.5).cast("int"))
    return models.agreement(v).select("flow_id", r6("agreement", "agreement"))


@query(f"{TREES}, v AS (SELECT flow_id, count(*) AS n, count(*) - sum(CAST(proba >= 0.5 AS INTEGER)) AS z FROM trees GROUP BY flow_id) SELECT flow_id FROM v ORDER BY abs(n - 2 * (CASE WHEN z = 0 OR z = n THEN 1 ELSE z + 1 END)) / n, flow_id LIMIT 20")
def hardest_samples(spark, d):
    v = _trees(spark, d).withColumn("vote", (F.col("proba") >= 0.5).cast("int"))
    return models.hardest(models.agreement(v), 20).select("flow_id")


@query(f"{TREES} SELECT flow_id, round(avg(proba), 6) AS p1, CAST(1 - avg(proba) < 3 * avg(proba) AS INTEGER) AS label FROM trees GROUP BY flow_id")
def meta_cost_labels(spark, d):
    return models.meta_cost(_trees(spark, d), ((0.0, 3.0), (1.0, 0.0))).select("flow_id", r6("p1", "p1"), "label")


_TS = f"tree_scores AS (SELECT CAST(tree AS INTEGER) AS tree, round(avg(proba), 2) AS score, CAST(count(*) AS BIGINT) AS bits FROM trees GROUP BY tree)"


def _tree_scores(spark, d):
    return _trees(spark, d).groupBy("tree").agg(F.round(F.avg("proba"), 2).alias("score"), F.count("*").alias("bits"))


@query(f"{TREES}, {_TS} SELECT tree, score FROM (SELECT *, rank() OVER (ORDER BY score DESC) AS r FROM tree_scores) WHERE r <= 3")
def best_trees(spark, d):
    return models.best_trees(_tree_scores(spark, d), 3).select("tree", "score")


@query(f"{TREES}, {_TS}, b AS (SELECT *, sum(bits) OVER (ORDER BY score DESC, tree ROWS UNBOUNDED PRECEDING) - bits AS before, row_number() OVER (ORDER BY score DESC, tree) AS nth FROM tree_scores) SELECT tree, score, bits FROM b WHERE before < (SELECT 3 * max(bits) FROM tree_scores) OR nth <= 2")
def pruned_forest(spark, d):
    t = _tree_scores(spark, d)
    n = sized(spark, d).count()
    return models.prune_to_size(t, 3 * n)


@query("nodes AS (SELECT CAST(l_suppkey % 5 AS BIGINT) AS tree, l_linenumber >= 4 AS leaf FROM lineitem) SELECT tree, CAST(sum(CAST(NOT leaf AS BIGINT)) AS BIGINT) AS inner_nodes, CAST(sum(CAST(leaf AS BIGINT)) AS BIGINT) AS leaves, CAST(sum(CAST(NOT leaf AS BIGINT)) * (7 + 32 + ceil(log2(count(*)))) + sum(CAST(leaf AS BIGINT)) AS BIGINT) AS bits FROM nodes GROUP BY tree")
def tree_sizes(spark, d):
    n = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("tree"), (F.col("l_linenumber") >= 4).alias("is_leaf"))
    return models.full_tree_bits(n, 7, 32).select("tree", F.col("inner").alias("inner_nodes"), "leaves", F.col("bits").cast("long").alias("bits"))


@query(f"{LABELLED}, h AS (SELECT avg(heavy) AS h FROM labelled) SELECT CAST(f AS DOUBLE) AS fnr, round((0.08 - h * (1 - f)) / (1 - h), 6) AS fpr FROM h, (VALUES (0.0), (0.1), (0.2), (0.5)) AS t(f)")
def fnr_to_fpr(spark, d):
    return models.rate_table(labelled(spark, d), 0.08, [0.0, 0.1, 0.2, 0.5]).select("fnr", r6("fpr", "fpr"))


# -- pipelines and errors ----------------------------------------------------------------------------------------------

CONFIG = pipelines.FseConfig(5, R, C, T, TR, TS)


def _fse_sql(predicted: str) -> str:
    """The size pipeline with the unbounded manager; `predicted` is a relation (flow_id, predicted)."""
    return f"""{predicted}, arrive AS (SELECT o.flow_id, o.seq FROM ordered o JOIN pred p USING (flow_id) WHERE o.rn = 5 AND p.predicted = 1), {ADMIT},
res AS (SELECT flow_id, size FROM sizes WHERE size < 5),
counted AS (SELECT s.flow_id, s.size FROM sizes s WHERE size >= 5 AND flow_id NOT IN (SELECT flow_id FROM placed WHERE table_idx IS NOT NULL)),
hits AS (SELECT flow_id, size, r AS row, {BUCKET('r', 'flow_id', C)} AS col FROM counted, range({R}) t(r)),
cells AS (SELECT row, col, least(sum(size), CASE WHEN row = 0 THEN 16777215 ELSE 65535 END) AS cnt FROM hits GROUP BY row, col),
cms AS (SELECT h.flow_id, min(CASE WHEN h.row = 0 OR c.cnt < 65535 THEN c.cnt END) AS size FROM hits h JOIN cells c ON h.row = c.row AND h.col = c.col GROUP BY h.flow_id),
resolved AS (SELECT s.flow_id, s.size AS v, CAST(CASE WHEN x.flow_id IS NOT NULL THEN s.size WHEN t.flow_id IS NOT NULL THEN s.size WHEN c.flow_id IS NOT NULL THEN c.size ELSE coalesce(r.size, 0) END AS BIGINT) AS estimate,
  CASE WHEN x.flow_id IS NOT NULL THEN 'discarded' WHEN t.flow_id IS NOT NULL THEN 'ht' WHEN c.flow_id IS NOT NULL THEN 'cms' WHEN r.flow_id IS NOT NULL THEN 'fm' ELSE 'none' END AS sector
  FROM sizes s LEFT JOIN (SELECT flow_id FROM placed WHERE table_idx IS NULL) x USING (flow_id) LEFT JOIN (SELECT flow_id FROM placed WHERE table_idx IS NOT NULL) t USING (flow_id)
  LEFT JOIN cms c USING (flow_id) LEFT JOIN res r USING (flow_id))"""


ORACLE_PRED = f"{LABELLED}, pred AS (SELECT flow_id, heavy AS predicted FROM labelled)"
ERRORS = "SELECT round(sum(v * abs(v - estimate)) / sum(v), 6) AS awae, round(sum(abs(v - estimate)) / count(*), 6) AS aae, round(sum(abs(v - estimate) / v) / count(*), 6) AS are FROM resolved"


def _fse(spark, d, predicted):
    s = pipelines.sizes(packets(spark, d))
    e = pipelines.estimate_sizes(s, flow_manager.infinite(packets(spark, d), 5), predicted, CONFIG)
    return metrics.resolve(s, e.table, e.cms, e.manager, e.discarded, 5), e


def _truth(spark, d):
    return labelled(spark, d).select("flow_id", F.col("heavy").alias("predicted"))


def _errors(resolved):
    return metrics.errors(resolved).select(*(r6(c, c) for c in ("awae", "aae", "are")))


@query(f"{_fse_sql(ORACLE_PRED)} SELECT flow_id, v, estimate, sector FROM resolved")
def fse_estimates_oracle(spark, d):
    return _fse(spark, d, _truth(spark, d))[0]


@query(f"{_fse_sql(ORACLE_PRED)} {ERRORS}")
def fse_awae_oracle(spark, d):
    return _errors(_fse(spark, d, _truth(spark, d))[0])


@query(f"{_fse_sql(SYNTH)} {ERRORS}")
def fse_awae_synth_rates(spark, d):
    return _errors(_fse(spark, d, _synth(spark, d))[0])


@query(f"{_fse_sql(SYNTH)} SELECT sector, CAST(count(*) AS BIGINT) AS flows, round(sum(v * abs(v - estimate)) / (SELECT sum(v) FROM resolved), 6) AS share_of_awae FROM resolved GROUP BY sector")
def fse_error_by_sector(spark, d):
    return metrics.errors_by_sector(_fse(spark, d, _synth(spark, d))[0]).select("sector", "flows", r6("share_of_awae", "share_of_awae"))


@query(f"{EST}, resolved AS (SELECT s.flow_id, s.size AS v, e.estimate FROM sizes s JOIN est e USING (flow_id)) {ERRORS}")
def baseline_awae(spark, d):
    s = sized(spark, d)
    e = sketches.cms_estimates(s, _cells(spark, d), R, C)
    return _errors(s.select("flow_id", F.col("size").alias("v")).join(e, "flow_id"))


@query(f"{EST} SELECT s.flow_id, s.size AS v, e.estimate FROM sizes s JOIN est e USING (flow_id) ORDER BY s.size * abs(s.size - e.estimate) DESC, s.flow_id LIMIT 20")
def worst_errors(spark, d):
    s = sized(spark, d)
    e = sketches.cms_estimates(s, _cells(spark, d), R, C)
    j = s.select("flow_id", F.col("size").alias("v")).join(e, "flow_id")
    return j.orderBy(F.desc(F.col("v") * F.abs(F.col("v") - F.col("estimate"))), "flow_id").limit(20)


@query(f"{_fse_sql(SYNTH)} SELECT CAST(count(*) AS BIGINT) AS n FROM placed p JOIN cms c USING (flow_id) WHERE p.table_idx IS NOT NULL")
def ht_cms_overlap(spark, d):
    e = _fse(spark, d, _synth(spark, d))[1]
    return metrics.misplaced(e.table, e.cms)


@query(f"{_fse_sql(SYNTH)} SELECT CAST(count(*) AS BIGINT) AS told, CAST(count(DISTINCT flow_id) AS BIGINT) AS flows FROM placed WHERE table_idx IS NULL")
def control_plane(spark, d):
    return _fse(spark, d, _synth(spark, d))[1].discarded.agg(F.count("*").alias("told"), F.countDistinct("flow_id").alias("flows"))


MAX_HEAVY = 10
EXACT = f"exact AS (SELECT flow_id, q, coalesce(list_sort(list(gap_us) FILTER (gap_us IS NOT NULL))[CAST(floor(q * (count(gap_us) - 1)) AS INTEGER) + 1] / 1e6, 0) AS v FROM ordered, {QSQL} GROUP BY flow_id, q)"
IAT = f"""{ORACLE_PRED}, {_G}, {EXACT},
big AS (SELECT o.flow_id FROM ordered o JOIN pred p USING (flow_id) WHERE o.rn = 5 AND p.predicted = 1 ORDER BY o.seq LIMIT {MAX_HEAVY + 1}),
g_big AS (SELECT * FROM gaps WHERE flow_id IN (SELECT flow_id FROM big)),
g_small AS (SELECT * FROM gaps WHERE flow_id NOT IN (SELECT flow_id FROM big) AND flow_id IN (SELECT flow_id FROM sizes WHERE size >= 5)),
{_dd(BINS, 16, 'g_big', 'ddh')}, {_dd(MICE, 8, 'g_small', 'ddm')},
estimates AS (SELECT flow_id, q, value, 'heavy' AS sector FROM ddh UNION ALL SELECT flow_id, q, value, 'mice' FROM ddm
  UNION ALL SELECT flow_id, q, v, 'manager' FROM exact WHERE flow_id IN (SELECT flow_id FROM sizes WHERE size < 5))"""


def _iat(spark, d):
    p = packets(spark, d)
    return pipelines.gap_estimates(p, flow_manager.infinite(p, 5), _truth(spark, d), MAX_HEAVY, BINS, MICE, QS)


def _exact(spark, d):
    p = packets(spark, d)
    return pipelines.exact_quantiles(pipelines.gaps(p), pipelines.sizes(p), QS).withColumnRenamed("value", "v")


@query(f"{IAT} SELECT flow_id, q, round(value, 4) AS value, sector FROM estimates")
def iat_estimates_oracle(spark, d):
    return _iat(spark, d).select("flow_id", "q", F.round("value", 4).alias("value"), "sector")


MRE = "SELECT q, CAST(sum(CAST(v = 0 AND value <> 0 AS BIGINT)) AS BIGINT) AS n_inf, round(avg(CASE WHEN v = 0 AND value = 0 THEN 0 WHEN v <> 0 THEN abs(v - value) / v END), 6) AS mre FROM exact JOIN {e} USING (flow_id, q) GROUP BY q"


@query(f"{IAT} {MRE.format(e='estimates')}")
def iat_mre_oracle(spark, d):
    j = _exact(spark, d).join(_iat(spark, d).withColumnRenamed("value", "estimate"), ["flow_id", "q"])
    return metrics.mean_relative_error(j).select("q", "n_inf", r6("mre", "mre"))


BASE16 = sketches.LogBins(2_592_000.0, 1.0, 16)


@query(f"{_G}, {EXACT}, {_dd(BINS, 8, 'gaps', 'd1')}, {_dd(BASE16, 16, 'gaps', 'd2')}, {_dd(BINS, 16, 'gaps', 'd3')} SELECT '32x8' AS config, * FROM ({MRE.format(e='d1')}) UNION ALL SELECT '16x16', * FROM ({MRE.format(e='d2')}) UNION ALL SELECT '32x16', * FROM ({MRE.format(e='d3')})")
def iat_mre_baselines(spark, d):
    g, ex = pipelines.gaps(packets(spark, d)), _exact(spark, d)
    out = None
    for name, bins, bits in (("32x8", BINS, 8), ("16x16", BASE16, 16), ("32x16", BINS, 16)):
        e = sketches.quantiles(sketches.quantile_bins(g, bins, bits), bins, QS).withColumnRenamed("value", "estimate")
        m = metrics.mean_relative_error(ex.join(e, ["flow_id", "q"])).select(F.lit(name).alias("config"), "q", "n_inf", r6("mre", "mre"))
        out = m if out is None else out.unionByName(m)
    return out


# -- smaller operators -------------------------------------------------------------------------------------------------


@query("SELECT seq, rn > 1 AS seen FROM ordered")
def seen_before(spark, d):
    return flows.ordered(packets(spark, d)).select("seq", (F.col("rn") > 1).alias("seen"))


@query("SELECT flow_id, min(ts_us) AS first_us FROM packets GROUP BY flow_id ORDER BY first_us, flow_id LIMIT 20")
def earliest_flows(spark, d):
    return flows.time_bounds(packets(spark, d)).select(fk(), "first_us").orderBy("first_us", "flow_id").limit(20)


@query(f"{BLOOM} SELECT flow_id, CASE WHEN hit THEN 'mice' ELSE 'next' END AS route FROM probe")
def mice_router(spark, d):
    s = sized(spark, d)
    probes = sketches.bloom_probe(s, sketches.bloom_bits(s.where("size >= 15"), BM, BK), BM, BK)
    return probes.select("flow_id", F.when(F.col("hit"), "mice").otherwise("next").alias("route"))


@query(f"{_G}, {_dd(BINS, 16)} SELECT flow_id, seq, bin, round(CASE WHEN bin = {sketches.ZERO} THEN 0 ELSE 2 * pow({BINS.gamma!r}, bin) / {BINS.gamma + 1!r} END, 4) AS value FROM dd_v")
def values_to_bins(spark, d):
    v = sketches.freeze_seq(pipelines.gaps(packets(spark, d)), BINS, 16)
    return v.select("flow_id", "seq", "bin", F.round(F.when(F.col("bin") == sketches.ZERO, 0.0).otherwise(BINS.value(F.col("bin"))), 4).alias("value"))


@query(f"{_DAYS} SELECT day, flow_id, size FROM days ORDER BY day DESC, flow_id LIMIT 100")
def replay_buffer_fifo(spark, d):
    s = packets(spark, d).groupBy(F.floor(F.col("ts_us") / 86_400_000_000).alias("minute"), fk()).agg(F.count("*").alias("size"))
    return models.replay_buffer(s.where("minute % 2 = 0"), s.where("minute % 2 <> 0"), "update-fifo", 100).select(F.col("minute").alias("day"), "flow_id", "size")


@query(f"{TREES}, v AS (SELECT flow_id, count(*) AS n, count(*) - sum(CAST(proba >= 0.5 AS INTEGER)) AS z FROM trees GROUP BY flow_id) SELECT flow_id FROM v WHERE abs(n - 2 * (CASE WHEN z = 0 OR z = n THEN 1 ELSE z + 1 END)) / n < 0.3")
def active_samples(spark, d):
    v = _trees(spark, d).withColumn("vote", (F.col("proba") >= 0.5).cast("int"))
    return models.agreement(v).where("agreement < 0.3").select("flow_id")


@query(f"{TREES} SELECT flow_id, array_to_string(list(tree || '-' || printf('%.3f', proba) ORDER BY tree), ' ') AS log FROM trees GROUP BY flow_id")
def prediction_log(spark, d):
    t = _trees(spark, d).groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("tree", "proba"))).alias("x"))
    return t.select("flow_id", F.array_join(F.transform("x", lambda x: F.concat(x["tree"].cast("string"), F.lit("-"), F.format_string("%.3f", x["proba"]))), " ").alias("log"))


@query(f"{TREES}, {_TS} SELECT tree, score FROM tree_scores ORDER BY score DESC, tree LIMIT 1")
def best_params(spark, d):
    return _tree_scores(spark, d).select("tree", "score").orderBy(F.desc("score"), "tree").limit(1)


@query("SELECT s.flow_id, min(d.err) AS least_error FROM sizes s, (SELECT flow_id, size % k AS err FROM sizes, (VALUES (3), (5), (7)) AS t(k)) d WHERE s.flow_id = d.flow_id GROUP BY s.flow_id")
def best_split_error(spark, d):
    e = sized(spark, d).select("flow_id", "size", F.explode(F.array(F.lit(3), F.lit(5), F.lit(7))).alias("k"))
    return e.groupBy("flow_id").agg(F.min(F.col("size") % F.col("k")).alias("least_error"))


@query(f"{_fse_sql(SYNTH)} SELECT CAST(count(*) AS BIGINT) AS flows, CAST(sum(v) AS BIGINT) AS packets, CAST(sum(CASE WHEN sector = 'ht' THEN v END) AS BIGINT) AS in_table FROM resolved")
def fse_totals(spark, d):
    r = _fse(spark, d, _synth(spark, d))[0]
    return r.agg(F.count("*").alias("flows"), F.sum("v").alias("packets"), F.sum(F.when(F.col("sector") == "ht", F.col("v"))).alias("in_table"))


# -- the same sizes over another table ---------------------------------------------------------------------------------


@query("SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS size, CAST(count(*) > (SELECT quantile_cont(n, 0.9) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) AS INTEGER) AS heavy FROM lineitem GROUP BY l_orderkey")
def order_size_labels(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("size"))
    return labels.label_elephants(s, 90).select("k", "size", "heavy")
