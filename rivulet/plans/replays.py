"""SQL that replays bounded managers packet by packet, and the queries over what they give.

The replays are recursive: a step for each event of a bucket, with the flows that it holds as a list.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.operators import flow_manager, metrics, pipelines
from rivulet.plans import sizing
from rivulet.plans.queries import ADMIT, BUCKET, ERRORS, CONFIG, LABELLED, MAX_HEAVY, ORACLE, C, R, _errors, _truth, packets, query
from rivulet.streaming import flows as streams

ROWS, SLOTS, LIMIT = 16, 4, 5
LAYERS = flow_manager.layer_rows([0.5, 0.25, 0.15, 0.1], 32, LIMIT)
FIRST = f"firsts AS MATERIALIZED (SELECT flow_id, seq, ts_us, rn, {BUCKET(chr(39) + 'fm' + chr(39), 'flow_id', ROWS)} AS bucket FROM ordered WHERE rn <= {LIMIT})"


def fifo_sql(remove: bool = True) -> str:
    """Relation `outcome`: first in, first out; only a flow's first packet and its k-th one change what a bucket holds."""
    kept = "list_filter(r.held, lambda x: x <> e.flow_id)" if remove else "r.held"
    return f"""{FIRST},
events_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS i FROM firsts WHERE rn IN (1, {LIMIT})),
run(bucket, i, held, gone, outcome, seq, ts_us) AS (
  SELECT DISTINCT bucket, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT FROM events_
  UNION ALL
  SELECT r.bucket, e.i, CASE WHEN e.rn = 1 THEN list_append(CASE WHEN len(r.held) >= {SLOTS} THEN r.held[2:] ELSE r.held END, e.flow_id) ELSE {kept} END,
    CASE WHEN e.rn = 1 AND len(r.held) >= {SLOTS} THEN r.held[1] WHEN e.rn = {LIMIT} AND list_contains(r.held, e.flow_id) THEN e.flow_id END,
    CASE WHEN e.rn = 1 THEN 'evicted' ELSE 'collected' END, e.seq, e.ts_us
  FROM run r JOIN events_ e ON e.bucket = r.bucket AND e.i = r.i + 1),
left_ AS MATERIALIZED (SELECT gone AS flow_id, min_by(outcome, seq) AS outcome, min(seq) AS seq, min_by(ts_us, seq) AS ts_us FROM run WHERE gone IS NOT NULL GROUP BY gone),
outcome AS MATERIALIZED (SELECT l.flow_id, l.outcome, l.seq, l.ts_us, CAST(count(CASE WHEN l.outcome = 'collected' OR f.seq < l.seq THEN 1 END) AS INTEGER) AS n_pkts FROM left_ l JOIN firsts f USING (flow_id) GROUP BY ALL
  UNION ALL SELECT flow_id, 'resident', max(seq), max_by(ts_us, seq), CAST(count(*) AS INTEGER) FROM firsts WHERE flow_id NOT IN (SELECT flow_id FROM left_) GROUP BY flow_id)"""


def layers_sql() -> str:
    """Relation `outcome` of the layered manager; a layer's list is in order of arrival time, so the first one leaves."""
    out, ends = [FIRST, "in1 AS (SELECT flow_id, seq, ts_us FROM firsts WHERE rn = 1)"], []
    for i in range(1, LIMIT):
        entry = "{'ts_us': e.ts_us, 'seq': e.seq, 'flow_id': e.flow_id}"
        out.append(f"""ev{i} AS MATERIALIZED (SELECT *, {BUCKET(f"'layer{i}'", 'flow_id', LAYERS[i - 1])} AS bucket, row_number() OVER (PARTITION BY {BUCKET(f"'layer{i}'", 'flow_id', LAYERS[i - 1])} ORDER BY seq) AS i
  FROM (SELECT flow_id, seq, ts_us, true AS comes FROM in{i} UNION ALL SELECT flow_id, seq, ts_us, false FROM firsts WHERE rn = {i + 1} AND flow_id IN (SELECT flow_id FROM in{i}))),
run{i}(bucket, i, held, gone, moves, seq, ts_us) AS (
  SELECT DISTINCT bucket, 0::BIGINT, []::STRUCT(ts_us BIGINT, seq BIGINT, flow_id VARCHAR)[], NULL::VARCHAR, false, NULL::BIGINT, NULL::BIGINT FROM ev{i}
  UNION ALL
  SELECT r.bucket, e.i, CASE WHEN e.comes THEN list_sort(list_append(CASE WHEN len(r.held) >= {SLOTS} THEN r.held[2:] ELSE r.held END, {entry})) ELSE list_filter(r.held, lambda x: x.flow_id <> e.flow_id) END,
    CASE WHEN e.comes AND len(r.held) >= {SLOTS} THEN r.held[1].flow_id WHEN NOT e.comes AND len(list_filter(r.held, lambda x: x.flow_id = e.flow_id)) = 1 THEN e.flow_id END,
    NOT e.comes, e.seq, e.ts_us
  FROM run{i} r JOIN ev{i} e ON e.bucket = r.bucket AND e.i = r.i + 1),
gone{i} AS MATERIALIZED (SELECT gone AS flow_id, moves, seq, ts_us FROM run{i} WHERE gone IS NOT NULL),
in{i + 1} AS MATERIALIZED (SELECT flow_id, seq, ts_us FROM gone{i} WHERE moves)""")
        ends.append(f"SELECT flow_id, 'evicted' AS outcome, seq, ts_us, {i} AS n_pkts FROM gone{i} WHERE NOT moves")
        ends.append(f"SELECT flow_id, 'resident', seq, ts_us, {i} FROM in{i} WHERE flow_id NOT IN (SELECT flow_id FROM gone{i})")
    ends.append(f"SELECT flow_id, 'collected', seq, ts_us, {LIMIT} FROM in{LIMIT}")
    return ", ".join(out) + ", outcome AS MATERIALIZED (" + " UNION ALL ".join(ends) + ")"


def recursive(sql: str):
    """As `query`; the SQL has recursive relations."""

    def put(f):
        query(sql)(f)
        ORACLE[f.__name__] = ORACLE[f.__name__].replace("WITH ", "WITH RECURSIVE ", 1)
        return f

    return put


OUTCOME = "SELECT flow_id, outcome, seq, ts_us, n_pkts FROM outcome"


@recursive(f"{fifo_sql()} {OUTCOME}")
def evict_fifo_outcome(spark, d):
    return flow_manager.evict_oldest(packets(spark, d), ROWS, SLOTS, LIMIT)


# Of flows that were collected, the smaller seq is the collection: they leave later, and without notice.
@recursive(f"{fifo_sql(remove=False)} {OUTCOME}")
def evict_timeout_outcome(spark, d):
    return flow_manager.evict_timeout(packets(spark, d), ROWS, SLOTS, LIMIT)


@recursive(f"{layers_sql()} {OUTCOME}")
def hierarchical_outcome(spark, d):
    return flow_manager.hierarchical(packets(spark, d), LAYERS, SLOTS, LIMIT)


@recursive(f"{fifo_sql()} {OUTCOME} WHERE outcome <> 'resident'")
def stream_fifo_outcome(spark, d):
    return streams.drain(streams.bounded_manager(streams.packet_stream(spark, d), ROWS, SLOTS, LIMIT), streams.work_dir(spark))


@recursive(f"{LABELLED}, {fifo_sql()}, n AS (SELECT outcome, n_pkts, CAST(count(*) AS BIGINT) AS n FROM outcome JOIN labelled USING (flow_id) WHERE heavy = 1 GROUP BY ALL) SELECT outcome, n_pkts, n, round(n / (SELECT sum(n) FROM n), 6) AS share FROM n")
def eviction_stages(spark, d):
    """Elephants by how many packets they had when they left the manager, and their share of all."""
    o = flow_manager.evict_oldest(packets(spark, d), ROWS, SLOTS, LIMIT).join(_truth(spark, d).where("predicted = 1").select("flow_id"), "flow_id", "left_semi")
    n = o.groupBy("outcome", "n_pkts").agg(F.count("*").alias("n"))
    return n.select("outcome", "n_pkts", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


_WAITS = "SELECT o.flow_id, o.outcome, CAST(count(s.flow_id) AS BIGINT) AS new_flows FROM outcome o JOIN ordered b ON b.flow_id = o.flow_id AND b.rn = 1 LEFT JOIN ordered s ON s.rn = 1 AND s.seq > b.seq AND s.seq < o.seq WHERE o.outcome <> 'resident' GROUP BY ALL"


def _waits(spark, d, outcomes):
    return outcomes.select("flow_id", "outcome").join(flow_manager.new_flows_until(packets(spark, d), outcomes), "flow_id")


@recursive(f"{fifo_sql()} {_WAITS}")
def fifo_new_flows_while_cached(spark, d):
    return _waits(spark, d, flow_manager.evict_oldest(packets(spark, d), ROWS, SLOTS, LIMIT))


@recursive(f"{layers_sql()} {_WAITS}")
def layers_new_flows_while_cached(spark, d):
    return _waits(spark, d, flow_manager.hierarchical(packets(spark, d), LAYERS, SLOTS, LIMIT))


@recursive(f"""{LABELLED}, {fifo_sql()}, arrive AS (SELECT o.flow_id, o.seq FROM outcome o JOIN labelled l USING (flow_id) WHERE o.outcome = 'collected' AND l.heavy = 1), {ADMIT},
res AS (SELECT flow_id, n_pkts AS size FROM outcome WHERE outcome = 'resident'),
counted AS (SELECT s.flow_id, s.size FROM sizes s WHERE flow_id NOT IN (SELECT flow_id FROM res) AND flow_id NOT IN (SELECT flow_id FROM placed WHERE table_idx IS NOT NULL)),
hits AS (SELECT flow_id, size, r AS row, {BUCKET('r', 'flow_id', C)} AS col FROM counted, range({R}) t(r)),
cells AS (SELECT row, col, least(sum(size), CASE WHEN row = 0 THEN 16777215 ELSE 65535 END) AS cnt FROM hits GROUP BY row, col),
cms AS (SELECT h.flow_id, min(CASE WHEN h.row = 0 OR c.cnt < 65535 THEN c.cnt END) AS size FROM hits h JOIN cells c ON h.row = c.row AND h.col = c.col GROUP BY h.flow_id),
resolved AS (SELECT s.flow_id, s.size AS v, CASE WHEN p.flow_id IS NOT NULL THEN s.size WHEN c.flow_id IS NOT NULL THEN c.size ELSE coalesce(r.size, 0) END AS estimate
  FROM sizes s LEFT JOIN placed p USING (flow_id) LEFT JOIN cms c USING (flow_id) LEFT JOIN res r USING (flow_id)) {ERRORS}""")
def fse_fifo_errors(spark, d):
    """Errors of the size pipeline behind the bounded manager: evicted flows are counted by the sketch."""
    p = packets(spark, d)
    s = pipelines.sizes(p)
    e = pipelines.estimate_sizes(s, flow_manager.evict_oldest(p, ROWS, SLOTS, LIMIT), _truth(spark, d), CONFIG)
    return _errors(metrics.resolve(s, e.table, e.cms, e.manager, e.discarded, LIMIT))


@recursive(f"""{LABELLED}, {fifo_sql()}, big AS (SELECT o.flow_id FROM outcome o JOIN labelled l USING (flow_id) WHERE o.outcome = 'collected' AND l.heavy = 1 ORDER BY o.seq LIMIT {MAX_HEAVY + 1})
SELECT p.seq, p.flow_id, CASE WHEN o.outcome = 'resident' OR p.seq <= o.seq THEN 'manager' WHEN o.flow_id IN (SELECT flow_id FROM big) THEN 'heavy' ELSE 'mice' END AS route FROM packets p JOIN outcome o USING (flow_id)""")
def packet_routes(spark, d):
    p = packets(spark, d)
    return pipelines.routes(p, flow_manager.evict_oldest(p, ROWS, SLOTS, LIMIT), _truth(spark, d), MAX_HEAVY)


# -- memory of the structures: whole numbers, divided part by part -----------------------------------------------------

_REPORT = """t(trace, budget_mb, entries, capacity, small) AS (VALUES ('caida', 1.0::DOUBLE, 20024, 18552, false), ('mawi', 1.5, 9494, 11728, false), ('uni', 0.02, 110, 100, true)),
r AS (SELECT *, CASE WHEN small THEN CAST(floor(greatest(30, capacity // 8) * 0.96) AS BIGINT) ELSE greatest(30, capacity // 8) END AS n, 64 * (entries // 64) AS held FROM t),
c AS (SELECT *, CAST(floor((budget_mb * 1048576 - entries * 3 - CASE WHEN small THEN 0 ELSE 16 * n * 8 - 290 * 1024 END) / 5) AS BIGINT) * 5 // 1024 AS sketch FROM r),
m AS (SELECT trace, budget_mb, unnest([{'part': 'system_kb', 'amount': 8 * n * 15 // 1024 + held * 6 // 1024 + 531}, {'part': 'estimation_kb', 'amount': held * 3 // 1024 + sketch}, {'part': 'table_entries', 'amount': held}, {'part': 'table_kb', 'amount': held * 6 // 1024},
  {'part': 'table_extra_kb', 'amount': held * 3 // 1024}, {'part': 'sketch_kb', 'amount': sketch}, {'part': 'manager_kb', 'amount': 8 * n * 16 // 1024}]) AS x FROM c)
SELECT trace, budget_mb, x.part AS part, CAST(x.amount AS BIGINT) AS amount FROM m"""


@query(_REPORT)
def memory_reports(spark, d):
    rows = [(name, mb, k, int(v)) for name, mb in (("caida", 1.0), ("mawi", 1.5), ("uni", 0.02)) for k, v in sizing.memory_report(sizing.flow_sizes(mb, sizing.trace_of(name))).items()]
    return spark.createDataFrame(rows, "trace string, budget_mb double, part string, amount long")
