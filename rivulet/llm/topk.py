"""Exact top-k inner products by pivot-table elimination.

For integer vectors, q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2. Distances of all vectors to many pivots are worked out
once and kept with them; by the triangle inequality the largest |d(q,p) - d(x,p)| over the pivots p bounds |q - x| from
below, and so q.x from above. Each query takes candidates in the order of their bounds and stops when the next bound is
below its k-th score: the answer is exact.

Vectors are packed into blocks of bounded size, those nearest to the same pivot together. A query first searches a block
of its own pivot; the k-th score found there goes with it to the others. Pairs of blocks that the bounds rule out as a
whole aren't made, and of the others each query passes over those that it can rule out alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import cut, table

TOP, QUERY_STEP, SCALE = 5, 50, 256
PIVOTS = 32
QUERY_BLOCK, VECTOR_BLOCK = 2_048, 4_096
#: A query's candidates are scored this many at a time, in the order of their bounds.
CHUNK = 256
#: Tasks that search pairs of blocks, at most; beyond it a task takes several pairs, one after the other.
MOST_TASKS, MOST_SALTS = 20_000, 1_024
#: Parts in which a query's results are put together first.
MERGES = 64
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def quantised(embedding: Column) -> Column:
    """floor(SCALE * x) of each component as double; null for vectors that are null or hold null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def _scorer(q: np.ndarray, x: np.ndarray):
    """scores(i, rows): exact inner products of q[i] with rows of x, as int64; those beyond a long are the nearest one.

    Sums below 2^53 are exact in float64, whose products are fast; below 2^63 in int64; others need Python's integers.
    """
    d = min(q.shape[1], x.shape[1])
    q, x = q[:, :d], x[:, :d]
    most = lambda y: max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0
    top = d * most(q) * most(x)
    if top < 1 << 53:
        qf, xf = q.astype(float), x.astype(float)
        return lambda i, rows: (xf[rows] @ qf[i]).astype(np.int64)
    if top < 1 << 63:
        return lambda i, rows: x[rows] @ q[i]
    qo, xo = q.astype(object), x.astype(object)
    return lambda i, rows: np.array([min(max(int(v), LOWEST), HIGHEST) for v in xo[rows] @ qo[i]], np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    y = x.astype(float)
    return (y * y).sum(1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """[vector, pivot] distances; whichever is shorter is continued with zeros."""
    d = min(x.shape[1], pivots.shape[1])
    return np.sqrt(np.maximum(_norms(x)[:, None] + (pivots * pivots).sum(1) - 2 * (x[:, :d].astype(float) @ pivots[:, :d].T), 0))


def search_block(q_id: np.ndarray, q: np.ndarray, q_to: np.ndarray, least: np.ndarray, x_id: np.ndarray, x: np.ndarray, x_to: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vector ids, scores) of the best k of a block for each query that reach its `least`; ties to smaller
    ids. q_to and x_to are distances to the pivots."""
    if not len(x):
        return
    scores, qn, xn = _scorer(q, x), _norms(q), _norms(x)
    # Distances are off by the rounding of sums of squares at most, and bounds too.
    slack = 1e-6 * (1 + np.sqrt(qn) + np.sqrt(xn.max()) + np.maximum(q_to.max(1, initial=0), x_to.max(initial=0)))
    over = 1e-9 * (1 + qn + xn.max())
    columns = np.ascontiguousarray(x_to.T)
    gap = np.maximum(columns.min(1) - q_to, q_to - columns.max(1)).max(1, initial=0)
    ceiling = (qn + xn.max() - np.maximum(gap - slack, 0) ** 2) / 2 + over
    for i in np.flatnonzero(ceiling >= least):
        low = np.zeros(len(x))
        for p in range(len(columns)):
            np.maximum(low, np.abs(columns[p] - q_to[i, p]), out=low)
        low = np.maximum(low - slack[i], 0)
        bound = (qn[i] + xn - low * low) / 2 + over[i]
        best, taken = np.empty(0, np.int64), np.empty(0, np.int64)
        size = CHUNK
        rest = np.flatnonzero((bound >= least[i]) & (x_id != q_id[i]))
        while len(rest):
            if len(rest) > size:  # the `size` largest bounds, ties and all, then the others
                edge = np.partition(bound[rest], len(rest) - size)[len(rest) - size]
                now, rest = rest[bound[rest] >= edge], rest[bound[rest] < edge]
            else:
                now, rest = rest, rest[:0]
            best, taken = np.concatenate([best, scores(i, now)]), np.concatenate([taken, now])
            keep = np.lexsort((x_id[taken], -np.maximum(best, LOWEST + 1)))[:k]
            best, taken = best[keep], taken[keep]
            if len(best) == k:
                rest = rest[bound[rest] >= best[-1]]  # an equal score may still win by its id
            size *= 4
        yield np.full(len(taken), q_id[i]), x_id[taken], best


ROWS = "row long, vec_id long, d int, v array<long>, to array<double>, cell int, norm double"
PACKED = "block long, d int, ids binary, v binary, to binary, least binary, low array<double>, high array<double>, norm double, lowest long"


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """ROWS: each vector with its distances to the pivots, the nearest of these, and its squared length."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for d, some in whole.groupby(whole["v"].map(len), sort=False):
                for begin in range(0, len(some), 2048):
                    pdf = some.iloc[begin : begin + 2048]
                    v = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), d)
                    to = distances(v, pivots)
                    yield pd.DataFrame({"row": pdf["row"].to_numpy(), "vec_id": pdf["vec_id"].to_numpy(), "d": d, "v": list(v), "to": list(to), "cell": to.argmin(1), "norm": _norms(v)})

    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v").mapInPandas(run, ROWS)


def _cells(rows: DataFrame, size: int) -> DataFrame:
    """(d, cell, home, parts): vectors of a cell that would fill a quarter of a block have blocks of their own, `parts`
    of them; the others of the same length share blocks, home -1."""
    counts = cut(rows.groupBy("d", "cell").agg(F.count("*").alias("n")), "counts")
    homes = counts.select("d", "cell", F.when(F.col("n") * 4 >= size, F.col("cell")).otherwise(-1).alias("home"), "n")
    parts = homes.groupBy("d", "home").agg(F.ceil(F.sum("n") / size).alias("parts"))
    return cut(homes.join(parts, ["d", "home"]).select("d", "cell", "home", "parts"), "cells")


def _packed(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """A row of PACKED for each block; `rows` may have `least`."""
    placed = rows.join(cells, ["d", "cell"]).withColumn("block", F.xxhash64("d", "home", F.pmod(F.xxhash64("row"), F.col("parts"))))
    if "least" not in rows.columns:
        placed = placed.withColumn("least", F.lit(LOWEST))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        v, to = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), d), np.array(pdf["to"].tolist(), float)
        return pd.DataFrame({
            "block": pdf["block"].iloc[:1].to_numpy(), "d": d, "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "v": [v.tobytes()], "to": [to.tobytes()], "least": [pdf["least"].to_numpy(np.int64).tobytes()],
            "low": [to.min(0)], "high": [to.max(0)], "norm": pdf["norm"].max(), "lowest": pdf["least"].min(),
        })

    # Lengths go into the key, so that blocks are matrices even if hashes collide.
    return placed.groupBy("block", "d").applyInPandas(pack, PACKED)


def _unpacked(ids: bytes, v: bytes, to: bytes, least: bytes, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(ids) // 8
    return np.frombuffer(ids, np.int64), np.frombuffer(v, np.int64).reshape(n, d), np.frombuffer(to, float).reshape(n, -1), np.frombuffer(least, np.int64)


SIDE = ("d", "ids", "v", "to", "least")


def _side(df: DataFrame, mark: str) -> list[Column]:
    return [F.col(c).alias(mark + c) for c in ("block", *SIDE)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) from rows (vec_id, v), v arrays of whole numbers; other columns are of no effect.

    Rows with null id, null v or a null component take no part. Of vectors of different lengths the shorter one is
    continued with zeros; an empty one has the score 0 with all. Scores are exact; one beyond a long is the nearest
    long. Of rows with one id, each is a vector of its own, and none is a candidate of a query of that id; a query's
    rows together have one list. Ties go to the smaller id. An empty table on either side gives an empty result.
    """
    spark = vectors.sparkSession
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull())
    x, q = (cut(t.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v")), "vectors") for t in (vectors, queries))
    # Any vectors do as pivots; these are spread by a hash of their ids and are few.
    chosen = [r["v"] for r in x.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id", "v").limit(pivots).collect()]
    if not chosen or q.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    at = np.zeros((len(chosen), max(1, *map(len, chosen))))
    for p, v in zip(at, chosen, strict=True):
        p[: len(v)] = v
    x, q = cut(_placed(x, at), "placed"), cut(_placed(q, at), "asked")
    homes = _cells(x, vector_block)
    blocks = cut(_packed(x, homes), "blocks")

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                mine, theirs = (_unpacked(*(r[m + c] for c in ("ids", "v", "to", "least", "d"))) for m in ("q", "x"))
                for ids, found, score in search_block(*mine, *theirs[:3], k):
                    yield pd.DataFrame({"query_id": ids, "vec_id": found, "score": score, "part": r["xblock"] % MERGES})

    found_rows = "query_id long, vec_id long, score long, part long"

    def paired(pairs: DataFrame, asked: DataFrame, n: int) -> DataFrame:
        """What is found in the (qblock, xblock) of `pairs`, dealt over tasks of their own: rows are few, but large."""
        sides = asked.select(*_side(asked, "q")).join(pairs, "qblock").join(blocks.select(*_side(blocks, "x")), "xblock")
        return sides.repartition(max(1, min(MOST_TASKS, n)), "qblock", "xblock").mapInPandas(search, found_rows)

    # Each query searches one block of its own cell, or of the cells that share blocks.
    first = cut(q.join(homes.select("d", "cell", "home"), ["d", "cell"]).withColumn("near", F.xxhash64("d", "home", F.lit(0).cast("long"))), "first")
    crowd = first.groupBy("d", "cell").agg(F.count("*").alias("n")).select("d", "cell", F.col("cell").alias("home"), F.ceil(F.col("n") / query_block).alias("parts"))
    asked = cut(_packed(first.select(*q.columns), cut(crowd, "crowd")), "first-blocks")
    near = first.join(crowd.select("d", "cell", "parts"), ["d", "cell"]).select(F.xxhash64("d", "cell", F.pmod(F.xxhash64("row"), F.col("parts"))).alias("qblock"), F.col("near").alias("xblock")).distinct()
    near = cut(near, "near")
    met = paired(near, asked, near.count()).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
    met = cut(met.where(F.size("s") >= k).select(F.col("query_id").alias("vec_id"), F.element_at("s", k).alias("least")), "least")
    # Ids of several rows have no bound to begin with: it would be that of all their rows together.
    alone = q.groupBy("vec_id").agg(F.count("*").alias("n")).where("n = 1").select("vec_id")
    bounded = q.join(met.join(alone, "vec_id"), "vec_id", "left").select(*q.columns, F.coalesce("least", F.lit(LOWEST)).alias("least"))
    bounded = cut(bounded, "bounded")
    asked = cut(_packed(bounded, _cells(bounded, query_block)), "query-blocks")
    # Pairs of blocks that may hold one of a query's best: from summaries of blocks, which are small. Those of vectors
    # are dealt over salts, and those of queries meet each salt.
    salts = max(1, min(MOST_SALTS, blocks.count()))
    qs = asked.select(F.col("block").alias("qblock"), *(F.col(c).alias("q" + c) for c in ("low", "high", "norm", "lowest")), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    xs = blocks.select(F.col("block").alias("xblock"), *(F.col(c).alias("x" + c) for c in ("low", "high", "norm")), F.pmod("block", F.lit(salts)).cast("int").alias("salt"))
    apart = lambda a, b: F.array_max(F.zip_with(a, b, lambda y, z: y - z))
    gap = F.greatest(F.lit(0.0), apart("xlow", "qhigh"), apart("qlow", "xhigh")) - F.lit(1e-6) * (1 + F.sqrt("qnorm") + F.sqrt("xnorm") + F.greatest(F.array_max("xhigh"), F.array_max("qhigh")))
    bound = (F.col("qnorm") + F.col("xnorm") - F.pow(F.greatest(F.lit(0.0), gap), 2)) / 2 + 1e-9 * (1 + F.col("qnorm") + F.col("xnorm"))
    pairs = cut(qs.join(xs, "salt").where(bound >= F.col("qlowest")).select("qblock", "xblock"), "pairs")
    found = paired(pairs, asked, pairs.count())
    # Of the best k of each block, the best k, in two steps.
    order = F.struct((-F.greatest("score", F.lit(LOWEST + 1))).alias("s"), "vec_id", "score")
    some = found.groupBy("query_id", "part").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("b"))
    best = some.select("query_id", F.explode("b").alias("r")).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("r")), 1, k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("p", "r")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(v, v.where(F.col("vec_id") % QUERY_STEP == 0))


QUERIES = {"op9_exact_top_k": op9_exact_top_k}
ORACLE = {
    "op9_exact_top_k": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 5"""
}
