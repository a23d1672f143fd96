"""Connected components of an edge table, without collecting edges or nodes anywhere.

Each round does a large-star and a small-star step: every node points its larger neighbours, then its smaller ones,
at the least node it knows. Rounds end when the edges no longer change; all are then stars around the least id.
Partitions first shrink their own edges to a spanning forest, so a round moves at most a row per node and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, drop


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b, the least node that each can reach."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        high, low = np.maximum(x, y), np.minimum(x, y)
        open_ = high != low
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least node, node) with the same components as the edges u-v."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = least_labels(len(ids), at[: len(u)], at[len(u) :])
    other = label != np.arange(len(ids))
    return ids[label[other]], ids[other]


#: Rows of an edge table that a task holds at a time when it shrinks them.
FOREST_ROWS = 1_000_000


def _shrink(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    u, v, held, last = [], [], 0, 0
    for pdf in parts:
        u.append(pdf["u"].to_numpy())
        v.append(pdf["v"].to_numpy())
        held += len(pdf)
        if held >= FOREST_ROWS + 2 * last:
            x, y = forest(np.concatenate(u), np.concatenate(v))
            u, v, held, last = [x], [y], len(x), len(x)
    if held:
        x, y = forest(np.concatenate(u), np.concatenate(v))
        yield pd.DataFrame({"u": x, "v": y})


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", shrink: bool = True) -> DataFrame:
    """(node, component) for each node that has an edge to another; component is the least node it can reach.

    `shrink`: whether partitions first shrink their edges; not needed where they are forests already.
    Rows with a null end, loops and repeated edges are of no effect; an empty table gives an empty result.
    """
    clean = edges.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") < F.col("v")))
    now = cut((clean.mapInPandas(_shrink, "u long, v long") if shrink else clean).distinct(), "edges")
    mark = _mark(now)
    while True:
        # Large star: of x's neighbours, those above x go to the least of x and its neighbours.
        least = now.select(F.col("v").alias("x"), F.col("u").alias("m")).groupBy("x").agg(F.min("m").alias("m"))
        least = cut(least, "least")
        large = now.join(least, now["u"] == least["x"], "left").select(F.least(F.coalesce("m", "u"), "u").alias("u"), "v").distinct()
        large = cut(large, "large")
        # Small star: x and its smaller neighbours go to the least of these.
        below = cut(large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m")), "below")
        moved = large.join(below, large["v"] == below["x"]).select("m", "u", "v")
        small = moved.select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v").union(below.select(F.col("m").alias("u"), F.col("x").alias("v"))).distinct()
        then = cut(small, "edges")
        for old in (now, least, large, below):
            drop(old)
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select("u", "u").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
