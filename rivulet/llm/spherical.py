"""Embedding near-duplicates by spherical-cap filters.

Filter directions are the code words of a structured random product code: a rotated vector is cut into a few blocks,
each block has its own random code book, and every choice of a word from each book is a direction. A vector passes
the filters whose directions have an inner product of at least alpha with it; these are list-decoded block by block,
a prefix being dropped once even the best rest can't reach alpha, so far fewer directions are touched than exist.
Vectors that share a filter are candidates; links are verified in double precision.

alpha and the size of a code follow from the number of vectors: a filter is to meet about OCCUPANCY unrelated ones.
Codes with rotations of their own are added until, of pairs drawn at random with an inner product of just the
threshold, a share of RECALL has a filter in common. So the work grows with a power of the number of vectors below 2.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import cut, table
from rivulet.llm.components import connected_components, forest

COSINE = 0.9
RECALL, OCCUPANCY = 0.99, 0.25
#: Filters of a code that a vector passes, on average; pairs drawn to see how many codes are needed.
LIST, DRAWN = 5.0, 1_000
#: Words of a book beyond which a code has more blocks.
MOST_WORDS = 1 << 15
#: Vectors of one filter that a task compares at once; a filter with more is dealt into blocks, and pairs of blocks.
BLOCK = 1_024
#: Up to this many vectors of a filter are compared together with those of other filters.
SMALL = 24
SEED = 23


@dataclass(frozen=True)
class Code:
    """books[k] has the words of block k, columns edges[k]:edges[k+1] of a rotated vector."""

    rotation: np.ndarray
    books: tuple[np.ndarray, ...]
    edges: tuple[int, ...]
    alpha: float

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that each unit vector passes."""
        y = x @ self.rotation
        scores = [y[:, a:b] @ book.T for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)]
        rest = np.zeros((len(x), len(scores) + 1))
        for k in range(len(scores) - 1, -1, -1):
            rest[:, k] = rest[:, k + 1] + scores[k].max(1)
        row, code, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k, score in enumerate(scores):
            order = np.argsort(-score, 1)
            ranked = np.take_along_axis(score, order, 1)
            need = self.alpha - total - rest[row, k + 1]
            # How many of the ranked words of its row each prefix can go on with: by bisection, for all prefixes.
            lo, hi = np.zeros(len(row), np.int64), np.full(len(row), ranked.shape[1])
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                ok = open_ & (ranked[row, np.minimum(mid, ranked.shape[1] - 1)] >= need)
                lo, hi = np.where(ok, mid + 1, lo), np.where(open_ & ~ok, mid, hi)
            again = np.repeat(np.arange(len(row)), lo)
            nth = np.arange(len(again)) - np.repeat(np.cumsum(lo) - lo, lo)
            row, code, total = row[again], code[again], total[again]
            code = code * score.shape[1] + order[row, nth]
            total = total + ranked[row, nth]
        return row, code


def _tail(a: float, d: int) -> float:
    """P(first coordinate of a random unit vector in d dimensions >= a)."""
    t = np.linspace(a, 1, 4001)
    f = np.maximum(1 - t * t, 0) ** ((d - 3) / 2)
    g = np.linspace(-1, 1, 8001)
    h = np.maximum(1 - g * g, 0) ** ((d - 3) / 2)
    return float(np.trapezoid(f, t) / np.trapezoid(h, g))


def _blocks(d: int, filters: float) -> int:
    """Blocks of a code: as few as keep its books small, each of four dimensions, or two if books were too large."""
    m = max(1, min(2 if filters < 1e7 else 3 if filters < 1e10 else 4, d // 4))
    while filters ** (1 / m) > MOST_WORDS and m < d // 2:
        m += 1
    return m


def _code(rng: np.random.Generator, alpha: float, filters: float, d: int) -> Code:
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    m = _blocks(d, filters)
    size = max(2, math.ceil(filters ** (1 / m)))
    edges = tuple(round(k * d / m) for k in range(m + 1))
    books = []
    for a, b in zip(edges, edges[1:], strict=False):
        book = rng.standard_normal((size, b - a))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt((b - a) / d))
    return Code(rotation, tuple(books), edges, alpha)


def decode(codes: tuple[Code, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) over all codes, sorted; filters of different codes have different numbers."""
    found = [code.decode(x) for code in codes]
    row = np.concatenate([r for r, _ in found])
    cell = np.concatenate([f * len(codes) + t for t, (_, f) in enumerate(found)])
    order = np.lexsort((cell, row))
    return row[order], cell[order]


def make_codes(n: int, d: int, cosine: float = COSINE, recall: float = RECALL, occupancy: float = OCCUPANCY, seed: int = SEED) -> tuple[Code, ...]:
    """The codes for n vectors of d dimensions. They are random with a fixed seed, so every task could make the same."""
    rng = np.random.default_rng(seed)
    if d < 3:  # too few dimensions for caps to tell vectors apart: one filter that all pass
        return (Code(np.eye(d), (np.zeros((1, d)),), (0, d), -1.0),)
    p = min(0.02, occupancy / max(n, 1))
    lo, hi = 0.0, 0.999
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _tail(mid, d) > p else (lo, mid)
    # Caps have to be as wide as the angle of a pair: in few dimensions smaller ones would never hold both its ends.
    lo = min(lo, cosine)
    p = max(p, _tail(lo, d))
    x = _unit(rng.standard_normal((DRAWN, d)))
    z = rng.standard_normal((DRAWN, d))
    z = _unit(z - (z * x).sum(1, keepdims=True) * x)
    both = np.concatenate([x, cosine * x + math.sqrt(1 - cosine * cosine) * z])
    codes, met = [], np.zeros(DRAWN, bool)
    while met.mean() < recall:
        codes.append(_code(rng, lo, LIST / p, d))
        row, cell = codes[-1].decode(both)
        pair = np.unique(np.stack([row % DRAWN, cell, row // DRAWN], 1), axis=0)
        same = (pair[1:, :2] == pair[:-1, :2]).all(1)
        met[pair[1:][same, 0]] = True
    return tuple(codes)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _links(x: np.ndarray, owner: np.ndarray, filters: list[np.ndarray], at: int, other: slice | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of x of one filter `at` that reach `cosine` and share no smaller filter.

    With `other`, only pairs of a row before it and one in it.
    """
    n = len(x)
    close = x @ x.T >= cosine
    close &= owner[:, None] != owner[None, :]
    if other is None:
        close = np.triu(close, 1)
    else:
        mask = np.zeros((n, n), bool)
        mask[: other.start, other] = True
        close &= mask
    if close.any():
        smaller = [f[f < at] for f in filters]
        ids, where = np.unique(np.concatenate(smaller), return_inverse=True)
        if len(ids):
            has = np.zeros((n, len(ids)), np.float32)
            has[np.repeat(np.arange(n), [len(f) for f in smaller]), where] = 1
            close &= (has @ has.T) == 0
    return np.nonzero(close)


FOUND = "kind int, x long, y long"


def _compare(parts: Iterator[pd.DataFrame], cosine: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by (filter, pair of blocks): emits (1, vector, links found) and (2, u, v), a forest of the links.

    A link counts as often as its other end has copies. A pair is met in each filter that both ends pass, and counted
    in the first of these.
    """
    held: list[pd.DataFrame] = []
    for pdf in parts:
        # The last run of a batch may go on in the next one.
        pdf = pd.concat([*held, pdf], ignore_index=True) if held else pdf
        key = pdf[["cell", "a", "b"]].to_numpy()
        last = len(pdf) - 1
        same = (key == key[last]).all(1)
        cut_at = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
        held = [pdf.iloc[cut_at:]]
        if cut_at:
            yield from _runs(pdf.iloc[:cut_at], cosine)
    if held and len(held[0]):
        yield from _runs(held[0], cosine)


def _runs(pdf: pd.DataFrame, cosine: float) -> Iterator[pd.DataFrame]:
    x = np.array(pdf["v"].tolist(), float)
    ids, copies, cell, a, b, of = (pdf[c].to_numpy() for c in ("vec_id", "copies", "cell", "a", "b", "of"))
    filters = pdf["filters"].tolist()
    edge = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    ends = np.r_[edge[1:], len(pdf)]
    lefts, rights = [], []
    small = (ends - edge) <= SMALL
    # Filters with few vectors: all at once, by the distance of two rows within the sorted run.
    run = np.repeat(np.arange(len(edge)), ends - edge)
    keep = small[run] & (a == b)
    for step in range(1, SMALL):
        if step >= len(pdf):
            break
        i = np.flatnonzero(keep[:-step] & (run[:-step] == run[step:]))
        if not len(i):
            break
        i = i[(np.einsum("ij,ij->i", x[i], x[i + step]) >= cosine) & (ids[i] != ids[i + step])]
        first = np.array([not _shares(filters[k], filters[k + step], cell[k]) for k in i], bool)
        i = i[first] if len(i) else i
        lefts.append(i)
        rights.append(i + step)
    for k in np.flatnonzero(~small | (a[edge] != b[edge])):
        s, e = edge[k], ends[k]
        order = s + np.argsort(of[s:e], kind="stable")
        pair = a[s] != b[s]
        split = int((of[order] == a[s]).sum())
        i, j = _links(x[order], ids[order], [filters[o] for o in order], int(cell[s]), slice(split, e - s) if pair else None, cosine)
        lefts.append(order[i])
        rights.append(order[j])
    u, v = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (lefts, rights))
    if len(u):
        who, at = np.unique(np.r_[ids[u], ids[v]], return_inverse=True)
        n = np.bincount(at, np.r_[copies[v], copies[u]]).astype(np.int64)
        p, q = forest(ids[u], ids[v])
        yield pd.DataFrame({"kind": np.r_[np.ones(len(who), int), np.full(len(p), 2)], "x": np.r_[who, p], "y": np.r_[n, q]})


def _shares(f: np.ndarray, g: np.ndarray, below: int) -> bool:
    return bool(np.intersect1d(f[f < below], g[g < below]).size)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding); other columns are of no effect.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. Those of different
    lengths don't link; each length, of which there are few, is searched by itself. Equal vectors are compared once:
    they link with each other and have the same links to the rest. Rows with null vec_id come back with no links and
    null component; rows that repeat an id are one vertex, and come back once for each row. An empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = vectors.where(F.col("vec_id").isNotNull() & fine).select("vec_id", F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v")).distinct()
    ids = vectors.select("vec_id")
    # Classes of equal vectors, by a digest; the least id stands for all.
    named = usable.select("vec_id", "v", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), " "), 256).alias("h"))
    classes = cut(named.groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "classes")
    member = named.select("vec_id", "h").join(classes.select("h", "rep", "copies"), "h").select("vec_id", "rep", "copies")
    found = spark.createDataFrame([], FOUND)
    for d, n in classes.groupBy(F.size("v").alias("d")).count().where("count > 1").orderBy("d").collect():
        dealt = _dealt(classes.where(F.size("v") == d).select(F.col("rep").alias("vec_id"), "copies", "v"), n, d, cosine)
        found = found.union(cut(dealt.mapInPandas(lambda parts: _compare(parts, cosine), FOUND), "found"))
    degree = found.where("kind = 1").groupBy(F.col("x").alias("rep")).agg(F.sum("y").alias("links"))
    comps = connected_components(found.where("kind = 2").select(F.col("x").alias("src"), F.col("y").alias("dst")))
    per = classes.select("rep", "copies").join(degree, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    per = cut(per.select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "per-class")
    links = member.join(per, "rep").groupBy("vec_id").agg(F.sum("links").alias("n_links"), F.min("component").alias("component_id"))
    links = cut(links, "links")
    out = ids.join(links, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _dealt(rows: DataFrame, n: int, d: int, cosine: float) -> DataFrame:
    """A row for each vector, filter it passes and, where that filter is crowded, pair of blocks it is in; sorted."""

    codes = make_codes(n, d, cosine)

    def passing(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for begin in range(0, len(whole), 2048):
                pdf = whole.iloc[begin : begin + 2048]
                x = _unit(np.array(pdf["v"].tolist(), float))
                row, cell = decode(codes, x)
                ends = np.searchsorted(row, np.arange(len(pdf) + 1))
                yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy(), "copies": pdf["copies"].to_numpy(), "v": list(x), "filters": [cell[a:b] for a, b in zip(ends, ends[1:], strict=False)]})

    coded = cut(rows.mapInPandas(passing, "vec_id long, copies long, v array<double>, filters array<long>"), "coded")
    cells = coded.select("vec_id", F.explode("filters").alias("cell"))
    crowd = cut(cells.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > 1), "cells")
    joined = coded.select("vec_id", F.explode("filters").alias("cell")).join(crowd, "cell")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    of = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) % F.col("n")
    spread = joined.select("vec_id", "cell", blocks.alias("n")).withColumn("of", of.cast("int")).select("vec_id", "cell", "of", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("with"))
    spread = spread.select("vec_id", "cell", "of", F.least("of", "with").alias("a"), F.greatest("of", "with").alias("b"))
    full = spread.join(coded, "vec_id").select("vec_id", "copies", "v", "cell", "filters", "a", "b", "of")
    return full.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b", "of", "vec_id")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_embedding_near_dedup": op3_embedding_near_dedup}
