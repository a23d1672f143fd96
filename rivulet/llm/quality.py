"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are of the whole text. Trees are grown level by level on binned features with logistic loss, then laid
out as complete binary trees in three arrays, so that all rows go down all levels at once in numpy.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import release, small_batches, table

#: Labelled rows that the trees are fitted on, at most: a sample by hash of ids, the bound of this operator.
FIT_ROWS = 20_000
#: A document is rejected where its score is below this.
THRESHOLD = 0.3

_B = np.arange(256)
_LOWER, _UPPER, _DIGIT = (_B >= 97) & (_B <= 122), (_B >= 65) & (_B <= 90), (_B >= 48) & (_B <= 57)
_SPACE, _HIGH = np.isin(_B, [32, 9, 10, 11, 12, 13]), _B >= 128
_PLAIN = np.isin(_B, [44, 46])
_SYMBOL = (_B > 32) & (_B < 127) & ~_LOWER & ~_UPPER & ~_DIGIT & ~_PLAIN
_KINDS = np.array([_LOWER, _UPPER, _DIGIT, _SPACE, _HIGH, _PLAIN, _SYMBOL], float).T
FEATURES = (
    "lower", "upper", "digit", "space", "high", "plain", "symbol", "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "same_as_last",
    "double_symbols", "log_lines", "distinct_lines", "line_bytes", "packed", "upper_words", "odd_ends", "sentence_words",
)


def statistics(text: str | None) -> list[float]:
    """FEATURES of a text; null is as the empty text, whose ratios are all 0."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    a = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(a, minlength=256) @ _KINDS / n
    words, lines = raw.split(), raw.split(b"\n")
    m = len(words)
    if m:
        counts = Counter(words)
        top, distinct = max(counts.values()) / m, len(counts) / m
        same = sum(map(operator.eq, words, words[1:])) / m
        upper = sum(map(bytes.isupper, words)) / m
        ends = Counter(map(_LAST, words))
        odd = sum(v for k, v in ends.items() if _SYMBOL[k]) / m
        sentences = ends.get(46, 0) + 1
    else:
        top = distinct = same = upper = odd = 0.0
        sentences = 1
    twice = float(((a[1:] == a[:-1]) & _SYMBOL[a[1:]]).sum()) / n
    return [
        *kinds, np.log1p(n), np.log1p(m), n / (m + 1), distinct, top, same, twice, np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines),
        len(zlib.compress(raw, 1)) / n, upper, odd, m / sentences,
    ]


_LAST = operator.itemgetter(-1)


@dataclass
class Trees:
    """Complete binary trees of one depth: inner node i has children 2i+1 and 2i+2; a row goes right where its feature
    is above the threshold. leaf[t] has the values of the last level."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Fits `trees` trees. Without rows, or with one class alone, the score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1)
    margin = np.full(len(y), base)
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)  # within its level
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            best, gain_of = np.full(width, -1), np.full(width, 1e-9)
            cut = np.zeros(width, np.int64)
            for j in range(d):
                k = len(edges[j]) + 1
                cell = node * k + binned[:, j]
                gs = np.bincount(cell, g, width * k).reshape(width, k).cumsum(1)
                hs = np.bincount(cell, h, width * k).reshape(width, k).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                gain[(hs < least) | (ha - hs < least)] = -1
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                won = top > gain_of
                best[won], gain_of[won], cut[won] = j, top[won], at[won]
            for w in range(width):
                if best[w] >= 0 and cut[w] < len(edges[best[w]]):
                    out.feature[t, first + w], out.threshold[t, first + w] = best[w], edges[best[w]][cut[w]]
            right = x[np.arange(len(y)), out.feature[t, first + node]] > out.threshold[t, first + node]
            node = 2 * node + right
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        out.leaf[t] = -rate * gs / (hs + ridge)
        margin += out.leaf[t][node]
    return out


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5, is 0: never learned from. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Fits on at most about `rows` labelled documents that aren't held out, drawn by a hash of their ids.

    Labels other than 0 and 1, of null ids or without a document, are of no effect. Statistics of these rows alone
    come to the driver: rows x len(FEATURES) numbers.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # about `rows` rows

    def measure(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [statistics(t) for t in pdf["text"]]})

    got = texts.mapInPandas(measure, "doc_id long, y int, x array<double>").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.array(got["x"].tolist(), float), got["y"].to_numpy(float)
    order = np.lexsort((y, *x.T, got["doc_id"].to_numpy()))  # rows come in any order; sums of floats depend on it
    return fit(x[order], y[order])


def scored(docs: DataFrame, trees: Trees, out: str = "score") -> DataFrame:
    """Adds `out`, the score of each text by its statistics alone; null texts count as empty. A column of that name is replaced."""
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.DoubleType())])

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            x = np.array([statistics(t.as_py()) for t in column("text")], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(column(f.name) for f in keep), pa.array(trees.score(x), pa.float64())], names=[*(f.name for f in keep), out])
        release()

    return docs.mapInArrow(run, schema)


def good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that aren't rejected, with the columns they had."""
    name = "__score"
    return scored(docs, train(docs, labels), name).where(F.col(name) >= threshold).drop(name)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
