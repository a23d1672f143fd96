"""Mixing sources to target weights: token blocks, multinomial shard counts, pseudorandom index permutations.

Words are packed into blocks of BLOCK_WORDS within each source. Each output shard draws its counts of blocks by source
from a multinomial over what the sources still owe; the last shard takes the rest. A slot is mapped through its source's
keyed permutation of block indices, a new one for each pass over the source, and the slots join the blocks by (source,
index). A source's last slot is cut to the words it still owes, so totals meet the targets to the word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.common import WORD, cut, small_batches, table

BLOCK_WORDS = 256
#: No source is taken more often than this.
MAX_PASSES = 3
#: Blocks in an output shard, where that makes LEAST_SHARDS to MAX_SHARDS shards; else shards are smaller, or grow.
SHARD_BLOCKS, LEAST_SHARDS, MAX_SHARDS = 4_096, 16, 1_024
#: Rows of the plan, at most: a row for each shard and source. With more sources there are fewer shards.
PLAN_ROWS = 1 << 20
#: Slots of a row of work at most, slots of a task on average, and tasks at most.
STEP, TASK_SLOTS, MOST_TASKS = 1 << 14, 1 << 12, 20_000
#: Up to so many sources are sent to every executor; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: Documents of a source fall into this many ranges whose sums are added up first, so that no source is one task's.
BUCKETS = 1_024
SEED = 17
_WORD = re.compile(WORD)


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weights(n: int) -> np.ndarray:
    """1, 2, 3, repeating."""
    return 1.0 + np.arange(n) % 3


def targets(sizes: np.ndarray, weight: np.ndarray, passes: int = MAX_PASSES) -> np.ndarray:
    """Shares of the sum of sizes by weight; none above `passes` times its size, the excess going to the others.

    Sources reach their bounds in order of bound / weight, so one pass over them in that order finds the level.
    Where every source is at its bound or empty, nothing more is given out.
    """
    sizes = np.asarray(sizes, float)
    bound, out = passes * sizes, np.zeros(len(sizes))
    order = np.argsort(bound / weight, kind="stable")
    left, over = sizes.sum(), weight.sum()
    for k, i in enumerate(order):
        if left * weight[i] / over <= bound[i]:
            rest = order[k:]
            out[rest] = left * weight[rest] / over
            break
        out[i] = bound[i]
        left, over = left - bound[i], over - weight[i]
    return out


def draws(slots: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """[shard, source] counts of blocks: multinomial by what is still owed, totals exactly `slots`."""
    rng, left = np.random.default_rng(seed), slots.astype(np.int64).copy()
    out, total = np.zeros((shards, len(slots)), np.int64), int(slots.sum())
    for s in range(shards):
        want = min(int(left.sum()), total * (s + 1) // shards - total * s // shards)
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[s] += got
            left -= got
            want -= int(got.sum())
    return out


def _network(n: int, key: int) -> tuple[int, int, np.ndarray]:
    a = int(np.ceil(np.sqrt(n)))
    return a, -(-n // a), np.frombuffer(hashlib.blake2b(str(key).encode(), digest_size=32).digest(), np.uint64)


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1: four Feistel rounds on a x b >= n, walked on until the value is below n.

    `back`: its inverse.
    """
    a, b, keys = _network(n, key)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        left, right = out[todo] // np.uint64(b), out[todo] % np.uint64(b)
        for r in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            if r % 2:
                by = _mixed(left, keys[r]) % np.uint64(b)
                right = (right + (np.uint64(b) - by if back else by)) % np.uint64(b)
            else:
                by = _mixed(right, keys[r]) % np.uint64(a)
                left = (left + (np.uint64(a) - by if back else by)) % np.uint64(a)
        out[todo] = left * np.uint64(b) + right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))) >> np.uint64(8)


def pass_key(seed: int, source: int, turn: int) -> int:
    return (seed * 1_000_003 + source) * (MAX_PASSES + 1) + turn


def slots_for(want: int, size: int, block_words: int, seed: int, source: int) -> tuple[int, int]:
    """(slots, words of the last one) that together have `want` words, at most MAX_PASSES times `size`.

    A pass has `size` words. In the last one, all blocks are full but for the source's last: it is known at which slot
    that comes.
    """
    if not size or not want:
        return 0, 0
    blocks = -(-size // block_words)
    turns, rest = divmod(want, size)
    short = size - (blocks - 1) * block_words
    if not rest:
        turns, rest = turns - 1, size
    at = int(permuted(np.array([blocks - 1]), blocks, pass_key(seed, source, turns), back=True)[0])
    n = -(-rest // block_words)
    if at < n:  # the short block is among these
        n = at + 1 + max(0, -(-(rest - at * block_words - short) // block_words))
        if rest <= at * block_words:
            n = -(-rest // block_words)
    before = (n - 1) * block_words - (block_words - short if at < n - 1 else 0)
    return turns * blocks + n, rest - before


def sized(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, th, bucket): what the packing needs; `whole` adds __doc, the row as it was."""
    kept = [F.struct(*(docs[c] for c in docs.columns)).alias("__doc")] if whole else []
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("th"), *kept)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(BUCKETS)))


def source_table(rows: DataFrame) -> list[tuple[str | None, int]]:
    """(source, words) by code point, null last: a row for each source, of which there are few."""
    got = [(r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    return sorted(got, key=lambda x: (x[0] is None, x[0] or ""))


def offsets(rows: DataFrame) -> DataFrame:
    """Adds start, the word of its source at which a row begins, in two steps: sums of buckets, then rows in a bucket.

    Rows are ordered by (bucket, doc_id, size, hash of text); equal ones are alike, so any order of them gives the
    same result.
    """
    sums = rows.groupBy("__s", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most BUCKETS rows for each source.
    sums = cut(sums.select(F.col("__s").alias("s2"), F.col("bucket").alias("b2"), before.alias("base")), "bases")
    inside = F.sum("size").over(Window.partitionBy("__s", "bucket").orderBy("doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    run = rows.withColumn("inside", inside)
    return run.join(sums, (run["__s"] == sums["s2"]) & (run["bucket"] == sums["b2"])).withColumn("start", F.col("base") + F.col("inside")).drop("inside", "base", "s2", "b2")


def _numbered(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds the number of a row's source, its words and its target; `known` has a row for each source."""
    small = known.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(known) if small else known, rows["source"].eqNullSafe(known["__source"])).drop("__source")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots) of a mix.

    documents: doc_id, source, size, source_size, target, taken. pieces: row's source number, block, first word and
    words of it in the block, and the place of these there. slots: shard, slot, source number, pass, block, words (of
    the block that are taken, from its first). Null ids, sources and texts are kept; texts without words, null and
    empty ones take part with none; repeated rows are rows of their own; columns of other names are ignored. An empty
    table gives empty results.
    """
    documents, pieces, slots, _ = _mix(docs, block_words, seed)
    return documents, pieces, slots


def _mix(docs: DataFrame, block_words: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    spark = docs.sparkSession
    rows = cut(sized(docs), "sizes")
    sources = source_table(rows)
    sizes = np.array([n for _, n in sources], np.int64)
    target = targets(sizes, weights(len(sources)))
    blocks = -(-sizes // block_words)
    asked = [slots_for(int(min(round(t), MAX_PASSES * n)), int(n), block_words, seed, i) for i, (t, n) in enumerate(zip(target, sizes, strict=True))]
    slots, last = np.array([n for n, _ in asked], np.int64), [w for _, w in asked]
    # Sent by Arrow: lists would start plain Python workers on the executors, which stay beside those of pandas.
    known = {"__s": pa.array(np.arange(len(sources)), pa.int32()), "__source": pa.array([x for x, _ in sources], pa.string()), "source_size": pa.array(sizes, pa.int64())}
    known = spark.createDataFrame(pa.table(known | {"target": pa.array(target, pa.float64())}))
    rows = cut(_numbered(rows, known), "sourced")
    total = int(slots.sum())
    shards = max(1, min(MAX_SHARDS, PLAN_ROWS // max(1, len(sources)), max(LEAST_SHARDS, -(-total // SHARD_BLOCKS)), total))
    counts = draws(slots, shards, seed)
    starts = np.cumsum(counts, 0) - counts
    shard, at = np.nonzero(counts)
    plan = {"shard": shard.astype(np.int32), "s": at.astype(np.int32), "first": starts[shard, at], "n": counts[shard, at]}
    plan = spark.createDataFrame(pa.table(plan | {"blocks": blocks[at], "slots": slots[at], "last": np.array(last, np.int64)[at]}))
    spread = plan.select("shard", "s", "blocks", "slots", "last", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STEP))).alias("k"))
    spread = spread.select("shard", "s", "blocks", (F.col("first") + F.col("k") * STEP).alias("first"), F.least(F.lit(STEP).cast("long"), F.col("n") - F.col("k") * STEP).alias("n"), "slots", "last")

    def map_slots(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, s, n_blocks, first, n, n_slots, words_left in pdf.itertuples(index=False):
                at = np.arange(first, first + n)
                turn, block = at // n_blocks, np.empty(n, np.int64)
                for t in np.unique(turn):
                    now = turn == t
                    block[now] = permuted(at[now] % n_blocks, int(n_blocks), pass_key(seed, int(s), int(t)))
                yield pd.DataFrame({"shard": shard, "slot": at, "s": s, "pass": turn, "block": block, "words": np.where(at == n_slots - 1, words_left, block_words)})

    tasks = max(1, min(MOST_TASKS, -(-total // TASK_SLOTS)))
    drawn = spread.repartition(tasks, "shard", "s", "first").mapInPandas(map_slots, "shard int, slot long, s int, pass long, block long, words long")
    # A row of `size` words touches the blocks of its first to its last word; one without words touches none.
    run = offsets(rows)
    touched = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = run.select(F.col("__s").alias("s"), "doc_id", "size", "start", F.explode(touched).alias("block"))
    pieces = pieces.select("s", "block", "doc_id", "size", "start", (lo - F.col("start")).alias("first"), (hi - lo).alias("n"), (lo - F.col("block") * block_words).alias("at"))
    drawn = cut(drawn, "slots")
    # Uses of a block as a whole, and the words of the use that is cut: a source has one such slot at most.
    whole = F.col("words") >= block_words
    uses = cut(drawn.groupBy("s", "block").agg(F.count(F.when(whole, 1)).alias("uses"), F.max(F.when(~whole, F.col("words"))).alias("part")), "uses")
    some = F.greatest(F.lit(0), F.least("n", F.coalesce("part", F.lit(0)) - F.col("at")))
    taken = pieces.join(uses, ["s", "block"]).groupBy("s", "doc_id", "size", "start").agg(F.sum(F.col("n") * F.col("uses") + some).alias("taken"))
    taken = taken.select(F.col("s").alias("t_s"), F.col("doc_id").alias("t_id"), F.col("start").alias("t_start"), F.col("taken"))
    words_of = run.join(taken, (run["__s"] == taken["t_s"]) & (run["start"] == taken["t_start"]) & (run["size"] > 0), "left")
    documents = words_of.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return documents, pieces, drawn, known


def _words_of(text: pd.Series, n: pd.Series, pieces: pd.Series) -> pd.Series:
    """The text from the first to the last word of each unbroken stretch of pieces (first, n), stretches on lines of
    their own; a text whose every word is taken as it is."""
    out = []
    for t, size, found in zip(text, n, pieces, strict=True):
        runs: list[list[int]] = []
        for p in found:
            if runs and p["first"] == runs[-1][1]:
                runs[-1][1] += p["n"]
            else:
                runs.append([p["first"], p["first"] + p["n"]])
        if runs == [[0, size]]:
            out.append(t)
        else:
            spans = [m.span() for m in _WORD.finditer(t)]
            out.append("\n".join(t[spans[a][0] : spans[b - 1][1]] for a, b in runs))
    return pd.Series(out)


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words of it, with the columns of `docs`.

    text has the words taken, n_chars (where there is such a column) its length. Documents without words are in no block.
    """
    small_batches(docs.sparkSession)
    _, pieces, drawn, known = _mix(docs, block_words, seed)
    used = pieces.join(drawn.select("s", "block", "pass", "words"), ["s", "block"]).withColumn("n", F.least("n", F.col("words") - F.col("at"))).where("n > 0")
    got = used.groupBy("s", "start", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("found"))
    got = got.select(F.col("s").alias("g_s"), F.col("start").alias("g_start"), "found")
    rows = offsets(_numbered(sized(docs, whole=True), known)).where("size > 0")
    both = rows.join(got, (rows["__s"] == got["g_s"]) & (rows["start"] == got["g_start"]))
    taken = both.select("__doc", F.pandas_udf(_words_of, "string")(F.col("__doc.text"), "size", "found").alias("__text"))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return taken.select(*(new[c].alias(c) if c in new else F.col("__doc")[c].alias(c) for c in docs.columns))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _, _ = mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_mix_sources": op8_mix_sources}
