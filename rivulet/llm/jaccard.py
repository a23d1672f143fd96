"""N-gram Jaccard join: T-occurrence search by DivideSkip, and the components of the links it finds.

1. Each text becomes the set of 64-bit hashes of its distinct word shingles. Texts with the same set are one class.
2. A fixed-size sketch of how often shingles occur, over all documents, gives one order of all shingles, rare ones
   first. Two sets can only link if their prefixes in this order share a shingle; prefixes that are l - 1 longer share
   l of them. Sets of which too few prefix shingles occur in any other prefix are out, most of them; the others that
   share one are joined into candidate groups. Only connections are kept, never pairs.
3. Each group is searched by itself: an inverted index from shingles to documents; for each document the T shingles
   that a partner must share at least; its longest lists are set aside (DivideSkip), the short ones are merged with a
   heap, and what occurs often enough there is probed for in the long ones by binary search. A list's entries are
   blocks of documents with a bit for each, so the heap and the probes move a block at a time and counters of a block's
   documents are added up bit by bit, all at once. Blocks whose documents are connected already are skipped.
4. A group too large for a task is dealt into blocks, and a few of its documents into each of them; each is searched.
   What is connected by then needs no more; of the other documents, pairs of blocks are searched.

The result is exact, but for collisions of 64-bit hashes within a pair of documents.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import cut, release, small_batches, table
from rivulet.llm.components import connected_components, forest

WORDS, SIMILARITY = 5, 75  # per cent
#: Cells of the sketch, and those in a row of it that is shuffled. Its size is the same for any input.
CELL_BITS, CELLS_IN_ROW = 22, 1 << 16
#: Shingles seen more often than this, and four times as often as the average cell, have their documents dealt over SALTS keys.
HOT, SALTS = 200_000, 256
#: Shingles and documents of a group that one task searches at once; larger groups are dealt into blocks. A block has
#: BLOCK_DOCS documents or the LEAST_PART-th part of its group, up to MOST_BLOCK_DOCS, so large groups aren't copied too often.
GROUP_SHINGLES, GROUP_DOCS = 2_000_000, 256
BLOCK_DOCS, LEAST_PART, MOST_BLOCK_DOCS = 128, 64, 4_096
#: Documents of a large group that are dealt into each of its blocks.
LEADERS = 4
#: Prefixes are longer by a SPARE-th of the set, and as many more shingles must be shared.
SPARE = 10
#: Prefix shingles that a task compares at once, about; each document's fall into at least LEAST_BUCKETS parts.
BUCKET_SHINGLES, LEAST_BUCKETS = 1_000_000, 64
#: Bits of the filter by which texts that a join can't need are told before any are moved, and those in a row of it.
#: It is what executors get of the candidate documents and of those to drop; its size is the same for any input.
FILTER_BITS, BITS_IN_ROW = 25, 1 << 15
#: The cost factor of DivideSkip by which lists are split into long and short.
MU = 0.0085
#: Documents in an entry of an inverted list.
WIDTH = 256

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Hashes of words, remembered; starts anew when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def forget_words() -> None:
    _WORDS.clear()


def _forgetting(run):
    """`run` as a task; what it remembers of words goes as it ends, since its process lives on."""

    def task(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            forget_words()
            release()

    return task


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of a shorter text, of all its words as one; null or no words: none."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(found), seed=n)], np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, n)
    s = h[: n - words + 1].copy()
    for k in range(1, words):
        s ^= s >> np.uint64(29)
        s *= _MUL
        s += h[k : n - words + 1 + k]
    s ^= s >> np.uint64(31)
    s *= _MIX
    s ^= s >> np.uint64(29)
    return np.unique(s)


def least_shared(n: int, similarity: int = SIMILARITY) -> int:
    """Shingles that a set of n shares at least with any that it links with."""
    return -(-similarity * n // 100)


def spare(n: int) -> int:
    """l of a set of n shingles."""
    return max(1, n // SPARE)


def _cell(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)


def prefix(s: np.ndarray, level: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """The first shingles of a sorted set in the order of (level, hash).

    Of n and m shingles, linked sets share t = max(least_shared(n), least_shared(m)) or more. Their first n - t + l
    and m - t + l then share l, whatever the order; here l is the smaller one's `spare`.
    """
    order = np.argsort((level[_cell(s)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")
    return s[order[: len(s) - least_shared(len(s), similarity) + spare(len(s))]]


def _add(planes: list[int], mask: int) -> None:
    """Adds 1 to the counters of a mask's documents; plane k has bit k of each counter."""
    k = 0
    while mask:
        if k == len(planes):
            planes.append(mask)
            return
        plane = planes[k]
        planes[k], mask, k = plane ^ mask, plane & mask, k + 1


def _reaching(planes: list[int], least: int, of: int) -> int:
    """Those documents of a mask whose counters are `least` or more."""
    if least >> len(planes):
        return 0
    above = 0
    for k in range(len(planes) - 1, -1, -1):
        if least >> k & 1:
            of &= planes[k]
        else:
            above |= of & planes[k]
            of &= ~planes[k]
    return above | of


class Index:
    """Inverted lists of documents 0..m-1, which come by falling size, and the T-occurrence search over them.

    A list is sorted, and holds WIDTH documents an entry: (block, mask of the documents in it).
    """

    def __init__(self, sizes: np.ndarray, ids: np.ndarray, owner: np.ndarray, lists: int) -> None:
        """`ids`, `owner`: list and document of each entry, sorted by list, then document."""
        self.blocks: list[list[int]] = [[] for _ in range(lists)]
        self.masks: list[list[int]] = [[] for _ in range(lists)]
        for k, block, bit in zip(ids.tolist(), (owner // WIDTH).tolist(), (owner % WIDTH).tolist(), strict=True):
            blocks = self.blocks[k]
            if blocks and blocks[-1] == block:
                self.masks[k][-1] |= 1 << bit
            else:
                blocks.append(block)
                self.masks[k].append(1 << bit)
        self.df = np.bincount(ids, minlength=lists).tolist()
        #: The documents of a block by size: (size, mask).
        self.by_size: list[list[tuple[int, int]]] = [[] for _ in range(-(-len(sizes) // WIDTH))]
        edges = np.flatnonzero(np.r_[True, (sizes[1:] != sizes[:-1]) | (np.arange(1, len(sizes)) % WIDTH == 0)]) if len(sizes) else np.empty(0, np.int64)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(sizes)], strict=True):
            self.by_size[a // WIDTH].append((int(sizes[a]), ((1 << (b - a)) - 1) << (a % WIDTH)))

    def partners(self, own: list[int], n: int, blocks: range, open_, similarity: int) -> Iterator[int]:
        """The documents in open_(block), a mask, that a set of n shingles with the lists `own` links with.

        None of them is larger than the set. What open_ gives may shrink as partners are met.
        """
        t = least_shared(n, similarity)
        if not t or len(own) < t:
            return
        own = sorted(own, key=self.df.__getitem__)
        n_long = min(t - 1, int(t / (MU * math.log2(max(2, self.df[own[-1]])) + 1)))
        short, long_ = own[: len(own) - n_long], own[len(own) - n_long :]
        least = t - n_long
        heap = []
        for k in short:
            entries = self.blocks[k]
            if (at := bisect_left(entries, blocks.start)) < len(entries):
                heap.append((entries[at], k, at))
        heapq.heapify(heap)
        while len(heap) >= least and (block := heap[0][0]) < blocks.stop:
            if not (here := open_(block)):  # on to the next block with documents to look at
                block = next((b for b in range(block + 1, blocks.stop) if open_(b)), blocks.stop)
                while heap and heap[0][0] < block:
                    _, k, at = heap[0]
                    at = bisect_left(self.blocks[k], block, at)
                    if at < len(self.blocks[k]):
                        heapq.heapreplace(heap, (self.blocks[k][at], k, at))
                    else:
                        heapq.heappop(heap)
                continue
            met = []
            while heap and heap[0][0] == block:
                _, k, at = heap[0]
                met.append(self.masks[k][at])
                at += 1
                if at < len(self.blocks[k]):
                    heapq.heapreplace(heap, (self.blocks[k][at], k, at))
                else:
                    heapq.heappop(heap)
            if len(met) < least:
                continue
            planes: list[int] = []
            for mask in met:
                _add(planes, mask & here)
            if not (left := _reaching(planes, least, here)):
                continue
            for k in long_:
                entries = self.blocks[k]
                if (at := bisect_left(entries, block)) < len(entries) and entries[at] == block:
                    _add(planes, self.masks[k][at] & left)
            left = _reaching(planes, t, left)
            if not left:
                continue
            linked = 0
            for m, mask in self.by_size[block]:
                if some := left & mask:  # 100 * shared >= similarity * (n + m - shared)
                    linked |= _reaching(planes, -(-similarity * (n + m) // (100 + similarity)), some)
            while linked := linked & open_(block):
                bit = linked & -linked
                linked ^= bit
                yield block * WIDTH + bit.bit_length() - 1


def search(sets: list[np.ndarray], label: np.ndarray | None = None, similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of linked sets that connect all sets which links connect, beyond those of equal `label`.

    Documents come by falling size. For each, partners are sought among those after it, of at least `similarity` per
    cent of its size; those connected with it already are left out.
    """
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    by_size = np.argsort(-sizes, kind="stable")
    sizes = sizes[by_size]
    flat = np.concatenate([sets[i] for i in by_size]) if m else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(m), sizes)
    ids, df = np.unique(flat, return_inverse=True, return_counts=True)[1:]
    often = df[ids] > 1  # what no other set has is in no list
    numbers = np.cumsum(df > 1) - 1
    ids, owner = numbers[ids[often]], owner[often]
    order = np.lexsort((owner, ids))
    index = Index(sizes, ids[order], owner[order], int((df > 1).sum()))
    ends = np.searchsorted(owner, np.arange(m + 1)).tolist()
    # Components: each with its documents, and these as a mask for each block.
    root = (np.arange(m) if label is None else np.unique(label[by_size], return_inverse=True)[1]).tolist()
    inside: dict[int, list[int]] = {}
    masks: dict[int, dict[int, int]] = {}
    for k, c in enumerate(root):
        inside.setdefault(c, []).append(k)
        mine = masks.setdefault(c, {})
        mine[k // WIDTH] = mine.get(k // WIDTH, 0) | 1 << k % WIDTH
    left, right = [], []
    least = [least_shared(n, similarity) for n in sizes.tolist()]
    last = np.searchsorted(-sizes, [-n for n in least], side="right").tolist() if m else []
    for r in range(m):
        first, end = r + 1, last[r]
        if first >= end or not least[r]:
            continue
        blocks = range(first // WIDTH, (end - 1) // WIDTH + 1)

        def open_(block: int, r: int = r, first: int = first, end: int = end) -> int:
            at = block * WIDTH
            lo, hi = max(first - at, 0), min(end - at, WIDTH)
            return ((1 << hi) - (1 << lo)) & ~masks[root[r]].get(block, 0) if lo < hi else 0

        if not any(map(open_, blocks)):
            continue
        for s in index.partners(ids[ends[r] : ends[r + 1]].tolist(), int(sizes[r]), blocks, open_, similarity):
            left.append(by_size[s])
            right.append(by_size[r])
            x, y = root[r], root[s]
            if len(inside[x]) < len(inside[y]):
                x, y = y, x
            for k in inside[y]:
                root[k] = x
            inside[x] += inside.pop(y)
            into = masks[x]
            for block, mask in masks.pop(y).items():
                into[block] = into.get(block, 0) | mask
    return np.array(left, np.int64), np.array(right, np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _node(digest: bytes) -> int:
    """A set's number among candidates. Should two sets have one, they are candidates together."""
    return int.from_bytes(digest[:8], "big", signed=True)


def _sets_and_counts(words: int):
    """Rows (doc_id, th, n, digest of the set), then the task's part of the sketch in rows (n: row of it, digest: counts)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << CELL_BITS, np.uint16)
        any_ = False
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                s = shingles(text, words)
                rows.append((len(s), _digest(s)))
                at = _cell(s)
                counts[at] += counts[at] < 65_535  # a cell that a set meets twice counts once
            any_ = any_ or any(n for n, _ in rows)
            yield pd.DataFrame({"row": False, "doc_id": pdf["doc_id"].astype("Int64"), "th": pdf["th"], "n": [n for n, _ in rows], "key": [k for _, k in rows], "node": [_node(k) for _, k in rows]})
        if any_:
            for k in range(0, 1 << CELL_BITS, CELLS_IN_ROW):
                yield pd.DataFrame({"row": [True], "doc_id": pd.array([None], "Int64"), "th": [0], "n": [k // CELLS_IN_ROW], "key": [zlib.compress(counts[k : k + CELLS_IN_ROW].tobytes(), 1)], "node": [0]})

    return run


def _hot_level(level: np.ndarray, hot: int) -> int:
    """The level from which a cell is hot: `hot` shingles, or four times the average cell's where that is more.

    Were the bound fixed, every cell of a large corpus would pass it.
    """
    average = float(np.exp2(level / 4).mean()) - 1
    return int(4 * np.log2(max(hot, 4 * average) + 1))


def _levels(parts: DataFrame) -> np.ndarray:
    """The sketch as levels, four for each doubling: a byte for each cell. Parts are added up on the executors."""

    def add(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, packed in zip(pdf["n"], pdf["key"], strict=True):
                part = np.frombuffer(zlib.decompress(packed), np.uint16).astype(np.int64)
                total[k] = total[k] + part if k in total else part
        for k, counts in total.items():
            yield pd.DataFrame({"n": [k], "levels": [np.floor(4 * np.log2(counts + 1)).astype(np.uint8).tobytes()]})

    out = np.zeros(1 << CELL_BITS, np.uint8)
    rows = (1 << CELL_BITS) // CELLS_IN_ROW
    for r in parts.select("n", "key").repartition(rows, "n").mapInPandas(add, "n long, levels binary").toLocalIterator():
        out[r["n"] * CELLS_IN_ROW : (r["n"] + 1) * CELLS_IN_ROW] = np.frombuffer(r["levels"], np.uint8)
    return out


PARTS = "bucket long, hot boolean, nodes binary, sizes binary, times binary, low binary"
SHARED = "h long, hot boolean, n int, node long"


def _prefix_parts(level, words: int, similarity: int, hot_level: int, bits: int):
    """Prefixes by bucket, the highest `bits` of a hash: for each batch and bucket the sets, their sizes, how many
    shingles they have there, and the 32 bits of these that come next. Hot shingles go to buckets by set as well."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[int, tuple[int, np.ndarray]] = {}
            for text in pdf["text"]:
                s = shingles(text, words)
                if len(s):
                    found[_node(_digest(s))] = (len(s), prefix(s, level.value, similarity))
            if not found:
                continue
            nodes = np.fromiter(found, np.int64, len(found))
            sizes = np.array([n for n, _ in found.values()], np.int32)
            h = np.concatenate([p for _, p in found.values()])
            own = np.repeat(np.arange(len(found)), [len(p) for _, p in found.values()])
            hot = level.value[_cell(h)] >= hot_level
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
            salt = (nodes[own].astype(np.uint64) * _MUL) >> np.uint64(64 - 8)
            bucket[hot] = ((h[hot] ^ (salt[hot] * _MIX)) * _MUL >> np.uint64(64 - bits)).astype(np.int64)
            for is_hot in (False, True):
                at = np.flatnonzero(hot == is_hot)
                if not len(at):
                    continue
                at = at[np.argsort(bucket[at], kind="stable")]
                edges = np.flatnonzero(np.r_[True, bucket[at][1:] != bucket[at][:-1]])
                rows = []
                for a, b in zip(edges, [*edges[1:], len(at)], strict=True):
                    own_ = own[at[a:b]]
                    first = np.flatnonzero(np.r_[True, own_[1:] != own_[:-1]])
                    who, times = own_[first], np.diff(np.r_[first, b - a]).astype(np.int32)
                    part = h[at[a:b]]
                    low = part if is_hot else ((part >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    rows.append((int(bucket[at[a]]), is_hot, nodes[who].tobytes(), sizes[who].tobytes(), times.tobytes(), low.tobytes()))
                yield pd.DataFrame(rows, columns=["bucket", "hot", "nodes", "sizes", "times", "low"])

    return run


def _compatible(n: np.ndarray, similarity: int) -> np.ndarray:
    """For sizes in order within a run: whether each and the next one can link."""
    return 100 * n[:-1] >= similarity * n[1:]


def _shared(similarity: int):
    """From rows of PARTS sorted by bucket: (h, hot, n, node) of the shingles that another set of fitting size has in
    its prefix too. Hot shingles all count as shared."""

    def one(rows: list[tuple]) -> pd.DataFrame:
        out = []
        for is_hot in (False, True):
            some = [r for r in rows if r[1] == is_hot]
            if not some:
                continue
            times = np.concatenate([np.frombuffer(r[4], np.int32) for r in some])
            node = np.repeat(np.concatenate([np.frombuffer(r[2], np.int64) for r in some]), times)
            n = np.repeat(np.concatenate([np.frombuffer(r[3], np.int32) for r in some]), times)
            low = np.concatenate([np.frombuffer(r[5], np.uint64 if is_hot else np.uint32) for r in some])
            h = low.view(np.int64) if is_hot else (np.int64(some[0][0]) << np.int64(32)) | low.astype(np.int64)
            order = np.lexsort((node, n, h))
            h, n, node = h[order], n[order], node[order]
            keep = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]
            h, n, node = h[keep], n[keep], node[keep]
            with_next = (h[1:] == h[:-1]) & _compatible(n, similarity)
            met = np.r_[with_next, False] | np.r_[False, with_next] | is_hot
            out.append(pd.DataFrame({"h": h[met], "hot": is_hot, "n": n[met], "node": node[met]}))
        return pd.concat(out, ignore_index=True)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    yield one(held)
                    held = []
                held.append(row)
        if held:
            yield one(held)

    return run


def _chains(similarity: int):
    """From rows sorted by (h, n, node): a forest of the sets that share h, as far as sizes let them link.

    Where the next set is too large for the one before it, it is so for all before, and the chain is broken.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            h, n, d = (pdf[c].to_numpy() for c in ("h", "n", "node"))
            if last is not None:
                h, n, d = np.r_[last[0], h], np.r_[last[1], n], np.r_[last[2], d]
            if not len(h):
                continue
            last = h[-1], n[-1], d[-1]
            on = (h[1:] == h[:-1]) & _compatible(n, similarity) & (d[1:] != d[:-1])
            u, v = forest(d[:-1][on], d[1:][on])
            yield pd.DataFrame({"src": u, "dst": v})

    return run


def _search_groups(words: int, similarity: int):
    """Rows sorted by (comp, a, b): searches each run, and emits links that connect what it has."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, words) for t in pdf["text"]]
        u, v = search(sets, pdf["label"].to_numpy(), similarity)
        ids = pdf["doc_id"].to_numpy()
        return pd.DataFrame({"src": ids[u], "dst": ids[v]})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None
        for pdf in batches:
            at = pdf[["comp", "a", "b"]].to_numpy()
            edges = np.r_[0, np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1, len(pdf)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if s == e:
                    continue
                if held and tuple(at[s]) != key:
                    yield one(pd.concat(held, ignore_index=True))
                    held = []
                key = tuple(at[s])
                held.append(pdf.iloc[s:e])
        if held:
            yield one(pd.concat(held, ignore_index=True))

    return run


def _may_match(rows: DataFrame, key: Column, keys: DataFrame, of: Column) -> DataFrame:
    """`rows` with a column __may: false only where `key`, a hash of each row, is none of the hashes `of` in `keys`.

    A bitmap of hashes is sent to the executors, not the keys, so the driver holds as much of it whatever their number.
    """
    bit = of.bitwiseAND((1 << FILTER_BITS) - 1)
    bits = keys.select(F.floor(bit / BITS_IN_ROW).alias("__row"), bit.bitwiseAND(BITS_IN_ROW - 1).alias("at")).groupBy("__row").agg(F.bitmap_construct_agg("at").alias("__bits"))
    met = rows.withColumn("__bit", key.bitwiseAND((1 << FILTER_BITS) - 1)).join(F.broadcast(cut(bits, "filter")), F.floor(F.col("__bit") / BITS_IN_ROW) == F.col("__row"), "left")
    at = F.col("__bit").bitwiseAND(BITS_IN_ROW - 1)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.call_function("shiftright", byte, at.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return met.select(*rows.columns, may.alias("__may"))


def _search_texts(texts: DataFrame, work: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links within each (comp, a, b) of `work`, rows (comp, a, b, label, doc_id)."""
    work = cut(work, "work")
    some = _may_match(texts, F.xxhash64("doc_id"), work, F.xxhash64("doc_id")).where("__may")
    full = some.join(work, "doc_id").select("comp", "a", "b", "label", "doc_id", "text")
    return full.repartition("comp", "a", "b").sortWithinPartitions("comp", "a", "b", "doc_id").mapInPandas(_forgetting(_search_groups(words, similarity)), "src long, dst long")


def _blocks(group: DataFrame, weights: DataFrame, texts: DataFrame, words: int, similarity: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(work, links) of groups with more than `most` shingles or GROUP_DOCS documents: the links found within blocks,
    and pairs of blocks (comp, a, b, label, doc_id) still to search."""
    a_block = F.greatest(F.lit(BLOCK_DOCS), F.least(F.lit(MOST_BLOCK_DOCS), F.floor(F.col("docs") / LEAST_PART)))
    large = cut(weights.where(_is_large(most)).select("comp", a_block.alias("a_block"), F.greatest(F.ceil(F.col("weight") * 2 / most), F.ceil(F.col("docs") / a_block)).alias("parts")), "large")
    big = cut(group.join(large, "comp"), "large-groups")
    picks = big.groupBy("comp").agg(F.first("parts").alias("parts"), *(F.min(F.struct(F.xxhash64(F.lit(k), "doc_id"), "doc_id")).alias(f"l{k}") for k in range(LEADERS)))
    leaders = cut(picks.select("comp", "parts", F.explode(F.array_distinct(F.array(*(F.col(f"l{k}.doc_id") for k in range(LEADERS))))).alias("doc_id")), "leaders")
    dealt = big.select("comp", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.col("parts")).alias("a"), "doc_id")
    everywhere = leaders.select("comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("a"), "doc_id")
    first = dealt.union(everywhere).distinct().select("comp", "a", F.col("a").alias("b"), F.col("doc_id").alias("label"), "doc_id")
    links = cut(_search_texts(texts, first, words, similarity), "block-links")
    labels = cut(connected_components(links), "labels")
    named = big.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("comp", "doc_id", "n", "a_block", F.coalesce("component", "doc_id").alias("label"))
    named = cut(named, "named")
    # What is connected and would fill a block has blocks of its own; the rest shares blocks.
    sums = named.groupBy("comp", "label", "a_block").agg(F.sum("n").alias("w"), F.count("*").alias("c"))
    led = cut(sums.where((F.col("c") * 2 >= F.col("a_block")) | (F.col("w") * 4 >= most)).select("comp", "label", F.col("label").alias("led")), "led")
    named = cut(named.join(led, ["comp", "label"], "left"), "led-or-not")
    sums = named.groupBy("comp", "led", "a_block").agg(F.sum("n").alias("w"), F.count("*").alias("c"))
    of = cut(sums.select(F.col("comp").alias("c2"), F.col("led").alias("l2"), F.greatest(F.lit(1), F.ceil(F.col("w") * 2 / most), F.ceil(F.col("c") / F.col("a_block"))).alias("parts")), "block-sizes")
    placed = named.join(of, (named["comp"] == of["c2"]) & named["led"].eqNullSafe(of["l2"]))
    placed = cut(placed.select("comp", "doc_id", "label", "led", F.xxhash64(F.lit(11), F.coalesce("led", F.lit(-1)), F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("block")), "placed")
    kinds = cut(placed.groupBy("comp", "block").agg(F.max("led").alias("led")), "blocks")
    x, y = kinds.select("comp", F.col("block").alias("a"), F.col("led").alias("la")), kinds.select("comp", F.col("block").alias("b"), F.col("led").alias("lb"))
    pairs = x.join(y, "comp").where((F.col("a") <= F.col("b")) & (F.col("la").isNull() | F.col("lb").isNull() | (F.col("la") != F.col("lb"))))
    ends = cut(pairs.select("comp", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")), "pairs")
    return placed.join(ends, ["comp", "block"]).select("comp", "a", "b", "label", "doc_id"), links


def _is_large(most: int):
    return (F.col("weight") > most) | (F.col("docs") > GROUP_DOCS)


def classes_and_links(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, group_shingles: int = GROUP_SHINGLES, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, links): rows (doc_id, th, n, key), th a hash of the text; classes (key, rep, n, node), rep the least id; links (src, dst) of reps
    that connect all that are connected."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = cut(texts.withColumn("th", F.xxhash64("text")).mapInPandas(_forgetting(_sets_and_counts(words)), "row boolean, doc_id long, th long, n long, key binary, node long"), "sets")
    sets = both.where(~F.col("row")).drop("row")
    classes = cut(sets.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("node").alias("node")), "classes")
    spark = docs.sparkSession
    levels = _levels(both.where("row"))
    hot_level, level = _hot_level(levels, hot), spark.sparkContext.broadcast(levels)
    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = max(LEAST_BUCKETS, int(total) // (3 * BUCKET_SHINGLES)).bit_length() - 1
    parts = texts.where("doc_id is not null").mapInPandas(_forgetting(_prefix_parts(level, words, similarity, hot_level, bits)), PARTS)
    shared = cut(parts.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_forgetting(_shared(similarity)), SHARED), "shared")
    # The least partner has least_shared(n) shingles, and so at least its spare in common.
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * similarity / 100) / SPARE))
    alive = shared.groupBy("node").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(F.col("c") >= need).select("node")
    alive = cut(alive, "alive")
    posts = shared.join(alive, "node")
    chained = posts.where("not hot").select("h", "n", "node").repartition("h").sortWithinPartitions("h", "n", "node").mapInPandas(_forgetting(_chains(similarity)), "src long, dst long")
    often = posts.where("hot").select("h", F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"), "node")
    least = cut(often.groupBy("h", "salt").agg(F.min("node").alias("m")), "hot")
    lowest = cut(least.groupBy("h").agg(F.min("m").alias("m0")), "hot-least")
    stars = often.join(least, ["h", "salt"]).select(F.col("m").alias("src"), F.col("node").alias("dst")).union(least.join(lowest, "h").select(F.col("m0").alias("src"), F.col("m").alias("dst")))
    groups = cut(connected_components(chained.union(stars), shrink=False), "groups")
    group = cut(classes.select("node", F.col("rep").alias("doc_id"), "n").join(groups.select("node", F.col("component").alias("comp")), "node").select("doc_id", "comp", "n"), "group")
    weights = cut(group.groupBy("comp").agg(F.sum("n").alias("weight"), F.count("*").alias("docs")), "weights")
    work = group.join(weights.where(~_is_large(group_shingles)), "comp").select("comp", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("doc_id").alias("label"), "doc_id")
    more = None
    if weights.where(_is_large(group_shingles)).limit(1).count():
        searched, more = _blocks(group, weights, texts.where("doc_id is not null"), words, similarity, group_shingles)
        work = work.union(searched)
    found = _search_texts(texts, work, words, similarity)
    links = cut(found.union(more) if more is not None else found, "links")
    return sets, classes, links


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, group_shingles: int = GROUP_SHINGLES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text); other columns are of no effect.

    Null and empty texts, and those of white space, have no shingles and link with nothing. Rows with null doc_id link
    with nothing and have a null component. Rows that repeat an id are one vertex with the links of all its texts;
    each comes back with the size of its own set. An empty table gives an empty result.
    """
    sets, classes, links = classes_and_links(docs, words, similarity, group_shingles, hot)
    # A repeated id in several classes ties these together.
    ties = sets.where("n > 0 and doc_id is not null").join(classes.select("key", "rep"), "key").where("doc_id <> rep").select("doc_id", "rep")
    twice = cut(sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.countDistinct("key").alias("k")).where("k > 1").select("doc_id"), "repeated")
    edges = links.union(ties.join(twice, "doc_id").select(F.col("rep").alias("src"), F.col("doc_id").alias("dst")))
    comps = connected_components(edges)
    named = cut(classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component")), "named")
    out = sets.join(named, "key", "left")
    linked = F.when(F.col("n").eqNullSafe(0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose (doc_id, hash of the text) isn't in `gone`, rows (__id, __gone)."""
    marked = _may_match(docs, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")), gone, F.xxhash64("__id", "__gone"))
    some = marked.where("__may").drop("__may")
    kept = some.join(gone, (some["doc_id"] == gone["__id"]) & (F.xxhash64(some["text"]) == gone["__gone"]), "left_anti")
    return marked.where("not __may").drop("__may").unionByName(kept)


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One row of each component of texts: that with its least id. Of rows that repeat an id and a set, one stays.

    Texts decide, not ids: where an id is repeated, each of its texts counts by itself. Rows with null id, and those
    without shingles (null, empty and blank texts), stay as they are. An empty table stays empty.
    """
    sets, classes, links = classes_and_links(docs, words, similarity)
    comps = connected_components(links)
    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    mine = cut(sets.where("n > 0 and doc_id is not null").join(named, "key").select("doc_id", "th", "key", "component"), "by-text")
    twice = cut(mine.where("doc_id = component").groupBy("doc_id", "key").agg(F.count("*").alias("c"), F.min("th").alias("one")).where("c > 1"), "twice")
    other = mine.join(twice.select("doc_id", "key", "one"), ["doc_id", "key"]).where("th <> one").select("doc_id", "th")
    gone = cut(mine.where("doc_id <> component").select("doc_id", "th").union(other).distinct().select(F.col("doc_id").alias("__id"), F.col("th").alias("__gone")), "dropped")
    text = F.xxhash64("text")
    kept = _without(docs, gone)
    if twice.isEmpty():
        return kept.select(*docs.columns)
    again = twice.select(F.col("doc_id").alias("__id"), F.col("one").alias("__gone"))
    same = (kept["doc_id"] == again["__id"]) & (text == again["__gone"])
    single = kept.join(again, same, "left_semi").withColumn("__th", text).dropDuplicates(["doc_id", "__th"])
    return kept.join(again, same, "left_anti").select(*docs.columns).unionByName(single.select(*docs.columns))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
