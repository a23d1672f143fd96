"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

A piece of text (a match of the split pattern) starts as single-byte tokens. Leaf i of a segment tree holds the rank of
the pair that token i makes with its next live neighbour, inner nodes the leftmost minimum; so the root names the next
merge. A merge replaces a token, unlinks its neighbour and updates the leaves of the two pairs it changes and of the
one that goes: O(log n) each. Short pieces of equal tree size are merged together, one merge each per step, in numpy;
long ones go one by one. Pieces met before are looked up.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import release, small_batches, table

#: Rank of a pair that is no token.
NONE = np.int64(1 << 40)
#: Pieces up to this many bytes are merged in groups.
GROUP_BYTES = 64
#: Pieces, and chunks between spaces, that a process remembers; when there are more, it starts anew.
REMEMBER = 150_000
#: White space beside a space, or a space at either end.
WHITE = regex.compile(r" \s|\s |^ | $").search
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def falls_at_spaces(pattern: str) -> bool:
    """Whether texts may be cut before single spaces and split part by part: known of the shipped pattern alone."""
    import public_tokenizers

    return pattern == public_tokenizers.PATTERN


class Bpe:
    """Encodes and decodes by a rank table. A text with a byte that is no token is refused with a ValueError."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.by_spaces = falls_at_spaces(pattern)
        self.ranks, self.words = ranks, {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.missing = frozenset(b for b in range(256) if bytes([b]) not in ranks)
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pair = pairs
        # An open-addressed table of pairs, for looking up many at once.
        self.bits = max(4, int(np.ceil(np.log2(4 * max(len(pairs), 1)))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & ((1 << self.bits) - 1)
        #: Ids by chunk and by piece, as the bytes of int32.
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.shown = {i: str(i) for i in self.words}

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where one is no token or a side is -1."""
        key = (left << 32) | right
        out, todo = np.full(len(key), NONE, np.int64), np.flatnonzero((left >= 0) & (right >= 0))
        at = self._home(key[todo])
        while len(todo):
            found = self.keys[at]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_group(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of at most GROUP_BYTES bytes: a row of a segment tree each, a merge of each row per step."""
        n = len(pieces)
        size = max(2, 1 << (max(map(len, pieces)) - 1).bit_length())
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        rows = np.arange(n)
        token = np.full((n, size + 1), -1, np.int64)
        inside = np.arange(size) < lengths[:, None]
        token[:, :size][inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, size + 2), (n, 1))  # next live position; beyond the end it stands still
        after[:, :size] = np.minimum(after[:, :size], lengths[:, None])
        before = np.tile(np.arange(-1, size), (n, 1))
        # tree[:, 1] is the root; leaf i is tree[:, size + i]. rank * 64 + position: its minimum is the leftmost.
        shift = int(size).bit_length()
        none = NONE << shift
        tree = np.full((n, 2 * size), none, np.int64)
        pos = np.broadcast_to(np.arange(size), (n, size))
        left, right = token[:, :size].ravel(), np.where(pos + 1 < lengths[:, None], token[:, 1 : size + 1], -1).ravel()
        tree[:, size:] = ((self._rank(left, right) << shift) | pos.ravel()).reshape(n, size)
        at = size
        while at > 1:
            tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
            at //= 2

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            node = i + size
            tree[r, node] = value
            node = node >> 1
            while node[0]:
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                node = node >> 1

        live = rows[tree[:, 1] < none]
        while len(live):
            root = tree[live, 1]
            i, rank = root & ((1 << shift) - 1), root >> shift
            gone = after[live, i]
            nxt = after[live, gone]
            token[live, i] = rank
            after[live, i] = nxt
            before[live, np.minimum(nxt, size)] = i
            end = lengths[live]
            put(live, gone, np.full(len(live), none, np.int64))
            put(live, i, (self._rank(rank, np.where(nxt < end, token[live, np.minimum(nxt, size)], -1)) << shift) | i)
            prev = before[live, i]
            has = prev >= 0
            if has.any():
                r, p = live[has], prev[has]
                put(r, p, (self._rank(token[r, p], rank[has]) << shift) | p)
            token[live, gone] = -1
            live = live[tree[live, 1] < none]
        flat = token[:, :size]
        kept = flat >= 0
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        ids = flat[kept].astype(np.int32).tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_one(self, piece: bytes) -> list[int]:
        """One piece of any length; the same tree in Python lists."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        pair, none = self.pair.get, int(NONE)
        token = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # A node holds rank << 40 | position, as its minimum is then the leftmost.
        tree = [none << 40] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = (pair(token[i] << 32 | token[i + 1], none) << 40) | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    return
                tree[i] = low
                i >>= 1

        mask = (1 << 40) - 1
        while (root := tree[1]) >> 40 < none:
            i, rank = root & mask, root >> 40
            gone = after[i]
            nxt = after[gone]
            token[i] = rank
            after[i] = nxt
            put(gone, none << 40)
            if nxt < n:
                before[nxt] = i
                put(i, (pair(rank << 32 | token[nxt], none) << 40) | i)
            else:
                put(i, none << 40)
            if (p := before[i]) >= 0:
                put(p, (pair(token[p] << 32 | rank, none) << 40) | p)
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Works out the ids of pieces that aren't known yet."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if self.missing and not self.missing.isdisjoint(raw):
                raise ValueError(f"bytes {sorted(self.missing.intersection(raw))} are no tokens of the vocabulary")
            if (whole := self.ranks.get(raw)) is not None:
                self.pieces[p] = np.int32(whole).tobytes()
            elif len(raw) > GROUP_BYTES:
                self.pieces[p] = np.array(self.merge_one(raw), np.int32).tobytes()
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for group in groups.values():
            for a in range(0, len(group), 8192):
                some = group[a : a + 8192]
                self.pieces.update(zip((p for p, _ in some), self.merge_group([raw for _, raw in some]), strict=True))

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text.

        No match of the shipped pattern goes on from a non-space to a space, so a text falls at its spaces into chunks
        whose matches don't depend on their neighbours, unless white space meets white space there; such texts, and
        all texts with another pattern, are split as a whole.
        """
        if len(self.chunks) > REMEMBER or len(self.pieces) > REMEMBER:
            self.chunks, self.pieces = {}, {}
        parts = [t.split(" ") if self.by_spaces else [t] for t in texts]
        new = {w: self.split(" " + w) for w in set().union(*(p[1:] for p in parts)).difference(self.chunks)}
        alone: dict[int, list[str]] = {}
        for k, (text, part) in enumerate(zip(texts, parts, strict=True)):
            if self.by_spaces and " " in text and ("" in part or WHITE(text)):
                alone[k] = self.split(text)
            else:
                alone[-k - 1] = self.split(part[0])
        self.learn(set().union(*new.values(), *alone.values()).difference(self.pieces))
        piece = self.pieces.__getitem__
        self.chunks.update((w, b"".join(map(piece, found))) for w, found in new.items())
        chunk = self.chunks.__getitem__
        for k, part in enumerate(parts):
            if k in alone:
                raw = b"".join(map(piece, alone[k]))
            else:
                raw = b"".join([*map(piece, alone[-k - 1]), *map(chunk, part[1:])])
            yield np.frombuffer(raw, np.int32)

    def forget(self) -> None:
        """Frees what is remembered of texts."""
        self.chunks, self.pieces = {}, {}

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


def _batches(texts: pd.Series, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about `limit` characters."""
    begin, held = 0, 0
    for k, n in enumerate(texts.str.len()):
        held += n
        if held >= limit:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


_READY: dict[tuple[str, str], Bpe] = {}


def coder(path: str, pattern: str) -> Bpe:
    """One coder for each process."""
    if (path, pattern) not in _READY:
        _READY[path, pattern] = Bpe(load_ranks(path), pattern)
    return _READY[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds `out`, array<int>: the ids of each text. Null is encoded as the empty text, to no ids. Other columns stay;
    one that is named as `out` already is replaced."""
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        bpe = coder(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pandas().fillna("")
            for a, b in _batches(texts):
                found = list(bpe.encode_batch(texts.iloc[a:b].tolist()))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found])))
                part = batch.slice(a, b - a)
                columns = [part.column(part.schema.get_field_index(f.name)) for f in keep]
                yield pa.RecordBatch.from_arrays([*columns, ids], names=[*(f.name for f in keep), out])
        _READY.clear()  # its tables are made anew in a sixth of a second, and the process lives on
        del bpe
        release()

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out`, binary: the bytes that ids stand for; null ids are no bytes. A column named as `out` is replaced."""
    from pyspark.sql import types as T

    keep = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.BinaryType())])

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        bpe = coder(path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            raw = pa.array([bpe.decode(x.tolist() if x is not None else ()) for x in column.to_pandas()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), raw], names=[*(f.name for f in keep), out])

    return docs.mapInArrow(run, schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of (doc_id, text): each text is encoded, its ids
    decoded again, and only the digests leave the task."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(path, pattern)
        for pdf in batches:
            texts = pdf["text"].fillna("")
            rows = []
            for a, b in _batches(texts):
                for ids in map(np.ndarray.tolist, bpe.encode_batch(texts.iloc[a:b].tolist())):
                    rows.append((len(ids), hashlib.sha256(",".join(map(bpe.shown.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            done = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            done.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield done
        bpe.forget()
        release()

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, DIGESTS)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(table(spark, sf_dir, "documents"), P.path(VOCABULARY), P.PATTERN)


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
