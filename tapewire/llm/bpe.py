"""Byte-level BPE encoding and decoding with numpy matrices.

Distinct pre-tokens are put into padded matrices by length.  Each round every row merges
its leftmost pair of least rank; ranks come from a hash table over pairs, and the merged
row is compacted by one place.  Rows without a pair left drop out.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.batches import built_once, slices, spans

NONE = np.int32(2**31 - 1)
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)  # longer pre-tokens are merged with a heap
ROWS = 1 << 14
REMEMBERED = 200_000  # distinct pre-tokens kept by a task; a cache, emptied when full
SLICE = 4 << 20


def load_ranks(path: str) -> bytes:
    """The rank file's bytes: a line per token, base64 and rank."""
    with open(path, "rb") as f:
        return f.read()


class Pairs:
    """Open-addressing hash table (left id, right id) -> id of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(len(left) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        while len(key):
            free = self.keys[at] == -1
            first = np.zeros(len(key), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = key[put], merged[put]
            key, merged, at = key[~put], merged[~put], at[~put]
            taken = self.keys[at] != -1
            at = np.where(taken, (at + 1) & (len(self.keys) - 1), at)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a pair with padding (-1) or without a merge has ``NONE``."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = left.ravel()[todo].astype(np.int64) << 32 | right.ravel()[todo]
        at = self._slot(key)
        flat = out.ravel()
        while len(todo):
            found = self.keys[at]
            hit = found == key
            flat[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            todo, key, at = todo[on], key[on], (at[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(left.shape)


class Bpe:
    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        size = max(self.ranks.values()) + 1
        parts = [b""] * size
        for token, i in self.ranks.items():
            parts[i] = token
        self.length = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        get = self.ranks.get
        splits = [(a, b, i) for t, i in self.ranks.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None]
        left, right, merged = (np.array(x, dtype=np.int32) for x in zip(*splits))
        self.pairs = Pairs(left, right, merged)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.empty(0, np.int32)
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)

    def _rounds(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, their final ids padded with -1) as rows finish."""
        own = np.arange(len(rows))
        rank = self.pairs.ranks(rows[:, :-1], rows[:, 1:])
        while len(rows):
            if rank.shape[1] == 0:
                yield own, rows
                return
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            go = best != NONE
            if not go.all():
                yield own[~go], rows[~go]
                own, rows, rank, at, best = own[go], rows[go], rank[go], at[go], best[go]
                if not len(rows):
                    return
            line = np.arange(len(rows))
            rows[line, at] = best
            cols = np.arange(rows.shape[1] - 1)
            rows = np.take_along_axis(rows, cols + (cols > at[:, None]), axis=1)
            if rank.shape[1] == 1:
                yield own, rows
                return
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), axis=1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                k = side[ok]
                rank[ok, k] = self.pairs.ranks(rows[ok, k], rows[ok, k + 1])

    def _long(self, piece: bytes) -> list[int]:
        """The same merges for one long pre-token: a heap of (rank, place) over a linked list."""
        ids = [int(x) for x in self.of_byte[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        arr = np.array(ids, np.int32)
        rank = self.pairs.ranks(arr[:-1], arr[1:])
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        cache: dict[tuple[int, int], int] = {}

        def pair(a: int, b: int) -> int:
            if (a, b) not in cache:
                cache[a, b] = int(self.pairs.ranks(np.array([a], np.int32), np.array([b], np.int32))[0])
            return cache[a, b]

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one side has merged since
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := pair(ids[x], ids[y])) != NONE:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def _learn(self, words: list[str]) -> None:
        """Encode distinct pre-tokens and add them to the pool."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(b) for b in raw])
        whole = np.array([self.ranks.get(b, -1) for b in raw])
        rows, ids, counts = [np.flatnonzero(whole >= 0)], [whole[whole >= 0].astype(np.int32)], [np.ones(int((whole >= 0).sum()), np.int64)]
        left, low = whole < 0, 1
        for width in WIDTHS:
            bucket = np.flatnonzero(left & (size >= low) & (size <= width))
            low = width + 1
            for block in range(0, len(bucket), ROWS):
                part = bucket[block : block + ROWS]
                m = np.full((len(part), width), -1, np.int32)
                flat = np.frombuffer(b"".join(raw[i] for i in part), np.uint8)
                m[np.repeat(np.arange(len(part)), size[part]), spans(size[part])] = self.of_byte[flat]
                for own, done in self._rounds(m):
                    full = done >= 0
                    rows.append(part[own])
                    ids.append(done[full])
                    counts.append(full.sum(axis=1))
        for i in np.flatnonzero(left & (size > WIDTHS[-1])):
            long = self._long(raw[i])
            rows.append(np.array([i]))
            ids.append(np.array(long, np.int32))
            counts.append(np.array([len(long)]))
        order, count = np.concatenate(rows), np.concatenate(counts).astype(np.int64)
        base = len(self.first)
        self.known.update((words[i], base + k) for k, i in enumerate(order.tolist()))
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.pool = np.concatenate([self.pool, *ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin (with the total at the end)."""
        found = [self.pattern.findall(t) if t else [] for t in texts]
        flat = [w for words in found for w in words]
        if len(self.known) > REMEMBERED:
            self._forget()
        new = list(set(flat).difference(self.known))
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        count = self.count[codes]
        ids = self.pool[np.repeat(self.first[codes], count) + spans(count)]
        upto = np.concatenate([[0], np.cumsum(count)])
        return ids, upto[np.cumsum([0, *map(len, found)])]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's bytes begin (with the total at the end)."""
        n = self.length[ids]
        return self.bytes[np.repeat(self.start[ids], n) + spans(n)], np.concatenate([[0], np.cumsum(n)])


def _of(sent, pattern: str) -> Bpe:
    return built_once(Bpe, sent.value, pattern)


def _encoded(batches, bpe: Bpe):
    for batch in slices(batches, "text", SLICE):
        ids, at = bpe.encode(batch.column("text").to_pylist())
        raw = ids.astype("<u4").tobytes()
        blobs = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(blobs, pa.binary())], names=["doc_id", "n_tokens", "ids"]
        )


def _decoded(batches, bpe: Bpe, whole: bool = False):
    for batch in batches if whole else slices(batches, "ids", SLICE):
        blobs = batch.column("ids").to_pylist()
        ids = np.frombuffer(b"".join(b or b"" for b in blobs), "<u4").astype(np.int64)
        data, at = bpe.decode(ids)
        ends = at[np.cumsum([0, *(len(b or b"") // 4 for b in blobs)])].tolist()
        raw = data.tobytes()
        texts = pa.array([None if b is None else raw[i:j] for b, i, j in zip(blobs, ends[:-1], ends[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])


def _slim(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return out, out.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids): ``ids`` are little-endian unsigned 32-bit integers.

    Whole texts, no special tokens; NULL and empty texts have no ids.  The rank file's bytes are broadcast
    (a vocabulary is bounded).  Repeated rows give equal rows, an empty table none.
    """
    slim, kind = _slim(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    return slim.mapInArrow(lambda batches: _encoded(batches, _of(sent, pattern)), f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """The rows (doc_id, n_tokens, ids) with ``decoded``, the bytes of the ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(lambda batches: _decoded(batches, _of(sent, pattern)), f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass: (doc_id, n_tokens, ids, decoded), with ``text`` last if it is kept."""
    slim, kind = _slim(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def task(batches):
        bpe = _of(sent, pattern)
        for batch in slices(batches, "text", SLICE):
            for done in _decoded(_encoded([batch], bpe), bpe, whole=True):
                yield done.append_column("text", batch.column("text")) if keep_text else done

    return slim.mapInArrow(task, f"doc_id {kind}, n_tokens long, ids binary, decoded binary{', text string' * keep_text}")
