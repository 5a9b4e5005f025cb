"""Substring dedup by hashing lines, the sentences inside them and content-defined pieces of those.

A piece begins where the hash of two neighbouring words is the least of those around it, so a passage gives the same
pieces wherever it stands in a line.  Units are normalised and hashed, digests are grouped over all documents, the earliest
ranked occurrence stays, and runs of later ones are cut out with their original offsets.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewire.llm.batches import free_name, null_safe, slices, spans
from tapewire.operators.scale import checkpointed

MIN_WORDS = 20  # a shorter run of repeated units stays: everyday phrases and headings
REACH = 3  # a piece begins where a pair of words hashes below its neighbours up to so many words away
_CUT = re.compile(r"(?<=[.!?])\s+|\n\s*")
_SPACE = np.array([chr(i).isspace() for i in range(0x3001)] + [False])
# scripts without spaces: every letter is a token, and two count as a word
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_WEIGHTS = np.random.default_rng(7).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _tokens(text: str):
    """(code points, where tokens begin, where they end, which are letters of a script without spaces or None)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE[np.minimum(codes, len(_SPACE) - 1)]
    begin = np.append(True, space[:-1])
    letter = None
    if len(codes) and codes.max() >= _UNSPACED[0][0]:
        letter = np.zeros(len(codes), bool)
        for a, b in _UNSPACED:
            letter |= (codes >= a) & (codes <= b)
        begin |= letter
        begin[1:] |= letter[:-1]
    begin = begin[: len(codes)] & ~space
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(~space & np.append((begin | space)[1:], True)[: len(codes)]) + 1
    return codes, starts, ends, letter[starts] if letter is not None and letter.any() else None


def _pieces(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """First tokens of all units, given those of the sentences; a piece has more than ``REACH`` tokens."""
    n = len(starts)
    if n <= 2 * REACH + 1:
        return firsts
    sizes = ends - starts
    place = spans(sizes)  # inside the token
    at = np.repeat(starts, sizes) + place
    h = np.add.reduceat(codes[at] * _WEIGHTS[np.minimum(place, len(_WEIGHTS) - 1)], np.cumsum(sizes) - sizes)
    h = (h ^ (h >> np.uint64(32))) * _WEIGHTS[0]
    pair = h[:-1] * _WEIGHTS[1] + h[1:]  # pair k: tokens k and k + 1
    inner = pair[REACH : n - 1 - REACH]
    least = np.ones(len(inner), bool)
    for d in range(1, REACH + 1):
        least &= (inner < pair[REACH - d : n - 1 - REACH - d]) & (inner < pair[REACH + d : n - 1 - REACH + d])
    cut = np.flatnonzero(least) + REACH + 1
    own = np.searchsorted(firsts, cut, "right")
    inside = (cut - firsts[own - 1] > REACH) & (np.append(firsts, n)[own] - cut > REACH)  # all compared pairs in one sentence
    return np.sort(np.concatenate([firsts, cut[inside]]))


def units(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of every unit: lines, cut behind sentence ends, and those at content-defined words."""
    text = text or ""
    low = text.lower()
    codes, starts, ends, letter = _tokens(low)
    n = len(starts)
    if not n:
        return []
    words = low.split() if letter is None else [low[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    begins, stops = (starts, ends) if len(low) == len(text) else _tokens(text)[1:3]
    firsts = np.unique(np.searchsorted(begins, [0, *(m.end() for m in _CUT.finditer(text))]))
    edges = np.append(_pieces(codes, starts, ends, firsts[firsts < n]), n)
    counts = np.diff(edges) if letter is None else np.diff(edges) - np.add.reduceat(letter.astype(np.int64), edges[:-1]) // 2
    begins, stops, edges = begins[edges[:-1]], stops[edges[1:] - 1], edges.tolist()
    begins[0] = 0
    texts = [" ".join(words[a:b]) for a, b in zip(edges, edges[1:])]
    digests = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in texts]
    return list(zip(begins.tolist(), stops.tolist(), counts.tolist(), digests))


def cuts(text: str | None, repeated: set[int], min_words: int = MIN_WORDS) -> tuple[list[tuple[int, int]], int, int]:
    """[start, end) code points to cut, how many units they hold and how many the text has.

    ``repeated`` are the numbers of units whose digests occur earlier elsewhere; a digest's later occurrences
    inside the text are repeats too.  A run is cut up to where the next unit begins.
    """
    own = units(text)
    digests = {own[k][3] for k in repeated}
    seen: set[bytes] = set()
    flags = []
    for _, _, _, digest in own:
        flags.append(digest in digests or digest in seen)
        seen.add(digest)
    found, removed, k = [], 0, 0
    while k < len(own):
        if not flags[k]:
            k += 1
            continue
        j = k
        while j < len(own) and flags[j]:
            j += 1
        if sum(u[2] for u in own[k:j]) >= min_words:
            found.append((own[k][0], own[j][0] if j < len(own) else len(text)))
            removed += j - k
        k = j
    return found, removed, len(own)


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return ("".join(parts) + text[at:]).rstrip("\n") if spans[-1][1] == len(text) else "".join(parts) + text[at:]


def _row_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


CHUNK_BITS = 1 << 19  # bits of a Bloom filter that one task builds
MAX_CHUNKS = 1024  # 64 MB, the most that is broadcast; beyond two bits a key nothing is filtered
HOT_KEYS, SALTS = 10_000, 32  # the most frequent digests, dealt over so many tasks each


def _probes(key: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk of each key, and its four bits in there."""
    bits = [(key >> np.int64(s)) % CHUNK_BITS for s in (0, 13, 26, 39)]
    return (key >> np.int64(32)) % chunks, np.stack(bits, axis=1)


class _Seen:
    """Which half digests may occur in several texts (never wrongly no), and which occur most."""

    def __init__(self, chunks: list[bytes], hot: list[int]):
        self.bits = np.frombuffer(b"".join(chunks), np.uint8).reshape(len(chunks), -1) if chunks else None
        self.hot = np.array(sorted(hot), np.int64)

    def maybe(self, key: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(key), bool)
        chunk, at = _probes(key, len(self.bits))
        return ((self.bits[chunk[:, None], at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    def salt(self, key: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.where(np.isin(key, self.hot), row % SALTS, 0)


def _seen(counted: DataFrame) -> _Seen:
    """From rows (key, n): one chunk of the filter a group, at most 64 MB in all, and at most HOT_KEYS keys."""
    total = counted.count()
    hot = [r.key for r in counted.orderBy(F.desc("n"), "key").limit(HOT_KEYS).where(F.col("n") > 2 * SALTS).collect()]
    chunks = min(MAX_CHUNKS, total * 12 // CHUNK_BITS + 1)
    if total * 2 > chunks * CHUNK_BITS:
        return _Seen([], hot)

    def build(group: pa.Table) -> pa.Table:
        _, at = _probes(group.column("key").to_numpy(), chunks)
        bits = np.zeros(CHUNK_BITS, np.uint8)
        bits[at.ravel()] = 1
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    built = counted.select(F.pmod(F.shiftright("key", 32), F.lit(chunks)).alias("chunk"), "key").groupBy("chunk").applyInArrow(build, "chunk long, bits binary")
    found = {r.chunk: bytes(r.bits) for r in built.collect()}
    return _Seen([found.get(c, bytes(CHUNK_BITS // 8)) for c in range(chunks)], hot)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, row_hash, units): numbers of the units whose digest an earlier ranked row has.

    Rows rank by id, then by a hash of the text.  The texts are cut twice: first only half digests are counted,
    combined by task, so that nothing else of the many that occur once is ever shuffled or stored; then the digests that a Bloom
    filter of the repeated halves lets through are ranked whole, which is exact whatever the filter lets through.  The most
    frequent digests, such as a line that a third of the documents share, are dealt over several tasks each.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), _row_hash(text_col).alias("row_hash"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def halves(batch) -> tuple[list[int], list[int], np.ndarray]:
        """Digests of a batch, each once a text: how many a text has, their units' numbers, both halves."""
        sizes, number, digest = [], [], []
        for text in batch.column("text").to_pylist():
            first: dict[bytes, int] = {}
            for k, unit in enumerate(units(text)):
                first.setdefault(unit[3], k)
            number += first.values()
            digest += first.keys()
            sizes.append(len(first))
        return sizes, number, np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)

    def count(batches):
        for batch in slices(batches, "text"):
            key, n = np.unique(halves(batch)[2][:, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    counted = slim.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    seen = spark.sparkContext.broadcast(_seen(checkpointed(counted)))

    def again(batches):
        for batch in slices(batches, "text"):
            sizes, number, half = halves(batch)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            keep = np.flatnonzero(seen.value.maybe(half[:, 0]))
            row, half = row[keep], half[keep]
            salt = seen.value.salt(half[:, 0], batch.column("row_hash").to_numpy()[row])
            own = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "row_hash")]
            values = [pa.array(np.array(number, np.int32)[keep]), pa.array(half[:, 0].copy()), pa.array(half[:, 1].copy()), pa.array(salt.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*own, *values], names=["doc_id", "row_hash", "unit", "key", "rest", "salt"])

    some = checkpointed(slim.mapInArrow(again, f"doc_id {kind}, row_hash long, unit int, key long, rest long, salt int"))
    rank = F.struct("doc_id", "row_hash")
    first = some.groupBy("key", "rest").agg(F.min(rank).alias("first"), F.max("salt").alias("hot"))
    # only a hot digest has a salt above 0; the others go to one group
    dealt = first.select("key", "rest", "first", F.explode(F.when(F.col("hot") > 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    later = some.join(dealt, ["key", "rest", "salt"]).where(rank != F.col("first"))
    return later.groupBy("doc_id", "row_hash").agg(F.collect_list("unit").alias("units"))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, report: str = "__cut") -> DataFrame:
    """``docs`` with repeats cut out of ``text_col`` and a struct column ``report``: ``n_units``, ``n_removed`` and
    ``spans``, the [start, end) code points of the original text that were cut.

    A repeat is a run of units, at least ``min_words`` words long, each of which occurs earlier: in a row of a smaller id
    (NULL is the smallest; ties by a hash of the text) or before in the same text.  The first occurrence is
    never cut.  Rows equal in id and text are cut alike.  NULL and empty texts stay as they are; a text of
    nothing but repeats becomes empty.  All other columns pass unchanged, whatever their names; ``report`` must not be one of them.
    """
    if free_name(docs.columns, report) != report:
        raise ValueError(f"the table has a column {report}: give another name for the report")
    row, numbers = free_name(docs.columns, "__row_hash"), free_name(docs.columns, "__units")
    found = repeated_units(docs, id_col, text_col)
    keyed = docs.withColumn(row, _row_hash(text_col))
    hits = found.select(F.col("doc_id").alias(id_col), F.col("row_hash").alias(row), F.col("units").alias(numbers))
    joined = null_safe(keyed, hits, [id_col, row], "left").drop(row)
    kind = T.StructType(
        [T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))]
    )
    arrow = pa.struct([("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64())))])
    schema = T.StructType([*docs.schema.fields, T.StructField(report, kind)])

    def task(batches):
        for batch in slices(batches, text_col):
            texts, rows = [], []
            for text, repeated in zip(batch.column(text_col).to_pylist(), batch.column(numbers).to_pylist()):
                spans, removed, n = cuts(text, set(repeated or ()), min_words)
                texts.append(without(text, spans))
                rows.append({"n_units": n, "n_removed": removed, "spans": spans})
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in docs_columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, arrow)], names=[*docs_columns, report])

    docs_columns = docs.columns
    return joined.select(*docs_columns, numbers).mapInArrow(task, schema)
