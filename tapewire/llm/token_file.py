"""Token ids in compressed binary files: an adaptive context-mixing range coder.

A file is a row of blocks.  A block holds whole documents, starts from a fresh model and carries
checksums, so any block can be decoded alone.  Its ids are cut into lanes that step together: in every step the
order-2 and order-1 contexts predict an id, their mixed weights follow how often such predictions came true, and what
neither predicts is coded with adaptive order-0 counts.  Model updates and arithmetic coding run over all lanes at once.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewire.llm.batches import built_once, slices, spans, splits, word_codes
from tapewire.operators.scale import checkpointed
from tapewire.session import shared_dir

MAGIC = b"TWCM0001"
HEAD = struct.Struct("<8sIIQIIIII")  # magic, vocabulary, documents, ids, lanes, steps, bytes of the tables, bytes of the code, crc32 of the ids
STEPS = 256  # ids in a lane
BLOCK_IDS = 1 << 21
CONTEXT_BITS = 18
GAIN = 24  # what one occurrence adds to an order-0 count
LEVELS = 16  # confidence levels of a prediction

# sureness after a prediction, at twice the sureness before plus one if it came true
_NEXT_SURE = np.array([[c >> 1 if c > 1 else 1, min(c + 1, LEVELS - 1)] for c in range(LEVELS)], dtype=np.int8).ravel()

_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 47)
_W16, _W48 = np.uint64(16), np.uint64(48)


class Model:
    """Predictions and counts shared by a block's lanes; the coder and the decoder make the same calls."""

    def __init__(self, vocabulary: int, lanes: int) -> None:
        self.counts = np.ones(vocabulary, dtype=np.int64)
        self.upto = np.zeros(vocabulary + 1, dtype=np.int64)
        self.next1 = np.zeros(vocabulary, dtype=np.int32)
        self.sure1 = np.zeros(vocabulary, dtype=np.int8)
        self.next2 = np.zeros(1 << CONTEXT_BITS, dtype=np.int32)
        self.sure2 = np.zeros(1 << CONTEXT_BITS, dtype=np.int8)
        self.right = np.ones((2, LEVELS), dtype=np.int64)
        self.tried = np.full((2, LEVELS), 4, dtype=np.int64)
        self.last = np.zeros(lanes, dtype=np.int64)
        self.hash = np.zeros(lanes, dtype=np.int64)

    def predict(self) -> None:
        """Set the two predicted ids and their shares of 65,536; the rest belongs to order 0."""
        np.cumsum(self.counts, out=self.upto[1:])
        self.c2, self.c1 = self.sure2[self.hash], self.sure1[self.last]
        self.p2, self.p1 = self.next2[self.hash], self.next1[self.last]
        weight = np.minimum((self.right << 16) // self.tried, 60_000)
        weight[:, 0] = 0
        a2 = weight[0].take(self.c2)
        a1 = ((65_536 - a2) * weight[1].take(self.c1)) >> 16
        a1 *= (self.p1 != self.p2) | (a2 == 0)
        self.a2, self.a1 = a2, a1

    def update(self, ids: np.ndarray) -> None:
        np.add.at(self.counts, ids, GAIN)
        for row, at, follows, sure, c, p in ((0, self.hash, self.next2, self.sure2, self.c2, self.p2), (1, self.last, self.next1, self.sure1, self.c1, self.p1)):
            hit = p == ids
            outcome = 2 * c.astype(np.intp) + hit
            seen = np.bincount(outcome, minlength=2 * LEVELS).reshape(LEVELS, 2)
            self.tried[row] += seen.sum(axis=1)
            self.right[row] += seen[:, 1]
            follows[at] = np.where(hit | (c > 1), p, ids)
            sure[at] = _NEXT_SURE.take(outcome)
        self.hash = ((self.last * 0x9E3779B1 + ids * 0x85EBCA6B) >> 7) & ((1 << CONTEXT_BITS) - 1)
        self.last = ids


def _settle(low: np.ndarray, size: np.ndarray):
    """Lanes whose top 16 bits are settled, again and again, with their ranges cut where they straddle a border too closely."""
    fixed = (low ^ (low + size)) < _TOP
    lanes = np.flatnonzero(fixed | (size < _BOTTOM))
    a, b, fixed = low[lanes], size[lanes], fixed[lanes]
    while len(lanes):
        b = np.where(fixed, b, (np.uint64(0) - a) & (_BOTTOM - np.uint64(1)))
        yield lanes, a
        a, b = a << _W16, b << _W16
        low[lanes], size[lanes] = a, b
        fixed = (a ^ (a + b)) < _TOP
        go = fixed | (b < _BOTTOM)
        lanes, a, b, fixed = lanes[go], a[go], b[go], fixed[go]


def compress(ids: np.ndarray, vocabulary: int, steps: int = STEPS) -> tuple[bytes, int, int]:
    """(code, lanes, steps) of the ids."""
    n = len(ids)
    if not n:
        return b"", 0, 0
    lanes = -(-n // steps)
    steps = -(-n // lanes)
    lanes = -(-n // steps)
    grid = np.zeros(lanes * steps, dtype=np.int64)
    grid[:n] = ids
    grid = grid.reshape(lanes, steps)
    model = Model(vocabulary, lanes)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    out = np.empty((lanes, 4 * steps + 8), dtype="<u2")
    used = np.zeros(lanes, dtype=np.int64)

    for step in range(steps):
        x = np.ascontiguousarray(grid[:, step])
        model.predict()
        a2, a1 = model.a2, model.a1
        hit2 = (model.p2 == x) & (a2 > 0)
        hit1 = (model.p1 == x) & (a1 > 0) & ~hit2
        begin = np.where(hit2, 0, np.where(hit1, a2, a2 + a1))
        share = np.where(hit2, a2, np.where(hit1, a1, 65_536 - a2 - a1))
        unit = size >> _W16
        low += unit * begin.astype(np.uint64)
        size = unit * share.astype(np.uint64)
        rest = np.flatnonzero(~(hit2 | hit1))
        y = x[rest]
        unit = size[rest] // np.uint64(model.upto[-1])
        low[rest] += unit * model.upto[y].astype(np.uint64)
        size[rest] = unit * model.counts[y].astype(np.uint64)
        for at, value in _settle(low, size):
            out[at, used[at]] = (value >> _W48).astype(np.uint16)
            used[at] += 1
        model.update(x)
    every = np.arange(lanes)
    for _ in range(4):
        out[every, used] = (low >> _W48).astype(np.uint16)
        low <<= _W16
        used += 1
    words = out[np.repeat(every, used), spans(used)]
    return used.astype("<u4").tobytes() + words.tobytes(), lanes, steps


def expand(code: bytes, n: int, lanes: int, steps: int, vocabulary: int) -> np.ndarray:
    """The ids of :func:`compress`."""
    if not n:
        return np.empty(0, np.int64)
    used = np.frombuffer(code, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(code, "<u2", offset=4 * lanes), np.zeros(8, "<u2")]).astype(np.uint64)
    at = np.cumsum(used) - used
    value = np.zeros(lanes, np.uint64)
    for _ in range(4):
        value = value << _W16 | words[at]
        at += 1
    model = Model(vocabulary, lanes)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    grid = np.empty((steps, lanes), dtype=np.int64)
    for step in range(steps):
        model.predict()
        a2, a1 = model.a2, model.a1
        unit = size >> _W16
        place = np.minimum((value - low) // unit, np.uint64(65_535)).astype(np.int64)
        hit2 = place < a2
        hit1 = ~hit2 & (place < a2 + a1)
        x = np.where(hit2, model.p2, model.p1).astype(np.int64)
        begin = np.where(hit2, 0, np.where(hit1, a2, a2 + a1))
        share = np.where(hit2, a2, np.where(hit1, a1, 65_536 - a2 - a1))
        low += unit * begin.astype(np.uint64)
        size = unit * share.astype(np.uint64)
        rest = np.flatnonzero(~(hit2 | hit1))
        unit = size[rest] // np.uint64(model.upto[-1])
        place = np.minimum((value[rest] - low[rest]) // unit, np.uint64(model.upto[-1] - 1)).astype(np.int64)
        y = np.searchsorted(model.upto, place, "right") - 1
        x[rest] = y
        low[rest] += unit * model.upto[y].astype(np.uint64)
        size[rest] = unit * model.counts[y].astype(np.uint64)
        for moved, _ in _settle(low, size):
            value[moved] = value[moved] << _W16 | words[at[moved]]
            at[moved] += 1
        model.update(x)
        grid[step] = x
    return grid.T.reshape(-1)[:n]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_block(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    known = np.array([d is not None for d in doc_ids])
    numbers = np.array([d or 0 for d in doc_ids], dtype="<i8")
    tables = zlib.compress(np.packbits(known).tobytes() + np.diff(numbers, prepend=np.int64(0)).tobytes() + lengths.astype("<u8").tobytes(), 1)
    code, lanes, steps = compress(ids, vocabulary)
    head = HEAD.pack(MAGIC, vocabulary, len(doc_ids), len(ids), lanes, steps, len(tables), len(code), _crc(ids))
    return head + struct.pack("<I", zlib.crc32(head + tables + code)) + tables + code


def read_blocks(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, lengths, ids) of every block; a block that fails a checksum raises."""
    at = 0
    while at < len(content):
        head = content[at : at + HEAD.size]
        magic, vocabulary, docs, n, lanes, steps, tables_size, code_size, crc = HEAD.unpack(head)
        (check,) = struct.unpack_from("<I", content, at + HEAD.size)
        begin = at + HEAD.size + 4
        tables, code = content[begin : begin + tables_size], content[begin + tables_size : begin + tables_size + code_size]
        if magic != MAGIC or zlib.crc32(head + tables + code) != check:
            raise ValueError(f"the block at {at} is damaged")
        raw = zlib.decompress(tables)
        bits = -(-docs // 8)
        known = np.unpackbits(np.frombuffer(raw, np.uint8, bits))[:docs].astype(bool)
        numbers = np.cumsum(np.frombuffer(raw, "<i8", docs, bits))
        lengths = np.frombuffer(raw, "<u8", docs, bits + 8 * docs).astype(np.int64)
        ids = expand(code, n, lanes, steps, vocabulary)
        if _crc(ids) != crc:
            raise ValueError(f"the ids of the block at {at} do not match their checksum")
        yield [int(d) if k else None for d, k in zip(numbers, known)], lengths, ids
        at = begin + tables_size + code_size + 1  # every block ends with a line end


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees every distinct piece between ASCII white space once.

    The tokenizer cuts at white space and between a letter and a full stop or comma, and marks word ends in its tokens.  So
    pieces are independent, and new words go to the library many at a time with a space between.
    """

    REMEMBERED = 1_000_000
    REMEMBERED_BYTES = 256 << 20
    TOGETHER = 20_000

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer)
        # lower-case ASCII words are past every normaliser and are one pre-token each: white space alone parts them
        self.plain = Tokenizer.from_str(tokenizer)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Drop the pieces that no second slice has used, or all if those are many."""
        keep = np.flatnonzero(self.uses > 1) if hasattr(self, "uses") else np.empty(0, np.int64)
        if not 0 < len(keep) <= self.REMEMBERED // 2:
            self.known: pa.Array | None = None
            self.pool, self.first, self.count, self.uses = np.empty(0, np.int32), *(np.empty(0, np.int64) for _ in range(3))
            return
        self.known, count = self.known.take(pa.array(keep)), self.count[keep]
        self.pool = self.pool[np.repeat(self.first[keep], count) + spans(count)]
        self.first, self.count, self.uses = np.cumsum(count) - count, count, np.zeros(len(keep), np.int64)

    def _add(self, pieces: pa.Array, ids: np.ndarray, count: np.ndarray) -> None:
        self.known = pieces if self.known is None else pa.concat_arrays([self.known, pieces])
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.uses = np.concatenate([self.uses, np.zeros(len(count), np.int64)])
        self.pool = np.concatenate([self.pool, ids])

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.array([len(f) for f in found], dtype=np.int64)
        return np.fromiter((i for f in found for i in f), np.int32, int(count.sum())), count

    def _words(self, words: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.int32)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else self._one_by_one(words)

    def _learn(self, pieces: pa.Array) -> pa.Array:
        """Encode distinct pieces; they are returned in the order in which they were added."""
        plain = pc.match_substring_regex(pieces, "^[a-z]+$")
        rest = pieces.filter(pc.invert(plain)).to_pylist()
        groups = (
            (pieces.filter(plain).to_pylist(), lambda some: self._words(some, self.plain)),
            ([x for x in rest if x.isalpha()], lambda some: self._words(some, self.tokenizer)),
            ([x for x in rest if not x.isalpha()], self._one_by_one),
        )
        order = []
        for some, encode in groups:
            for at in range(0, len(some), self.TOGETHER):
                part = some[at : at + self.TOGETHER]
                order.append(pa.array(part, pieces.type))
                self._add(order[-1], *encode(part))
        return pa.concat_arrays(order) if order else pieces

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the distinct pieces stand among the known ones; new ones are learned."""
        n = len(pieces)
        stems = pc.utf8_rtrim(pieces, characters=".,")
        size, full = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (stems, pieces))
        last = pc.utf8_slice_codeunits(stems, -1).dictionary_encode()
        letter = np.array([c.lower().isalpha() for c in last.dictionary.to_pylist()], dtype=bool)
        cut = (size > 0) & (size < full)
        cut[cut] = letter[last.indices.to_numpy(zero_copy_only=False)[cut]]
        # a piece with full stops or commas behind a letter is its stem and that tail
        stem, tail = stems.filter(pa.array(cut)), _tails(pieces.filter(pa.array(cut)), (full - size)[cut])
        both = pa.concat_arrays([pieces, stem, tail])
        place = np.full(len(both), -1, np.int64) if self.known is None else _index(both, self.known)
        new, parts = place[:n] < 0, np.concatenate([np.flatnonzero(cut)] * 2)
        # what is to be learned: new pieces that are not cut, and the unknown parts of new pieces that are
        wanted = np.concatenate([new & ~cut, new[parts] & (place[n:] < 0)])
        if wanted.any():
            base, unknown = len(self.first), both.filter(pa.array(wanted))
            place[wanted] = base + _index(unknown, self._learn(pc.unique(unknown)))
        ended = np.flatnonzero(new & cut)
        if len(ended):
            of = place[n:].reshape(2, -1)[:, new[cut]].T.ravel()
            count = self.count[of]
            place[ended] = len(self.first) + np.arange(len(ended))
            self._add(pieces.take(pa.array(ended)), self.pool[np.repeat(self.first[of], count) + spans(count)], count.reshape(-1, 2).sum(axis=1))
        return place[:n]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and the number of ids of each text."""
        # special tokens are found in the text as it stands; without one, letters may be lowered first
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        codes, pieces, at = word_codes(texts, lower=not special)
        if len(self.first) > self.REMEMBERED or (self.known is not None and self.known.nbytes > self.REMEMBERED_BYTES):
            self._forget()
        place = self._places(pieces)
        self.uses[place] += 1
        place = place[codes]
        count = self.count[place]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.first[place] - ends[:-1], count)]
        upto = ends[at]
        return np.insert(ids, upto[1:], end), np.diff(upto) + 1


def _index(values: pa.Array, among: pa.Array) -> np.ndarray:
    """Places of the values in a distinct list, -1 for those that are not there."""
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _tails(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The last ``sizes`` bytes of each value."""
    ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64))
    data = np.frombuffer(b"".join(pc.cast(values, pa.large_binary()).to_pylist()), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    cut = data[np.repeat(ends - sizes, sizes) + spans(sizes)]
    return pa.LargeStringArray.from_buffers(len(values), pa.py_buffer(offsets.tobytes()), pa.py_buffer(cut.tobytes())).cast(values.type)


def write(docs: DataFrame, tokenizer: str, vocabulary: int, end: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write their ids to ``folder`` in ascending order of the integer id.

    ``tokenizer`` is the JSON of a tokenizer of the tokenizers library whose first step cuts at white space;
    ``end`` follows every document.  The table is range-partitioned by id, a file a partition, as many as its
    input has splits; a task holds one block.  NULL texts are empty, a NULL id comes first, rows with
    equal ids follow each other in order of their texts.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tokenizer)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = slim.repartitionByRange(splits(slim), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def task(batches: Iterable[pa.RecordBatch]):
        encoder = built_once(Encoder, sent.value)
        doc_ids, lengths, ids, size = [], [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([write_block(doc_ids, np.concatenate(lengths), np.concatenate(ids), vocabulary)], pa.binary())], names=["block"])

        for batch in slices(batches, "text", 4 << 20):
            found, n = encoder.encode(batch.column("text"), end)
            doc_ids += batch.column("doc_id").to_pylist()
            lengths.append(n)
            ids.append(found.astype(np.int32))
            size += len(found)
            if size >= BLOCK_IDS:
                yield block()
                doc_ids, lengths, ids, size = [], [], [], 0
        if doc_ids:
            yield block()

    blocks = ordered.mapInArrow(task, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.option("lineSep", "\n").mode("overwrite").text(folder)


def read(spark, folder: str) -> DataFrame:
    """Rows (file, place, doc_id, first, n_tokens, ids) from the files of ``folder``; ``first`` counts the file's ids before the document, ``ids`` are little-endian unsigned 32-bit integers."""
    files = spark.read.format("binaryFile").load(folder)
    files = files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")

    def task(batches):
        for batch in batches:
            for number, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                before = place = 0
                for doc_ids, lengths, ids in read_blocks(content.as_py()):
                    ends = np.cumsum(lengths)
                    raw = ids.astype("<u4").tobytes()
                    blobs = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lengths.tolist())]
                    n = len(doc_ids)
                    for a in range(0, n, 1000):
                        b = min(n, a + 1000)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([number] * (b - a), pa.int32()),
                                pa.array(range(place + a, place + b), pa.int64()),
                                pa.array(doc_ids[a:b], pa.int64()),
                                pa.array((before + ends - lengths)[a:b]),
                                pa.array(lengths[a:b]),
                                pa.array(blobs[a:b], pa.binary()),
                            ],
                            names=["file", "place", "doc_id", "first", "n_tokens", "ids"],
                        )
                    place, before = place + n, before + len(ids)

    return files.mapInArrow(task, "file int, place long, doc_id long, first long, n_tokens long, ids binary")


def write_and_read(docs: DataFrame, tokenizer: str, vocabulary: int, end: int, **columns: str) -> DataFrame:
    """Write new files in the shared folder, read them back: (doc_id, start, n_tokens, ids_crc32), ``start`` over all files."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(docs, tokenizer, vocabulary, end, folder, **columns)
    rows = checkpointed(read(spark, folder).select("file", "doc_id", "first", "n_tokens", F.crc32("ids").alias("ids_crc32")))  # narrow
    # a row per file: bounded by the number of splits
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("file", before.alias("before")), "file").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )
