"""Document fingerprints: SimHash over weighted word pairs, and a search by permuted block tables.

Every term of a text votes with its weight on each bit of the fingerprint: for a set bit of the term's
hash, against an unset one.  Fingerprints within a Hamming radius agree in at least one block
when there are more blocks than the radius; a table per block brings those together.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tapewire.llm.batches import as_binary, slices, spans, splits, word_codes
from tapewire.operators.scale import attach, checkpointed

BITS = 256
RADIUS = 7
BLOCKS = 8  # tables; a block of 32 bits each, one more than the radius
CHUNK = 2_048  # fingerprints of a bucket that one task compares with as many others
PIECE, LONG = 8, 32  # a word of over 32 bytes is taken in pieces of 8, for scripts without spaces
TOKENS = 1 << 16  # terms whose bits are unpacked at a time
BLOCK_BYTES = 64 << 20  # of text in a block of consecutive documents
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SEEDS = GOLDEN * np.arange(1, BITS // 64 + 1, dtype=np.uint64)  # modulo 2^64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and where each text's begin and end."""
    codes, words, bounds = word_codes(texts)
    raw = as_binary(words)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in raw], np.uint64)
    long = np.array([len(w) > LONG for w in raw], bool)
    if not long.any():
        return hashes[codes], bounds
    pieces = [[xxhash.xxh64_intdigest(w[i : i + PIECE]) for i in range(0, len(w), PIECE)] if far else [int(h)] for w, far, h in zip(raw, long, hashes)]
    size = np.array([len(p) for p in pieces], np.int64)
    flat = np.array([h for p in pieces for h in p], np.uint64)
    start = np.cumsum(size) - size
    taken = size[codes]
    before = np.concatenate([[0], np.cumsum(taken)])
    return flat[np.repeat(start[codes], taken) + spans(taken)], before[bounds]


def signatures(texts: pa.Array) -> np.ndarray:
    """One row of 32 bytes a text.

    Terms are pairs of neighbouring words, A-Z lowered, the first word paired with the text's beginning; a
    term weighs as much as it occurs.  A bit is set if the votes for it outweigh those against it.  A text without words has no bit set.
    """
    words, bounds = _word_hashes(texts)
    n = len(texts)
    votes = np.zeros((n, BITS), np.int32)
    counts = np.diff(bounds)
    if not len(words):
        return np.zeros((n, BITS // 8), np.uint8)
    left = np.concatenate([[np.uint64(0)], words[:-1]])
    left[bounds[:-1][counts > 0]] = 0
    terms = _mix(_mix(left + GOLDEN) + words)
    owner = np.repeat(np.arange(n), counts)
    for at in range(0, len(terms), TOKENS):
        part, own = terms[at : at + TOKENS], owner[at : at + TOKENS]
        lanes = np.stack([_mix(part + seed) for seed in SEEDS], axis=1)
        bits = np.unpackbits(lanes.view(np.uint8)).view(np.uint64).reshape(len(part), -1)  # eight votes a word
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        length = np.diff(np.concatenate([begin, [len(part)]]))
        cuts = np.repeat(begin, -(-length // 255)) + 255 * spans(-(-length // 255))  # sums of at most 255 terms of one text fit a byte
        for first, last, text in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], own[cuts].tolist()):
            votes[text] += bits[first:last].sum(axis=0).view(np.uint8)
    return np.packbits(2 * votes > counts[:, None], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, row by row."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _hex(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().hex() for r in rows], pa.string())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint), one a row of ``docs``: 64 hexadecimal digits.

    Equal texts have equal fingerprints, NULL and empty ones that without a bit.  Whole texts of any length count.  An
    empty table gives no rows.  Columns other than the two are not looked at.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def task(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _hex(signatures(batch.column("text")))], names=["doc_id", "fingerprint"])

    return slim.mapInArrow(task, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _key(doc_id, digest: int) -> tuple:
    """Ascending order of documents: by id, NULL least, then by the text's hash."""
    return (doc_id is not None, doc_id if doc_id is not None else 0, digest)


def _dealt(slim: DataFrame) -> DataFrame:
    """(block, lead, doc_id, digest, text): blocks of consecutive documents, each followed by a copy of the next block's first.

    Block bounds are exact: ids and hashes are sorted over all partitions, and one pair of bounds a block comes to
    the driver.  Texts are shuffled once.  Rows equal in id and text are sent once a task.
    """
    keys = checkpointed(slim.groupBy("doc_id", "digest").agg(F.max(F.octet_length("text")).alias("size")))
    blocks = max(splits(slim), (keys.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES)
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "digest")
    ranged = keys.repartitionByRange(blocks, "doc_id", "digest").select(order.alias("k"), F.spark_partition_id().alias("p"))
    tops = sorted(_key(r.k.doc_id, r.k.digest) for r in ranged.groupBy("p").agg(F.max("k").alias("k")).select("k").collect())
    field = slim.schema["doc_id"]

    def task(batches):
        seen = set()
        for batch in slices(batches, "text"):
            rows, block, lead = [], [], []
            for i, (doc_id, digest) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist())):
                if (doc_id, digest) in seen:
                    continue
                seen.add((doc_id, digest))
                key = _key(doc_id, digest)
                b = bisect_left(tops, key)
                rows.append(i)
                block.append(b)
                lead.append(False)
                if tops[b] == key:  # first of its block in descending order: the block above ends with it, the least one after the greatest
                    rows.append(i)
                    block.append((b + 1) % len(tops))
                    lead.append(True)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(lead, pa.bool_()), *taken.columns], names=["block", "lead", *batch.schema.names])

    dealt = slim.mapInArrow(task, f"block int, lead boolean, doc_id {field.dataType.simpleString()}, digest long, text string")
    return dealt.repartitionById(max(1, len(tops)), "block")


def beside_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text ends in the next document's beginning: its last floor(n_chars / 2) code points give way to as many, or all,
    of the first code points of the document with the next smaller id; after the least comes the greatest.  A NULL id
    is less than any other, documents of one id follow each other by a hash of their text, and rows equal in id and text are one
    document.  NULL texts are empty.  An empty table gives no rows; the next of an only document is itself.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    ordered = _dealt(slim).sortWithinPartitions("block", "lead", F.col("doc_id").desc_nulls_last(), F.col("digest").desc())
    field = slim.schema["doc_id"]
    id_type = to_arrow_type(field.dataType)

    def pairs(rows: list[tuple], prints: np.ndarray) -> pa.RecordBatch:
        """Results of every row but the last, whose next document is not known or which is not its block's own."""
        keep = [i for i in range(len(rows) - 1) if not rows[i][1]]
        texts = [rows[i][4] for i in keep]
        edited = [t[: len(t) - len(t) // 2] + rows[i + 1][4][: len(t) // 2] for i, t in zip(keep, texts)]
        own, following = prints[keep], prints[[i + 1 for i in keep]]
        new = signatures(pa.array(edited, pa.string()))
        columns = [
            pa.array([rows[i][2] for i in keep], id_type),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            _hex(own),
            _hex(new),
            pa.array(likeness(own, new), pa.float64()),
            pa.array(likeness(own, following), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def task(batches):
        rows, prints = [], np.zeros((0, BITS // 8), np.uint8)
        for batch in slices(batches, "text"):
            fresh = list(zip(*[batch.column(c).to_pylist() for c in ("block", "lead", "doc_id", "digest", "text")]))
            shown = signatures(batch.column("text"))
            before = [rows[-1][:4] if rows else None, *[r[:4] for r in fresh[:-1]]]
            new = [i for i, r in enumerate(fresh) if r[:4] != before[i]]  # equal rows from several tasks
            rows = rows[-1:] + [fresh[i] for i in new]
            prints = np.concatenate([prints[-1:], shown[new]])
            yield pairs(rows, prints)

    out = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(task, f"doc_id {field.dataType.simpleString()}, {out}")


def _links(t: int, left: np.ndarray, right: np.ndarray, rows: np.ndarray, n: np.ndarray, radius: int, blocks: int) -> np.ndarray:
    """Documents that each row is linked with by the pairs of ``left`` and ``right``, equal or disjoint sets of rows.

    The rows are those of table ``t``, whose block stands first and the blocks before it last; a pair that agrees in one
    of these was found in that block's table.
    """
    lanes = rows.reshape(len(rows), blocks, -1)
    found = np.zeros(len(rows), np.int64)
    same = left is right
    strip = max(1, (1 << 22) // max(1, len(right) * BITS // 8))
    for at in range(0, len(left), strip):
        some = left[at : at + strip]
        apart = np.bitwise_count(lanes[some][:, None] ^ lanes[right][None]).sum(axis=3, dtype=np.int64)
        near = (apart.sum(axis=2) <= radius) & (apart[:, :, blocks - t :] > 0).all(axis=2)
        if same:
            near &= some[:, None] != right[None]
        found[some] += near @ n[right]
        if not same:
            found[right] += n[some] @ near
    return found


def _raw(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BITS // 8)


def _found(t: int, rows: np.ndarray, n: np.ndarray, near: np.ndarray | None) -> pa.RecordBatch:
    """Rows (t, rotated, n, near); ``near`` is NULL where a bucket is yet to be compared."""
    bits = pa.array([r.tobytes() for r in rows], pa.binary())
    counts = pa.nulls(len(rows), pa.int64()) if near is None else pa.array(near, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t), pa.int32()), bits, pa.array(n, pa.int64()), counts], names=["t", "rotated", "n", "near"])


_FOUND = "t int, rotated binary, n long, near long"


def _buckets(table: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Links inside the buckets of the block tables; rows of a bucket of over CHUNK fingerprints come back uncompared."""
    width = BITS // 8 // blocks
    key = F.substring("rotated", 1, width)
    ordered = table.repartition("t", key).sortWithinPartitions("t", "rotated")

    def settled(t, rows, n):
        if len(rows) > CHUNK:
            yield _found(t, rows, n, None)
        elif len(rows) > 1:
            every = np.arange(len(rows))
            near = _links(t, every, every, rows, n, radius, blocks)
            if near.any():
                yield _found(t, rows[near > 0], n[near > 0], near[near > 0])

    def task(batches) -> Iterator[pa.RecordBatch]:
        held, large = None, None  # the bucket that may go on, and the key of one that is large already
        for batch in batches:
            t, rows, n = batch.column("t").to_numpy(), _raw(batch.column("rotated")), batch.column("n").to_numpy()
            if held is not None:
                t, rows, n = (np.concatenate(x) for x in zip(held, (t, rows, n)))
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (rows[1:, :width] != rows[:-1, :width]).any(axis=1)])
            begin = np.flatnonzero(new).tolist()
            for first, last in zip(begin, [*begin[1:], None]):
                bucket = int(t[first]), rows[first, :width].tobytes()
                if bucket == large:
                    yield _found(bucket[0], rows[first:last], n[first:last], None)
                    held = None
                elif last is not None:
                    if last - first > 1:
                        yield from settled(bucket[0], rows[first:last], n[first:last])
                elif len(rows) - first > CHUNK:
                    yield _found(bucket[0], rows[first:], n[first:], None)
                    held, large = None, bucket
                else:
                    held = t[first:], rows[first:], n[first:]
        if held is not None:
            yield from settled(int(held[0][0]), held[1], held[2])

    return ordered.mapInArrow(task, _FOUND)


def _chunk_pairs(large: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Links inside large buckets: chunks of about CHUNK rows, every pair of chunks in a group of its own."""
    key = F.substring("rotated", 1, BITS // 8 // blocks)
    rows = large.select("t", key.alias("key"), "rotated", "n")
    sizes = rows.groupBy("t", "key").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = rows.join(sizes, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("rotated"), F.col("chunks")))
    each = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cells = each.select("t", "key", F.least("own", "j").alias("a"), F.greatest("own", "j").alias("b"), "own", "rotated", "n")

    def compare(group: pa.Table) -> pa.Table:
        t, a, b = (group.column(c)[0].as_py() for c in ("t", "a", "b"))
        rows, own, n = _raw(group.column("rotated")), group.column("own").to_numpy(), group.column("n").to_numpy()
        left = np.flatnonzero(own == a)
        near = _links(t, left, left if a == b else np.flatnonzero(own == b), rows, n, radius, blocks)
        return pa.Table.from_batches([_found(t, rows[near > 0], n[near > 0], near[near > 0])])

    return cells.groupBy("t", "key", "a", "b").applyInArrow(compare, _FOUND)


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Rows (fingerprint, n, class_id, near): documents that have it, the least id of them, documents of other fingerprints within ``radius`` bits.

    ``prints`` has (doc_id, fingerprint).  Copies are counted before any comparison, so equal texts are never
    paired.  Table t holds every fingerprint rotated so that block t stands first, and is grouped by that block.  ``blocks`` must divide 32 bytes and be
    more than ``radius``: by the pigeonhole principle no pair is missed.  Rare buckets of over CHUNK different fingerprints are
    compared chunk by chunk in separate tasks.
    """
    if blocks <= radius or (BITS // 8) % blocks:
        raise ValueError("more blocks than the radius are needed, of whole bytes")
    width = BITS // 8 // blocks
    classes = checkpointed(prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id")))
    table = classes.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("t"), F.unhex("fingerprint").alias("bits"), "n")
    at = F.col("t") * width
    rotated = F.concat(F.substring("bits", at + 1, F.lit(BITS // 8)), F.substring("bits", F.lit(1), at))
    first = checkpointed(_buckets(table.select("t", rotated.alias("rotated"), "n"), radius, blocks))
    found = first.where("near IS NOT NULL").unionByName(_chunk_pairs(first.where("near IS NULL"), radius, blocks))
    back = F.lit(BITS // 8) - at
    bits = F.concat(F.substring("rotated", back + 1, F.lit(BITS // 8)), F.substring("rotated", F.lit(1), back))
    near = found.groupBy(F.lower(F.hex(bits)).alias("fingerprint")).agg(F.sum("near").alias("near"))
    joined = classes.join(near, "fingerprint", "left")
    return joined.select("fingerprint", "n", "class_id", F.coalesce("near", F.lit(0)).alias("near"))


def with_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``prints`` with ``class_id``, the least id of the same fingerprint, and ``n_within``, how many other documents lie within ``radius``."""
    counted = near_counts(prints.select("doc_id", "fingerprint"), radius, blocks)
    linked = counted.where("n > 1 OR near > 0").select("fingerprint", F.col("class_id").alias("__class"), (F.col("n") - 1 + F.col("near")).alias("__within"))
    out = attach(prints, linked, ["fingerprint"])
    known = F.col("__within").isNotNull()
    return out.select(
        *prints.columns, F.when(known, F.col("__class")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("__within", F.lit(0)).alias("n_within")
    )
