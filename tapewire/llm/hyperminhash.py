"""Near-duplicate groups from HyperMinHash sketches.

A register holds the least hash of its bucket as a leading-zero count and the mantissa bits behind it.
Bands of four of 128 registers propose pairs; 512 registers, folded to a byte each, give a collision-corrected
Jaccard estimate that drops most of them; whole shingle sets decide the rest, and linked documents form components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.batches import as_binary, null_safe, slices, spans, word_codes
from tapewire.operators.scale import checkpointed

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS  # for bands
FINE_BITS = 9
FINE = 1 << FINE_BITS  # for estimates
MANTISSA = 10
FOLDS = 255  # values of a folded register; 0 is an empty bucket
BAND = 4  # registers a band: at a similarity of 0.8 all 32 bands miss a pair once in 20 million
ERRORS = 5.0  # standard errors that an estimate may lie below the threshold before a pair is dropped
BLOCK = 1024  # rows of a bucket compared at a time
BROADCAST_IDS = 50_000
EDGES_A_TASK = 100_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the distinct word shingles of many texts at a time."""

    def __init__(self, size: int) -> None:
        self.size = size

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """A sorted array of distinct 64-bit hashes per text; fewer words than ``size`` are one shingle, none give an empty array."""
        codes, words, at = word_codes(texts)
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in as_binary(words)), np.uint64, len(words))[codes]
        k = self.size
        rolled = np.zeros(max(0, len(hashed) - k + 1), dtype=np.uint64)
        for i in range(k):
            rolled = _mixed(rolled * _MIX[0] + hashed[i : i + len(rolled)])
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                h = np.sort(rolled[a : b - k + 1])
                out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
            elif b > a:
                short = np.uint64(b - a)
                for x in hashed[a:b]:
                    short = _mixed(np.array([short], np.uint64) * _MIX[0] + x)[0]
                out.append(np.array([short], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def registers(sets: list[np.ndarray], bits: int = BUCKET_BITS) -> np.ndarray:
    """A row of 2 ** ``bits`` registers per sorted set: (leading zeros + 1) << 10 | mantissa of the bucket's least hash, 0 for an empty bucket."""
    size = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), 1 << bits), dtype=np.uint16)
    if not size.sum():
        return out
    h = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    least = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])]))
    rest = h[least] & np.uint64((1 << (64 - bits)) - 1)
    top = rest >> np.uint64(32)  # the bit length, found on halves that a float holds exactly
    length = np.where(top > 0, np.frexp(top.astype(np.float64))[1] + 32, np.frexp((rest & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])
    length = np.maximum(length, 1)
    behind = length - 1
    shift = behind - MANTISSA
    tail = rest & ((np.uint64(1) << behind.astype(np.uint64)) - np.uint64(1))
    mantissa = np.where(shift >= 0, tail >> np.maximum(shift, 0).astype(np.uint64), tail << np.maximum(-shift, 0).astype(np.uint64))
    out[row[least], bucket[least]] = ((64 - bits - length + 1).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def folded(rows: np.ndarray) -> np.ndarray:
    """Registers as bytes; unequal ones agree once in ``FOLDS`` times."""
    mixed = (rows.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(16)
    return np.where(rows > 0, 1 + mixed % FOLDS, 0).astype(np.uint8)


def estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of folded rows, and how many registers each rests on."""
    either = ((a | b) != 0).sum(axis=1)
    share = ((a == b) & (a != 0)).sum(axis=1) / np.maximum(either, 1)
    chance = 1 / FOLDS
    return np.clip((share - chance) / (1 - chance), 0, 1), either


def passes(estimate: np.ndarray, rests_on: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the similarity may reach the threshold: within ``ERRORS`` standard errors of it.

    The registers are a sample without replacement of a union of ``(na + nb) / (1 + t)`` hashes.
    """
    t = percent / 100
    k = np.maximum(rests_on, 1)
    union = np.maximum((na + nb) / (1 + t), 2)
    left_out = np.clip((union - k) / (union - 1), 0, 1)
    error = np.sqrt(t * (1 - t) / k * left_out + (1 - t) / (FOLDS * k))
    near = estimate + ERRORS * error + 1 / k >= t
    return near & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def sketches(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, digest, registers, fine); ``digest`` names the shingle set, NULL without words."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def task(batches):
        shingler = Shingler(shingle)
        for batch in slices(batches, "text"):
            sets = shingler.sets(batch.column("text"))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            rows = [r.tobytes() for r in registers(sets).astype("<u2")]
            fine = [r.tobytes() for r in folded(registers(sets, FINE_BITS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(rows, pa.binary()), pa.array(fine, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "registers", "fine"],
            )

    return slim.mapInArrow(task, f"doc_id {kind}, n_shingles long, digest binary, registers binary, fine binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """Rows (node, band, key): a key per band with a full register."""
    width = 2 * BAND
    parts = [(i, F.substring("registers", 1 + width * i, width)) for i in range(REGISTERS // BAND)]
    keys = F.array(*[F.when(p != F.lit(bytes(width)), F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), p).alias("key"))) for i, p in parts])
    return nodes.select("node", F.explode(F.array_compact(keys)).alias("at")).select("node", "at.band", "at.key")


def _stars(live: DataFrame) -> DataFrame:
    """Distinct (leader, member): each bucket's most central row with every other row of it.

    A row is central if its buckets are full: the text that copies derive from shares more bands with them than
    they share among themselves.
    """
    central = live.groupBy("node").agg(F.sum("size").alias("score"))
    scored = live.join(central, "node")
    leader = scored.groupBy("key").agg(F.max(F.struct("score", "node"))["node"].alias("leader"))
    return scored.join(leader, "key").where(F.col("node") != F.col("leader")).select("leader", F.col("node").alias("member")).distinct()


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(leader, member, estimate) of the pairs that may reach the threshold."""
    side = lambda name, own: nodes.select(F.col("node").alias(name), F.col("fine").alias(f"r_{own}"), F.col("n").alias(f"n_{own}"))
    rows = pairs.join(side("member", "b"), "member").join(side("leader", "a"), "leader").select("leader", "member", "r_a", "r_b", "n_a", "n_b")
    kind = rows.schema["leader"].dataType.simpleString()

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            estimate, on = estimates(_matrix(batch.column("r_a"), "u1", FINE), _matrix(batch.column("r_b"), "u1", FINE))
            ok = pa.array(passes(estimate, on, na, nb, percent))
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("member"), pa.array(estimate)], names=["leader", "member", "estimate"]).filter(ok)

    return rows.mapInArrow(task, f"leader {kind}, member {kind}, estimate double")


def _with_sets(rows: DataFrame, shingle: int, name: str) -> DataFrame:
    """``rows`` with the array of shingle hashes in place of ``text``."""
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def task(batches):
        shingler = Shingler(shingle)
        for batch in slices(batches, "text"):
            sets = shingler.sets(batch.column("text"))
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=[*kept, name])

    return rows.mapInArrow(task, f"{schema}, {name} array<long>")


def _verified(pairs: DataFrame, n: int, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The ``n`` pairs whose whole shingle sets reach the threshold, checkpointed.

    Ids of at most ``BROADCAST_IDS`` pairs are broadcast to the scan of the texts; more are joined by shuffle.
    """
    small = F.broadcast if n <= BROADCAST_IDS else (lambda df: df)
    members = docs.join(small(pairs.select("leader", "member")), F.col("doc_id") == F.col("member")).select("leader", "member", "text")
    leaders = pairs.select("leader").distinct()
    leading = docs.join(small(leaders), F.col("doc_id") == F.col("leader")).select("leader", "text")
    rows = _with_sets(members, shingle, "b").join(_with_sets(leading, shingle, "a"), "leader")
    both = F.size(F.array_intersect("a", "b"))
    # nothing behind the join needs a leader's rows together, so adaptive execution may split a hot leader
    linked = rows.select("leader", "member", both.alias("both"), (F.size("a") + F.size("b")).alias("sum"))
    return checkpointed(linked.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("leader", "member"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of the edges (leader, member) that reach a lesser one: the least node each can reach.

    Every round hooks a node to its least neighbour, follows the hooks to their ends by doubling and contracts the
    edges; rounds grow with the logarithm of the longest path.  Tables have as many partitions as their size asks for.
    """
    tasks = edges.count() // EDGES_A_TASK + 1
    left = edges.select(F.greatest("leader", "member").alias("hi"), F.least("leader", "member").alias("lo")).where("hi <> lo")
    labels = None
    while not left.isEmpty():
        hooks = left.groupBy("hi").agg(F.min("lo").alias("lo"))
        while True:
            ends = hooks.select(F.col("hi").alias("lo"), F.col("lo").alias("end"))
            on = hooks.join(ends, "lo", "left").select("hi", F.coalesce("end", "lo").alias("lo"), F.col("end").isNotNull().alias("moved"))
            on = checkpointed(on.coalesce(tasks))
            hooks = on.select("hi", "lo")
            if on.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
        else:
            to = hooks.select(F.col("hi").alias("comp"), F.col("lo").alias("end"))
            moved = labels.join(to, "comp", "left").select("node", F.coalesce("end", "comp").alias("comp"))
            labels = checkpointed(moved.unionByName(hooks.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))).coalesce(tasks))
        for side in ("hi", "lo"):
            to = hooks.select(F.col("hi").alias(side), F.col("lo").alias("end"))
            left = left.join(to, side, "left").select(F.coalesce("end", side).alias(side), *[c for c in ("hi", "lo") if c != side])
        left = left.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()
        left = checkpointed(left.coalesce(tasks))
    return edges.select(F.col("leader").alias("node"), F.col("member").alias("comp")).limit(0) if labels is None else labels


def _across(live: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(leader, member) of rows that share a bucket, lie in different components and pass the estimate.

    Buckets inside one component have nothing left to find.  The others are cut by set size, since sets that
    differ too much in size cannot be similar: a row joins its own size class and, as a guest, the next smaller
    one.  A large class is cut into blocks, and block pairs are compared in parallel on registers.  A pair counts in the first
    band that it shares.
    """
    t = percent / 100
    step = float(np.log(1 / t)) + 1e-9
    named = live.join(labels, "node", "left").join(nodes.select("node", "n"), "node")
    named = named.select("key", "band", "node", F.coalesce("comp", "node").alias("comp"), "n", F.floor(F.log("n") / step).alias("own"))
    named = checkpointed(named)  # narrow, and read twice
    classed = named.withColumn("class", F.explode(F.array("own", F.col("own") - 1)))
    mixed = classed.groupBy("key", "class").agg(
        F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max((F.col("own") == F.col("class")).cast("int")).alias("any")
    )
    mixed = mixed.where("lo <> hi and any = 1").select("key", "class", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    rows = classed.join(mixed, ["key", "class"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("task", F.xxhash64("key", "class", F.least("block", "other"), F.greatest("block", "other")))
    rows = rows.withColumn("split", F.col("block") != F.col("other"))
    full = rows.select("task", "split", "block", "band", "node", "comp", "n", (F.col("own") == F.col("class")).alias("owner")).join(nodes.select("node", "registers", "fine"), "node")
    dealt = full.repartition("task").sortWithinPartitions("task")
    kind = dealt.schema["node"].dataType.simpleString()

    def compared(table: pa.Table):
        task, split, block, band, comp, n, owner = (table.column(c).to_numpy() for c in ("task", "split", "block", "band", "comp", "n", "owner"))
        node = table.column("node").combine_chunks()
        bands = _matrix(table.column("registers"), "<u8", REGISTERS // BAND)
        fine = _matrix(table.column("fine"), "u1", FINE)
        first = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        end = np.repeat(np.append(first[1:], len(task)), np.diff(np.append(first, len(task))))
        partners = end - np.arange(len(task)) - 1
        upto = np.cumsum(partners)
        start = 0
        while start < len(task):  # rows whose pairs fill a bounded piece
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + 50_000, "right")))
            a = np.repeat(np.arange(start, stop), partners[start:stop])
            b = a + 1 + spans(partners[start:stop])
            ok = (comp[a] != comp[b]) & (owner[a] | owner[b]) & (~split[a] | (block[a] != block[b]))
            ok &= 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            a, b = a[ok], b[ok]
            same = (bands[a] == bands[b]) & (bands[a] != 0)
            ok = same.argmax(axis=1) == band[a]
            a, b = a[ok], b[ok]
            if len(a):
                estimate, on = estimates(fine[a], fine[b])
                near = passes(estimate, on, n[a], n[b], percent)
                if near.any():
                    yield pa.RecordBatch.from_arrays([node.take(pa.array(a[near])), node.take(pa.array(b[near]))], names=["leader", "member"])
            start = stop

    def task(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            ids = table.column("task").to_numpy()
            if not len(ids):
                continue
            cut = int(np.searchsorted(ids, ids[-1]))  # the last task may go on in the next batch
            if cut:
                yield from compared(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield from compared(rest)

    return dealt.mapInArrow(task, f"leader {kind}, member {kind}")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept): one per row of ``docs``.

    Documents are linked if their sets of ``shingle``-word shingles have 100 * intersection >= ``percent`` * union;
    ``component_id`` is the least id reachable over links and ``kept`` marks its row.  Words are lowered in A-Z and
    cut at ASCII white space; a text of fewer words is one shingle; NULL, empty and blank texts have none and link to nothing.
    Ids are taken to be unique: rows that share one
    are told apart only by their sets.  A NULL id never leads: such a row belongs to a
    component only if its set equals another document's, and otherwise has a NULL ``component_id`` and is kept.

    Equal sets are one node from the start, however many copies there are.  Every bucket is settled
    against its most central row first, one comparison a row; only what still lies in
    different components is compared block by block.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = checkpointed(sketches(slim, shingle))
    nodes = base.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("registers").alias("registers"), F.first("fine").alias("fine"), F.first("n_shingles").alias("n")
    )
    nodes = checkpointed(nodes)
    known = nodes.where(F.col("node").isNotNull())
    keys = _bands(known)
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    live = checkpointed(keys.join(shared, "key"))
    near = _estimated(_stars(live), known, percent)
    best = checkpointed(near.groupBy("member").agg(F.max(F.struct("estimate", "leader"))["leader"].alias("leader")).select("leader", "member"))
    edges = _verified(best, best.count(), slim, shingle, percent)
    labels = components(edges)
    cross = checkpointed(_across(live, labels, known, percent))
    if n := cross.count():
        labels = components(edges.unionByName(_verified(cross, n, slim, shingle, percent)))
    comp = nodes.join(labels, "node", "left").select("digest", F.coalesce("comp", "node").alias("component_id"))
    full = base.where(F.col("digest").isNotNull()).join(comp, "digest").select("doc_id", "n_shingles", "component_id")
    none = base.where(F.col("digest").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that of the least id.  All columns pass unchanged."""
    kept = near_duplicates(docs, shingle, percent, id_col, text_col).where("kept").select(F.col("doc_id").alias(id_col)).distinct()
    return null_safe(docs, kept, [id_col], "left_semi")
