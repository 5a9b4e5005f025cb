"""Language-model scoring: word counts of the whole training corpus and a recurrent model trained on all of it.

Training is data-parallel: in every round each task starts from the shared weights, takes its share of the round's
documents and sends its weights back; they are averaged by tokens.  Each training document is used once.
Scoring carries the state through whole documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm import gru
from tapewire.llm.batches import slices, word_codes
from tapewire.operators.scale import checkpointed

END = ""  # no word is empty
FREQUENT = 1000  # words with an output of their own
DICTIONARY = 1 << 18  # words whose counts are broadcast; the rest are joined
BUCKETS = 64  # inputs shared by all other words, by their last letters
ROUNDS = 4
SLICE = 24 << 20
PART = 8192  # numbers in a row of weights
FAN_IN = 256


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n) over all words of ``text``, with the end marks under the empty word."""

    def task(batches):
        for batch in slices(batches, "text"):
            codes, words, at = word_codes(batch.column("text"))
            n = np.bincount(codes, minlength=len(words))
            full = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([words.filter(full), pa.array(n[n > 0])], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([len(at) - 1], pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The broadcast part of the counts: at most ``DICTIONARY`` words, the first of them with outputs of their own."""

    def __init__(self, rows: list[tuple[str, int]], total: int, distinct: int) -> None:
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        frequent = [r for r in rows if r[0] != END][: FREQUENT - 1]
        ends = next((n for w, n in rows if w == END), 0)
        frequent = sorted([*frequent, (END, ends)], key=lambda r: (-r[1], r[0]))
        own = {w for w, _ in frequent}
        rows = [*frequent, *(r for r in rows if r[0] not in own)]
        self.k = len(frequent)
        self.words = [w for w, _ in rows]
        self.counts = np.array([n for _, n in rows], dtype=np.int64)
        self.all = total + 0.5 * (distinct + 1)
        self.other = max(self.all - float((self.counts[: self.k] + 0.5).sum()), 0.5)
        self.total = total

    def model(self, weights: np.ndarray | None) -> gru.Gru:
        return gru.Gru(self.counts[: self.k] + 0.5, self.other, self.k + BUCKETS, weights)

    def index(self) -> dict[str, int]:
        if "_index" not in self.__dict__:
            self._index = {w: i for i, w in enumerate(self.words)}
        return self._index

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_index"}

    def tokens(self, texts: pa.Array):
        """(place in the dictionary or -1, target, input) of every token, where texts begin, distinct words, their codes; -1 codes an end."""
        index = self.index()
        codes, words, at = word_codes(texts)
        names = words.to_pylist()
        place = np.fromiter((index.get(w, -1) for w in names), np.int32, len(names))
        bucket = np.fromiter((xxhash.xxh32_intdigest(w[-2:].encode("utf-8", "surrogatepass")) % BUCKETS for w in names), np.int32, len(names))
        known = (place >= 0) & (place < self.k)
        end = index[END]
        codes = np.insert(codes.astype(np.int32), at[1:], -1)
        at = at + np.arange(len(at))
        pick = lambda values, last: np.append(values, np.int32(last))[codes]  # noqa: E731  code -1 takes the value of the end mark
        target = pick(np.where(known, place, np.int32(self.k)), end)
        x = gru.inputs_of(pick(np.where(known, place, np.int32(self.k) + bucket), end), at, end)
        return pick(place, end), target, x, at, names, codes


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The words above the count at which at most ``DICTIONARY`` remain; found from a histogram of at most some 500 steps."""
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    step = F.floor(F.log2("n") * 8).cast("int")
    bars = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()
    least, room = 2**31 - 1, DICTIONARY
    for bar in sorted(bars, key=lambda b: -b["step"]):
        room -= bar["words"]
        if room < 0:
            break
        least = bar["step"]
    rows = counts.where((step >= least) | (F.col("word") == END)).collect()
    return Vocabulary([(r["word"], r["n"]) for r in rows], whole["n"], whole["v"])


def _summed(rows: DataFrame) -> dict[int, tuple[np.ndarray, float]]:
    """Weighted sums of the tasks' vectors by part, added up ``FAN_IN`` rows at a time."""
    schema = "task long, part int, tokens double, vector binary"

    def add(table: pa.Table) -> pa.Table:
        vector = np.sum([np.frombuffer(v.as_py(), "<f8") for v in table.column("vector")], axis=0)
        tokens = float(np.sum(table.column("tokens").to_numpy()))
        first = {c: table.column(c)[0].as_py() for c in ("group", "part")}
        return pa.Table.from_pylist(
            [{"task": first["group"], "part": first["part"], "tokens": tokens, "vector": vector.astype("<f8").tobytes()}],
            pa.schema([("task", pa.int64()), ("part", pa.int32()), ("tokens", pa.float64()), ("vector", pa.binary())]),
        )

    rows = checkpointed(rows)  # the training itself is not repeated for the count
    tasks = rows.agg(F.coalesce(F.max("task"), F.lit(0)).alias("m")).first()["m"] + 1
    while tasks > 1:
        rows = rows.withColumn("group", F.floor(F.col("task") / FAN_IN)).groupBy("part", "group").applyInArrow(add, schema)
        tasks = -(-tasks // FAN_IN)
    return {r["part"]: (np.frombuffer(r["vector"], "<f8"), r["tokens"]) for r in rows.select("part", "tokens", "vector").collect()}


def fit(train: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after one pass over ``train`` (doc_id, text) in ``rounds`` rounds of averaging."""
    model = words.model(None)
    state = np.concatenate([model.flat, np.full(model.flat.size, 1e-6, np.float32)])  # weights, sums of squared gradients
    if not words.total:
        return model.flat
    context = train.sparkSession.sparkContext
    sent = context.broadcast(words)
    for turn in range(rounds):
        share = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == turn).select("text")
        begin = context.broadcast(state.astype(np.float32))

        def task(batches, begin=begin):
            own = sent.value
            size = len(begin.value) // 2
            model = own.model(begin.value[:size].copy())
            seen = begin.value[size:].copy()
            tokens = 0
            for batch in slices(batches, "text", SLICE):
                _, y, x, at, _, _ = own.tokens(batch.column("text"))
                gru.train(model, x, y, at, seen)
                tokens += len(y)
            if tokens:
                vector = np.concatenate([model.flat, seen]).astype(np.float64) * tokens
                parts = [vector[i : i + PART].astype("<f8").tobytes() for i in range(0, len(vector), PART)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([float(tokens)] * n), pa.array(parts, pa.binary())],
                    names=["task", "part", "tokens", "vector"],
                )

        found = _summed(share.mapInArrow(task, "task long, part int, tokens double, vector binary"))
        if found:
            state = np.concatenate([found[i][0] / found[i][1] for i in sorted(found)])
    return state[: len(state) // 2].astype(np.float32)


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Words are lowered in A-Z and cut at ASCII white space; an end mark follows every text, also a NULL or empty one.
    ``base_score`` is the smoothed unigram log10 probability, ``score`` the model's, over the same
    events: known words and one unknown.  Both cover whole texts.  Without training rows both give
    the unknown word all probability.  Repeated rows get equal scores.

    Counts of up to ``DICTIONARY`` words are broadcast; occurrences of rarer words are joined with the
    counts.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    train = train.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = checkpointed(word_counts(train))
    words = vocabulary(counts)
    weights = fit(train, words, rounds)
    context = docs.sparkSession.sparkContext
    sent, trained = context.broadcast(words), context.broadcast(weights)
    kind = slim.schema["doc_id"].dataType.simpleString()
    rare_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def task(batches):
        own = sent.value
        model = own.model(trained.value)
        logs = np.append(np.log10(own.counts + 0.5), 0.0)  # -1: not in the dictionary
        seen = np.append(own.counts > 0, False)
        for batch in slices(batches, "text", SLICE):
            place, y, x, at, names, codes = own.tokens(batch.column("text"))
            ll = gru.score(model, x, y, at) / math.log(10)
            add = lambda v: np.add.reduceat(v, at[:-1]) if len(at) > 1 else np.empty(0)  # noqa: E731  every text has an end
            tail = y == own.k
            out = {
                "n_tokens": np.diff(at),
                "n_seen": add(seen[place].astype(np.int64)),
                "n_tail": add(tail.astype(np.int64)),
                "log_all": add(logs[place]),
                "log_tail": add(np.where(tail, logs[place], 0.0)),
                "model": add(ll),
            }
            unknown = np.flatnonzero(place < 0)
            owner = np.searchsorted(at, unknown, "right") - 1
            pair, n = np.unique(owner.astype(np.int64) * max(1, len(names)) + codes[unknown], return_counts=True)
            owner, code = np.divmod(pair, max(1, len(names)))
            ends = np.searchsorted(owner, np.arange(len(at) - 1), "right").astype(np.int32)
            rare = pa.ListArray.from_arrays(
                pa.array(np.append(0, ends).astype(np.int32)), pa.StructArray.from_arrays([pa.array([names[c] for c in code.tolist()], pa.string()), pa.array(n.astype(np.int64))], ["word", "n"])
            ).cast(rare_type)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *map(pa.array, out.values()), rare], names=["row", "doc_id", *out, "rare"])

    schema = f"row long, doc_id {kind}, n_tokens long, n_seen long, n_tail long, log_all double, log_tail double, model double, rare array<struct<word: string, n: bigint>>"
    rows = checkpointed(slim.mapInArrow(task, schema))
    single = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    found = single.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("log_rare"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("n_rare")
    )
    rest = F.coalesce("log_rare", F.lit(0.0))
    return rows.drop("rare").join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_seen") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("log_all") + rest - F.col("n_tokens") * math.log10(words.all)).alias("base_score"),
        (F.col("model") + F.col("log_tail") + rest - F.col("n_tail") * math.log10(words.other)).alias("score"),
    )
