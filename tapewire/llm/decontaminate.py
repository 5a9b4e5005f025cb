"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

The automaton's letters are words: every window of 13 item words (or the whole of a
shorter item) is one pattern, a text is scanned once, and hits are mapped back to
code-point offsets of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewire.llm.batches import built_once, free_name, slices

WINDOW = 13
BLOCK_BYTES = 1 << 20  # item text in one automaton: about 2 million nodes in each task

# ASCII letters and digits and every byte of a longer character belong to words
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD_BYTES else 0x20 for b in range(256))
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("words", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)
_FOUND_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("words", pa.list_(pa.list_(pa.int64()))),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.list_(pa.int64()))),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Items:
    """The automaton over the windows of ``(item_id, text)`` pairs."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            codes = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text))
            for i in range(max(1, len(codes) - window + 1) if codes else 0):
                owners.setdefault(codes[i : i + window], set()).add(item)
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, own in owners.items():
                self.automaton.add_word(key, (len(key), own))
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit words as disjoint [first, end) word intervals in order, and the items with a hit."""
        if self.automaton is None or not words:
            return [], set()
        found: list[tuple[int, int]] = []
        own: set[str] = set()
        for last, (length, items) in self.automaton.iter(tuple(map(self.ids.get, words, repeat(0)))):
            found.append((last + 1 - length, last + 1))
            own |= items
        return joined(found), own


def joined(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _offsets(text: str, intervals: list[tuple[int, int]]) -> list[list[int]]:
    places = [m.span() for m in _ORIGINAL.finditer(text)]
    return [[places[a][0], places[b - 1][1]] for a, b in intervals]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(16)), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-int(total) // limit))
    for i in range(n):  # a few for any benchmark: its size does not follow the corpus
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield [(r["item"], r["text"]) for r in part.toLocalIterator()]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    found: str = "__found",
) -> DataFrame:
    """``docs`` with a struct column ``found``: ``n_words``; ``words``, the hit word intervals; ``items``, ids with hits
    sorted as strings; ``spans``, [start, end) code-point offsets of the hits in the original text.

    The items are broadcast in blocks of at most ``block_bytes`` of text; a larger benchmark takes one
    pass of the same plan per block.  No row is shuffled, so neither a hot passage nor repeated rows matter.
    A NULL text has no words and no hits, items without words match nothing, an empty benchmark gives no hits.
    A NULL item id counts as the empty string.  ``found`` must not be a name of ``docs``.
    """
    if free_name(docs.columns, found) != found:
        raise ValueError(f"the table has a column {found}: give another name for the hits")
    spark = docs.sparkSession
    schema = T.StructType([f for f in docs.schema.fields] + [T.StructField(found, _FOUND)])
    out = docs
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def task(batches, sent=sent):
            items = built_once(Items, sent.value, window)
            for batch in slices(batches, text_col):
                texts = batch.column(text_col).to_pylist()
                earlier = batch.column(found).to_pylist() if found in batch.schema.names else repeat(None)
                rows = []
                for text, old in zip(texts, earlier):
                    words = words_of(text)
                    places, own = items.hits(words)
                    if old:
                        places = joined([*map(tuple, old["words"]), *places])
                        own |= set(old["items"])
                    rows.append({"n_words": len(words), "words": places, "items": sorted(own), "spans": _offsets(text, places) if places else []})
                kept = [c for c in batch.schema.names if c != found]
                columns = [batch.column(c) for c in kept] + [pa.array(rows, _FOUND_ARROW)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, found])

        out = out.mapInArrow(task, schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, ``n_words``, ``n_hit``, ``items``, ``spans`` and ``contaminated`` (a twentieth of its words or more are hit)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return verdict(scan(slim, benchmark, **options)).select("doc_id", "__found.n_words", "n_hit", "__found.items", "__found.spans", "contaminated")


def verdict(scanned: DataFrame, found: str = "__found") -> DataFrame:
    n_hit = F.aggregate(F.col(found)["words"], F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return scanned.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col(found)["n_words"])
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated rows, all columns as they were, whatever their names."""
    found = free_name(docs.columns, "__found")
    scanned = scan(docs, benchmark, text_col, found=found, **options)
    hit = F.col(found)
    n_hit = F.aggregate(hit["words"], F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return scanned.where((n_hit == 0) | (20 * n_hit < hit["n_words"])).select(*docs.columns)
