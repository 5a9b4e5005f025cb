"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent 1- to 3-grams in order; a document's own most
frequent n-grams are compared with every profile by out-of-place distance.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewire.llm.batches import slices

RANKS = 400
SPACE = 32
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or 32 for anything that is not a letter."""
    out = np.full(0x110000, SPACE, dtype=np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(text: str) -> np.ndarray:
    """All 1- to 3-grams inside padded words, each as one integer of 21 bits a letter."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = _letters()[points]
    s = s[np.concatenate([[True], (s[1:] != SPACE) | (s[:-1] != SPACE)])]
    if len(s) < 2:
        return np.empty(0, np.int64)
    pairs = s[:-1] << 21 | s[1:]
    triples = (pairs[:-1] << 21 | s[2:])[s[1:-1] != SPACE]
    return np.concatenate([s[s != SPACE], pairs, triples])


def counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(g)
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    return g[first], np.diff(np.append(first, len(g)))


def top(g: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by the n-gram itself."""
    keys, n = counted(g)
    return keys[np.argsort(-n, kind="stable")[:ranks]]


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", ranks: int = RANKS) -> DataFrame:
    """Rows (lang, gram, rank): each language's ``ranks`` most frequent n-grams over all rows.

    Rows without text or language teach nothing.  Counts are summed inside each slice and
    task before the shuffle, and the rank limit is applied before it too.
    """
    slim = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )

    def task(batches):
        for batch in slices(batches, "text"):
            texts, langs = batch.column("text"), batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                own = texts.filter(pc.equal(langs, lang)).to_pylist()
                keys, n = counted(grams(" ".join(own)))
                if len(keys):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys)), pa.array(keys), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"]
                    )

    total = slim.mapInArrow(task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    # the limit stands on the row number itself: only so does it reach the tasks before the shuffle
    return total.withColumn("place", place).where(F.col("place") <= ranks).select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Profiles:
    """The profiles as one table: a row of ranks per language over all profile n-grams."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int) -> None:
        self.ranks = ranks
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.table = np.full((len(self.langs), len(self.grams)), -1, dtype=np.int64)
        for lang, gram, rank in rows:
            self.table[at[lang], np.searchsorted(self.grams, gram)] = rank

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language at the least out-of-place distance (ties: first by name) and one minus its share of the largest distance."""
        own = top(grams(text or ""), self.ranks)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == own, self.table[:, at], -1)
        out = np.where(ranks < 0, self.ranks, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(out))
        return self.langs[best], float(1.0 - out[best] / (self.ranks * len(own)))


def identify(docs: DataFrame, learned: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: int = RANKS) -> DataFrame:
    """Rows (doc_id, lang_pred, score) for every document.

    ``learned`` are the rows of :func:`profiles`; they are bounded by ``ranks`` a language and
    broadcast.  NULL, empty and letterless texts give ``und`` with score 0, as does an empty set of
    profiles.  Texts are compared whole; repeated rows get equal answers.
    """
    rows = [(r["lang"], r["gram"], r["rank"]) for r in learned.collect()]
    sent = docs.sparkSession.sparkContext.broadcast(Profiles(rows, ranks))

    def task(batches):
        model = sent.value
        for batch in slices(batches, "text"):
            found = [model.nearest(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(task, f"doc_id {kind}, lang_pred string, score double")
