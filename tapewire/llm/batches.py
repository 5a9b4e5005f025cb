"""Helpers for the Arrow tasks: bounded slices of text and whole-batch tokenising."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of the batches with at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space, as (code of each word, distinct words, where each text's codes begin and end).

    A NULL text has no words.  Only A-Z are lowered.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # the ends of a text leave empty pieces
    before = np.concatenate([[0], np.cumsum(full)])
    return codes[full], coded.dictionary, before[bounds - bounds[0]]


_BUILT: dict[type, tuple[object, object]] = {}


def built_once(kind: type, value, *rest):
    """``kind(value, *rest)``, built once per worker process and broadcast value; holding the value keeps its identity from passing on."""
    if kind not in _BUILT or _BUILT[kind][0] is not value:
        _BUILT[kind] = (value, kind(value, *rest))
    return _BUILT[kind][1]


def as_binary(values: pa.Array) -> list[bytes]:
    return values.cast(pa.binary()).to_pylist()


def spans(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for every n of ``lengths``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths)


def splits(df: DataFrame) -> int:
    """Tasks that the input's size asks for; grows with the input."""
    return max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores put behind it until no column has that name; case is ignored as Spark does."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join by ``<=>`` on renamed keys of ``right``, which must be distinct in them; ``right``'s keys are dropped."""
    marked = right.select(*[F.col(k).alias(f"__right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(marked[f"__right_{k}"])
        condition = same if condition is None else condition & same
    out = left.join(marked, condition, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__right_{k}" for k in keys])
