"""Quoted, multi-line CSV read in byte ranges.

A line break inside quotes belongs to a field, so a range of a file cannot tell by itself whether it starts inside one.
Each range reports what it does to both possible states, running composition gives the state in front of every range, and
then the ranges put their records together on their own.  The few records that cross a border are joined from their
pieces; every record is parsed by Spark's own CSV parser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_malformed"
# an open field goes on over line breaks; inside quotes two quotes stand for one
OPTIONS = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "multiLine": "true"}


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether the end of a line lies inside a quoted field, given whether its beginning does."""
    at = 0
    while True:
        if not inside:  # at the beginning of a field
            if line[at : at + 1] != b'"':
                at = line.find(b",", at) + 1
                if at == 0:
                    return False
                continue
            at += 1
        end = line.find(b'"', at)
        if end < 0:
            return True
        at, inside = end + 1, True
        if line[at : at + 1] != b'"':
            at = line.find(b",", at) + 1
            if at == 0:
                return False
            inside = False
        else:
            at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): lines in order inside each range of a file."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, list[bytes], list[int]]]:
    """(range, first row, lines, which of them hold a quote) of the runs of lines of one range; the next batch may go on with the last."""
    files, starts, values = batch.column("file").dictionary_encode(), batch.column("start").to_numpy(), batch.column("value")
    lines, code = values.to_pylist(), files.indices.to_numpy()
    quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
    edges = np.flatnonzero((code[1:] != code[:-1]) | (starts[1:] != starts[:-1])) + 1
    for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(lines)]):
        marks = quoted[np.searchsorted(quoted, first) : np.searchsorted(quoted, last)] - first
        yield (files.dictionary[int(code[first])].as_py(), int(starts[first])), first, lines[first:last], marks.tolist()


def _states(lines: DataFrame) -> DataFrame:
    """One row a range: (file, start, inside, crlf), the state in front of it and whether the file's first line ends in a carriage return."""

    def effect(batches):
        range_, out, crlf = None, None, None
        for batch in batches:
            for name, _, values, quoted in _ranges(batch):
                if name != range_:
                    if range_:
                        yield row(range_, out, crlf)
                    range_, out, crlf = name, [False, True], values[0].endswith(b"\r")
                for k in quoted:
                    out = [inside_after(values[k], s) for s in out]
        if range_:
            yield row(range_, out, crlf)

    def row(range_, out, crlf):
        return pa.RecordBatch.from_pylist([{"file": range_[0], "start": range_[1], "closed": out[0], "open": out[1], "crlf": crlf}])

    effects = lines.mapInArrow(effect, "file string, start long, closed boolean, open boolean, crlf boolean")
    # a range a row, 128 MB of text each: running composition of the effects of the ranges in front
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    seen = F.collect_list(F.struct("closed", "open")).over(before)
    inside = F.aggregate(seen, F.lit(False), lambda s, e: F.when(s, e["open"]).otherwise(e["closed"]))
    return effects.select("file", "start", inside.alias("inside"), F.first("crlf").over(W.partitionBy("file").orderBy("start")).alias("crlf"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): the text of every record of the files under ``path``; ``first`` marks a file's first one.

    Blank lines are no records.  The first line break of a file tells what its line breaks are.
    """
    lines = _lines(spark, path)
    states = _states(lines).withColumnRenamed("start", "_s").withColumnRenamed("file", "_f")
    # ranges are 128 MB of input each, so their states are small; the join keeps the order of lines inside a range
    known = lines.join(F.broadcast(states), (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_s"))).drop("_f", "_s")

    def assemble(batches):
        state = _Range()
        for batch in batches:
            out, size = [], 0
            for name, at, lines, quoted in _ranges(batch):
                if name != state.name:
                    out += state.rest()
                    state = _Range(name, batch.column("inside")[at].as_py(), batch.column("crlf")[at].as_py())
                for record in state.add(lines, quoted):
                    out.append(record)
                    size += len(record[3])
                    if size > 4 << 20:
                        yield emit(out)
                        out, size = [], 0
            if out:
                yield emit(out)
        rest = state.rest()
        if rest:
            yield emit(rest)

    def emit(rows):
        file, start, kind, text, number = zip(*rows)
        types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((file, start, kind, text, number), types)], names=["file", "start", "kind", "text", "number"])

    pieces = known.mapInArrow(assemble, "file string, start long, kind string, text binary, number long")
    whole = pieces.where("kind = 'whole'").select("file", ((F.col("start") == 0) & (F.col("number") == 0)).alias("first"), "text")
    # at most two pieces a range: the end of a record from the range before, and the beginning of one that goes on
    border = pieces.where("kind <> 'whole'")
    chain = F.count_if(F.col("kind") == "tail").over(W.partitionBy("file").orderBy("start", F.col("kind") == "tail"))
    linked = border.withColumn("chain", chain).groupBy("file", "chain").agg(
        F.sort_array(F.collect_list(F.struct("start", F.col("kind") == "tail", "text", "number"))).alias("p")
    )
    text = F.array_join(F.transform("p", lambda x: x["text"].cast("string")), "\n").cast("binary")
    head = F.get("p", F.lit(0))
    crossed = linked.select("file", ((head["start"] == 0) & (head["number"] == 0)).alias("first"), text.alias("text"))
    return whole.unionByName(crossed).select("file", "first", F.col("text").cast("string").alias("record")).where("record <> ''")


class _Range:
    """Puts the records of one range together while its lines pass."""

    def __init__(self, name=None, inside=False, crlf=False):
        self.name, self.inside, self.headless, self.crlf = name, inside, inside, crlf
        self.held: list[bytes] = []
        self.number = 0

    def add(self, lines: list[bytes], quoted: list[int]) -> Iterator[tuple]:
        """The records that end in these lines; only lines with a quote can change the state."""
        if self.crlf:
            lines = [x[:-1] if x.endswith(b"\r") else x for x in lines]
        ends = np.full(len(lines), not self.inside)  # whether a record ends with the line
        for k in quoted:
            inside = inside_after(lines[k], self.inside)
            if inside != self.inside:
                ends[k:] = not inside
            self.inside = inside
        at = 0
        for end in (np.flatnonzero(ends) + 1).tolist():
            self.held += lines[at:end]
            at = end
            yield self._close("head" if self.headless else "whole")
        self.held += lines[at:]

    def rest(self) -> list[tuple]:
        """What is left at the end of the range: the beginning of a record, or the middle of one that fills the range."""
        return [self._close("head" if self.headless else "tail")] if self.held else []

    def _close(self, kind: str) -> tuple:
        out = (*self.name, kind, b"\n".join(self.held), self.number)
        self.held, self.headless = [], False
        self.number += 1
        return out


def read_quoted(spark: SparkSession, path: str, schema: T.StructType, keep_malformed: bool = False) -> DataFrame:
    """Rows of the CSV files under ``path``, each with a header of the schema's names.

    Malformed records (another number of fields, or a value not of its type) are dropped; with ``keep_malformed`` they stay, their
    text in ``_malformed``, which is NULL in the others.  A header with other names is an error.
    """
    rows = records(spark, path)
    text = ", ".join(f"`{c}` string" for c in schema.names)
    titles = F.from_csv(F.regexp_replace("record", "^\ufeff", ""), text, {"escape": '"'})
    named = F.lit(True)
    for c in schema.names:
        named = named & F.coalesce(F.lower(F.trim(titles[c])) == c.lower(), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit(f"the header does not name {', '.join(schema.names)}: "), "record")).cast("boolean")
    rows = rows.where(F.when(~F.col("first"), True).when(named, False).otherwise(wrong))
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    parsed = rows.select(F.from_csv("record", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.fields), OPTIONS).alias("r"))
    parsed = parsed.select(*[F.col(f"r.`{c}`").alias(c) for c in wide.names])
    return parsed if keep_malformed else parsed.where(F.col(BAD).isNull()).drop(BAD)


def malformed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row (records, malformed) over all files."""
    rows = read_quoted(spark, path, schema, keep_malformed=True)
    return rows.agg(F.count("*").alias("records"), F.count(BAD).alias("malformed"))
