"""Conversation structure repair: the cheapest edits that make turns alternate.

Roles must read ``(s?(ua)+)?`` by their initials: an optional system turn, then user and
assistant in turn.  A dynamic programme over (turn, state) keeps backward cost vectors only
at every square root of a run's length; walking forward, a block's vectors are worked out
again from the checkpoint behind it, and the least letter that is still on a cheapest path is taken.

A conversation may hold a third of all rows.  The narrow turns are therefore sorted over all
partitions, so that one conversation is cut into runs, each run gives a 4 x 4 matrix of costs,
and the few runs that border on others (two a partition at most) are chained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tapewire.llm.batches import null_safe, slices, splits
from tapewire.operators.scale import checkpointed, once

WHITE = " \t\n\x0b\x0c\r"
SPEECH = r"[^\x20\x09-\x0D]"

# States by the last role kept: nothing yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the only role that may be put in
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
NOWHERE = (None, None, None, None)
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
FAR = 1 << 60
END = (0, 2 * INSERT, INSERT, 0)  # cost of closing a conversation from each state

_EDITS = "place long, edit string, fault string, turn long, was string, role string, text string"


def before(turn: tuple[str, bool, bool], after: tuple[int, ...]) -> tuple[int, ...]:
    """Cost vector in front of a turn (initial, must go, cut off) from the one behind it."""
    initial, must, cut = turn
    keep = KEEP.get(initial, NOWHERE)
    cost = []
    for s in range(4):
        c = DELETE + after[s]
        if not must:
            c = min(c, REROLE + cut * CUT_OFF + after[NEXT[s]])
            if keep[s] is not None:
                c = min(c, cut * CUT_OFF + after[keep[s]])
        cost.append(c)
    # after two inserts a user or assistant state is back where it was
    return tuple(min(cost[s], INSERT + cost[NEXT[s]], 2 * INSERT + cost[NEXT[NEXT[s]]]) for s in range(4))


def run_matrix(turns: list[tuple[str, bool, bool]]) -> list[int]:
    """Cost from state s in front of a run to state t behind it, as 16 numbers."""
    columns = []
    for t in range(4):
        v = tuple(0 if s == t else FAR for s in range(4))
        for turn in reversed(turns):
            v = before(turn, v)
        columns.append(v)
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(turns: list[tuple[str, bool, bool]], state: int, end: tuple[int, ...]) -> Iterator[tuple[str, int]]:
    """(letters, state behind it) of each turn on the ASCII-least cheapest path: inserts in front of the turn, then its own edit."""
    n = len(turns)
    step = isqrt(n) + 1
    saved, v = {}, end
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            saved[i // step] = v
        v = before(turns[i], v)
    for block in range((n + step - 1) // step):
        first, last = block * step, min(n, (block + 1) * step)
        vectors = [saved[block]]
        for i in range(last - 1, first - 1, -1):
            vectors.append(before(turns[i], vectors[-1]))
        for i in range(first, last):
            here, after = vectors[last - i], vectors[last - i - 1]
            initial, must, cut = turns[i]
            letters = ""
            while True:
                keep = KEEP.get(initial, NOWHERE)[state]
                if here[state] == DELETE + after[state]:
                    letters += "D"
                elif here[state] == INSERT + here[NEXT[state]]:
                    letters += "I"
                    state = NEXT[state]
                    continue
                elif keep is not None and here[state] == cut * CUT_OFF + after[keep]:
                    letters += "K"
                    state = keep
                else:
                    letters += "R"
                    state = NEXT[state]
                break
            yield letters, state


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    return once(
        rows,
        digest=key,
        was=F.col("role"),
        blank=~F.col("text").rlike(SPEECH),
        cut=~last.isin(".", "!", "?"),
    )


def _bundles(turns: DataFrame) -> DataFrame:
    """Equal rows of a turn counted together, in order, each marked as the first of its role and text or not."""
    grouped = turns.groupBy("conv_id", "turn", "digest", "was", "blank", "cut").agg(F.count("*").alias("n"))
    grouped = checkpointed(grouped)
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = grouped.groupBy("conv_id", "digest").agg(F.min(order).alias("o")).select("conv_id", "digest", F.col("o.turn").alias("turn"), F.lit(True).alias("first"))
    marked = null_safe(grouped, first, ["conv_id", "digest", "turn"], "left")
    keys = ["conv_id", "turn", "digest"]
    ranged = marked.repartitionByRange(splits(turns), *keys).sortWithinPartitions(*keys)
    flat = ranged.select(*keys, "was", "blank", "cut", F.col("first").isNull().alias("again"), "n", F.spark_partition_id().alias("part"))
    return checkpointed(flat)  # runs are named by partition: a lost executor must not sample other bounds


def _runs(batches) -> Iterator[tuple[int, object, list, list]]:
    """(partition, conversation, turns for the programme, rows) of every run of a partition, in order."""
    part, conv, turns, rows = None, None, [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "conv_id", "was", "blank", "again", "cut", "turn", "digest", "n")]
        for p, c, was, blank, again, cut, turn, digest, n in zip(*columns):
            if turns and c != conv:
                yield part, conv, turns, rows
                turns, rows = [], []
            part, conv = p, c
            turns.append((was[:1], blank or again, cut))
            rows.append((turn, digest, was, blank, again, cut, n))
    if turns:
        yield part, conv, turns, rows


def _edges(batches) -> Iterator[tuple[int, object, list]]:
    """The first and the last run of a partition."""
    last, n = None, 0
    for part, conv, turns, _ in _runs(batches):
        if n == 0:
            yield part, conv, turns
        last, n = (part, conv, turns), n + 1
    if n > 1:
        yield last


def _chain(bundles: DataFrame) -> dict:
    """{(partition, conversation): (state in front, cost vector behind)} of runs that border on another run of their conversation.

    Two small rows a partition come to the driver, whatever the number of turns.
    """
    field = bundles.schema["conv_id"]
    schema = f"part long, conv_id {field.dataType.simpleString()}, value array<bigint>"
    types = [pa.int64(), to_arrow_type(field.dataType), pa.list_(pa.int64())]

    def row(part, conv, value):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, conv, value), types)], names=["part", "conv_id", "value"])

    def matrices(batches):
        for part, conv, turns in _edges(batches):
            yield row(part, conv, run_matrix(turns))

    spans: list[list] = [[]]
    for r in bundles.mapInArrow(matrices, schema).collect():  # in order of partition, the first run before the last
        if spans[-1] and spans[-1][-1].conv_id != r.conv_id:
            spans.append([])
        spans[-1].append(r)
    spans = [s for s in spans if len(s) > 1]
    behind = {}
    for span in spans:
        v = END
        for r in reversed(span):
            behind[r.part, r.conv_id] = v
            v = tuple(min(r.value[4 * s + t] + v[t] for t in range(4)) for s in range(4))
    if not spans:
        return {}

    def exits(batches):
        for part, conv, turns in _edges(batches):
            if (part, conv) in behind:
                yield row(part, conv, [[at for _, at in walk(turns, s, behind[part, conv])][-1] for s in range(4)])

    leads = {(r.part, r.conv_id): r.value for r in bundles.mapInArrow(exits, schema).collect()}
    known = {}
    for span in spans:
        state = START
        for r in span:
            known[r.part, r.conv_id] = (state, behind[r.part, r.conv_id])
            state = leads[r.part, r.conv_id][state]
    return known


def _decisions(bundles: DataFrame) -> DataFrame:
    """The bundles with the letters of their first row's edits, inserts in front of it included."""
    known = _chain(bundles)
    field = bundles.schema["conv_id"]
    schema = f"conv_id {field.dataType.simpleString()}, turn long, digest binary, was string, blank boolean, again boolean, cut boolean, n long, letters string"
    names = ["conv_id", "turn", "digest", "was", "blank", "again", "cut", "n", "letters"]
    types = [to_arrow_type(field.dataType), pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.string()]

    def task(batches):
        out = []
        for part, conv, turns, rows in _runs(batches):
            state, end = known.get((part, conv), (START, END))
            for (turn, digest, was, blank, again, cut, n), (letters, _) in zip(rows, walk(turns, state, end)):
                out.append((conv, turn, digest, was, blank, again, cut, n, letters))
                if len(out) == 20_000:
                    yield _rows(out, names, types)
                    out = []
        if out:
            yield _rows(out, names, types)

    return bundles.mapInArrow(task, schema)


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, place, edit, fault, turn, was, role, text), one an edit; those with a role, in order of place, are the repaired conversation.

    ``edit`` is K (kept), R (another role), D (deleted: ``role`` and ``text`` are NULL) or I (an empty turn put in: ``turn`` and ``was``,
    the role as it was, are NULL).  ``fault`` is the first of blank, duplicate (role and text seen earlier in the conversation) and
    truncated (the last character that is no white space is not one of ``.!?``).  Deleting costs 3 and is the only way with blank and duplicate rows, another role and
    an insert 2, a truncated row that stays 1.  Of the cheapest edits those that are least in ASCII are taken.

    Rows are ordered by turn, NULL first, and inside a turn by the SHA-256 of role and text; repeated rows are
    duplicates of each other.  NULL roles and texts are one space; a NULL id is one conversation.  Texts of any length are only
    compared by digest and pass one by one.  An empty table gives no rows.  Columns other than the named ones are not looked at.

    A conversation's rows stand together in one partition, in order of place.  The programme runs on narrow rows, where a long
    conversation is split; texts are joined to the edits by sorting, one stream a conversation, never collected.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    decided = _decisions(_bundles(turns)).withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    nothing = {"was": "string", "blank": "boolean", "again": "boolean", "cut": "boolean", "n": "long", "letters": "string"}
    texts = turns.where(~F.col("blank")).select("conv_id", "turn", "digest", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], "role", "text")
    both = decided.unionByName(texts).repartition(splits(turns), "conv_id")
    ordered = both.sortWithinPartitions("conv_id", "turn", "digest", F.col("letters").isNull())
    field = ordered.schema["conv_id"]
    names = ["conv_id", "place", "edit", "fault", "turn", "was", "role", "text"]
    types = [to_arrow_type(field.dataType), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def edits(batches):
        """Tuples of an edit without place, with ``None`` behind each conversation."""
        conv, begun, state, waiting = None, False, START, None
        for batch in batches:
            for c, turn, was, blank, again, cut, n, letters, role, text in zip(
                *[batch.column(k).to_pylist() for k in ("conv_id", "turn", "was", "blank", "again", "cut", "n", "letters", "role", "text")]
            ):
                if begun and c != conv:
                    yield from closing(conv, state)
                    state = START
                conv, begun = c, True
                if letters is None:
                    if waiting is None:
                        continue  # a repeated row
                    edit, was, cut, turn, n = waiting
                    kept = role if edit == "K" else NAMES[state]
                    yield conv, edit, "truncated" if cut else None, turn, was, kept, text
                    waiting = None
                    for _ in range(n - 1):
                        yield conv, "D", "duplicate", turn, was, None, None
                    continue
                for letter in letters:
                    if letter == "I":
                        state = NEXT[state]
                        yield conv, "I", None, None, None, NAMES[state], ""
                    elif letter == "D":
                        first = "blank" if blank else "duplicate" if again else "truncated" if cut else None
                        yield conv, "D", first, turn, was, None, None
                        for _ in range(n - 1):
                            yield conv, "D", "blank" if blank else "duplicate", turn, was, None, None
                    else:
                        state = KEEP[was[:1]][state] if letter == "K" else NEXT[state]
                        waiting = (letter, was, cut, turn, n)
        if begun:
            yield from closing(conv, state)

    def closing(conv, state):
        while state in (SYSTEM, USER):
            state = NEXT[state]
            yield conv, "I", None, None, None, NAMES[state], ""
        yield None

    def task(batches):
        out, size, place = [], 0, 0
        for edit in edits(slices(batches, "text")):
            if edit is None:
                place = 0
                continue
            out.append((edit[0], place, *edit[1:]))
            place += 1
            size += 64 + len(edit[-1] or "")
            if size > 4 << 20:
                yield _rows(out, names, types)
                out, size = [], 0
        if out:
            yield _rows(out, names, types)

    return ordered.mapInArrow(task, f"conv_id {field.dataType.simpleString()}, {_EDITS}")


LEGAL = {"su", "ua", "au"}
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def summarise(edits: DataFrame, ordered: bool = False) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one a conversation of ``edits``.

    ``ordered`` says that the rows stand as :func:`repair` returned them; otherwise they are sorted first.  Every conversation is one
    stream: a digest over its texts has no parts that could be put together.  What is held is its edits' letters.
    """
    if not ordered:
        edits = edits.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    field = edits.schema["conv_id"]
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    types = [to_arrow_type(field.dataType), *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]

    def task(batches):
        out, sums = [], None
        for batch in slices(batches, "text"):
            for conv, place, edit, fault, turn, was, role, text in zip(*[batch.column(c).to_pylist() for c in edits_columns]):
                if place == 0:
                    if sums is not None:
                        out.append(sums.row())
                    sums = _Sums(conv)
                    if len(out) == 5_000:
                        yield _rows(out, names, types)
                        out = []
                sums.add(edit, fault, turn, was, role, text)
        if sums is not None:
            out.append(sums.row())
        if out:
            yield _rows(out, names, types)

    edits_columns = ["conv_id", "place", "edit", "fault", "turn", "was", "role", "text"]
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return edits.mapInArrow(task, f"conv_id {field.dataType.simpleString()}, {counts}, audit string, repaired_sha256 string")


class _Sums:
    """What is counted of one conversation while its edits pass."""

    def __init__(self, conv):
        self.conv, self.letters, self.digest, self.lines = conv, [], hashlib.sha256(), 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.cost = self.illegal = self.turns = 0
        self.low = self.turn = self.initial = None

    def add(self, edit, fault, turn, was, role, text):
        self.letters.append(edit)
        if fault:
            self.faults[fault] += 1
        self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit]
        if role is not None:
            self.cost += CUT_OFF if fault == "truncated" else 0
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1
        if edit == "I":
            return
        if self.initial is not None and self.initial + was[:1] not in LEGAL:
            self.illegal += 1
        self.initial = was[:1]
        if turn is not None and turn != self.turn:  # turns come in order
            self.low = turn if self.low is None else self.low
            self.turn, self.turns = turn, self.turns + 1

    def row(self):
        gaps = 0 if self.turn is None else self.turn - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.digest.hexdigest())
