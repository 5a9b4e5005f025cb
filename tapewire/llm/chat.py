"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and
only its text is trainable.  What follows the last assistant turn is kept in an example
without a target, so that no turn is lost.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the template's own marks first, then marks of other common templates
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TARGET = "assistant"

# A control string inside a text gets a backslash behind its first character; a text that
# already has backslashes there gets one more, so that taking one off restores it.
_IN = re.compile("|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in CONTROL))
_OUT = re.compile("|".join(rf"({re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    return _IN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _OUT.sub(lambda m: m[0][:-1], text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """One turn as formatted, and where its escaped text begins and ends in it.

    Backslashes and line ends of a role are escaped too: the role ends at the first line end.
    """
    head = OPEN + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def _role(head: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a formatted example."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        stop = formatted.index(CLOSE + "\n", line + 1)
        out.append((_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : stop])))
        at = stop + len(CLOSE) + 1
    return out


def expand(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = TARGET
) -> DataFrame:
    """Rows (conv_id, example, target_turn, formatted, loss_start, loss_end), ``example`` counting from 0 inside a conversation.

    ``formatted`` holds all turns up to the target and ends with it; [loss_start, loss_end) are the code
    points of the target's escaped text.  Turns after the last target make a last example with no target: its ``target_turn`` and
    mask are NULL.  NULL roles and texts are empty, rows without a conversation id are one conversation,
    repeated and tied turns are turns of their own, ordered by turn (NULL first), role and text.

    A conversation is grouped into one row because its last example holds all of it anyway; examples are
    made one at a time.
    """
    turn = F.struct(
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    grouped = conversations.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    kind = grouped.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, example long, target_turn long, formatted string, loss_start long, loss_end long"

    def examples(turns):
        so_far, size, n, open_turns = [], 0, 0, False
        for t in turns:
            text, start, end = turn_text(t["role"], t["text"])
            so_far.append(text)
            open_turns = True
            if t["role"] == target:
                yield n, t["turn"], "".join(so_far), size + start, size + end
                n, open_turns = n + 1, False
            size += len(text)
        if open_turns:
            yield n, None, "".join(so_far), None, None

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["example", "target_turn", "formatted", "loss_start", "loss_end"]

    def task(batches):
        for batch in batches:
            convs, rows, size = [], [], 0

            def flush(convs, rows):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                return pa.RecordBatch.from_arrays([pa.array(convs, batch.schema.field("conv_id").type), *columns], names=["conv_id", *names])

            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns")):
                for row in examples(turns.as_py()):
                    convs.append(conv)
                    rows.append(row)
                    size += len(row[2])
                    if size > 4 << 20:
                        yield flush(convs, rows)
                        convs, rows, size = [], [], 0
            if rows:
                yield flush(convs, rows)

    return grouped.mapInArrow(task, schema)


def read_back(examples: DataFrame) -> DataFrame:
    """Rows (conv_id, example, turns, loss, formatted_chars) read from formatted examples.

    ``turns`` is NULL but for the last example of a conversation, which holds every turn; ``loss``
    is the unescaped text under the mask, empty without a target.
    """
    last = examples.groupBy("conv_id").agg(F.max("example").alias("__last"))
    marked = examples.join(last.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv"))).select(
        "conv_id", "example", "formatted", "loss_start", "loss_end", (F.col("example") == F.col("__last")).alias("whole")
    )
    kind = marked.schema["conv_id"].dataType.simpleString()
    turns_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def task(batches):
        for batch in batches:
            turns, loss, size = [], [], []
            for text, a, b, whole in zip(*[batch.column(c).to_pylist() for c in ("formatted", "loss_start", "loss_end", "whole")]):
                turns.append([{"role": r, "text": t} for r, t in read_turns(text)] if whole else None)
                loss.append("" if a is None else unescape(text[a:b]))
                size.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("example"), pa.array(turns, turns_type), pa.array(loss, pa.string()), pa.array(size, pa.int64())],
                names=["conv_id", "example", "turns", "loss", "formatted_chars"],
            )

    return marked.mapInArrow(task, f"conv_id {kind}, example long, turns array<struct<role string, text string>>, loss string, formatted_chars long".replace("role string", "role: string").replace("text string", "text: string"))
