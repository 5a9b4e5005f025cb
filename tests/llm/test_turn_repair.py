import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tapewire.llm import queries, turn_repair
from tapewire.llm.queries import QUERIES
from tests.llm.frames import table
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, place int, edit string, part int, n long, digest string"
EMPTY = hashlib.sha256(b"").hexdigest()


def cheapest(rows):
    """(cost, audit, repaired) by Dijkstra over (cost, audit so far): the first accepted one is cheapest and least in ASCII."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, said = heapq.heappop(heap)
        if (i, roles[-1:]) in done and i < len(rows):
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, said
        done.add((i, roles[-1:]))

        def go(extra, letter, step, role=None, text=""):
            line = said if role is None else (*said, f"{role}:{text}")
            new = roles if role is None else roles + role[:1]
            if role is None or (role and re.fullmatch("s?(ua)*u?", new)):
                heapq.heappush(heap, (cost + extra, audit + letter, i + step, new, line))

        go(2, "I", 0, "user")
        go(2, "I", 0, "assistant")
        if i < len(rows):
            role, text, fault = rows[i]
            go(3, "D", 1)
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                go(cut, "K", 1, role, text)
                go(2 + cut, "R", 1, "user", text)
                go(2 + cut, "R", 1, "assistant", text)
    raise AssertionError("no way")


def brute(talk):
    """One conversation's rows (turn, role, text) in order -> the contract's columns."""
    talk = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in talk]
    seen, rows, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
    for _, role, text in talk:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        count[fault] += 1
        rows.append((role, text, fault))
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    turns = [t for t, _, _ in talk if t is not None]
    cost, audit, said = cheapest(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def in_order(rows):
    """Turns as repair() orders them: NULL first, ties by the digest of role and text."""
    blank = lambda v: " " if v is None else v
    key = lambda r: hashlib.sha256(f"{len(blank(r[1]))}:{blank(r[1])}{blank(r[2])}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key(r)))


def odd_talks(seed, n=60, longest=14):
    rng = random.Random(seed)
    roles = ["user", "assistant", "assistant", "user", "system", None, "", "tool", "u", "User"]
    texts = ["Yes.", "No!", "cut", " ", "", None, "\t\x0b\n", "why? ", "é?\n", "ok . x", "\x1f", "Yes."]
    out = []
    for c in range(n):
        size = rng.randint(1, longest)
        for t in range(size):
            turn = rng.choice([t, t, t, t + 3, None, t // 2])
            row = (None if c == 7 else c, turn, rng.choice(roles[: rng.choice([4, 10])]), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}.")
            out += [row] * rng.choice([1, 1, 1, 2])
    return out


def expected(rows):
    talks = {}
    for c, *rest in rows:
        talks.setdefault(c, []).append(tuple(rest))
    return {c: brute(in_order(t)) for c, t in talks.items()}


def got(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


def wide(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "K", 2, 5, "x") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = odd_talks(seed)
    assert got(turn_repair.summarise(turn_repair.repair(wide(spark, rows)))) == expected(rows)


@pytest.mark.parametrize("parts", [2, 7, 40])
def test_a_conversation_cut_into_runs(spark, monkeypatch, parts):
    """One conversation holds most rows; the runs of all partitions are chained."""
    monkeypatch.setattr(turn_repair, "splits", lambda df: parts)
    rng = random.Random(parts)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Yes.", f"a{t}.", f"b{t}", f"c{t}!", " "])) for t in range(700)]
    rows += [(c, 0, "user", "Hi.") for c in (0, 2, 3)] + odd_talks(parts, 5)
    rows = [r for r in rows if r[0] is not None]
    frame = wide(spark, rows)
    chained = turn_repair._chain(turn_repair._bundles(turn_repair._turns(frame, "conv_id", "turn", "role", "text")))
    assert len([k for k in chained if k[1] == 1]) > 1
    assert got(turn_repair.summarise(turn_repair.repair(frame), ordered=True)) == expected(rows)


def test_edits_say_what_was_done(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Cut."), (1, 1, "user", "Cut."), (1, 2, "assistant", ""), (1, 3, "user", "Bye"), (1, 5, "assistant", "Bye.")]
    edits = [(r.place, r.edit, r.fault, r.role, r.text) for r in turn_repair.repair(wide(spark, rows)).orderBy("place").collect()]
    assert edits == [
        (0, "K", None, "user", "Hi."),
        (1, "R", None, "assistant", "Cut."),
        (2, "D", "duplicate", None, None),
        (3, "D", "blank", None, None),
        (4, "K", "truncated", "user", "Bye"),
        (5, "K", None, "assistant", "Bye."),
    ]


def test_empty_table_and_one_very_long_text(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", " " * 200_000)]
    frame = wide(spark, rows)
    assert turn_repair.summarise(turn_repair.repair(frame.where("conv_id > 5"))).count() == 0
    assert got(turn_repair.summarise(turn_repair.repair(frame))) == expected(rows)


def damage(conv, turn, role, text):
    """Rows after damage, by the contract's words."""
    blank = lambda v: " " if v is None else str(v)
    kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
    role, text = blank(role), blank(text)
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def after_damage(rows):
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).extend(damage(c, t, r, x))
    return {c: brute(in_order(t)) if t else (0, 0, 0, 0, 0, 0, "", EMPTY) for c, t in talks.items()}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_turn_repair"](spark, SF)) == after_damage(rows)


def test_query_on_awkward_rows(spark, tmp_path):
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)  # all of its rows are dropped
    rows = [*odd_talks(9, 200, 3), (gone, 0, "user", "Hi.")]
    wide(spark, rows).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    want = after_damage(rows)
    assert got(QUERIES["op12_turn_repair"](spark, str(tmp_path))) == want
    assert want[gone] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert queries.damaged(wide(spark, rows).where("conv_id > 9999")).count() == 0


def test_query_equals_sql_at_the_next_size(spark):
    sf = SF.replace("0.001", "0.01")
    assert compare(spark, duck(sf), sf, QUERIES["op12_turn_repair"], queries.SQL["op12_turn_repair"]) is None
