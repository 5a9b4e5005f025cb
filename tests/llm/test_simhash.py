import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tapewire.llm import simhash
from tapewire.llm.queries import QUERIES
from tests.llm.frames import no_docs, odd_docs, table

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def brute_print(text):
    """Votes one term at a time, in whole numbers."""
    words = []
    for w in (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split():
        words += [w[i : i + 8] for i in range(0, len(w), 8)] if len(w) > 32 else [w]
    votes, before = [0] * 256, 0
    for w in words:
        h = xxhash.xxh64_intdigest(w)
        term = mix((mix((before + GOLDEN) & M) + h) & M)
        lanes = b"".join(mix((term + GOLDEN * (k + 1)) & M).to_bytes(8, "little") for k in range(4))
        for i in range(256):
            votes[i] += 1 if lanes[i // 8] >> (7 - i % 8) & 1 else -1
        before = h
    return int("".join("1" if v > 0 else "0" for v in votes), 2).to_bytes(32, "big").hex()


def like(a, b):
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 256


def brute_beside(rows):
    """(doc_id, text) -> the contract's columns, rows equal in id and text once."""
    key = lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42))))
    docs = sorted({(i, t or "") for i, t in rows}, key=key, reverse=True)
    out = []
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, new = brute_print(t), brute_print(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, new, like(own, new), like(own, brute_print(after))))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:4]))


def got(frame):
    return order([tuple(r)[:7] for r in frame.collect()])


def test_many_words_of_few_kinds():
    texts = ["a b " * 5000, None, "", "x", "Der  Über\tÜber", "日本語" * 40, "q" * 33]
    assert [r.tobytes().hex() for r in simhash.signatures(pa.array(texts))] == [brute_print(t) for t in texts]


@pytest.mark.parametrize("blocks", [1, 5])
def test_beside_edited_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "splits", lambda df: blocks)
    docs = odd_docs(spark).withColumnsRenamed({"block": "lead", "row": "block", "key": "tops"}).repartition(3)
    assert got(simhash.beside_edited(docs)) == order(brute_beside([(r.doc_id, r.text) for r in docs.collect()]))


def test_one_document_and_none(spark):
    docs = spark.createDataFrame([("b", "one two three four")], "doc_id string, text string")
    assert got(simhash.beside_edited(docs)) == brute_beside([tuple(r) for r in docs.collect()])
    assert simhash.beside_edited(no_docs(spark)).count() == 0 and simhash.with_links(simhash.fingerprints(no_docs(spark))).count() == 0


def test_a_row_delivered_many_times(spark):
    rows = [(5, "same text again")] * 300 + [(i, f"text {i}") for i in range(10)] + [(None, f"no id {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(6)
    assert got(simhash.beside_edited(docs)) == order(brute_beside(rows))


def near(rows, radius):
    """Documents within the radius of each document, all pairs of them."""
    out = {}
    for i, a in rows:
        same = [j for j, b in rows if a == b]
        out[i] = (min(same), sum((int(a, 16) ^ int(b, 16)).bit_count() <= radius for _, b in rows) - 1)
    return out


def clusters(n, seed=3):
    """Fingerprints, some a few bits apart, some equal, many of them alike in one block."""
    rng = random.Random(seed)
    out, base = [], rng.getrandbits(256)
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            base = rng.getrandbits(256)
        x = base
        if kind > 0.5:
            for bit in rng.sample(range(256), rng.choice([1, 3, 7, 8, 12])):
                x ^= 1 << bit
        if kind > 0.9:
            x = (x & ((1 << 224) - 1)) | 0xABCDEF01 << 224  # a common first block
        out.append((i, f"{x:064x}"))
    return out


@pytest.mark.parametrize("chunk,radius,blocks", [(2048, 7, 8), (3, 7, 8), (2048, 3, 4), (5, 1, 2), (2048, 15, 16)])
def test_tables_find_every_near_fingerprint(spark, monkeypatch, chunk, radius, blocks):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = clusters(500)
    frame = spark.createDataFrame(rows, "doc_id int, fingerprint string").repartition(5)
    found = {r.doc_id: (r.class_id, r.n_within) for r in simhash.with_links(frame, radius, blocks).collect()}
    assert found == near(rows, radius) and any(n > 3 for _, n in found.values())


def test_too_few_blocks(spark):
    with pytest.raises(ValueError):
        simhash.near_counts(spark.createDataFrame([], "doc_id int, fingerprint string"), 8, 8)


def test_query_on_whole_documents(spark):
    rows = QUERIES["op13_fingerprints"](spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]
    assert order([tuple(r)[:7] for r in rows]) == order(brute_beside(docs))
    assert {r.doc_id: (r.class_id, r.n_within) for r in rows} == near([(r.doc_id, r.fingerprint) for r in rows], 7)
    unlike = [r for r in rows if r.near_next < 0.9 and r.n_chars > 200]
    assert sum(r.near_edited > r.near_next for r in unlike) >= 0.98 * len(unlike)
