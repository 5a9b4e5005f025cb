import random

import numpy as np
import pytest

from tapewire.llm import passages


def sequential(rows):
    """doc_id -> numbers of units whose digest an earlier document has."""
    first, out = {}, {}
    for i, text in sorted(rows):
        own = passages.units(text)
        again = {k for k, u in enumerate(own) if u[3] in first}
        at = {}
        for k, u in enumerate(own):
            at.setdefault(u[3], k)
        if again:
            out[i] = {at[own[k][3]] for k in again}
        for u in own:
            first.setdefault(u[3], i)
    return out


def shared_lines(n=400):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    hot = "This line stands in every document of the hot group, word for word."
    return [(i, "\n".join([" ".join(word() for _ in range(15)), *([hot] if i % 3 else []), " ".join(f"s{(i // 7) % 9}{k}" for k in range(12))])) for i in range(n)]


@pytest.mark.parametrize("chunks", [1024, 0])
def test_repeats_with_and_without_a_filter(spark, monkeypatch, chunks):
    monkeypatch.setattr(passages, "MAX_CHUNKS", chunks)  # 0: nothing may be filtered
    rows = shared_lines()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r.doc_id: set(r.units) for r in passages.repeated_units(frame).collect()}
    assert found == sequential(rows)


def test_the_filter_never_says_no_wrongly(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 120_000, dtype=np.int64)
    counted = spark.createDataFrame([(int(k), 2 + 200 * (i < 5)) for i, k in enumerate(keys)], "key long, n long")
    seen = passages._seen(counted)
    assert len(seen.bits) == 3 and seen.maybe(keys).all() and set(seen.hot) == set(keys[:5].tolist())
    others = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 50_000, dtype=np.int64)
    assert seen.maybe(others).mean() < 0.02
    assert (seen.salt(keys[:5], np.full(5, 37)) == 5).all() and (seen.salt(others, np.full(len(others), 37)) == 0).all()
