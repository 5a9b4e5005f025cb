import collections
import hashlib
import random
import re

import pytest

from tapewire.llm import decontaminate, langid, lm_scoring, passages, quality
from tapewire.llm.queries import QUERIES
from tests.llm.frames import no_docs, odd_docs, table

SF = "/root/testdata/sf0.001"


def figures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_base_rule(spark):
    docs = odd_docs(spark).unionByName(table(spark, "documents"), allowMissingColumns=True)
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(figures(r.text))
    rows = quality.verdicts(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got in texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.verdicts(no_docs(spark)).count() == 0


def test_quality_fence_adapts_to_the_group_and_keeps_columns(spark):
    fill = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{fill} tail{i}", "en", "a") for i in range(300)] + [(1000, fill + " ###$$$%%%|||<<<" * 20, "en", "a"), (1001, fill, "xx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {i for i, *_ in rows} - {1000}
    # a group where symbols are the rule keeps them
    noisy = spark.createDataFrame([(i, fill + " ###" * (20 + i % 7), "en", "code") for i in range(300)], docs.schema)
    assert quality.keep_good(noisy).count() == 300
    assert quality.keep_good(odd_docs(spark)).columns == odd_docs(spark).columns


def test_quality_fence_follows_the_spread_of_the_group(spark):
    """Each odd document lies inside quartile +- (4 characters, 0.10, 0.30, 0.30)."""
    plain = [f"word{i}" for i in range(60)]
    lines = [" ".join(plain[i : i + 5]) for i in range(0, 60, 5)]
    odd = {
        "long": " ".join(f"longr{i:03}" for i in range(60)),
        "symbols": " ".join([f"wor#{i}" for i in range(18)] + plain[18:]),
        "lines": "\n".join(lines + lines[:4]),
    }
    normal = [(f"{lang}{i}", " ".join([*plain, f"tail{i}"]), lang) for lang in ("en", "de") for i in range(300)]
    rows = normal + [(k, t, "en") for k, t in odd.items()]
    # where symbols or long words are the rule, the same documents stay
    rows += [(f"code{i}", " ".join([f"wor#{k}" for k in range(8 + i % 20)] + plain[8 + i % 20 :]), "code") for i in range(300)] + [("code", odd["symbols"], "code")]
    rows += [(f"wide{i}", " ".join(f"{'x' * (i % 4)}word{k}" for k in range(60)), "wide") for i in range(300)] + [("wide", odd["long"], "wide")]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id string, text string, lang string, source string")
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {r[0] for r in rows} - set(odd)


def test_decontamination_equals_brute_force(spark):
    item = " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "short  Answer"), (3, None), (4, "..."), (10, item), (None, "zeta eta")], "item_id long, text string")
    texts = [None, "", f"x {item.upper()}, y", "a short... answer! " + "pad " * 50, "short answer", "b0 b1 b2", "é" + " zeta-eta", " ".join(f"b{i}" for i in range(12))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    patterns = {}
    for r in bench.collect():
        w = word.findall(low(r.text))
        for i in range(max(1, len(w) - 12) if w else 0):
            patterns.setdefault(tuple(w[i : i + 13]), set()).add("" if r.item_id is None else str(r.item_id))
    for size in (1 << 20, 20):  # one block, then several
        for r in decontaminate.contamination(docs, bench, block_bytes=size).collect():
            w = word.findall(low(texts[r.doc_id]))
            hits, items = set(), set()
            for p, own in patterns.items():
                for i in range(len(w) - len(p) + 1):
                    if tuple(w[i : i + len(p)]) == p:
                        hits |= set(range(i, i + len(p)))
                        items |= own
            assert (r.n_words, r.n_hit, list(r["items"])) == (len(w), len(hits), sorted(items))
            assert r.contaminated == (len(hits) > 0 and 20 * len(hits) >= len(w))
            covered = [x for a, b in r.spans for x in word.findall(low(texts[r.doc_id][a:b]))]
            assert covered == [w[i] for i in sorted(hits)]
    odd = odd_docs(spark)
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.contamination(no_docs(spark), bench).count() == 0


def test_passages_equal_a_sequential_pass(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    first, expected = {}, {}
    for r in docs.orderBy("doc_id").collect():
        own = passages.units(r.text)
        flags = []
        for k, (*_, digest) in enumerate(own):
            flags.append(digest in first)
            first.setdefault(digest, (r.doc_id, k))
        spans, k = [], 0
        while k < len(own):
            j = k
            while j < len(own) and flags[j]:
                j += 1
            if j > k and sum(u[2] for u in own[k:j]) >= passages.MIN_WORDS:
                spans.append([own[k][0], own[j][0] if j < len(own) else len(r.text)])
            k = max(j, k + 1)
        expected[r.doc_id] = spans
    rows = passages.dedupe(docs).collect()
    assert {r.doc_id: r["__cut"].spans for r in rows} == expected and any(expected.values())


def test_passages_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60)) + "."
    odd = odd_docs(spark)
    extra = spark.createDataFrame([(20, f"First here.\n{passage}\nend"), (21, f"Other start. {passage.upper()} Then more.")], "doc_id long, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    rows = passages.dedupe(docs).collect()
    assert len(rows) == docs.count() and passages.dedupe(docs).drop("__cut").columns == docs.columns
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[20][0].text == f"First here.\n{passage}\nend"
    assert by[21][0].text == "Other start. Then more."
    assert by[2][0].text is None and by[3][0].text == "" and by[1][0].text == by[1][1].text
    assert by[5][0].text == ""  # nothing but a repeat
    assert passages.dedupe(no_docs(spark)).count() == 0


def test_passages_inside_longer_lines(spark):
    """Passages of over 50 words without a sentence end, set into lines that go on before and behind them."""
    rng = random.Random(5)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    said = [" ".join(fresh(55)) for _ in range(40)]
    rows = [(i, " ".join([*fresh(30), p, *fresh(30)])) for i, p in enumerate(said)]
    rows += [(100 + i, " ".join([*fresh(1 + i), p.upper(), *fresh(40 - i)])) for i, p in enumerate(said)]
    letters = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(120))
    rows += [(200, "".join(map(chr, range(0x5000, 0x5040))) + letters), (201, letters + "".join(map(chr, range(0x6000, 0x6040))))]
    rows += [(300, "一二三四五六七八"), (301, "一二三四五六七八")]  # four words' length
    texts = dict(rows)
    for r in passages.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = r["__cut"].spans
        if not 100 <= r.doc_id < 300 or r.doc_id == 200:
            assert r.text == texts[r.doc_id] and not spans
            continue
        a, b = spans[0]
        assert len(spans) == 1
        if r.doc_id == 201:
            assert texts[201][a:b] in letters and b - a >= 80
        else:
            assert texts[r.doc_id][a:b].strip().lower() in said[r.doc_id - 100] and len(texts[r.doc_id][a:b].split()) >= passages.MIN_WORDS


def test_language_id(spark):
    rows = QUERIES["op10_language_id"](spark, SF).join(table(spark, "documents"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) > 0
    assert all(0 <= r.score <= 1 for r in rows)
    docs = odd_docs(spark)
    found = langid.identify(docs, langid.profiles(docs)).collect()
    assert len(found) == docs.count()
    assert {(r.lang_pred, r.score) for r in found if r.doc_id in (2, 3, 4)} == {("und", 0.0)}
    assert {r.lang_pred for r in langid.identify(docs, langid.profiles(no_docs(spark))).collect()} == {"und"}
    assert langid.identify(no_docs(spark), langid.profiles(docs)).count() == 0


def test_profiles_rank_by_count(spark):
    learned = {(r.lang, r.gram): r["rank"] for r in langid.profiles(spark.createDataFrame([("aab", "x"), (None, "x"), ("zz", None)], "text string, lang string")).collect()}
    keys, n = langid.counted(langid.grams("aab"))
    order = sorted(zip(keys.tolist(), n.tolist()), key=lambda p: (-p[1], p[0]))
    assert [learned["x", k] for k, _ in order] == list(range(len(order)))


def test_lm_scores(spark):
    import math

    rows = {r.doc_id: r for r in QUERIES["op1_lm_score"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts.items()}
    counts = collections.Counter(w for i, ws in tokens.items() if not rows[i].held_out for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "DICTIONARY", 50)  # most words take the join
    docs = odd_docs(spark)
    rows = lm_scoring.score(docs, docs).collect()
    assert len(rows) == docs.count() and all(r.score <= 0 and r.n_known == r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert lm_scoring.score(no_docs(spark), docs).count() == 0
    assert all(r.n_known == 0 and abs(r.base_score) < 1e-9 for r in lm_scoring.score(docs, no_docs(spark)).collect())


def test_gru_gradient():
    import numpy as np

    from tapewire.llm import gru

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, (5, 3)), rng.integers(0, 9, (5, 3))
    fresh = np.ones((5, 3, 1), np.float32)
    fresh[2, 1] = 0
    h = rng.normal(size=(3, gru.HIDDEN)).astype(np.float32)
    model = gru.Gru(np.array([9, 8, 7, 5, 4, 3, 2, 1.5]), 3.0, 12)
    start = model.flat.copy()

    def loss(flat):
        model.flat[:] = flat
        return -model.log_likelihood(x, y, fresh, h)[0].mean()

    seen = np.zeros_like(start)
    model.flat[:] = start
    model.step(x, y, fresh, np.ones((5, 3), np.float32), h, seen)
    grad = np.sqrt(seen)  # one step: the absolute gradient
    for i in rng.choice(len(start), 60, replace=False):
        moved = start.copy()
        moved[i] += 1e-2
        up = loss(moved)
        moved[i] -= 2e-2
        assert abs(abs(up - loss(moved)) / 2e-2 - grad[i]) < 2e-3


def test_decontamination_query_digest(spark):
    for r in QUERIES["op6_decontaminate"](spark, SF).where("n_items = 0").take(3):
        assert r.items_sha256 == hashlib.sha256(b"").hexdigest()
