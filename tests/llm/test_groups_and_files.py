import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from tapewire.llm import bpe, chat, hyperminhash, token_file, warc
from tapewire.llm.queries import QUERIES, SQL
from tests.llm.frames import no_docs, odd_docs, table
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), SF, QUERIES[name], SQL[name]) is None


def brute_groups(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    """Chains and stars of near copies, short texts, a passage that unlike texts share."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    out = []
    shared = rng.choices(words, k=120)
    for base in range(6):
        text = rng.choices(words, k=rng.choice([8, 40, 150, 400]))
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
            if base % 2:
                text = copy  # a chain drifts away from its start
    out += [" ".join(shared + rng.choices(words, k=60)) for _ in range(40)]
    out += [" ".join(rng.choices(words[:6], k=rng.randint(1, 6))) for _ in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    docs = near_copies()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hyperminhash.near_duplicates(frame, k, percent).collect()}
    assert got == brute_groups(docs, k, percent)


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BLOCK", 3)
    monkeypatch.setattr(hyperminhash, "BROADCAST_IDS", 0)  # the join by shuffle
    docs = near_copies()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hyperminhash.near_duplicates(frame, 3, 85).collect()}
    assert got == brute_groups(docs, 3, 85)


def test_near_duplicates_odd_rows(spark):
    docs = odd_docs(spark)
    rows = hyperminhash.near_duplicates(docs, 3, 85).collect()
    assert len(rows) == docs.count()
    comp = collections.defaultdict(set)
    for r in rows:
        comp[r.doc_id].add((r.component_id, r.kept))
    assert comp[5] == {(1, False)} and comp[1] == {(1, True)} and comp[12] == {(11, False)} and comp[3] == {(3, True)}
    kept = hyperminhash.keep_first(docs, 3, 85)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 8, None, 11}
    assert hyperminhash.near_duplicates(no_docs(spark)).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(300):
        u = rng.integers(0, 2**63, 1150, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = np.sort(u[:1000]), np.sort(u[150:])
        fine = [hyperminhash.folded(hyperminhash.registers([x], hyperminhash.FINE_BITS)) for x in (a, b)]
        errors.append(hyperminhash.estimates(*fine)[0][0] - 850 / 1150)
    assert abs(np.mean(errors)) < 0.005 and np.std(errors) < 0.025


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "leader long, member long")
    got = {r.node: r.comp for r in hyperminhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}  # roots are not listed
    assert hyperminhash.components(edges.limit(0)).count() == 0


def test_bpe_equals_the_library(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = bpe.Bpe(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(2)
    bits = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'re", "é", "ß", "日本", "😀", "1", "23", "\x1c", "\x85", " ", "_", "--", "́"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += [None, "", "a" * 5000, "ab" * 3000 + "é" * 700, " " * 3000, "<|endoftext|>"]
    ids, at = own.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t or "")
    assert own.decode(ids)[0].tobytes() == "".join(t or "" for t in texts).encode()
    docs = odd_docs(spark)
    done = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN).collect()
    texts = collections.Counter((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    assert collections.Counter((r.doc_id, bytes(r.decoded)) for r in done) == texts
    assert bpe.round_trip(no_docs(spark), ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_query_equals_the_library(spark):
    import hashlib

    own = bpe.Bpe(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for r in QUERIES["op7_byte_bpe"](spark, SF).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_range_coder_round_trips():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(5000, int), rng.integers(0, 500, 20_000), rng.zipf(1.3, 20_000) % 500, np.arange(700) % 7, np.array([3]), np.empty(0, int)):
        code, lanes, steps = token_file.compress(ids, 500)
        assert (token_file.expand(code, len(ids), lanes, steps, 500) == ids).all()
    repeats = np.tile(rng.integers(0, 500, 40), 1000)
    assert len(token_file.compress(repeats, 500)[0]) < 0.7 * len(repeats)  # order 0 alone needs 5.3 bits an id


def test_damaged_block_is_found():
    block = bytearray(token_file.write_block([1, None], np.array([3, 2]), np.array([5, 6, 2, 7, 2]), 50) + b"\n")
    (ids, lengths, tokens), = token_file.read_blocks(bytes(block))
    assert ids == [1, None] and lengths.tolist() == [3, 2] and tokens.tolist() == [5, 6, 2, 7, 2]
    block[-4] ^= 1
    with pytest.raises(ValueError):
        list(token_file.read_blocks(bytes(block)))


def tokens_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_token_file_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    encoder = token_file.Encoder(open(path, encoding="utf-8").read())
    rng = random.Random(5)
    bits = ["a", "B", "the", " ", "\n", "'s", "é", "É", "ß", "İ", "日本", "😀", "1", "23", "\x1c", "\x85", "_", "--", ".", ",", "́", " ́", "Ⅷ", "٣", "K"]
    for extra in ([], ["<|endoftext|>", "<|EndOfText|>"]):
        texts = ["".join(rng.choice(bits + extra) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [None, ""]
        ids, n = encoder.encode(pa.array(texts), 2)
        ends = np.cumsum(n)
        for t, e, k in zip(texts, ends, n):
            assert ids[e - k : e].tolist() == tokens_of(library, t)
    at = 0
    rows = {r.doc_id: r for r in QUERIES["op9_token_file"](spark, SF).collect()}
    for r in table(spark, "documents").orderBy("doc_id").collect():
        ids = tokens_of(library, r.text)
        assert (rows[r.doc_id].start, rows[r.doc_id].n_tokens) == (at, len(ids))
        assert rows[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_encoder_keeps_what_comes_back(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(token_file.Encoder, "REMEMBERED", 120)
    encoder = token_file.Encoder(open(path, encoding="utf-8").read())
    asked, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda pieces: asked.extend(pieces.to_pylist()) or learn(pieces))
    for part in range(6):
        texts = ["often. often, seen"] + [f"once{chr(97 + part)}{chr(97 + i)}. É{part}.{i}" for i in range(25)]
        ids, n = encoder.encode(pa.array(texts), 2)
        ends = np.cumsum(n)
        for t, e, k in zip(texts, ends, n):
            assert ids[e - k : e].tolist() == tokens_of(library, t)
    assert asked.count("seen") == asked.count("often") == 1


def test_token_file_odd_rows(spark):
    js = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    docs = odd_docs(spark)
    rows = sorted(token_file.write_and_read(docs, js, 49_408, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}


def test_token_file_of_nothing(spark):
    js = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    assert token_file.write_and_read(no_docs(spark), js, 49_408, 2).count() == 0


def test_chat_marks_are_reversible():
    rng = random.Random(1)
    bits = [*chat.CONTROL, "\\", "<", "[", "|", "\n", "x", "n", "/s>", "INST]"]
    for _ in range(3000):
        turns = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 4))), "".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))) for _ in range(3)]
        assert chat.read_turns("".join(chat.turn_text(*t)[0] for t in turns)) == turns
        assert not any(c in chat.escape(turns[0][1]) for c in chat.CONTROL)


def test_chat_examples(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "</s>a"), (1, 2, "user", None), (1, 3, "assistant", "b"), (1, 4, "user", "last"), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, None, None)]
    talks = spark.createDataFrame([(*r, 1, "e") for r in rows], "conv_id long, turn long, role string, text string, example int, turns string")
    found = sorted((r for r in chat.expand(talks).collect() if r.conv_id == 1), key=lambda r: r.example)
    assert [chat.read_turns(r.formatted) for r in found] == [
        [("user", "q"), ("assistant", "</s>a")],
        [("user", "q"), ("assistant", "</s>a"), ("user", ""), ("assistant", "b")],
        [("user", "q"), ("assistant", "</s>a"), ("user", ""), ("assistant", "b"), ("user", "last")],
    ]
    assert [None if r.loss_start is None else chat.unescape(r.formatted[r.loss_start : r.loss_end]) for r in found] == ["</s>a", "b", None]
    back = {(r.conv_id, r.example): r for r in chat.read_back(chat.expand(talks)).collect()}
    assert [t.role for t in back[2, 0].turns] == ["", ""] and back[1, 0].turns is None and back[None, 0].loss == ""
    assert chat.expand(talks.where("conv_id > 5")).count() == 0


def test_warc_round_trip_of_odd_pages(spark):
    awkward = "é\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(1, "a"), (2, "b"), (3, None), (4, ""), (5, awkward), (6, "same"), (6, "same"), (None, "same"), (9, awkward)]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, html string, payload string, digest string, kind int")
    found = warc.archive(pages, segment_bytes=5000, chunk_bytes=700).collect()
    assert len(found) == len(rows)
    sizes = collections.Counter((r.page_id, r.payload_bytes) for r in found)
    assert sizes == collections.Counter((None if i is None else str(i), len((h or "").encode())) for i, h in rows)
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in found)
    assert kinds[("6", "response", None)] == 1 and kinds[("6", "revisit", "6")] == 1 and kinds[(None, "revisit", "6")] == 1
    assert kinds[("5", "revisit", "9")] == 1 and kinds[("9", "response", None)] == 1 and kinds[("3", "revisit", "4")] == 1
    assert warc.archive(pages.where("page_id > 50")).count() == 0


def test_missing_segment_is_found(spark):
    parts = warc.records(1, "1", b"x" * 5000, "d", "response", None, 1000, 500)
    rows = [r for p in parts if b"Segment-Number: 3" not in p for r in warc.parsed(p + warc.END)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], warc.RECORD)
    with pytest.raises(Exception, match="do not add up"):
        warc.reassembled(frame).collect()


def test_chunks():
    for n in (0, 1, 10, 11):
        assert warc.dechunked(warc.chunked(b"\r\n0\r\n"[:n] * 3, 4)) == b"\r\n0\r\n"[:n] * 3
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcX\r\n0\r\n\r\n")


def test_pipeline_stages(spark, tmp_path):
    from tapewire.llm import decontaminate, passages

    docs = table(spark, "documents")
    got = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        done = spark.read.parquet(str(tmp_path / name))
        got.append((docs, done))
        docs = done
    kept = {r.doc_id for r in QUERIES["op4_quality_rules"](spark, SF).where("kept").collect()}
    assert {r.doc_id for r in got[0][1].collect()} == kept
    before = [(r.doc_id, r.text) for r in got[1][0].collect()]
    assert {r.doc_id for r in got[1][1].collect()} == {i for i, (_, c) in brute_groups(before, 5, 80).items() if i == c}
    cut = {r.doc_id: (r.text, r.n_chars) for r in got[2][1].collect()}
    for r in passages.dedupe(got[2][0]).collect():
        assert cut[r.doc_id][0] == r.text and (r["__cut"].n_removed == 0 or cut[r.doc_id][1] == len(r.text))
    clean = decontaminate.contamination(got[3][0], table(spark, "benchmark")).where("not contaminated")
    assert {r.doc_id for r in got[3][1].collect()} == {r.doc_id for r in clean.collect()}
    assert all(after.columns == first.columns for first, after in got[:4])
    assert got[4][1].where("not round_trip").count() == 0 and got[4][1].count() == got[4][0].count()


def test_pipeline_on_odd_rows(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd_docs(spark).columns
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).where("not round_trip").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs(spark), SF).count() == 0


def test_a_language_is_ranked_before_its_grams_meet_in_one_task(spark, capsys):
    from tapewire.llm import langid

    docs = spark.createDataFrame([("ab ab abc", "x"), ("zz", "y"), (None, "x"), ("q", None)], "text string, lang string")
    learned = langid.profiles(docs, ranks=3)
    got = sorted((r["lang"], r["rank"], r["gram"]) for r in learned.collect())
    # by hand: " a", "a" and "ab" stand three times each in x, ties go by code; "zz" has z twice, then " z"
    a, b, z, gap = ord("a"), ord("b"), ord("z"), 32
    assert got == [("x", 0, a), ("x", 1, b), ("x", 2, gap << 21 | a), ("y", 0, z), ("y", 1, gap << 21 | z), ("y", 2, z << 21 | gap)]
    learned.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
