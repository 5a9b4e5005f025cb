"""Duplicate removal against a plain first-come-first-kept loop."""

import random

import pytest
from pyspark.sql import functions as F

from tapewire.operators import dedupe as dd


def frame(spark, titles, urls=None):
    rows = [(i, t, (urls or [f"https://x.com/{i}"] * len(titles))[i]) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "article_id long, title string, url string")


def ids(df):
    return sorted(r.article_id for r in df.collect())


def greedy(titles, floor=0.85, min_chars=10, short=False):
    kept, sets = [], []
    for i, t in enumerate(titles):
        words = set(t.lower().split())
        if len(t) < min_chars or not words:
            kept += [i] * short
            continue
        if all(2 * len(words & s) < floor * (len(words) + len(s)) - 1e-9 for s in sets):
            kept.append(i)
            sets.append(words)
    return kept


def near_copies(n, seed):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(60)]
    out = []
    base = [rng.sample(vocab, 12) for _ in range(6)]
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(12)] = rng.choice(vocab)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("bucket,seed", [(64, 1), (64, 2), (3, 3), (2, 4)])
def test_fuzzy_equals_the_sequential_pass(spark, bucket, seed):
    # small blocks cut every bucket
    titles = near_copies(90, seed)
    sets = dd.checkpointed(dd.word_sets(frame(spark, titles), 10, "article_id"))
    gone = {r.article_id for r in dd.near_duplicates(sets, 0.85, "article_id", bucket).collect()}
    reps = {r.article_id for r in sets.collect()}
    assert sorted(reps - gone) == greedy(titles)


def test_fuzzy_chain_keeps_the_far_end(spark):
    a = "one two three four five six seven eight nine ten"
    b = a.replace("one", "uno")
    c = b.replace("two", "dos").replace("three", "tres")
    assert ids(dd.dedupe_fuzzy(frame(spark, [a, b, c, "short", a.upper()]))) == greedy([a, b, c, "short", a], short=True)


def test_fuzzy_is_idempotent(spark):
    df = frame(spark, near_copies(60, 9))
    once = dd.dedupe_fuzzy(df)
    assert ids(dd.dedupe_fuzzy(once)) == ids(once)


def test_exact_keeps_first_and_all_blank_titles(spark):
    urls = ["https://A.com/x/?q=1", "http://a.com/x#f", "https://a.com/y", "u", "v"]
    df = frame(spark, ["Same", "same ", "Same", "", " "], urls)
    assert ids(dd.dedupe_exact(df)) == [0, 2, 3, 4]


def test_titles_are_deduplicated_at_every_size(spark):
    assert ids(dd.dedupe_titles(frame(spark, ["a", "A", "", "b", "c", " "]))) == [0, 2, 3, 4, 5]


def test_a_redelivered_id_stays_once(spark):
    rows = [(1, "Some long title", "u"), (1, "Some long title", "u"), (2, "some LONG title", "u"), (None, "other", "v"), (None, None, "w")]
    df = spark.createDataFrame(rows, "article_id long, title string, url string")
    for out in (dd.dedupe_exact(df), dd.dedupe_keys(df, ["title", "url"]).where("article_id = 1"), dd.dedupe_fuzzy(df)):
        assert out.where("article_id = 1").count() == 1
    assert dd.dedupe_exact(df).count() == 3 and dd.dedupe_fuzzy(df).count() == 3


@pytest.mark.parametrize("floor", [0.5, 0.7, 0.85])
def test_short_sets_meet_longer_ones(spark, floor):
    rng = random.Random(8)
    titles = [" ".join(rng.sample([f"word{i}" for i in range(9)], rng.randint(2, 6))) for _ in range(60)]
    assert ids(dd.dedupe_fuzzy(frame(spark, titles), floor)) == greedy(titles, floor)


def test_checkpoints_do_not_follow_the_number_of_titles(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(60)]
    made = []
    monkeypatch.setattr(dd, "checkpointed", lambda df, f=dd.checkpointed: made.append(1) or f(df))
    counts = []
    for n in (300, 3000):
        made.clear()
        dd.dedupe_fuzzy(frame(spark, [" ".join(rng.sample(vocab, 8)) for _ in range(n)])).count()
        counts.append(len(made))
    assert counts[1] <= counts[0] + 2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def greedy_edits(titles, floor, min_chars=10):
    kept = []
    for i, t in enumerate(titles):
        t = t.lower().strip()
        if len(t) < min_chars:
            kept.append((i, None))
        elif not any(
            k is not None and abs(len(k) - len(t)) <= (1 - floor) * max(len(k), len(t)) + 1e-9 and edits(k, t) <= int(max(len(k), len(t)) * (1 - floor) + 1e-9) for _, k in kept
        ):
            kept.append((i, t))
    return [i for i, _ in kept]


def mistyped(n, seed):
    """Titles of 5 to 90 characters with a few characters changed, put in or left out, many behind a common beginning."""
    rng = random.Random(seed)
    letters = "abcdefghij étü"
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    base = [("breaking news: " if i % 2 else "") + word(rng.choice([5, 9, 12, 20, 40, 75])) for i in range(max(3, n // 12))]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4, 7, 12])):
            at = rng.randrange(len(t) + 1)
            kind = rng.random()
            t[at : at + (kind < 0.66)] = [] if kind < 0.33 else [rng.choice(letters)]
        out.append("".join(t))
    return out


@pytest.mark.parametrize("n,floor,seed", [(1000, 0.85, 1), (200, 0.7, 2), (200, 0.95, 3)])
def test_similar_equals_brute_force_on_edit_ratio(spark, n, floor, seed):
    titles = mistyped(n, seed)
    assert ids(dd.dedupe_similar(frame(spark, titles), floor)) == greedy_edits(titles, floor)


def test_similar_in_small_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(dd.pairs_by_edits, "__defaults__", (2,))
    titles = mistyped(80, 5) + ["", "   ", "short"]
    df = frame(spark, titles)
    assert ids(dd.dedupe_similar(df.unionByName(df).repartition(3))) == sorted([*greedy_edits(titles, 0.85), *[i for i, t in enumerate(titles) if len(t.strip()) < 10]])
    assert dd.dedupe_similar(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        dd.dedupe_similar(df, 0.5)


def test_a_long_chain_is_settled_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = dd.checkpointed
    monkeypatch.setattr(dd, "checkpointed", lambda df: rounds.append(1) or real(df))
    n = 1000
    chain = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    assert ids(dd.greedy_dropped(chain, "article_id")) == list(range(1, n, 2))
    assert (len(rounds) - 1) / 2 <= 15


@pytest.mark.parametrize("seed", range(3))
def test_greedy_on_any_graph(spark, seed):
    rng = random.Random(seed)
    n = 120
    pairs = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(160)) if a < b} | {(i, i + 1) for i in range(30, 90)}
    dropped = set()
    for b in range(n):
        if any((a, b) in pairs and a not in dropped for a in range(b)):
            dropped.add(b)
    assert ids(dd.greedy_dropped(spark.createDataFrame(sorted(pairs), "a long, b long"), "article_id")) == sorted(dropped)


def test_letter_counts_bound_the_edits_and_grams_are_runs_of_characters(spark):
    titles = [t for t in mistyped(60, 7) if len(t) > 2] + ["é🙂x" * 40, "e" * 9_000]
    rows = spark.createDataFrame(list(enumerate(titles)), "id int, f string").withColumn("n", F.length("f"))
    words = [f"l{i}" for i in range(len(dd.LETTERS))]
    rows = rows.withColumns({w: dd._letters(F.col("f"), c) for w, c in zip(words, dd.LETTERS)})
    rows = rows.withColumn("counted", sum(dd._lane_sum(F.col(w)) for w in words).cast("int"))
    both = rows.alias("x").join(rows.alias("y"), F.col("x.id") < F.col("y.id"))
    both = both.select(dd._fewest_edits("x", "y", words).alias("least"), F.levenshtein("x.f", "y.f").alias("edits"))
    assert both.where("least > edits").count() == 0 and both.where("least > 0.5 * edits").count() > 0
    grams = rows.select("f", F.explode(dd._grams(F.split("f", ""), F.lit(3), F.lit(1))).alias("c")).select("f", "c.*")
    assert grams.where(F.expr("substring(f, place, 3) <> g")).count() == 0
    assert grams.count() == sum(len(t) - 2 for t in titles)


def test_titles_that_repeat_a_word_meet_once_in_a_stretch(spark, monkeypatch):
    """Before, each place of one met each place of the other; and one task made the runs of all titles."""
    made = []
    monkeypatch.setattr(dd, "checkpointed", lambda df, f=dd.checkpointed: made.append(f(df)) or made[-1])
    titles = [f"{w} " * 400 for w in ("thonx", "thony", "abcde")] + ["thonx " * 399 + "thonz "]
    pairs = dd.pairs_by_edits(spark.createDataFrame([(i, t.strip()) for i, t in enumerate(titles)], "article_id long, f string"), 0.85, "article_id")
    assert sorted(map(tuple, pairs.collect())) == [(0, 3)]
    assert made[1].count() < 400


def test_titles_are_dealt_as_texts_and_cut_behind_that(spark, monkeypatch):
    dealt, kind = [], type(spark.range(1))
    monkeypatch.setattr(kind, "repartition", lambda self, *args, real=kind.repartition: dealt.append(self.dtypes) or real(self, *args))
    titles = spark.createDataFrame([(1, "a title of some length"), (2, "a title of some lengths"), (3, "something else altogether")], "article_id long, f string")
    assert [tuple(r) for r in dd.pairs_by_edits(titles, 0.85, "article_id").collect()] == [(1, 2)]
    assert dealt and not any(t.startswith("array") for columns in dealt for _, t in columns)
