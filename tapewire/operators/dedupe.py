"""Exact and near-duplicate removal.

An exact survivor is carried through a map-side combining aggregate as a whole row, so a group of
copies holding a third of the table costs one row per task, and a row delivered twice under one id stays once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.functions.text import normalize_url
from tapewire.operators.matching import padded
from tapewire.operators.scale import checkpointed, dim_join

BLOCK = 512  # sets of a bucket that are compared in one task


def folded_title() -> Column:
    return F.lower(F.trim(F.coalesce(F.col("title"), F.lit(""))))


def _keep_first(df: DataFrame, keys: dict[str, Column], key: str) -> DataFrame:
    """The row of the least id per key; a NULL id comes last."""
    rows = df.select(*[c.alias(n) for n, c in keys.items()], F.struct(*df.columns).alias("_row"))
    order = F.struct(F.col(f"_row.{key}").isNull(), F.col(f"_row.{key}"))
    return rows.groupBy(*keys).agg(F.min_by("_row", order).alias("_row")).select("_row.*")


def _alone(df: DataFrame, key: str) -> Column:
    """Tells rows with a blank title apart: by id, without one by their contents."""
    plain = [c for c, t in df.dtypes if not t.startswith("map")]
    own = F.coalesce(F.col(key).cast("string"), F.xxhash64(*plain).cast("string"))
    return F.when(folded_title() == "", own)


def dedupe_exact(df: DataFrame, key: str = "article_id") -> DataFrame:
    """First article per (normalised url, whole lower-case title); articles with blank titles are all kept."""
    url = F.coalesce(normalize_url(F.col("url")), F.lit(""))
    return _keep_first(df, {"_url": url, "_title": folded_title(), "_alone": _alone(df, key)}, key)


def dedupe_keys(df: DataFrame, keys: list[str], key: str = "article_id") -> DataFrame:
    """First row per plain key columns."""
    return _keep_first(df, {f"_k{i}": F.col(c) for i, c in enumerate(keys)}, key)


def dedupe_titles(df: DataFrame, key: str = "article_id") -> DataFrame:
    """First article per whole lower-case title, at every size; articles with blank titles are all kept."""
    return _keep_first(df, {"_title": folded_title(), "_alone": _alone(df, key)}, key)


# ---- near duplicates -------------------------------------------------------------------------


def word_sets(df: DataFrame, min_chars: int, key: str) -> DataFrame:
    """(key, words, n): the distinct words of each distinct title, rarest first.

    Equal titles are collapsed to their smallest id before anything is compared.
    """
    folded = F.trim(padded(F.col("title")))
    t = df.where(F.length("title") >= min_chars).select(key, folded.alias("_f")).where("_f <> ''")
    reps = t.groupBy("_f").agg(F.min(key).alias(key))
    words = reps.select(key, F.explode(F.array_distinct(F.split("_f", " "))).alias("w"))
    freq = words.groupBy("w").agg(F.count("*").alias("df"))
    ranked = dim_join(words, freq, ["w"])
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("_l")).select(
        key, F.col("_l.w").alias("words"), F.size("_l").alias("n")
    )


def _pairs_alike(sets: DataFrame, floor: float, key: str, block: int) -> DataFrame:
    """The (a, b) pairs, a before b, whose similarity 2*shared/(na+nb) reaches the floor.

    A set of n words shares at least ``need`` with any set as similar, so similar sets meet
    in one of their rarest n - need + 1 words, and in two of their rarest n - need + 2 where two must be shared.  Sets are
    keyed by such words or pairs of words.  Large buckets are cut into blocks whose pairs are compared in
    parallel; the similarity is part of the join condition, so only similar pairs leave it.
    """
    share = floor / (2 - floor)
    least = lambda n: F.ceil(n * share - 1e-9)
    need = least(F.col("n"))
    head = lambda more: F.slice("words", 1, F.least(F.col("n"), F.col("n") - need + more).cast("int"))
    ones = F.transform(head(1), lambda w: F.xxhash64(w))
    # a partner may be so small that one shared word is enough for it
    small = least(least(F.col("n"))) <= 1
    twos = F.flatten(
        F.transform(head(2), lambda w, i: F.transform(F.slice(head(2), i + 2, F.size(head(2))), lambda v: F.xxhash64(F.least(w, v), F.greatest(w, v))))
    )
    keys = F.when(need <= 1, ones).when(small, F.concat(ones, twos)).otherwise(twos)
    # a checkpoint keeps the keys from being worked out again for each side of the join
    rows = checkpointed(sets.select(key, "words", "n", F.explode(F.array_distinct(keys)).alias("k")))
    sizes = rows.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "k").withColumn("blk", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("blk", "other"), "hi": F.greatest("blk", "other")})
    dealt = checkpointed(dealt.select("k", "lo", "hi", "blk", key, "words", "n"))
    left, right = dealt.alias("x"), dealt.alias("y")
    same = (F.col("x.k") == F.col("y.k")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    ordered = (F.col(f"x.{key}") < F.col(f"y.{key}")) & ((F.col("x.lo") == F.col("x.hi")) | (F.col("x.blk") != F.col("y.blk")))
    total = F.col("x.n") + F.col("y.n")
    sized = 2.0 * F.least("x.n", "y.n") >= floor * total - 1e-9
    alike = 2.0 * F.size(F.array_intersect("x.words", "y.words")) >= floor * total - 1e-9
    pairs = left.join(right, same & ordered & sized & alike)
    return pairs.select(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b")).distinct()


def greedy_dropped(edges: DataFrame, key: str) -> DataFrame:
    """Ids a first-come-first-kept pass drops, given the similar pairs (a, b), a before b, as rows (key).

    An id is dropped if a kept one stands before it among its partners.  Each undecided id has one condition per earlier
    partner, "that one is kept", possibly negated.  In a round every condition on a decided id becomes a constant, and every
    condition on an id that has a single condition itself is replaced by that one, so a chain of n similar titles
    halves each round instead of losing a link.  An id with a condition and its negation is dropped.
    """
    conditions = checkpointed(edges.select("b", "a", F.lit(False).alias("neg")).distinct())
    gone = conditions.select("b").limit(0)
    while not conditions.isEmpty():
        own = conditions.groupBy(F.col("b").alias("_x")).agg(F.count("*").alias("_n"), F.min("a").alias("_a"), F.min("neg").alias("_neg"))
        known = conditions.join(own, F.col("a") == F.col("_x"), "left").join(gone.select(F.col("b").alias("_g")), F.col("a") == F.col("_g"), "left")
        decided = F.col("_x").isNull()
        value = F.when(decided, F.col("_g").isNull() != F.col("neg"))  # kept is true
        single = F.col("_n") == 1
        step = checkpointed(
            known.select(
                "b", F.when(single, F.col("_a")).otherwise(F.col("a")).alias("a"), F.when(single, F.col("neg") == F.col("_neg")).otherwise(F.col("neg")).alias("neg"), value.alias("value")
            ).distinct()
        )
        both = step.where("value IS NULL").groupBy("b", "a").agg(F.count("*").alias("n")).where("n > 1")
        now = step.where("value").select("b").unionByName(both.select("b")).distinct()
        gone = gone.unionByName(now)
        conditions = checkpointed(step.where("value IS NULL").select("b", "a", "neg").join(now, "b", "left_anti"))
    return gone.select(F.col("b").alias(key))


def near_duplicates(sets: DataFrame, floor: float, key: str, block: int = BLOCK) -> DataFrame:
    """Ids a first-come-first-kept pass would drop: each is similar to an earlier kept one."""
    return greedy_dropped(checkpointed(_pairs_alike(sets, floor, key, block)), key)


def dedupe_fuzzy(df: DataFrame, floor: float = 0.85, min_chars: int = 10, key: str = "article_id") -> DataFrame:
    """First of each run of near-equal titles in id order; titles under ``min_chars``, blank and NULL ones pass uncompared."""
    sets = checkpointed(word_sets(df, min_chars, key))
    keep = sets.select(key).join(near_duplicates(sets, floor, key), key, "left_anti")
    compared = F.coalesce((F.length("title") >= min_chars) & (F.trim(padded(F.col("title"))) != ""), F.lit(False))
    rest = df.where(~compared)
    # a row delivered twice under one id stays once
    first = dedupe_keys(df.where(compared).join(keep, key, "left_semi"), [key], key)
    return first.unionByName(rest)


# ---- similarity of characters --------------------------------------------------------------------


def _edits(n: Column, floor: float) -> Column:
    """The most edits between a title of n characters and a longer one that is similar to it."""
    return F.floor(n * ((1 - floor) / floor) + 1e-9).cast("int")


def _chunk(n: Column, floor: float) -> Column:
    """Longest chunk, of up to 6 characters, of which a title of n characters has more than edits can touch."""
    out = F.lit(1)
    for q in range(2, 7):
        out = F.when(F.floor(n / q) > _edits(n, floor), q).otherwise(out)
    return out


def _grams(chars: Column, q: Column, step: Column) -> Column:
    """(gram, place) of every ``step``-th run of q entries of a character array; a substring of a text would be counted out from its beginning."""
    at = F.sequence(F.lit(1), F.size(chars) - q + 1, step)
    return F.transform(at, lambda i: F.struct(F.array_join(F.slice(chars, i, q), "").alias("g"), i.alias("place")))


TITLES_PER_TASK = 10_000
LETTERS = "etao", "insr", "hldc", "um g"


LANE = 15  # bits of a letter's count in a long
EACH = sum(1 << LANE * i for i in range(4))


def _letters(text: Column, which: str) -> Column:
    """How often four letters occur, each up to 4,095, in 15 bits each of a long."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(which):
        times = F.least(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))), F.lit(4_095)).cast("long")
        out = out.bitwiseOR(F.shiftleft(times, LANE * i))
    return out


def _lane_sum(c: Column) -> Column:
    return sum((F.shiftright(c, LANE * i).bitwiseAND(F.lit((1 << LANE) - 1)) for i in range(1, 4)), c.bitwiseAND(F.lit((1 << LANE) - 1)))


def _fewest_edits(x: str, y: str, names: Sequence[str]) -> Column:
    """A lower bound of the edits between two titles: an edit takes away one letter at most and puts in one at most.

    Four letters are compared at a time: a bit above each count keeps the differences apart and tells which are not negative.
    """
    more = F.lit(0).cast("long")
    for name in names:
        apart = F.col(f"{x}.{name}").bitwiseOR(F.lit(EACH << LANE - 1)) - F.col(f"{y}.{name}")
        ones = F.shiftright(apart, LANE - 1).bitwiseAND(F.lit(EACH))
        more = more + apart.bitwiseAND(F.shiftleft(ones, LANE - 1) - ones)
    other = (F.col(f"{x}.n") - F.col(f"{x}.counted")) - (F.col(f"{y}.n") - F.col(f"{y}.counted"))
    # what one title has more of, less what the other has more of, is the difference of their lengths
    return _lane_sum(more) + F.greatest(other, F.lit(0)) + F.greatest(F.col(f"{y}.n") - F.col(f"{x}.n"), F.lit(0))


def pairs_by_edits(titles: DataFrame, floor: float, key: str, block: int = BLOCK) -> DataFrame:
    """The (a, b) pairs of titles (key, f), a before b, with ``1 - edits / longer length`` of at least ``floor``.

    A title is cut into chunks of a few characters; an edit touches one chunk, so of one more chunks than edits are allowed one
    stands unchanged in every similar title, moved by no more places than edits.  The rarest chunks of
    one side meet the runs of as many characters of the other in the same stretch of places and lengths, which is exact.
    What a title repeats inside a stretch is one row with its first and last place.  Large buckets are cut into blocks, and lengths, places and the counts of sixteen
    letters are part of the join condition: few pairs but the similar ones leave it, for which the edits are counted.
    """
    if floor <= 0.5:
        raise ValueError("a floor above one half is needed: otherwise no part of a title need stay unchanged")
    words = [f"l{i}" for i in range(len(LETTERS))]
    rows = titles.select(key, "f", F.length("f").alias("n"), *[_letters(F.col("f"), c).alias(l) for c, l in zip(LETTERS, words)])
    rows = checkpointed(rows.withColumn("counted", sum(_lane_sum(F.col(w)) for w in words).cast("int")))
    names = [*words, "counted"]
    # the titles come in few parts, each character of them becomes rows
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TITLES_PER_TASK))
    # texts are dealt and cut into characters behind that: an array holds 16 bytes for each
    dealt = rows.select(key, "n", *names, "f").repartition(tasks, key).select(key, "n", *names, F.split("f", "").alias("cs"))
    q = _chunk(F.col("n"), floor)
    cut = dealt.select(key, "n", *names, "cs", q.alias("q")).select(key, "n", *names, "q", F.explode(_grams(F.col("cs"), F.col("q"), F.col("q"))).alias("c")).select(key, "n", *names, "q", "c.*")
    common = cut.groupBy("q", "g").agg(F.count("*").alias("df"))
    ranked = dim_join(cut, common, ["q", "g"])
    rarest = ranked.groupBy(key, "n", *names, "q").agg(F.sort_array(F.collect_list(F.struct("df", "g", "place"))).alias("l"))
    rarest = rarest.select(key, "n", *names, "q", F.explode(F.slice("l", F.lit(1), _edits(F.col("n"), floor) + 1)).alias("c")).select(key, "n", *names, "q", "c.g", "c.place")
    # stretches of places, at least as wide as the edits of the title allow, in powers of two so that few widths occur
    width = lambda m: F.pow(2.0, F.ceil(F.log2(F.greatest(2 * _edits(m, floor), F.lit(8)).cast("double")))).cast("int")
    # one hash instead of four columns: whatever else it lets meet, the edits decide
    meet, met_at = ["m"], F.xxhash64("q", "g", "w", "s").alias("m")
    ends = (F.min("place").alias("lo"), F.max("place").alias("hi"))
    reach, w = _edits(F.col("n"), floor), F.col("w")
    stretches = F.sequence(F.floor(F.greatest(F.col("place") - reach, F.lit(0)) / w), F.floor((F.col("place") + reach) / w))
    left = rarest.withColumn("w", width(F.col("n"))).withColumn("s", F.explode(stretches)).groupBy(key, "n", *names, met_at).agg(*ends)
    # partners' lengths say which chunk lengths and stretches a title's runs may be looked up by
    lengths = F.sequence(F.ceil(F.col("n") * floor - 1e-9).cast("int"), F.floor(F.col("n") / floor + 1e-9).cast("int"))
    shape = lambda m: F.struct(_chunk(m, floor).alias("q"), width(m).alias("w"))
    looked = dealt.select(key, "n", *names, "cs", F.explode(F.array_distinct(F.transform(lengths, shape))).alias("s")).select(key, "n", *names, "cs", "s.*").where("n >= q")
    runs = looked.select(key, "n", *names, "q", "w", F.explode(_grams(F.col("cs"), F.col("q"), F.lit(1))).alias("c")).select(key, "n", *names, "q", "w", "c.*")
    right = runs.withColumn("s", F.floor(F.col("place") / w)).groupBy(key, "n", *names, met_at).agg(*ends)
    left = checkpointed(left)
    sizes = left.groupBy(*meet).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    left = left.join(sizes, meet).withColumn("blk", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    right = right.join(sizes, meet).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    text = rows.select(F.col(key).alias("_id"), "f")
    x, y = left.alias("x"), right.alias("y")
    same = (F.col("x.blk") == F.col("y.blk")) & (F.col(f"x.{key}") != F.col(f"y.{key}"))
    for c in meet:
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    longer = F.greatest("x.n", "y.n")
    allowed = F.floor(longer * (1 - floor) + 1e-9)
    near = (F.abs(F.col("x.n") - F.col("y.n")) <= allowed) & (F.col("x.lo") - F.col("y.hi") <= allowed) & (F.col("y.lo") - F.col("x.hi") <= allowed)
    near = near & (_fewest_edits("x", "y", words) <= allowed)
    sides = (F.least(F.col(f"x.{key}"), F.col(f"y.{key}")).alias("a"), F.greatest(F.col(f"x.{key}"), F.col(f"y.{key}")).alias("b"))
    met = x.join(y, same & near).select(*sides).distinct()
    # the pairs are narrow and their edits are dear, so they are not left in the few parts that their bytes would ask for
    sides = met.join(text.withColumnsRenamed({"_id": "a", "f": "fa"}), "a").repartition(4 * tasks, "b").join(text.withColumnsRenamed({"_id": "b", "f": "fb"}), "b")
    most = F.floor(F.greatest(F.length("fa"), F.length("fb")) * (1 - floor) + 1e-9).cast("int")
    edits = F.call_function("levenshtein", "fa", "fb", most)  # -1 beyond the most
    return sides.where(edits >= 0).select("a", "b")


def dedupe_similar(df: DataFrame, floor: float = 0.85, min_chars: int = 10, key: str = "article_id") -> DataFrame:
    """First of each run of titles alike by characters: dropped where an earlier kept title, folded and trimmed, needs edits
    of at most ``1 - floor`` of the longer one's length.  Shorter, blank and NULL titles pass uncompared; equal titles are compared once."""
    compared = F.coalesce(F.length(folded_title()) >= min_chars, F.lit(False))
    titles = checkpointed(df.where(compared).groupBy(folded_title().alias("f")).agg(F.min(key).alias(key)))
    keep = titles.select(key).join(greedy_dropped(checkpointed(pairs_by_edits(titles, floor, key)), key), key, "left_anti")
    first = dedupe_keys(df.where(compared).join(keep, key, "left_semi"), [key], key)
    return first.unionByName(df.where(~compared))
