"""Quality rules with adaptive thresholds, in DataFrame functions only.

Per-document figures come from array functions inside the row.  For every
(lang, source) a mergeable KLL sketch of each figure is built; a far-out fence
(an outer quantile plus a multiple of its distance from an inner one) replaces a
fixed cut-off, and the documents are joined with the fences and filtered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.llm.batches import null_safe
from tapewire.operators.scale import checkpointed, once

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LONG_MAX = 2**63 - 1

# figure -> (outer and inner quantile, part of ``fence`` by which their distance is taken, least width).  Most documents
# have no symbols and no repeats, so those figures have a spread only in the tail; junk reaches below the 95th percentile
# of symbols.  The least width is for groups of equal documents, whose fence would cut at any change.
FIGURES = {
    "word_length": (0.75, 0.25, 1.0, 0.25),
    "symbol_share": (0.90, 0.50, 1.0, 0.02),
    "dup_line_share": (0.99, 0.50, 0.25, 0.02),
    "repeat_share": (0.99, 0.50, 0.25, 0.02),
}
SKETCH_K = 400  # rank error under 1 %
FENCE = 4.0  # times the distance of the quantiles
MIN_GROUP = 200  # documents; smaller groups take their language's merged sketch


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(hashes: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    A window's hash and its place share one long, so that a sort of longs brings
    equal windows together; equal neighbours are confirmed on their whole hashes.
    """
    m = F.greatest(n - 2, F.lit(0)).cast("long")
    grams = F.transform(
        F.slice(hashes, F.lit(1), m.cast("int")), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2))
    )

    def over(g: Column) -> Column:
        span = F.call_function("div", F.lit(LONG_MAX), m)
        packed = F.sort_array(F.transform(g, lambda x, i: F.pmod(x, span) * m + i))
        return _let(packed, lambda s: starts(g, s))

    def starts(g: Column, s: Column) -> Column:
        def same(v: Column, other: Column) -> Column:
            return (F.call_function("div", v, m) == F.call_function("div", other, m)) & (
                F.get(g, (v % m).cast("int")) == F.get(g, (other % m).cast("int"))
            )

        hits = F.filter(s, lambda v, k: same(v, F.get(s, k - 1)) | same(v, F.get(s, k + 1)))
        return _let(F.sort_array(F.transform(hits, lambda v: v % m)), covered)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    return F.when(m < 2, F.lit(0).cast("long")).otherwise(_let(grams, over))


def _figures(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        n = F.size(words)
        lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x))
        return _let(
            F.struct(F.transform(words, lambda w: F.xxhash64(w)).alias("h"), lines.alias("l")),
            lambda x: F.struct(
                n.cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
                F.size(x["l"]).cast("long").alias("n_lines"),
                _repeated(x["h"], n).alias("n_repeat_words"),
            ),
        )

    return _let(F.array_remove(F.split(text, SPACE), ""), of)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row per document: id, the two group columns, the counts and ``base_failed``.

    A NULL or empty text has no words and fails the base rule.  Other columns are not carried.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(c) for c in by], F.col(text_col).alias("__text"))
    seen = once(slim, __m=_figures(F.col("__text"))).select("doc_id", *by, "__m.*")
    return seen.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _shares(measured: DataFrame) -> DataFrame:
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return measured.withColumns(
        {
            "word_length": part("word_chars", "n_words"),
            "symbol_share": part("n_symbols", "word_chars"),
            "dup_line_share": part("n_dup_lines", "n_lines"),
            "repeat_share": part("n_repeat_words", "n_words"),
        }
    )


def fences(measured: DataFrame, by: tuple[str, str] = ("lang", "source"), fence: float = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source): ``lo_<figure>`` and ``hi_<figure>`` from merged KLL sketches.

    Documents that fail the base rule are left out of the sketches.  Every task sends
    one sketch per group, so a source with a third of the rows costs no more than
    another.  A group of fewer than ``min_group`` documents takes the sketch merged
    over its language; a small language takes the one merged over everything.  NULL is
    a group of its own.
    """
    own = _shares(measured.where(~F.col("base_failed"))).groupBy(*by).agg(
        F.count("*").alias("__n"), *[F.kll_sketch_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in FIGURES]
    )
    own = checkpointed(own)  # a sketch draws random bits: the groups and what they merge into must see the same one
    merged = [F.kll_merge_agg_double(c, F.lit(SKETCH_K)).alias(f"{c}_up") for c in FIGURES]
    lang = own.groupBy(by[0]).agg(F.sum("__n").alias("__n_up"), *merged)
    # one row of a fixed size: the sketches of everything
    every = own.agg(*[F.kll_merge_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in FIGURES]).first()
    wide = null_safe(own, lang, [by[0]], "left")

    def pick(c: str) -> Column:
        return F.when(F.col("__n") >= min_group, F.col(c)).when(F.col("__n_up") >= min_group, F.col(f"{c}_up")).otherwise(F.lit(every[c]))

    out = []
    for c, (outer, inner, part, least) in FIGURES.items():
        low, high = (F.kll_sketch_get_quantile_double(pick(c), F.lit(p)) for p in (inner, outer))
        width = F.greatest(F.lit(fence * part) * (high - low), F.lit(least))
        out += [(low - width).alias(f"lo_{c}"), (high + width).alias(f"hi_{c}")]
    return checkpointed(wide.select(*by, *out))


def verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    by: tuple[str, str] = ("lang", "source"),
    fence: float = FENCE,
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """The measured rows with ``kept``: false if the base rule fails or a figure lies beyond its group's fence.

    Short words, symbols, repeated lines and repeated windows count against a document; long
    words count on both sides.  Repeated rows get equal verdicts; an empty table gives no rows.
    """
    rows = checkpointed(measure(docs, id_col, text_col, by))  # narrow: the texts are read once
    limits = fences(rows, by, fence, min_group)
    joined = null_safe(_shares(rows), limits, list(by), "left")
    inside = F.lit(True)
    for c in FIGURES:
        inside = inside & (F.col(c) <= F.coalesce(F.col(f"hi_{c}"), F.lit(float("inf"))))
    inside = inside & (F.col("word_length") >= F.coalesce(F.col("lo_word_length"), F.lit(0.0)))
    return joined.select(*rows.columns, (~F.col("base_failed") & inside).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rejected ones, all columns as they were.  Rows that share an id stand and fall together."""
    good = verdicts(docs, id_col, **options).groupBy("doc_id").agg(F.bool_and("kept").alias("__kept"))
    return null_safe(docs, good.where("__kept").select(F.col("doc_id").alias(id_col)), [id_col], "left_semi")
