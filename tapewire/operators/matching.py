"""Finding terms, symbols and names in whole texts.

Text is folded to a padded token string (lower case, one space between tokens, a
space at both ends), so a whole-token test is a plain search and a phrase works like
a word.  Short term lists are plan literals; for long ones ``term_hits`` explodes the
text's word groups and equi joins, which gives the same answer.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewire.operators.scale import checkpointed, dim_join, explode_some, once

TOKEN_GAP = r"[^\p{L}\p{N}]+"


def padded(c: Column) -> Column:
    """' token token ... ' over the whole text; NULL counts as empty."""
    folded = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), TOKEN_GAP, " ")
    return F.concat(F.lit(" "), F.trim(folded), F.lit(" "))


def fold_term(term: str) -> str:
    """The padded form of a literal term."""
    import re

    return " " + re.sub(r"[\W_]+", " ", term.lower()).strip() + " "


def full_text() -> Column:
    return F.concat_ws(" ", F.col("title"), F.col("description"))


def has_term(text: Column, term: str, substring: bool = False) -> Column:
    return text.contains(term.lower() if substring else fold_term(term))


def any_term(text: Column, terms: Sequence[str], substring: bool = False) -> Column:
    """True if any term occurs in ``padded`` text (as whole tokens unless ``substring``).

    One alternation, so the text expression is evaluated once however many terms there are.
    """
    if substring:
        return text.rlike("|".join("\\Q" + t.lower() + "\\E" for t in terms))
    return text.rlike(" (?:" + "|".join(fold_term(t).strip() for t in terms) + ") ")


def count_terms(text: Column, terms: Sequence[str]) -> Column:
    """How many different terms occur."""
    out = F.lit(0)
    for t in terms:
        out = out + has_term(text, t).cast("int")
    return out


def word_runs(c: Column) -> Column:
    """Every distinct run of consecutive words of a short name."""
    words = F.split(c, " ")
    n = F.size(words)
    runs = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(words, i, j - i + 1), " ")),
    )
    return F.array_distinct(F.flatten(runs))


def term_hits(df: DataFrame, text: str, terms: DataFrame, key: str, max_words: int) -> DataFrame:
    """(key, term, ...term columns) for every distinct term of a large table found in the text.

    Exact for any number of terms of up to ``max_words`` words: the text's groups of
    1..max_words tokens are exploded and equi joined.
    """
    tokens = F.split(F.trim(padded(F.col(text))), " ")
    df = df.select(key, tokens.alias("_t"))

    def groups(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("_t") - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(F.col("_t"), i, n), " "))

    all_grams = F.array_distinct(F.concat(*[groups(n) for n in range(1, max_words + 1)]))
    return dim_join(df.select(key, F.explode(all_grams).alias("term")), terms, ["term"], "inner")


def keyword_class(text: Column, classes: Mapping[str, Sequence[str]], otherwise: str = "low") -> Column:
    """First class, in the mapping's order, with any keyword in the text."""
    out = None
    for name, terms in classes.items():
        hit = any_term(text, terms)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def keyword_flags(df: DataFrame, column: str, categories: Mapping[str, Sequence[str]], prefix: str = "kw_") -> DataFrame:
    text = padded(F.col(column))
    return df.withColumns({f"{prefix}{n}": any_term(text, t).cast("int") for n, t in categories.items()})


def is_reputable(source: Column, allow: Sequence[str]) -> Column:
    """Any allow-list name is a substring of the source name."""
    low = F.lower(F.coalesce(source, F.lit("")))
    out = F.lit(False)
    for a in allow:
        out = out | low.contains(a.lower())
    return out


def relevance_score(
    has_ticker: Column, financial_source: Column, financial_hits: Column, impact_hits: Column
) -> Column:
    """Half for a ticker, 0.3 for the source, up to 0.2 for each kind of keyword; at most 1."""
    score = has_ticker.cast("double") * 0.5 + financial_source.cast("double") * 0.3
    score = score + F.least(financial_hits * 0.1, F.lit(0.2)) + F.least(impact_hits * 0.1, F.lit(0.2))
    return F.least(score, F.lit(1.0))


def relevance_flags(
    df: DataFrame,
    impact: Mapping[str, Sequence[str]],
    financial: Sequence[str],
    stop: Sequence[str],
    sources: Sequence[str],
    floor: float = 0.25,
) -> DataFrame:
    """Impact level, relevance score and the three flags of each article, in one pass over its text."""
    every = [t for terms in impact.values() for t in terms]
    text = F.col("_text")
    df = once(df, _text=padded(full_text()))
    df = once(
        df,
        impact_level=keyword_class(text, impact),
        is_irrelevant=any_term(text, stop),
        relevance_score=relevance_score(
            F.coalesce(F.col("ticker"), F.lit("")) != "",
            is_reputable(F.col("source"), sources),
            count_terms(text, financial),
            count_terms(text, every),
        ),
    ).drop("_text")
    return df.withColumns(
        {
            "is_relevant": (F.col("relevance_score") >= floor) & ~F.col("is_irrelevant"),
            "is_impactful": F.col("impact_level").isin("high", "macro"),
        }
    )


def keep_relevant(df: DataFrame, floor: float = 0.25) -> DataFrame:
    wanted = (
        F.col("is_relevant")
        | F.col("is_impactful")
        | F.col("ticker").isNotNull()
        | (F.col("relevance_score") >= floor)
    )
    return df.where(wanted & ~F.col("is_irrelevant"))


# one to five letters, optionally a one-letter share class, not inside a longer word
SYMBOL = r"(?<![\p{L}\p{N}])([A-Z]{1,5}(?:[.\-][A-Z])?)(?![\p{L}\p{N}])"


def symbol_tokens(c: Column, pattern: str = SYMBOL) -> Column:
    """Distinct symbol-shaped tokens in order of appearance, share class written with a dash."""
    found = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.translate(t, ".", "-")))


LISTED_TICKERS = 2_000


def _listed(universe: DataFrame, name: str = "ticker") -> list[str] | None:
    """The universe as a list when it is small, else None; reads no further than the bound."""
    rows = universe.select(name).distinct().limit(LISTED_TICKERS + 1).collect()
    return [r[name] for r in rows] if len(rows) <= LISTED_TICKERS else None


def _tracked(tokens: Column, listed: list[str] | None) -> Column:
    """Tokens that are listed, in their order; all of them when the list is too long for the plan."""
    return tokens if listed is None else F.array_intersect(tokens, F.array(*[F.lit(t) for t in listed]).cast("array<string>"))


def _semi(rows: DataFrame, universe: DataFrame, listed: list[str] | None) -> DataFrame:
    return dim_join(rows, universe.select("ticker"), ["ticker"], "left_semi") if listed is None else rows


def extract_tickers(
    df: DataFrame, universe: DataFrame, text: Column, pattern: str = SYMBOL, key: str = "article_id"
) -> DataFrame:
    """One row per (article, tracked symbol found), ``position`` in order of appearance.

    A small universe is matched inside the row, so only hits are exploded next to the
    text.  A large one is matched on narrow (key, text hash, symbol) rows that join back by both, which gives the same rows.
    """
    listed = _listed(universe)
    base = df.drop("ticker")
    if listed is not None:
        found = _tracked(symbol_tokens(text, pattern), listed)
        return base.select("*", F.posexplode(found).alias("position", "ticker"))
    same = F.xxhash64(text)
    tokens = df.select(F.col(key).alias("_id"), same.alias("_same"), F.posexplode(symbol_tokens(text, pattern)).alias("_p", "ticker"))
    hits = _semi(tokens, universe, None).groupBy("_id", "_same").agg(F.sort_array(F.collect_set(F.struct("_p", "ticker"))).alias("_h"))
    hits = hits.select("_id", "_same", F.posexplode(F.col("_h.ticker")).alias("position", "ticker"))
    marked = base.withColumn("_text", same)
    return marked.join(hits, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_same"))).drop("_id", "_same", "_text")


def assign_ticker(df: DataFrame, universe: DataFrame, key: str = "article_id", pattern: str = SYMBOL) -> DataFrame:
    """(key, ticker): the longest tracked symbol, title before description, single letters skipped."""
    listed = _listed(universe)
    parts = F.array(
        *[
            F.struct(F.lit(i).alias("part"), _tracked(symbol_tokens(F.col(c), pattern), listed).alias("tokens"))
            for i, c in enumerate(("title", "description"))
        ]
    )
    rows = df.select(key, F.explode(parts).alias("p")).select(key, "p.part", F.explode("p.tokens").alias("ticker"))
    rows = _semi(rows.where(F.length("ticker") > 1), universe, listed)
    order = F.struct("part", (-F.length("ticker")).alias("l"), "ticker")
    return rows.groupBy(key).agg(F.min_by("ticker", order).alias("ticker"))


def substrings(chars: Column, longest: int) -> Column:
    """Every distinct run of one to ``longest`` entries of a character array."""
    n = F.size(chars)

    def windows(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(chars, i, size), ""))

    return F.array_distinct(F.concat(*[windows(k) for k in range(1, longest + 1)]))


def mentions(
    news: DataFrame, universe: DataFrame, key: str = "article_id", pattern: str = SYMBOL, substring: int | None = None
) -> DataFrame:
    """(key, ticker): the article's own ticker and every tracked symbol named in its title.

    ``substring=n`` also counts symbols of up to n characters inside longer words; the
    title's character windows are exploded and equi joined, so it stays exact without
    comparing every title with every symbol.
    """
    own = F.array_compact(F.array(F.col("ticker")))
    title = F.upper(F.coalesce(F.col("title"), F.lit("")))
    listed = _listed(universe)
    if substring is None:
        found = F.array_union(own, symbol_tokens(title, pattern))
        rows = news.select(key, F.explode(_tracked(found, listed)).alias("ticker"))
    else:
        rows = news.select(key, own.alias("_own"), F.split(title, "").alias("_chars"))
        found = F.array_union("_own", substrings(F.col("_chars"), substring))
        rows = rows.select(key, F.explode(_tracked(found, listed)).alias("ticker"))
    return _semi(rows, universe, listed)


def names_in_title(news: DataFrame, pattern: str = SYMBOL) -> Column:
    """The article's own ticker, then the symbols named in its title; feeds without titles give their own ticker only."""
    own = F.array_compact(F.array(F.col("ticker")))
    return F.array_union(own, symbol_tokens(F.col("title"), pattern)) if "title" in news.columns else own


def per_mention(news: DataFrame, universe: DataFrame, pattern: str = SYMBOL) -> DataFrame:
    """Every article once for each tracked symbol it serves, which is then its ``ticker``.

    Worked out inside the row, without a join on the id: rows that share an id keep their own symbols, a symbol that is both
    the article's ticker and in its title counts once, and an article that serves no tracked symbol goes.
    """
    listed = _listed(universe)
    served = _tracked(names_in_title(news, pattern), listed)
    rows = news.select(*[c for c in news.columns if c != "ticker"], F.explode(served).alias("ticker"))
    return _semi(rows, universe, listed).select(*news.columns)


def related_news(news: DataFrame, ticker: str, k: int = 5) -> DataFrame:
    """The k newest articles of a ticker or naming it in title or description."""
    hit = (F.col("ticker") == ticker) | has_term(padded(full_text()), ticker)
    return news.where(hit).orderBy(F.desc_nulls_last("date"), F.asc("article_id")).limit(k)


def extract_entities(df: DataFrame, entities: Mapping[str, Sequence[str]], key: str = "article_id") -> DataFrame:
    """(key, kind, name) for every listed name in the whole text."""
    text = F.col("_text")
    found = F.array(
        *[
            F.when(has_term(text, name), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name")))
            for kind, names in entities.items()
            for name in names
        ]
    )
    rows = once(df.select(key, "title", "description"), _text=padded(full_text()))
    return explode_some(rows, [key], found, "e").select(key, "e.kind", "e.name")


def resolve_company(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ticker for each search term: exact name, then contained name, else the term itself.

    ``aliases`` is (name, ticker).  "Contained" means as a run of words, found by
    equi joining the runs of one side with the other side's whole text.
    """
    t = terms.select("term", F.trim(padded(F.col("term"))).alias("_q"))
    a = aliases.select(F.trim(padded(F.col("name"))).alias("_n"), "ticker")
    # a name, and a run of words that names share, keep the ticker that would win: one row each, combined before the shuffle
    names = a.groupBy("_n").agg(F.min("ticker").alias("ticker"))
    runs = names.select("ticker", "_n", F.explode(word_runs(F.col("_n"))).alias("_q"))
    runs = runs.groupBy("_q").agg(F.min(F.struct("_n", "ticker")).alias("w")).select("_q", "w.*")
    exact = dim_join(t.withColumnRenamed("_q", "_n"), names, ["_n"]).select("term", "ticker", F.lit(0).alias("rank"), "_n")
    name_in_term = dim_join(t.select("term", F.explode(word_runs(F.col("_q"))).alias("_n")), names, ["_n"])
    term_in_name = dim_join(t, runs, ["_q"])
    near = name_in_term.select("term", "ticker", F.lit(1).alias("rank"), "_n").unionByName(
        term_in_name.select("term", "ticker", F.lit(1).alias("rank"), "_n")
    )
    best = exact.unionByName(near).groupBy("term").agg(
        F.min_by("ticker", F.struct("rank", "_n", "ticker")).alias("ticker")
    )
    return t.join(best, "term", "left").select(
        "term", F.coalesce("ticker", F.upper(F.trim(F.col("term")))).alias("ticker")
    )


def sentiment_scores(
    df: DataFrame,
    lexicon: DataFrame,
    modifiers: DataFrame,
    key: str | list[str] = "article_id",
    alpha: float = 15.0,
) -> DataFrame:
    """(key, compound, positive, negative, neutral) of every article with a lexicon word.

    ``lexicon`` is (token, weight); ``modifiers`` is (prev, factor), factors that the
    word before applies to a weight (negative for negators, above one for boosters).
    compound = s / sqrt(s^2 + alpha).  Tokens are exploded next to their article id, so
    the text itself never moves; a text's hits are a set of places, so a row delivered twice scores as once.
    """
    keys = [key] if isinstance(key, str) else key
    tokens = once(df.select(*keys, "title", "description"), _t=F.split(F.trim(padded(full_text())), " ")).drop("title", "description")
    listed = _listed(lexicon, "token")

    def place(t: Column, i: Column) -> Column:
        found = F.struct(i.alias("at"), t.alias("token"), F.when(i > 0, F.get(F.col("_t"), i - 1)).alias("prev"))
        return found if listed is None else F.when(t.isin(listed), found)

    # of a small lexicon only the words it holds leave the row; a large one is left to the join
    pairs = F.transform(F.col("_t"), place)
    rows = explode_some(tokens, [*keys, F.size("_t").alias("n_tokens")], pairs if listed is None else F.array_compact(pairs), "p").select(
        *keys, "n_tokens", "p.at", "p.token", "p.prev"
    )
    rows = dim_join(rows, lexicon.select("token", "weight"), ["token"], "inner")
    rows = dim_join(rows, modifiers.select("prev", "factor"), ["prev"], "left")
    w = F.col("weight") * F.coalesce(F.col("factor"), F.lit(1.0))
    places = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("at", w.alias("w")))).alias("_hits"), F.max("n_tokens").alias("_n"))
    add = lambda pick: F.aggregate("_hits", F.lit(0.0), lambda acc, h: acc + pick(h["w"]))
    hit = places.select(
        *keys,
        add(lambda v: v).alias("_s"),
        add(lambda v: F.when(v > 0, v).otherwise(0.0)).alias("_p"),
        add(lambda v: F.when(v < 0, -v).otherwise(0.0)).alias("_m"),
        (F.col("_n") - F.size("_hits")).alias("_plain"),
    )
    total = F.col("_p") + F.col("_m") + F.col("_plain")
    s = F.col("_s")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0))
    return hit.select(
        *keys,
        (s / F.sqrt(s * s + alpha)).alias("sentiment_compound"),
        share("_p").alias("sentiment_positive"),
        share("_m").alias("sentiment_negative"),
        share("_plain").alias("sentiment_neutral"),
    )


def score_sentiment(df: DataFrame, lexicon: DataFrame, modifiers: DataFrame, key: str = "article_id", alpha: float = 15.0) -> DataFrame:
    """Articles with their lexicon scores; without any lexicon word all neutral.  Rows of one id with different texts are scored apart."""
    marked = df.withColumn("_text", F.xxhash64(full_text()))
    scores = sentiment_scores(marked, lexicon, modifiers, [key, "_text"], alpha).withColumnRenamed(key, "_id").withColumnRenamed("_text", "_same")
    out = marked.join(scores, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_same")), "left").drop("_id", "_same", "_text")
    none = {"sentiment_compound": 0.0, "sentiment_positive": 0.0, "sentiment_negative": 0.0, "sentiment_neutral": 1.0}
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in none.items()})


def score_with_model(df: DataFrame, scorer, key: str = "article_id", batch: int = 256) -> DataFrame:
    """Batched external text model.  ``scorer(list[str]) -> list[(pos, neg, neu)]``.

    Runs inside tasks on Arrow batches; compound = positive - negative.
    """
    import pandas as pd

    def run(frames):
        for pdf in frames:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                pos, neg, neu = zip(*scorer(part["_text"].tolist()))
                yield pd.DataFrame(
                    {
                        key: part[key].to_numpy(),
                        "sentiment_positive": pos,
                        "sentiment_negative": neg,
                        "sentiment_neutral": neu,
                    }
                )

    schema = f"{key} {df.schema[key].dataType.simpleString()}, sentiment_positive double, sentiment_negative double, sentiment_neutral double"
    scored = df.select(key, full_text().alias("_text")).mapInPandas(run, schema)
    return scored.withColumn("sentiment_compound", F.col("sentiment_positive") - F.col("sentiment_negative"))


def score_with_fallback(
    df: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple]]], lexicon: DataFrame, modifiers: DataFrame, key: str = "article_id", batch: int = 256
) -> DataFrame:
    """Articles scored by an external text model, and by the lexicon where the model gives nothing; ``scored_by`` says which.

    ``load()`` returns a scorer, ``list[str] -> list[(pos, neg, neu)]``; it is called once a worker, and a model that cannot be loaded leaves
    everything to the lexicon.  A batch on which the scorer fails is tried again text by text, so what
    falls back depends on the texts and not on how they were dealt.  Only narrow scores are stored and shuffled.
    """
    from pyspark.ml.functions import predict_batch_udf

    def make():
        try:
            scorer = load()
        except Exception:  # any reason for which the model is not there
            return lambda texts: np.full((len(texts), 3), np.nan)

        def one(text):
            try:
                return scorer([text])[0]
            except Exception:  # the scorer is foreign code
                return (np.nan,) * 3

        def predict(texts):
            flat = [str(t) for t in np.ravel(texts)]
            try:
                found = scorer(flat)
            except Exception:
                found = [one(t) for t in flat]
            return np.array(found, float).reshape(len(flat), 3)

        return predict

    model = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch)
    marked = df.withColumn("_text", F.xxhash64(full_text()))
    found = checkpointed(marked.select(F.col(key).alias("_id"), F.col("_text").alias("_same"), model(full_text()).alias("_m")))
    names = ("sentiment_positive", "sentiment_negative", "sentiment_neutral")
    there = F.col("_m")[0].isNotNull() & ~F.isnan(F.col("_m")[0])  # what is no number may come back as NULL
    by_model = found.where(there).dropDuplicates(["_id", "_same"]).select("_id", "_same", *[F.col("_m")[i].alias(n) for i, n in enumerate(names)])
    by_model = by_model.withColumn("sentiment_compound", F.col("sentiment_positive") - F.col("sentiment_negative"))
    left = found.where(~there).select("_id", "_same").distinct()
    same = F.col(key).eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_same"))
    rest = marked.join(left, same, "left_semi")
    by_lexicon = sentiment_scores(rest, lexicon, modifiers, [key, "_text"]).withColumnsRenamed({key: "_id", "_text": "_same"})
    scores = by_model.withColumn("scored_by", F.lit("model")).unionByName(by_lexicon.withColumn("scored_by", F.lit("lexicon")))
    out = marked.join(scores, same, "left").drop("_id", "_same", "_text")
    none = {"sentiment_compound": 0.0, "sentiment_positive": 0.0, "sentiment_negative": 0.0, "sentiment_neutral": 1.0, "scored_by": "lexicon"}
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in none.items()})
