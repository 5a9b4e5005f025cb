"""Joins of articles, labels, quotes, dimensions and stored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewire.functions.numeric import clip
from tapewire.functions.scores import ScoreWeights, direction_hit, merge_model, prediction_score, recommend
from tapewire.functions.text import blank_to_null, market_symbol
from tapewire.operators.scale import attach, first_per_key

# ---- tickers, quotes, dimension -------------------------------------------------------------


def by_symbol(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join on the market symbol, then on the raw ticker where that found nothing.

    Both sides hold one row per ticker; whether they are broadcast is left to
    Spark's own size check.
    """
    r = right.select("ticker", *columns)
    first = r.select(market_symbol(F.col("ticker")).alias("_sym"), F.struct(*columns).alias("_a"))
    first = first_per_key(first, ["_sym"], [F.col("_a")])
    second = r.select(F.col("ticker").alias("_raw"), F.struct(*columns).alias("_b"))
    out = left.withColumn("_sym", market_symbol(F.col("ticker"))).join(first, "_sym", "left")
    out = out.join(second, F.col("ticker") == F.col("_raw"), "left")
    hit = F.coalesce("_a", "_b")
    return out.select(*[F.col(c) for c in left.columns], *[hit[c].alias(c) for c in columns])


def ticker_signals(
    universe: DataFrame, summary: DataFrame, quotes: DataFrame, dim: DataFrame | None = None, weights: ScoreWeights = ScoreWeights()
) -> DataFrame:
    """One prediction row per priced ticker of the universe.

    A ticker without news keeps zero counts, HOLD and confidence 0; one without a price, or with price 0, is skipped.
    Company and sector come from ``dim`` (ticker, company_name, sector, industry), from the quotes where they carry them,
    else the ticker itself and 'Unknown'.  ``news_sentiment_score`` and ``momentum_normalized`` are the score's two main
    ingredients, rounded to four places for display; the score is not made from the rounded ones.
    """
    named = [c for c in ("company_name", "sector", "industry") if c in quotes.columns]
    priced = by_symbol(universe.select("ticker"), quotes, ["price", "change_percent", *named]).where(F.col("price") > 0)
    known = dim if dim is not None else universe.limit(0).select("ticker")
    absent = {c: F.lit(None).cast("string") for c in ("sector", "industry", "company_name") if c not in known.columns}
    rows = enrich_quotes(priced, known.withColumns(absent) if absent else known).join(summary, "ticker", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sent = F.coalesce(F.col("avg_sentiment"), F.lit(0.0))
    momentum = clip(F.coalesce(F.col("change_percent"), F.lit(0.0)) / weights.change_scale, -1, 1)
    score = prediction_score(sent, F.col("change_percent"), zero("article_count"), weights)
    return rows.select(
        "ticker",
        "company_name",
        "sector",
        "price",
        F.col("change_percent").alias("price_change_percent"),
        zero("article_count").alias("news_count"),
        sent.alias("avg_sentiment"),
        zero("positive_count").alias("positive_news"),
        zero("negative_count").alias("negative_news"),
        F.round(sent, 4).alias("news_sentiment_score"),
        F.round(momentum, 4).alias("momentum_normalized"),
        score.alias("prediction_score"),
        recommend(score).alias("recommendation"),
        F.coalesce(F.col("recommendation"), F.lit("HOLD")).alias("sentiment_recommendation"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence"),
    )


def merge_model_scores(preds: DataFrame, model: DataFrame) -> DataFrame:
    """Predictions with the model's scores where there are any, the sentiment stand-in elsewhere."""
    cols = ["ml_probability_up", "ml_confidence", "ml_score", "ml_recommendation"]
    return merge_model(preds.drop(*cols).join(model.select("ticker", *cols), "ticker", "left"))


def enrich_quotes(quotes: DataFrame, dim: DataFrame) -> DataFrame:
    """Quotes with sector, industry and company; an unknown value never replaces a known one."""
    cols = ["sector", "industry", "company_name"]
    base = quotes.withColumns(
        {c: F.lit(None).cast("string") for c in cols if c not in quotes.columns}
    )
    known = by_symbol(base.select("ticker"), dim, cols)
    known = known.select("ticker", *[F.col(c).alias(f"_{c}") for c in cols])
    out = base.join(known, "ticker", "left")
    useful = lambda c: F.when(F.lower(F.col(c)) != "unknown", blank_to_null(F.col(c)))
    fill = {"sector": F.lit("Unknown"), "industry": F.lit("Unknown"), "company_name": F.col("ticker")}
    return out.withColumns({c: F.coalesce(useful(f"_{c}"), useful(c), fill[c]) for c in cols}).drop(
        *[f"_{c}" for c in cols]
    )


def dim_gaps(universe: DataFrame, dim: DataFrame, n: int | None = None) -> DataFrame:
    """Universe members missing from the dimension or without a name, in order, at most n per run."""
    complete = dim.where(blank_to_null(F.col("company_name")).isNotNull()).select("ticker")
    gaps = universe.select("ticker").join(complete, "ticker", "left_anti").orderBy("ticker")
    return gaps if n is None else gaps.limit(n)


def dim_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of both, the latest row per ticker wins; on equal times the new table does."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, ["ticker"], [F.col("updated_at"), F.col("_src")], last=True).drop("_src")


def realised_check(preds: DataFrame, quotes: DataFrame) -> DataFrame:
    """Predicted sign against the sign of the last close-to-close change."""
    moved = quotes.select("ticker", F.col("change_percent").alias("actual_change_percent"))
    return direction_hit(preds.join(moved, "ticker"), actual="actual_change_percent")


# ---- articles against prices ---------------------------------------------------------------


def asof_forward(articles: DataFrame, bars: DataFrame, h: int = 1, key: str = "article_id") -> DataFrame:
    """Each article with the trading row of its day or the next one, and the h-row change after it.

    The lookup runs on distinct (ticker, day) pairs, bounded by the calendar per
    ticker: pairs and bars are unioned and each pair takes the first bar at or after
    it, found by a running frame from the newest date down.  Articles then join the result by equality, salted because one ticker-day may
    hold a large part of them.  Articles without a full horizon are dropped.
    """
    s = W.partitionBy("ticker").orderBy("date")
    ahead = bars.select("ticker", "date", "close", F.lead("close", h).over(s).alias("close_fwd"))
    bar_rows = ahead.select(
        "ticker", "date", F.lit(1).alias("_bar"), F.struct(F.col("date").alias("bar_date"), "close", "close_fwd").alias("_q")
    )
    days = articles.select("ticker", "date").distinct()
    q_type = bar_rows.schema["_q"].dataType
    pairs = days.select("ticker", "date", F.lit(0).alias("_bar"), F.lit(None).cast(q_type).alias("_q"))
    # newest first, a day's bar before its pair: a running frame, one step a row
    so_far = W.partitionBy("ticker").orderBy(F.desc("date"), F.desc("_bar")).rowsBetween(W.unboundedPreceding, 0)
    located = (
        pairs.unionByName(bar_rows)
        .withColumn("_next", F.last("_q", ignorenulls=True).over(so_far))
        .where("_bar = 0")
        .select("ticker", "date", "_next.*")
        .where(F.col("close_fwd").isNotNull())
    )
    out = attach(articles, located, ["ticker", "date"], "inner")
    return out.withColumn("change_percent", (F.try_divide(F.col("close_fwd"), F.col("close")) - 1) * 100)


def next_day_change(bars: DataFrame) -> DataFrame:
    """Change from calendar day d to d + 1 where both have a close."""
    nxt = bars.select("ticker", F.date_sub("date", 1).alias("date"), F.col("close").alias("next_close"))
    out = bars.select("ticker", "date", "close").join(nxt, ["ticker", "date"])
    diff = F.col("next_close") - F.col("close")
    return out.withColumns(
        {"change": diff, "change_percent": F.try_divide(diff, F.col("close")) * 100}
    )


def features_with_labels(features: DataFrame, changes: DataFrame) -> DataFrame:
    """Article features left joined to price changes by (date, ticker)."""
    return attach(features, changes, ["ticker", "date"], "left")


def scores_vs_returns(preds: DataFrame, returns: DataFrame) -> DataFrame:
    return preds.join(returns, ["ticker", "date"])


def merge_back_daily(news: DataFrame) -> DataFrame:
    """Every article with the figures of its (date, ticker): count, sentiment moments, high impact, relevance.

    The spread of a single article is 0.
    """
    daily = news.groupBy("ticker", "date").agg(
        F.count("*").alias("daily_news_count"),
        F.avg("sentiment_compound").alias("daily_avg_sentiment"),
        F.coalesce(F.stddev_samp("sentiment_compound"), F.lit(0.0)).alias("daily_sentiment_std"),
        F.min("sentiment_compound").alias("daily_min_sentiment"),
        F.max("sentiment_compound").alias("daily_max_sentiment"),
        F.avg("relevance_score").alias("daily_avg_relevance"),
        F.count_if(F.col("impact_level") == "high").alias("daily_high_impact"),
    )
    return attach(news, daily, ["ticker", "date"])


# ---- against what is stored ------------------------------------------------------------------


def event_key():
    """Identity of a stored article: folded title and url, ticker, and collection second."""
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return F.struct(
        text("title").alias("t"),
        text("url").alias("u"),
        F.coalesce(F.col("ticker"), F.lit("")).alias("k"),
        F.unix_seconds("scraped_at").alias("s"),
    )


def anti_join_store(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose key is not stored; salted, since many rows of ``df`` may share one key."""
    keys = stored.select(event_key().alias("_key")).distinct()
    return attach(df.withColumn("_key", event_key()), keys, ["_key"], "left_anti").drop("_key")


def new_titles(df: DataFrame, stored: DataFrame, within_day: bool = False) -> DataFrame:
    """Articles whose title is not stored yet, anywhere or on the same batch day."""
    on = ["title", "date"] if within_day else ["title"]
    return attach(df, stored.select(*on).distinct(), on, "left_anti").select(*df.columns)


def pending_days(collected: DataFrame, ingested: DataFrame) -> DataFrame:
    return collected.select("day").distinct().join(ingested.select("day").distinct(), "day", "left_anti")


def missing_days(done: DataFrame, start: str, end: str) -> DataFrame:
    """Calendar days of an inclusive range without a marker."""
    span = done.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )
    return span.join(done.select("day").distinct(), "day", "left_anti")


def distinct_keys(df: DataFrame) -> DataFrame:
    return df.select("date", "ticker").distinct()


def merge_articles(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.unionByName(new, allowMissingColumns=True)
