"""Filtered, ordered, paged reads of articles, predictions and quotes.

Every predicate is optional and plain column logic, so equality and range tests reach
the Parquet scan and a date range prunes partitions.  Ordering always ends in a
unique key, which makes pages repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.functions.text import market_symbol
from tapewire.operators.ranking import page
from tapewire.operators.scale import dim_join


def _contains(c: str, needle: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle.lower())


def _bounds(df: DataFrame, column: str, low, high, null_as: float | None = None) -> DataFrame:
    c = F.col(column) if null_as is None else F.coalesce(F.col(column), F.lit(null_as))
    if low is not None:
        df = df.where(c >= low)
    return df if high is None else df.where(c <= high)


def search_news(
    news: DataFrame,
    as_of: str,
    ticker: str | None = None,
    source: str | None = None,
    min_sentiment: float | None = None,
    max_sentiment: float | None = None,
    impact: str | None = None,
    days: int | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Articles matching all given predicates, newest first; missing sentiment counts as 0."""
    out = news
    if ticker:
        out = out.where(F.col("ticker") == ticker.strip().upper())
    if source:
        out = out.where(_contains("source", source))
    if impact:
        out = out.where(F.col("impact_level") == impact)
    if days is not None:
        out = lookback(out, days, as_of)
    out = _bounds(out, "sentiment_compound", min_sentiment, max_sentiment, null_as=0.0)
    return page(out, [F.desc_nulls_last("event_time"), F.asc("article_id")], offset, limit)


def search_predictions(
    preds: DataFrame,
    ticker: str | None = None,
    sector: str | None = None,
    recommendation: str | None = None,
    min_score: float | None = None,
    max_score: float | None = None,
    min_confidence: float | None = None,
    min_news: int | None = None,
    max_news: int | None = None,
    sort_by: str = "prediction_score",
    desc: bool = True,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    out = preds
    if ticker:
        out = out.where(F.col("ticker") == ticker.strip().upper())
    if sector:
        out = out.where(_contains("sector", sector))
    if recommendation:
        out = out.where(F.col("recommendation") == recommendation.upper())
    out = _bounds(out, "prediction_score", min_score, max_score)
    out = _bounds(out, "confidence", min_confidence, None)
    out = _bounds(out, "news_count", min_news, max_news)
    return page(out, [F.desc(sort_by) if desc else F.asc(sort_by), F.asc("ticker")], offset, limit)


def search_quotes(
    quotes: DataFrame,
    sector: str | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    min_change: float | None = None,
    max_change: float | None = None,
    sort_by: str = "ticker",
    desc: bool = True,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    out = quotes.where(F.col("price") > 0)
    if sector:
        out = out.where(_contains("sector", sector))
    out = _bounds(out, "price", min_price, max_price)
    out = _bounds(out, "change_percent", min_change, max_change)
    return page(out, [F.desc(sort_by) if desc else F.asc(sort_by), F.asc("ticker")], offset, limit)


def page_counts(found: DataFrame, offset: int, limit: int) -> DataFrame:
    """How many rows match and how many a page of them returns, named apart."""
    left = F.greatest(F.col("total_rows") - offset, F.lit(0))
    return found.agg(F.count("*").alias("total_rows")).withColumn(
        "returned_rows", F.least(left, F.lit(limit)).cast("long")
    )


def lookup(df: DataFrame, ticker: str) -> DataFrame:
    """One ticker's row."""
    return df.where(F.col("ticker") == market_symbol(F.lit(ticker)))


def lookback(news: DataFrame, days: int, as_of: str) -> DataFrame:
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return news.where(F.col("event_time") >= since)


def history_slice(news: DataFrame, start: str, end: str, day: str = "date") -> DataFrame:
    """Articles of an inclusive range of batch days; on a partitioned store only those are read."""
    return news.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def recent(news: DataFrame, days: int, as_of: str, day: str = "date") -> DataFrame:
    until = F.lit(as_of).cast("date")
    return news.where((F.col(day) >= F.date_sub(until, days)) & (F.col(day) <= until))


def in_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    return dim_join(df, universe.select("ticker"), ["ticker"], "left_semi")
