"""Per-article classifier inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.operators.joins import merge_back_daily
from tapewire.operators.matching import keyword_flags
from tapewire.operators.ranking import is_top_source


def article_features(news: DataFrame, top_sources: int = 10, categories: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Sentiment, impact, relevance, calendar and per-day features of each article.

    ``categories`` (name to terms) adds a ``has_`` flag each, found in the title before anything is joined.
    """
    if categories:
        news = keyword_flags(news, "title", categories, "has_")
    s, rel = F.col("sentiment_compound"), F.col("relevance_score")
    hour = F.hour("event_time")
    flag = lambda c: c.cast("int")
    df = merge_back_daily(is_top_source(news, top_sources))
    return df.withColumns(
        {
            "sentiment_strength": F.abs(s),
            "is_positive": flag(s > 0.05),
            "is_negative": flag(s < -0.05),
            "is_neutral": flag(s.between(-0.05, 0.05)),
            "is_high_impact": flag(F.col("impact_level") == "high"),
            "is_macro": flag(F.col("impact_level") == "macro"),
            "is_medium_impact": flag(F.col("impact_level") == "medium"),
            "high_relevance": flag(rel > 0.7),
            "weekday": F.weekday("event_time"),
            "hour": hour,
            "is_weekend": flag(F.weekday("event_time") >= 5),
            "is_market_hours": flag(hour.between(9, 16)),
            "sentiment_squared": s * s,
            "sentiment_momentum": s * F.abs(s),
            "sentiment_x_relevance": s * rel,
            "sentiment_x_impact": s * flag(F.col("impact_level") == "high"),
        }
    )
