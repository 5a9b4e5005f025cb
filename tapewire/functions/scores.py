"""Scores, recommendations and derived features as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.functions.numeric import clip, ladder

BUYS = ("BUY", "STRONG BUY")
SELLS = ("SELL", "STRONG SELL")


def label_sentiment(c: Column) -> Column:
    """Five labels; the cut points are half and a twentieth, inclusive on both sides."""
    return (
        F.when(c >= 0.5, "Very Positive")
        .when(c >= 0.05, "Positive")
        .when(c <= -0.5, "Very Negative")
        .when(c <= -0.05, "Negative")
        .otherwise("Neutral")
    )


@dataclass(frozen=True)
class Ladder:
    """Cut points of the five recommendations."""

    strong_buy: float
    buy: float
    sell: float
    strong_sell: float


SCORE_LADDER = Ladder(0.5, 0.2, -0.2, -0.5)
SENTIMENT_LADDER = Ladder(0.5, 0.15, -0.15, -0.5)
PANEL_PROBABILITY = Ladder(0.66, 0.56, 0.44, 0.34)
TICKER_PROBABILITY = Ladder(0.75, 0.60, 0.40, 0.25)


def recommend(score: Column, cuts: Ladder = SCORE_LADDER) -> Column:
    """STRONG BUY .. STRONG SELL by cut points, all inclusive."""
    return (
        F.when(score >= cuts.strong_buy, "STRONG BUY")
        .when(score >= cuts.buy, "BUY")
        .when(score <= cuts.strong_sell, "STRONG SELL")
        .when(score <= cuts.sell, "SELL")
        .otherwise("HOLD")
    )


@dataclass(frozen=True)
class ScoreWeights:
    sentiment: float = 0.6
    momentum: float = 0.3
    volume: float = 0.1
    change_scale: float = 10.0
    full_volume: float = 20.0


def prediction_score(
    avg_sentiment: Column, change_percent: Column, news_count: Column, w: ScoreWeights = ScoreWeights()
) -> Column:
    """Weighted sentiment, price momentum and news volume in [-1, 1]."""
    momentum = clip(change_percent / w.change_scale, -1, 1) * w.momentum
    volume = F.least(news_count / w.full_volume, F.lit(1.0)) * w.volume
    return clip(avg_sentiment * w.sentiment + momentum + volume, -1, 1)


def prediction_score_amplified(avg_sentiment: Column, change_percent: Column, news_count: Column) -> Column:
    """Sentiment-heavy variant: strong sentiment is amplified, volume follows its sign."""
    sentiment = avg_sentiment * F.when(F.abs(avg_sentiment) > 0.3, 1.5).otherwise(1.0) * 0.7
    momentum = clip(change_percent / 5.0, -1, 1) * 0.2
    tier = ladder(news_count, [(50, 0.1), (20, 0.08), (10, 0.05), (5, 0.03)], 0.01)
    return clip(sentiment + momentum + tier * F.signum(avg_sentiment), -1, 1)


def model_confidence(p: Column) -> Column:
    return F.abs(p - 0.5) * 2


def model_score(p: Column) -> Column:
    return (p - 0.5) * 2


def strong_conflict(rec: Column, sentiment: Column, news_count: Column) -> Column:
    """The model says one thing and clearly worded news the other."""
    against_buy = rec.isin(*BUYS) & (sentiment < -0.3)
    against_sell = rec.isin(*SELLS) & (sentiment > 0.3)
    return (news_count > 0) & (against_buy | against_sell)


def fallback_probability(sentiment: Column) -> Column:
    return clip(F.bround(0.5 + sentiment * 0.3, 4), 0.05, 0.95)


def merge_model(df: DataFrame) -> DataFrame:
    """Final recommendation and confidence of tickers with or without a model score.

    With a model score its label holds unless it conflicts with strong news, which
    gives HOLD.  Without one the sentiment ladder and its probability stand in.
    """
    sent = F.coalesce(F.col("avg_sentiment"), F.lit(0.0))
    scored = F.col("ml_probability_up").isNotNull()
    conflict = strong_conflict(F.col("ml_recommendation"), sent, F.col("news_count"))
    own = recommend(sent, SENTIMENT_LADDER)
    stand_in = fallback_probability(sent)
    stand_in_conf = F.bround(F.abs(sent) * 0.6, 4)
    base_conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    model_rec = F.when(conflict, "HOLD").otherwise(F.col("ml_recommendation"))
    return df.select(
        *[c for c in df.columns if c not in MERGED],
        F.when(scored, F.col("ml_probability_up")).otherwise(stand_in).alias("ml_probability_up"),
        F.when(scored, F.col("ml_confidence")).otherwise(stand_in_conf).alias("ml_confidence"),
        F.when(scored, F.col("ml_score")).otherwise(F.bround(model_score(stand_in), 4)).alias("ml_score"),
        F.when(scored, model_rec).otherwise(own).alias("ml_recommendation"),
        F.when(scored, model_rec)
        .otherwise(F.coalesce(F.col("sentiment_recommendation"), own))
        .alias("recommendation"),
        F.bround(
            F.greatest(base_conf, F.when(scored, F.coalesce(F.col("ml_confidence"), F.lit(0.0))).otherwise(stand_in_conf)),
            3,
        ).alias("confidence"),
        F.when(scored, "model").otherwise("sentiment-only").alias("ml_source"),
    )


MERGED = (
    "ml_probability_up", "ml_confidence", "ml_score", "ml_recommendation", "recommendation", "confidence", "ml_source",
)


def ticker_features(df: DataFrame) -> DataFrame:
    """Classifier inputs of one row per ticker."""
    sent, n, chg = F.col("avg_sentiment"), F.col("news_count"), F.col("price_change_percent")
    return df.withColumns(
        {
            "sentiment_strength": F.abs(sent),
            "sentiment_direction": (sent > 0).cast("int"),
            "has_news": (n > 0).cast("int"),
            "high_news_volume": (n >= 5).cast("int"),
            "log_news_count": F.log1p(n),
            "price_momentum": F.when(chg > 1, 1).when(chg < -1, -1).otherwise(0),
            "strong_momentum": (F.abs(chg) > 2).cast("int"),
            "sentiment_news_interaction": sent * F.log1p(n),
            "pos_neg_ratio": F.col("positive_news") / F.greatest(F.col("negative_news"), F.lit(1)),
            "sentiment_imbalance": F.col("positive_news") - F.col("negative_news"),
            "weighted_sentiment": sent * F.col("confidence"),
        }
    )


def panel_interactions(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "sent_news_interaction": F.col("sent_mean") * F.log1p("news_count"),
            "sent_range": F.col("sent_max") - F.col("sent_min"),
        }
    )


def move_labels(df: DataFrame, change: str = "change_percent", big: float = 2.0) -> DataFrame:
    c = F.col(change)
    return df.withColumns(
        {
            "price_up": (c > 0).cast("int"),
            "price_down": (c < 0).cast("int"),
            "significant_move": (F.abs(c) > big).cast("int"),
        }
    )


def direction(c: Column, flat: float = 0.0) -> Column:
    return F.when(c > flat, "up").when(c < -flat, "down").otherwise("flat")


def direction_hit(df: DataFrame, predicted: str = "prediction_score", actual: str = "change_percent") -> DataFrame:
    """Predicted and realised signs and whether they agree."""
    return df.withColumns(
        {"predicted_direction": direction(F.col(predicted)), "actual_direction": direction(F.col(actual))}
    ).withColumn("correct", (F.col("predicted_direction") == F.col("actual_direction")).cast("int"))
