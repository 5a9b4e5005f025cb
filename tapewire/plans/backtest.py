"""Train on the earlier dates, trade the later ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.operators.indicators import backtest_features
from tapewire.operators.metrics import accuracy_by_confidence, binary_metrics, cumulative_return, trades, trading_summary
from tapewire.operators.scale import checkpointed
from tapewire.plans.model import BACKTEST_FEATURES, Forest, fit, forest, probability_up


@dataclass(frozen=True)
class Backtest:
    scored: DataFrame
    metrics: DataFrame
    by_confidence: DataFrame
    daily: DataFrame
    summary: DataFrame


def date_cut(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """One row: the date below which ``share`` of the dates lie (dates are few)."""
    days = rows.select(F.unix_date("date").alias("d")).distinct()
    return days.agg(F.date_from_unix_date(F.floor(F.percentile("d", share)).cast("int")).alias("cut"))


def split_by_date(rows: DataFrame, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Earlier dates train, later dates test, across all tickers alike."""
    cut = date_cut(rows, share).scalar()
    return rows.where(F.col("date") <= cut), rows.where(F.col("date") > cut)


def run(bars: DataFrame, trees: int = 100, depth: int = 10, share: float = 0.7, min_confidence: float = 0.6, seed: int = 42) -> Backtest:
    """Scaled random forest on the backtest features, metrics and trading result on the test dates."""
    rows = checkpointed(backtest_features(bars))  # the fit and every figure read it
    train, test = split_by_date(rows, share)
    model = fit(train, forest(Forest(trees, depth, 5), "direction_fwd", seed), BACKTEST_FEATURES, scale=True)
    scored = checkpointed(probability_up(model, test, BACKTEST_FEATURES).select(
        "ticker", "date", "return_fwd", F.col("direction_fwd").alias("label"), "probability",
        (F.col("probability") >= 0.5).cast("int").alias("predicted"),
    ))
    taken = trades(scored, min_confidence)
    return Backtest(
        scored, binary_metrics(scored, score="probability"), accuracy_by_confidence(scored), cumulative_return(taken), trading_summary(taken)
    )
