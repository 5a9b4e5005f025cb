"""The (ticker, date) panel: labels, news aggregates, rolling features, indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.functions.scores import panel_interactions
from tapewire.operators.aggregates import NEWS_COLUMNS, daily_news
from tapewire.operators.indicators import NEUTRAL, forward_return, return_lags, rolling_news, technicals, technicals_or_neutral


def panel_base(labels: DataFrame, daily: DataFrame) -> DataFrame:
    """The label calendar with that day's news; days without news get zeros."""
    joined = labels.join(daily, ["ticker", "date"], "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NEWS_COLUMNS})


def add_technicals(panel: DataFrame, tech: DataFrame) -> DataFrame:
    """Indicators by (ticker, date); where there are none, neutral values."""
    joined = panel.join(tech, ["ticker", "date"], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in NEUTRAL.items()})


def daily_panel(
    news: DataFrame, bars: DataFrame, h: int = 1, with_technicals: bool = True, keep_unlabelled: bool = False
) -> DataFrame:
    """Model input: one row per ticker and trading day."""
    labels = forward_return(bars, h, keep_unlabelled).select("ticker", "date", "return_fwd", "direction_fwd")
    panel = rolling_news(panel_base(labels, daily_news(news)))
    return add_technicals(panel, technicals(bars)) if with_technicals else panel


def model_panel(news: DataFrame, bars: DataFrame, h: int = 1, keep_unlabelled: bool = True) -> DataFrame:
    """The panel plus past-return features and interactions, ready to split or score."""
    panel = daily_panel(news, bars, h, keep_unlabelled=keep_unlabelled)
    lags = return_lags(bars).select("ticker", "date", "return_lag1", "return_lag2", "vol_5d")
    return panel_interactions(panel.join(lags, ["ticker", "date"], "left").fillna(0.0, ["return_lag1", "return_lag2", "vol_5d"]))


def series_panel(daily: DataFrame, bars: DataFrame, h: int = 1) -> DataFrame:
    """``model_panel`` with unlabelled rows from daily news and bars of one row per ticker and date.

    Each bar carries its own label, returns and indicators, so that nothing is joined but the news.
    """
    lags = ["return_lag1", "return_lag2", "vol_5d"]
    rows = return_lags(forward_return(bars, h, keep_unlabelled=True))
    panel = rolling_news(panel_base(rows, daily))
    kept = [c for c in panel.columns if c not in bars.columns and c not in lags]
    panel = technicals_or_neutral(panel, ["ticker", "date", *kept, *lags])
    # a join by ticker and date finds nothing where one of them is missing
    known = F.col("ticker").isNotNull() & F.col("date").isNotNull()
    panel = panel.withColumns({c: F.when(known, F.col(c)) for c in lags}).select("ticker", "date", *kept, *NEUTRAL, *lags)
    return panel_interactions(panel.fillna(0.0, lags))
