"""Top-k lists, ranks, latest slices and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewire.operators.scale import global_row_number

BUY_CLASS = ("BUY", "STRONG BUY")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows; ``orderBy().limit`` keeps k rows per task, never a full sort."""
    return df.orderBy(*order).limit(k)


def newest_first_cap(df: DataFrame, n: int, time_col: str = "event_time", key: str = "article_id") -> DataFrame:
    """Newest first, undated last, first n rows; n <= 0 keeps all."""
    ordered = df.orderBy(F.desc_nulls_last(time_col), F.asc(key))
    return ordered if n <= 0 else ordered.limit(n)


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """A slice of the ordered rows; ``order`` must be total.

    A limited slice is a top-k of offset + limit rows.  Without a limit the rows behind the offset are numbered block by block, so
    no task holds the table.
    """
    if limit is not None:
        return df.orderBy(*order).offset(offset).limit(limit)
    if offset <= 0:
        return df.orderBy(*order)
    return global_row_number(df, order, "_rn").where(F.col("_rn") > offset).drop("_rn").orderBy(*order)


def top_predictions(preds: DataFrame, k: int = 10, min_news: int = 0, worst: bool = False) -> DataFrame:
    gate = preds.where(F.col("news_count") >= min_news)
    score = F.col("prediction_score")
    return top_k(gate, [score.asc() if worst else score.desc(), F.col("ticker")], k)


def gainers(quotes: DataFrame, k: int = 10) -> DataFrame:
    return top_k(quotes.where("change_percent >= 0"), [F.desc("change_percent"), F.asc("ticker")], k)


def losers(quotes: DataFrame, k: int = 10) -> DataFrame:
    """Worst first."""
    return top_k(quotes.where("change_percent <= 0"), [F.asc("change_percent"), F.asc("ticker")], k)


def most_active(quotes: DataFrame, k: int = 10) -> DataFrame:
    return top_k(quotes, [F.desc("volume"), F.asc("ticker")], k)


def top_picks(preds: DataFrame, k: int = 5, min_confidence: float = 0.4) -> DataFrame:
    picked = preds.where(F.col("recommendation").isin(*BUY_CLASS) & (F.col("confidence") > min_confidence))
    return top_k(picked, [F.desc("prediction_score"), F.asc("ticker")], k)


def value_counts_top(df: DataFrame, column: str, k: int) -> DataFrame:
    """Most frequent values, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return top_k(counts, [F.desc("n"), F.asc("value")], k)


def is_top_source(df: DataFrame, k: int = 10) -> DataFrame:
    """Flag rows whose source is among the k most frequent (k rows are broadcast)."""
    top = value_counts_top(df, "source", k).select(F.col("value").alias("source"), F.lit(1).alias("_top"))
    joined = df.join(F.broadcast(top), "source", "left")
    return joined.withColumn("is_top_source", F.coalesce(F.col("_top"), F.lit(0))).drop("_top")


def rank_recommend(preds: DataFrame, p: str = "ml_probability_up", name: str = "ml_recommendation") -> DataFrame:
    """Label by rank: the top and bottom 5 % are strong, the next ones up to 10 % plain.

    Each band has at least one member; where bands overlap on few rows buys win.  A row without a
    probability takes no part in the ranking and is a HOLD.
    Positions come from range-partitioned blocks, so no single task ranks the table.
    """
    unknown = preds.where(F.col(p).isNull()).withColumn(name, F.lit("HOLD"))
    ranked = global_row_number(preds.where(F.col(p).isNotNull()), [F.desc(p), F.asc("ticker")], "_down")
    n = ranked.agg(F.count("*")).scalar()
    ranked = ranked.withColumn("_n", n)
    # ascending order breaks ties by ticker too, so it is not just n - down + 1
    ranked = _ascending_position(ranked, p)
    strong = F.greatest(F.lit(1), F.bround(F.col("_n") * 0.05))
    plain = F.greatest(F.lit(1), F.bround(F.col("_n") * 0.10))
    rec = (
        F.when(F.col("_down") <= strong, "STRONG BUY")
        .when(F.col("_down") <= plain, "BUY")
        .when(F.col("_up") <= strong, "STRONG SELL")
        .when(F.col("_up") <= plain, "SELL")
        .otherwise("HOLD")
    )
    return ranked.withColumn(name, rec).drop("_down", "_up", "_n").unionByName(unknown)


def _ascending_position(ranked: DataFrame, p: str) -> DataFrame:
    """Ascending rank from the descending one: within a tie the ticker order is the same.

    For a value held by m rows at descending positions d0+1..d0+m, the ascending
    positions are n-d0-m+1..n-d0 in the same ticker order.
    """
    ties = ranked.groupBy(p).agg(F.min("_down").alias("_d1"), F.count("*").alias("_m"))
    from tapewire.operators.scale import attach

    joined = attach(ranked, ties, [p], "inner")
    return joined.withColumn(
        "_up", F.col("_n") - (F.col("_d1") - 1) - F.col("_m") + (F.col("_down") - F.col("_d1") + 1)
    ).drop("_d1", "_m")


def latest_slice(panel: DataFrame, news_only: bool = False) -> DataFrame:
    """Rows of the newest date, on request only those with news."""
    latest = panel.where(F.col("date") == panel.select(F.max("date")).scalar())
    return latest.where(F.col("news_count") > 0) if news_only else latest


def last_quote(bars: DataFrame) -> DataFrame:
    """Last close, previous close, change, per cent and volume of each ticker."""
    w = W.partitionBy("ticker").orderBy("date")
    rows = bars.where(F.col("close").isNotNull()).select(
        "ticker",
        "date",
        F.col("close").alias("price"),
        F.coalesce(F.lag("close").over(w), F.col("close")).alias("previous_close"),
        "volume",
    )
    last = rows.groupBy("ticker").agg(F.max_by(F.struct("price", "previous_close", "volume"), "date").alias("q"))
    change = F.col("price") - F.col("previous_close")
    return last.select("ticker", "q.*").select(
        "ticker",
        "price",
        "previous_close",
        change.alias("change"),
        F.coalesce(F.try_divide(change, F.col("previous_close")) * 100, F.lit(0.0)).alias("change_percent"),
        "volume",
    )
