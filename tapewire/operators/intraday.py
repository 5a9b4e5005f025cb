"""Bars inside trading sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire.operators.scale import dim_join


def intraday_bars(ticks: DataFrame, sessions: DataFrame, minutes: int, order: str = "tick_id") -> DataFrame:
    """Rows (ticker, date, start, open, high, low, close, volume, trades): bars of so many minutes from a session's opening on.

    ``ticks`` has (ticker, ts, price, volume) and a column that orders ticks of one moment; ``sessions`` has (date, opens, closes), one row a
    trading day.  Ticks outside every session are left out.  Between a ticker's first and last bar of a session a span without ticks gives empty
    bars: the close before, no volume, no trades.  Nothing is filled across sessions.

    Ticks are combined by bar before the shuffle; the window that finds gaps sees one row a bar of one ticker and session.
    """
    inside = dim_join(ticks.where("price IS NOT NULL").withColumn("date", F.to_date("ts")), sessions, ["date"])
    inside = inside.where((F.col("ts") >= F.col("opens")) & (F.col("ts") < F.col("closes")))
    step = minutes * 60
    slot = F.floor((F.unix_seconds("ts") - F.unix_seconds("opens")) / step)
    at = F.struct("ts", order)
    bars = inside.groupBy("ticker", "date", "opens", slot.alias("slot")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"), F.count("*").alias("trades"),
    )
    until = F.coalesce(F.lead("slot").over(W.partitionBy("ticker", "date").orderBy("slot")) - 1, F.col("slot"))
    rows = bars.withColumn("_upto", until).withColumn("_at", F.explode(F.sequence("slot", "_upto")))
    real = F.col("_at") == F.col("slot")
    price = lambda c: F.when(real, F.col(c)).otherwise(F.col("close")).alias(c)
    start = F.timestamp_seconds(F.unix_seconds("opens") + F.col("_at") * step)
    return rows.select(
        "ticker", "date", start.alias("start"), price("open"), price("high"), price("low"), "close",
        F.when(real, F.col("volume")).otherwise(0.0).alias("volume"), F.when(real, F.col("trades")).otherwise(0).alias("trades"),
    )
