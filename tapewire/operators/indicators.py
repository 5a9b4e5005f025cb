"""Per-ticker series: returns, rolling news, technical indicators.

Bars hold one row per (ticker, trading day), so a per-ticker window is bounded by
the length of the trading calendar however many rows the table has in total; the
windows below rely on that and are never applied to article-level rows.
All indicators of one table share the same partitioning, hence one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from tapewire.functions.numeric import clip

NEUTRAL = {"rsi14": 50.0, "macd_hist": 0.0, "bb_pos": 0.5, "vol_ratio": 1.0, "price_trend": 1.0, "atr_pct": 0.0}


def series() -> WindowSpec:
    return W.partitionBy("ticker").orderBy("date")


def last_rows(n: int) -> WindowSpec:
    return series().rowsBetween(-(n - 1), 0)


def forward_return(bars: DataFrame, h: int = 1, keep_unlabelled: bool = False) -> DataFrame:
    """return_fwd = close[t+h]/close[t] - 1 and its 0/1 direction.

    The last h rows have no label: dropped for training, kept for inference.
    """
    ahead = F.lead("close", h).over(series())
    out = bars.withColumn("return_fwd", F.try_divide(ahead, F.col("close")) - 1).withColumn(
        "direction_fwd", (F.col("return_fwd") > 0).cast("int")
    )
    return out if keep_unlabelled else out.where(F.col("return_fwd").isNotNull())


def rolling_news(panel: DataFrame, windows: Sequence[int] = (3, 7)) -> DataFrame:
    """Mean sentiment and summed news count over the last n rows, fewer at the start."""
    cols = {}
    for n in windows:
        cols[f"sent_mean_roll{n}"] = F.avg("sent_mean").over(last_rows(n))
        cols[f"news_count_roll{n}"] = F.sum("news_count").over(last_rows(n))
    return panel.withColumns(cols)


def _moves(prev: Column, first: Column) -> dict[str, Column]:
    """Rise and fall since the row before."""
    delta = F.col("close") - prev
    # the first row has no delta, and greatest() would turn that NULL into 0
    return {"_up": F.when(~first, F.greatest(delta, F.lit(0.0))), "_dn": F.when(~first, F.greatest(-delta, F.lit(0.0)))}


def _rsi_value(gain: Column, loss: Column, flat_value: float = 50.0) -> Column:
    return F.coalesce(100 - 100 / (1 + F.try_divide(gain, loss)), F.lit(flat_value))


def rsi(df: DataFrame, n: int = 14, flat_value: float = 50.0, name: str = "rsi14") -> DataFrame:
    """Simple-mean RSI; a window without losses gives ``flat_value``."""
    df = df.withColumns(_moves(F.lag("close").over(series()), F.row_number().over(series()) == 1))
    gain, loss = F.avg("_up").over(last_rows(n)), F.avg("_dn").over(last_rows(n))
    return df.withColumn(name, _rsi_value(gain, loss, flat_value)).drop("_up", "_dn")


def _bollinger_value(mean: Column, std: Column, high: Column, low: Column, width: float = 2.0) -> Column:
    half = width * F.coalesce(std, F.lit(0.0))
    pos = clip(F.try_divide(F.col("close") - (mean - half), 2 * half), 0, 1)
    return F.when(high == low, 0.5).otherwise(F.coalesce(pos, F.lit(0.5)))


def bollinger_pos(df: DataFrame, n: int = 20, width: float = 2.0, name: str = "bb_pos") -> DataFrame:
    """Where the close sits between the bands, 0..1; a flat window gives 0.5."""
    w = last_rows(n)
    found = [f("close").over(w) for f in (F.avg, F.stddev_samp, F.max, F.min)]
    return df.withColumn(name, _bollinger_value(*found, width))


def _volume_value(mean: Column, cap: float = 10.0) -> Column:
    return clip(F.coalesce(F.try_divide(F.col("volume"), mean), F.lit(1.0)), 0, cap)


def volume_ratio(df: DataFrame, n: int = 20, cap: float = 10.0, name: str = "vol_ratio") -> DataFrame:
    return df.withColumn(name, _volume_value(F.avg("volume").over(last_rows(n)), cap))


def _trend_value(fast: Column, slow: Column) -> Column:
    return F.coalesce(F.try_divide(fast, slow), F.lit(1.0))


def price_trend(df: DataFrame, fast: int = 5, slow: int = 20, name: str = "price_trend") -> DataFrame:
    return df.withColumn(name, _trend_value(F.avg("close").over(last_rows(fast)), F.avg("close").over(last_rows(slow))))


def _true_range(prev: Column) -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def _atr_value(mean: Column) -> Column:
    return F.coalesce(F.try_divide(mean, F.col("close")), F.lit(0.0))


def atr_pct(df: DataFrame, n: int = 14, name: str = "atr_pct") -> DataFrame:
    """Mean true range over n rows divided by the close."""
    df = df.withColumn("_tr", _true_range(F.lag("close").over(series())))
    return df.withColumn(name, _atr_value(F.avg("_tr").over(last_rows(n)))).drop("_tr")


# ---- many trailing figures at once -------------------------------------------------------------


def _trailing_figures(values: np.ndarray, known: np.ndarray, place: np.ndarray, wanted: Mapping[str, tuple[str, int]]) -> dict[str, pa.Array]:
    """Figures (kind, n) of the last n rows of every row, oldest first and without NULLs, as Spark's window functions take them.

    ``place`` counts a row's predecessors in its series: a row that far back belongs to the series before.
    """
    out = {}
    size = len(values)
    for name, (kind, n) in wanted.items():
        count = np.zeros(size, np.int64)
        mean = np.zeros(size)
        acc = np.zeros(size) if kind in ("mean", "std") else np.full(size, -np.inf if kind == "max" else np.inf)
        for back in range(min(n, size) - 1, -1, -1):
            to, take = slice(back, size), slice(0, size - back)
            use = known[take] & (place[to] >= back)
            x = values[take]
            count[to] += use
            if kind == "mean":
                acc[to] += np.where(use, x, 0.0)
            elif kind == "std":
                delta = x - mean[to]
                step = delta / np.maximum(count[to], 1)
                mean[to] += np.where(use, step, 0.0)
                acc[to] += np.where(use, delta * (delta - step), 0.0)
            else:  # NaN is the largest number
                acc[to] = np.where(use, (np.maximum if kind == "max" else np.fmin)(acc[to], x), acc[to])
        least = 2 if kind == "std" else 1
        if kind in ("mean", "std"):
            acc = acc / np.maximum(count - (kind == "std"), 1)
        out[name] = pa.array(np.sqrt(acc) if kind == "std" else acc, mask=count < least)
    return out


def _trailing(df: DataFrame, wanted: Mapping[str, tuple[str, str, int]], place: str) -> DataFrame:
    """Adds figures name -> (kind, column, n) over each row's last n rows: mean, std, max and min, all in one pass.

    A sliding window of Spark walks its n rows for every row and figure.  The rows of a partition must come series by series in the order of
    ``place`` (0, 1, ...), as a window over them leaves them; the helper moves on by batches and keeps the last rows of the one before.
    """
    by_column: dict[str, dict[str, tuple[str, int]]] = {}
    for name, (kind, column, n) in wanted.items():
        by_column.setdefault(column, {})[name] = (kind, n)
    longest = max(n for _, _, n in wanted.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).select([place, *by_column])
            seen = rows if kept is None else pa.concat_tables([kept, rows])
            at = seen.column(place).to_numpy()
            if not ((at[1:] == at[:-1] + 1) | (at[1:] == 0)).all():
                raise ValueError("rows out of order")
            figures = {}
            with np.errstate(all="ignore"):
                for column, what in by_column.items():
                    c = seen.column(column).cast(pa.float64())
                    known = c.is_valid().to_numpy()
                    figures.update(_trailing_figures(c.fill_null(0.0).to_numpy(), known, at, what))
            skip = seen.num_rows - batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[figures[name].slice(skip) for name in wanted]], names=[*batch.schema.names, *wanted]
            )
            kept = seen.slice(max(0, seen.num_rows - longest + 1))

    schema = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], *[f"{name} double" for name in wanted]])
    return df.mapInArrow(run, schema)


EMA_CHUNK = 256


def _positions(df: DataFrame, chunk: int) -> DataFrame:
    df = df.withColumn("_pos", F.row_number().over(series()) - 1)
    return df.withColumns({"_chunk": F.floor(F.col("_pos") / chunk), "_i": F.col("_pos") % chunk})


def _ema(df: DataFrame, value: str, spans: Mapping[str, int], chunk: int) -> DataFrame:
    within = W.partitionBy("ticker", "_chunk").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    by_chunk = W.partitionBy("ticker").orderBy("_chunk")
    if min(spans.values()) < 2:
        raise ValueError("a span of one row is the value itself")
    keep = {name: 1 - 2 / (span + 1) for name, span in spans.items()}
    local, result = {}, {}
    for name, d in keep.items():
        weight = F.when(F.col("_pos") == 0, 1.0).otherwise(1 - d)
        scale = F.pow(F.lit(d), F.col("_i"))
        local[f"_l_{name}"] = scale * F.sum(F.col(value) * weight / scale).over(within)
        # what a chunk ends with, seen k chunks later; terms below one part in 10^18
        # cannot change a double
        end = F.when(F.col("_i") == chunk - 1, F.col(f"_l_{name}"))
        carry, k = F.lit(0.0), 1
        while d ** (chunk * (k - 1)) >= 1e-18:
            past = F.sum(end).over(by_chunk.rangeBetween(-k, -k))
            carry = carry + F.coalesce(past, F.lit(0.0)) * d ** (chunk * (k - 1))
            k += 1
        result[name] = F.col(f"_l_{name}") + F.pow(F.lit(d), F.col("_i") + 1) * carry
    return df.withColumns(local).withColumns(result).drop(*local)


def ema(df: DataFrame, value: str, spans: Mapping[str, int], chunk: int = EMA_CHUNK) -> DataFrame:
    """Exponential means seeded by the first value: y = (1-a)y' + a*x, a = 2/(span+1).

    The recursion is an affine map, so it is cut into chunks of rows.  Inside a chunk
    the part that starts from zero is a scaled running sum; what enters a chunk is the
    earlier chunks' ends, each damped by (1-a)^chunk per step, read through a range
    frame over chunk numbers.  No array is built, nothing is joined, and every window
    is partitioned by ticker, so the whole chain needs one shuffle.
    """
    return _ema(_positions(df, chunk), value, spans, chunk).drop("_pos", "_chunk", "_i")


def macd_hist(
    df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, name: str = "macd_hist", chunk: int = EMA_CHUNK
) -> DataFrame:
    """Fast minus slow exponential mean, less its own exponential mean."""
    return _macd_hist(_positions(df, chunk), fast, slow, signal, name, chunk).drop("_pos", "_chunk", "_i")


def _macd_hist(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, name: str = "macd_hist", chunk: int = EMA_CHUNK) -> DataFrame:
    df = _ema(df, "close", {"_fast": fast, "_slow": slow}, chunk)
    df = _ema(df.withColumn("_macd", F.col("_fast") - F.col("_slow")), "_macd", {"_signal": signal}, chunk)
    return df.withColumn(name, F.col("_macd") - F.col("_signal")).drop("_fast", "_slow", "_macd", "_signal")


def _history() -> Column:
    """A ticker's bars; the count shares the order of the other windows, and so their sort."""
    return F.count("*").over(series().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))


def min_history(bars: DataFrame, n: int = 20) -> DataFrame:
    """Drop tickers with fewer than n bars."""
    return bars.withColumn("_rows", _history()).where(F.col("_rows") >= n).drop("_rows")


def technicals(bars: DataFrame, min_rows: int = 20) -> DataFrame:
    """(ticker, date) with the six indicators, for tickers with enough history."""
    df = min_history(bars, min_rows) if min_rows else bars
    return with_technicals(df, ["ticker", "date"])


def technicals_or_neutral(bars: DataFrame, keep: Sequence[str], min_rows: int = 20) -> DataFrame:
    """The kept columns of every bar with its indicators, neutral where the ticker has too little history or a bar has no ticker or date."""
    df = with_technicals(bars.withColumn("_rows", _history()), list(dict.fromkeys([*keep, "ticker", "date", "_rows"])))
    there = (F.col("_rows") >= min_rows) & F.col("ticker").isNotNull() & F.col("date").isNotNull()
    return df.select(*keep, *[F.coalesce(F.when(there, F.col(c)), F.lit(v)).alias(c) for c, v in NEUTRAL.items()])


TRAILING = {
    "_gain": ("mean", "_up", 14), "_loss": ("mean", "_dn", 14), "_range": ("mean", "_tr", 14), "_volume20": ("mean", "volume", 20),
    "_mean5": ("mean", "close", 5), "_mean20": ("mean", "close", 20), "_std20": ("std", "close", 20), "_max20": ("max", "close", 20), "_min20": ("min", "close", 20),
}


def with_technicals(bars: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The kept columns of every bar with its six indicators.

    A task holds its rows once for each sort.  What the day before decides comes first, by date; MACD, whose windows go by chunk
    and place, has the second sort, and leaves the rows in the order in which the trailing means and deviations are taken.
    """
    s = series()
    df = bars.withColumns({"_prev": F.lag("close").over(s), "_pos": F.row_number().over(s) - 1})
    df = df.withColumns({**_moves(F.col("_prev"), F.col("_pos") == 0), "_tr": _true_range(F.col("_prev"))})
    df = df.select(*dict.fromkeys([*keep, "close", "volume", "_up", "_dn", "_tr", "_pos"]))
    df = _macd_hist(df.withColumns({"_chunk": F.floor(F.col("_pos") / EMA_CHUNK), "_i": F.col("_pos") % EMA_CHUNK})).drop("_chunk", "_i")
    df = _trailing(df, TRAILING, "_pos")
    c = F.col
    df = df.withColumns({
        "rsi14": _rsi_value(c("_gain"), c("_loss")), "bb_pos": _bollinger_value(c("_mean20"), c("_std20"), c("_max20"), c("_min20")),
        "vol_ratio": _volume_value(c("_volume20")), "price_trend": _trend_value(c("_mean5"), c("_mean20")), "atr_pct": _atr_value(c("_range")),
    })
    return df.select(*keep, *NEUTRAL)


def return_lags(bars: DataFrame) -> DataFrame:
    """Close-to-close returns known at t: today's, yesterday's, and their 5-row spread."""
    df = bars.withColumn("_r", F.try_divide(F.col("close"), F.lag("close").over(series())) - 1)
    df = df.withColumns(
        {
            "return_lag1": F.coalesce(F.col("_r"), F.lit(0.0)),
            "return_lag2": F.coalesce(F.lag("_r").over(series()), F.lit(0.0)),
        }
    ).drop("_r")
    return df.withColumn("vol_5d", F.coalesce(F.stddev_samp("return_lag1").over(last_rows(5)), F.lit(0.0)))


def _full(c: Column, n: int, over: str) -> Column:
    return F.when(F.count(over).over(last_rows(n)) == n, c)


def sma(df: DataFrame, spans: Sequence[int] = (20, 50)) -> DataFrame:
    """Simple moving averages, NULL until the window is full."""
    return df.withColumns({f"sma_{n}": _full(F.avg("close").over(last_rows(n)), n, "close") for n in spans})


def backtest_features(bars: DataFrame, h: int = 1) -> DataFrame:
    """Complete feature rows for the backtest: return, averages, spread, momentum, range, label."""
    s = series()
    df = forward_return(bars, h, keep_unlabelled=True)
    df = df.withColumn("daily_return", F.try_divide(F.col("close"), F.lag("close").over(s)) - 1)
    df = df.withColumns(
        {
            "sma_5": _full(F.avg("close").over(last_rows(5)), 5, "close"),
            "sma_20": _full(F.avg("close").over(last_rows(20)), 20, "close"),
            "volatility_5": _full(F.stddev_samp("daily_return").over(last_rows(5)), 5, "daily_return"),
            "momentum_5": F.try_divide(F.col("close"), F.lag("close", 5).over(s)) - 1,
            "volume_change": F.try_divide(F.col("volume"), F.lag("volume").over(s)) - 1,
            "high_low_range": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
        }
    )
    df = df.withColumn("sma_ratio", F.try_divide(F.col("sma_5"), F.col("sma_20")))
    used = [
        "daily_return", "sma_5", "sma_20", "sma_ratio", "volatility_5", "momentum_5", "volume_change", "high_low_range",
        "return_fwd",
    ]
    return df.select("ticker", "date", *used, "direction_fwd").dropna(subset=used)


def ohlc(bars: DataFrame, unit: str = "week") -> DataFrame:
    """Bars resampled to day, week, month, quarter or year."""
    return (
        bars.groupBy("ticker", F.to_date(F.date_trunc(unit, "date")).alias("date"))
        .agg(
            F.min_by("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


def price_history(bars: DataFrame, ticker: str, start, end, unit: str = "day") -> DataFrame:
    """One ticker's OHLCV rows between two dates at an interval."""
    picked = bars.where((F.col("ticker") == ticker) & F.col("date").between(start, end))
    return picked.select("ticker", "date", "open", "high", "low", "close", "volume") if unit == "day" else ohlc(picked, unit)


def sector_relative(df: DataFrame, column: str = "avg_sentiment", name: str = "sector_relative_sentiment") -> DataFrame:
    """Value minus its sector mean; the means are pre-aggregated and joined back, sectors may be hot."""
    from tapewire.operators.scale import dim_join

    means = df.groupBy("sector").agg(F.avg(column).alias("_mean"))
    return dim_join(df, means, ["sector"], "left").withColumn(name, F.col(column) - F.col("_mean")).drop("_mean")
