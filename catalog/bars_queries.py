"""Series queries: panel, labels, indicators, quotes, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import fix, fxs, query
from catalog.views import BARS, BARS_U, NEWS, QUOTES, bars, bars_u, news, quotes, table
from tapewire.operators import indicators as ind
from tapewire.operators import ranking
from tapewire.operators.intraday import intraday_bars
from tapewire.plans import panel as pn

PRICE = ("open", "high", "low", "close")
DAILY = """daily AS (
 SELECT ticker, date, count(*) AS news_count, avg(sentiment_compound) AS sent_mean,
  coalesce(stddev_samp(sentiment_compound), 0) AS sent_std, min(sentiment_compound) AS sent_min,
  max(sentiment_compound) AS sent_max, avg(relevance_score) AS relevance_mean,
  count(*) FILTER (impact_level = 'high') AS high_impact_count, count(*) FILTER (impact_level = 'macro') AS macro_count
 FROM news_events GROUP BY 1, 2)"""
LABELS_U = """labels_u AS (
 SELECT ticker, date, ahead / close - 1 AS return_fwd, CAST(ahead / close - 1 > 0 AS INTEGER) AS direction_fwd
 FROM (SELECT *, lead(close) OVER (PARTITION BY ticker ORDER BY date) AS ahead FROM bars_u) b WHERE ahead IS NOT NULL)"""
ZERO = ("news_count", "sent_mean", "sent_std", "sent_min", "sent_max", "relevance_mean", "high_impact_count", "macro_count")
PANEL = f"""panel AS (
 SELECT l.ticker, l.date, return_fwd, direction_fwd, {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0) AS {c}' for c in ZERO)}
 FROM labels_u l LEFT JOIN daily d ON l.ticker = d.ticker AND l.date = d.date)"""
ROLL = """rolled AS (
 SELECT *, avg(sent_mean) OVER w3 AS sent_mean_roll3, sum(news_count) OVER w3 AS news_count_roll3,
  avg(sent_mean) OVER w7 AS sent_mean_roll7, sum(news_count) OVER w7 AS news_count_roll7
 FROM panel WINDOW w3 AS (PARTITION BY ticker ORDER BY date ROWS 2 PRECEDING), w7 AS (PARTITION BY ticker ORDER BY date ROWS 6 PRECEDING))"""
PANEL_FIGS = ("return_fwd", *ZERO)
ROLL_FIGS = (*PANEL_FIGS, "sent_mean_roll3", "news_count_roll3", "sent_mean_roll7", "news_count_roll7")


def figs(cols):
    return ", ".join(f"{fxs(c)} AS {c}" for c in cols)


@query("daily_panel", f"WITH {NEWS}, {BARS_U}, {DAILY}, {LABELS_U}, {PANEL}, {ROLL} SELECT ticker, date, direction_fwd, {figs(ROLL_FIGS)} FROM rolled")
def daily_panel(spark, sf):
    return fix(pn.daily_panel(news(spark, sf), bars_u(spark, sf), with_technicals=False), *ROLL_FIGS)


@query("panel_base", f"WITH {NEWS}, {BARS_U}, {DAILY}, {LABELS_U}, {PANEL} SELECT ticker, date, direction_fwd, {figs(PANEL_FIGS)} FROM panel")
def panel_base(spark, sf):
    from tapewire.operators.aggregates import daily_news

    labels = ind.forward_return(bars_u(spark, sf)).select("ticker", "date", "return_fwd", "direction_fwd")
    return fix(pn.panel_base(labels, daily_news(news(spark, sf))), *PANEL_FIGS)


FWD5 = f"""WITH {BARS}, f AS (SELECT ticker, date, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS r FROM bars)
SELECT ticker, date, {fxs('r')} AS return_fwd, CAST(r > 0 AS INTEGER) AS direction_fwd FROM f WHERE r IS NOT NULL"""


@query("forward_return", FWD5)
def forward_return(spark, sf):
    out = ind.forward_return(bars(spark, sf), 5)
    return fix(out, "return_fwd").select("ticker", "date", "return_fwd", "direction_fwd")


W = "OVER (PARTITION BY ticker ORDER BY date ROWS {n} PRECEDING)"
PREV = "lag(close) OVER (PARTITION BY ticker ORDER BY date)"


def over(n):
    return W.format(n=n - 1)


RSI = f"""rsi AS (
 SELECT ticker, date, coalesce(100 - 100 / (1 + g / nullif(l, 0)), 50) AS rsi14 FROM (
  SELECT ticker, date, avg(up) {over(14)} AS g, avg(dn) {over(14)} AS l FROM (
   SELECT ticker, date, CASE WHEN d IS NULL THEN NULL WHEN d > 0 THEN d ELSE 0 END AS up,
    CASE WHEN d IS NULL THEN NULL WHEN d < 0 THEN -d ELSE 0 END AS dn
   FROM (SELECT ticker, date, close - {PREV} AS d FROM bars) a) b) c)"""
BB = f"""bb AS (
 SELECT ticker, date, CASE WHEN hi = lo THEN 0.5 ELSE greatest(0, least(1, (close - (m - 2 * s)) / (4 * s))) END AS bb_pos FROM (
  SELECT ticker, date, close, avg(close) {over(20)} AS m, coalesce(stddev_samp(close) {over(20)}, 0) AS s,
   max(close) {over(20)} AS hi, min(close) {over(20)} AS lo FROM bars) a)"""
VR = f"""vr AS (
 SELECT ticker, date, greatest(0, least(10, coalesce(volume / nullif(v, 0), 1))) AS vol_ratio
 FROM (SELECT ticker, date, volume, avg(volume) {over(20)} AS v FROM bars) a)"""
PT = f"pt AS (SELECT ticker, date, coalesce(avg(close) {over(5)} / nullif(avg(close) {over(20)}, 0), 1) AS price_trend FROM bars)"
ATR = f"""atr AS (
 SELECT ticker, date, coalesce(avg(tr) {over(14)} / nullif(close, 0), 0) AS atr_pct FROM (
  SELECT ticker, date, close, greatest(high - low, abs(high - p), abs(low - p)) AS tr FROM (
   SELECT *, {PREV} AS p FROM bars) a) b)"""


def one(name, cte, cte_name, col, fn):
    sql = f"WITH {BARS}, {cte} SELECT ticker, date, {fxs(col)} AS {col} FROM {cte_name}"

    @query(name, sql)
    def run(spark, sf):
        return fix(fn(bars(spark, sf)), col).select("ticker", "date", col)


one("rsi", RSI, "rsi", "rsi14", ind.rsi)
one("bollinger_pos", BB, "bb", "bb_pos", ind.bollinger_pos)
one("volume_ratio", VR, "vr", "vol_ratio", ind.volume_ratio)
one("price_trend", PT, "pt", "price_trend", ind.price_trend)
one("atr_pct", ATR, "atr", "atr_pct", ind.atr_pct)

# the recursion unrolled: y_t = sum over j of weight(j) * d^(t-j), first weight 1


def ema_cte(name, source, value, span):
    a = 2 / (span + 1)
    d = 1 - a
    return f"""{name} AS (
 SELECT t.ticker, t.pos, sum(s.{value} * CASE WHEN s.pos = 1 THEN 1 ELSE {a!r} END * pow({d!r}, t.pos - s.pos)) AS y
 FROM {source} t JOIN {source} s ON t.ticker = s.ticker AND s.pos <= t.pos GROUP BY 1, 2)"""


MACD = f"""p AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos FROM bars),
 {ema_cte('e12', 'p', 'close', 12)}, {ema_cte('e26', 'p', 'close', 26)},
 m AS (SELECT p.ticker, p.date, p.pos, e12.y - e26.y AS macd FROM p JOIN e12 ON p.ticker = e12.ticker AND p.pos = e12.pos
  JOIN e26 ON p.ticker = e26.ticker AND p.pos = e26.pos),
 {ema_cte('sg', 'm', 'macd', 9)},
 macd AS (SELECT m.ticker, m.date, m.macd - sg.y AS macd_hist FROM m JOIN sg ON m.ticker = sg.ticker AND m.pos = sg.pos)"""
one("macd_hist", MACD, "macd", "macd_hist", ind.macd_hist)

TECH = ("rsi14", "macd_hist", "bb_pos", "vol_ratio", "price_trend", "atr_pct")
BARS20 = "bars20 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS rows FROM bars) r WHERE rows >= 20)"
TECH_SQL = f"""WITH {BARS}, {BARS20}, {', '.join(c.replace('FROM bars)', 'FROM bars20)').replace('FROM bars) a', 'FROM bars20) a') for c in (RSI, BB, VR, PT, ATR, MACD))}
SELECT rsi.ticker, rsi.date, {figs(TECH)} FROM rsi JOIN bb USING (ticker, date) JOIN vr USING (ticker, date)
 JOIN pt USING (ticker, date) JOIN atr USING (ticker, date) JOIN macd USING (ticker, date)"""


@query("technicals", TECH_SQL)
def technicals(spark, sf):
    return fix(ind.technicals(bars(spark, sf)), *TECH)


@query(
    "add_technicals",
    f"""WITH {BARS}, {RSI}, {BB}, {VR}, {PT}, {ATR}, {MACD}, n AS (SELECT ticker, date, lead(close, 1) OVER (PARTITION BY ticker ORDER BY date) AS ahead FROM bars),
 t AS (SELECT * FROM rsi JOIN bb USING (ticker, date) JOIN vr USING (ticker, date) JOIN pt USING (ticker, date) JOIN atr USING (ticker, date)
  JOIN macd USING (ticker, date) WHERE rsi14 > 50)
SELECT n.ticker, n.date, {', '.join(f"{fxs(f'coalesce({c}, {v})')} AS {c}" for c, v in ind.NEUTRAL.items())}
FROM n LEFT JOIN t ON n.ticker = t.ticker AND n.date = t.date WHERE ahead IS NOT NULL""",
)
def add_technicals(spark, sf):
    b = bars(spark, sf)
    labels = ind.forward_return(b).select("ticker", "date")
    tech = ind.technicals(b, min_rows=0).where("rsi14 > 50")
    return fix(pn.add_technicals(labels, tech), *TECH).select("ticker", "date", *TECH)


@query(
    "return_lags",
    f"""WITH {BARS}, r AS (SELECT ticker, date, close / {PREV} - 1 AS r FROM bars),
 l AS (SELECT ticker, date, coalesce(r, 0) AS return_lag1, coalesce(lag(r) OVER (PARTITION BY ticker ORDER BY date), 0) AS return_lag2 FROM r)
SELECT ticker, date, {figs(('return_lag1', 'return_lag2'))}, {fxs(f'coalesce(stddev_samp(return_lag1) {over(5)}, 0)')} AS vol_5d FROM l""",
)
def return_lags(spark, sf):
    cols = ("return_lag1", "return_lag2", "vol_5d")
    return fix(ind.return_lags(bars(spark, sf)), *cols).select("ticker", "date", *cols)


@query(
    "sma_overlay",
    f"""WITH {BARS} SELECT ticker, date,
 CASE WHEN count(close) {over(20)} = 20 THEN {fxs(f'avg(close) {over(20)}')} END AS sma_20,
 CASE WHEN count(close) {over(50)} = 50 THEN {fxs(f'avg(close) {over(50)}')} END AS sma_50 FROM bars""",
)
def sma_overlay(spark, sf):
    return fix(ind.sma(bars(spark, sf)), "sma_20", "sma_50").select("ticker", "date", "sma_20", "sma_50")


BT = ("daily_return", "sma_5", "sma_20", "sma_ratio", "volatility_5", "momentum_5", "volume_change", "high_low_range", "return_fwd")
BT_CTE = f"""bt0 AS (
 SELECT *, close / lag(close) OVER s - 1 AS daily_return, close / lag(close, 5) OVER s - 1 AS momentum_5,
  volume / lag(volume) OVER s - 1 AS volume_change, (high - low) / close AS high_low_range, lead(close) OVER s / close - 1 AS return_fwd
 FROM bars WINDOW s AS (PARTITION BY ticker ORDER BY date)),
 bt1 AS (
 SELECT *, CASE WHEN count(close) {over(5)} = 5 THEN avg(close) {over(5)} END AS sma_5,
  CASE WHEN count(close) {over(20)} = 20 THEN avg(close) {over(20)} END AS sma_20,
  CASE WHEN count(daily_return) {over(5)} = 5 THEN stddev_samp(daily_return) {over(5)} END AS volatility_5 FROM bt0),
 bt AS (SELECT *, sma_5 / sma_20 AS sma_ratio, CAST(return_fwd > 0 AS INTEGER) AS direction_fwd FROM bt1
  WHERE sma_20 IS NOT NULL AND volatility_5 IS NOT NULL AND return_fwd IS NOT NULL AND momentum_5 IS NOT NULL AND volume_change IS NOT NULL)"""


@query("backtest_features", f"WITH {BARS}, {BT_CTE} SELECT ticker, date, {figs(BT)}, direction_fwd FROM bt")
def backtest_features(spark, sf):
    return fix(ind.backtest_features(bars(spark, sf)), *BT)


@query(
    "min_history",
    f"WITH {BARS} SELECT ticker, date, {fxs('close')} AS close FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM bars) b WHERE n >= 520",
)
def min_history(spark, sf):
    return fix(ind.min_history(bars(spark, sf), 520), "close").select("ticker", "date", "close")


@query(
    "last_quote",
    f"WITH {BARS}, {QUOTES} SELECT ticker, {figs(('price', 'previous_close', 'change', 'change_percent', 'volume'))} FROM quotes",
)
def last_quote(spark, sf):
    return fix(quotes(spark, sf), "price", "previous_close", "change", "change_percent", "volume")


def ohlc_sql(unit, where="TRUE"):
    return f"""WITH {BARS} SELECT ticker, CAST(date_trunc('{unit}', date) AS DATE) AS date, {fxs('min_by(open, date)')} AS open,
 {fxs('max(high)')} AS high, {fxs('min(low)')} AS low, {fxs('max_by(close, date)')} AS close, {fxs('sum(volume)')} AS volume
FROM bars WHERE {where} GROUP BY 1, 2"""


@query("price_history_weekly", ohlc_sql("week"))
def price_history_weekly(spark, sf):
    return fix(ind.ohlc(bars(spark, sf), "week"), *PRICE, "volume")


@query("price_history_monthly", ohlc_sql("month"))
def price_history_monthly(spark, sf):
    return fix(ind.ohlc(bars(spark, sf), "month"), *PRICE, "volume")


@query("price_history_ticker", ohlc_sql("week", "ticker = 'S7' AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"))
def price_history_ticker(spark, sf):
    return fix(ind.price_history(bars(spark, sf), "S7", "1996-01-01", "1997-12-31", "week"), *PRICE, "volume")


@query("gainers", f"WITH {BARS}, {QUOTES} SELECT ticker, {fxs('change_percent')} AS change_percent FROM quotes WHERE change_percent >= 0 ORDER BY quotes.change_percent DESC, ticker LIMIT 10")
def gainers(spark, sf):
    return fix(ranking.gainers(quotes(spark, sf)), "change_percent").select("ticker", "change_percent")


@query("losers", f"WITH {BARS}, {QUOTES} SELECT ticker, {fxs('change_percent')} AS change_percent FROM quotes WHERE change_percent <= 0 ORDER BY quotes.change_percent, ticker LIMIT 10")
def losers(spark, sf):
    return fix(ranking.losers(quotes(spark, sf)), "change_percent").select("ticker", "change_percent")


@query("most_active", f"WITH {BARS}, {QUOTES} SELECT ticker, {fxs('volume')} AS volume FROM quotes ORDER BY quotes.volume DESC, ticker LIMIT 10")
def most_active(spark, sf):
    return fix(ranking.most_active(quotes(spark, sf)), "volume").select("ticker", "volume")


@query(
    "union_tickers",
    f"WITH {BARS}, {BARS_U} SELECT ticker, count(*) AS bars, min(date) AS first_day, max(date) AS last_day FROM (SELECT ticker, date FROM bars UNION ALL SELECT ticker, date FROM bars_u) u GROUP BY 1",
)
def union_tickers(spark, sf):
    both = bars(spark, sf).select("ticker", "date").unionByName(bars_u(spark, sf).select("ticker", "date"))
    return both.groupBy("ticker").agg(
        F.count("*").alias("bars"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


# ---- inside a day ---------------------------------------------------------------------------------


def sessions(spark, sf):
    """Nine to five; Saturdays until one, no Sundays."""
    days = table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()
    hour = lambda h: F.timestamp_seconds(F.unix_seconds(F.col("date").cast("timestamp")) + h * 3600)
    close = F.when(F.dayofweek("date") == 7, hour(13)).otherwise(hour(17))
    return days.where(F.dayofweek("date") != 1).select("date", hour(9).alias("opens"), close.alias("closes"))


def intraday_sql(minutes):
    return f"""WITH t AS (SELECT 'U' || CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, ts, event_id, value AS price, CAST(ts AS DATE) + INTERVAL 9 HOUR AS opens,
  CAST(ts AS DATE) + CASE WHEN isodow(ts) = 6 THEN INTERVAL 13 HOUR ELSE INTERVAL 17 HOUR END AS closes FROM events WHERE isodow(ts) <> 7),
 b AS (SELECT ticker, date, opens, CAST(floor((epoch(date_trunc('second', ts)) - epoch(opens)) / {minutes * 60}) AS BIGINT) AS slot, min_by(price, (ts, event_id)) AS o, max(price) AS h, min(price) AS l,
   max_by(price, (ts, event_id)) AS c, sum(price) AS v, count(*) AS n FROM t WHERE ts >= opens AND ts < closes GROUP BY 1, 2, 3, 4),
 g AS (SELECT *, unnest(generate_series(slot, coalesce(lead(slot) OVER (PARTITION BY ticker, date ORDER BY slot) - 1, slot))) AS a FROM b)
SELECT ticker, date, CAST(opens + to_seconds(a * {minutes * 60}) AS TIMESTAMP) AS start, CASE WHEN a = slot THEN o ELSE c END AS open, CASE WHEN a = slot THEN h ELSE c END AS high,
 CASE WHEN a = slot THEN l ELSE c END AS low, c AS close, {fxs('CASE WHEN a = slot THEN v ELSE 0 END')} AS volume, CAST(CASE WHEN a = slot THEN n ELSE 0 END AS BIGINT) AS trades FROM g"""


def intraday(spark, sf, minutes):
    ticks = table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.col("value").alias("volume"), F.col("event_id").alias("tick_id"),
    )
    out = intraday_bars(ticks, sessions(spark, sf), minutes)
    return fix(out, "volume").withColumns({"start": F.col("start").cast("timestamp_ntz"), "trades": F.col("trades").cast("long")})


@query("intraday_5m", intraday_sql(5))
def intraday_5m(spark, sf):
    return intraday(spark, sf, 5)


@query("intraday_1h", intraday_sql(60))
def intraday_1h(spark, sf):
    return intraday(spark, sf, 60)
