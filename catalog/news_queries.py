"""Article and prediction summaries, top-k lists, searches and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import fix, fxs, query
from catalog.views import (
    ARTICLES, BARS, BARS_U, DIM, DIM_U, NEWS, QUOTES, articles, bars_u, customer_dim, news, quotes, scored, table, ticker_dim,
)
from tapewire.functions import scores as sc
from tapewire.operators import aggregates as ag
from tapewire.operators import ranking, search
from tapewire.operators.indicators import sector_relative

S = "sentiment_compound"
AS_OF = "2024-01-31 00:00:00"
HIGH = "count(*) FILTER (impact_level = 'high')"


def figs(cols, digits=6):
    return ", ".join(f"{fxs(c, digits)} AS {c}" for c in cols)


# ---- daily and per-ticker aggregates ---------------------------------------------------------

DAY_FIGS = ("sent_mean", "sent_std", "sent_min", "sent_max", "relevance_mean")


@query(
    "daily_news",
    f"""WITH {NEWS} SELECT ticker, date, count(*) AS news_count, {fxs(f'avg({S})')} AS sent_mean,
 {fxs(f'coalesce(stddev_samp({S}), 0)')} AS sent_std, {fxs(f'min({S})')} AS sent_min, {fxs(f'max({S})')} AS sent_max,
 {fxs('avg(relevance_score)')} AS relevance_mean, {HIGH} AS high_impact_count, count(*) FILTER (impact_level = 'macro') AS macro_count
FROM news_events GROUP BY 1, 2""",
)
def daily_news(spark, sf):
    return fix(ag.daily_news(news(spark, sf)), *DAY_FIGS)


REC = """CASE WHEN m >= 0.4 AND p > 2 * q THEN 'STRONG BUY' WHEN m >= 0.15 THEN 'BUY'
  WHEN m <= -0.4 AND q > 2 * p THEN 'STRONG SELL' WHEN m <= -0.15 THEN 'SELL' ELSE 'HOLD' END"""
CONF = """least(0.99, 0.4 * CASE WHEN n >= 50 THEN 0.95 WHEN n >= 20 THEN 0.85 WHEN n >= 10 THEN 0.75 WHEN n >= 5 THEN 0.65 ELSE 0.5 END
  + 0.4 * least(1, 2 * abs(a)) + 0.2 * greatest(0, 1 - 2 * v))"""
SUMM = f"""summ AS (
 SELECT ticker, n, m, p, q, {REC} AS rec, {CONF} AS conf FROM (
  SELECT ticker, count(*) AS n, sum(w * s) / sum(w) AS m, count(*) FILTER (s > 0.05) AS p, count(*) FILTER (s < -0.05) AS q, avg(s) AS a, var_pop(s) AS v
  FROM (SELECT ticker, {S} AS s, exp(-greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(event_time)) / 3.6e9) / 24.0) AS w FROM news_events) x GROUP BY 1) y)"""


@query(
    "ticker_sentiment",
    f"""WITH {NEWS}, {SUMM} SELECT ticker, n AS article_count, {fxs('m')} AS avg_sentiment, p AS positive_count, q AS negative_count,
 n - p - q AS neutral_count, rec AS recommendation, {fxs('conf')} AS confidence FROM summ""",
)
def ticker_sentiment(spark, sf):
    return fix(ag.ticker_sentiment(news(spark, sf), AS_OF), "avg_sentiment", "confidence")


@query(
    "sentiment_confidence",
    f"""WITH {NEWS}, g AS (SELECT ticker, date, count(*) AS n, avg({S}) AS a, var_pop({S}) AS v FROM news_events GROUP BY 1, 2)
SELECT ticker, date, {fxs(CONF)} AS confidence FROM g""",
)
def sentiment_confidence(spark, sf):
    g = news(spark, sf).groupBy("ticker", "date").agg(F.count("*").alias("n"), F.avg(S).alias("a"), F.var_pop(S).alias("v"))
    out = g.withColumn("confidence", ag.sentiment_confidence(F.col("n"), F.col("a"), F.col("v")))
    return fix(out, "confidence").select("ticker", "date", "confidence")


@query(
    "recent_articles",
    f"""WITH {NEWS} SELECT ticker, article_id, {fxs(S)} AS {S}, CAST(rn AS INTEGER) AS rn FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_time DESC, article_id) AS rn FROM news_events) x WHERE rn <= 5""",
)
def recent_articles(spark, sf):
    return fix(ag.recent_articles(news(spark, sf)).select("ticker", "article_id", S, "rn"), S)


@query(
    "sentiment_distribution",
    f"""WITH {NEWS} SELECT count(*) FILTER (s >= 0.5) AS very_positive, count(*) FILTER (s >= 0.05 AND s < 0.5) AS positive,
 count(*) FILTER (s > -0.05 AND s < 0.05) AS neutral, count(*) FILTER (s <= -0.05 AND s > -0.5) AS negative,
 count(*) FILTER (s <= -0.5) AS very_negative, count(*) AS total, {fxs('avg(s)')} AS avg_sentiment FROM (SELECT {S} AS s FROM news_events) x""",
)
def sentiment_distribution(spark, sf):
    return fix(ag.sentiment_distribution(news(spark, sf)), "avg_sentiment")


@query(
    "news_summary",
    f"""WITH {NEWS} SELECT count(*) AS total, {fxs(f'avg({S})')} AS avg_sentiment, count(*) FILTER ({S} > 0.05) AS positive,
 count(*) FILTER ({S} < -0.05) AS negative, count(*) FILTER ({S} BETWEEN -0.05 AND 0.05) AS neutral, {HIGH} AS high_impact FROM news_events""",
)
def news_summary(spark, sf):
    return fix(ag.news_summary(news(spark, sf)), "avg_sentiment")


@query(
    "news_top_lists",
    f"""WITH {NEWS}, s AS (SELECT 'source' AS list, source AS value, count(*) AS n FROM news_events GROUP BY source ORDER BY n DESC, value LIMIT 20),
 t AS (SELECT 'ticker' AS list, ticker AS value, count(*) AS n FROM news_events GROUP BY ticker ORDER BY n DESC, value LIMIT 20)
SELECT * FROM s UNION ALL SELECT * FROM t""",
)
def news_top_lists(spark, sf):
    return ag.top_lists(news(spark, sf))


# ---- predictions -------------------------------------------------------------------------------
# users as tickers: sentiment summary joined to the quote of their value series

QUOTES_U = QUOTES.replace("quotes AS", "quotes_u AS").replace("FROM bars)", "FROM bars_u)")
MOMENTUM = "greatest(-1, least(1, chg / 10))"
SCORE = "greatest(-1, least(1, 0.6 * avg_sentiment + 0.3 * greatest(-1, least(1, chg / 10)) + 0.1 * least(1, news_count / 20.0)))"
FIVE = "CASE WHEN {c} >= {a} THEN 'STRONG BUY' WHEN {c} >= {b} THEN 'BUY' WHEN {c} <= {d} THEN 'STRONG SELL' WHEN {c} <= {e} THEN 'SELL' ELSE 'HOLD' END"


def five(c, a, b, e, d):
    return FIVE.format(c=c, a=a, b=b, d=d, e=e)


PREDS = f"""{DIM_U}, base AS (
 SELECT s.ticker, coalesce(d.sector, 'Unknown') AS sector, coalesce(d.company_name, s.ticker) AS company_name, q.price, q.change_percent AS chg, s.n AS news_count, s.m AS avg_sentiment,
  s.p AS pos, s.q AS neg, s.conf AS confidence, s.rec AS srec FROM summ s JOIN quotes_u q ON s.ticker = q.ticker LEFT JOIN customer_dim d ON s.ticker = d.ticker WHERE q.price > 0),
 preds AS (SELECT *, {SCORE} AS prediction_score, {five(SCORE, 0.5, 0.2, -0.2, -0.5)} AS recommendation FROM base)"""
WITH_PREDS = f"WITH {NEWS}, {BARS_U}, {QUOTES_U}, {SUMM}, {PREDS}"


def preds(spark, sf):
    from tapewire.operators.joins import ticker_signals

    summary = ag.ticker_sentiment(news(spark, sf), AS_OF)
    q = ranking.last_quote(bars_u(spark, sf))
    return ticker_signals(summary.select("ticker"), summary, q, customer_dim(spark, sf))


@query(
    "ticker_signals",
    WITH_PREDS + f""" SELECT ticker, company_name, sector, {fxs('avg_sentiment', 4)} AS news_sentiment_score, {fxs(MOMENTUM, 4)} AS momentum_normalized, {fxs('price')} AS price, {fxs('chg')} AS price_change_percent, news_count, {fxs('avg_sentiment')} AS avg_sentiment,
 pos AS positive_news, neg AS negative_news, {fxs('prediction_score')} AS prediction_score, recommendation, srec AS sentiment_recommendation,
 {fxs('confidence')} AS confidence FROM preds""",
)
def ticker_signals(spark, sf):
    p = fix(preds(spark, sf), "price", "price_change_percent", "avg_sentiment", "prediction_score", "confidence")
    return fix(p, "news_sentiment_score", "momentum_normalized", digits=4)


@query(
    "ticker_signals_universe",
    f"""WITH {BARS}, {QUOTES}, {ARTICLES}, n AS (SELECT ticker, count(*) AS n FROM articles GROUP BY 1)
SELECT q.ticker, {fxs('price')} AS price, coalesce(n, 0) AS news_count, {fxs('greatest(-1, least(1, 0.3 * greatest(-1, least(1, change_percent / 10)) + 0.1 * least(1, coalesce(n, 0) / 20.0)))')} AS prediction_score,
 CASE WHEN n IS NULL THEN 'HOLD' ELSE 'N/A' END AS sentiment_recommendation FROM quotes q LEFT JOIN n ON q.ticker = n.ticker WHERE price > 0""",
)
def ticker_signals_universe(spark, sf):
    from tapewire.operators.joins import ticker_signals as join_signals

    u = ticker_dim(spark, sf).select("ticker")
    summary = (
        articles(spark, sf)
        .groupBy("ticker")
        .agg(F.count("*").alias("article_count"))
        .select(
            "ticker", "article_count", F.lit(0.0).alias("avg_sentiment"), F.lit(0).cast("long").alias("positive_count"),
            F.lit(0).cast("long").alias("negative_count"), F.lit("N/A").alias("recommendation"), F.lit(0.0).alias("confidence"),
        )
    )
    out = join_signals(u, summary, quotes(spark, sf))
    return fix(out.select("ticker", "price", "news_count", "prediction_score", "sentiment_recommendation"), "price", "prediction_score")


@query(
    "prediction_summary",
    WITH_PREDS + f""" SELECT recommendation, count(*) AS n, {fxs('avg(avg_sentiment)')} AS avg_sentiment, {fxs('avg(confidence)')} AS avg_confidence FROM preds GROUP BY 1
UNION ALL SELECT 'ALL', count(*), {fxs('avg(avg_sentiment)')}, {fxs('avg(confidence)')} FROM preds""",
)
def prediction_summary(spark, sf):
    return fix(ag.prediction_summary(preds(spark, sf)), "avg_sentiment", "avg_confidence")


@query(
    "sector_ranking",
    WITH_PREDS + f""", g AS (SELECT sector, count(*) AS n, avg(prediction_score) AS s FROM preds GROUP BY 1),
 a AS (SELECT *, 'top' AS list FROM g ORDER BY s DESC, sector LIMIT 5), b AS (SELECT *, 'bottom' AS list FROM g ORDER BY s, sector LIMIT 5)
SELECT sector, n, {fxs('s')} AS avg_score, list FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x""",
)
def sector_ranking(spark, sf):
    return fix(ag.sector_ranking(preds(spark, sf)), "avg_score")


@query(
    "coverage_metrics",
    WITH_PREDS + f""" SELECT {fxs('avg(CASE WHEN news_count > 0 THEN 1 ELSE 0 END)')} AS share_with_news, {fxs('avg(news_count)')} AS avg_news,
 {fxs('avg(CASE WHEN confidence >= 0.7 THEN 1 ELSE 0 END)')} AS share_confident FROM preds""",
)
def coverage_metrics(spark, sf):
    return fix(ag.coverage_metrics(preds(spark, sf)), "share_with_news", "avg_news", "share_confident")


@query(
    "market_summary",
    f"""WITH {BARS}, {QUOTES} SELECT count(*) AS valid, count(*) FILTER (change_percent > 0) AS gainers, count(*) FILTER (change_percent < 0) AS losers,
 count(*) FILTER (change_percent = 0) AS unchanged, {fxs('avg(change_percent)')} AS avg_change FROM quotes WHERE price > 0""",
)
def market_summary(spark, sf):
    return fix(ag.market_summary(quotes(spark, sf)), "avg_change")


@query(
    "market_lists",
    f"""WITH {BARS}, {QUOTES}, g AS (SELECT *, 'gainers' AS list FROM quotes ORDER BY change_percent DESC, ticker LIMIT 10),
 l AS (SELECT *, 'losers' AS list FROM quotes ORDER BY change_percent, ticker LIMIT 10), a AS (SELECT *, 'most_active' AS list FROM quotes ORDER BY volume DESC, ticker LIMIT 10)
SELECT ticker, {figs(('change_percent', 'volume'))}, list FROM (SELECT * FROM g UNION ALL SELECT * FROM l UNION ALL SELECT * FROM a) x""",
)
def market_lists(spark, sf):
    return fix(ag.market_lists(quotes(spark, sf)), "change_percent", "volume")


# ---- pattern statistics ---------------------------------------------------------------------

SBIN = f"""CASE WHEN {S} < -1 THEN NULL WHEN {S} <= -0.5 THEN 'very_negative' WHEN {S} <= -0.1 THEN 'negative' WHEN {S} <= 0.1 THEN 'neutral'
 WHEN {S} <= 0.5 THEN 'positive' WHEN {S} <= 1 THEN 'very_positive' END"""


@query(
    "sentiment_range_stats",
    f"WITH {NEWS} SELECT {SBIN} AS bin, count(*) AS n, {fxs(f'avg({S})')} AS avg_sentiment, {HIGH} AS high_impact FROM news_events GROUP BY 1",
)
def sentiment_range_stats(spark, sf):
    return fix(ag.sentiment_range_stats(news(spark, sf)), "avg_sentiment")


STATS = f"""count(*) AS n, {fxs(f'avg({S})')} AS avg_sentiment, {fxs(f'coalesce(stddev_samp({S}), 0)')} AS std_sentiment, {HIGH} AS high_impact,
 {fxs('avg(relevance_score)')} AS avg_relevance"""
STAT_FIGS = ("avg_sentiment", "std_sentiment", "avg_relevance")


@query(
    "source_stats",
    f"""WITH {NEWS}, g AS (SELECT source, {STATS} FROM news_events GROUP BY 1), v AS (SELECT *, 'volume' AS list FROM g ORDER BY n DESC, source LIMIT 10),
 h AS (SELECT *, 'high_impact' AS list FROM g ORDER BY high_impact DESC, source LIMIT 10) SELECT * FROM v UNION ALL SELECT * FROM h""",
)
def source_stats(spark, sf):
    return fix(ag.source_stats(news(spark, sf)), *STAT_FIGS)


@query("impact_stats", f"WITH {NEWS} SELECT impact_level, {STATS} FROM news_events GROUP BY 1".replace(f"{HIGH} AS high_impact,", ""))
def impact_stats(spark, sf):
    return fix(ag.impact_stats(news(spark, sf)), *STAT_FIGS)


@query(
    "ticker_stats",
    f"""WITH {NEWS}, g AS (SELECT ticker, {STATS}, avg({S}) AS a FROM news_events GROUP BY 1),
 v AS (SELECT *, 'volume' AS list FROM g ORDER BY n DESC, ticker LIMIT 20), p AS (SELECT *, 'most_positive' AS list FROM g ORDER BY a DESC, ticker LIMIT 10),
 q AS (SELECT *, 'most_negative' AS list FROM g ORDER BY a, ticker LIMIT 10), h AS (SELECT *, 'high_impact' AS list FROM g ORDER BY high_impact DESC, ticker LIMIT 10)
SELECT * EXCLUDE (a) FROM (SELECT * FROM v UNION ALL SELECT * FROM p UNION ALL SELECT * FROM q UNION ALL SELECT * FROM h) x""",
)
def ticker_stats(spark, sf):
    return fix(ag.ticker_stats(news(spark, sf)), *STAT_FIGS)


@query(
    "temporal_stats",
    f"""WITH {NEWS} SELECT dayname(event_time) AS bucket, count(*) AS n, {fxs(f'avg({S})')} AS avg_sentiment, {HIGH} AS high_impact, 'weekday' AS kind FROM news_events GROUP BY 1
UNION ALL SELECT CAST(hour(event_time) AS VARCHAR), count(*), {fxs(f'avg({S})')}, {HIGH}, 'hour' FROM news_events GROUP BY 1""",
)
def temporal_stats(spark, sf):
    return fix(ag.temporal_stats(news(spark, sf)), "avg_sentiment")


@query(
    "busiest_hours",
    f"WITH {NEWS} SELECT CAST(hour(event_time) AS INTEGER) AS hour, count(*) AS n FROM news_events GROUP BY 1 ORDER BY n DESC, hour LIMIT 5",
)
def busiest_hours(spark, sf):
    return ag.busiest_hours(news(spark, sf))


VBIN = "CASE WHEN n <= 2 THEN 'low' WHEN n <= 5 THEN 'medium' WHEN n <= 10 THEN 'high' ELSE 'very_high' END"


@query(
    "volume_stats",
    f"""WITH {NEWS}, d AS (SELECT date, ticker, count(*) AS n FROM news_events GROUP BY 1, 2)
SELECT {VBIN} AS bin, count(*) AS ticker_days, {fxs('avg(n)')} AS avg_articles, max(n) AS max_articles FROM d GROUP BY 1""",
)
def volume_stats(spark, sf):
    return fix(ag.volume_stats(news(spark, sf)), "avg_articles")


@query(
    "volume_totals",
    f"WITH {NEWS} SELECT count(*) AS articles, count(DISTINCT ticker) AS tickers, {fxs('count(*) / count(DISTINCT ticker)')} AS articles_per_ticker FROM news_events",
)
def volume_totals(spark, sf):
    return fix(ag.volume_totals(news(spark, sf)), "articles_per_ticker")


@query(
    "sentiment_verdict",
    f"""WITH {NEWS}, v AS (SELECT avg(CASE WHEN {S} > 0.05 THEN 1 ELSE 0 END) AS p, avg(CASE WHEN {S} < -0.05 THEN 1 ELSE 0 END) AS q FROM news_events)
SELECT {fxs('p')} AS positive_share, {fxs('q')} AS negative_share, CASE WHEN p > 0.6 THEN 'bullish' WHEN q > 0.6 THEN 'bearish' ELSE 'mixed' END AS verdict FROM v""",
)
def sentiment_verdict(spark, sf):
    return fix(ag.sentiment_verdict(news(spark, sf)), "positive_share", "negative_share")


def long_sql(pattern, key, group, metrics, source="news_events"):
    return " UNION ALL ".join(
        f"SELECT '{pattern}' AS pattern, CAST({key} AS VARCHAR) AS key, '{m}' AS metric, {fxs(e)} AS value FROM {source} GROUP BY {group}"
        for m, e in metrics.items()
    )


BASIC = {"n": "count(*)", "avg_sentiment": f"avg({S})", "high_impact": HIGH}
FULL = {**BASIC, "std_sentiment": f"coalesce(stddev_samp({S}), 0)", "avg_relevance": "avg(relevance_score)"}
REPORT = f"""WITH {NEWS}, d AS (SELECT date, ticker, count(*) AS n FROM news_events GROUP BY 1, 2)
{long_sql('sentiment_range', SBIN, SBIN, BASIC)} UNION ALL {long_sql('source', 'source', 'source', FULL)}
UNION ALL {long_sql('temporal', 'dayname(event_time)', 'dayname(event_time)', BASIC)} UNION ALL {long_sql('temporal', 'hour(event_time)', 'hour(event_time)', BASIC)}
UNION ALL {long_sql('volume', VBIN, VBIN, {'ticker_days': 'count(*)', 'avg_articles': 'avg(n)', 'max_articles': 'max(n)'}, 'd')}
UNION ALL {long_sql('impact', 'impact_level', 'impact_level', {k: v for k, v in FULL.items() if k != 'high_impact'})}
UNION ALL {long_sql('ticker', 'ticker', 'ticker', FULL)}
UNION ALL SELECT 'verdict', CASE WHEN p > 0.6 THEN 'bullish' WHEN q > 0.6 THEN 'bearish' ELSE 'mixed' END, m, v FROM (
 SELECT p, q, unnest(['positive_share', 'negative_share']) AS m, unnest([{fxs('p')}, {fxs('q')}]) AS v FROM (
  SELECT avg(CASE WHEN {S} > 0.05 THEN 1 ELSE 0 END) AS p, avg(CASE WHEN {S} < -0.05 THEN 1 ELSE 0 END) AS q FROM news_events) x) y"""


@query("pattern_report", REPORT)
def pattern_report(spark, sf):
    return fix(ag.pattern_report(news(spark, sf)), "value")


# ---- stored batches and exploration --------------------------------------------------------

BATCH_FIGS = ("avg_sentiment", "positive_pct", "negative_pct")


@query(
    "batch_stats",
    f"""WITH {NEWS}, g AS (SELECT date AS batch_date, count(*) AS articles, count(*) FILTER ({S} > 0.05) AS positive, count(*) FILTER ({S} < -0.05) AS negative, avg({S}) AS avg_sentiment FROM news_events GROUP BY 1)
SELECT batch_date, articles, positive, articles - positive - negative AS neutral, negative, {fxs('avg_sentiment')} AS avg_sentiment,
 {fxs('positive / articles * 100')} AS positive_pct, {fxs('negative / articles * 100')} AS negative_pct FROM g""",
)
def batch_stats(spark, sf):
    return fix(ag.batch_stats(news(spark, sf)), *BATCH_FIGS)


@query(
    "store_metadata",
    f"WITH {NEWS} SELECT count(DISTINCT date) AS batches, count(*) AS articles, min(date) AS earliest, max(date) AS latest FROM news_events",
)
def store_metadata(spark, sf):
    return ag.store_metadata(news(spark, sf))


@query(
    "eda_value_counts",
    f"""WITH {NEWS} SELECT 'source' AS field, source AS value, count(*) AS n FROM news_events GROUP BY 2
UNION ALL SELECT 'impact_level', impact_level, count(*) FROM news_events GROUP BY 2""",
)
def eda_value_counts(spark, sf):
    return ag.value_counts(news(spark, sf), ["source", "impact_level"])


@query(
    "sentiment_profile",
    f"""WITH {NEWS} SELECT count(*) AS n, {fxs(f'avg({S})')} AS mean, {fxs(f'min({S})')} AS min, {fxs(f'max({S})')} AS max,
 count(*) FILTER ({S} > 0.5) AS above_half, count(*) FILTER ({S} < -0.5) AS below_half, {fxs(f'quantile_cont({S}, 0.5)')} AS median FROM news_events""",
)
def sentiment_profile(spark, sf):
    return fix(ag.sentiment_profile(news(spark, sf)), "mean", "min", "max", "median")


@query(
    "sector_stats",
    WITH_PREDS + f""" SELECT sector, {fxs('avg(prediction_score)')} AS avg_score, {fxs('avg(avg_sentiment)')} AS avg_sentiment, CAST(sum(news_count) AS BIGINT) AS news_count, count(*) AS tickers FROM preds GROUP BY 1""",
)
def sector_stats(spark, sf):
    return fix(ag.sector_stats(preds(spark, sf)), "avg_score", "avg_sentiment")


CORR = ("quantity", "price", "discount", "tax")


@query(
    "correlation_matrix",
    "WITH l AS (SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {fxs(f'corr({a}, {b})')} AS r FROM l" for a in CORR for b in CORR),
)
def correlation_matrix(spark, sf):
    l = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )
    return fix(ag.correlation_matrix(l, CORR), "r")


DESC = ("l_quantity", "l_discount", "l_tax")


@query(
    "describe_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, count({c}) AS n, {fxs(f'avg({c})')} AS mean, {fxs(f'stddev_samp({c})')} AS std, {fxs(f'min({c})')} AS min, {fxs(f'max({c})')} AS max FROM lineitem"
        for c in DESC
    ),
)
def describe_columns(spark, sf):
    return fix(ag.describe_columns(table(spark, sf, "lineitem"), DESC), "mean", "std", "min", "max")


@query(
    "training_profile",
    f"WITH {NEWS} "
    + " UNION ALL ".join(
        f"SELECT 'numeric' AS kind, '{c}' AS field, '{m}' AS metric, {fxs(e.format(c=c))} AS value FROM news_events"
        for c in (S, "relevance_score")
        for m, e in {"n": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})"}.items()
    )
    + f" UNION ALL SELECT 'label', 'impact_level', impact_level, {fxs('count(*) * 100.0 / (SELECT count(*) FROM news_events)')} FROM news_events GROUP BY impact_level",
)
def training_profile(spark, sf):
    return fix(ag.training_profile(news(spark, sf), [S, "relevance_score"], ["impact_level"]), "value")


# ---- dashboard ------------------------------------------------------------------------------


@query("daily_sentiment_trend", f"WITH {NEWS} SELECT date, {fxs(f'avg({S})')} AS avg_sentiment FROM news_events WHERE ticker = 'U7' GROUP BY 1")
def daily_sentiment_trend(spark, sf):
    return fix(ag.daily_sentiment_trend(news(spark, sf), "U7"), "avg_sentiment")


@query(
    "recommendation_mix",
    WITH_PREDS + f" SELECT recommendation AS value, count(*) AS n, {fxs('count(*) * 100.0 / (SELECT count(*) FROM preds)')} AS pct FROM preds GROUP BY 1",
)
def recommendation_mix(spark, sf):
    return fix(ag.share_of_total(preds(spark, sf), "recommendation"), "pct")


@query(
    "source_share",
    f"WITH s AS (SELECT source AS value, count(*) AS n FROM documents GROUP BY 1) SELECT value, n, {fxs('n * 100.0 / (SELECT count(*) FROM documents)')} AS pct FROM s ORDER BY n DESC, value LIMIT 10",
)
def source_share(spark, sf):
    return fix(ag.share_of_total(table(spark, sf, "documents"), "source", 10), "pct")


@query(
    "sector_rollup_other",
    f"""WITH {DIM}, c AS (SELECT CASE WHEN industry = 'NATION_24' OR trim(industry) = '' THEN 'Unknown' ELSE industry END AS s, count(*) AS n FROM ticker_dim GROUP BY 1),
 k AS (SELECT s FROM c WHERE s <> 'Unknown' ORDER BY n DESC, s LIMIT 4)
SELECT CASE WHEN s = 'Unknown' THEN s WHEN s IN (SELECT s FROM k) THEN s ELSE 'Other' END AS sector, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
)
def sector_rollup_other(spark, sf):
    dim = ticker_dim(spark, sf).select(F.when(F.col("industry") != "NATION_24", F.col("industry")).otherwise("n/a").alias("sector"))
    return ag.sector_rollup_other(dim, 4)


BUYS, SELLS = "recommendation IN ('BUY', 'STRONG BUY')", "recommendation IN ('SELL', 'STRONG SELL')"


@query(
    "market_verdict",
    WITH_PREDS + f""", v AS (SELECT count(*) FILTER ({BUYS}) AS buys, count(*) FILTER ({SELLS}) AS sells FROM preds)
SELECT *, CASE WHEN buys > 1.5 * sells THEN 'bullish' WHEN sells > 1.5 * buys THEN 'bearish' ELSE 'neutral' END AS verdict FROM v""",
)
def market_verdict(spark, sf):
    return ag.market_verdict(preds(spark, sf))


@query(
    "dashboard_metrics",
    WITH_PREDS + f""" SELECT count(*) FILTER ({BUYS}) AS buys, count(*) FILTER (recommendation = 'HOLD') AS holds, count(*) FILTER ({SELLS}) AS sells,
 {fxs('avg(confidence) FILTER (news_count > 0)')} AS avg_confidence, {fxs('count(*) FILTER (avg_sentiment > 0.05) * 100.0 / count(*)')} AS positive_pct,
 {fxs('count(*) FILTER (avg_sentiment < -0.05) * 100.0 / count(*)')} AS negative_pct FROM preds""",
)
def dashboard_metrics(spark, sf):
    return fix(ag.dashboard_metrics(preds(spark, sf)), "avg_confidence", "positive_pct", "negative_pct")


@query(
    "sector_performance",
    f"WITH {BARS}, {QUOTES}, {DIM} SELECT sector, {fxs('avg(change_percent)')} AS avg_change_percent FROM quotes JOIN ticker_dim USING (ticker) GROUP BY 1",
)
def sector_performance(spark, sf):
    return fix(ag.sector_performance(quotes(spark, sf).join(ticker_dim(spark, sf), "ticker")), "avg_change_percent")


# ---- rankings -------------------------------------------------------------------------------


@query("newest_first_cap", f"WITH {NEWS} SELECT article_id, ticker FROM news_events ORDER BY event_time DESC, article_id LIMIT 500")
def newest_first_cap(spark, sf):
    return ranking.newest_first_cap(news(spark, sf), 500).select("article_id", "ticker")


for _name, _worst, _order in (("top_predictions", False, "DESC"), ("bottom_predictions", True, "ASC")):

    @query(
        _name,
        WITH_PREDS + f" SELECT ticker, {fxs('prediction_score')} AS prediction_score, news_count FROM preds WHERE news_count >= 10 ORDER BY preds.prediction_score {_order}, ticker LIMIT 10",
    )
    def _top(spark, sf, worst=_worst):
        out = ranking.top_predictions(preds(spark, sf), 10, 10, worst)
        return fix(out, "prediction_score").select("ticker", "prediction_score", "news_count")


@query(
    "top_picks",
    WITH_PREDS + f" SELECT ticker, {fxs('prediction_score')} AS prediction_score, {fxs('confidence')} AS confidence FROM preds WHERE {SELLS.replace('SELL', 'BUY')} AND confidence > 0.4 ORDER BY preds.prediction_score DESC, ticker LIMIT 5",
)
def top_picks(spark, sf):
    return fix(ranking.top_picks(preds(spark, sf)), "prediction_score", "confidence").select("ticker", "prediction_score", "confidence")


@query("high_impact_news", f"WITH {NEWS} SELECT article_id, ticker, source FROM news_events WHERE impact_level = 'high' ORDER BY event_time DESC, article_id LIMIT 20")
def high_impact_news(spark, sf):
    rows = news(spark, sf).where("impact_level = 'high'")
    return ranking.newest_first_cap(rows, 20).select("article_id", "ticker", "source")


@query("page", WITH_PREDS + f" SELECT ticker, {fxs('confidence')} AS confidence FROM preds ORDER BY preds.confidence DESC, ticker LIMIT 20 OFFSET 30")
def page(spark, sf):
    out = ranking.page(preds(spark, sf), [F.desc("confidence"), F.asc("ticker")], 30, 20)
    return fix(out, "confidence").select("ticker", "confidence")


@query("value_counts_top", "SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def value_counts_top(spark, sf):
    return ranking.value_counts_top(table(spark, sf, "documents"), "source", 10)


@query(
    "is_top_source",
    "WITH t AS (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 10) SELECT doc_id, CAST(source IN (SELECT source FROM t) AS INTEGER) AS is_top_source FROM documents",
)
def is_top_source(spark, sf):
    return ranking.is_top_source(table(spark, sf, "documents").select("doc_id", "source")).select("doc_id", "is_top_source")


@query(
    "rank_recommend",
    WITH_PREDS + f""", r AS (SELECT ticker, (prediction_score + 1) / 2 AS p, row_number() OVER (ORDER BY (prediction_score + 1) / 2 DESC, ticker) AS d,
  row_number() OVER (ORDER BY (prediction_score + 1) / 2, ticker) AS u, count(*) OVER () AS n FROM preds),
 b AS (SELECT *, greatest(1, round_even(n * 0.05, 0)) AS s, greatest(1, round_even(n * 0.10, 0)) AS k FROM r)
SELECT ticker, {fxs('p')} AS ml_probability_up, CASE WHEN d <= s THEN 'STRONG BUY' WHEN d <= k THEN 'BUY' WHEN u <= s THEN 'STRONG SELL' WHEN u <= k THEN 'SELL' ELSE 'HOLD' END AS ml_recommendation FROM b""",
)
def rank_recommend(spark, sf):
    p = preds(spark, sf).select("ticker", ((F.col("prediction_score") + 1) / 2).alias("ml_probability_up"))
    return fix(ranking.rank_recommend(p), "ml_probability_up")


@query(
    "latest_slice",
    f"""WITH {NEWS}, {BARS_U}, d AS (SELECT b.ticker, b.date, coalesce(n, 0) AS news_count FROM bars_u b LEFT JOIN (SELECT ticker, date, count(*) AS n FROM news_events WHERE {S} > 0 GROUP BY 1, 2) x ON b.ticker = x.ticker AND b.date = x.date),
 l AS (SELECT * FROM d WHERE date = (SELECT max(date) FROM d))
SELECT ticker, date, news_count FROM l""",
)
def latest_slice(spark, sf):
    per_day = news(spark, sf).where(F.col(S) > 0).groupBy("ticker", "date").agg(F.count("*").alias("news_count"))
    panel = bars_u(spark, sf).select("ticker", "date").join(per_day, ["ticker", "date"], "left").fillna(0, ["news_count"])
    return ranking.latest_slice(panel)


# ---- scores ---------------------------------------------------------------------------------



@query(
    "prediction_score",
    WITH_PREDS + f" SELECT ticker, {fxs('0.6 * avg_sentiment')} AS sentiment_part, {fxs('0.3 * greatest(-1, least(1, chg / 10))')} AS momentum_part, {fxs('prediction_score')} AS prediction_score FROM preds",
)
def prediction_score(spark, sf):
    p = preds(spark, sf)
    w = sc.ScoreWeights()
    from tapewire.functions.numeric import clip

    out = p.select(
        "ticker",
        (F.col("avg_sentiment") * w.sentiment).alias("sentiment_part"),
        (clip(F.col("price_change_percent") / w.change_scale, -1, 1) * w.momentum).alias("momentum_part"),
        "prediction_score",
    )
    return fix(out, "sentiment_part", "momentum_part", "prediction_score")


AMP = """greatest(-1, least(1, avg_sentiment * CASE WHEN abs(avg_sentiment) > 0.3 THEN 1.5 ELSE 1 END * 0.7 + 0.2 * greatest(-1, least(1, chg / 5))
 + sign(avg_sentiment) * CASE WHEN news_count >= 50 THEN 0.1 WHEN news_count >= 20 THEN 0.08 WHEN news_count >= 10 THEN 0.05 WHEN news_count >= 5 THEN 0.03 ELSE 0.01 END))"""


@query("prediction_score_amplified", WITH_PREDS + f" SELECT ticker, {fxs(AMP)} AS score FROM preds")
def prediction_score_amplified(spark, sf):
    p = preds(spark, sf)
    score = sc.prediction_score_amplified(F.col("avg_sentiment"), F.col("price_change_percent"), F.col("news_count"))
    return fix(p.select("ticker", score.alias("score")), "score")


@query(
    "recommend",
    f"WITH {NEWS} SELECT article_id, {five(S, 0.5, 0.2, -0.2, -0.5)} AS by_score, {five(S, 0.5, 0.15, -0.15, -0.5)} AS by_sentiment FROM news_events",
)
def recommend(spark, sf):
    c = F.col(S)
    return news(spark, sf).select("article_id", sc.recommend(c).alias("by_score"), sc.recommend(c, sc.SENTIMENT_LADDER).alias("by_sentiment"))


@query(
    "recommend_probability",
    f"WITH {NEWS}, p AS (SELECT article_id, ({S} + 1) / 2 AS p FROM news_events) SELECT article_id, {five('p', 0.66, 0.56, 0.44, 0.34)} AS panel_rec, {five('p', 0.75, 0.6, 0.4, 0.25)} AS ticker_rec FROM p",
)
def recommend_probability(spark, sf):
    p = F.col("probability")
    return scored(spark, sf).select(
        "article_id", sc.recommend(p, sc.PANEL_PROBABILITY).alias("panel_rec"), sc.recommend(p, sc.TICKER_PROBABILITY).alias("ticker_rec")
    )


@query(
    "model_confidence",
    f"WITH {NEWS}, p AS (SELECT article_id, ({S} + 1) / 2 AS p FROM news_events) SELECT article_id, {fxs('abs(p - 0.5) * 2')} AS ml_confidence, {fxs('(p - 0.5) * 2')} AS ml_score FROM p",
)
def model_confidence(spark, sf):
    p = F.col("probability")
    out = scored(spark, sf).select("article_id", sc.model_confidence(p).alias("ml_confidence"), sc.model_score(p).alias("ml_score"))
    return fix(out, "ml_confidence", "ml_score")


# a stand-in model: relevance as probability, for tickers with no fewer high-impact than macro articles
MODEL = f"""model AS (SELECT ticker, avg(relevance_score) * 2 - 0.5 AS p FROM news_events GROUP BY 1 HAVING count(*) FILTER (impact_level = 'high') >= count(*) FILTER (impact_level = 'macro')),
 merged AS (SELECT b.*, m.p AS mp, {five('m.p', 0.52, 0.505, 0.495, 0.48)} AS mrec FROM preds b LEFT JOIN model m ON b.ticker = m.ticker)"""
CONFLICT = "news_count > 0 AND ((avg_sentiment < -0.3 AND mrec IN ('BUY', 'STRONG BUY')) OR (avg_sentiment > 0.3 AND mrec IN ('SELL', 'STRONG SELL')))"


@query(
    "resolve_conflict",
    WITH_PREDS + f", {MODEL} SELECT ticker, CASE WHEN {CONFLICT} THEN 'HOLD' ELSE mrec END AS recommendation, {fxs('greatest(confidence, abs(mp - 0.5) * 2)', 3)} AS confidence FROM merged WHERE mp IS NOT NULL",
)
def resolve_conflict(spark, sf):
    from tapewire.operators.joins import merge_model_scores

    out = merge_model_scores(preds(spark, sf), _model(spark, sf)).where("ml_source = 'model'")
    return fix(out.select("ticker", "recommendation", "confidence"), "confidence", digits=3)


@query(
    "sentiment_fallback",
    WITH_PREDS + f", {MODEL} SELECT ticker, {fxs('greatest(0.05, least(0.95, 0.5 + 0.3 * avg_sentiment))', 4)} AS ml_probability_up, {fxs('0.6 * abs(avg_sentiment)', 4)} AS ml_confidence, srec AS recommendation FROM merged WHERE mp IS NULL",
)
def sentiment_fallback(spark, sf):
    from tapewire.operators.joins import merge_model_scores

    out = merge_model_scores(preds(spark, sf), _model(spark, sf)).where("ml_source = 'sentiment-only'")
    return fix(out.select("ticker", "ml_probability_up", "ml_confidence", "recommendation"), "ml_probability_up", "ml_confidence", digits=4)


def _model(spark, sf):
    p = (
        news(spark, sf)
        .groupBy("ticker")
        .agg(
            (F.avg("relevance_score") * 2 - 0.5).alias("ml_probability_up"),
            (F.count_if(F.col("impact_level") == "high") >= F.count_if(F.col("impact_level") == "macro")).alias("known"),
        )
        .where("known")
        .drop("known")
    )
    c = F.col("ml_probability_up")
    return p.withColumns(
        {
            "ml_confidence": sc.model_confidence(c),
            "ml_score": sc.model_score(c),
            "ml_recommendation": sc.recommend(c, sc.Ladder(0.52, 0.505, 0.495, 0.48)),
        }
    )


@query(
    "merge_model_scores",
    WITH_PREDS + f""", {MODEL} SELECT ticker, CASE WHEN mp IS NULL THEN 'sentiment-only' ELSE 'model' END AS ml_source,
 CASE WHEN mp IS NULL THEN srec WHEN {CONFLICT} THEN 'HOLD' ELSE mrec END AS recommendation,
 CASE WHEN mp IS NULL THEN {five('avg_sentiment', 0.5, 0.15, -0.15, -0.5)} WHEN {CONFLICT} THEN 'HOLD' ELSE mrec END AS ml_recommendation FROM merged""",
)
def merge_model_scores(spark, sf):
    from tapewire.operators.joins import merge_model_scores as merge

    return merge(preds(spark, sf), _model(spark, sf)).select("ticker", "ml_source", "recommendation", "ml_recommendation")


TF = ("sentiment_strength", "log_news_count", "sentiment_news_interaction", "pos_neg_ratio", "weighted_sentiment")


@query(
    "ticker_features",
    WITH_PREDS + f""" SELECT ticker, {fxs('abs(avg_sentiment)')} AS sentiment_strength, CAST(avg_sentiment > 0 AS INTEGER) AS sentiment_direction, 1 AS has_news,
 CAST(news_count >= 5 AS INTEGER) AS high_news_volume, {fxs('ln(1 + news_count)')} AS log_news_count, CASE WHEN chg > 1 THEN 1 WHEN chg < -1 THEN -1 ELSE 0 END AS price_momentum,
 CAST(abs(chg) > 2 AS INTEGER) AS strong_momentum, {fxs('avg_sentiment * ln(1 + news_count)')} AS sentiment_news_interaction, {fxs('pos / greatest(neg, 1)')} AS pos_neg_ratio,
 pos - neg AS sentiment_imbalance, {fxs('avg_sentiment * confidence')} AS weighted_sentiment, {fxs('avg_sentiment - avg(avg_sentiment) OVER (PARTITION BY sector)')} AS sector_relative_sentiment FROM preds""",
)
def ticker_features(spark, sf):
    out = sector_relative(sc.ticker_features(preds(spark, sf)))
    cols = (*TF, "sector_relative_sentiment")
    ints = ("sentiment_direction", "has_news", "high_news_volume", "price_momentum", "strong_momentum", "sentiment_imbalance")
    return fix(out, *cols).select("ticker", *cols, *ints)


@query(
    "sector_relative",
    f"WITH {BARS}, {QUOTES}, {DIM} SELECT ticker, {fxs('change_percent - avg(change_percent) OVER (PARTITION BY sector)')} AS rel FROM quotes JOIN ticker_dim USING (ticker)",
)
def sector_relative_q(spark, sf):
    q = quotes(spark, sf).join(ticker_dim(spark, sf), "ticker")
    return fix(sector_relative(q, "change_percent", "rel").select("ticker", "rel"), "rel")


@query(
    "panel_interactions",
    f"""WITH {NEWS} SELECT ticker, date, {fxs(f'avg({S}) * ln(1 + count(*))')} AS sent_news_interaction, {fxs(f'max({S}) - min({S})')} AS sent_range FROM news_events GROUP BY 1, 2""",
)
def panel_interactions(spark, sf):
    out = sc.panel_interactions(ag.daily_news(news(spark, sf)))
    return fix(out, "sent_news_interaction", "sent_range").select("ticker", "date", "sent_news_interaction", "sent_range")


@query(
    "move_labels",
    f"WITH {BARS}, {QUOTES} SELECT ticker, CAST(change_percent > 0 AS INTEGER) AS price_up, CAST(change_percent < 0 AS INTEGER) AS price_down, CAST(abs(change_percent) > 2 AS INTEGER) AS significant_move FROM quotes",
)
def move_labels(spark, sf):
    return sc.move_labels(quotes(spark, sf)).select("ticker", "price_up", "price_down", "significant_move")


def _dir(c):
    return f"CASE WHEN {c} > 0 THEN 'up' WHEN {c} < 0 THEN 'down' ELSE 'flat' END"


@query(
    "direction_hit",
    WITH_PREDS + f" SELECT ticker, {_dir('prediction_score')} AS predicted_direction, {_dir('chg')} AS actual_direction, CAST({_dir('prediction_score')} = {_dir('chg')} AS INTEGER) AS correct FROM preds",
)
def direction_hit(spark, sf):
    out = sc.direction_hit(preds(spark, sf), actual="price_change_percent")
    return out.select("ticker", "predicted_direction", "actual_direction", "correct")


# ---- searches -------------------------------------------------------------------------------


@query(
    "search_news",
    f"""WITH {NEWS} SELECT article_id, ticker, source, {fxs(S)} AS {S} FROM news_events WHERE source ILIKE '%RR%' AND {S} >= -0.9 AND {S} <= 0.5 AND impact_level = 'high'
 AND event_time >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY ORDER BY event_time DESC, article_id LIMIT 50 OFFSET 5""",
)
def search_news(spark, sf):
    out = search.search_news(
        news(spark, sf), as_of=AS_OF, source="RR", min_sentiment=-0.9, max_sentiment=0.5, impact="high", days=10, limit=50, offset=5
    )
    return fix(out.select("article_id", "ticker", "source", S), S)


@query("news_by_ticker", f"WITH {NEWS} SELECT article_id FROM news_events WHERE ticker = 'U7' ORDER BY event_time DESC, article_id LIMIT 100")
def news_by_ticker(spark, sf):
    return search.search_news(news(spark, sf), as_of=AS_OF, ticker="U7", limit=100).select("article_id")


@query("news_by_source", f"WITH {NEWS} SELECT article_id FROM news_events WHERE source ILIKE '%click%' ORDER BY event_time DESC, article_id LIMIT 100")
def news_by_source(spark, sf):
    return search.search_news(news(spark, sf), as_of=AS_OF, source="click", limit=100).select("article_id")


@query(
    "search_news_counts",
    f"WITH {NEWS} SELECT count(*) AS total_rows, least(count(*), 50) AS returned_rows FROM news_events WHERE impact_level = 'macro'",
)
def search_news_counts(spark, sf):
    found = search.search_news(news(spark, sf), as_of=AS_OF, impact="macro")
    return search.page_counts(found, 0, 50)


@query(
    "search_predictions",
    WITH_PREDS + f""" SELECT ticker, sector, {fxs('prediction_score')} AS prediction_score FROM preds WHERE sector ILIKE '%asia%' AND recommendation = 'SELL' AND confidence >= 0.5
 AND news_count BETWEEN 5 AND 100000 AND prediction_score >= -0.9 ORDER BY preds.prediction_score DESC, ticker LIMIT 25 OFFSET 2""",
)
def search_predictions(spark, sf):
    out = search.search_predictions(
        preds(spark, sf), sector="SIA", recommendation="SELL", min_confidence=0.5, min_news=5, max_news=100000, min_score=-0.9,
        sort_by="prediction_score", limit=25, offset=2,
    )
    return fix(out.select("ticker", "sector", "prediction_score"), "prediction_score")


@query(
    "search_quotes",
    f"""WITH {BARS}, {QUOTES}, {DIM} SELECT ticker, {fxs('price')} AS price FROM quotes JOIN ticker_dim USING (ticker)
WHERE price > 0 AND sector ILIKE '%a%' AND price BETWEEN 900 AND 5000 AND change_percent >= -90 ORDER BY quotes.price DESC, ticker LIMIT 20""",
)
def search_quotes(spark, sf):
    q = quotes(spark, sf).join(ticker_dim(spark, sf), "ticker")
    out = search.search_quotes(q, sector="a", min_price=900, max_price=5000, min_change=-90, sort_by="price", limit=20)
    return fix(out.select("ticker", "price"), "price")


@query("lookup", WITH_PREDS + f" SELECT ticker, {fxs('prediction_score')} AS prediction_score FROM preds WHERE ticker = 'U11'")
def lookup(spark, sf):
    return fix(search.lookup(preds(spark, sf), " u11 ").select("ticker", "prediction_score"), "prediction_score")


@query(
    "history_slice",
    f"WITH {NEWS} SELECT article_id, date FROM news_events WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'",
)
def history_slice(spark, sf):
    return search.history_slice(news(spark, sf), "2024-01-05", "2024-01-09").select("article_id", "date")


@query("history_recent", f"WITH {NEWS} SELECT article_id, date FROM news_events WHERE date >= DATE '2024-01-24' AND date <= DATE '2024-01-31'")
def history_recent(spark, sf):
    return search.recent(news(spark, sf), 7, "2024-01-31").select("article_id", "date")


@query("lookback", f"WITH {NEWS} SELECT article_id FROM news_events WHERE event_time >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def lookback(spark, sf):
    return search.lookback(news(spark, sf), 7, AS_OF).select("article_id")


@query(
    "in_universe",
    f"WITH {NEWS} SELECT article_id FROM news_events WHERE ticker IN (SELECT 'U' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def in_universe(spark, sf):
    u = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("ticker"))
    return search.in_universe(news(spark, sf), u).select("article_id")


