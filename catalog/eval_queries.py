"""Joins, thresholds, metrics, quality, article features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.bars_queries import BT_CTE, DAILY
from catalog.news_queries import WITH_PREDS, preds
from catalog.registry import fix, fxs, query
from catalog.views import (
    ARTICLES, BARS, BARS_U, DIM, NEWS, QUOTES, SCORED, articles, bars, bars_u, news, quotes, scored, ticker_dim,
)
from tapewire.operators import features as ft
from tapewire.operators import indicators as ind
from tapewire.operators import joins as jn
from tapewire.operators import metrics as mx
from tapewire.operators import quality as ql
from tapewire.operators import ranking

S = "sentiment_compound"


def figs(cols, digits=6):
    return ", ".join(f"{fxs(c, digits)} AS {c}" for c in cols)


# ---- joins -------------------------------------------------------------------------------------

ASOF = f"""located AS (
 SELECT d.ticker, d.date, b.date AS bar_date, b.close, b.close_fwd FROM (SELECT DISTINCT ticker, date FROM news_d) d
 ASOF JOIN (SELECT ticker, date, close, lead(close, 3) OVER (PARTITION BY ticker ORDER BY date) AS close_fwd FROM bars_u) b
 ON d.ticker = b.ticker AND d.date <= b.date)"""
NEWS_D = f"news_d AS (SELECT * REPLACE (date + CAST(article_id % 4 AS INTEGER) AS date) FROM news_events)"


@query(
    "asof_forward",
    f"""WITH {NEWS}, {BARS_U}, {NEWS_D}, {ASOF} SELECT n.article_id, n.ticker, l.bar_date, {fxs('(close_fwd / close - 1) * 100')} AS change_percent
FROM news_d n JOIN located l ON n.ticker = l.ticker AND n.date = l.date WHERE close_fwd IS NOT NULL""",
)
def asof_forward(spark, sf):
    shifted = news(spark, sf).withColumn("date", F.date_add("date", (F.col("article_id") % 4).cast("int")))
    out = jn.asof_forward(shifted, bars_u(spark, sf), 3)
    return fix(out.select("article_id", "ticker", "bar_date", "change_percent"), "change_percent")


@query(
    "next_day_change",
    f"""WITH {BARS_U} SELECT a.ticker, a.date, {fxs('b.close - a.close')} AS change, {fxs('(b.close - a.close) / a.close * 100')} AS change_percent
FROM bars_u a JOIN bars_u b ON a.ticker = b.ticker AND b.date = a.date + 1""",
)
def next_day_change(spark, sf):
    return fix(jn.next_day_change(bars_u(spark, sf)), "change", "change_percent").select("ticker", "date", "change", "change_percent")


@query(
    "scores_vs_returns",
    f"""WITH {NEWS}, {BARS_U}, {DAILY}, r AS (SELECT ticker, date, lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS r FROM bars_u)
SELECT ticker, date, {fxs('sent_mean')} AS score, {fxs('r')} AS return_fwd FROM daily JOIN r USING (ticker, date) WHERE r IS NOT NULL""",
)
def scores_vs_returns(spark, sf):
    from tapewire.operators.aggregates import daily_news

    p = daily_news(news(spark, sf)).select("ticker", "date", F.col("sent_mean").alias("score"))
    r = ind.forward_return(bars_u(spark, sf)).select("ticker", "date", "return_fwd")
    return fix(jn.scores_vs_returns(p, r), "score", "return_fwd")


BACK = f"""back AS (SELECT *, count(*) OVER g AS daily_news_count, avg({S}) OVER g AS daily_avg_sentiment, count(*) FILTER (impact_level = 'high') OVER g AS daily_high_impact,
  coalesce(stddev_samp({S}) OVER g, 0) AS daily_sentiment_std, min({S}) OVER g AS daily_min_sentiment, max({S}) OVER g AS daily_max_sentiment, avg(relevance_score) OVER g AS daily_avg_relevance
 FROM news_events WINDOW g AS (PARTITION BY ticker, date))"""


DAY_FEATS = ("daily_avg_sentiment", "daily_sentiment_std", "daily_min_sentiment", "daily_max_sentiment", "daily_avg_relevance")


@query("merge_back_daily", f"WITH {NEWS}, {BACK} SELECT article_id, daily_news_count, {figs(DAY_FEATS)}, daily_high_impact FROM back")
def merge_back_daily(spark, sf):
    out = jn.merge_back_daily(news(spark, sf))
    return fix(out, *DAY_FEATS).select("article_id", "daily_news_count", *DAY_FEATS, "daily_high_impact")


@query(
    "features_with_labels",
    f"""WITH {NEWS}, {BARS_U}, c AS (SELECT a.ticker, a.date, (b.close - a.close) / a.close * 100 AS ch FROM bars_u a JOIN bars_u b ON a.ticker = b.ticker AND b.date = a.date + 1)
SELECT article_id, {fxs('ch')} AS change_percent FROM news_events n LEFT JOIN c ON n.ticker = c.ticker AND n.date = c.date""",
)
def features_with_labels(spark, sf):
    changes = jn.next_day_change(bars_u(spark, sf)).select("ticker", "date", "change_percent")
    out = jn.features_with_labels(news(spark, sf), changes)
    return fix(out.select("article_id", "change_percent"), "change_percent")


@query(
    "enrich_quotes",
    f"""WITH {BARS}, {QUOTES}, {DIM}, d AS (SELECT CASE WHEN ticker LIKE '%3' THEN lower(ticker) ELSE ticker END AS ticker, sector, CASE WHEN industry LIKE '%7' THEN 'Unknown' ELSE industry END AS industry, company_name FROM ticker_dim)
SELECT q.ticker, coalesce(sector, 'Unknown') AS sector, CASE WHEN industry IS NULL THEN 'Unknown' ELSE industry END AS industry, coalesce(company_name, q.ticker) AS company_name
FROM quotes q LEFT JOIN d ON q.ticker = upper(d.ticker)""",
)
def enrich_quotes(spark, sf):
    d = ticker_dim(spark, sf).select(
        F.when(F.col("ticker").endswith("3"), F.lower("ticker")).otherwise(F.col("ticker")).alias("ticker"),
        "sector",
        F.when(F.col("industry").endswith("7"), "Unknown").otherwise(F.col("industry")).alias("industry"),
        "company_name",
    )
    return jn.enrich_quotes(quotes(spark, sf), d).select("ticker", "sector", "industry", "company_name")


@query(
    "dim_gaps",
    f"WITH {DIM}, {BARS}, u AS (SELECT DISTINCT ticker FROM bars) SELECT ticker FROM u WHERE ticker NOT IN (SELECT ticker FROM ticker_dim WHERE industry <> 'NATION_3' AND ticker NOT LIKE '%5') ORDER BY ticker LIMIT 10",
)
def dim_gaps(spark, sf):
    d = ticker_dim(spark, sf).where(~F.col("ticker").endswith("5"))
    d = d.withColumn("company_name", F.when(F.col("industry") != "NATION_3", F.col("company_name")).otherwise(" "))
    return jn.dim_gaps(bars(spark, sf).select("ticker").distinct(), d, 10)


@query(
    "dim_upsert",
    f"""WITH {DIM}, o AS (SELECT ticker, sector, TIMESTAMP '2024-01-01' AS updated_at FROM ticker_dim), n AS (SELECT ticker, industry AS sector, CASE WHEN ticker LIKE '%1' THEN TIMESTAMP '2023-01-01' ELSE TIMESTAMP '2024-02-01' END AS updated_at FROM ticker_dim WHERE ticker < 'S5')
SELECT o.ticker, CASE WHEN n.updated_at >= o.updated_at THEN n.sector ELSE o.sector END AS sector FROM o LEFT JOIN n USING (ticker)""",
)
def dim_upsert(spark, sf):
    d = ticker_dim(spark, sf)
    old = d.select("ticker", "sector", F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    when = F.when(F.col("ticker").endswith("1"), "2023-01-01").otherwise("2024-02-01").cast("timestamp")
    new = d.where("ticker < 'S5'").select("ticker", F.col("industry").alias("sector"), when.alias("updated_at"))
    return jn.dim_upsert(old, new).select("ticker", "sector")


@query(
    "read_ticker_dim",
    f"""WITH {DIM}, r AS (SELECT replace(upper(trim(' ' || lower(ticker) || '.A ')), '.', '-') AS ticker, CASE WHEN industry LIKE '%1' THEN NULL ELSE industry END AS industry FROM ticker_dim) SELECT * FROM r""",
)
def read_ticker_dim(spark, sf):
    from catalog.flow_queries import scratch
    from tapewire.sources import readers

    d = ticker_dim(spark, sf).select(
        F.concat(F.lit(" "), F.lower("ticker"), F.lit(".A ")).alias("ticker"),
        "sector",
        F.when(F.col("industry").endswith("1"), "nan").otherwise(F.col("industry")).alias("industry"),
        "company_name",
        F.lit("2024-01-02").cast("timestamp").alias("updated_at"),
    )
    older = d.withColumns({"industry": F.lit("old"), "updated_at": F.lit("2024-01-01").cast("timestamp")})
    out = scratch(spark)
    both = d.unionByName(older).select("ticker", "sector", "industry", "company_name", "updated_at")
    both.write.csv(out, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_ticker_dim(spark, out).select("ticker", "industry")


@query(
    "realised_check",
    WITH_PREDS + f""", c AS (SELECT ticker, CASE WHEN prediction_score > 0 THEN 'up' WHEN prediction_score < 0 THEN 'down' ELSE 'flat' END AS p, CASE WHEN chg > 0 THEN 'up' WHEN chg < 0 THEN 'down' ELSE 'flat' END AS a, recommendation FROM preds)
SELECT recommendation, {fxs('avg(CASE WHEN p = a THEN 1 ELSE 0 END)')} AS accuracy, count(*) AS n FROM c GROUP BY 1""",
)
def realised_check(spark, sf):
    out = jn.realised_check(preds(spark, sf), ranking.last_quote(bars_u(spark, sf)))
    return fix(mx.accuracy_by(out, "recommendation"), "accuracy")


def _stored(spark, sf):
    """Articles as collected: scraped at noon of their day."""
    return articles(spark, sf).withColumn("scraped_at", F.col("date").cast("timestamp") + F.expr("INTERVAL 12 HOUR"))


KEYED = """k AS (SELECT article_id, lang, lower(trim(coalesce(title, ''), ' ')) AS t, ticker, date FROM articles)"""


@query(
    "anti_join_store",
    f"WITH {ARTICLES}, {KEYED} SELECT article_id FROM k WHERE (t, ticker, date) NOT IN (SELECT t, ticker, date FROM k WHERE lang = 'en')",
)
def anti_join_store(spark, sf):
    a = _stored(spark, sf).withColumn("url", F.lit("https://example.com/x"))
    return jn.anti_join_store(a, a.where("lang = 'en'")).select("article_id")


@query("new_titles", f"WITH {ARTICLES} SELECT article_id FROM articles WHERE title NOT IN (SELECT title FROM articles WHERE lang = 'en')")
def new_titles(spark, sf):
    a = articles(spark, sf)
    return jn.new_titles(a, a.where("lang = 'en'")).select("article_id")


@query(
    "new_titles_within_day",
    f"WITH {ARTICLES} SELECT article_id FROM articles WHERE (title, date) NOT IN (SELECT title, date + 1 FROM articles WHERE lang = 'en')",
)
def new_titles_within_day(spark, sf):
    a = articles(spark, sf)
    stored = a.where("lang = 'en'").withColumn("date", F.date_add("date", 1))
    return jn.new_titles(a, stored, within_day=True).select("article_id")


@query("missing_days", f"WITH {NEWS}, d AS (SELECT unnest(generate_series(DATE '2023-12-20', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS day) SELECT day FROM d WHERE day NOT IN (SELECT date FROM news_events)")
def missing_days(spark, sf):
    return jn.missing_days(news(spark, sf).select(F.col("date").alias("day")), "2023-12-20", "2024-02-05")


@query("pending_days", f"WITH {NEWS} SELECT DISTINCT date AS day FROM news_events WHERE date NOT IN (SELECT date FROM news_events WHERE ticker = 'U7')")
def pending_days(spark, sf):
    n = news(spark, sf).select("ticker", F.col("date").alias("day"))
    return jn.pending_days(n, n.where("ticker = 'U7'"))


@query("day_difference", f"WITH {NEWS}, {BARS} SELECT date FROM bars EXCEPT SELECT date + INTERVAL 3 DAY FROM bars".replace("date + INTERVAL 3 DAY", "CAST(date + INTERVAL 3 DAY AS DATE)"))
def day_difference(spark, sf):
    b = bars(spark, sf)
    return b.select("date").subtract(b.select(F.date_add("date", 3).alias("date")))


@query("distinct_keys", f"WITH {NEWS} SELECT DISTINCT date, ticker FROM news_events")
def distinct_keys(spark, sf):
    return jn.distinct_keys(news(spark, sf))


@query(
    "merge_articles",
    f"WITH {ARTICLES} SELECT article_id, title, lang FROM articles UNION ALL SELECT article_id, title, NULL FROM articles WHERE lang <> 'en'",
)
def merge_articles(spark, sf):
    a = articles(spark, sf)
    new = a.where("lang <> 'en'").select("article_id", "title")
    return jn.merge_articles(a.select("article_id", "title", "lang"), new)


# ---- article features ----------------------------------------------------------------------------

FEATS = ("sentiment_strength", "sentiment_squared", "sentiment_x_relevance", "sentiment_momentum", *DAY_FEATS)
FLAGS = ("is_positive", "is_negative", "is_high_impact", "is_macro", "high_relevance", "is_weekend", "is_market_hours", "hour")


@query(
    "article_features",
    f"""WITH {NEWS}, {BACK} SELECT article_id, {fxs(f'abs({S})')} AS sentiment_strength, {fxs(f'{S} * {S}')} AS sentiment_squared, {fxs(f'{S} * relevance_score')} AS sentiment_x_relevance,
 {fxs(f'{S} * abs({S})')} AS sentiment_momentum, {figs(DAY_FEATS)}, CAST({S} > 0.05 AS INTEGER) AS is_positive, CAST({S} < -0.05 AS INTEGER) AS is_negative, CAST(impact_level = 'high' AS INTEGER) AS is_high_impact,
 CAST(impact_level = 'macro' AS INTEGER) AS is_macro, CAST(relevance_score > 0.7 AS INTEGER) AS high_relevance, CAST(isodow(event_time) >= 6 AS INTEGER) AS is_weekend,
 CAST(hour(event_time) BETWEEN 9 AND 16 AS INTEGER) AS is_market_hours, CAST(hour(event_time) AS INTEGER) AS hour, daily_news_count,
 CAST(source IN (SELECT source FROM news_events GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 3) AS INTEGER) AS is_top_source FROM back""",
)
def article_features(spark, sf):
    out = ft.article_features(news(spark, sf), top_sources=3)
    return fix(out, *FEATS).select("article_id", *FEATS, *FLAGS, "daily_news_count", "is_top_source")


# ---- thresholds ------------------------------------------------------------------------------------


def cuts_sql(cuts, column, source):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS name, {fxs(f'coalesce(quantile_cont({column}, {p}), {d})')} AS value, count({column}) AS n_rows FROM {source}"
        for n, (p, d) in cuts.items()
    )


@query("sentiment_thresholds", f"WITH {NEWS} {cuts_sql(mx.SENTIMENT_CUTS, S, 'news_events')}")
def sentiment_thresholds(spark, sf):
    return fix(mx.thresholds(news(spark, sf), S, mx.SENTIMENT_CUTS), "value")


@query(
    "recommendation_thresholds",
    f"""WITH {NEWS}, {BARS_U}, {DAILY}, r AS (SELECT ticker, date, lead(close) OVER (PARTITION BY ticker ORDER BY date) AS ahead FROM bars_u),
 j AS (SELECT sent_mean FROM daily JOIN r USING (ticker, date) WHERE ahead IS NOT NULL) {cuts_sql(mx.RECOMMENDATION_CUTS, 'sent_mean', 'j')}""",
)
def recommendation_thresholds(spark, sf):
    from tapewire.operators.aggregates import daily_news

    p = daily_news(news(spark, sf)).select("ticker", "date", "sent_mean")
    r = ind.forward_return(bars_u(spark, sf)).select("ticker", "date", "return_fwd")
    return fix(mx.thresholds(jn.scores_vs_returns(p, r), "sent_mean", mx.RECOMMENDATION_CUTS), "value")


@query("confidence_thresholds", WITH_PREDS + " " + cuts_sql(mx.CONFIDENCE_CUTS, "confidence", "preds"))
def confidence_thresholds(spark, sf):
    return fix(mx.thresholds(preds(spark, sf), "confidence", mx.CONFIDENCE_CUTS), "value")


# ---- metrics -----------------------------------------------------------------------------------------

PRED = f"{NEWS}, {SCORED}, lab AS (SELECT *, CAST(probability > 0.4 AS INTEGER) AS predicted FROM scored)"


def labelled(spark, sf):
    return scored(spark, sf).withColumn("predicted", (F.col("probability") > 0.4).cast("int"))


COUNTS = """c AS (SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
 count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 0 AND predicted = 0) AS tn FROM lab)"""
RANKS = """rk AS (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS r FROM lab),
 auc AS (SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM rk)"""


@query(
    "binary_metrics",
    f"""WITH {PRED}, {COUNTS}, {RANKS} SELECT tp, fp, fn, tn, {fxs('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy, {fxs('tp / (tp + fp)')} AS precision,
 {fxs('tp / (tp + fn)')} AS recall, {fxs('2 * tp / (2 * tp + fp + fn)')} AS f1, {fxs('auc')} AS auc FROM c, auc""",
)
def binary_metrics(spark, sf):
    return fix(mx.binary_metrics(labelled(spark, sf), score="probability"), "accuracy", "precision", "recall", "f1", "auc")


@query("confusion_matrix", f"WITH {PRED} SELECT label AS actual, predicted, count(*) AS n FROM lab GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return mx.confusion_matrix(labelled(spark, sf))


@query(
    "class_report",
    f"""WITH {PRED} """
    + " UNION ALL ".join(
        f"SELECT {k} AS class, {fxs(f'count(*) FILTER (label = {k} AND predicted = {k}) / count(*) FILTER (predicted = {k})')} AS precision, {fxs(f'count(*) FILTER (label = {k} AND predicted = {k}) / count(*) FILTER (label = {k})')} AS recall, {fxs(f'2 * count(*) FILTER (label = {k} AND predicted = {k}) / (count(*) FILTER (label = {k}) + count(*) FILTER (predicted = {k}))')} AS f1, count(*) FILTER (label = {k}) AS support FROM lab"
        for k in (0, 1)
    ),
)
def class_report(spark, sf):
    return fix(mx.class_report(labelled(spark, sf)), "precision", "recall", "f1")


@query("accuracy_by", f"WITH {PRED} SELECT ticker, {fxs('avg(CASE WHEN label = predicted THEN 1 ELSE 0 END)')} AS accuracy, count(*) AS n FROM lab GROUP BY 1")
def accuracy_by(spark, sf):
    rows = labelled(spark, sf).withColumn("correct", (F.col("label") == F.col("predicted")).cast("int"))
    return fix(mx.accuracy_by(rows, "ticker"), "accuracy")


@query(
    "accuracy_by_confidence",
    f"""WITH {PRED}, b AS (SELECT abs(probability - 0.5) * 2 AS c, label, predicted FROM lab)
SELECT CASE WHEN c <= 0.2 THEN '0-20%' WHEN c <= 0.4 THEN '20-40%' WHEN c <= 0.6 THEN '40-60%' WHEN c <= 0.8 THEN '60-80%' ELSE '80-100%' END AS bin, {fxs('avg(CASE WHEN label = predicted THEN 1 ELSE 0 END)')} AS accuracy, count(*) AS n FROM b GROUP BY 1""",
)
def accuracy_by_confidence(spark, sf):
    return fix(mx.accuracy_by_confidence(labelled(spark, sf)), "accuracy")


@query(
    "roc_curve",
    f"""WITH {PRED}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM lab GROUP BY 1)
SELECT {fxs('score')} AS score, {fxs('sum(q) OVER w / (SELECT sum(q) FROM g)')} AS fpr, {fxs('sum(p) OVER w / (SELECT sum(p) FROM g)')} AS tpr FROM g WINDOW w AS (ORDER BY g.score DESC)""",
)
def roc_curve(spark, sf):
    return fix(mx.roc_curve(labelled(spark, sf)), "score", "fpr", "tpr")


# a fixed rule stands in for the model: momentum sets the probability
BT_PRED = "greatest(0.0, least(1.0, 0.5 + momentum_5))"
# Test prices move by whole multiples a day: returns are scaled down before compounding
# and the compounded figures are compared by their logarithm.
SCALE = 0.001
TRADES = f"""tr AS (SELECT date, return_fwd * {SCALE} AS r, CASE WHEN p > 0.5 THEN return_fwd ELSE -return_fwd END * {SCALE} AS sr FROM (SELECT *, {BT_PRED} AS p FROM bt) x WHERE abs(p - 0.5) * 2 > 0.6),
 dd AS (SELECT date, avg(sr) AS sr, avg(r) AS mr, count(*) AS trades FROM tr GROUP BY 1)"""


def trade_rows(spark, sf):
    from tapewire.functions.numeric import clip

    rows = ind.backtest_features(bars(spark, sf)).withColumn("probability", clip(0.5 + F.col("momentum_5"), 0, 1))
    rows = rows.withColumn("return_fwd", F.col("return_fwd") * SCALE)
    return mx.trades(rows.withColumn("predicted", (F.col("probability") > 0.5).cast("int")))


@query(
    "cumulative_return",
    f"""WITH {BARS}, {BT_CTE}, {TRADES} SELECT date, {fxs('sr')} AS strategy_return, {fxs('mr')} AS market_return, trades,
 {fxs('sum(ln(1 + sr)) OVER (ORDER BY date)')} AS cum_strategy, {fxs('sum(ln(1 + mr)) OVER (ORDER BY date)')} AS cum_market FROM dd""",
)
def cumulative_return(spark, sf):
    out = mx.cumulative_return(trade_rows(spark, sf))
    out = out.withColumns({c: F.log(c) for c in ("cum_strategy", "cum_market")})
    return fix(out, "strategy_return", "market_return", "cum_strategy", "cum_market")


@query(
    "trading_summary",
    f"""WITH {BARS}, {BT_CTE}, {TRADES}, f AS (SELECT sum(ln(1 + sr)) AS fs, sum(ln(1 + mr)) AS fm, CAST(sum(trades) AS BIGINT) AS trades FROM dd)
SELECT {fxs('fs')} AS final_strategy, {fxs('fm')} AS final_market, trades, {fxs('(SELECT avg(CASE WHEN sr > 0 THEN 1 ELSE 0 END) FROM tr)')} AS win_rate FROM f""",
)
def trading_summary(spark, sf):
    out = mx.trading_summary(trade_rows(spark, sf)).drop("alpha")
    out = out.withColumns({c: F.log(c) for c in ("final_strategy", "final_market")})
    return fix(out, "final_strategy", "final_market", "win_rate")


# ---- quality --------------------------------------------------------------------------------------------

NEWS_Q = f"""nq AS (SELECT CASE WHEN article_id % 50 = 0 THEN '' ELSE source END AS title, ticker, {S} * 1.02 AS s FROM news_events)"""
QUALITY = (
    f"{WITH_PREDS}, {NEWS_Q}, rep AS (SELECT 'news' AS \"table\", 'missing column sentiment_label' AS rule, 'error' AS severity, 1 AS n "
    "UNION ALL SELECT 'news', 'empty table', 'error', 0 UNION ALL SELECT 'news', 'all sentiment zero', 'error', 0 "
    "UNION ALL SELECT 'news', 'sentiment out of range', 'error', count(*) FILTER (s < -1 OR s > 1) FROM nq "
    "UNION ALL SELECT 'news', 'blank title', 'warning', count(*) FILTER (title = '') FROM nq UNION ALL SELECT 'news', 'mostly blank ticker', 'warning', 0 "
    "UNION ALL SELECT 'news', 'duplicate title', 'warning', sum(n) FROM (SELECT count(*) AS n FROM nq GROUP BY title HAVING count(*) > 1) d "
    "UNION ALL SELECT 'quotes', 'empty table', 'error', 0 UNION ALL SELECT 'quotes', 'suspicious price', 'warning', count(*) FILTER (price <= 0 OR price > 100000) FROM quotes_u "
    "UNION ALL SELECT 'quotes', 'missing price', 'warning', 0 UNION ALL SELECT 'quotes', 'extreme change', 'warning', count(*) FILTER (change_percent < -50 OR change_percent > 50) FROM quotes_u "
    "UNION ALL SELECT 'predictions', 'empty table', 'error', 0 UNION ALL SELECT 'predictions', 'unknown recommendation', 'error', count(*) FILTER (recommendation = 'HOLD') FROM preds "
    "UNION ALL SELECT 'predictions', 'confidence out of range', 'error', 0 UNION ALL SELECT 'predictions', 'score out of range', 'error', 0)"
)


def report(spark, sf):
    n = news(spark, sf).select(
        F.when(F.col("article_id") % 50 == 0, "").otherwise(F.col("source")).alias("title"), "source", "ticker",
        (F.col(S) * 1.02).alias(S),
    )
    p = preds(spark, sf).withColumn("recommendation", F.when(F.col("recommendation") == "HOLD", "WAIT").otherwise(F.col("recommendation")))
    return ql.quality_report(n, ranking.last_quote(bars_u(spark, sf)), p)


@query("quality_report", QUALITY + ' SELECT "table", rule, severity, CAST(n AS BIGINT) AS n FROM rep')
def quality_report(spark, sf):
    return report(spark, sf)


@query(
    "quality_overall",
    QUALITY + """, g AS (SELECT "table", count(*) FILTER (severity = 'error' AND n > 0) AS errors, count(*) FILTER (severity = 'warning' AND n > 0) AS warnings FROM rep GROUP BY 1)
SELECT "table", errors = 0 AS valid, errors, warnings FROM g UNION ALL SELECT 'ALL', sum(errors) = 0, CAST(sum(errors) AS BIGINT), CAST(sum(warnings) AS BIGINT) FROM g""",
)
def quality_overall(spark, sf):
    return ql.overall_valid(report(spark, sf))


