"""Grouped summaries of articles, batches, tickers, sectors and quotes.

All of them are hash aggregations with map-side partial results; lists are the
first k rows of an aggregate, ties broken by the value itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewire.functions.numeric import interval, ladder
from tapewire.functions.scores import label_sentiment
from tapewire.operators.matching import SYMBOL, names_in_title, per_mention
from tapewire.operators.ranking import top_k
from tapewire.operators.scale import exact_quantiles, explode_some, once, union_all

S = "sentiment_compound"
POSITIVE, NEGATIVE = 0.05, -0.05
NEWS_COLUMNS = (
    "news_count", "sent_mean", "sent_std", "sent_min", "sent_max", "relevance_mean", "high_impact_count", "macro_count",
)


def _high() -> Column:
    return F.count_if(F.col("impact_level") == "high")


def daily_news(news: DataFrame) -> DataFrame:
    """Per (ticker, date): counts, sentiment moments, relevance, high and macro counts."""
    zero = F.lit(0.0)
    return news.groupBy("ticker", "date").agg(
        F.count("*").alias("news_count"),
        F.coalesce(F.avg(S), zero).alias("sent_mean"),
        F.coalesce(F.stddev_samp(S), zero).alias("sent_std"),
        F.coalesce(F.min(S), zero).alias("sent_min"),
        F.coalesce(F.max(S), zero).alias("sent_max"),
        F.coalesce(F.avg("relevance_score"), zero).alias("relevance_mean"),
        _high().alias("high_impact_count"),
        F.count_if(F.col("impact_level") == "macro").alias("macro_count"),
    )


def sentiment_confidence(n: Column, mean: Column, var_pop: Column) -> Column:
    """0.4 volume tier + 0.4 strength + 0.2 consistency, at most 0.99; 0 without articles."""
    tier = ladder(n, [(50, 0.95), (20, 0.85), (10, 0.75), (5, 0.65)], 0.50)
    strength = F.least(F.abs(mean) * 2, F.lit(1.0))
    steady = F.greatest(F.lit(0.0), 1.0 - var_pop * 2)
    return F.when(n == 0, 0.0).otherwise(F.least(tier * 0.4 + strength * 0.4 + steady * 0.2, F.lit(0.99)))


def ticker_sentiment(
    news: DataFrame, as_of: str, tau_hours: float = 24.0, universe: DataFrame | None = None, pattern: str = SYMBOL
) -> DataFrame:
    """Per ticker: age-weighted mean sentiment, counts, recommendation, confidence.

    Weight exp(-age/tau); undated articles count as fresh, future ones have age 0.  With a ``universe`` an article counts
    for every tracked symbol it serves, its own and those its title names; without one for its own ticker.
    """
    if universe is not None:
        cols = [c for c in ("ticker", "title", "event_time", S) if c in news.columns]
        news = per_mention(news.select(*cols), universe, pattern)
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("event_time")) / 3.6e9
    weight = F.exp(-F.greatest(F.coalesce(age, F.lit(0.0)), F.lit(0.0)) / max(tau_hours, 1e-6))
    rows = news.withColumns({"_s": F.coalesce(F.col(S), F.lit(0.0)), "_w": weight})
    agg = rows.groupBy("ticker").agg(
        F.count("*").alias("article_count"),
        F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum("_w")).alias("_mean"),
        F.count_if(F.col("_s") > POSITIVE).alias("positive_count"),
        F.count_if(F.col("_s") < NEGATIVE).alias("negative_count"),
        F.avg("_s").alias("_avg"),
        F.var_pop("_s").alias("_var"),
    )
    agg = agg.withColumn("avg_sentiment", F.coalesce(F.col("_mean"), F.lit(0.0)))
    return agg.select(
        "ticker",
        "article_count",
        "avg_sentiment",
        "positive_count",
        "negative_count",
        (F.col("article_count") - F.col("positive_count") - F.col("negative_count")).alias("neutral_count"),
        recommend_from_counts(F.col("avg_sentiment"), F.col("positive_count"), F.col("negative_count")).alias(
            "recommendation"
        ),
        sentiment_confidence(F.col("article_count"), F.col("_avg"), F.col("_var")).alias("confidence"),
    )


def recommend_from_counts(mean: Column, pos: Column, neg: Column) -> Column:
    """Strong labels need a clear majority of articles on their side as well."""
    return (
        F.when((mean >= 0.4) & (pos > neg * 2), "STRONG BUY")
        .when(mean >= 0.15, "BUY")
        .when((mean <= -0.4) & (neg > pos * 2), "STRONG SELL")
        .when(mean <= -0.15, "SELL")
        .otherwise("HOLD")
    )


def recent_articles(news: DataFrame, k: int = 5, universe: DataFrame | None = None, pattern: str = SYMBOL) -> DataFrame:
    """The k newest articles per ticker, or per tracked symbol they serve.  ``rn <= k`` is pruned before the shuffle."""
    if universe is not None:
        news = per_mention(news, universe, pattern)
    w = W.partitionBy("ticker").orderBy(F.desc_nulls_last("event_time"), F.asc("article_id"))
    return news.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def sentiment_distribution(news: DataFrame) -> DataFrame:
    label = label_sentiment(F.col(S))
    counts = [
        F.count_if(label == name).alias(name.lower().replace(" ", "_"))
        for name in ("Very Positive", "Positive", "Neutral", "Negative", "Very Negative")
    ]
    return news.agg(*counts, F.count("*").alias("total"), F.avg(S).alias("avg_sentiment"))


def news_summary(news: DataFrame) -> DataFrame:
    return news.agg(
        F.count("*").alias("total"),
        F.avg(S).alias("avg_sentiment"),
        F.count_if(F.col(S) > POSITIVE).alias("positive"),
        F.count_if(F.col(S) < NEGATIVE).alias("negative"),
        F.count_if(F.col(S).between(NEGATIVE, POSITIVE)).alias("neutral"),
        _high().alias("high_impact"),
    )


def top_lists(news: DataFrame, columns: Sequence[str] = ("source", "ticker"), k: int = 20) -> DataFrame:
    """The k most frequent values of several columns, tagged by column; counted in one scan."""
    counts = value_counts(news, columns).where("value is not null")
    w = W.partitionBy("field").orderBy(F.desc("n"), F.asc("value"))
    # the rank filter is applied per task before the shuffle, k rows per column remain
    ranked = counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return ranked.select(F.col("field").alias("list"), "value", "n")


def prediction_summary(preds: DataFrame) -> DataFrame:
    """Per recommendation: rows, mean sentiment and confidence; one 'ALL' row for the table."""
    agg = [
        F.count("*").alias("n"),
        F.avg("avg_sentiment").alias("avg_sentiment"),
        F.avg("confidence").alias("avg_confidence"),
    ]
    return preds.groupBy("recommendation").agg(*agg).unionByName(
        preds.agg(*agg).withColumn("recommendation", F.lit("ALL"))
    )


def sector_ranking(preds: DataFrame, k: int = 5) -> DataFrame:
    """The k best and k worst sectors by mean score, tagged."""
    sectors = preds.groupBy("sector").agg(F.count("*").alias("n"), F.avg("prediction_score").alias("avg_score"))
    best = top_k(sectors, [F.desc("avg_score"), F.asc("sector")], k).withColumn("list", F.lit("top"))
    worst = top_k(sectors, [F.asc("avg_score"), F.asc("sector")], k).withColumn("list", F.lit("bottom"))
    return best.unionByName(worst)


def coverage_metrics(preds: DataFrame, confident: float = 0.7) -> DataFrame:
    return preds.agg(
        F.avg((F.col("news_count") > 0).cast("double")).alias("share_with_news"),
        F.avg("news_count").alias("avg_news"),
        F.avg((F.col("confidence") >= confident).cast("double")).alias("share_confident"),
    )


def market_summary(quotes: DataFrame) -> DataFrame:
    valid = quotes.where(F.col("price") > 0)
    change = F.col("change_percent")
    return valid.agg(
        F.count("*").alias("valid"),
        F.count_if(change > 0).alias("gainers"),
        F.count_if(change < 0).alias("losers"),
        F.count_if(change == 0).alias("unchanged"),
        F.avg(change).alias("avg_change"),
    )


def market_lists(quotes: DataFrame, k: int = 10) -> DataFrame:
    """Top gainers, losers (worst first) and most active, tagged."""
    valid = quotes.where(F.col("price") > 0).select("ticker", "change_percent", "volume")
    lists = {
        "gainers": [F.desc("change_percent"), F.asc("ticker")],
        "losers": [F.asc("change_percent"), F.asc("ticker")],
        "most_active": [F.desc("volume"), F.asc("ticker")],
    }
    return union_all([top_k(valid, order, k).withColumn("list", F.lit(name)) for name, order in lists.items()])


# ---- pattern statistics -------------------------------------------------------------------

SENTIMENT_EDGES = (-1.0, -0.5, -0.1, 0.1, 0.5, 1.0)
SENTIMENT_BINS = ("very_negative", "negative", "neutral", "positive", "very_positive")
VOLUME_EDGES = (0, 2, 5, 10, 100)
VOLUME_BINS = ("low", "medium", "high", "very_high")


def sentiment_range_stats(news: DataFrame) -> DataFrame:
    bins = news.withColumn("bin", interval(F.col(S), SENTIMENT_EDGES, SENTIMENT_BINS)).where("bin is not null")
    return bins.groupBy("bin").agg(F.count("*").alias("n"), F.avg(S).alias("avg_sentiment"), _high().alias("high_impact"))


def keyword_category_stats(articles: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per category: matching articles, their mean sentiment and share of high impact."""
    from tapewire.operators.matching import any_term, padded

    rows = once(articles.select("title", S, "impact_level"), _text=padded(F.col("title")))
    hits = F.array(*[F.when(any_term(F.col("_text"), terms), F.lit(name)) for name, terms in categories.items()])
    rows = explode_some(rows, [S, "impact_level"], hits, "category")
    return rows.groupBy("category").agg(
        F.count("*").alias("matches"),
        F.avg(S).alias("avg_sentiment"),
        F.avg((F.col("impact_level") == "high").cast("double") * 100).alias("high_impact_pct"),
    )


def group_stats(news: DataFrame, key: str) -> DataFrame:
    """Count, mean and spread of sentiment, high-impact count and mean relevance per group."""
    return news.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg(S).alias("avg_sentiment"),
        F.coalesce(F.stddev_samp(S), F.lit(0.0)).alias("std_sentiment"),
        _high().alias("high_impact"),
        F.avg("relevance_score").alias("avg_relevance"),
    )


def source_stats(news: DataFrame, k: int = 10) -> DataFrame:
    """Top sources by volume and by high-impact count, tagged."""
    stats = group_stats(news, "source")
    by_volume = top_k(stats, [F.desc("n"), F.asc("source")], k).withColumn("list", F.lit("volume"))
    by_high = top_k(stats, [F.desc("high_impact"), F.asc("source")], k).withColumn("list", F.lit("high_impact"))
    return by_volume.unionByName(by_high)


def ticker_stats(news: DataFrame, volume_k: int = 20, k: int = 10) -> DataFrame:
    """Top tickers by volume, by mean sentiment either way, and by high-impact count."""
    stats = group_stats(news, "ticker")
    lists = {
        "volume": ([F.desc("n")], volume_k),
        "most_positive": ([F.desc("avg_sentiment")], k),
        "most_negative": ([F.asc("avg_sentiment")], k),
        "high_impact": ([F.desc("high_impact")], k),
    }
    return union_all(
        [top_k(stats, [*o, F.asc("ticker")], size).withColumn("list", F.lit(name)) for name, (o, size) in lists.items()]
    )


def temporal_stats(news: DataFrame) -> DataFrame:
    """By UTC weekday and by hour: count, mean sentiment, high-impact count; one scan for both."""
    kinds = F.array(
        F.struct(F.lit("weekday").alias("kind"), F.date_format("event_time", "EEEE").alias("bucket")),
        F.struct(F.lit("hour").alias("kind"), F.hour("event_time").cast("string").alias("bucket")),
    )
    rows = news.select(S, "impact_level", F.explode(kinds).alias("k"))
    return rows.groupBy(F.col("k.kind").alias("kind"), F.col("k.bucket").alias("bucket")).agg(
        F.count("*").alias("n"), F.avg(S).alias("avg_sentiment"), _high().alias("high_impact")
    )


def busiest_hours(news: DataFrame, k: int = 5) -> DataFrame:
    hours = news.groupBy(F.hour("event_time").alias("hour")).agg(F.count("*").alias("n"))
    return top_k(hours, [F.desc("n"), F.asc("hour")], k)


def volume_stats(news: DataFrame) -> DataFrame:
    """(date, ticker) article counts binned; days, mean and largest count per bin."""
    per_day = news.groupBy("date", "ticker").agg(F.count("*").alias("n"))
    bins = per_day.withColumn("bin", interval(F.col("n"), VOLUME_EDGES, VOLUME_BINS, open_end=True))
    return bins.groupBy("bin").agg(
        F.count("*").alias("ticker_days"), F.avg("n").alias("avg_articles"), F.max("n").alias("max_articles")
    )


def volume_totals(news: DataFrame) -> DataFrame:
    """Articles, distinct tickers, and their ratio: the fallback when no dates are known."""
    per_ticker = news.groupBy("ticker").agg(F.count("*").alias("n"))
    return per_ticker.agg(
        F.sum("n").alias("articles"),
        F.count("ticker").alias("tickers"),
        F.try_divide(F.sum("n").cast("double"), F.count("ticker")).alias("articles_per_ticker"),
    )


def impact_stats(news: DataFrame) -> DataFrame:
    return group_stats(news, "impact_level").drop("high_impact")


def sentiment_verdict(news: DataFrame, majority: float = 0.6) -> DataFrame:
    """bullish or bearish when more than the majority of articles lean that way."""
    pos = F.avg((F.col(S) > POSITIVE).cast("double"))
    neg = F.avg((F.col(S) < NEGATIVE).cast("double"))
    return news.agg(pos.alias("positive_share"), neg.alias("negative_share")).withColumn(
        "verdict", _lean(F.col("positive_share"), F.col("negative_share"), majority)
    )


# Which figures each pattern reports.
BASIC_FIGURES = ("n", "avg_sentiment", "high_impact")
ALL_FIGURES = (*BASIC_FIGURES, "std_sentiment", "avg_relevance")
PATTERNS = {
    "sentiment_range": ("bin", BASIC_FIGURES),
    "source": ("source", ALL_FIGURES),
    "weekday": ("weekday", BASIC_FIGURES),
    "hour": ("hour", BASIC_FIGURES),
    "impact": ("impact_level", ("n", "avg_sentiment", "std_sentiment", "avg_relevance")),
    "ticker": ("ticker", ALL_FIGURES),
    "verdict": ("everything", ("positive_share", "negative_share")),
}
KEYWORD_FIGURES = ("n", "avg_sentiment", "high_impact_pct")


def _lean(positive: Column, negative: Column, majority: float) -> Column:
    return F.when(positive > majority, "bullish").when(negative > majority, "bearish").otherwise("mixed")


def pattern_report(news: DataFrame, categories: Mapping[str, Sequence[str]] | None = None, majority: float = 0.6) -> DataFrame:
    """Every pattern statistic as long rows (pattern, key, metric, value).

    The table is scanned once: each row is expanded to one (pattern, key) pair per
    statistic and aggregated with partial sums.  Only the per-day volumes need a
    second, two-level aggregation.  ``categories`` (name to terms) adds the articles whose title holds a term of each;
    the key of the verdict is the verdict.
    """
    from tapewire.operators.matching import any_term, padded

    keyed = news.withColumns(
        {
            "bin": interval(F.col(S), SENTIMENT_EDGES, SENTIMENT_BINS),
            "weekday": F.date_format("event_time", "EEEE"),
            "hour": F.hour("event_time").cast("string"),
            "everything": F.lit("all"),
        }
    )
    pairs = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(k).alias("key")) for p, (k, _) in PATTERNS.items()])
    if categories:
        keyed = once(keyed, _text=padded(F.col("title")))
        named = [
            F.when(any_term(F.col("_text"), terms), F.struct(F.lit("keyword").alias("pattern"), F.lit(name).alias("key")))
            for name, terms in categories.items()
        ]
        pairs = F.concat(pairs, F.array_compact(F.array(*named)))
    rows = keyed.select(S, "impact_level", "relevance_score", F.explode(pairs).alias("p"))
    stats = rows.groupBy(F.col("p.pattern").alias("pattern"), F.col("p.key").alias("key")).agg(
        F.count("*").alias("n"),
        F.avg(S).alias("avg_sentiment"),
        _high().alias("high_impact"),
        F.coalesce(F.stddev_samp(S), F.lit(0.0)).alias("std_sentiment"),
        F.avg("relevance_score").alias("avg_relevance"),
        (F.count_if(F.col("impact_level") == "high") * 100.0 / F.count("*")).alias("high_impact_pct"),
        F.avg((F.col(S) > POSITIVE).cast("double")).alias("positive_share"),
        F.avg((F.col(S) < NEGATIVE).cast("double")).alias("negative_share"),
    )
    lean = _lean(F.col("positive_share"), F.col("negative_share"), majority)
    stats = stats.withColumn("key", F.when(F.col("pattern") == "verdict", lean).otherwise(F.col("key")))
    wanted = (F.col("pattern") == "keyword") & F.col("metric").isin(*KEYWORD_FIGURES)
    for p, (_, figures) in PATTERNS.items():
        wanted = wanted | ((F.col("pattern") == p) & F.col("metric").isin(*figures))
    every = (*ALL_FIGURES, "high_impact_pct", "positive_share", "negative_share")
    long = _long(stats.where("key is not null"), ["pattern", "key"], every).where(wanted)
    renamed = F.when(F.col("pattern").isin("weekday", "hour"), "temporal").otherwise(F.col("pattern"))
    volume = volume_stats(news).select(F.lit("volume").alias("pattern"), F.col("bin").alias("key"), "*")
    return long.withColumn("pattern", renamed).unionByName(
        _long(volume, ["pattern", "key"], ("ticker_days", "avg_articles", "max_articles"))
    )


def _long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    wide = df.select(*ids, *[F.col(c).cast("double") for c in metrics])
    return wide.unpivot(list(ids), list(metrics), "metric", "value")


# ---- stored batches ------------------------------------------------------------------------


def batch_stats(news: DataFrame, day: str = "date") -> DataFrame:
    """Per batch: positive, neutral, negative counts, mean and percentages, always derived on read."""
    n = F.count("*")
    pos, neg = F.count_if(F.col(S) > POSITIVE), F.count_if(F.col(S) < NEGATIVE)
    return news.groupBy(F.col(day).alias("batch_date")).agg(
        n.alias("articles"),
        pos.alias("positive"),
        (n - pos - neg).alias("neutral"),
        neg.alias("negative"),
        F.avg(S).alias("avg_sentiment"),
        (pos / n * 100).alias("positive_pct"),
        (neg / n * 100).alias("negative_pct"),
    )


def store_metadata(news: DataFrame, day: str = "date") -> DataFrame:
    per_batch = news.groupBy(F.col(day).alias("d")).agg(F.count("*").alias("n"))
    return per_batch.agg(
        F.count("d").alias("batches"), F.sum("n").alias("articles"), F.min("d").alias("earliest"), F.max("d").alias("latest")
    )


# ---- exploration ----------------------------------------------------------------------------


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every value of several columns: one explode and one aggregation, not one per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def sentiment_profile(news: DataFrame) -> DataFrame:
    """Mean, exact median, extremes and threshold counts of sentiment."""
    median = exact_quantiles(news, S, [0.5]).select("value").scalar()
    return news.agg(
        F.count("*").alias("n"),
        F.avg(S).alias("mean"),
        F.min(S).alias("min"),
        F.max(S).alias("max"),
        F.count_if(F.col(S) > 0.5).alias("above_half"),
        F.count_if(F.col(S) < -0.5).alias("below_half"),
    ).withColumn("median", median)


def sector_stats(preds: DataFrame) -> DataFrame:
    return preds.groupBy("sector").agg(
        F.avg("prediction_score").alias("avg_score"),
        F.avg("avg_sentiment").alias("avg_sentiment"),
        F.sum("news_count").alias("news_count"),
        F.count("*").alias("tickers"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson coefficients as rows (a, b, r); every pair in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
            for i, (x, y) in enumerate(pairs)
            for a, b in ([(x, y)] if x == y else [(x, y), (y, x)])
        ]
    )
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, max of several columns as rows."""
    wide = df.agg(
        *[f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in
          (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                *[F.col(f"{n}_{c}").alias(n) for n in ("n", "mean", "std", "min", "max")],
            )
            for c in columns
        ]
    )
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def label_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts with their share of the table, as percentages."""
    counts = value_counts(df, columns)
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn("share_pct", F.col("n") * 100.0 / total)


def training_profile(df: DataFrame, numeric: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Numeric summaries and label shares as long rows (kind, field, metric, value)."""
    stats = describe_columns(df, numeric).withColumn("n", F.col("n").cast("double"))
    stats = stats.unpivot("field", ["n", "mean", "std", "min", "max"], "metric", "value").withColumn(
        "kind", F.lit("numeric")
    )
    shares = label_shares(df, labels).select(
        "field", F.col("value").alias("metric"), F.col("share_pct").alias("value"), F.lit("label").alias("kind")
    )
    return stats.unionByName(shares)


# ---- dashboard figures ------------------------------------------------------------------------


def daily_sentiment_trend(news: DataFrame, ticker: str, pattern: str = SYMBOL) -> DataFrame:
    """Mean sentiment per day of the articles that serve a ticker: its own and those naming it in the title."""
    serves = F.array_contains(names_in_title(news, pattern), ticker)
    return news.where(serves).groupBy("date").agg(F.avg(S).alias("avg_sentiment"))


def share_of_total(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Counts and percentage of all rows per value, optionally the k largest."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    out = counts.withColumn("pct", F.col("n") * 100.0 / df.agg(F.count("*")).scalar())
    return out if k is None else top_k(out, [F.desc("n"), F.asc("value")], k)


def sector_rollup_other(df: DataFrame, k: int = 8) -> DataFrame:
    """The k largest known sectors, the rest as 'Other', missing ones as 'Unknown'."""
    from tapewire.functions.text import normalize_sector

    counts = df.groupBy(normalize_sector(F.col("sector")).alias("sector")).agg(F.count("*").alias("n"))
    known = top_k(counts.where(F.col("sector") != "Unknown"), [F.desc("n"), F.asc("sector")], k)
    named = counts.join(F.broadcast(known.select("sector", F.lit(True).alias("_known"))), "sector", "left")
    bucket = F.when(F.col("sector") == "Unknown", "Unknown").when(F.col("_known"), F.col("sector")).otherwise("Other")
    return named.groupBy(bucket.alias("sector")).agg(F.sum("n").alias("n"))


def market_verdict(preds: DataFrame, edge: float = 1.5) -> DataFrame:
    buys = F.count_if(F.col("recommendation").isin("BUY", "STRONG BUY"))
    sells = F.count_if(F.col("recommendation").isin("SELL", "STRONG SELL"))
    return preds.agg(buys.alias("buys"), sells.alias("sells")).withColumn(
        "verdict",
        F.when(F.col("buys") > F.col("sells") * edge, "bullish")
        .when(F.col("sells") > F.col("buys") * edge, "bearish")
        .otherwise("neutral"),
    )


def dashboard_metrics(preds: DataFrame) -> DataFrame:
    rec = F.col("recommendation")
    n = F.count("*")
    return preds.agg(
        F.count_if(rec.isin("BUY", "STRONG BUY")).alias("buys"),
        F.count_if(rec == "HOLD").alias("holds"),
        F.count_if(rec.isin("SELL", "STRONG SELL")).alias("sells"),
        F.avg(F.when(F.col("news_count") > 0, F.col("confidence"))).alias("avg_confidence"),
        (F.count_if(F.col("avg_sentiment") > POSITIVE) * 100.0 / n).alias("positive_pct"),
        (F.count_if(F.col("avg_sentiment") < NEGATIVE) * 100.0 / n).alias("negative_pct"),
    )


def sector_performance(quotes_with_sector: DataFrame) -> DataFrame:
    return quotes_with_sector.groupBy("sector").agg(F.avg("change_percent").alias("avg_change_percent"))

