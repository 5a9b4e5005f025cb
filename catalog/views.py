"""The library's tables as views over the test data, in Spark and as SQL text.

Each article keeps its whole text: the title is the first sentence and the
description is everything after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.operators.scale import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def impact_of(c):
    return (
        F.when(c == "error", "high").when(c == "signup", "macro").when(c == "purchase", "medium").otherwise("low")
    )


def news(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("article_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("source"),
        (F.least(F.col("value"), F.lit(200.0)) / 100.0 - 1.0).alias("sentiment_compound"),
        impact_of(F.col("event_type")).alias("impact_level"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("relevance_score"),
    )


NEWS = """news_events AS (
 SELECT event_id AS article_id, 'U' || CAST(user_id AS VARCHAR) AS ticker, ts AS event_time, CAST(ts AS DATE) AS date,
  event_type AS source, least(value, 200.0) / 100.0 - 1.0 AS sentiment_compound,
  CASE event_type WHEN 'error' THEN 'high' WHEN 'signup' THEN 'macro' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS impact_level,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS relevance_score
 FROM events)"""


def bars(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return l.groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date")
    ).agg(
        F.min_by("px", order).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", order).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


BARS = """bars AS (
 SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
  min_by(px, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open, max(px) AS high, min(px) AS low,
  max_by(px, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close, sum(l_quantity) AS volume
 FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem) x GROUP BY 1, 2)"""


def bars_u(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.to_date("ts").alias("date"))
        .agg(
            F.min_by("value", "event_id").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
    )


BARS_U = """bars_u AS (
 SELECT 'U' || CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date,
  min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close,
  CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Title = first sentence, description = the rest; the url column is invented per source."""
    d = spread(table(spark, sf, "documents"))
    title = F.regexp_extract("text", r"^[^.\n]*", 0)
    return d.select(
        F.col("doc_id").alias("article_id"),
        title.alias("title"),
        F.expr(r"substring(text, length(regexp_extract(text, '^[^.\n]*', 0)) + 1)").alias("description"),
        "source",
        "lang",
        F.concat(F.lit("S"), (F.col("doc_id") % 10 + 1).cast("string")).alias("ticker"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("?id="), F.col("doc_id")).alias("url"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"),
    )


ARTICLES = r"""articles AS (
 SELECT doc_id AS article_id, regexp_extract(text, '^[^.\n]*', 0) AS title,
  substring(text, length(regexp_extract(text, '^[^.\n]*', 0)) + 1) AS description, source, lang,
  'S' || CAST(doc_id % 10 + 1 AS VARCHAR) AS ticker,
  'https://' || source || '.example.com/' || lang || '?id=' || CAST(doc_id AS VARCHAR) AS url,
  DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date
 FROM documents)"""


def ticker_dim(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            F.col("s_name").alias("company_name"),
        )
    )


DIM = """ticker_dim AS (
 SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ticker, r_name AS sector, n_name AS industry, s_name AS company_name
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def customer_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Company and sector of the user tickers; customers in debt are not in the dimension."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return (
        c.where("c_acctbal >= 0")
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("ticker"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            F.col("c_name").alias("company_name"),
        )
    )


DIM_U = """customer_dim AS (
 SELECT 'U' || CAST(c_custkey AS VARCHAR) AS ticker, r_name AS sector, n_name AS industry, c_name AS company_name
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal >= 0)"""


NAMED_CODE = r"(?<![\p{L}\p{N}])(S[0-9]+)(?![\p{L}\p{N}])"


def named_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles whose title names a second supplier; every third has no ticker of its own."""
    other = F.concat(F.lit(" (S"), (F.col("article_id") % 7 + 1).cast("string"), F.lit(")"))
    own = F.when(F.col("article_id") % 3 != 0, F.col("ticker"))
    at = F.col("date").cast("timestamp") + F.make_dt_interval(hours=(F.col("article_id") % 24).cast("int"))
    return articles(spark, sf).withColumns({"title": F.concat("title", other), "ticker": own, "event_time": at})


# the CTE takes the name of the plain articles, so that SQL written for those reads these
NAMED = ARTICLES.replace("articles AS", "plain AS", 1) + """, articles AS (
 SELECT article_id, title || ' (S' || CAST(article_id % 7 + 1 AS VARCHAR) || ')' AS title, description, source, lang,
  CASE WHEN article_id % 3 <> 0 THEN ticker END AS ticker, url, date,
  CAST(date AS TIMESTAMP) + to_hours(CAST(article_id % 24 AS INTEGER)) AS event_time FROM plain)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return news(spark, sf).select(
        "article_id",
        "ticker",
        "date",
        F.col("sentiment_compound").alias("score"),
        ((F.col("sentiment_compound") + 1) / 2).alias("probability"),
        F.when(F.col("relevance_score") > 0.5, 1).otherwise(0).alias("label"),
    )


SCORED = """scored AS (
 SELECT article_id, ticker, date, sentiment_compound AS score, (sentiment_compound + 1) / 2 AS probability,
  CASE WHEN relevance_score > 0.5 THEN 1 ELSE 0 END AS label FROM news_events)"""


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    from tapewire.operators.ranking import last_quote

    return last_quote(bars(spark, sf))


QUOTES = """quotes AS (
 SELECT ticker, price, coalesce(previous_close, price) AS previous_close, price - coalesce(previous_close, price) AS change,
  CASE WHEN coalesce(previous_close, price) = 0 THEN 0.0
       ELSE (price - coalesce(previous_close, price)) / coalesce(previous_close, price) * 100 END AS change_percent, volume
 FROM (SELECT ticker, close AS price, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS previous_close, volume,
        row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars) q WHERE rn = 1)"""
