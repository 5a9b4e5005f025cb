"""Reading landed files: event CSVs, raw day files, history documents, wide bars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewire.functions.text import blank_to_null, day_from_name, market_symbol, parse_time
from tapewire.operators.scale import first_per_key
from tapewire.schema import FEED_ARTICLE, HISTORY, NEWS_EVENTS_CSV, TICKER_DIM, WEB_DAY
from tapewire.sources.quoted_csv import read_quoted


def read_events(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Quoted, multi-line event CSV with malformed rows skipped; a large file is read in ranges by many tasks."""
    df = read_quoted(spark, path, NEWS_EVENTS_CSV)
    return df if columns is None else df.select(*columns)


def newest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column-pruned, newest first."""
    return df.select(*columns).orderBy(F.desc_nulls_last("event_time"))


# columns that only the feed shape has
FEED_ONLY = ("ticker", "author", "content", "topics", "scraped_at", "is_reputable")


# ---- raw day files ------------------------------------------------------------------------------


def _dated_name() -> Column:
    """A file's name; in a folder a day (``day=2024-01-31``) the folder's day goes in front, whatever the file is called."""
    folder = F.regexp_extract("_metadata.file_path", r"/day=([^/]+)/[^/]*$", 1)
    return F.concat_ws("/", F.nullif(folder, F.lit("")), "_metadata.file_name").alias("file_name")


def _day_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", _dated_name())


def parse_day_files(files: DataFrame) -> DataFrame:
    """(file_name, day, web, feed, meta, corrupt) from whole-file text of either shape."""
    is_list = F.ltrim("value").startswith("[")
    web = F.when(~is_list, F.from_json("value", WEB_DAY))
    feed = F.when(is_list, F.from_json("value", T.ArrayType(FEED_ARTICLE)))
    out = files.select("file_name", day_from_name(F.col("file_name")).alias("day"), web.alias("w"), feed.alias("feed"))
    # a list or object that does not parse, or an object without the articles field
    bad = F.coalesce(F.col("feed").isNull() & F.col("w.articles").isNull(), F.lit(True))
    return out.select("file_name", "day", F.col("w.articles").alias("web"), "feed", F.col("w.meta").alias("meta"), bad.alias("corrupt"))


def web_to_article(web: DataFrame) -> DataFrame:
    """Web-index rows in the article shape: the domain is the source."""
    return web.select(
        F.concat(F.lit("web:"), F.col("domain")).alias("source"),
        "title",
        "url",
        parse_time([F.col("seendate")]).alias("published_at"),
        F.col("snippet").alias("description"),
        F.col("language"),
        "day",
        *[F.lit(None).cast(FEED_ARTICLE[c].dataType).alias(c) for c in FEED_ONLY],
    )


def articles_of(days: DataFrame) -> DataFrame:
    """Articles of parsed day files, both shapes in one schema; corrupt files give no rows."""
    web = web_to_article(days.select("day", F.explode("web").alias("a")).select("a.*", "day"))
    feed = days.select("day", F.explode("feed").alias("a")).select("a.*", "day")
    feed = feed.select(
        "source", "title", "url", parse_time([F.col("published_at")], F.col("day").cast("timestamp")).alias("published_at"),
        "description", F.lit(None).cast("string").alias("language"), "day", *FEED_ONLY,
    )
    return web.unionByName(feed)


def read_raw_days(spark: SparkSession, path: str) -> DataFrame:
    return articles_of(parse_day_files(_day_files(spark, path)))


def status_of(days: DataFrame) -> DataFrame:
    """Per day file: rows, corrupt flag, reported error."""
    rows = F.greatest(F.coalesce(F.size("web"), F.lit(0)), F.coalesce(F.size("feed"), F.lit(0)))
    return days.select("day", F.when(F.col("corrupt"), 0).otherwise(rows).alias("rows"), "corrupt", F.col("meta.error").alias("error"))


def file_status(days: DataFrame) -> DataFrame:
    """One row per day: files, articles in them, unreadable files and the first error a file reports."""
    per_file = status_of(days)
    error = F.coalesce(F.col("error"), F.when(F.col("corrupt"), F.lit("unreadable file")))
    return per_file.groupBy("day").agg(
        F.count("*").alias("calls"), F.sum("rows").alias("fetched"), F.count_if("corrupt").alias("corrupt"), F.min(error).alias("error")
    )


def day_status(spark: SparkSession, path: str) -> DataFrame:
    return status_of(parse_day_files(_day_files(spark, path)))


def days_of(names: DataFrame) -> DataFrame:
    """Distinct days in file names."""
    return names.select(day_from_name(F.col("file_name")).alias("day")).where("day is not null").distinct()


def list_days(spark: SparkSession, path: str) -> DataFrame:
    """Days present, from file and folder names only (no file content is read)."""
    return days_of(spark.read.format("binaryFile").load(path).select(_dated_name()))


# ---- history document -----------------------------------------------------------------------------


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored article of date -> batch documents, tagged with its batch date."""
    return parse_history(spark.read.text(path, wholetext=True))


def parse_history(texts: DataFrame) -> DataFrame:
    """The documents in ``value``, exploded by batch and then by article."""
    doc = texts.select(F.from_json("value", HISTORY).alias("h"))
    batches = doc.select(F.explode("h.batches").alias("batch_date", "b"))
    return batches.select(F.to_date("batch_date").alias("batch_date"), F.explode("b.articles").alias("a")).select("batch_date", "a.*")


TRAINING_COLUMNS = (
    "title", "description", "source", "ticker", "published_at", "sentiment_compound", "sentiment_label", "impact_level", "relevance_score",
)


def export_training(history: DataFrame, columns: Sequence[str] = TRAINING_COLUMNS) -> DataFrame:
    """Flat training rows: the batch date and whichever of the wanted columns exist."""
    return history.select("batch_date", *[c for c in columns if c in history.columns])


# ---- dimension, bars --------------------------------------------------------------------------------


def read_ticker_dim(spark: SparkSession, path: str) -> DataFrame:
    return clean_ticker_dim(spark.read.schema(TICKER_DIM).option("header", True).csv(path))


def clean_ticker_dim(df: DataFrame) -> DataFrame:
    """Trimmed, symbol-normalised dimension, latest row per ticker."""
    text = ["sector", "industry", "company_name"]
    clean = df.withColumns({c: blank_to_null(F.col(c)) for c in text}).withColumn("ticker", market_symbol(F.col("ticker")))
    order = [F.coalesce("updated_at", F.lit("1970-01-01").cast("timestamp")), F.struct(*text)]
    return first_per_key(clean, ["ticker"], order, last=True)


FIELDS: Mapping[str, str] = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}


def bars_from_wide(df: DataFrame, sep: str = "|", date: str = "Date") -> DataFrame:
    """(ticker, field) column pairs such as ``AAPL|Close`` to one row per ticker and day.

    Each wide row is exploded in place; nothing is shuffled.
    """
    tickers = sorted({c.split(sep)[0] for c in df.columns if sep in c})

    def number(t: str, field: str) -> Column:
        name = f"{t}{sep}{field}"
        return (F.col(f"`{name}`").try_cast("double") if name in df.columns else F.lit(None).cast("double")).alias(FIELDS[field])

    rows = F.array(*[F.struct(F.lit(t).alias("ticker"), *[number(t, f) for f in FIELDS]) for t in tickers])
    long = df.select(F.to_date(date).alias("date"), F.explode(rows).alias("r")).select("r.ticker", "date", *[f"r.{v}" for v in FIELDS.values()])
    return long.where(F.col("close").isNotNull() & ~F.isnan("close"))
