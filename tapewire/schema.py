"""Explicit schemas of every table and ``conform``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_SIMPLE = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(),
}


def _fields(text: str) -> list[T.StructField]:
    """'name type, name type' to fields; needs no session, so schemas are module constants."""
    return [T.StructField(n, _SIMPLE[t]) for n, t in (part.split() for part in text.split(","))]


def _struct(text: str) -> T.StructType:
    return T.StructType(_fields(text))


FEED_ARTICLE = T.StructType(
    _fields(
        "source string, title string, url string, ticker string, published_at string, description string, content string,"
        " author string, scraped_at string, is_reputable boolean"
    )
    + [T.StructField("topics", T.ArrayType(T.StringType()))]
)
WEB_ARTICLE = _struct(
    "domain string, language string, seendate string, socialimage string, sourcecountry string, title string, url string,"
    " url_mobile string, snippet string"
)
WEB_DAY = T.StructType(
    [
        T.StructField("articles", T.ArrayType(WEB_ARTICLE)),
        T.StructField("meta", _struct("calls int, day string, error string, fetched int, http_status int")),
    ]
)
SCORES = (
    "sentiment_compound double, sentiment_positive double, sentiment_negative double, sentiment_neutral double,"
    " sentiment_label string, impact_level string, relevance_score double, is_relevant boolean, is_impactful boolean,"
    " is_irrelevant boolean"
)
ARTICLE = "title string, description string, source string, url string, ticker string,"
NEWS_EVENTS_CSV = _struct(f"{ARTICLE} published_at string, scraped_at string, {SCORES}")
NEWS_EVENTS = _struct(f"{ARTICLE} event_time timestamp, scraped_at timestamp, {SCORES}")
BARS = _struct("ticker string, date date, open double, high double, low double, close double, volume double")
TICKER_DIM = _struct("ticker string, sector string, industry string, company_name string, updated_at timestamp")
HISTORY_ARTICLE = _struct(
    f"{ARTICLE} published_at string, sentiment_compound double, sentiment_label string, impact_level string, relevance_score double"
)
HISTORY_BATCH = T.StructType(
    _fields("date string, created_at string, updated_at string, article_count int")
    + [
        T.StructField("sentiment_stats", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("articles", T.ArrayType(HISTORY_ARTICLE)),
    ]
)
HISTORY = T.StructType(
    [
        T.StructField("metadata", _struct("created_at string, last_updated string")),
        T.StructField("batches", T.MapType(T.StringType(), HISTORY_BATCH)),
    ]
)
LEDGER = _struct("day date, calls int, fetched long, appended long, corrupt int, error string, recorded_at timestamp")


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Add the schema's missing columns with a default (NULL unless given); extra columns stay."""
    defaults = defaults or {}
    missing = {
        f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in schema.fields if f.name not in df.columns
    }
    return df.withColumns(missing) if missing else df
