"""Text, symbol, URL and time cleaning as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH_FLOOR = "2000-01-01"
# The spellings of time found in feeds, most specific first.
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "d MMM yyyy HH:mm:ss Z",
    "yyyyMMdd'T'HHmmss'Z'",
    "yyyy-MM-dd",
    "MMM-dd-yy",
    "MMM-dd-yy hh:mma",
)


def blank_to_null(c: Column) -> Column:
    """Trimmed text; blank and the literal 'nan' count as missing."""
    t = F.trim(c)
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def clean_text(df: DataFrame, columns: Sequence[str] = ("title", "description", "source", "url")) -> DataFrame:
    """Trim the text columns to NULL-if-blank, upper-case the ticker."""
    df = df.withColumns({c: blank_to_null(F.col(c)) for c in columns if c in df.columns})
    return df.withColumn("ticker", F.upper(blank_to_null(F.col("ticker")))) if "ticker" in df.columns else df


def drop_short_titles(df: DataFrame, n: int = 5) -> DataFrame:
    return df.where(F.length("title") > n)


def market_symbol(c: Column) -> Column:
    """Trimmed upper-case symbol with a dash for the share class."""
    return F.translate(F.upper(F.trim(c)), ".", "-")


def valid_symbol(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).rlike(r"^[A-Z0-9.\-]{1,10}$"), F.lit(False))


def normalize_url(c: Column) -> Column:
    """Lower-case host and path: no scheme, query, fragment or trailing slashes."""
    u = F.lower(F.trim(c))
    bare = F.regexp_replace(F.regexp_replace(u, r"^[a-z][a-z0-9+.\-]*://", ""), r"[?#].*$", "")
    return F.regexp_replace(bare, r"/+$", "")


def sanitize_text(c: Column, n: int | None = None) -> Column:
    """Without control characters (newline and tab stay), trimmed, cut to n characters if asked."""
    cut = c if n is None else F.substring(c, 1, n)
    return F.trim(F.regexp_replace(cut, r"[\x00-\x08\x0B-\x1F\x7F]", ""))


def title_prefix(c: Column, n: int = 100) -> Column:
    """Display form of a title; the stored title stays whole."""
    return F.substring(c, 1, n)


def parse_time(columns: Sequence[Column], relative_to: Column | None = None) -> Column:
    """First parseable of several texts over the known formats.

    'Today hh:mm' and 'Yesterday hh:mm' are resolved against ``relative_to`` (when
    the row was collected), so a re-run years later gives the same moment.
    """
    tries = []
    for c in columns:
        # mail-style times: the weekday says nothing new, zone names become offsets
        t = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9}, +", "")
        t = F.regexp_replace(t, r" (GMT|UTC|Z)$", " +0000")
        tries += [F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS]
        if relative_to is not None:
            day = F.to_date(relative_to)
            word = F.lower(F.regexp_extract(t, r"^(?i)(today|yesterday)", 1))
            clock = F.upper(F.trim(F.regexp_replace(t, r"^(?i)(today|yesterday)", "")))
            base = F.when(word == "today", day).when(word == "yesterday", F.date_sub(day, 1))
            text = F.concat_ws(" ", base.cast("string"), F.when(clock != "", clock).otherwise("00:00"))
            tries += [
                F.when(base.isNotNull(), F.try_to_timestamp(text, F.lit(f)))
                for f in ("yyyy-MM-dd HH:mm", "yyyy-MM-dd hh:mma", "yyyy-MM-dd hh:mm a")
            ]
    return F.coalesce(*tries)


def event_time(published: Column, scraped: Column, floor: str = EPOCH_FLOOR) -> Column:
    """Publication time unless missing or before the floor, then collection time."""
    return F.when(published >= F.lit(floor).cast("timestamp"), published).otherwise(scraped)


def stamp_day(day: Column) -> Column:
    """Noon UTC of a day."""
    return F.make_timestamp(F.year(day), F.month(day), F.day(day), F.lit(12), F.lit(0), F.lit(0))


def day_from_name(c: Column) -> Column:
    """The yyyyMMdd or yyyy-MM-dd date in a file name."""
    digits = F.regexp_replace(F.regexp_extract(c, r"(\d{4}-?\d{2}-?\d{2})", 1), "-", "")
    return F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))


def normalize_sector(c: Column) -> Column:
    t = F.trim(c)
    missing = t.isNull() | F.lower(t).isin("", "n/a", "unknown")
    return F.when(missing, "Unknown").otherwise(t)
