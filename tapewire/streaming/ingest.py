"""Article ingest and daily buckets as Structured Streaming jobs over landed files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from tapewire.operators.aggregates import NEWS_COLUMNS, daily_news
from tapewire.operators.scale import dim_join, first_per_key
from tapewire.sources.store import append_events, by_day, exists, read_store

Scorer = Callable[[DataFrame], DataFrame]


def landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A file stream; the source remembers which files it has processed."""
    reader = spark.readStream.schema(schema).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def incremental_news(
    stream: DataFrame,
    store: str,
    checkpoint: str,
    scorer: Scorer | None = None,
    dedupe_on: Sequence[str] = ("title", "url"),
    lateness: str = "2 days",
    horizon: str | None = None,
    stateful: bool = False,
    available_now: bool = True,
) -> StreamingQuery:
    """Drop repeats, score, and append what is not stored yet.

    Repeats are found per micro-batch by map-side combining and against all stored
    keys, however old, so a text copied a million times never meets in one task and the
    store is the only state.  A ``horizon`` limits the comparison to stored rows of about the batch's own
    times, for feeds that may repeat old titles.  ``stateful`` adds the stream's own duplicate state in
    front, for feeds with small batches and even keys.  Scoring runs inside the
    micro-batch; a repeated micro-batch writes the same ``batch`` partition again.
    """

    def land(df: DataFrame, batch_id: int) -> None:
        rows = df.withColumn("event_date", F.to_date("event_time")).persist()  # several actions read the micro-batch
        append_events(
            rows, store, f"b{batch_id:012d}", identity=list(dedupe_on), span="event_time", horizon=horizon, scorer=scorer
        )
        rows.unpersist()

    if stateful:
        stream = stream.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(list(dedupe_on))
    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def daily_bucket(
    stream: DataFrame, out: str, checkpoint: str, lateness: str = "3 days", available_now: bool = True
) -> StreamingQuery:
    """Per (ticker, UTC day) news aggregates kept in stream state, changed days written per batch."""
    s = F.col("sentiment_compound")
    agg = (
        stream.withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", "1 day"), "ticker")
        .agg(
            F.count("*").alias("news_count"),
            F.coalesce(F.avg(s), F.lit(0.0)).alias("sent_mean"),
            F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("sent_std"),
            F.coalesce(F.min(s), F.lit(0.0)).alias("sent_min"),
            F.coalesce(F.max(s), F.lit(0.0)).alias("sent_max"),
            F.coalesce(F.avg("relevance_score"), F.lit(0.0)).alias("relevance_mean"),
            F.count_if(F.col("impact_level") == "high").alias("high_impact_count"),
            F.count_if(F.col("impact_level") == "macro").alias("macro_count"),
        )
        .select("ticker", F.to_date("window.start").alias("date"), *NEWS_COLUMNS)
    )

    def upsert(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(out)

    writer = agg.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_buckets(spark: SparkSession, out: str) -> DataFrame:
    """The latest version of each (ticker, day)."""
    rows = spark.read.parquet(out)
    return first_per_key(rows, ["ticker", "date"], [F.col("batch")], last=True).drop("batch")


def late_rows(
    stream: DataFrame, side: str, marks: str, checkpoint: str, lateness: str = "3 days", available_now: bool = True
) -> StreamingQuery:
    """Rows the daily bucket has closed on go to a side table.

    The mark a batch is compared with is the newest event time of the batches before
    it less the lateness, which is the watermark ``daily_bucket`` uses.  ``marks``
    holds one row per batch.
    """

    def split(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        if exists(spark, marks):
            seen = spark.read.parquet(marks).where(F.col("batch") < batch_id)
            limit = seen.agg(F.max("newest") - F.expr(f"INTERVAL {lateness}")).scalar()
            # a bucket closes when its end passes the mark
            bucket_end = F.date_trunc("day", "event_time") + F.expr("INTERVAL 1 DAY")
            late = df.where(bucket_end <= limit)
            late.withColumns({"batch": F.lit(batch_id), "date": F.to_date("event_time")}).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("batch").parquet(side)
        df.agg(F.max("event_time").alias("newest")).where("newest is not null").withColumn(
            "batch", F.lit(batch_id)
        ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(marks)

    writer = stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# sums that a day's figures follow from, and merge by addition (lo, hi: by the least and the greatest)
_SUMS = {"n": int, "s": float, "ss": float, "lo": float, "hi": float, "sn": int, "r": float, "rn": int, "high": int, "macro": int}
_FIELDS = ["event_time", "article_id", "source", "sentiment_compound", "impact_level", "relevance_score"]
_OUT = ["kind", "ticker", "date", *_FIELDS, *_SUMS]


# the state of a group of tickers on a day: a row per ticker, column by column; a double that is missing is NaN
_STATE = ", ".join(["ticker array<string>", *[f"{c} array<{'long' if kind is int else 'double'}>" for c, kind in _SUMS.items()]])


def _sums(rows: pd.DataFrame) -> pd.DataFrame:
    """The sums of every ticker of the rows, in :data:`_SUMS`' columns."""
    v, w, level = rows["sentiment_compound"].astype(float), rows["relevance_score"].astype(float), rows["impact_level"]
    parts = {
        "n": 1, "s": v, "ss": v * v, "lo": v, "hi": v, "sn": v.notna().astype(int), "r": w, "rn": w.notna().astype(int),
        "high": (level == "high").astype(int), "macro": (level == "macro").astype(int),
    }
    return _merged(pd.DataFrame({"ticker": rows["ticker"], **parts}))


def _merged(sums: pd.DataFrame) -> pd.DataFrame:
    """One row per ticker; a NULL ticker is a ticker."""
    by, added = sums.groupby("ticker", dropna=False, sort=False), [c for c in _SUMS if c not in ("lo", "hi")]
    return by[added].sum().assign(lo=by["lo"].min(), hi=by["hi"].max()).reset_index()


def _closing(key, frames, state) -> Iterator[pd.DataFrame]:
    """A day of a group of tickers: rows behind the watermark go out as they are, the others into the sums; the timer of the day's end closes it."""
    _, day = key
    end = int((pd.Timestamp(day) + pd.Timedelta(days=1)).timestamp() * 1000)
    held = pd.DataFrame(dict(zip(["ticker", *_SUMS], state.get))) if state.exists else None
    if state.hasTimedOut:
        state.remove()
        yield _bucket("closed", day, held)
        return
    parts = []
    for rows in frames:
        if end <= state.getCurrentWatermarkMs():
            yield rows.assign(kind="late", **{c: None for c in _SUMS})[_OUT]
            continue
        parts.append(_sums(rows))
    if parts:
        fresh = pd.concat(parts)
        sums = _merged(pd.concat([held, fresh]) if held is not None else fresh)
        names = [None if pd.isna(t) else t for t in sums["ticker"]]
        state.update((names, *[sums[c].astype(kind).tolist() for c, kind in _SUMS.items()]))
        state.setTimeoutTimestamp(end)
        yield _bucket("open", day, sums[sums["ticker"].isin(fresh["ticker"])])


def _bucket(kind: str, day, sums: pd.DataFrame) -> pd.DataFrame:
    return sums.assign(kind=kind, date=day, **{c: None for c in _FIELDS})[_OUT]


def closing_days(
    stream: DataFrame, out: str, side: str, checkpoint: str, lateness: str = "3 days", available_now: bool = True, groups: int = 16
) -> StreamingQuery:
    """Daily sums per (ticker, UTC day) that close behind the watermark; rows that come later go to the side table.

    One stateful operator does both, so a row is counted or set aside, never both or neither: the query's own
    watermark decides, and a timer at the end of a day emits its last version and drops the state.  ``out`` is partitioned by
    day and batch (``state`` is open or closed), ``side`` likewise; a repeated micro-batch replaces its own partitions.
    The tickers of a day are kept in ``groups`` states, each read and written as a whole, so that calls follow days and
    groups, not tickers; all of a day close together.  A state's rows of a micro-batch pass in pieces and only sums are kept.
    """
    # An operator never sees rows behind the watermark of its own time column.  So the clock is the event time, of
    # whose watermark the query takes the least, and the column that reaches the operator is one that is never late.
    rows = stream.withWatermark("event_time", lateness)
    rows = rows.select("ticker", F.to_date("event_time").alias("date"), *_FIELDS[1:], (F.col("event_time") + F.expr("INTERVAL 0 SECOND")).alias("event_time"))
    rows = rows.where("date IS NOT NULL").withColumn("passes", F.lit("2200-01-01").cast("timestamp")).withWatermark("passes", "0 seconds")
    kinds = {int: "long", float: "double"}
    sums = ", ".join(f"{c} {kinds[k]}" for c, k in _SUMS.items())
    schema = f"kind string, ticker string, date date, {', '.join(f'{c} {rows.schema[c].dataType.simpleString()}' for c in _FIELDS)}, {sums}"
    rows = rows.withColumn("group", F.pmod(F.xxhash64("ticker"), F.lit(groups)))
    found = rows.groupBy("group", "date").applyInPandasWithState(_closing, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)

    def land(df: DataFrame, batch_id: int) -> None:
        rows = df.withColumn("batch", F.lit(batch_id)).persist()  # written to two tables
        late = rows.where("kind = 'late'").select("ticker", "date", *_FIELDS, "batch")
        days = rows.where("kind <> 'late'").select("ticker", "date", F.col("kind").alias("state"), *_SUMS, "batch")
        for table, path in ((late, side), (days, out)):
            by_day(table, "date", "ticker").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)
        rows.unpersist()

    writer = found.writeStream.outputMode("append").foreachBatch(land).option("checkpointLocation", checkpoint)
    conf, one = stream.sparkSession.conf, "spark.sql.streaming.statefulOperator.allowMultiple"
    before = conf.get(one, None)
    conf.set(one, "false")  # a query takes its settings when it starts; two time columns need a single stateful operator
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.unset(one) if before is None else conf.set(one, before)


def _figures(rows: DataFrame) -> DataFrame:
    """The daily news columns from sums."""
    mean = F.col("s") / F.col("sn")
    spread = F.greatest(F.col("ss") - F.col("s") * mean, F.lit(0.0)) / (F.col("sn") - 1)
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return rows.select(
        "ticker", "date", F.col("n").alias("news_count"), zero(F.when(F.col("sn") > 0, mean), "sent_mean"), zero(F.when(F.col("sn") > 1, F.sqrt(spread)), "sent_std"),
        zero(F.col("lo"), "sent_min"), zero(F.col("hi"), "sent_max"), zero(F.when(F.col("rn") > 0, F.col("r") / F.col("rn")), "relevance_mean"),
        F.col("high").alias("high_impact_count"), F.col("macro").alias("macro_count"), *[c for c in ("state",) if c in rows.columns],
    )


def day_sums(spark: SparkSession, out: str, since: str | None = None) -> DataFrame:
    """The latest version of each (ticker, day) that :func:`closing_days` wrote; ``since`` reads only the partitions of later days."""
    rows = read_store(spark, out)
    rows = rows if since is None else rows.where(F.col("date") >= F.lit(since).cast("date"))
    return first_per_key(rows, ["ticker", "date"], [F.struct("batch", F.when(F.col("state") == "closed", 1).otherwise(0))], last=True).drop("batch")


def with_late(days: DataFrame, late: DataFrame) -> DataFrame:
    """Daily figures with late rows counted in: their sums are merged into the (ticker, day) they belong to.

    Only late rows and one row per (ticker, day) are read, whatever the number of articles; equal to a full recount.
    """
    s, r, level = F.col("sentiment_compound"), F.col("relevance_score"), F.col("impact_level")
    more = late.groupBy("ticker", "date").agg(
        F.count("*").alias("n"), F.sum(s).alias("s"), F.sum(s * s).alias("ss"), F.min(s).alias("lo"), F.max(s).alias("hi"), F.count(s).alias("sn"),
        F.sum(r).alias("r"), F.count(r).alias("rn"), F.count_if(level == "high").alias("high"), F.count_if(level == "macro").alias("macro"),
    )
    both = days.select("ticker", "date", *_SUMS).unionByName(more)
    pick = {"lo": F.min, "hi": F.max}
    return _figures(both.groupBy("ticker", "date").agg(*[pick.get(c, F.sum)(c).alias(c) for c in _SUMS]))


def repair(buckets: DataFrame, events: DataFrame, late: DataFrame) -> DataFrame:
    """Buckets with the days of late rows recomputed in full from the stored events.

    Days are few and distinct; only their partitions of the store are read.
    """
    days = late.select(F.to_date("event_time").alias("date")).distinct()
    fresh = daily_news(dim_join(events, days, ["date"], "left_semi"))
    return dim_join(buckets, days, ["date"], "left_anti").unionByName(fresh.select(*buckets.columns))


def run_to_end(query: StreamingQuery) -> None:
    """Wait for an available-now query and raise what it raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


