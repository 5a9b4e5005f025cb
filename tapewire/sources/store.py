"""The partitioned article store and the other sinks.

The store is Parquet partitioned by ``event_date`` and ``batch``.  A batch writes
only its own partitions with dynamic overwrite, so repeating a failed batch replaces
what it wrote and never touches another batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.operators.dedupe import dedupe_keys
from tapewire.operators.joins import event_key
from tapewire.schema import LEDGER
from tapewire.sources import identity as identity_index
from tapewire.sources.paths import read_path, write_partitions


WRITERS = 4  # tasks, and so files, a day and batch


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds any data yet."""
    return read_path(lambda: spark.read.parquet(path)) is not None


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored events; filters on ``event_date`` prune partitions."""
    return spark.read.parquet(path)


def append_events(
    df: DataFrame,
    path: str,
    batch: str,
    day: str = "event_date",
    key: str = "article_id",
    identity: Sequence[str] | None = None,
    span: str = "scraped_at",
    horizon: str | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Append the rows that are not stored yet and return how many there were.

    Two rows are the same article when their ``identity`` columns agree (by default
    ``event_key``: folded title and url, ticker, collection second).  Duplicates inside
    the batch go first, by map-side combining; then those that another batch has stored, however old: the identity index
    says which of its files may hold one of the batch's keys, and only these are read.  A store without an index gets one first.
    With a ``horizon`` only stored rows whose ``span`` time is missing or lies within the batch's own, widened by it, are compared: a
    range Parquet statistics can skip on; a batch with a missing ``span`` is still compared with everything.  ``scorer`` adds
    columns to the rows that are left, so nothing known already is scored again.

    The index is written behind the rows; a batch that dies in between is repeated, and replaces both.
    """
    spark = df.sparkSession
    same = event_key() if identity is None else F.struct(*identity)
    fresh = dedupe_keys(df.withColumn("_key", same), ["_key"], key)
    if exists(spark, path):
        stored = read_store(spark, path)
        if horizon is not None:
            near = _near(df, stored.where(F.col("batch") != batch), span, horizon)
            fresh = fresh.join(near.select(same.alias("_key")).distinct(), "_key", "left_anti")
        else:
            keyed = fresh.select("*", *identity_index.digest(F.col("_key")))
            files = identity_index.files_to_open(spark, keyed.select("k1", "k2"), path, batch)
            if files is None:
                identity_index.record(stored.select("batch", *identity_index.digest(same)), path)
                files = identity_index.files_to_open(spark, keyed.select("k1", "k2"), path, batch)
            fresh = keyed.join(identity_index.stored_keys(spark, path, files), ["k1", "k2"], "left_anti").drop("k1", "k2")
    fresh = fresh.drop("_key")
    rows = scorer(fresh) if scorer else fresh
    write_partitions(by_day(rows.withColumn("batch", F.lit(batch)), day, key), path, [day, "batch"])
    written = read_path(lambda: read_store(spark, path).where(F.col("batch") == batch))
    if written is None:
        return 0
    if horizon is None:
        identity_index.record(written.select("batch", *identity_index.digest(same)), path)
    return written.count()  # of this batch's partitions alone, from Parquet footers


def _near(df: DataFrame, stored: DataFrame, span: str, horizon: str) -> DataFrame:
    """Stored rows of about the batch's own times."""
    ends = df.agg(F.min(span).alias("lo"), F.max(span).alias("hi"), F.count_if(F.col(span).isNull()).alias("missing")).first()
    if ends.lo is None or ends.missing:
        return stored
    widen = F.expr(f"INTERVAL {horizon}")
    return stored.where(F.col(span).between(F.lit(ends.lo) - widen, F.lit(ends.hi) + widen) | F.col(span).isNull())


def by_day(df: DataFrame, day: str, key: str) -> DataFrame:
    """Rows dealt to at most ``WRITERS`` tasks a day, so that a day gets few files and a hot day still several writers."""
    return df.repartition(F.col(day), F.pmod(F.xxhash64(key), F.lit(WRITERS)))


def compact(spark: SparkSession, path: str, new_path: str, closed_before: str, day: str = "event_date", key: str = "article_id") -> DataFrame:
    """A new version of the store in which every day before ``closed_before`` is one batch of at most ``WRITERS`` files.

    Later days keep their batches, so a micro-batch that is repeated still overwrites its own.
    """
    old = read_store(spark, path)
    closed = F.col(day) < F.lit(closed_before).cast("date")
    batch = F.when(closed, F.lit("compact")).otherwise(F.col("batch"))
    write_partitions(by_day(old.withColumn("batch", batch), day, key), new_path, [day, "batch"])
    return read_store(spark, new_path)


def upsert_batch(df: DataFrame, path: str, day: str, run: str, key: str = "article_id") -> DataFrame:
    """Add a day's unseen titles to the history; returns one row of (batch_date, added, total)."""
    spark = df.sparkSession
    rows = dedupe_keys(df, ["title"], key).withColumn("batch_date", F.lit(day).cast("date"))
    if exists(spark, path):
        seen = read_store(spark, path).where((F.col("batch_date") == F.lit(day).cast("date")) & (F.col("run") != run))
        rows = rows.join(seen.select("title").distinct(), "title", "left_anti").select(*rows.columns)
    write_partitions(rows.withColumn("run", F.lit(run)), path, ["batch_date", "run"])
    stored = read_store(spark, path).where(F.col("batch_date") == F.lit(day).cast("date"))
    return stored.agg(
        F.lit(day).cast("date").alias("batch_date"),
        F.count_if(F.col("run") == run).alias("added"),
        F.count("*").alias("total"),
    )


def retained(store: DataFrame, keep_days: int, as_of: str, day: str = "batch_date") -> DataFrame:
    """Rows of batches not older than the cutoff; on a partitioned store a partition filter."""
    return store.where(F.col(day) >= F.date_sub(F.lit(as_of).cast("date"), keep_days))


def retain(spark: SparkSession, path: str, new_path: str, keep_days: int, as_of: str) -> DataFrame:
    """Write the retained batches as a new version; the old path is never overwritten in place."""
    kept = retained(read_store(spark, path), keep_days, as_of)
    write_partitions(kept, new_path, ["batch_date", "run"])
    return read_store(spark, new_path)


def rescore(spark: SparkSession, path: str, new_path: str, scorer) -> DataFrame:
    """Re-run scoring (``DataFrame -> DataFrame``) over the store into a new version path."""
    old = read_store(spark, path)
    write_partitions(scorer(old), new_path, ["event_date", "batch"])
    return read_store(spark, new_path)


# ---- snapshots and results -------------------------------------------------------------------------

SNAPSHOT = {
    "news": ("title", "source", "ticker", "event_time", "sentiment_compound", "sentiment_label", "impact_level", "relevance_score"),
    "predictions": (
        "ticker", "company_name", "sector", "news_count", "avg_sentiment", "news_sentiment_score", "momentum_normalized",
        "prediction_score", "recommendation", "confidence",
    ),
    "quotes": ("ticker", "company_name", "sector", "price", "previous_close", "change", "change_percent", "volume"),
}


def write_snapshot(news: DataFrame, predictions: DataFrame, quotes: DataFrame, path: str) -> None:
    """Overwrite three projected tables; quotes without a usable price are left out."""
    tables = {"news": news, "predictions": predictions, "quotes": quotes.where(F.col("price") > 0)}
    for name, df in tables.items():
        df.select(*[c for c in SNAPSHOT[name] if c in df.columns]).write.mode("overwrite").parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in SNAPSHOT}


def write_patterns(report: DataFrame, path: str) -> None:
    """Long pattern rows, one folder per pattern."""
    write_partitions(report, path, ["pattern"])


def patterns_as_json(report: DataFrame) -> DataFrame:
    """One JSON document per (pattern, key)."""
    metrics = F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))
    return report.groupBy("pattern", "key").agg(F.to_json(metrics).alias("document"))


# ---- ledger -----------------------------------------------------------------------------------------------


def ledger_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Per-day fetch records in the ledger's schema."""
    return spark.createDataFrame(rows, LEDGER)


def day_records(due: DataFrame, status: DataFrame, written: DataFrame | None, recorded_at: Column) -> DataFrame:
    """Ledger records of the days in ``due``: what was fetched, from ``status`` (day, calls, fetched, corrupt, error), and how many rows
    of ``written`` (day) are new.  A day that neither names gets a record of zeros.  One row a day throughout."""
    found = due.select("day").distinct().join(status, "day", "left")
    if written is not None:
        found = found.join(written.groupBy("day").agg(F.count("*").alias("appended")), "day", "left")
    else:
        found = found.withColumn("appended", F.lit(0).cast("long"))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return found.select("day", zero("calls", "int"), zero("fetched", "long"), zero("appended", "long"), zero("corrupt", "int"), "error", recorded_at.alias("recorded_at"))


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Latest record per day."""
    from tapewire.operators.scale import first_per_key

    return first_per_key(spark.read.schema(LEDGER).parquet(path), ["day"], [F.col("recorded_at")], last=True)


def staleness(ledger: DataFrame, as_of: str, max_age_minutes: int = 60) -> DataFrame:
    """Age of the newest record in minutes and whether a refresh is due (also when empty)."""
    age = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.max("recorded_at"))) / 60.0
    return ledger.agg(age.alias("age_minutes")).withColumn(
        "refresh", F.coalesce(F.col("age_minutes") > max_age_minutes, F.lit(True))
    )
