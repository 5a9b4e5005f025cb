"""Resumable backfill: a stream whose offset is a day, oldest first.

The source only says which days are due; a micro-batch reads the files of its days, appends their articles and
then writes one ledger record a day, also for days without files.  What was done is the stream's own checkpoint, so a
run that is killed after day k goes on with day k + 1.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tapewire.functions.text import stamp_day
from tapewire.operators.scale import union_all
from tapewire.sources import readers as rd
from tapewire.sources.paths import read_path
from tapewire.sources.store import append_events, append_ledger, day_records, read_store

Scorer = Callable[[DataFrame], DataFrame]


class DayCursor(DataSource):
    """Rows (day) of a calendar range; options ``start``, ``end`` (both inclusive) and ``daysPerBatch``."""

    @classmethod
    def name(cls) -> str:
        return "day_cursor"

    def schema(self) -> str:
        return "day date"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Cursor(self.options)


class _Cursor(SimpleDataSourceStreamReader):
    """The offset is the last day handed out."""

    def __init__(self, options):
        self.start, self.end = (dt.date.fromisoformat(options[k]) for k in ("start", "end"))
        self.step = int(options.get("daysPerBatch", 1))

    def initialOffset(self) -> dict:
        return {"day": (self.start - dt.timedelta(days=1)).isoformat()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        last = dt.date.fromisoformat(start["day"])
        upto = {"day": max(last, min(last + dt.timedelta(days=self.step), self.end)).isoformat()}
        return self.readBetweenOffsets(start, upto), upto

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        first, last = dt.date.fromisoformat(start["day"]), dt.date.fromisoformat(end["day"])
        return iter([(first + dt.timedelta(days=k),) for k in range(1, (last - first).days + 1)])


def day_files(spark: SparkSession, landing: str, days: list[dt.date]) -> DataFrame:
    """(file_name, value): whole texts of the files in the folders ``day=yyyy-mm-dd`` of these days; a missing folder is an empty day."""
    frames = []
    for day in days:
        folder = read_path(lambda d=day: spark.read.text(f"{landing}/day={d.isoformat()}", wholetext=True))
        if folder is not None:
            frames.append(folder.select(F.lit(day.isoformat()).alias("file_name"), "value"))
    return union_all(frames) if frames else spark.createDataFrame([], "file_name string, value string")


def ingest_days(spark: SparkSession, landing: str, days: list[dt.date], store: str, ledger: str, batch: str, scorer: Scorer, recorded_at: str | None = None) -> None:
    """Append the articles of these days' files and record every day: files, articles read, articles new, files unreadable, error.

    The ledger comes last: a run that dies before it is repeated, and the same batch replaces what it wrote.
    """
    parsed = rd.parse_day_files(day_files(spark, landing, days)).persist()  # several actions read the files of a few days
    todo = rd.articles_of(parsed).withColumn("scraped_at", stamp_day(F.col("day")))
    todo = todo.withColumn("event_time", F.coalesce(F.col("published_at"), F.col("scraped_at")))
    todo = todo.withColumns({"event_date": F.to_date("event_time"), "article_id": F.xxhash64("url", "title", "ticker", "scraped_at")})
    append_events(todo, store, batch, scorer=scorer)
    written = read_path(lambda: read_store(spark, store).where(F.col("batch") == batch).select("day"))
    due = spark.createDataFrame([(d,) for d in days], "day date")
    at = F.current_timestamp() if recorded_at is None else F.lit(recorded_at).cast("timestamp")
    append_ledger(day_records(due, rd.file_status(parsed), written, at), ledger)
    parsed.unpersist()


def backfill(
    spark: SparkSession,
    landing: str,
    store: str,
    ledger: str,
    checkpoint: str,
    start: str,
    end: str,
    scorer: Scorer,
    days_per_batch: int = 1,
    recorded_at: str | None = None,
) -> StreamingQuery:
    """Start the backfill of ``start`` to ``end``; :func:`finish` waits until all its days are recorded."""
    spark.dataSource.register(DayCursor)
    days = spark.readStream.format("day_cursor").options(start=start, end=end, daysPerBatch=days_per_batch).load()

    def land(df: DataFrame, batch_id: int) -> None:
        due = [r.day for r in df.orderBy("day").collect()]  # at most ``days_per_batch`` rows
        if due:
            ingest_days(df.sparkSession, landing, due, store, ledger, f"day-{due[0].isoformat()}", scorer, recorded_at)

    return days.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).start()


def finish(query: StreamingQuery) -> None:
    """Process every day up to the end, then stop; raises what a day raised."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
