"""Batch drivers: resumable ingest of pending days, quick update, full refresh, maintenance."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.functions.text import stamp_day
from tapewire.operators.aggregates import daily_news, ticker_sentiment
from tapewire.operators.dedupe import dedupe_exact
from tapewire.operators.joins import enrich_quotes, merge_model_scores, pending_days, ticker_signals
from tapewire.operators.matching import SYMBOL, keep_relevant
from tapewire.operators.ranking import last_quote
from tapewire.operators.scale import checkpointed, dealt, dim_join, fits, union_all
from tapewire.plans.panel import model_panel, series_panel
from tapewire.sources.paths import read_path
from tapewire.sources.store import append_events, append_ledger, day_records, exists, read_ledger, read_store

Scorer = Callable[[DataFrame], DataFrame]


def ingest_pending(
    spark: SparkSession, days: DataFrame, store: str, ledger: str, scorer: Scorer, recorded_at: str, status: DataFrame | None = None
) -> int:
    """Ingest the days in ``days`` (rows tagged with ``day``) the ledger does not list yet.

    All pending days are scored in one job.  ``status`` (day, calls, fetched, corrupt, error), as ``readers.file_status`` gives it, says
    how the days were fetched and may name days without rows; by default a day is one call that gave its rows.  The
    ledger is written last, so a run that dies is repeated; the store's key check makes the repetition harmless.
    """
    if status is None:
        none = F.lit(None).cast("string").alias("error")
        status = days.groupBy("day").agg(F.count("*").alias("fetched")).select("day", F.lit(1).alias("calls"), "fetched", F.lit(0).alias("corrupt"), none)
    due = status.select("day").distinct()
    if exists(spark, ledger):
        due = pending_days(due, read_ledger(spark, ledger))
    todo = dim_join(days, due, ["day"], "left_semi").withColumn("scraped_at", stamp_day(F.col("day")))
    todo = todo.withColumn("event_time", F.coalesce(F.col("published_at"), F.col("scraped_at")))
    todo = todo.withColumn("event_date", F.to_date("event_time"))
    batch = "day-" + recorded_at.replace(":", "").replace(" ", "T")
    added = append_events(todo, store, batch, scorer=scorer)
    written = read_path(lambda: read_store(spark, store).where(F.col("batch") == batch).select("day"))
    append_ledger(day_records(due, status, written, F.lit(recorded_at).cast("timestamp")), ledger)
    return added


def quick_update(
    news: DataFrame,
    quotes: DataFrame,
    universe: DataFrame,
    scorer: Scorer,
    as_of: str,
    since: str,
    dim: DataFrame | None = None,
    pattern: str = SYMBOL,
) -> DataFrame:
    """Predictions from all articles since a moment, for every ticker they serve, and the last known quotes."""
    scored = scorer(news.where(F.col("event_time") >= F.lit(since).cast("timestamp")))
    return ticker_signals(universe, ticker_sentiment(scored, as_of, universe=universe, pattern=pattern), quotes, dim)


def full_refresh(
    news: DataFrame,
    bars: DataFrame,
    universe: DataFrame,
    scorer: Scorer,
    as_of: str,
    model_scores: DataFrame | None = None,
    dim: DataFrame | None = None,
    pattern: str = SYMBOL,
) -> dict[str, DataFrame]:
    """The whole chain, lazily: scored news, quotes with company and sector, predictions and panel.

    An article counts in the predictions of every ticker it serves, in the panel for its own.

    Nothing runs until a result is written; ``step_counts`` then reads the counts
    off the written tables.
    """
    kept = keep_relevant(scorer(dedupe_exact(news)))
    return {"news": kept, **_from_scored(kept, _quotes(bars, dim), bars, universe, as_of, model_scores, dim, pattern)}


def _quotes(bars: DataFrame, dim: DataFrame | None) -> DataFrame:
    return last_quote(bars) if dim is None else enrich_quotes(last_quote(bars), dim)


def _from_scored(kept, quotes, bars, universe, as_of, model_scores, dim, pattern) -> dict[str, DataFrame]:
    preds = ticker_signals(universe, ticker_sentiment(kept, as_of, universe=universe, pattern=pattern), quotes, dim)
    if model_scores is not None:
        preds = merge_model_scores(preds, model_scores)
    return {"quotes": quotes, "predictions": preds, "panel": model_panel(kept, bars)}


def refresh_in_steps(
    news: DataFrame,
    bars: DataFrame,
    universe: DataFrame,
    scorer: Scorer,
    as_of: str,
    path: str,
    model_scores: DataFrame | None = None,
    dim: DataFrame | None = None,
    pattern: str = SYMBOL,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """``full_refresh`` written step by step: texts are scored once and bars made once, predictions start from the written news and quotes.

    Returns what ``run_refresh`` returns.
    """
    # dealt by ticker before they are stored, as every window and join on them needs them
    bars = checkpointed(bars.repartition("ticker"))
    first, began = run_refresh({"news": keep_relevant(scorer(dedupe_exact(news))), "quotes": _quotes(bars, dim)}, path)
    rest = _from_scored(first["news"], first["quotes"], bars, universe, as_of, model_scores, dim, pattern)
    rest, went_on = run_refresh({name: rest[name] for name in ("predictions", "panel")}, path)
    return {**first, **rest}, began.unionByName(went_on)


def run_refresh(tables: dict[str, DataFrame], path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Write every table of a refresh; the tables as read back, and rows (step, rows, seconds).

    The counts come from the footers of the written files: no column is read a second time.  (An ``Observation`` would
    count while writing, but a session that has used one can no longer send a freshly fitted logistic regression to its tasks.)
    """
    spark = next(iter(tables.values())).sparkSession
    steps, written = [], {}
    for name, df in tables.items():
        began = time.monotonic()
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        took = time.monotonic() - began
        written[name] = spark.read.parquet(f"{path}/{name}")
        steps.append((name, written[name].count(), took))
    return written, spark.createDataFrame(steps, "step string, rows long, seconds double")


def write_refresh(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Write every table of a refresh and return them as read back."""
    return run_refresh(tables, path)[0]


def step_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (step, rows) of written tables."""
    return union_all([df.agg(F.count("*").alias("rows")).withColumn("step", F.lit(name)) for name, df in tables.items()])


def stored_panel(news: DataFrame, bars: DataFrame) -> DataFrame:
    """``model_panel`` over bars and daily news that are made once."""
    bars, daily = checkpointed(bars), checkpointed(daily_news(news))
    if not bars.groupBy("ticker", "date").count().where("count > 1").isEmpty():
        return model_panel(news, bars)  # several bars a day: its joins pair them
    return series_panel(F.broadcast(daily) if fits(daily) else daily, dealt(bars, "ticker"))


def maintain(
    spark: SparkSession,
    days: DataFrame,
    bars: DataFrame,
    store: str,
    ledger: str,
    panel_path: str,
    scorer: Scorer,
    recorded_at: str,
    train: Callable[[DataFrame], object] | None = None,
) -> int:
    """Ingest pending days, rebuild the panel from the store, retrain on it."""
    added = ingest_pending(spark, days, store, ledger, scorer, recorded_at)
    news = spark.read.parquet(store).withColumn("date", F.col("event_date"))
    stored_panel(news.where(F.col("ticker").isNotNull()), bars).write.mode("overwrite").parquet(panel_path)
    if train is not None:
        train(spark.read.parquet(panel_path))
    return added
