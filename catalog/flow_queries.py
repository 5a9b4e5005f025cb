"""Sources, sinks, streams, batch drivers and models.

Files these queries need are written by Spark from the given tables into the shared
checkpoint folder, a new sub-folder per run.
"""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.bars_queries import BT_CTE, DAILY, LABELS_U, PANEL
from catalog.news_queries import AS_OF, MOMENTUM, PREDS, QUOTES_U, SCORE, SUMM, WITH_PREDS, five, preds
from catalog.registry import fix, fxs, query
from catalog.text_queries import FIN, FLAGGED, LABEL, S, SCORED_A, SOURCES, STOP, TERMS, lexicon, modifiers, pad_sql
from catalog.views import (
    ARTICLES, BARS, BARS_U, DIM, NAMED, NAMED_CODE, NEWS, QUOTES, articles, bars, bars_u, named_articles, news, quotes, ticker_dim,
)
from tapewire.functions.scores import label_sentiment
from tapewire.functions.text import day_from_name
from tapewire.operators import aggregates as ag
from tapewire.operators import matching as mt
from tapewire.operators import ranking
from tapewire.operators.joins import enrich_quotes
from tapewire.operators.scale import checkpointed, once
from tapewire.plans import backtest, model, refresh
from tapewire.plans.panel import model_panel
from tapewire.schema import NEWS_EVENTS, conform
from tapewire.session import shared_dir
from tapewire.sources import readers as rd
from tapewire.sources import store as st
from tapewire.sources.quoted_csv import malformed
from tapewire.streaming import backfill as bf
from tapewire.streaming import ingest


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def figs(cols, digits=6):
    return ", ".join(f"{fxs(c, digits)} AS {c}" for c in cols)


def stamped(spark, sf):
    """Articles with collection and event times; one second per article keeps keys apart."""
    a = articles(spark, sf)
    t = F.col("date").cast("timestamp") + F.make_dt_interval(hours=F.lit(12), secs=F.col("article_id").cast("decimal(18,6)"))
    return a.withColumns({"scraped_at": t, "event_time": t, "event_date": F.col("date")})


# ---- sources -----------------------------------------------------------------------------------------


@query("read_events_csv", f"WITH {ARTICLES} SELECT nullif(title, '') AS title, nullif(description, '') AS description, source, ticker, CAST(article_id AS VARCHAR) AS url FROM articles")
def read_events_csv(spark, sf):
    out = scratch(spark)
    a = conform(articles(spark, sf).withColumn("url", F.col("article_id").cast("string")), rd.NEWS_EVENTS_CSV)
    rows = a.select(*rd.NEWS_EVENTS_CSV.names)
    rows.write.options(
        header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(out)
    return rd.read_events(spark, out, ["title", "description", "source", "ticker", "url"])


FILE_ROWS = 20_000


@query("read_events_malformed", "SELECT count(*) AS records, count(*) FILTER (doc_id % 10 = 3 OR doc_id % 10 = 7) AS malformed FROM documents")
def read_events_malformed(spark, sf):
    """Every tenth row has a score that is no number, and another tenth one field too many."""
    out = scratch(spark)
    a = articles(spark, sf)
    n = max(3, -(-a.count() // FILE_ROWS))  # a file is written by one task
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    last = F.col("article_id") % 10
    fields = {"title": F.col("title"), "description": F.col("description"), "url": F.col("url"), "sentiment_compound": F.when(last == 3, "none").otherwise("0.5")}
    line = F.concat_ws(",", *[cell(fields.get(c, F.lit(""))) for c in rd.NEWS_EVENTS_CSV.names], F.when(last == 7, "more"))
    lines = a.select(F.lit(1).alias("k"), "article_id", line.alias("value"))
    header = spark.range(1).select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("article_id"), F.lit(",".join(rd.NEWS_EVENTS_CSV.names)).alias("value"))
    files = lines.withColumn("f", F.col("article_id") % n).unionByName(header.withColumn("f", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))))
    files.repartition(n, "f").sortWithinPartitions("f", "k", "article_id").select("f", "value").write.partitionBy("f").text(out)
    return malformed(spark, out, rd.NEWS_EVENTS_CSV)


@query("read_events_newest", f"WITH {NEWS} SELECT ticker, source, event_time FROM news_events")
def read_events_newest(spark, sf):
    out = rd.newest(news(spark, sf), ["ticker", "source", "event_time"])
    return out.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def day_files(spark, sf):
    """Whole-file texts of at most 50 articles each: list form, web form, and broken ones."""
    a = articles(spark, sf)
    block = F.floor(F.col("article_id") / 50)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (block % 28).cast("int")), "yyyyMMdd")
    web = F.struct(
        F.concat("source", F.lit(".example.com")).alias("domain"), F.col("lang").alias("language"),
        F.concat(day, F.lit("T101112Z")).alias("seendate"), "title", "url", F.col("description").alias("snippet"),
    )
    stamp = F.date_format("date", "yyyy-MM-dd")
    feed = F.struct(
        "source", "title", "url", "ticker", stamp.alias("published_at"), "description", F.col("title").alias("content"), stamp.alias("scraped_at"),
        F.concat(F.lit("by "), "lang").alias("author"), F.array("lang").alias("topics"), (F.col("article_id") % 2 == 0).alias("is_reputable"),
    )
    files = a.groupBy(block.alias("block"), day.alias("d")).agg(F.collect_list(web).alias("web"), F.collect_list(feed).alias("feed"))
    kind = F.col("block") % 3
    meta = F.struct(F.size("web").alias("fetched"))
    value = (
        F.when(kind == 0, F.to_json("feed"))
        .when(kind == 1, F.to_json(F.struct(F.col("web").alias("articles"), meta.alias("meta"))))
        .otherwise('[{"source": "cut')
    )
    return files.select(F.concat("d", F.lit("-"), F.col("block").cast("string"), F.lit(".raw.json")).alias("file_name"), value.alias("value"))


DAYF = f"""f AS (SELECT *, article_id // 50 AS block, DATE '2024-01-01' + CAST((article_id // 50) % 28 AS INTEGER) AS day FROM articles)"""


@query(
    "read_raw_days",
    f"""WITH {ARTICLES}, {DAYF} SELECT CASE WHEN block % 3 = 0 THEN source ELSE 'web:' || source || '.example.com' END AS source, title, description, url, day,
 CASE WHEN block % 3 = 0 THEN ticker END AS ticker, CASE WHEN block % 3 = 0 THEN 'by ' || lang END AS author, CASE WHEN block % 3 = 0 THEN title END AS content,
 CASE WHEN block % 3 = 0 THEN lang END AS topic, CASE WHEN block % 3 = 0 THEN CAST(date AS VARCHAR) END AS scraped_at, CASE WHEN block % 3 = 0 THEN article_id % 2 = 0 END AS is_reputable,
 CASE WHEN block % 3 = 0 THEN CAST(date AS TIMESTAMP) ELSE CAST(day AS TIMESTAMP) + INTERVAL 36672 SECOND END AS published_at FROM f WHERE block % 3 < 2""",
)
def read_raw_days(spark, sf):
    out = rd.read_raw_days(spark, landed_days(spark, sf))
    out = out.withColumn("topic", F.get("topics", F.lit(0))).drop("language", "topics")
    return out.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("day_status", f"WITH {ARTICLES}, {DAYF} SELECT day, CAST(sum(CASE WHEN block % 3 = 2 THEN 0 ELSE 1 END) AS BIGINT) AS rows, count(DISTINCT block) FILTER (block % 3 = 2) AS corrupt FROM f GROUP BY 1")
def day_status(spark, sf):
    out = rd.day_status(spark, landed_days(spark, sf))
    return out.groupBy("day").agg(F.sum("rows").alias("rows"), F.count_if("corrupt").alias("corrupt"))


@query("list_days", f"WITH {ARTICLES}, {DAYF} SELECT DISTINCT day FROM f")
def list_days(spark, sf):
    return rd.list_days(spark, landed_days(spark, sf))


@query("web_article_to_article", f"WITH {ARTICLES} SELECT 'web:' || source AS source, title, url, lang AS language FROM articles")
def web_article_to_article(spark, sf):
    raw = articles(spark, sf).select(
        F.col("source").alias("domain"), F.col("lang").alias("language"), F.date_format("date", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"),
        "title", "url", F.col("description").alias("snippet"), F.col("date").alias("day"),
    )
    return rd.web_to_article(raw).select("source", "title", "url", "language")


def history_texts(spark, sf):
    """History documents of at most 50 articles, one batch day each."""
    a = articles(spark, sf)
    block = F.floor(F.col("article_id") / 1500)
    art = F.struct("title", "description", "source", "ticker", F.col("article_id").cast("double").alias("relevance_score"))
    batch = F.struct(F.count("*").alias("article_count"), F.collect_list(art).alias("articles"))
    docs = a.groupBy("date", block.alias("block")).agg(batch.alias("b"))
    batches = F.create_map(F.date_format("date", "yyyy-MM-dd"), F.col("b"))
    return docs.select(F.to_json(F.struct(batches.alias("batches"))).alias("value"))


@query("read_history", f"WITH {ARTICLES} SELECT date AS batch_date, title, ticker, CAST(article_id AS DOUBLE) AS relevance_score FROM articles")
def read_history(spark, sf):
    return stored_history(spark, sf).select("batch_date", "title", "ticker", "relevance_score")


def stored_history(spark, sf):
    """The history documents, a file each, read back."""
    out = scratch(spark)
    history_texts(spark, sf).write.option("maxRecordsPerFile", 1).text(out)
    return rd.read_history(spark, out)


@query("export_training", f"WITH {ARTICLES} SELECT date AS batch_date, title, description, source, ticker FROM articles")
def export_training(spark, sf):
    flat = rd.export_training(stored_history(spark, sf))
    return flat.select("batch_date", "title", "description", "source", "ticker")


@query(
    "bars_from_wide",
    f"""WITH {BARS}, {DIM} SELECT sector AS ticker, date, {fxs('max(close)')} AS close, {fxs('sum(volume)')} AS volume FROM bars JOIN ticker_dim USING (ticker) GROUP BY 1, 2""",
)
def bars_from_wide(spark, sf):
    long = bars(spark, sf).join(ticker_dim(spark, sf).select("ticker", "sector"), "ticker")
    sectors = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = (
        long.groupBy(F.col("date").alias("Date"))
        .pivot("sector", sectors)
        .agg(F.max("close").cast("string").alias("Close"), F.sum("volume").alias("Volume"))
    )
    wide = wide.select("Date", *[F.col(f"`{s}_{f}`").alias(f"{s}|{f}") for s in sectors for f in ("Close", "Volume")])
    return fix(rd.bars_from_wide(wide).select("ticker", "date", "close", "volume"), "close", "volume")


@query("conform", f"WITH {ARTICLES} SELECT article_id, title, CAST(0 AS DOUBLE) AS sentiment_compound, CAST(NULL AS VARCHAR) AS impact_level FROM articles")
def conform_q(spark, sf):
    out = conform(articles(spark, sf), NEWS_EVENTS, {"sentiment_compound": 0.0})
    return out.select("article_id", "title", "sentiment_compound", "impact_level")


# ---- sinks -----------------------------------------------------------------------------------------------


@query(
    "append_events",
    f"""WITH {ARTICLES}, k AS (SELECT article_id, lang, date, lower(trim(title, ' ')) AS t FROM articles), g AS (
 SELECT date, t, min(article_id) AS a, min(article_id) FILTER (lang = 'en') AS e FROM k GROUP BY 1, 2) SELECT date AS event_date, coalesce(e, a) AS article_id FROM g""",
)
def append_events(spark, sf):
    out = scratch(spark)
    noon = F.col("date").cast("timestamp") + F.expr("INTERVAL 12 HOUR")
    a = stamped(spark, sf).withColumns({"scraped_at": noon, "url": F.lit("https://example.com/x"), "ticker": F.lit(None).cast("string")})
    st.append_events(a.where("lang = 'en'"), out, "one")
    st.append_events(a, out, "two")
    return st.read_store(spark, out).select("event_date", "article_id")


@query(
    "compact",
    f"""WITH {ARTICLES} SELECT date AS event_date, CASE WHEN date < DATE '2024-01-15' THEN 'compact' WHEN lang = 'en' THEN 'one' ELSE 'two' END AS batch, count(*) AS n FROM articles GROUP BY 1, 2""",
)
def compact(spark, sf):
    old, new = scratch(spark), scratch(spark)
    a = stamped(spark, sf).withColumns({"scraped_at": F.col("date").cast("timestamp"), "ticker": F.lit(None).cast("string")})
    a = a.withColumns({"url": F.concat(F.lit("https://example.com/"), F.col("article_id")), "title": F.concat("title", F.col("article_id"))})
    st.append_events(a.where("lang = 'en'"), old, "one")
    st.append_events(a.where("lang <> 'en'"), old, "two")
    return st.compact(spark, old, new, "2024-01-15").groupBy("event_date", "batch").agg(F.count("*").alias("n"))


@query(
    "upsert_batch",
    f"WITH {ARTICLES} SELECT DATE '2024-03-01' AS batch_date, count(DISTINCT title) - count(DISTINCT title) FILTER (lang = 'en') AS added, count(DISTINCT title) AS total FROM articles",
)
def upsert_batch(spark, sf):
    out = scratch(spark)
    a = articles(spark, sf)
    st.upsert_batch(a.where("lang = 'en'"), out, "2024-03-01", "r1")
    return st.upsert_batch(a, out, "2024-03-01", "r2")


@query("retain", f"WITH {NEWS} SELECT article_id, date AS batch_date FROM news_events WHERE date >= DATE '2024-01-21'")
def retain(spark, sf):
    old, new = scratch(spark), scratch(spark)
    rows = news(spark, sf).select("article_id", F.col("date").alias("batch_date"), F.lit("r1").alias("run"))
    rows.write.partitionBy("batch_date", "run").parquet(old)
    return st.retain(spark, old, new, 10, "2024-01-31").select("article_id", "batch_date")


@query("write_snapshot", f"WITH {BARS}, {QUOTES} SELECT ticker, {figs(('price', 'change_percent'))} FROM quotes WHERE price > 2000")
def write_snapshot(spark, sf):
    return fix(snapshot(spark, sf)["quotes"].select("ticker", "price", "change_percent"), "price", "change_percent")


def snapshot(spark, sf):
    """News, predictions and quotes with company and sector, written and read back."""
    out = scratch(spark)
    q = quotes(spark, sf).withColumn("price", F.when(F.col("price") > 2000, F.col("price")).otherwise(0.0))
    st.write_snapshot(news(spark, sf), preds(spark, sf), enrich_quotes(q, ticker_dim(spark, sf)), out)
    return st.read_snapshot(spark, out)


@query(
    "write_snapshot_companies",
    f"""WITH {BARS}, {QUOTES}, {DIM} SELECT q.ticker, coalesce(d.company_name, q.ticker) AS company_name, coalesce(d.sector, 'Unknown') AS sector
FROM quotes q LEFT JOIN ticker_dim d ON q.ticker = d.ticker WHERE price > 2000""",
)
def write_snapshot_companies(spark, sf):
    return snapshot(spark, sf)["quotes"].select("ticker", "company_name", "sector")


@query(
    "write_snapshot_predictions",
    WITH_PREDS + f""" SELECT ticker, company_name, sector, news_count, {fxs('avg_sentiment', 4)} AS news_sentiment_score, {fxs(MOMENTUM, 4)} AS momentum_normalized,
 {fxs('prediction_score')} AS prediction_score, recommendation FROM preds""",
)
def write_snapshot_predictions(spark, sf):
    p = snapshot(spark, sf)["predictions"].drop("avg_sentiment", "confidence")
    return fix(fix(p, "prediction_score"), "news_sentiment_score", "momentum_normalized", digits=4)


@query("write_snapshot_news", f"WITH {NEWS} SELECT ticker, source, event_time, impact_level, count(*) AS n, {fxs(f'sum({S})', 4)} AS total FROM news_events GROUP BY ALL")
def write_snapshot_news(spark, sf):
    n = snapshot(spark, sf)["news"].groupBy("ticker", "source", "event_time", "impact_level")
    return fix(n.agg(F.count("*").alias("n"), F.sum(S).alias("total")), "total", digits=4)


@query(
    "write_patterns",
    f"WITH {NEWS} SELECT 'source' AS pattern, source AS key, CAST(count(*) AS DOUBLE) AS n, {fxs(f'avg({S})')} AS avg_sentiment FROM news_events GROUP BY source",
)
def write_patterns(spark, sf):
    out = scratch(spark)
    st.write_patterns(ag.pattern_report(news(spark, sf)), out)
    docs = st.patterns_as_json(spark.read.parquet(out).where("pattern = 'source'"))
    m = F.from_json("document", "map<string,double>")
    return fix(docs.select("pattern", "key", m["n"].alias("n"), m["avg_sentiment"].alias("avg_sentiment")), "avg_sentiment")


def ledger(spark, sf):
    """Two records per news day, the later one corrected."""
    out = scratch(spark)
    days = news(spark, sf).groupBy(F.col("date").alias("day")).agg(F.count("*").alias("n"))
    for hours, extra in ((1, 100), (2, 0)):
        at = F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))
        rows = days.select(
            "day", F.lit(1).alias("calls"), (F.col("n") + extra).alias("fetched"), F.col("n").alias("appended"),
            F.lit(0).alias("corrupt"), F.lit(None).cast("string").alias("error"), at.alias("recorded_at"),
        )
        st.append_ledger(rows, out)
    return st.read_ledger(spark, out)


@query("ingest_ledger", f"WITH {NEWS} SELECT date AS day, count(*) AS fetched FROM news_events GROUP BY 1")
def ingest_ledger(spark, sf):
    return ledger(spark, sf).select("day", "fetched")


@query(
    "staleness",
    f"WITH {NEWS} SELECT {fxs('(epoch(TIMESTAMP ' + repr(AS_OF) + ') - epoch(CAST(max(date) AS TIMESTAMP) + INTERVAL 2 HOUR)) / 60.0')} AS age_minutes, TRUE AS refresh FROM news_events",
)
def staleness(spark, sf):
    return fix(st.staleness(ledger(spark, sf), AS_OF, 60), "age_minutes")


def light_scorer(spark):
    """Lexicon sentiment, label, impact, relevance flags: the whole text chain."""

    def score(df):
        out = once(mt.score_sentiment(df, lexicon(spark), modifiers(spark)), _padded=mt.padded(mt.full_text()))
        return out.withColumns({"sentiment_label": label_sentiment(F.col(S)), "impact_level": mt.keyword_class(F.col("_padded"), TERMS)}).drop("_padded")

    return score


@query("rescore", f"WITH {ARTICLES}, {SCORED_A} SELECT article_id, {LABEL.format(c=S)} AS sentiment_label, {fxs(S)} AS {S} FROM scored_a")
def rescore(spark, sf):
    old, new = scratch(spark), scratch(spark)
    st.append_events(stamped(spark, sf).withColumn("sentiment_label", F.lit("old")), old, "b1")
    return fix(st.rescore(spark, old, new, light_scorer(spark)).select("article_id", "sentiment_label", S), S)


# ---- streams ------------------------------------------------------------------------------------------------


@query("incremental_news", f"WITH {ARTICLES} SELECT DISTINCT title, lang FROM articles")
def incremental_news(spark, sf):
    src, store, cp = scratch(spark), scratch(spark), scratch(spark)
    feed = stamped(spark, sf).withColumn("url", F.concat(F.lit("https://example.com/"), "lang"))
    feed.repartition(4, "article_id").write.parquet(src)
    stream = ingest.landed(spark, src, feed.schema, per_trigger=2)
    ingest.run_to_end(ingest.incremental_news(stream, store, cp, light_scorer(spark)))
    return st.read_store(spark, store).select("title", "lang")


@query("daily_bucket_stream", f"WITH {NEWS}, {DAILY} SELECT ticker, date, news_count, high_impact_count, macro_count, {figs(('sent_mean', 'sent_std', 'sent_min', 'sent_max', 'relevance_mean'))} FROM daily")
def daily_bucket_stream(spark, sf):
    src, out, cp = scratch(spark), scratch(spark), scratch(spark)
    rows = news(spark, sf)
    rows.repartition(6, "article_id").write.parquet(src)
    stream = ingest.landed(spark, src, rows.schema, per_trigger=3)
    ingest.run_to_end(ingest.daily_bucket(stream, out, cp, lateness="40 days"))
    return fix(ingest.current_buckets(spark, out), "sent_mean", "sent_std", "sent_min", "sent_max", "relevance_mean")


def out_of_order(spark, sf):
    """News landed day by day, but for some rows that arrive after all others; closed with a lateness of two days."""
    src, out, side, cp = scratch(spark), scratch(spark), scratch(spark), scratch(spark)
    rows = news(spark, sf)
    late = (F.hour("event_time") >= 20) & (F.col("source") == "error")
    arrival = F.when(late, 9).otherwise(F.floor((F.dayofmonth("date") - 1) / 5))
    for k in (0, 1, 2, 3, 4, 5, 9):
        rows.where(arrival == k).repartition(2, "article_id").write.mode("append").parquet(src)
    stream = ingest.landed(spark, src, rows.schema, per_trigger=2)
    ingest.run_to_end(ingest.closing_days(stream, out, side, cp, lateness="2 days"))
    return out, side


LATE = f"""WITH {NEWS}, x AS (SELECT *, hour(event_time) >= 20 AND source = 'error' AS is_late FROM news_events),
 mark AS (SELECT date_trunc('milliseconds', max(event_time)) - INTERVAL 2 DAY AS t FROM x WHERE NOT is_late)"""


@query("late_side_table", LATE + " SELECT date, count(*) AS n, sum(article_id) AS ids FROM x, mark WHERE is_late AND CAST(date AS TIMESTAMP) + INTERVAL 1 DAY <= t GROUP BY 1")
def late_side_table(spark, sf):
    _, side = out_of_order(spark, sf)
    return spark.read.parquet(side).groupBy("date").agg(F.count("*").alias("n"), F.sum("article_id").cast("decimal(38,0)").alias("ids"))


@query("closing_days", f"WITH {NEWS}, {DAILY} SELECT ticker, date, news_count, high_impact_count, macro_count, {figs(('sent_mean', 'sent_std', 'sent_min', 'sent_max', 'relevance_mean'))} FROM daily")
def closing_days(spark, sf):
    out, side = out_of_order(spark, sf)
    whole = ingest.with_late(ingest.day_sums(spark, out), spark.read.parquet(side))
    return fix(whole, "sent_mean", "sent_std", "sent_min", "sent_max", "relevance_mean")


@query("repair_days", f"WITH {NEWS}, {DAILY} SELECT ticker, date, news_count, {fxs('sent_mean')} AS sent_mean FROM daily")
def repair_days(spark, sf):
    n = news(spark, sf)
    late = n.where((F.hour("event_time") >= 20) & (F.col("source") == "error"))
    on_time = n.join(late.select("article_id"), "article_id", "left_anti")
    fixed = ingest.repair(ag.daily_news(on_time), n, late)
    return fix(fixed.select("ticker", "date", "news_count", "sent_mean"), "sent_mean")


# ---- batch drivers --------------------------------------------------------------------------------------------


def collected(spark, sf):
    a = articles(spark, sf).withColumn("url", F.concat(F.lit("https://example.com/"), F.col("article_id")))
    return a.withColumns({"day": F.col("date"), "published_at": F.lit(None).cast("timestamp")}).drop("date")


@query("ingest_pending", f"WITH {ARTICLES} SELECT date AS event_date, count(*) AS n FROM articles GROUP BY 1")
def ingest_pending(spark, sf):
    store, led = scratch(spark), scratch(spark)
    days = collected(spark, sf)
    scorer = light_scorer(spark)
    refresh.ingest_pending(spark, days.where("day <= '2024-01-12'"), store, led, scorer, "2024-02-01 00:00:00")
    # the second run sees all days and ingests only the new ones; the third none
    refresh.ingest_pending(spark, days, store, led, scorer, "2024-02-02 00:00:00")
    refresh.ingest_pending(spark, days, store, led, scorer, "2024-02-03 00:00:00")
    return st.read_store(spark, store).groupBy("event_date").agg(F.count("*").alias("n"))


def landed_days(spark, sf):
    """The raw day files in a folder a day, one file each; the broken ones and the last days of the month, which have none, included."""
    out = scratch(spark)
    files = day_files(spark, sf).withColumn("day", day_from_name(F.col("file_name")))
    files.repartition(4, "day").select("day", "value").write.option("maxRecordsPerFile", 1).partitionBy("day").text(out)
    return out


BACKFILL = f"""WITH {ARTICLES}, {DAYF}, u AS (SELECT day, block, lower(trim(title, ' ')) AS t, lower(trim(url, ' ')) AS u, coalesce(CASE WHEN block % 3 = 0 THEN ticker END, '') AS k FROM f WHERE block % 3 < 2),
 cal AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day)"""


@query(
    "backfill",
    BACKFILL + """ SELECT cal.day, CAST(coalesce(calls, 0) AS INTEGER) AS calls, coalesce(fetched, 0) AS fetched, coalesce(appended, 0) AS appended, CAST(coalesce(corrupt, 0) AS INTEGER) AS corrupt,
 CASE WHEN corrupt > 0 THEN 'unreadable file' END AS error, row_number() OVER (ORDER BY cal.day) AS place
FROM cal LEFT JOIN (SELECT day, count(DISTINCT block) AS calls, count(*) FILTER (block % 3 < 2) AS fetched, count(DISTINCT block) FILTER (block % 3 = 2) AS corrupt FROM f GROUP BY day) a ON cal.day = a.day
 LEFT JOIN (SELECT day, count(DISTINCT (t, u, k)) AS appended FROM u GROUP BY day) b ON cal.day = b.day""",
)
def backfill_q(spark, sf):
    """A run that dies on the twelfth day, then one that goes on behind it; ``place`` counts the days in the order they were recorded."""
    landing, store, led, cp = landed_days(spark, sf), scratch(spark), scratch(spark), scratch(spark)
    args = (spark, landing, store, led, cp, "2024-01-01", "2024-01-31")

    def dies(df):
        if df.where("day = '2024-01-12'").limit(1).count():
            raise RuntimeError("killed")
        return df

    try:
        bf.finish(bf.backfill(*args, dies, days_per_batch=4))
    except StreamingQueryException:
        pass
    bf.finish(bf.backfill(*args, lambda df: df, days_per_batch=4))
    place = F.row_number().over(Window.orderBy("recorded_at", "day"))  # 31 rows
    every = spark.read.parquet(led).withColumn("place", place.cast("long"))
    return every.select("day", "calls", "fetched", "appended", "corrupt", "error", "place")


QUICK = f"""WITH {NEWS.replace('news_events AS', 'all_news AS')}, news_events AS (SELECT * FROM all_news WHERE event_time >= TIMESTAMP '2024-01-20 06:00:00'), {BARS_U}, {QUOTES_U}, {SUMM}"""


@query(
    "quick_update",
    QUICK + f""", j AS (SELECT q.ticker, q.price, q.change_percent AS chg, coalesce(s.n, 0) AS news_count, coalesce(s.m, 0) AS avg_sentiment, coalesce(s.rec, 'HOLD') AS rec FROM quotes_u q LEFT JOIN summ s ON q.ticker = s.ticker WHERE q.price > 0)
SELECT ticker, news_count, {fxs('avg_sentiment')} AS avg_sentiment, {fxs('greatest(-1, least(1, 0.6 * avg_sentiment + 0.3 * greatest(-1, least(1, chg / 10)) + 0.1 * least(1, news_count / 20.0)))')} AS prediction_score, rec AS sentiment_recommendation FROM j""",
)
def quick_update(spark, sf):
    q = ranking.last_quote(bars_u(spark, sf))
    out = refresh.quick_update(news(spark, sf), q, q.select("ticker"), lambda df: df, AS_OF, "2024-01-20 06:00:00")
    return fix(out.select("ticker", "news_count", "avg_sentiment", "prediction_score", "sentiment_recommendation"), "avg_sentiment", "prediction_score")


def flagged_events(df):
    return df.withColumns(
        {
            "is_relevant": F.col("relevance_score") >= 0.25,
            "is_impactful": F.col("impact_level").isin("high", "macro"),
            "is_irrelevant": F.col("source") == "view",
        }
    )


def refreshed(spark, sf):
    n = news(spark, sf).withColumns({"title": F.concat("source", F.col("article_id").cast("string")), "url": F.lit("x")})
    q = bars_u(spark, sf).select("ticker").distinct()
    return refresh.full_refresh(n, bars_u(spark, sf), q, flagged_events, AS_OF)


@query(
    "full_refresh_predictions",
    f"""WITH {NEWS.replace('news_events AS', 'all_news AS')}, news_events AS (SELECT * FROM all_news WHERE source <> 'view'), {BARS_U}, {QUOTES_U}, {SUMM}, {PREDS}
SELECT ticker, news_count, {fxs('prediction_score')} AS prediction_score, recommendation FROM preds""",
)
def full_refresh_predictions(spark, sf):
    out = refreshed(spark, sf)["predictions"].where("news_count > 0")
    return fix(out.select("ticker", "news_count", "prediction_score", "recommendation"), "prediction_score")


@query(
    "full_refresh_panel",
    f"""WITH {NEWS.replace('news_events AS', 'all_news AS')}, news_events AS (SELECT * FROM all_news WHERE source <> 'view'), {BARS_U}, {DAILY}, {LABELS_U}, {PANEL}
SELECT ticker, date, {figs(('news_count', 'sent_mean', 'return_fwd'))} FROM panel""",
)
def full_refresh_panel(spark, sf):
    p = refreshed(spark, sf)["panel"].where("return_fwd is not null")
    return fix(p.select("ticker", "date", "news_count", "sent_mean", "return_fwd"), "news_count", "sent_mean", "return_fwd")


@query(
    "full_refresh_counts",
    f"WITH {NEWS}, {BARS_U}, q AS (SELECT count(DISTINCT ticker) AS n FROM bars_u) SELECT 'news' AS step, count(*) FILTER (source <> 'view') AS rows FROM news_events UNION ALL SELECT 'quotes', n FROM q UNION ALL SELECT 'predictions', n FROM q UNION ALL SELECT 'panel', count(*) FROM bars_u",
)
def full_refresh_counts(spark, sf):
    return refresh.run_refresh(refreshed(spark, sf), scratch(spark))[1].select("step", "rows")


# ---- articles that serve several tickers: whole texts, scored, attributed and joined to company and sector ----


def named_scored(spark, sf):
    return mt.score_sentiment(named_articles(spark, sf), lexicon(spark), modifiers(spark))


def text_chain(spark):
    """Sentiment, impact, relevance and flags from the whole text."""
    return lambda df: mt.relevance_flags(mt.score_sentiment(df, lexicon(spark), modifiers(spark)), TERMS, FIN, STOP, SOURCES)


def served_sql(rows, where="true"):
    """Summary ``summ`` over the rows of a CTE, one for each ticker that an article serves."""
    return f"""{DIM}, news_events AS (SELECT a.article_id, u.ticker, a.title, a.date, a.event_time, a.{S} FROM {rows} a
 JOIN ticker_dim u ON a.ticker = u.ticker OR contains({pad_sql('a.title')}, ' ' || lower(u.ticker) || ' ') WHERE {where}), {SUMM}"""


SIGNALS_S = f"""base AS (
 SELECT d.ticker, d.sector, d.company_name, q.price, q.change_percent AS chg, coalesce(s.n, 0) AS news_count, coalesce(s.m, 0) AS avg_sentiment,
  coalesce(s.rec, 'HOLD') AS srec, coalesce(s.conf, 0) AS confidence FROM ticker_dim d JOIN quotes q ON d.ticker = q.ticker LEFT JOIN summ s ON d.ticker = s.ticker WHERE q.price > 0),
 preds AS (SELECT *, {SCORE} AS prediction_score, {five(SCORE, 0.5, 0.2, -0.2, -0.5)} AS recommendation FROM base)
SELECT ticker, company_name, sector, news_count, {fxs('avg_sentiment', 4)} AS news_sentiment_score, {fxs(MOMENTUM, 4)} AS momentum_normalized,
 {fxs('prediction_score')} AS prediction_score, recommendation, srec AS sentiment_recommendation, {fxs('confidence')} AS confidence FROM preds"""
SIGNAL_COLUMNS = (
    "ticker", "company_name", "sector", "news_count", "news_sentiment_score", "momentum_normalized", "prediction_score", "recommendation",
    "sentiment_recommendation", "confidence",
)


def signals(df):
    out = fix(df.select(*SIGNAL_COLUMNS), "prediction_score", "confidence")
    return fix(out, "news_sentiment_score", "momentum_normalized", digits=4)


@query("per_mention", f"WITH {NAMED}, {DIM} SELECT article_id, u.ticker, a.title FROM articles a JOIN ticker_dim u ON a.ticker = u.ticker OR contains({pad_sql('a.title')}, ' ' || lower(u.ticker) || ' ')")
def per_mention(spark, sf):
    out = mt.per_mention(named_articles(spark, sf), ticker_dim(spark, sf), NAMED_CODE)
    return out.select("article_id", "ticker", "title")


@query(
    "ticker_sentiment_mentions",
    f"""WITH {NAMED}, {SCORED_A}, {served_sql('scored_a')} SELECT ticker, n AS article_count, {fxs('m')} AS avg_sentiment, p AS positive_count, q AS negative_count,
 n - p - q AS neutral_count, rec AS recommendation, {fxs('conf')} AS confidence FROM summ""",
)
def ticker_sentiment_mentions(spark, sf):
    out = ag.ticker_sentiment(named_scored(spark, sf), AS_OF, universe=ticker_dim(spark, sf), pattern=NAMED_CODE)
    return fix(out, "avg_sentiment", "confidence")


@query(
    "recent_articles_mentions",
    f"""WITH {NAMED}, {SCORED_A}, {served_sql('scored_a')} SELECT ticker, article_id, CAST(rn AS INTEGER) AS rn FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_time DESC, article_id) AS rn FROM news_events) x WHERE rn <= 5""",
)
def recent_articles_mentions(spark, sf):
    out = ag.recent_articles(named_articles(spark, sf), universe=ticker_dim(spark, sf), pattern=NAMED_CODE)
    return out.select("ticker", "article_id", "rn")


@query(
    "daily_sentiment_trend_mentions",
    f"WITH {NAMED}, {SCORED_A}, {served_sql('scored_a')} SELECT date, {fxs(f'avg({S})')} AS avg_sentiment FROM news_events WHERE ticker = 'S3' GROUP BY 1",
)
def daily_sentiment_trend_mentions(spark, sf):
    return fix(ag.daily_sentiment_trend(named_scored(spark, sf), "S3", NAMED_CODE), "avg_sentiment")


SINCE_TEXT = "2024-01-08 12:00:00"


@query("quick_update_text", f"WITH {NAMED}, {SCORED_A}, {BARS}, {QUOTES}, " + served_sql("scored_a", f"a.event_time >= TIMESTAMP '{SINCE_TEXT}'") + f", {SIGNALS_S}")
def quick_update_text(spark, sf):
    u = ticker_dim(spark, sf)
    out = refresh.quick_update(named_articles(spark, sf), quotes(spark, sf), u, text_chain(spark), AS_OF, SINCE_TEXT, u, NAMED_CODE)
    return signals(out)


KEPT_TEXT = f"""{SCORED_A}, {FLAGGED}, firsts AS (SELECT article_id FROM (
 SELECT article_id, row_number() OVER (PARTITION BY coalesce(source || '/' || lang, ''), lower(trim(title, ' ')) ORDER BY article_id) AS rn FROM articles) x WHERE rn = 1),
 kept AS (SELECT s.* FROM scored_a s JOIN firsts USING (article_id) JOIN fl ON s.article_id = fl.article_id
  WHERE (is_relevant OR is_impactful OR fl.ticker IS NOT NULL OR CAST(relevance_score AS DOUBLE) >= 0.25) AND NOT is_irrelevant)"""


def refreshed_text(spark, sf):
    u = ticker_dim(spark, sf)
    return refresh.refresh_in_steps(
        named_articles(spark, sf), bars(spark, sf), u, text_chain(spark), AS_OF, scratch(spark), dim=u, pattern=NAMED_CODE
    )


@query("full_refresh_text_predictions", f"WITH {NAMED}, {KEPT_TEXT}, {BARS}, {QUOTES}, {served_sql('kept')}, {SIGNALS_S}")
def full_refresh_text_predictions(spark, sf):
    return signals(refreshed_text(spark, sf)[0]["predictions"])


@query(
    "full_refresh_text_counts",
    f"""WITH {NAMED}, {KEPT_TEXT}, {BARS}, {QUOTES} SELECT 'news' AS step, count(*) AS rows, true AS timed FROM kept UNION ALL SELECT 'quotes', count(*), true FROM quotes
UNION ALL SELECT 'predictions', count(*) FILTER (price > 0), true FROM quotes UNION ALL SELECT 'panel', count(*), true FROM bars""",
)
def full_refresh_text_counts(spark, sf):
    return refreshed_text(spark, sf)[1].select("step", "rows", (F.col("seconds") > 0).alias("timed"))


# ---- models -----------------------------------------------------------------------------------------------------

# What a fit gives has no SQL form: the queries return what must hold for any fit, next to the rows it was made on and measured on.
# SMALL has 100 trees and 2 x 10 rounds; maintain and random_search take the operators' defaults, which are the full sizes.
SMALL = model.Plan(model.Forest(100, 10, 10), model.Boost(10, 5, 0.1), model.Boost(10, 6, 0.1, 0.7))


def panel(spark, sf):
    """The model panel, written once so that every fit reads files instead of recomputing it."""
    out = scratch(spark)
    model_panel(news(spark, sf), bars_u(spark, sf)).write.parquet(out)
    return spark.read.parquet(out)


P_SQL = f"WITH {NEWS}, {BARS_U}, {DAILY}, {LABELS_U}, {PANEL}"


LAST_SHARE = " SELECT ticker, date, CASE WHEN date >= (SELECT min(d) FROM (SELECT date AS d, row_number() OVER (ORDER BY date DESC) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel) y) x WHERE i <= ceil(n * {share})) THEN 'test' ELSE 'train' END AS side FROM panel"


@query("time_split", P_SQL + LAST_SHARE.format(share=0.2))
def time_split(spark, sf):
    rows = _labelled(spark, sf)
    a, b = model.time_split(rows)
    return a.withColumn("side", F.lit("train")).unionByName(b.withColumn("side", F.lit("test"))).select("ticker", "date", "side")


def _labelled(spark, sf):
    from tapewire.plans.panel import daily_panel

    return daily_panel(news(spark, sf), bars_u(spark, sf), with_technicals=False)


@query("time_split_short", P_SQL + LAST_SHARE.format(share=0.5))
def time_split_short(spark, sf):
    a, b = model.time_split(_labelled(spark, sf), 0.5)
    return a.withColumn("side", F.lit("train")).unionByName(b.withColumn("side", F.lit("test"))).select("ticker", "date", "side")


@query("validation_slice", P_SQL + " SELECT ticker, date FROM panel WHERE date >= (SELECT min(d) FROM (SELECT DISTINCT date AS d FROM panel ORDER BY d DESC LIMIT 7) x)")
def validation_slice(spark, sf):
    return model.validation_slice(_labelled(spark, sf), 7)[1].select("ticker", "date")


@query("training_rows", P_SQL + " SELECT ticker, date FROM panel WHERE direction_fwd IN (0, 1) AND news_count > 0")
def training_rows(spark, sf):
    return model.training_rows(_labelled(spark, sf), news_only=True).select("ticker", "date")


@query("class_weight", P_SQL + f" SELECT ticker, date, {fxs('count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY direction_fwd))')} AS weight FROM panel")
def class_weight(spark, sf):
    return fix(model.class_weight(_labelled(spark, sf)).select("ticker", "date", "weight"), "weight")


@query("category_index", f"WITH {DIM} SELECT ticker, CAST(dense_rank() OVER (ORDER BY coalesce(sector, 'Unknown')) - 1 AS DOUBLE) AS sector_encoded FROM (SELECT ticker, CASE WHEN ticker LIKE '%9' THEN NULL ELSE sector END AS sector FROM ticker_dim) d")
def category_index(spark, sf):
    d = ticker_dim(spark, sf).select("ticker", F.when(~F.col("ticker").endswith("9"), F.col("sector")).alias("sector"))
    return model.category_index(d, "sector", "sector_encoded").select("ticker", "sector_encoded")


@query("soft_vote", f"WITH {NEWS} SELECT article_id, {fxs(f'(1.2 * ({S} + 1) / 2 + 1.0 * relevance_score + 0.8 * 0.5) / 3.0')} AS probability FROM news_events")
def soft_vote(spark, sf):
    n = news(spark, sf).select("article_id", ((F.col(S) + 1) / 2).alias("a"), F.col("relevance_score").alias("b"), F.lit(0.5).alias("c"))
    return fix(model.soft_vote(n, {"a": 1.2, "b": 1.0, "c": 0.8}).select("article_id", "probability"), "probability")


DEALT = P_SQL + ", dealt AS (SELECT *, row_number() OVER (ORDER BY direction_fwd NULLS FIRST, md5(ticker || '|' || CAST(date AS VARCHAR) || '|42'), ticker, date) AS rn FROM panel)"


@query("hash_folds", DEALT + " SELECT ticker, date, direction_fwd, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM dealt")
def hash_folds(spark, sf):
    return model.stratified_fold(_labelled(spark, sf), ["ticker", "date"], 5).select("ticker", "date", "direction_fwd", "fold")


@query(
    "stratified_holdout",
    DEALT + " SELECT ticker, date, CASE WHEN rn * 8000 // 10000 > (rn - 1) * 8000 // 10000 THEN 'train' ELSE 'test' END AS side, direction_fwd FROM dealt",
)
def stratified_holdout(spark, sf):
    a, b = model.holdout(_labelled(spark, sf), ["ticker", "date"])
    both = a.withColumn("side", F.lit("train")).unionByName(b.withColumn("side", F.lit("test")))
    return both.select("ticker", "date", "side", "direction_fwd")


LABELLED_ROWS = ", tr AS (SELECT * FROM panel WHERE direction_fwd IN (0, 1){more})"
NEWEST = (
    ", td AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM tr) z),"
    " te AS (SELECT * FROM tr WHERE date >= (SELECT min(date) FROM td WHERE i <= ceil(n * 0.2)))"
)
WITH_NEWS = LABELLED_ROWS.format(more=" AND news_count > 0")


def measured(metrics, *more):
    """Rows and rises a fit was measured on, and whether its figures belong to its counts."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    sound = (F.abs(F.col("accuracy") - (F.col("tp") + F.col("tn")) / n) < 1e-9) & (F.abs(F.col("f1") - f1) < 1e-9) & F.col("auc").between(0, 1)
    return metrics.select(*more, n.alias("rows"), (F.col("tp") + F.col("fn")).alias("rises"), sound.alias("sound"))


MEASURED = "count(*) AS rows, count(*) FILTER (direction_fwd = 1) AS rises, true AS sound"


@query(
    "maintain",
    f"WITH {ARTICLES}, {BARS}, a AS (SELECT count(*) AS n FROM articles), tr AS (SELECT ticker, date, CAST(ahead / close > 1 AS INTEGER) AS direction_fwd"
    " FROM (SELECT *, lead(close) OVER (PARTITION BY ticker ORDER BY date) AS ahead FROM bars) b WHERE ahead IS NOT NULL)"
    + NEWEST + f" SELECT (SELECT count(*) FROM bars) AS panel_rows, (SELECT n FROM a) AS stored, 3 AS members, {MEASURED} FROM te",
)
def maintain(spark, sf):
    """Ingest, panel, and a model fitted on it: the stored model is loaded, its meta row says what it was measured on."""
    store, led, panel_path, fitted = (scratch(spark) for _ in range(4))
    score = light_scorer(spark)
    plan = model.Plan()
    refresh.maintain(
        spark, collected(spark, sf), bars(spark, sf), store, led, panel_path, lambda df: score(df).withColumn("relevance_score", F.lit(0.0)),
        "2024-02-01 00:00:00", train=lambda rows: model.train(rows, fitted, AS_OF, plan),
    )
    stored = st.read_store(spark, store).agg(F.count("*")).scalar()
    rows = spark.read.parquet(panel_path).agg(F.count("*")).scalar()
    members = len(model.Ensemble.load(fitted, plan.votes).members)
    meta = measured(spark.read.parquet(f"{fitted}/meta"), F.lit(members).alias("members"))
    return meta.withColumns({"panel_rows": rows, "stored": stored})


@query(
    "train_and_predict_latest",
    f"""WITH {BARS_U}, l AS (SELECT ticker, date FROM bars_u WHERE date = (SELECT max(date) FROM bars_u)),
 n AS (SELECT count(*) AS n, CAST(greatest(1, round_even(count(*) * 0.05, 0)) AS BIGINT) AS s, CAST(greatest(1, round_even(count(*) * 0.10, 0)) AS BIGINT) AS k FROM l)
SELECT ticker, date, true AS sound, s AS strong_buys, k - s AS buys, k - s AS sells, s AS strong_sells FROM l, n""",
)
def train_and_predict_latest(spark, sf):
    p = panel(spark, sf)
    ensemble, _ = model.train(p, scratch(spark), AS_OF, SMALL)
    out = scratch(spark)
    model.predict_latest(ensemble, p).write.parquet(out)
    rows = spark.read.parquet(out)
    up = F.col("ml_probability_up")
    sound = up.between(0, 1) & (F.abs(F.col("ml_confidence") - F.abs(up - 0.5) * 2) < 1e-9) & (F.abs(F.col("ml_score") - (up - 0.5) * 2) < 1e-9)
    held = lambda label: rows.agg(F.count_if(F.col("ml_recommendation") == label)).scalar()
    labels = {"strong_buys": "STRONG BUY", "buys": "BUY", "sells": "SELL", "strong_sells": "STRONG SELL"}
    return rows.select("ticker", "date", sound.alias("sound"), *[held(v).alias(k) for k, v in labels.items()])


@query("train_meta", P_SQL + LABELLED_ROWS.format(more="") + NEWEST + f" SELECT 'ensemble' AS model, {len(model.FEATURES)} AS features, {MEASURED} FROM te")
def train_meta(spark, sf):
    meta = model.train(panel(spark, sf), scratch(spark), AS_OF, SMALL)[1]
    return measured(meta, "model", F.size(F.split("features", ",")).alias("features"))


@query("model_roundtrip", f"WITH {BARS_U} SELECT ticker, date, true AS same FROM bars_u")
def model_roundtrip(spark, sf):
    """Scores of the fitted and of the stored and loaded members, row by row."""
    p, out = panel(spark, sf), scratch(spark)
    fitted, _ = model.train(p, out, AS_OF, SMALL)
    loaded = model.Ensemble.load(out, SMALL.votes)
    both = loaded.score(fitted.score(p, "fitted"), "loaded", deal=False)
    return both.select("ticker", "date", (F.col("fitted") == F.col("loaded")).alias("same"))


def _split(spark, sf):
    return model.time_split(model.training_rows(panel(spark, sf), news_only=True))


BASELINES = ["logistic", "forest", "boosted", "linear_svc", "kernel_svc"]


@query(
    "baseline_comparison",
    P_SQL + WITH_NEWS + NEWEST + f" SELECT unnest({BASELINES}) AS model, 1 AS best_models, * FROM (SELECT {MEASURED} FROM te) m",
)
def baseline_comparison(spark, sf):
    train, test = _split(spark, sf)
    table = checkpointed(model.compare(train, test, model.baselines(100, 10, 50))[0])
    return measured(table, "model", table.agg(F.count_if("is_best").cast("int")).scalar().alias("best_models"))


@query("top_vote", P_SQL + WITH_NEWS + NEWEST + f" SELECT 3 AS members, {MEASURED} FROM te")
def top_vote(spark, sf):
    train, test = _split(spark, sf)
    ensemble = model.top_vote(*model.compare(train, test, model.baselines(20, 5, 20)))
    return measured(model.evaluate(ensemble, test), F.lit(len(ensemble.members)).alias("members"))


TRIALS = 30


@query(
    "random_search",
    P_SQL + WITH_NEWS + f""", tune AS (SELECT count(*) AS tuned_on FROM tr WHERE date >= (SELECT min(d) FROM (SELECT DISTINCT date AS d FROM tr ORDER BY d DESC LIMIT 7) x))
SELECT CAST(t AS INTEGER) AS trial, tuned_on, true AS in_range FROM tune, range({TRIALS}) r(t)""",
)
def random_search(spark, sf):
    fit_part, tune = model.validation_slice(model.training_rows(panel(spark, sf), news_only=True), 7)
    base = model.Boost()
    found = model.random_search(fit_part, tune, TRIALS, base=base)
    in_range = F.col("depth").between(3, 7) & F.col("rounds").between(base.rounds // 2, base.rounds) & F.col("subsample").between(0.6, 1) & F.col("rate").between(0.005, 0.2)
    return found.select("trial", "tuned_on", (in_range & F.col("auc").between(0, 1)).alias("in_range"))


@query("feature_importance", P_SQL + f" SELECT unnest({list(model.FEATURES)}) AS feature, true AS in_range, true AS whole")
def feature_importance(spark, sf):
    train, _ = _split(spark, sf)
    table = model.feature_importance(spark, model.fit(train, model.forest(model.Forest(), "direction_fwd", 42)))
    total = table.agg(F.sum("importance")).scalar()
    return table.select("feature", F.col("importance").between(0, 1).alias("in_range"), (F.abs(total - 1) < 1e-9).alias("whole"))


@query(
    "cross_validate",
    P_SQL + WITH_NEWS + """, cv AS (SELECT CAST((row_number() OVER (ORDER BY direction_fwd NULLS FIRST, md5(ticker || '|' || CAST(date AS VARCHAR) || '|42'), ticker, date) - 1) % 5 AS INTEGER) AS fold FROM tr)
SELECT fold, count(*) AS n, true AS in_range FROM cv GROUP BY 1""",
)
def cross_validate(spark, sf):
    rows = model.training_rows(panel(spark, sf), news_only=True)
    found = model.cross_validate(rows, model.forest(model.Forest(50, 5, 5), "direction_fwd", 42))
    return found.select("fold", "n", F.col("accuracy").between(0, 1).alias("in_range"))


@query(
    "walk_forward_backtest",
    f"""WITH {BARS}, {BT_CTE}, c AS (SELECT floor(quantile_cont(d - DATE '1970-01-01', 0.7)) AS cut FROM (SELECT DISTINCT date AS d FROM bt) x)
SELECT {MEASURED} FROM bt, c WHERE date - DATE '1970-01-01' > cut""",
)
def walk_forward_backtest(spark, sf):
    return measured(backtest.run(bars(spark, sf)).metrics)


@query("walk_forward_split", f"WITH {BARS}, d AS (SELECT DISTINCT date FROM bars), c AS (SELECT floor(quantile_cont(date - DATE '1970-01-01', 0.7)) AS cut FROM d) SELECT ticker, count(*) FILTER (date - DATE '1970-01-01' <= cut) AS train_rows, count(*) FILTER (date - DATE '1970-01-01' > cut) AS test_rows FROM bars, c GROUP BY 1")
def walk_forward_split(spark, sf):
    a, b = backtest.split_by_date(bars(spark, sf).select("ticker", "date"))
    both = a.withColumn("test", F.lit(False)).unionByName(b.withColumn("test", F.lit(True)))
    return both.groupBy("ticker").agg(F.count_if(~F.col("test")).alias("train_rows"), F.count_if("test").alias("test_rows"))

