"""Sources, store and streams: repeats, late rows, broken files, batch = stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tapewire.operators.aggregates import daily_news
from tapewire.plans import model, refresh
from tapewire.sources import readers as rd
from tapewire.sources import store as st
from tapewire.streaming import ingest

T0 = dt.datetime(2024, 1, 1, 12)
NEWS_DDL = (
    "article_id long, title string, description string, url string, ticker string, event_time timestamp, scraped_at timestamp,"
    " sentiment_compound double, impact_level string, relevance_score double"
)


def article(i, title, hours=0, ticker="A", s=0.2):
    t = T0 + dt.timedelta(hours=hours)
    return (i, title, "d", f"https://x.com/{title}", ticker, t, t, s, "low", 0.5)


def frame(spark, rows):
    return spark.createDataFrame(rows, NEWS_DDL).withColumn("event_date", F.to_date("event_time"))


# ---- store ----------------------------------------------------------------------------------


def test_append_drops_repeats_inside_the_batch_and_against_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    first = frame(spark, [article(1, "a"), article(2, "a"), article(3, "b")])
    assert st.append_events(first, path, "one") == 2
    assert st.append_events(frame(spark, [article(4, "B"), article(5, "c")]), path, "two") == 1
    assert st.append_events(frame(spark, [article(4, "B")]), path, "three") == 0
    assert sorted(r.article_id for r in st.read_store(spark, path).collect()) == [1, 3, 5]


def test_repeating_a_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = frame(spark, [article(1, "a"), article(2, "b", 30)])
    assert [st.append_events(rows, path, "one") for _ in range(3)] == [2, 2, 2]
    assert st.read_store(spark, path).count() == 2


def test_empty_batches(spark, tmp_path):
    path = str(tmp_path / "store")
    empty = frame(spark, [])
    assert st.append_events(empty, path, "zero") == 0
    assert st.append_events(frame(spark, [article(1, "a")]), path, "one") == 1
    assert st.append_events(empty, path, "two") == 0


def test_upsert_batch_adds_unseen_titles(spark, tmp_path):
    path = str(tmp_path / "history")
    a = frame(spark, [article(1, "a"), article(2, "b")]).drop("event_date")
    b = frame(spark, [article(3, "b"), article(4, "c"), article(5, "c")]).drop("event_date")
    assert st.upsert_batch(a, path, "2024-01-01", "r1").first().added == 2
    got = st.upsert_batch(b, path, "2024-01-01", "r2").first()
    assert (got.added, got.total) == (1, 3)
    assert st.upsert_batch(b, path, "2024-01-02", "r3").first().total == 2


def test_retention_writes_a_new_version(spark, tmp_path):
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    for d, r in (("2024-01-01", "r1"), ("2024-01-20", "r2")):
        st.upsert_batch(frame(spark, [article(1, "a")]).drop("event_date"), old, d, r)
    assert st.retain(spark, old, new, 10, "2024-01-25").count() == 1
    assert st.read_store(spark, old).count() == 2


# ---- files -----------------------------------------------------------------------------------


def test_event_csv_multiline_quotes_and_malformed(spark, tmp_path):
    head = ",".join(rd.NEWS_EVENTS_CSV.names)
    n = len(rd.NEWS_EVENTS_CSV.names)
    good = ['"two\nlines, ""quoted"""', '"d"', '"s"', '"u"', '"A"', '"2024-01-01"', '"2024-01-01"', "0.5"] + ['"0.1"'] * 3 + ['"Positive"', '"low"', "0.2", "true", "false", "false"]
    assert len(good) == n
    bad = list(good)
    bad[7] = '"not a number"'
    (tmp_path / "events.csv").write_text(head + "\n" + ",".join(good) + "\n" + ",".join(bad) + "\n")
    rows = rd.read_events(spark, str(tmp_path / "events.csv")).collect()
    assert [(r.title, r.sentiment_compound, r.is_relevant) for r in rows] == [('two\nlines, "quoted"', 0.5, True)]


def test_raw_day_files_of_both_shapes_and_a_corrupt_one(spark, tmp_path):
    web = {"articles": [{"domain": "x.com", "seendate": "20240405T010203Z", "title": "t", "url": "u", "language": "English"}], "meta": {"error": "", "fetched": 1}}
    feed = [{"source": "Feed", "title": "f", "url": "v", "published_at": "Yesterday", "description": "d"}]
    (tmp_path / "20240405.raw.json").write_text(json.dumps(web))
    (tmp_path / "20240406.raw.json").write_text(json.dumps(feed))
    (tmp_path / "20240407.raw.json").write_text('{"articles": [')
    (tmp_path / "20240408.raw.json").write_text(json.dumps({"articles": [], "meta": {"error": "HTTP 429"}}))
    path = str(tmp_path / "*.json")
    got = {r.source: (r.title, str(r.published_at), str(r.day)) for r in rd.read_raw_days(spark, path).collect()}
    assert got == {"web:x.com": ("t", "2024-04-05 01:02:03", "2024-04-05"), "Feed": ("f", "2024-04-05 00:00:00", "2024-04-06")}
    status = {str(r.day): (r.rows, r.corrupt, r.error) for r in rd.day_status(spark, path).collect()}
    assert status["2024-04-07"][1] is True and status["2024-04-08"] == (0, False, "HTTP 429")
    assert sorted(str(r.day) for r in rd.list_days(spark, path).collect()) == [f"2024-04-0{i}" for i in (5, 6, 7, 8)]


def test_history_document(spark, tmp_path):
    doc = {"metadata": {"created_at": "x"}, "batches": {"2024-01-01": {"articles": [{"title": "a", "sentiment_compound": 0.1}, {"title": "b"}]}, "2024-01-02": {"articles": []}}}
    (tmp_path / "h.json").write_text(json.dumps(doc))
    rows = rd.read_history(spark, str(tmp_path / "h.json"))
    assert sorted((str(r.batch_date), r.title) for r in rows.collect()) == [("2024-01-01", "a"), ("2024-01-01", "b")]
    assert "impact_level" in rd.export_training(rows).columns


def test_wide_bars(spark):
    wide = spark.createDataFrame([("2024-01-01", "1.5", None, 9.0), ("2024-01-02", "bad", 2.5, None)], "Date string, `A|Close` string, `B|Close` double, `A|Volume` double")
    got = sorted((r.ticker, str(r.date), r.close, r.volume) for r in rd.bars_from_wide(wide).collect())
    assert got == [("A", "2024-01-01", 1.5, 9.0), ("B", "2024-01-02", 2.5, None)]


# ---- streams -----------------------------------------------------------------------------------


def land(spark, rows, path):
    spark.createDataFrame(rows, NEWS_DDL).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("stateful", [False, True])
def test_stream_restart_appends_nothing_and_equals_batch(spark, tmp_path, stateful):
    src, store, cp = (str(tmp_path / x) for x in ("src", "store", "cp"))
    land(spark, [article(1, "a"), article(2, "b"), article(3, "a", 1)], src)
    schema = spark.read.parquet(src).schema

    def run():
        stream = ingest.landed(spark, src, schema)
        ingest.run_to_end(ingest.incremental_news(stream, store, cp, stateful=stateful))
        return st.read_store(spark, store)

    assert run().count() == 2
    assert run().count() == 2  # same checkpoint, no new files
    land(spark, [article(4, "b", 2), article(5, "c", 3)], src)
    assert sorted(r.title for r in run().collect()) == ["a", "b", "c"]


def test_daily_bucket_counts_late_rows_inside_the_watermark_only(spark, tmp_path):
    src, out, side, marks = (str(tmp_path / x) for x in ("src", "out", "side", "marks"))
    day = 24
    steps = [
        [article(1, "a"), article(2, "b")],
        [article(3, "c", 10 * day)],
        [article(4, "late inside", 8 * day)],
        [article(5, "late beyond", 1), article(6, "d", 10 * day)],
    ]
    for rows in steps:
        land(spark, rows, src)
        stream = ingest.landed(spark, src, spark.read.parquet(src).schema)
        ingest.run_to_end(ingest.daily_bucket(stream, out, str(tmp_path / "cp1"), lateness="3 days"))
        ingest.run_to_end(ingest.late_rows(stream, side, marks, str(tmp_path / "cp2"), lateness="3 days"))
    got = {str(r.date): r.news_count for r in ingest.current_buckets(spark, out).collect()}
    assert got == {"2024-01-01": 2, "2024-01-09": 1, "2024-01-11": 2}
    late = spark.read.parquet(side)
    assert [r.article_id for r in late.collect()] == [5]
    events = spark.read.parquet(src).withColumn("date", F.to_date("event_time"))
    fixed = ingest.repair(ingest.current_buckets(spark, out), events, late)
    want = {(r.ticker, r.date): r.news_count for r in daily_news(events).collect()}
    assert {(r.ticker, r.date): r.news_count for r in fixed.collect()} == want


def test_days_close_behind_the_watermark_and_late_rows_are_set_aside(spark, tmp_path):
    src, out, side, cp = (str(tmp_path / x) for x in ("src", "out", "side", "cp"))
    day = 24
    steps = [
        [article(1, "a"), article(2, "b")],
        [article(3, "c", 10 * day)],
        [article(4, "late inside", 8 * day)],
        [article(5, "late beyond", 1), article(6, "d", 10 * day)],
        [article(7, "late again", 2)],
    ]
    for rows in steps:
        land(spark, rows, src)
        stream = ingest.landed(spark, src, spark.read.parquet(src).schema).withColumn("source", F.lit("wire"))
        ingest.run_to_end(ingest.closing_days(stream, out, side, cp, lateness="3 days"))
    days = ingest.day_sums(spark, out)
    assert {str(r.date): (r.state, r.n) for r in days.collect()} == {"2024-01-01": ("closed", 2), "2024-01-09": ("open", 1), "2024-01-11": ("open", 2)}
    late = spark.read.parquet(side)
    assert sorted(r.article_id for r in late.collect()) == [5, 7]
    events = spark.read.parquet(src).withColumn("date", F.to_date("event_time"))
    names = ["ticker", "date", "news_count", "sent_mean", "sent_std", "sent_min", "sent_max", "relevance_mean", "high_impact_count", "macro_count"]
    rounded = lambda df: {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(names).collect()}
    assert rounded(ingest.with_late(days, late)) == rounded(daily_news(events))
    recent = ingest.day_sums(spark, out, since="2024-01-09")
    assert recent.count() == 2 and "PartitionFilters: [isnotnull(date" in recent._jdf.queryExecution().toString()


def test_a_day_has_a_bounded_number_of_states_and_files(spark, tmp_path):
    src, out, side, cp = (str(tmp_path / x) for x in ("src", "out", "side", "cp"))
    names = [None, *[f"T{i}" for i in range(150)]]
    for step in range(2):  # tickers of the second file are old and new
        rows = [article(1000 * step + i, f"t{i}") for i in range(300)]
        tickers = spark.createDataFrame([(1000 * step + i, names[(i + 60 * step) % len(names)]) for i in range(300)], "article_id long, ticker string")
        frame(spark, rows).drop("ticker").join(tickers, "article_id").coalesce(1).write.mode("append").parquet(src)
    stream = ingest.landed(spark, src, spark.read.parquet(src).schema, per_trigger=1).withColumn("source", F.lit("wire"))
    query = ingest.closing_days(stream, out, side, cp, lateness="3 days")
    ingest.run_to_end(query)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 16
    assert len(list((tmp_path / "out").rglob("*.parquet"))) <= 2 * st.WRITERS
    events = spark.read.parquet(src).withColumn("date", F.to_date("event_time"))
    figures = ["ticker", "date", "news_count", "sent_mean", "sent_min", "sent_max", "relevance_mean"]
    rounded = lambda df: {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(figures).collect()}
    assert rounded(ingest.with_late(ingest.day_sums(spark, out), events.limit(0))) == rounded(daily_news(events))


# ---- drivers and models ----------------------------------------------------------------------------


def test_ingest_pending_skips_days_in_the_ledger(spark, tmp_path):
    store, ledger = str(tmp_path / "s"), str(tmp_path / "l")
    rows = [(i, f"t{i}", "d", f"u{i}", None, None, dt.date(2024, 1, 1 + i % 3)) for i in range(9)]
    days = spark.createDataFrame(rows, "article_id long, title string, description string, url string, ticker string, published_at timestamp, day date")
    same = lambda df: df
    assert refresh.ingest_pending(spark, days.where("day = '2024-01-01'"), store, ledger, same, "2024-02-01 00:00:00") == 3
    assert refresh.ingest_pending(spark, days, store, ledger, same, "2024-02-02 00:00:00") == 6
    assert refresh.ingest_pending(spark, days, store, ledger, same, "2024-02-03 00:00:00") == 0
    assert st.read_ledger(spark, ledger).count() == 3
    noon = {r.scraped_at.hour for r in st.read_store(spark, store).collect()}
    assert noon == {12}
    assert st.staleness(st.read_ledger(spark, ledger), "2024-02-02 00:30:00").first().refresh is False


def test_staleness_of_an_empty_ledger_asks_for_a_refresh(spark):
    assert st.staleness(st.ledger_rows(spark, []), "2024-01-01").first().refresh is True


def test_a_fit_deals_its_rows_evenly_however_they_come(spark):
    rows = [(float(i % 7), float(i % 11), i % 2 if i % 10 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, direction_fwd int").coalesce(1)
    ready = model._ready(df, ("a", "b", "absent"), "direction_fwd")
    sizes = ready.rdd.glom().map(len).collect()
    assert sum(sizes) == 1800 and len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) <= len(sizes)
    assert ready.where("absent <> 0").isEmpty()
    estimator = model.forest(model.Forest(5, 3, 1), "direction_fwd", 1)
    assert estimator.getCacheNodeIds()
    fitted, walked = (model._fit(ready, e, ("a", "b"), "direction_fwd") for e in (estimator, estimator.copy().setCacheNodeIds(False)))
    assert fitted.stages[-1].toDebugString.split("\n")[1:] == walked.stages[-1].toDebugString.split("\n")[1:]
    assert abs(sum(fitted.stages[-1].featureImportances.toArray()) - 1) < 1e-9


def test_more_rows_make_more_files_of_raw_lines(spark, tmp_path, monkeypatch):
    from catalog import flow_queries

    spark.range(100).selectExpr("id AS doc_id", "concat('a \"quoted\" title ', id, '. rest') AS text", "'en' AS lang", "'wire' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(flow_queries, "FILE_ROWS", 10)
    monkeypatch.setattr(flow_queries, "scratch", lambda spark: str(tmp_path / "out"))
    assert tuple(flow_queries.read_events_malformed(spark, str(tmp_path)).first()) == (100, 20)
    assert len(list((tmp_path / "out").iterdir())) > 9


def test_time_split_never_mixes_dates(spark):
    rows = [(f"T{i % 5}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 5)) for i in range(200)]
    panel = spark.createDataFrame(rows, "ticker string, date date")
    train, test = model.time_split(panel, 0.35)
    assert train.agg(F.max("date")).first()[0] < test.agg(F.min("date")).first()[0]
    assert test.select("date").distinct().count() == 14


def test_class_weights_balance(spark):
    df = model.class_weight(spark.createDataFrame([(1,), (0,), (0,), (0,)], "direction_fwd int"))
    sums = {r[0]: r[1] for r in df.groupBy("direction_fwd").agg(F.sum("weight")).collect()}
    assert sums[0] == pytest.approx(sums[1])


def test_category_index_is_alphabetical_with_unknown(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "sector string")
    got = {r.sector: r.code for r in model.category_index(df, "sector", "code").collect()}
    assert got == {None: 0.0, "a": 1.0, "b": 2.0}


def test_a_batch_without_times_is_stored_and_compared(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(1, "a", "u", "2024-01-01"), (2, "b", "u", None)]
    df = spark.createDataFrame(rows, "article_id long, title string, url string, at string").withColumns(
        {"event_time": F.to_timestamp("at"), "event_date": F.lit(dt.date(2024, 1, 1))}
    ).drop("at")
    for horizon in (None, "1 day"):
        out = f"{path}-{horizon}"
        same = dict(identity=["title", "url"], span="event_time", horizon=horizon)
        assert st.append_events(df.where("article_id = 1"), out, "one", **same) == 1
        assert st.append_events(df, out, "two", **same) == 1
        assert st.append_events(df.where("event_time is null"), out, "three", **same) == 0


def test_an_old_title_is_known_however_late_it_returns(spark, tmp_path):
    src, store, cp = (str(tmp_path / x) for x in ("src", "store", "cp"))
    land(spark, [article(1, "a")], src)
    schema = spark.read.parquet(src).schema
    for later in (0, 200):
        if later:
            land(spark, [article(2, "a", later), article(3, "new", later)], src)
        ingest.run_to_end(ingest.incremental_news(ingest.landed(spark, src, schema), store, cp))
    assert sorted(r.article_id for r in st.read_store(spark, store).collect()) == [1, 3]


def test_times_with_microseconds(spark):
    from tapewire.functions.text import parse_time

    texts = ["2024-01-02T03:04:05.123456", "2024-01-02T03:04:05.123456+00:00", "2024-01-02 03:04:05.5", "2024-01-02T03:04:05Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_time([F.col("t")]).alias("p"))
    assert [r.p.microsecond for r in df.collect()] == [123456, 123456, 500000, 0]


def test_a_day_has_few_files_and_compaction_fewer(spark, tmp_path):
    path, new = str(tmp_path / "store"), tmp_path / "new"
    for b in range(3):
        rows = [article(100 * b + i, f"t{b}-{i}", hours=12 * (i % 4)) for i in range(60)]
        st.append_events(frame(spark, rows).repartition(16), path, f"b{b}")
    days = {p.parent.parent for p in (tmp_path / "store").rglob("*.parquet")}
    assert all(len(list(d.rglob("*.parquet"))) <= 3 * st.WRITERS for d in days)
    out = st.compact(spark, path, str(new), "2024-01-02")
    assert sorted(r.article_id for r in out.collect()) == sorted(r.article_id for r in st.read_store(spark, path).collect())
    assert [p.name for p in (new / "event_date=2024-01-01").iterdir()] == ["batch=compact"]
    assert len(list((new / "event_date=2024-01-01").rglob("*.parquet"))) <= st.WRITERS
    assert len(list((new / "event_date=2024-01-02").iterdir())) == 3


def test_a_refresh_makes_bars_once_and_predicts_from_the_written_quotes(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(refresh, "run_refresh", lambda tables, path, real=refresh.run_refresh: made.append(tables) or real(tables, path))
    news = frame(spark, [article(1, "a"), article(2, "b", ticker="B")]).withColumn("date", F.to_date("event_time"))
    flags = lambda df: df.withColumns({"is_relevant": F.lit(True), "is_impactful": F.lit(False), "is_irrelevant": F.lit(False)})
    days = [(t, dt.date(2024, 1, d), 1.0, 2.0, 0.5, 1.0 + d, 10.0) for t in "AB" for d in range(1, 4)]
    bars_path = str(tmp_path / "bars")
    spark.createDataFrame(days, "ticker string, date date, open double, high double, low double, close double, volume double").write.parquet(bars_path)
    bars = spark.read.parquet(bars_path)
    out, steps = refresh.refresh_in_steps(news, bars, bars.select("ticker").distinct(), flags, "2024-01-04 00:00:00", str(tmp_path / "out"))
    assert {r.step: r.rows for r in steps.collect()} == {"news": 2, "quotes": 2, "predictions": 2, "panel": 6}
    tables = {name: df for step in made for name, df in step.items()}
    assert any("/out/quotes/" in f for f in tables["predictions"].inputFiles())
    assert not any("/bars/" in f for name in ("quotes", "panel") for f in tables[name].inputFiles())


def test_members_of_an_ensemble_score_one_vector(spark):
    rows = [(float(i % 7) if i % 3 else None, float(i % 11), int(i % 7 > 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, direction_fwd int")
    plan = model.Plan(model.Forest(3, 3, 1), model.Boost(2, 2, 0.1), model.Boost(2, 2, 0.1))
    fitted = model.train_ensemble(df, plan, ("a", "b", "absent"))
    single = df
    for name, member in fitted.members.items():
        single = model.probability_up(member, single, fitted.features, name)
    want = model.soft_vote(single, plan.votes, "p").select("a", "b", "p")
    got = fitted.score(df, "p")
    assert got.columns == [*df.columns, "absent", "p"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("UDF(struct(") == 1  # one assembly
    assert sorted(map(str, got.select("a", "b", "p").collect())) == sorted(map(str, want.collect()))
