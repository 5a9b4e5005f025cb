"""Cleaning, matching, labels, scores, rules, quality on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewire.functions import numeric, scores, text
from tapewire.operators import aggregates as ag
from tapewire.operators import joins, matching, metrics, quality, rules
from tapewire.schema import NEWS_EVENTS, conform


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "raw,want",
    [
        ("2024-01-05T10:11:12Z", "2024-01-05 10:11:12"),
        ("2024-01-05T10:11:12+02:00", "2024-01-05 08:11:12"),
        ("Fri, 05 Jan 2024 10:11:12 GMT", "2024-01-05 10:11:12"),
        ("Fri, 5 Jan 2024 10:11:12 -0500", "2024-01-05 15:11:12"),
        ("20240105T101112Z", "2024-01-05 10:11:12"),
        ("2024-01-05", "2024-01-05 00:00:00"),
        ("Jan-05-24", "2024-01-05 00:00:00"),
        ("Jan-05-24 09:30PM", "2024-01-05 21:30:00"),
        ("Today 09:30AM", "2024-02-10 09:30:00"),
        ("yesterday", "2024-02-09 00:00:00"),
        ("soon", None),
        ("", None),
    ],
)
def test_parse_time(spark, raw, want):
    base = F.lit("2024-02-10 15:00:00").cast("timestamp")
    got = one(spark, text.parse_time([F.col("t")], base).cast("string"), t=raw)
    assert got == want


def test_event_time_falls_back_before_the_floor(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    got = [
        one(spark, text.event_time(t(p), t("2024-01-02 00:00:00")).cast("string"), a=1)
        for p in ("1999-12-31 00:00:00", None, "2024-01-01 00:00:00")
    ]
    assert got == ["2024-01-02 00:00:00", "2024-01-02 00:00:00", "2024-01-01 00:00:00"]


def test_symbols(spark):
    assert one(spark, text.market_symbol(F.col("c")), c=" brk.b ") == "BRK-B"
    assert [one(spark, text.valid_symbol(F.col("c")), c=c) for c in ("A.B", "TOO-LONG-SYM", "a b", "")] == [True, False, False, False]
    uni = spark.createDataFrame([("BRK-B",), ("IT",), ("A",), ("AAPL",)], "ticker string")
    art = spark.createDataFrame([(1, "Ⅰ WITHIN ($AAPL) brk.b, aapl", "it is A")], "article_id long, title string, description string")
    found = matching.extract_tickers(art, uni, matching.full_text()).orderBy("position").collect()
    assert [r.ticker for r in found] == ["AAPL", "BRK-B", "IT", "A"]
    assert matching.assign_ticker(art, uni).first().ticker == "BRK-B"


def test_whole_tokens_not_substrings(spark):
    t = matching.padded(F.col("t"))
    assert one(spark, matching.any_term(t, ["FED"]), t="the Fed, again")
    assert not one(spark, matching.any_term(t, ["fed"]), t="federal")
    assert one(spark, matching.any_term(t, ["fed"], substring=True), t="federal")
    assert one(spark, matching.any_term(t, ["interest rate"]), t="An INTEREST -- rate")


@pytest.mark.parametrize(
    "s,label", [(0.5, "Very Positive"), (0.05, "Positive"), (0.0499, "Neutral"), (-0.05, "Negative"), (-0.5, "Very Negative"), (-1.0, "Very Negative")]
)
def test_label_edges(spark, s, label):
    assert one(spark, scores.label_sentiment(F.col("s")), s=s) == label


def test_bins_include_the_ends(spark):
    b = numeric.interval(F.col("s"), ag.SENTIMENT_EDGES, ag.SENTIMENT_BINS)
    assert one(spark, b, s=-1.0) == "very_negative"
    v = numeric.interval(F.col("s"), ag.VOLUME_EDGES, ag.VOLUME_BINS, open_end=True)
    assert one(spark, v, s=500) == "very_high"
    assert one(spark, b, s=-1.5) is None


def test_amplified_score_clamps_and_follows_sign(spark):
    f = lambda s, c, n: one(spark, scores.prediction_score_amplified(F.col("s"), F.col("c"), F.col("n")), s=s, c=c, n=n)
    assert f(1.0, 50.0, 60) == 1.0
    assert f(0.0, 0.0, 60) == 0.0
    assert f(-0.2, 0.0, 5) == pytest.approx(-0.17)


def test_conflict_downgrades_to_hold(spark):
    c = lambda rec, s, n: one(spark, scores.strong_conflict(F.col("r"), F.col("s"), F.col("n")), r=rec, s=s, n=n)
    assert c("BUY", -0.31, 1) and c("STRONG SELL", 0.31, 2)
    assert not c("BUY", -0.3, 1) and not c("BUY", -0.9, 0) and not c("HOLD", -0.9, 3)


def news(spark, rows):
    return spark.createDataFrame(
        rows, "article_id long, ticker string, event_time timestamp, sentiment_compound double, impact_level string, relevance_score double"
    )


def test_sentiment_is_invariant_to_shifting_as_of_with_the_data(spark):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "A", t, 0.9, "low", 0.1), (2, "A", t - dt.timedelta(hours=30), -0.4, "low", 0.1), (3, "A", None, 0.0, "low", 0.1)]
    later = [(i, k, w + dt.timedelta(days=9) if w else None, s, m, r) for i, k, w, s, m, r in rows]
    a = ag.ticker_sentiment(news(spark, rows), "2024-01-01 13:00:00").first()
    b = ag.ticker_sentiment(news(spark, later), "2024-01-10 13:00:00").first()
    assert a.avg_sentiment == pytest.approx(b.avg_sentiment)
    assert (a.positive_count, a.negative_count, a.neutral_count) == (1, 1, 1)


def test_signals_skip_unpriced_and_keep_newsless(spark):
    u = spark.createDataFrame([("BRK.B",), ("C",), ("D",)], "ticker string")
    s = ag.ticker_sentiment(news(spark, [(1, "C", None, 0.6, "low", 0.2)]), "2024-01-01")
    q = spark.createDataFrame([("BRK-B", 5.0, 2.0), ("C", 0.0, 1.0)], "ticker string, price double, change_percent double")
    got = joins.ticker_signals(u, s, q).collect()
    assert [(r.ticker, r.news_count, r.sentiment_recommendation, r.confidence) for r in got] == [("BRK.B", 0, "HOLD", 0.0)]


def test_sector_first_equals_ticker_first(spark):
    rows = [(1, "tech", "positive", "a", 0.5, 1), (1, "tech", "positive", "b", 0.7, 2), (1, "bank", "positive", "c", 0.7, 0), (1, "bank", "negative", "d", 0.4, 3), (2, "tech", "neutral", "e", 0.9, 1)]
    hits = spark.createDataFrame(rows, "article_id long, sector string, direction string, reason string, confidence double, rule_id int")
    places = spark.createDataFrame([("tech", f"T{i}") for i in range(6)] + [("bank", f"B{i}") for i in range(6)] + [("bank", "T1")], "sector string, ticker string")
    slow = rules.best_impact(rules.sector_fanout(hits, places).drop("sector"))
    columns = slow.columns
    assert sorted(rules.best_by_ticker(hits, places).select(columns).collect()) == sorted(slow.collect())
    want = {}
    for r in sorted(slow.where("direction <> 'neutral'").collect(), key=lambda r: (-r.confidence, r.ticker)):
        want.setdefault((r.article_id, r.direction), []).append(r.ticker)
    got = {}
    for r in sorted(rules.impact_summary(hits, places, 4).collect(), key=lambda r: r["rank"]):
        got.setdefault((r.article_id, r.direction), []).append(r.ticker)
    assert got == {k: v[:4] for k, v in want.items()}


def test_rules_and_best_impact_tie(spark):
    art = spark.createDataFrame([(1, "Oil jumps", "sanctions hit")], "article_id long, title string, description string")
    rs = [rules.Rule("oil", "energy", "positive", "first"), rules.Rule("OIL", "energy", "positive", "second")]
    hits = rules.match_rules(art, rs)
    assert hits.count() == 2
    rows = hits.select("article_id", F.lit("X").alias("ticker"), F.lit("positive").alias("direction"), "reason", F.lit(0.5).alias("confidence"), "rule_id")
    assert rules.best_impact(rows).first().reason == "first"
    many = rs * 150  # more rules than one pass takes
    assert rules.match_rules(art, many).count() == 300
    both = [rules.CompoundRule((("oil",), ("sanctions", "war")), "energy", "positive", "supply")]
    assert rules.compound_rules(art, both).count() == 1
    assert rules.compound_rules(art, [rules.CompoundRule((("oil",), ("gold",)), "x", "y", "z")]).count() == 0


def test_metrics_with_one_class_and_ties(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5)], "label int, predicted int, p double")
    m = metrics.binary_metrics(df, score="p").first()
    assert (m.auc, m.precision, m.recall) == (0.5, 1.0, 0.5)
    none = metrics.binary_metrics(df.where("label = 0")).first()
    assert (none.accuracy, none.precision, none.f1) == (0.0, 0.0, 0.0)
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, p double")
    assert metrics.auc(tied, "label", "p").first().auc == pytest.approx(0.875)


def test_thresholds_are_quantiles_at_every_size(spark):
    df = spark.range(5).select(F.col("id").cast("double").alias("v"))
    got = {r.name: (r.value, r.n_rows) for r in metrics.thresholds(df, "v", metrics.CONFIDENCE_CUTS).collect()}
    assert got == {"high": (3.0, 5), "medium": (2.0, 5), "low": (1.0, 5)}
    none = {r.name: (r.value, r.n_rows) for r in metrics.thresholds(df.limit(0), "v", metrics.CONFIDENCE_CUTS).collect()}
    assert none == {"high": (0.7, 0), "medium": (0.5, 0), "low": (0.3, 0)}
    got = {r.name: r.value for r in metrics.thresholds(spark.range(101).selectExpr("double(id) v"), "v", metrics.CONFIDENCE_CUTS).collect()}
    assert got == {"high": 75.0, "medium": 50.0, "low": 25.0}


def test_trading_averages_per_day_before_compounding(spark):
    d = [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    rows = [(d[0], 0.1, 1, 0.9), (d[0], 0.3, 1, 0.9), (d[1], -0.5, 0, 0.05), (d[1], 9.0, 1, 0.6)]
    t = metrics.trades(spark.createDataFrame(rows, "date date, return_fwd double, predicted int, probability double"))
    s = metrics.trading_summary(t).first()
    assert (round(s.final_strategy, 6), round(s.final_market, 6), s.trades, s.win_rate) == (1.8, 0.6, 3, 1.0)


def test_quality_of_an_empty_and_a_broken_table(spark):
    empty = spark.createDataFrame([], "ticker string, price double, change_percent double")
    report = {(r.rule): r.n for r in quality.quote_checks(empty).collect()}
    assert report["empty table"] == 1
    bad = spark.createDataFrame([("A", 0.0), ("B", None)], "ticker string, price double")
    report = {(r.rule): r.n for r in quality.quote_checks(bad).collect()}
    assert (report["missing column change_percent"], report["suspicious price"], report["missing price"]) == (1, 1, 1)
    zero = spark.createDataFrame([("t", "s", "", 0.0, "Neutral")] * 11, "title string, source string, ticker string, sentiment_compound double, sentiment_label string")
    report = {(r.rule): r.n for r in quality.news_checks(zero).collect()}
    assert (report["all sentiment zero"], report["mostly blank ticker"], report["duplicate title"]) == (11, 11, 11)


def test_conform_adds_and_keeps(spark):
    df = conform(spark.createDataFrame([("t", 1)], "title string, extra int"), NEWS_EVENTS, {"impact_level": "low"})
    assert set(NEWS_EVENTS.names) | {"extra"} == set(df.columns)
    assert df.first().impact_level == "low"


def test_enrich_does_not_replace_known_with_unknown(spark):
    q = spark.createDataFrame([("A", "Tech"), ("BRK-B", "Unknown")], "ticker string, sector string")
    d = spark.createDataFrame([("A", "Unknown", "i", "n"), ("BRK.B", "Finance", None, "Berk")], "ticker string, sector string, industry string, company_name string")
    got = {r.ticker: (r.sector, r.industry, r.company_name) for r in joins.enrich_quotes(q, d).collect()}
    assert got == {"A": ("Tech", "i", "n"), "BRK-B": ("Finance", "Unknown", "Berk")}


def test_resolve_company(spark):
    terms = spark.createDataFrame([("apple inc",), ("Apple",), ("the apple inc group",), ("zz",)], "term string")
    al = spark.createDataFrame([("Apple Inc", "AAPL"), ("Appleton", "APN")], "name string, ticker string")
    got = {r.term: r.ticker for r in matching.resolve_company(terms, al).collect()}
    assert got == {"apple inc": "AAPL", "Apple": "AAPL", "the apple inc group": "AAPL", "zz": "ZZ"}


def test_large_universe_matches_like_a_small_one(spark, monkeypatch):
    uni = spark.createDataFrame([("BRK-B",), ("IT",), ("AAPL",), ("OIL",)], "ticker string")
    art = spark.createDataFrame(
        [(1, "AAPL", "AAPL and BRK.B", "it is oil, aapl"), (2, None, "nothing", None), (3, "ZZ", "Oil oil", "")],
        "article_id long, ticker string, title string, description string",
    )

    def run():
        found = matching.extract_tickers(art, uni, matching.full_text())
        return (
            sorted((r.article_id, r.position, r.ticker) for r in found.collect()),
            sorted((r.article_id, r.ticker) for r in matching.assign_ticker(art, uni).collect()),
            sorted((r.article_id, r.ticker) for r in matching.mentions(art, uni).collect()),
            sorted((r.article_id, r.ticker) for r in matching.mentions(art, uni, substring=5).collect()),
        )

    small = run()
    monkeypatch.setattr(matching, "LISTED_TICKERS", 0)
    assert run() == small
    assert small[0] == [(1, 0, "AAPL"), (1, 1, "BRK-B"), (1, 2, "IT"), (1, 3, "OIL"), (3, 0, "OIL")]


def test_costly_text_is_evaluated_once(spark):
    art = spark.createDataFrame([(1, "A", "s", "the title", "some text")], "article_id long, ticker string, source string, title string, description string")
    flags = matching.keep_relevant(matching.relevance_flags(art, {"high": ["title"]}, ["some"], ["zz"], ["s"]))
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    hits = rules.match_rules(art, [rules.Rule("the", "x", "up", "r"), rules.Rule("text", "x", "up", "r")])
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 2


def test_a_row_delivered_twice_scores_as_once(spark):
    lexicon = spark.createDataFrame([("good", 1.5), ("bad", -2.0)], "token string, weight double")
    modifiers = spark.createDataFrame([("not", -0.5)], "prev string, factor double")
    rows = [(1, "good news, not bad, good", None), (1, "good news, not bad, good", None), (1, "bad", None), (None, "good", None), (2, "plain", None)]
    df = spark.createDataFrame(rows, "article_id long, title string, description string").repartition(3)
    got = sorted((r.article_id or 0, r.title, round(r.sentiment_compound, 4)) for r in matching.score_sentiment(df, lexicon, modifiers).collect())
    c = lambda s: round(s / (s * s + 15) ** 0.5, 4)
    assert got == [(0, "good", c(1.5)), (1, "bad", c(-2.0)), (1, "good news, not bad, good", c(4.0)), (1, "good news, not bad, good", c(4.0)), (2, "plain", 0.0)]


@pytest.mark.parametrize("listed", [2000, 0])
def test_tickers_of_rows_that_share_an_id(spark, monkeypatch, listed):
    monkeypatch.setattr(matching, "LISTED_TICKERS", listed)
    universe = spark.createDataFrame([("AAA",), ("BBB",)], "ticker string")
    df = spark.createDataFrame([(1, "AAA up"), (1, "BBB up, AAA"), (1, "AAA up"), (None, "BBB"), (2, "CCC")], "article_id long, title string")
    got = sorted((r.article_id or 0, r.title, r.position, r.ticker) for r in matching.extract_tickers(df, universe, F.col("title")).collect())
    assert got == [(0, "BBB", 0, "BBB"), (1, "AAA up", 0, "AAA"), (1, "AAA up", 0, "AAA"), (1, "BBB up, AAA", 0, "BBB"), (1, "BBB up, AAA", 1, "AAA")]


def test_a_model_that_is_not_there_leaves_all_to_the_lexicon(spark, tmp_path):
    lexicon = spark.createDataFrame([("good", 1.5)], "token string, weight double")
    modifiers = spark.createDataFrame([], "prev string, factor double")
    loads = str(tmp_path / "loads")

    def absent():
        raise OSError("no such model")

    def present():
        with open(loads, "a") as out:
            out.write("x")
        return lambda texts: [(0.5, 0.25, 0.25) for _ in texts]

    rows = [(i % 50, f"good news {i % 50}", None) for i in range(60)] + [(None, "plain", None)]
    df = spark.createDataFrame(rows, "article_id long, title string, description string").coalesce(1)
    out = matching.score_with_fallback(df, absent, lexicon, modifiers).collect()
    assert len(out) == 61 and {r.scored_by for r in out} == {"lexicon"}
    assert {round(r.sentiment_compound, 4) for r in out} == {0.0, round(1.5 / (1.5**2 + 15) ** 0.5, 4)}
    out = matching.score_with_fallback(df, present, lexicon, modifiers, batch=7).collect()
    assert len(out) == 61 and {(r.scored_by, r.sentiment_compound) for r in out} == {("model", 0.25)}
    assert len(open(loads).read()) == 1  # one worker, nine batches


def test_a_word_in_every_name(spark):
    aliases = spark.createDataFrame([(f"Company {i:03d} Inc", f"T{i:03d}") for i in range(300)] + [("Company 005 Inc", "AAA")], "name string, ticker string")
    terms = spark.createDataFrame([("inc",), ("company 007 inc",), ("005",), ("the company 009 inc shop",), ("none",)], "term string")
    got = {r.term: r.ticker for r in matching.resolve_company(terms, aliases).collect()}
    assert got == {"inc": "T000", "company 007 inc": "T007", "005": "AAA", "the company 009 inc shop": "T009", "none": "NONE"}


def test_an_article_serves_every_ticker_of_its_title(spark, monkeypatch):
    rows = [(1, "A", "A and B rise", 0.5), (1, None, "C alone", -0.5), (2, "Z", "nothing here", 0.9), (3, "B", None, 0.1), (3, "B", None, 0.1)]
    art = spark.createDataFrame(rows, "article_id long, ticker string, title string, sentiment_compound double")
    uni = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    want = [(1, "A"), (1, "B"), (1, "C"), (3, "B"), (3, "B")]
    assert sorted((r.article_id, r.ticker) for r in matching.per_mention(art, uni).collect()) == want
    monkeypatch.setattr(matching, "LISTED_TICKERS", 1)
    assert sorted((r.article_id, r.ticker) for r in matching.per_mention(art, uni).collect()) == want
    dated = art.withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    counts = {r.ticker: r.article_count for r in ag.ticker_sentiment(dated, "2024-01-02", universe=uni).collect()}
    assert counts == {"A": 1, "B": 3, "C": 1}
    assert matching.per_mention(art.drop("title"), uni).count() == 3
    assert matching.per_mention(art.limit(0), uni).count() == 0


def test_signals_take_company_and_sector_from_the_dimension(spark):
    u = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    q = spark.createDataFrame([("A", 5.0, 25.0, "quoted"), ("B", 5.0, -3.14159, None), ("C", 5.0, None, "unknown")], "ticker string, price double, change_percent double, sector string")
    dim = spark.createDataFrame([("A", "Alpha", "tech"), ("B", "", "bank")], "ticker string, company_name string, sector string")
    s = ag.ticker_sentiment(news(spark, [(1, "A", None, 0.123456, "low", 0.2)]), "2024-01-01")
    got = {r.ticker: r for r in joins.ticker_signals(u, s, q, dim).collect()}
    assert [(got[t].company_name, got[t].sector) for t in "ABC"] == [("Alpha", "tech"), ("B", "bank"), ("C", "Unknown")]
    assert (got["A"].news_sentiment_score, got["A"].momentum_normalized) == (0.1235, 1.0)
    assert (got["B"].momentum_normalized, got["C"].momentum_normalized) == (-0.3142, 0.0)
    assert {r.sector for r in joins.ticker_signals(u, s, q).collect()} == {"quoted", "Unknown"}


def test_whole_articles_are_scored_once_and_stored_without_the_rest_of_the_text(spark, tmp_path):
    from catalog.text_queries import whole_articles

    rows = [(i, f"The thon is {w}. Worthless erin {w}", "en", "web", 30) for i, w in enumerate(("la", "und", "les"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = whole_articles(spark, str(tmp_path))
    assert out.inputFiles() == [] and "description" not in out.columns
    assert sorted(r.article_id for r in out.collect()) == [0, 1, 2]


def test_only_lexicon_words_leave_the_row_and_a_long_lexicon_scores_alike(spark, monkeypatch):
    df = spark.createDataFrame([(1, "not good", "a bad day, good day"), (2, None, None), (3, "plain", "words")], "article_id long, title string, description string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.5), ("bad", -0.5), (None, 1.0)], "token string, weight double")
    modifiers = spark.createDataFrame([("not", -0.5)], "prev string, factor double")
    scored = lambda: sorted(map(str, matching.sentiment_scores(df, lexicon, modifiers).collect()))
    assert "filter(transform" in matching.sentiment_scores(df, lexicon, modifiers)._jdf.queryExecution().optimizedPlan().toString()
    listed = scored()
    monkeypatch.setattr(matching, "LISTED_TICKERS", 1)
    assert scored() == listed and len(listed) == 1
