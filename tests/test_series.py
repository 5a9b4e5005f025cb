"""Indicators on hand-made series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewire.operators import indicators as ind
from tapewire.operators import ranking
from tapewire.operators.joins import asof_forward, next_day_change
from tapewire.plans.panel import daily_panel, model_panel

DAY = dt.date(2024, 1, 1)


def bars(spark, closes, ticker="A"):
    rows = [(ticker, DAY + dt.timedelta(days=i), c, c + 1.0, c - 1.0, c, 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[name] for r in df.orderBy("ticker", "date").collect()]


def walk(n, seed=3):
    return [float(x) for x in np.round(100 + np.cumsum(np.random.default_rng(seed).normal(0, 1, n)), 3)]


@pytest.mark.parametrize("n", [1, 2, 9, 70, 300])
@pytest.mark.parametrize("chunk", [4, 256])
def test_macd_matches_ewm(spark, n, chunk):
    closes = walk(n)
    c = pd.Series(closes)
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    want = macd - macd.ewm(span=9, adjust=False).mean()
    assert column(ind.macd_hist(bars(spark, closes), chunk=chunk), "macd_hist") == pytest.approx(list(want), abs=1e-9)


def test_rsi_flat_gain_and_rolling_means(spark):
    assert column(ind.rsi(bars(spark, [5.0] * 5)), "rsi14") == [50.0] * 5
    up = bars(spark, [1.0, 2.0, 3.0])
    assert column(ind.rsi(up), "rsi14") == [50.0] * 3
    assert column(ind.rsi(up, flat_value=100.0), "rsi14")[-1] == 100.0
    closes = walk(40)
    d = pd.Series(closes).diff()
    gain = d.clip(lower=0).rolling(14, min_periods=1).mean()
    loss = (-d.clip(upper=0)).rolling(14, min_periods=1).mean()
    want = (100 - 100 / (1 + gain / loss.replace(0, np.nan))).fillna(50)
    assert column(ind.rsi(bars(spark, closes)), "rsi14") == pytest.approx(list(want))


def test_flat_prices_are_neutral(spark):
    t = ind.technicals(bars(spark, [7.0] * 25)).orderBy("date").collect()
    assert {(r.rsi14, r.bb_pos, r.vol_ratio, r.price_trend) for r in t} == {(50.0, 0.5, 1.0, 1.0)}
    assert all(abs(r.macd_hist) < 1e-12 for r in t)


def test_nineteen_bars_are_too_few(spark):
    both = bars(spark, walk(19), "A").union(bars(spark, walk(20), "B"))
    assert {r.ticker for r in ind.technicals(both).collect()} == {"B"}


def test_forward_return_keeps_unlabelled_rows_for_inference(spark):
    b = bars(spark, [1.0, 2.0, 1.0])
    assert column(ind.forward_return(b), "return_fwd") == [1.0, -0.5]
    assert column(ind.forward_return(b, keep_unlabelled=True), "return_fwd") == [1.0, -0.5, None]


def test_panel_keeps_days_without_news_and_single_article_std(spark):
    news = spark.createDataFrame(
        [(1, "A", DAY, 0.4, "high", 0.5)],
        "article_id long, ticker string, date date, sentiment_compound double, impact_level string, relevance_score double",
    )
    rows = daily_panel(news, bars(spark, [1.0, 2.0, 3.0])).orderBy("date").collect()
    assert [(r.news_count, r.sent_std, r.high_impact_count) for r in rows] == [(1.0, 0.0, 1.0), (0.0, 0.0, 0.0)]
    assert (rows[0].rsi14, rows[0].vol_ratio) == (50.0, 1.0)
    assert model_panel(news, bars(spark, [1.0, 2.0, 3.0])).count() == 3


def test_panel_is_one_shuffle_per_side(spark):
    plan = ind.technicals(bars(spark, walk(30)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_asof_uses_the_next_trading_row_and_needs_a_full_horizon(spark):
    rows = [("A", DAY, 10.0), ("A", DAY + dt.timedelta(3), 20.0), ("A", DAY + dt.timedelta(4), 30.0)]
    b = spark.createDataFrame(rows, "ticker string, date date, close double")
    arts = spark.createDataFrame(
        [(1, "A", DAY), (2, "A", DAY + dt.timedelta(1)), (3, "A", DAY + dt.timedelta(4)), (4, "A", DAY + dt.timedelta(9))],
        "article_id long, ticker string, date date",
    )
    got = {r.article_id: (r.bar_date, round(r.change_percent, 6)) for r in asof_forward(arts, b).collect()}
    assert got == {1: (DAY, 100.0), 2: (DAY + dt.timedelta(3), 50.0)}


def test_next_day_needs_adjacent_days(spark):
    b = bars(spark, [10.0, 11.0]).union(bars(spark, [1.0], "B"))
    assert [(r.ticker, round(r.change_percent, 6)) for r in next_day_change(b).collect()] == [("A", 10.0)]


def test_quote_with_one_bar_has_no_change(spark):
    q = ranking.last_quote(bars(spark, [4.0])).first()
    assert (q.previous_close, q.change, q.change_percent) == (4.0, 0.0, 0.0)


def test_rank_bands_overlap_on_few_rows(spark):
    p = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "ticker string, ml_probability_up double")
    got = {r.ticker: r.ml_recommendation for r in ranking.rank_recommend(p).collect()}
    assert got == {"A": "STRONG BUY", "B": "HOLD"}
    one = ranking.rank_recommend(p.where("ticker = 'A'")).collect()
    assert [r.ml_recommendation for r in one] == ["STRONG BUY"]


def test_rows_without_a_probability_are_held(spark):
    p = spark.createDataFrame([("A", 0.9), ("B", None), ("C", 0.1)], "ticker string, ml_probability_up double")
    got = {r.ticker: r.ml_recommendation for r in ranking.rank_recommend(p).collect()}
    assert got == {"A": "STRONG BUY", "B": "HOLD", "C": "STRONG SELL"}


def test_offset_without_limit_is_not_collected(spark):
    df = spark.range(50).withColumn("v", F.col("id") % 7)
    out = ranking.page(df, [F.desc("v"), F.asc("id")], offset=45)
    assert [r.id for r in out.collect()] == [r.id for r in df.orderBy(F.desc("v"), "id").collect()][45:]
    assert "CollectLimit" not in out._jdf.queryExecution().executedPlan().toString()


def test_latest_slice_keeps_all_unless_asked(spark):
    rows = [(f"T{i}", DAY, 1 if i < 4 else 0) for i in range(8)]
    panel = spark.createDataFrame(rows, "ticker string, date date, news_count int")
    assert ranking.latest_slice(panel).count() == 8
    assert ranking.latest_slice(panel, news_only=True).count() == 4


def test_losers_are_worst_first(spark):
    q = spark.createDataFrame([("A", -1.0), ("B", -9.0), ("C", 2.0)], "ticker string, change_percent double")
    assert [r.ticker for r in ranking.losers(q, 2).collect()] == ["B", "A"]


def test_empty_bars(spark):
    empty = bars(spark, [1.0]).where(F.lit(False))
    assert ind.technicals(empty).collect() == []
    assert ranking.last_quote(empty).collect() == []


def test_a_gap_inside_a_session_is_filled_and_none_across(spark):
    import datetime as dt

    from tapewire.operators.intraday import intraday_bars

    at = lambda d, h, m, s=0: dt.datetime(2024, 1, d, h, m, s)
    ticks = [("A", at(2, 9, 0), 10.0, 1.0, 1), ("A", at(2, 9, 4, 59), 12.0, 1.0, 2), ("A", at(2, 9, 4, 59), 11.0, 1.0, 3), ("A", at(2, 9, 16), 9.0, None, 4)]
    ticks += [("A", at(2, 8, 59), 99.0, 1.0, 5), ("A", at(2, 10, 0), 99.0, 1.0, 6), ("A", at(3, 9, 30), 8.0, 1.0, 7), ("A", at(4, 9, 30), 8.0, 1.0, 8), ("B", at(2, 9, 0), None, 1.0, 9)]
    frame = spark.createDataFrame(ticks, "ticker string, ts timestamp, price double, volume double, tick_id long")
    sessions = spark.createDataFrame([(dt.date(2024, 1, d), at(d, 9, 0), at(d, 10, 0)) for d in (2, 3)], "date date, opens timestamp, closes timestamp")
    rows = [(r.start.day, r.start.minute, r.open, r.high, r.low, r.close, r.volume, r.trades) for r in intraday_bars(frame, sessions, 5).orderBy("start").collect()]
    assert rows == [
        (2, 0, 10.0, 12.0, 10.0, 11.0, 3.0, 3), (2, 5, 11.0, 11.0, 11.0, 11.0, 0.0, 0), (2, 10, 11.0, 11.0, 11.0, 11.0, 0.0, 0), (2, 15, 9.0, 9.0, 9.0, 9.0, 0.0, 1),
        (3, 30, 8.0, 8.0, 8.0, 8.0, 1.0, 1),
    ]


def test_technicals_share_one_sort_by_date_and_one_by_place(spark, capsys):
    rows = [(t, dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0 * i, 2.0 * i + 1, 0.5 * i, 1.5 * i + 1, 10.0) for t in ("A", "B") for i in range(30)]
    bars = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    ind.technicals(bars).explain()
    assert capsys.readouterr().out.count(" Sort ") == 2


def test_technicals_walk_no_window_row_by_row_and_equal_the_single_indicators(spark, capsys):
    rows = [(t, dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0, 2.0 + i % 5, 0.5, None if i % 9 == 4 else float(i * i % 17), float(i % 3)) for t, n in (("A", 45), ("B", 21), (None, 30)) for i in range(n)]
    b = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    b = b.withColumn("close", F.when(F.col("ticker") == "B", 3.0).otherwise(F.col("close")))
    want = b
    for single in (ind.rsi, ind.bollinger_pos, ind.volume_ratio, ind.price_trend, ind.atr_pct, ind.macd_hist):
        want = single(want)
    want = sorted(want.select("ticker", "date", *ind.NEUTRAL).collect(), key=str)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for n in (1, 7, 10_000):  # what a window needs from the batches before is kept
            spark.conf.set(size, n)
            assert sorted(ind.technicals(b).collect(), key=str) == want
    finally:
        spark.conf.set(size, before)
    ind.technicals(b).explain()
    assert "specifiedwindowframe(RowFrame, -19" not in capsys.readouterr().out


@pytest.mark.parametrize("repeated", [False, True])
def test_a_stored_panel_makes_bars_once_and_equals_the_joined_one(spark, repeated, capsys):
    from tapewire.plans import refresh

    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [(t, day(i) if i else None, 1.0, 2.0 + i % 5, 0.5, float(i * i % 17 + 1), float(i % 3)) for t, n in (("A", 30), ("B", 10), (None, 25)) for i in range(n)]
    if repeated:
        rows += [("A", day(3), 1.0, 5.0, 0.5, 10.0, 0.0)]
    b = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    news = spark.createDataFrame(
        [(i, "AB"[i % 2] if i % 5 else None, day(i % 8), i / 10, "high", 0.5) for i in range(20)],
        "article_id long, ticker string, date date, sentiment_compound double, impact_level string, relevance_score double",
    )
    old, new = model_panel(news, b), refresh.stored_panel(news, b)
    assert new.dtypes == old.dtypes
    if repeated:
        assert new.count() == old.count() == len(rows) - 2 + 8
        return
    new.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert sorted(map(str, new.collect())) == sorted(map(str, old.collect()))
