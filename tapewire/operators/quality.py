"""Data-quality checks: one conditional aggregation per table, results as long rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.operators.scale import union_all

LABELS = ("STRONG BUY", "BUY", "HOLD", "SELL", "STRONG SELL")


@dataclass(frozen=True)
class Check:
    """``count`` offending rows as an aggregate; reported when above zero."""

    rule: str
    severity: str
    count: Column
    needs: tuple[str, ...] = ()


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def _outside(c: str, low: float, high: float) -> Column:
    return F.count_if((F.col(c) < low) | (F.col(c) > high))


def _report(df: DataFrame, table: str, required: Sequence[str], checks: Sequence[Check]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    all_checks = [
        Check(f"missing column {c}", "error", F.lit(1).cast("long")) for c in missing
    ] + [Check("empty table", "error", (F.count("*") == 0).cast("long"))]
    all_checks += [c for c in checks if all(n in df.columns for n in c.needs)]
    wide = df.agg(*[F.coalesce(c.count, F.lit(0)).cast("long").alias(f"c{i}") for i, c in enumerate(all_checks)])
    cells = F.array(
        *[
            F.struct(F.lit(c.rule).alias("rule"), F.lit(c.severity).alias("severity"), F.col(f"c{i}").alias("n"))
            for i, c in enumerate(all_checks)
        ]
    )
    return wide.select(F.explode(cells).alias("r")).select(F.lit(table).alias("table"), "r.rule", "r.severity", "r.n")


def news_checks(news: DataFrame) -> DataFrame:
    s = F.col("sentiment_compound")
    n = F.count("*")
    blank_tickers = F.count_if(_blank("ticker"))
    checks = [
        Check("all sentiment zero", "error", F.when((n > 10) & (F.count_if(s != 0) == 0), n).otherwise(0), ("sentiment_compound",)),
        Check("sentiment out of range", "error", _outside("sentiment_compound", -1, 1), ("sentiment_compound",)),
        Check("blank title", "warning", F.count_if(_blank("title")), ("title",)),
        Check("mostly blank ticker", "warning", F.when(blank_tickers > n * 0.5, blank_tickers).otherwise(0), ("ticker",)),
    ]
    base = _report(news, "news", ("title", "source", "ticker", "sentiment_compound", "sentiment_label"), checks)
    if "title" not in news.columns:
        return base
    # duplicates are counted per title with partial sums, so one repeated title is no hot spot
    repeats = news.groupBy("title").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n")
    )
    return base.unionByName(
        repeats.select(F.lit("news").alias("table"), F.lit("duplicate title").alias("rule"), F.lit("warning").alias("severity"), "n")
    )


def quote_checks(quotes: DataFrame) -> DataFrame:
    p = F.col("price")
    checks = [
        Check("suspicious price", "warning", F.count_if((p <= 0) | (p > 100_000)), ("price",)),
        Check("missing price", "warning", F.count_if(p.isNull()), ("price",)),
        Check("extreme change", "warning", _outside("change_percent", -50, 50), ("change_percent",)),
    ]
    return _report(quotes, "quotes", ("ticker", "price", "change_percent"), checks)


def prediction_checks(preds: DataFrame) -> DataFrame:
    rec = F.col("recommendation")
    checks = [
        Check("unknown recommendation", "error", F.count_if(rec.isNull() | ~rec.isin(*LABELS)), ("recommendation",)),
        Check("confidence out of range", "error", _outside("confidence", 0, 1), ("confidence",)),
        Check("score out of range", "error", _outside("prediction_score", -1, 1), ("prediction_score",)),
    ]
    return _report(preds, "predictions", ("ticker", "recommendation", "prediction_score", "confidence"), checks)


def quality_report(news: DataFrame, quotes: DataFrame, preds: DataFrame) -> DataFrame:
    """Every check with its count, per table."""
    return union_all([news_checks(news), quote_checks(quotes), prediction_checks(preds)])


def overall_valid(report: DataFrame) -> DataFrame:
    """Per table and for 'ALL': valid when no error rule has a count."""
    bad = F.count_if((F.col("severity") == "error") & (F.col("n") > 0))
    warn = F.count_if((F.col("severity") == "warning") & (F.col("n") > 0))
    agg = [(bad == 0).alias("valid"), bad.alias("errors"), warn.alias("warnings")]
    return report.groupBy("table").agg(*agg).unionByName(report.agg(*agg).withColumn("table", F.lit("ALL")))
