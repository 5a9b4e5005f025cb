"""Classifier metrics, data-driven thresholds and the trading simulation.

Ranks and curves come from counts per distinct score and running sums over
range-partitioned blocks; no task sees the whole score column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewire.functions.numeric import interval
from tapewire.operators.scale import approx_quantiles, exact_quantiles, global_running, union_all

# ---- thresholds ------------------------------------------------------------------------------

# Quantile of each cut point, and the value used with too little data.
SENTIMENT_CUTS = {
    "very_positive": (0.90, 0.5),
    "positive": (0.65, 0.05),
    "neutral_upper": (0.55, 0.05),
    "neutral_lower": (0.45, -0.05),
    "negative": (0.35, -0.05),
    "very_negative": (0.10, -0.5),
}
RECOMMENDATION_CUTS = {
    "strong_buy": (0.90, 0.5),
    "buy": (0.70, 0.2),
    "sell": (0.30, -0.2),
    "strong_sell": (0.10, -0.5),
}
CONFIDENCE_CUTS = {"high": (0.75, 0.7), "medium": (0.50, 0.5), "low": (0.25, 0.3)}


def thresholds(
    df: DataFrame, column: str, cuts: Mapping[str, tuple[float, float]], exact: bool = True
) -> DataFrame:
    """Rows (name, value, n_rows): the quantile cut points of a column and how many values they rest on.

    Without a single value the stated defaults apply.
    """
    spark = df.sparkSession
    known = df.where(F.col(column).isNotNull())
    rows = [(name, p, default) for name, (p, default) in cuts.items()]
    names = spark.createDataFrame(rows, "name string, prob double, fallback double")
    values = (exact_quantiles if exact else approx_quantiles)(known, column, [p for _, p, _ in rows])
    n = known.agg(F.count("*").alias("n_rows"))
    found = names.join(values, "prob", "left").select("name", F.coalesce("value", "fallback").alias("value"))
    return found.withColumn("n_rows", n.scalar())


# ---- classification ----------------------------------------------------------------------------


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: area under the ROC curve with ties at average rank; 0.5 with one class."""
    per = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )
    run = global_running(per, [F.col("s")], {"neg_upto": "neg"})
    # in doubles: the pair count of a large table exceeds 64 bits
    pairs = F.sum(F.col("pos").cast("double") * (F.col("neg_upto") - F.col("neg") / 2.0))
    all_pairs = F.sum("pos").cast("double") * F.sum("neg")
    return run.agg(F.coalesce(F.try_divide(pairs, all_pairs), F.lit(0.5)).alias("auc"))


def binary_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted", score: str | None = None) -> DataFrame:
    """accuracy, precision, recall, f1 (0 where undefined) and, with a score, auc."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    c = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = c.select(
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    return out if score is None else out.withColumn("auc", auc(df, label, score).scalar())


def confusion_matrix(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Per class: precision, recall, f1 and support, from one confusion aggregation."""
    cm = confusion_matrix(df, label, predicted)
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.lit("actual").alias("side")),
        F.struct(F.col("predicted").alias("class"), F.lit("predicted").alias("side")),
    )
    long = cm.withColumn("hit", F.col("actual") == F.col("predicted")).select("n", "hit", F.explode(sides).alias("c"))
    total = lambda side, hit=None: F.sum(
        F.when((F.col("c.side") == side) & (F.lit(True) if hit is None else F.col("hit")), F.col("n")).otherwise(0)
    )
    per = long.groupBy(F.col("c.class").alias("class")).agg(
        total("actual", True).alias("_tp"), total("actual").alias("support"), total("predicted").alias("_pred")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return per.select(
        "class",
        ratio(F.col("_tp"), F.col("_pred")).alias("precision"),
        ratio(F.col("_tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("_tp"), F.col("_pred") + F.col("support")).alias("f1"),
        "support",
    )


def accuracy_by(df: DataFrame, group: str, correct: str = "correct") -> DataFrame:
    return df.groupBy(group).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count("*").alias("n"))


CONFIDENCE_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
CONFIDENCE_BINS = ("0-20%", "20-40%", "40-60%", "60-80%", "80-100%")


def accuracy_by_confidence(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Accuracy per bin of |p - 1/2| * 2; zero confidence belongs to the first bin."""
    conf = F.abs(F.col(probability) - 0.5) * 2
    rows = df.withColumn("bin", interval(conf, CONFIDENCE_EDGES, CONFIDENCE_BINS, open_end=True)).withColumn(
        "correct", (F.col("predicted") == F.col("label")).cast("int")
    )
    return accuracy_by(rows, "bin")


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, fpr, tpr) at each distinct score; one call per model."""
    per = df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )
    run = global_running(per, [F.desc("score")], {"tp": "pos", "fp": "neg"})
    p = run.agg(F.sum("pos")).scalar()
    n = run.agg(F.sum("neg")).scalar()
    return run.select(
        "score", F.try_divide(F.col("fp").cast("double"), n).alias("fpr"), F.try_divide(F.col("tp").cast("double"), p).alias("tpr")
    )


def model_comparison(scored: Mapping[str, DataFrame], score: str = "probability") -> DataFrame:
    """Metrics of several models side by side, best F1 flagged."""
    rows = union_all([binary_metrics(df, score=score).withColumn("model", F.lit(name)) for name, df in scored.items()])
    best = rows.agg(F.max_by("model", F.struct("f1", "auc", "model"))).scalar()
    return rows.withColumn("is_best", F.col("model") == best)


# ---- trading simulation --------------------------------------------------------------------------


def trades(df: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Confident predictions with the return of going long on up and short on down."""
    conf = F.abs(F.col("probability") - 0.5) * 2
    side = F.when(F.col("predicted") == 1, F.col("return_fwd")).otherwise(-F.col("return_fwd"))
    return df.where(conf > min_confidence).withColumn("strategy_return", side)


def cumulative_return(trade_rows: DataFrame) -> DataFrame:
    """Per day: equal-weight strategy and market return and both compounded so far.

    Trades are averaged per day first, so the ordered window runs over calendar days only.
    """
    daily = trade_rows.groupBy("date").agg(
        F.avg("strategy_return").alias("strategy_return"), F.avg("return_fwd").alias("market_return"), F.count("*").alias("trades")
    )
    w = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumns(
        {
            "cum_strategy": F.product(1 + F.col("strategy_return")).over(w),
            "cum_market": F.product(1 + F.col("market_return")).over(w),
        }
    )


def trading_summary(trade_rows: DataFrame) -> DataFrame:
    """Final returns, alpha and win rate."""
    days = cumulative_return(trade_rows)
    win = trade_rows.agg(F.avg((F.col("strategy_return") > 0).cast("double"))).scalar()
    return days.agg(
        F.coalesce(F.max_by("cum_strategy", "date"), F.lit(1.0)).alias("final_strategy"),
        F.coalesce(F.max_by("cum_market", "date"), F.lit(1.0)).alias("final_market"),
        F.coalesce(F.sum("trades"), F.lit(0)).alias("trades"),
    ).select(
        "final_strategy",
        "final_market",
        (F.col("final_strategy") - F.col("final_market")).alias("alpha"),
        "trades",
        F.coalesce(win, F.lit(0.0)).alias("win_rate"),
    )
