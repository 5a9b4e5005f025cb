"""Training, comparing, storing and applying direction classifiers with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewire.functions.scores import PANEL_PROBABILITY, model_confidence, model_score, recommend
from tapewire.operators.metrics import auc, binary_metrics
from tapewire.operators.ranking import latest_slice, rank_recommend
from tapewire.operators.scale import checkpointed, dealt, global_row_number, union_all
from tapewire.plans.kernel import kernel_svc
from tapewire.plans.trees import grow, is_tree

FEATURES = (
    "news_count", "sent_mean", "sent_std", "sent_min", "sent_max", "relevance_mean", "high_impact_count", "macro_count",
    "sent_mean_roll3", "news_count_roll3", "sent_mean_roll7", "news_count_roll7", "rsi14", "macd_hist", "bb_pos", "vol_ratio",
    "price_trend", "atr_pct", "return_lag1", "return_lag2", "vol_5d", "sent_news_interaction", "sent_range",
)
BACKTEST_FEATURES = (
    "daily_return", "sma_ratio", "volatility_5", "momentum_5", "volume_change", "high_low_range",
)


@dataclass(frozen=True)
class Forest:
    trees: int = 400
    depth: int = 10
    min_leaf: int = 10


@dataclass(frozen=True)
class Boost:
    rounds: int = 500
    depth: int = 5
    rate: float = 0.03
    subsample: float = 0.8


@dataclass(frozen=True)
class Plan:
    """Sizes of the three ensemble members and their vote weights."""

    forest: Forest = field(default_factory=Forest)
    boost_a: Boost = field(default_factory=Boost)
    boost_b: Boost = field(default_factory=lambda: Boost(depth=6, subsample=0.7))
    votes: Mapping[str, float] = field(default_factory=lambda: {"boost_a": 1.2, "boost_b": 1.0, "forest": 0.8})
    seed: int = 42


# ---- splits and rows ---------------------------------------------------------------------------------


def last_dates_cut(panel: DataFrame, n: int) -> DataFrame:
    """One row: the earliest of the n newest dates (dates are bounded by the calendar)."""
    return panel.select("date").distinct().orderBy(F.desc("date")).limit(n).agg(F.min("date").alias("cut"))


def time_split(panel: DataFrame, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(train, test): the newest ``share`` of the dates, rounded up, is the test set; a date is never cut."""
    dates = panel.select("date").distinct()
    # a row per calendar day reaches this window
    place = dates.withColumn("_i", F.row_number().over(W.orderBy(F.desc("date"))))
    n = F.ceil(dates.agg(F.count("*")).scalar() * share)
    cut = place.where(F.col("_i") <= n).agg(F.min("date")).scalar()
    return panel.where(F.col("date") < cut), panel.where(F.col("date") >= cut)


def validation_slice(train: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(fit, tune): the newest training dates are held out for tuning."""
    cut = last_dates_cut(train, days).scalar()
    return train.where(F.col("date") < cut), train.where(F.col("date") >= cut)


def training_rows(panel: DataFrame, news_only: bool = False) -> DataFrame:
    """Labelled rows, on request only those with news."""
    labelled = panel.where(F.col("direction_fwd").isin(0, 1) & F.col("return_fwd").isNotNull())
    return labelled.where(F.col("news_count") > 0) if news_only else labelled


def class_weight(df: DataFrame, label: str = "direction_fwd", name: str = "weight") -> DataFrame:
    """Balanced weights n / (2 * n_class)."""
    n, pos = df.agg(F.count("*")).scalar(), df.agg(F.sum(label)).scalar()
    size = F.when(F.col(label) == 1, pos).otherwise(n - pos)
    return df.withColumn(name, n / (2.0 * size))


def _dealt(df: DataFrame, keys: Sequence[str], label: str, seed: int) -> DataFrame:
    """Rows numbered in ``_rn``: class by class, inside a class in the order of an md5 of the keys."""
    mark = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return global_row_number(df.withColumn("_mark", mark), [F.col(label), F.col("_mark"), *map(F.col, keys)], "_rn").drop("_mark")


def stratified_fold(df: DataFrame, keys: Sequence[str], k: int = 5, seed: int = 42, label: str = "direction_fwd") -> DataFrame:
    """A repeatable fold number per row; a class's rows are dealt to the folds in turn, so its counts differ by one at most."""
    return _dealt(df, keys, label, seed).withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


def holdout(df: DataFrame, keys: Sequence[str], share: float = 0.8, seed: int = 42, label: str = "direction_fwd") -> tuple[DataFrame, DataFrame]:
    """(train, test): a repeatable split that deals every class in the same proportion."""
    edge = round(share * 10_000)
    upto = lambda n: F.floor(n * edge / 10_000)
    # the train set grows by one wherever its share of the rows so far passes a whole number
    dealt = checkpointed(_dealt(df, keys, label, seed).withColumn("_train", upto(F.col("_rn")) > upto(F.col("_rn") - 1)).drop("_rn"))
    return dealt.where("_train").drop("_train"), dealt.where("not _train").drop("_train")


def category_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Sorted category codes, missing values as 'Unknown'."""
    filled = df.withColumn("_c", F.coalesce(F.col(column), F.lit("Unknown")))
    indexer = StringIndexer(inputCol="_c", outputCol=name, stringOrderType="alphabetAsc")
    return indexer.fit(filled).transform(filled).drop("_c")


# ---- models -------------------------------------------------------------------------------------------


def _fill(df: DataFrame, features: Sequence[str]) -> DataFrame:
    absent = {f: F.lit(0.0) for f in features if f not in df.columns}
    df = df.withColumns(absent) if absent else df
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def _pipeline(features: Sequence[str], estimator, scale: bool) -> Pipeline:
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, estimator])


def _common(label: str, seed: int | None = None) -> dict:
    base = {"featuresCol": "features", "labelCol": label, "weightCol": "weight"}
    return base if seed is None else {**base, "seed": seed}


def forest(p: Forest, label: str, seed: int) -> RandomForestClassifier:
    # without the kept node of each row and tree, every pass would walk all trees from their roots
    return RandomForestClassifier(
        numTrees=p.trees, maxDepth=p.depth, minInstancesPerNode=p.min_leaf, featureSubsetStrategy="sqrt", cacheNodeIds=True, **_common(label, seed)
    )


def boost(p: Boost, label: str, seed: int) -> GBTClassifier:
    return GBTClassifier(maxIter=p.rounds, maxDepth=p.depth, stepSize=p.rate, subsamplingRate=p.subsample, **_common(label, seed))


ROWS_PER_TASK = 200_000


def _ready(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """What a fit reads, written once and dealt evenly: a fit passes over its rows many times, and a pass is as long as its longest task.

    Every task of a tree model's pass sends figures of all nodes, so there are no more tasks than cores until they would hold many rows.
    """
    rows = _fill(df, features).where(F.col(label).isNotNull()).select(*features, label)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
    return checkpointed(rows.repartition(tasks))


def _dense(df: DataFrame, assembler: VectorAssembler) -> DataFrame:
    """The assembled features; a sparse vector would be searched at every split of every tree."""
    name = assembler.getOutputCol()
    return assembler.transform(df).withColumn(name, array_to_vector(vector_to_array(name)))


def fit(df: DataFrame, estimator, features: Sequence[str] = FEATURES, label: str = "direction_fwd", scale: bool = False) -> PipelineModel:
    return _fit(_ready(df, features, label), estimator, features, label, scale)


def _fit(rows: DataFrame, estimator, features: Sequence[str], label: str, scale: bool = False) -> PipelineModel:
    return _fit_all(rows, [estimator], features, label, scale)[0]


def _fit_all(rows: DataFrame, estimators: Sequence, features: Sequence[str], label: str, scale: bool = False) -> list[PipelineModel]:
    """Fits on the same rows; trees are grown together in one job where a task can hold the rows as bytes."""
    grown = grow(rows, estimators, features, label) if all(map(is_tree, estimators)) else None
    if grown is None:
        return [_pipeline(features, e, scale).fit(class_weight(rows, label)) for e in estimators]
    before, scaled = _pipeline(features, None, scale).getStages()[:-1], None
    if scale:
        before[1] = before[1].fit(before[0].transform(rows))
        mean, std = before[1].mean.toArray(), before[1].std.toArray()
        scaled = lambda f, edge: (edge - mean[f]) * (1 / std[f])
    return [PipelineModel([*before, model]) for model in side_by_side(rows.sparkSession, lambda made: made(scaled=scaled), grown)]


def side_by_side(spark: SparkSession, work: Callable, items: Sequence) -> list:
    """Results in order; the many small jobs of a model need not wait for those of the next."""
    with ThreadPoolExecutor(min(8, spark.sparkContext.defaultParallelism)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def probability_up(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str = "probability") -> DataFrame:
    """The model's probability of a rise; a margin model's margin goes through the logistic curve."""
    return _probability(model, _fill(df, features), {}, name)


def _probability(model: PipelineModel, df: DataFrame, vectors: Mapping[tuple[str, ...], str], name: str) -> DataFrame:
    """``vectors`` names the columns that hold features, by their names, assembled already."""
    out = df
    for stage in model.stages:
        if isinstance(stage, VectorAssembler):
            made = vectors.get(tuple(stage.getInputCols()))
            out = out.withColumn(stage.getOutputCol(), F.col(made)) if made else _dense(out, stage)
        else:
            out = stage.transform(out)
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    extra = [c for c in ("_raw", "features", "kernel", "rawPrediction", "probability", "prediction") if c in out.columns and c not in df.columns]
    return out.withColumn("_p", p).drop(*extra).withColumnRenamed("_p", name)


@dataclass
class Ensemble:
    """Fitted members with their vote weights."""

    members: dict[str, PipelineModel]
    votes: dict[str, float]
    features: tuple[str, ...]

    def score(self, df: DataFrame, name: str = "probability", deal: bool = True) -> DataFrame:
        """All members score the same rows in one pass; no joins.

        Hundreds of trees cost far more than a row's bytes, by which files are split, so rows are dealt evenly unless ``deal`` is off.
        """
        df = _fill(dealt(df) if deal else df, self.features)
        df = _dense(df, VectorAssembler(inputCols=list(self.features), outputCol="_vector"))
        for member, model in self.members.items():
            df = _probability(model, df, {tuple(self.features): "_vector"}, f"_p_{member}")
        return soft_vote(df, {f"_p_{m}": self.votes[m] for m in self.members}, name).drop("_vector", *[f"_p_{m}" for m in self.members])

    def save(self, path: str, meta: DataFrame | None = None) -> None:
        for member, model in self.members.items():
            model.write().overwrite().save(f"{path}/{member}")
        if meta is not None:
            meta.write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(path: str, votes: Mapping[str, float], features: Sequence[str] = FEATURES) -> Ensemble:
        return Ensemble({m: PipelineModel.load(f"{path}/{m}") for m in votes}, dict(votes), tuple(features))


def soft_vote(df: DataFrame, weights: Mapping[str, float], name: str = "probability") -> DataFrame:
    """Weighted mean of probability columns."""
    total = sum(weights.values())
    acc = F.lit(0.0)
    for c, w in weights.items():
        acc = acc + F.col(c) * (w / total)
    return df.withColumn(name, acc)


def train_ensemble(train: DataFrame, plan: Plan = Plan(), features: Sequence[str] = FEATURES, label: str = "direction_fwd") -> Ensemble:
    estimators = {
        "boost_a": boost(plan.boost_a, label, plan.seed),
        "boost_b": boost(plan.boost_b, label, plan.seed + 1),
        "forest": forest(plan.forest, label, plan.seed),
    }
    rows = _ready(train, features, label)
    members = dict(zip(estimators, _fit_all(rows, list(estimators.values()), features, label)))
    return Ensemble(members, dict(plan.votes), tuple(features))


def random_search(train: DataFrame, tune: DataFrame, trials: int = 30, seed: int = 42, base: Boost = Boost(), features: Sequence[str] = FEATURES, label: str = "direction_fwd") -> DataFrame:
    """Random boosting settings, each with its AUC on the tuning slice and the rows this was measured on."""
    rng = random.Random(seed)
    plans = [
        replace(
            base,
            depth=rng.randint(3, 7),
            rate=round(10 ** rng.uniform(-2.3, -0.7), 4),
            rounds=rng.randint(max(2, base.rounds // 2), base.rounds),
            subsample=round(rng.uniform(0.6, 1.0), 2),
        )
        for _ in range(trials)
    ]
    # the trials share their rows and are grown side by side
    fitted = _fit_all(_ready(train, features, label), [boost(p, label, seed + i) for i, p in enumerate(plans)], features, label)
    tune = checkpointed(dealt(_fill(tune.where(F.col(label).isNotNull()), features).select(label, *features)))

    def measured(trial: int) -> DataFrame:
        p = plans[trial]
        scored = checkpointed(probability_up(fitted[trial], tune, features).select(label, "probability"))  # ranks and counts both read it
        return auc(scored, label, "probability").select(
            F.lit(trial).alias("trial"), F.lit(p.depth).alias("depth"), F.lit(p.rate).alias("rate"),
            F.lit(p.rounds).alias("rounds"), F.lit(p.subsample).alias("subsample"), "auc",
            scored.agg(F.count("*")).scalar().alias("tuned_on"),
        )

    return union_all(side_by_side(train.sparkSession, measured, range(trials)))


def baselines(
    trees: int = 100, rounds: int = 100, steps: int = 100, label: str = "direction_fwd", seed: int = 42, features: Sequence[str] = FEATURES
) -> dict[str, tuple[object, bool]]:
    """Plain classifiers to compare with: name to (estimator, needs scaling)."""
    return {
        "logistic": (LogisticRegression(maxIter=steps, **_common(label)), True),
        "forest": (forest(Forest(trees, 10, 5), label, seed), False),
        "boosted": (boost(Boost(rounds, 5, 0.1, 1.0), label, seed), False),
        "linear_svc": (LinearSVC(maxIter=steps, **_common(label)), True),
        "kernel_svc": (kernel_svc(len(features), label, steps=steps, seed=seed), True),
    }


def compare(train: DataFrame, test: DataFrame, models: Mapping[str, tuple[object, bool]], features: Sequence[str] = FEATURES, label: str = "direction_fwd") -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Metrics table of several models, best F1 flagged, and the fitted models."""
    ready, rows = _ready(train, features, label), []
    together = [name for name, (estimator, scale) in models.items() if is_tree(estimator) and not scale]
    grown = dict(zip(together, _fit_all(ready, [models[name][0] for name in together], features, label)))
    fitted = {name: grown[name] if name in grown else _fit(ready, estimator, features, label, scale) for name, (estimator, scale) in models.items()}
    test = checkpointed(dealt(_fill(test.where(F.col(label).isNotNull()), features).select(label, *features)))
    for name, model in fitted.items():
        scored = probability_up(model, test, features)
        scored = scored.select(F.col(label).alias("label"), "probability", (F.col("probability") >= 0.5).cast("int").alias("predicted"))
        rows.append(binary_metrics(checkpointed(scored), score="probability").withColumn("model", F.lit(name)))
    table = union_all(rows)
    return table.withColumn("is_best", F.col("model") == table.agg(F.max_by("model", F.struct("f1", "model"))).scalar()), fitted


def top_vote(table: DataFrame, fitted: Mapping[str, PipelineModel], k: int = 3, features: Sequence[str] = FEATURES) -> Ensemble:
    """The k models with the best F1, equal votes; the table has one row per model."""
    best = [r.model for r in table.orderBy(F.desc("f1"), "model").limit(k).select("model").collect()]
    return Ensemble({m: fitted[m] for m in best}, {m: 1.0 for m in best}, tuple(features))


def cross_validate(df: DataFrame, estimator, k: int = 5, keys: Sequence[str] = ("ticker", "date"), features: Sequence[str] = FEATURES, label: str = "direction_fwd", scale: bool = False) -> DataFrame:
    """Accuracy per fold of a repeatable k-fold split."""
    folds = stratified_fold(df.where(F.col(label).isNotNull()), keys, k, label=label)
    out = []
    for i in range(k):
        model = fit(folds.where(F.col("fold") != i), estimator, features, label, scale)
        scored = probability_up(model, folds.where(F.col("fold") == i), features)
        hit = ((F.col("probability") >= 0.5).cast("int") == F.col(label)).cast("double")
        out.append(scored.agg(F.lit(i).alias("fold"), F.avg(hit).alias("accuracy"), F.count("*").alias("n")))
    return union_all(out)


def feature_importance(spark: SparkSession, model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """Rows (feature, importance) of a tree model; as many as there are features."""
    rows = [(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def evaluate(ensemble: Ensemble, test: DataFrame, label: str = "direction_fwd") -> DataFrame:
    used = [c for c in ensemble.features if c in test.columns]
    scored = ensemble.score(test.where(F.col(label).isNotNull()).select(label, *used))
    rows = scored.select(F.col(label).alias("label"), "probability", (F.col("probability") >= 0.5).cast("int").alias("predicted"))
    return binary_metrics(checkpointed(rows), score="probability")  # counts and ranks both read it


def predict_latest(ensemble: Ensemble, panel: DataFrame) -> DataFrame:
    """Scores of the newest date: rank-based labels spread over the tickers."""
    scored = ensemble.score(latest_slice(panel), "ml_probability_up")
    p = F.col("ml_probability_up")
    scored = scored.select(
        "ticker", "date", "ml_probability_up", model_confidence(p).alias("ml_confidence"), model_score(p).alias("ml_score"),
        recommend(p, PANEL_PROBABILITY).alias("ladder_recommendation"),
    )
    return rank_recommend(checkpointed(scored))  # read by several parts of the ranking


def train(panel: DataFrame, path: str, trained_at: str, plan: Plan = Plan(), test_share: float = 0.2, news_only: bool = False) -> tuple[Ensemble, DataFrame]:
    """Split, fit, evaluate on the newest dates, store members and a meta row."""
    train_part, test_part = time_split(training_rows(panel, news_only), test_share)
    ensemble = train_ensemble(train_part, plan)
    meta = evaluate(ensemble, test_part).select(
        F.lit(trained_at).cast("timestamp").alias("trained_at"),
        F.lit("ensemble").alias("model"),
        F.lit(",".join(ensemble.features)).alias("features"),
        "*",
    )
    ensemble.save(path, meta)
    return ensemble, panel.sparkSession.read.parquet(f"{path}/meta")
