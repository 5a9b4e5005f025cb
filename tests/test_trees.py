import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import functions as F

from catalog import flow_queries
from tapewire.plans import model, trees

LABEL = "direction_fwd"


def rows(spark, n=600):
    made = [(float(i % 7), float(i % 11), float(i * 7919 % 13), int((i % 7) * 2 + i % 11 + i * 7919 % 5 > 12)) for i in range(n)]
    return spark.createDataFrame(made, f"a double, b double, c double, {LABEL} int")


def chances(fitted, df):
    scored = model.probability_up(fitted, df, ("a", "b", "c")).select("a", "b", "c", "probability")
    return [r.probability for r in scored.orderBy("a", "b", "c").collect()]


class Seen(Exception):
    pass


def seen(*args, **more):
    raise Seen(args, more)


def test_maintain_trains_the_whole_plan(spark, monkeypatch):
    monkeypatch.setattr(flow_queries, "collected", lambda spark, sf: None)
    monkeypatch.setattr(flow_queries, "bars", lambda spark, sf: None)
    monkeypatch.setattr(flow_queries.refresh, "maintain", lambda *args, train: train(None))
    monkeypatch.setattr(flow_queries.model, "train", seen)
    with pytest.raises(Seen) as got:
        flow_queries.maintain(spark, "")
    plan = got.value.args[0][3]
    assert plan == model.Plan() and (plan.forest.trees, plan.boost_a.rounds, plan.boost_b.rounds) == (400, 500, 500)


def test_the_search_tries_all_settings_at_full_size(spark, monkeypatch):
    monkeypatch.setattr(flow_queries, "panel", lambda spark, sf: None)
    monkeypatch.setattr(flow_queries.model, "training_rows", lambda rows, news_only: rows)
    monkeypatch.setattr(flow_queries.model, "validation_slice", lambda rows, days: (None, None))
    monkeypatch.setattr(flow_queries.model, "random_search", seen)
    with pytest.raises(Seen) as got:
        flow_queries.random_search(spark, "")
    assert got.value.args[0][2] == 30 and got.value.args[1]["base"] == model.Boost()


def test_a_grown_booster_equals_the_one_of_spark_ml(spark):
    df = model._ready(rows(spark), ("a", "b", "c"), LABEL)
    e = model.boost(model.Boost(12, 3, 0.2, 1.0), LABEL, 1)
    fitted = model._fit(df, e, ("a", "b", "c"), LABEL)
    theirs = model._pipeline(("a", "b", "c"), e, False).fit(model.class_weight(df, LABEL))
    ours = fitted.stages[-1]
    assert isinstance(ours, GBTClassificationModel) and ours.getNumTrees == 12 and ours.treeWeights == theirs.stages[-1].treeWeights
    assert np.allclose(chances(fitted, df), chances(theirs, df), atol=1e-5)
    assert np.allclose(ours.featureImportances.toArray(), theirs.stages[-1].featureImportances.toArray(), atol=1e-4)


@pytest.mark.parametrize("scale", [False, True])
def test_a_grown_tree_equals_the_one_of_spark_ml(spark, scale):
    df = model._ready(rows(spark), ("a", "b", "c"), LABEL)
    e = model.forest(model.Forest(1, 4, 5), LABEL, 1).setFeatureSubsetStrategy("auto").setBootstrap(False)
    fitted = model._fit(df, e, ("a", "b", "c"), LABEL, scale)
    theirs = model._pipeline(("a", "b", "c"), e, scale).fit(model.class_weight(df, LABEL))
    assert isinstance(fitted.stages[-1], RandomForestClassificationModel)
    assert np.allclose(chances(fitted, df), chances(theirs, df))


def test_a_forest_draws_rows_and_features_and_can_be_stored(spark, tmp_path):
    df = model._ready(rows(spark), ("a", "b", "c"), LABEL)
    fitted = model._fit(df, model.forest(model.Forest(30, 6, 2), LABEL, 3), ("a", "b", "c"), LABEL)
    forest = fitted.stages[-1]
    assert forest.getNumTrees == 30 and len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) == 30
    right = model.probability_up(fitted, df, ("a", "b", "c")).select(((F.col("probability") > 0.5).cast("int") == F.col(LABEL)).cast("int").alias("r"))
    assert right.agg(F.avg("r")).first()[0] > 0.9
    fitted.write().overwrite().save(str(tmp_path / "m"))
    assert chances(model.PipelineModel.load(str(tmp_path / "m")), df) == chances(fitted, df)


def test_rows_beyond_a_task_are_fitted_by_spark_ml(spark, monkeypatch):
    df = model._ready(rows(spark), ("a", "b", "c"), LABEL)
    e = model.boost(model.Boost(2, 2, 0.1), LABEL, 1)
    assert len(trees.grow(df, [e, e], ("a", "b", "c"), LABEL)) == 2
    monkeypatch.setattr(trees, "TASK_BYTES", 1000)
    assert trees.grow(df, [e], ("a", "b", "c"), LABEL) is None
    assert model._fit(df, e, ("a", "b", "c"), LABEL).stages[-1].getNumTrees == 2


def test_edges_lie_between_values_and_share_the_rows():
    assert trees._edges(np.array([0.0, 0.0, 1.0, 3.0]), 32).tolist() == [0.5, 2.0]
    assert len(trees._edges(np.zeros(9), 32)) == 0
    edges = trees._edges(np.arange(1024.0), 32)
    assert len(edges) == 31 and max(np.diff(edges)) <= 33
    heavy = trees._edges(np.concatenate([np.zeros(900), np.arange(124.0)]), 32)
    assert heavy[0] < 1 and len(heavy) > 1


def test_the_search_measures_every_trial(spark):
    df = rows(spark, 300)
    found = model.random_search(df, df.where("a < 3"), 3, base=model.Boost(6), features=("a", "b", "c")).orderBy("trial").collect()
    want = df.where("a < 3").count()
    assert [r.trial for r in found] == [0, 1, 2] and {r.tuned_on for r in found} == {want} and all(0.5 < r.auc <= 1 for r in found)


def test_tree_fits_do_not_pass_over_the_rows_level_by_level(spark, monkeypatch):
    df = model._ready(rows(spark), ("a", "b", "c"), LABEL)
    for kind in (model.RandomForestClassifier, model.GBTClassifier):
        monkeypatch.setattr(kind, "_fit", seen)
    for e in (model.forest(model.Forest(20, 5, 5), LABEL, 1), model.boost(model.Boost(5), LABEL, 1)):
        assert model._fit(df, e, ("a", "b", "c"), LABEL, scale=True).stages[-1].getNumTrees in (20, 5)


def test_a_comparison_stores_its_rows_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(model, "_ready", lambda *args, real=model._ready: made.append(args) or real(*args))
    df = rows(spark, 300)
    models = {k: v for k, v in model.baselines(4, 2, 3, features=("a", "b", "c")).items() if k in ("forest", "boosted", "logistic")}
    table, fitted = model.compare(df, df, models, ("a", "b", "c"))
    found = table.collect()
    assert len(made) == 1 and {r.model for r in found} == set(models) == set(fitted) and sum(r.is_best for r in found) == 1
    assert {r.tp + r.fp + r.fn + r.tn for r in found} == {300}
