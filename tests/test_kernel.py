import math
import random

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tapewire.plans import model, refresh
from tapewire.plans.kernel import RandomFourierFeatures, kernel_svc


def rings(spark, n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        r, a = (1.0 if i % 2 else 3.0) + rng.gauss(0, 0.15), rng.uniform(0, 2 * math.pi)
        rows.append((r * math.cos(a), r * math.sin(a), float(i % 2), 1.0))
    return spark.createDataFrame(rows, "x double, y double, label double, weight double")


def accuracy(model, df):
    return model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def test_two_rings(spark, tmp_path):
    df = rings(spark)
    vector = VectorAssembler(inputCols=["x", "y"], outputCol="features")
    curved = Pipeline(stages=[vector, kernel_svc(2, "label", features=100, steps=30)]).fit(df)
    straight = Pipeline(stages=[vector, LinearSVC(maxIter=30)]).fit(df)
    assert accuracy(curved, df) > 0.97 and accuracy(straight, df) < 0.7
    curved.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    side = lambda m: [r.p for r in m.transform(df).select(vector_to_array("rawPrediction")[1].alias("p")).collect()]
    assert np.allclose(side(loaded), side(curved))


def test_features_approach_the_kernel(spark):
    points = [[0.0, 0.0, 0.0], [0.5, -0.2, 0.1], [2.0, 1.0, -1.0]]
    df = spark.createDataFrame([(Vectors.dense(p),) for p in points], ["features"])
    z = np.array([r.k for r in RandomFourierFeatures(3, 4000, 0.5).transform(df).select(vector_to_array("kernel").alias("k")).collect()])
    p = np.array(points)
    want = np.exp(-0.5 * ((p[:, None] - p[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.06


def test_refresh_counts_and_times_its_steps(spark, tmp_path):
    tables = {"a": spark.range(7).repartition(3), "b": spark.range(0)}
    written, steps = refresh.run_refresh(tables, str(tmp_path))
    assert [(r.step, r.rows) for r in steps.collect()] == [("a", 7), ("b", 0)] and steps.where("seconds <= 0").count() == 0
    assert written["a"].count() == 7


def test_scores_are_dealt_evenly_and_equal_the_members_own(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.random() < 0.2), rng.random() if i % 3 else 0.0, float(i % 2)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double").coalesce(1)
    plan = model.Plan(model.Forest(3, 3, 2), model.Boost(1, 2, 0.1), model.Boost(1, 2, 0.1))
    absent = ("c", "d", "e")  # zeros, so that assembled vectors are sparse
    ensemble = model.train_ensemble(df, plan, ("a", "b", *absent), "y")
    scored = ensemble.score(df)
    parts = scored.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sorted(r["count"] for r in parts) == [60] * 4
    filled = df.withColumns({c: F.lit(0.0) for c in absent})
    for member, fitted in ensemble.members.items():
        own = {r.id: r.probability[1] for r in fitted.transform(filled).select("id", "probability").collect()}
        got = {r.id: r.probability for r in model.probability_up(fitted, df, ensemble.features).collect()}
        assert got == own, member
