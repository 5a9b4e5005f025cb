"""The skew-safe building blocks against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewire.operators import rules, scale


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # a third of the rows share one value
    return [(i, rng.choice(["hot", f"k{rng.randint(0, 40)}", f"k{rng.randint(0, 40)}"]), float(rng.randint(0, 50))) for i in range(900)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, v double").repartition(5)


def test_global_row_number_is_the_sorted_position(table, rows):
    got = {r.id: r.rn for r in scale.global_row_number(table, [F.desc("v"), F.asc("id")], blocks=7).collect()}
    want = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(want)}


def test_global_running_matches_cumsum(table, rows):
    out = scale.global_running(table, [F.col("v"), F.col("id")], {"acc": "v"}, blocks=3)
    got = {r.id: r.acc for r in out.collect()}
    total = 0.0
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        total += r[2]
        assert got[r[0]] == pytest.approx(total)


@pytest.mark.parametrize("probs", [[0.0, 0.1, 0.5, 0.9, 1.0], [0.333, 0.6667]])
def test_exact_quantiles(table, rows, probs):
    got = {r.prob: r.value for r in scale.exact_quantiles(table, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile([r[2] for r in rows], p))


def test_exact_quantiles_single_row_and_empty(spark):
    one = spark.createDataFrame([(3.0,), (None,)], "v double")
    assert [r.value for r in scale.exact_quantiles(one, "v", [0.25]).collect()] == [3.0]
    assert scale.exact_quantiles(one.where("v > 9"), "v", [0.5]).collect() == []


def test_approx_quantiles_shape(table):
    assert [r.prob for r in scale.approx_quantiles(table, "v", [0.1, 0.5]).orderBy("prob").collect()] == [0.1, 0.5]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_dim_join_gives_the_same_beyond_the_broadcast_bound(spark, table, how):
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("k99", 4)], "k string, d int")
    small = scale.dim_join(table, dim, ["k"], how).collect()
    large = scale.dim_join(table, dim, ["k"], how, max_rows=1).collect()
    assert sorted(map(str, (r.asDict().items() for r in small))) == sorted(map(str, (r.asDict().items() for r in large)))
    assert small


def test_first_per_key(table, rows):
    got = {r.k: r.id for r in scale.first_per_key(table, ["k"], [F.col("v"), F.col("id")]).collect()}
    last = {r.k: r.id for r in scale.first_per_key(table, ["k"], [F.col("v"), F.col("id")], last=True).collect()}
    for k in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        assert (got[k], last[k]) == (mine[0][0], mine[-1][0])


def test_input_partitioning_does_not_change_results(table):
    a = scale.global_row_number(table.repartition(1), [F.col("v"), F.col("id")], blocks=4).orderBy("id").collect()
    b = scale.global_row_number(table.repartition(9), [F.col("v"), F.col("id")], blocks=6).orderBy("id").collect()
    assert [(r.id, r.rn) for r in a] == [(r.id, r.rn) for r in b]


@pytest.mark.parametrize("max_rows", [scale.BROADCAST_ROWS, 0])
def test_fan_out_uses_all_tasks(spark, max_rows):
    few = spark.range(200).select("id", F.concat(F.lit("k"), (F.col("id") % 2).cast("string")).alias("k"))
    few = few.groupBy("id", "k").count()  # small enough to be read by one task
    dim = spark.range(60).select(F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("k"), "id").withColumnRenamed("id", "t")
    out = scale.fan_out(few, dim, ["k"], max_rows)
    parts = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 200 * 20 and len(parts) == 4
    assert out.columns == ["k", "id", "count", "t"]
    assert sorted((r.id, r.t) for r in out.collect()) == sorted((i, t) for i in range(200) for t in range(60) if t % 3 == i % 2)


def test_hits_are_dealt_before_the_fan_out(spark):
    hits = spark.range(400).coalesce(1).select(F.col("id").alias("article_id"), F.lit("tech").alias("sector"))
    places = spark.range(10).select(F.lit("tech").alias("sector"), F.col("id").cast("string").alias("ticker"))
    parts = rules.sector_fanout(hits, places).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 4000 and len(parts) == 4
