import os

import pytest
from pyspark.sql import functions as F

from tapewire.sources import identity
from tapewire.sources import store as st


def articles(spark, first, n, day="2024-05-01"):
    rows = spark.range(first, first + n).select(
        F.col("id").alias("article_id"), F.concat(F.lit("title "), "id").alias("title"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("ticker"),
        F.lit(f"{day} 08:00:00").cast("timestamp").alias("scraped_at"),
    )
    return rows.withColumn("event_date", F.to_date("scraped_at"))


def opened(spark, df, path, batch="new"):
    return identity.files_to_open(spark, df.select(*identity.digest(F.struct("title", "url"))), path, batch)


def append(df, path, batch):
    return st.append_events(df, path, batch, identity=["title", "url"])


def size(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def test_new_articles_open_no_stored_keys_however_large_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    read = []
    for k in range(4):
        assert append(articles(spark, 1000 * k, 1000), path, f"b{k}") == 1000
        read.append(len(opened(spark, articles(spark, 100_000, 1000), path)))
    assert max(read) <= 1  # a filter may let a key through wrongly once in 40,000
    # repeats open the files of the batch they repeat, and no others
    files = opened(spark, articles(spark, 1000, 1000), path)
    assert {b for _, b in files if b != "b1"} <= {files[0][1]} and sum(b == "b1" for _, b in files) == identity.BUCKETS
    assert append(articles(spark, 1500, 1000), path, "b1.5") == 0 and append(articles(spark, 3900, 200), path, "b5") == 100
    assert size(f"{path}/_identity/filters") < 40 * 4100


def test_a_repeated_batch_replaces_its_rows_and_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    append(articles(spark, 0, 50), path, "a")
    for _ in range(2):
        assert append(articles(spark, 40, 50), path, "b") == 40
    assert st.read_store(spark, path).count() == 90 and append(articles(spark, 0, 90), path, "c") == 0


def test_a_store_without_an_index_gets_one(spark, tmp_path):
    path = str(tmp_path / "store")
    old = articles(spark, 0, 30).withColumn("batch", F.lit("old"))
    old.write.partitionBy("event_date", "batch").parquet(path)
    assert append(articles(spark, 20, 30), path, "new") == 20
    assert sorted(r.article_id for r in st.read_store(spark, path).collect()) == list(range(50))
    assert {b for _, b in opened(spark, articles(spark, 0, 30), path)} == {"old"}


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, tmp_path, n):
    path = str(tmp_path / "store")
    assert append(articles(spark, 0, n), path, "a") == n and append(articles(spark, 0, 1), path, "b") == 1 - n
