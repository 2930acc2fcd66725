"""Clustered vectors against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import clusters, retrieval


def rows(df):
    return sorted((r["question_id"], r["place"], r["key"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("cluster_rows", [1, 40, 10_000])
def test_the_same_as_all_vectors(spark, monkeypatch, cluster_rows):
    monkeypatch.setattr(clusters, "CLUSTER_ROWS", cluster_rows)
    monkeypatch.setattr(clusters, "MOST_CENTERS", 30)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"))
    df = df.unionByName(df.filter("key < 40").withColumn("key", F.col("key") + 10_000))
    asked = df.filter("key % 50 = 0").select(F.col("key").alias("question_id"), F.col("vector").alias("question_vector"))
    got, share = clusters.nearest(clusters.build(df), asked, 20)
    assert rows(got) == rows(retrieval.nearest(df, asked, 20)) and 0 < share <= 1


def test_far_clusters_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CLUSTER_ROWS", 50)
    r = np.random.default_rng(1)
    centers = r.normal(0, 1, (20, 16))
    data = np.concatenate([c + r.normal(0, 0.02, (100, 16)) for c in centers])
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"k{i:05d}", v.tolist()) for i, v in enumerate(data)], "key string, vector array<double>").repartition(4)
    asked = df.filter("key like '%00'").select(F.col("key").alias("question_id"), F.col("vector").alias("question_vector"))
    index = clusters.build(df)
    got, share = clusters.nearest(index, asked, 10)
    assert rows(got) == rows(retrieval.nearest(df, asked, 10)) and share < 0.35, share
    one = asked.limit(1)
    found = clusters._compared(index, np.array([one.first()["question_vector"]]), [np.array([0])], 10)
    assert "PartitionFilters: [isnotnull(cluster" in found._jdf.queryExecution().toString() or "PartitionFilters: [cluster" in found._jdf.queryExecution().toString()


def test_no_vectors_and_no_questions(spark):
    none = spark.createDataFrame([], "key long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, question_vector array<double>")
    assert clusters.nearest(clusters.build(none), asked)[0].count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "key long, vector array<double>")
    assert clusters.nearest(clusters.build(some), asked.limit(0))[0].count() == 0
    assert [r["key"] for r in clusters.nearest(clusters.build(some), asked, 1)[0].collect()] == [1]
