"""What is held and exchanged stays bounded as tables grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import markup
from quarry.operators import clusters, passages, postings, retrieval
from quarry.sources import office

TEXTS = "key long, text string"


def test_nearest_with_many_questions(spark, monkeypatch):
    """Scores are held for some questions at a time; ties and lengths as before."""
    monkeypatch.setattr(retrieval, "QUESTIONS_AT_ONCE", 3)
    r = np.random.default_rng(1)
    rows = [(k, r.integers(-2, 3, 2 + k % 2).astype(float).tolist()) for k in range(90)]
    vectors = spark.createDataFrame([*rows, (99, None)], "key long, vector array<double>").repartition(3)
    asked = spark.createDataFrame(rows[:20], "question_id long, question_vector array<double>")
    got = sorted((x["question_id"], x["place"], x["key"], x["score"]) for x in retrieval.nearest(vectors, asked, 5).collect())
    own = {q: sorted((-float(np.dot(a, b)), k) for k, b in rows if len(a) == len(b))[:5] for q, a in rows[:20]}
    assert got == [(q, place, k, -s) for q in sorted(own) for place, (s, k) in enumerate(own[q])]
    even = vectors.filter(F.size("vector") == 2)
    some = asked.filter(F.size("question_vector") == 2)
    best = clusters.nearest(clusters.build(even), some, 5)[0].collect()
    assert sorted((x["question_id"], x["place"], x["key"], x["score"]) for x in best) == [x for x in got if x[0] % 2 == 0]


@pytest.mark.parametrize(
    "step",
    [
        lambda df: office.extract(df.select(F.lit("a.txt").alias("path"), F.col("text").cast("binary").alias("content"))),
        lambda df: df.select(markup.html_to_text(F.col("text"))),
        lambda df: df.select(markup.code_blocks(F.col("text"))),
        lambda df: passages.split(df),
        lambda df: retrieval.hash_vectors(df, "key"),
        lambda df: postings.postings(df),
        lambda df: retrieval.nearest(df.select("key", F.array(F.lit(1.0)).alias("vector")), df.select(F.col("key").alias("question_id"), F.array(F.lit(1.0)).alias("question_vector"))),
    ],
    ids="office html code passages hash postings nearest".split(),
)
def test_python_gets_small_batches(spark, step):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    df = spark.createDataFrame([(1, "one two"), (2, "three")], TEXTS)
    assert step(df).count() == 2 or step(df).count() == 4
    assert int(spark.conf.get(name)) == tables.ARROW_BYTES
