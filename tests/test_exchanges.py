"""Searches exchange what they find, not the texts or their words."""

from pyspark.sql import functions as F

from quarry import tables
from quarry.operators import postings, retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_where_texts_are_read(spark):
    df = spark.createDataFrame([(1, "Été the  the, of"), (2, None), (3, "")], "key long, text string")
    found = postings.postings(df, F.col("key") < 2)
    assert "Exchange" not in plan(found)
    rows = {r["key"]: (r["kept"], r["size"], sorted(zip(r["terms"], r["tf"], strict=True))) for r in found.collect()}
    assert rows == {1: (True, 4, [("ete", 1), ("of", 1), ("the", 2)]), 2: (False, 0, []), 3: (False, 0, [])}
    index = postings.build(df)
    assert (index.n_texts, index.n_words) == (3, 4)
    blocks = postings.gathered(index, ["e", "et", "the", "zz"])
    assert "Exchange" not in plan(blocks)
    row = [r for r in blocks.collect()][0]
    assert (row["keys"], row["prefix"], row["n"], row["tf"]) == ([1], [0, 1, 2], [1, 1, 1], [1, 1, 2])


def test_only_texts_of_a_ranking_are_joined(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "key long, text string")
    ranking = spark.createDataFrame([(q, k) for q in (1, 2) for k in (3, 4, 99)], "question_id long, key long")
    found = tables.with_texts(ranking, texts)
    assert "BroadcastHashJoin [key" in plan(found) and "LeftSemi" in plan(found)
    expected = [(q, k, f"t{k}") for q in (1, 2) for k in (3, 4)]
    get = lambda df: sorted((r["question_id"], r["key"], r["text"]) for r in df.collect())
    assert get(found) == expected
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 1)
    assert get(tables.with_texts(ranking, texts)) == expected
    assert retrieval.keyword(texts, spark.createDataFrame([(1, "t3x t30")], "question_id long, text string")).count() == 1
