"""Tables that change together, and an index kept by deltas: crashes, two writers, small changes, answers."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import live_index, postings, retrieval
from quarry.sources.versioned import Conflict, Versioned

LISTING = "path string, size long, mtime long, hash string, text string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefg", k=r.randint(2, 5))) for _ in range(n))


def listing(spark, texts, mtime=0):
    rows = [(p, len(t or ""), mtime if isinstance(mtime, int) else mtime.get(p, 0), str(hash(t)), t) for p, t in texts.items()]
    return spark.createDataFrame(rows, LISTING).repartition(3)


def answers(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_of_tables(spark, tmp_path):
    tables = Versioned(spark, f"{tmp_path}/t")
    assert tables.version() == 0 and tables.table("a", "x int").count() == 0
    change = tables.begin()
    assert change.append("a", spark.range(3).selectExpr("int(id) AS x")).count() == 3
    change.append("b", spark.range(1).selectExpr("int(id) AS x"))
    assert tables.version() == 0 and tables.table("a", "x int").count() == 0
    change.facts["n"] = 3
    assert change.commit() == 1
    one, other = tables.begin(), tables.begin()
    one.append("a", spark.range(2).selectExpr("int(id) AS x"))
    other.replace("a", spark.range(9).selectExpr("int(id) AS x"))
    assert one.commit() == 2
    with pytest.raises(Conflict):
        other.commit()
    assert tables.table("a", "x int").count() == 5 and tables.table("a", "x int", 1).count() == 3 and tables.entry(2)["facts"] == {"n": 3}
    assert len(tables.unused()) == 1 and tables.remove_unused() and tables.unused() == [] and tables.table("a", "x int").count() == 5


def test_a_writer_that_stops_leaves_the_old_version(spark, tmp_path, monkeypatch):
    live = live_index.LiveIndex(spark, f"{tmp_path}/i")
    texts = {f"p{k}": words(k, 60) for k in range(20)}
    live.update(listing(spark, texts))
    asked = spark.createDataFrame([(1, words(3, 5)), (2, words(9, 5))], "question_id long, text string")
    before = answers(live.search(asked))

    def broken(*_):
        raise RuntimeError("stopped between documents and passages")

    with monkeypatch.context() as m:
        m.setattr(live_index.passages, "split", broken)
        with pytest.raises(RuntimeError):
            live.update(listing(spark, {**texts, "p1": words(99, 60), "new": "n"}))
    assert live.tables.version() == 1 and live.documents().count() == 20 and answers(live.search(asked)) == before
    assert live.tables.unused()


def test_the_second_of_two_writers_compares_again(spark, tmp_path, monkeypatch):
    live = live_index.LiveIndex(spark, f"{tmp_path}/i")
    texts = {f"p{k}": words(k, 40) for k in range(10)}
    live.update(listing(spark, texts))
    rival, first = live_index.LiveIndex(spark, f"{tmp_path}/i"), []
    count = live_index.LiveIndex._count

    def slow(self, *a):
        if not first:
            first.append(rival.update(listing(spark, {**texts, "rival": "of the rival"})))
        return count(self, *a)

    monkeypatch.setattr(live, "_count", lambda *a: slow(live, *a))
    with pytest.raises(Conflict):
        live.update(listing(spark, {**texts, "mine": "of mine"}), attempts=1)
    got = live.update(listing(spark, {**texts, "mine": "of mine"}))
    assert got["added"] == 1 and got["removed"] == 1
    assert {r["path"] for r in live.documents().collect()} == {*texts, "mine"}


def test_deltas_answer_as_an_index_built_anew(spark, tmp_path, monkeypatch):
    live = live_index.LiveIndex(spark, f"{tmp_path}/i", tokens=50, merge_after=3)
    texts = {f"d/p{k}#1": "\n\n".join(words(k * 10 + j, 40) for j in range(6)) for k in range(100)}
    live.update(listing(spark, texts))
    asked = spark.createDataFrame([(k, words(k * 10, 6)) for k in range(8)], "question_id long, text string")
    seen = []
    embed = live.embedder
    live.embedder = lambda df, key: seen.append(df.count()) or embed(df, key)
    for turn in range(5):
        changed = random.Random(turn).sample(sorted(texts), 1)
        texts |= {p: words(1000 + turn, 80) for p in changed} | {f"new{turn}": words(2000 + turn, 80), "none": None if turn % 2 else " "}
        texts.pop(f"d/p{turn}#1", None)
        seen.clear()
        got = live.update(listing(spark, texts, {"d/p50#1": turn}))
        # only the passages of what changed are embedded
        assert seen[0] <= 8 and got["removed"] <= 1, (seen, got)
        fresh = live_index.LiveIndex(spark, f"{tmp_path}/f{turn}", tokens=50)
        fresh.update(listing(spark, texts, {"d/p50#1": turn}))
        assert answers(live.search(asked, top_k=8)) == answers(fresh.search(asked, top_k=8))
        facts = [x.tables.entry(x.tables.version())["facts"] for x in (live, fresh)]
        assert facts[0] == facts[1] and live.passages().count() == facts[0]["n_texts"]
    assert len(live.tables.entry(live.tables.version())["tables"]["passages"]) <= 3
    version = live.tables.version()
    assert live.update(listing(spark, texts, {"d/p50#1": 4}))["added"] <= 1 and live.tables.version() - version <= 1


def plain_bm25(texts, question, k):
    import math
    import re

    own = {key: re.findall(r"\w+", t) for key, t in texts}
    mean, scores = sum(map(len, own.values())) / len(own), {}
    for p in dict.fromkeys(re.sub("^(.{4,})s$", r"\1", w) for w in question.split() if len(w) > 2):
        tf = {key: sum(w.startswith(p) for w in ws) for key, ws in own.items()}
        n = sum(x > 0 for x in tf.values())
        for key, x in tf.items():
            if x:
                idf = max(math.log((len(own) - n + 0.5) / (n + 0.5)), 1e-6)
                scores[key] = scores.get(key, 0) + idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(own[key]) / mean))
    return sorted(((round(s, 6), key) for key, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]


@pytest.mark.parametrize("block_texts", [1, 7, 128, 10_000])
def test_pruned_blocks_change_no_result(spark, monkeypatch, block_texts):
    monkeypatch.setattr(postings, "BLOCK_TEXTS", block_texts)
    texts = [(f"k{k}", words(k, 30)) for k in range(150)] + [("empty", ""), ("none", None)]
    df = spark.createDataFrame([(k, t, "s") for k, t in texts], "key string, text string, source string").repartition(4)
    asked = [(q, words(500 + q, 7)) for q in range(9)] + [(9, "the"), (10, "zzzzzz")]
    got = retrieval.keyword(df, spark.createDataFrame(asked, "question_id long, text string"), 6).collect()
    expected = [(q, key, s, n) for q, t in asked for n, (s, key) in enumerate(plain_bm25([(k, t or "") for k, t in texts], t, 6))]
    assert sorted((r["question_id"], r["key"], r["score"], r["place"]) for r in got) == sorted(expected)
    some = df.filter("key < 'k5'")
    kept = retrieval.keyword(df, spark.createDataFrame(asked, "question_id long, text string"), 6, keep=F.col("key") < "k5").collect()
    assert kept and {r["key"] for r in kept} <= {r["key"] for r in some.collect()}


def test_blocks_out_of_reach_are_not_read(spark, monkeypatch):
    """Of texts whose rare words stand together, most blocks are left unread."""
    monkeypatch.setattr(postings, "BLOCK_TEXTS", 10)
    texts = [(k, f"common words here number{k // 10}") for k in range(1000)]
    df = spark.createDataFrame(texts, "key long, text string").repartition(4)
    index = postings.build(df)
    seen = []
    whole = postings.scored

    def counted(blocks, *a):
        seen.append(blocks.count())
        return whole(blocks, *a)

    monkeypatch.setattr(postings, "scored", counted)
    best = postings.search(index, spark.createDataFrame([(1, "common number42 words")], "question_id long, text string"), 5).collect()
    assert len(best) >= 5 and {r["key"] // 10 for r in sorted(best, key=lambda r: -r["score"])[:5]} == {42}
    assert seen[1] < seen[0] / 3, seen


def test_prefixes_are_ranges_of_the_dictionary(spark):
    terms = sorted({words(k, 1) for k in range(400)} | {"a", "ab", "abé", "é", "z", "𐐷x"})
    df = spark.createDataFrame([(t,) for t in terms], "term string").repartitionByRange(5, "term").sortWithinPartitions("term")
    prefixes = sorted({"a", "ab", "abé", "é", "zz", "b", "gfe", "𐐷"})
    got = sorted((r["term"], r["prefix"]) for r in postings.lookup(df, prefixes).collect())
    assert got == sorted((t, k) for t in terms for k, p in enumerate(prefixes) if t.startswith(p))
    plan = postings.lookup(postings.dictionary(df), ["a"])._jdf.queryExecution().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan


def test_questions_in_blocks(spark, monkeypatch):
    texts = [(k, words(k, 30), "s") for k in range(60)]
    df = spark.createDataFrame(texts, "key long, text string, source string").repartition(3)
    asked = spark.createDataFrame([(q, words(700 + q, 6)) for q in range(11)], "question_id long, text string")
    whole = answers(retrieval.hybrid(df, asked))
    monkeypatch.setattr(retrieval, "BROADCAST_QUESTIONS", 3)
    assert answers(retrieval.hybrid(df, asked)) == whole
