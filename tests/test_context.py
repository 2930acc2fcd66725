"""Excerpts, several context providers, exports, vectors as bytes, cascades."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import messages, providers, retrieval
from quarry.plans import catalogue
from quarry.sources import export


def plain_excerpt(text, query, n=10):
    """Every window of n words compared."""
    words = text.split()
    wanted = list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))
    found = [{k for k, x in enumerate(wanted) if re.sub(r"^[\W_]+", "", w.lower()).startswith(x)} for w in words]
    best = None
    for i in range(len(words)):
        if not found[i]:
            continue
        inside, seen, last = found[i : i + n], set(), i
        for j, own in enumerate(inside):
            if own - seen:
                seen, last = seen | own, i + j
        key = (-len(seen), last - i, i)
        best = min(best, key) if best else key
    first = max(0, min(best[2], len(words) - n))
    return ("…" if first else "") + " ".join(words[first : first + n]) + ("…" if first + n < len(words) else "")


@pytest.mark.parametrize("query", ["ab", "ab cd", "a b c d", "dd _cc- AB", "ab ab"])
def test_excerpts_against_every_window(spark, query):
    r = random.Random(5)
    texts = [" ".join(r.choices(["ab", "abc,", "(cd", "CDx", "dd", "x", "yy", "zzz", "b", "a", "c"], weights=[1, 1, 1, 1, 1, 9, 9, 9, 1, 1, 1], k=r.randint(1, 60))) + " ab cd dd cc b" * (k % 2) + " ab dd cc b a c d" for k in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r["k"]: r["e"] for r in df.select("k", messages.excerpt(F.col("text"), query).alias("e")).collect()}
    assert got == {k: plain_excerpt(t, query) for k, t in enumerate(texts)}


def test_a_provider_that_fails_leaves_the_others(spark):
    texts = spark.createDataFrame([(k, f"s{k}", t) for k, t in enumerate(["red apple pie", "green apple", "red car", "apple apple apple red"])], "key long, source string, text string")
    asked = spark.createDataFrame([(1, "red apple"), (2, "car"), (3, "nothing")], "question_id long, text string")

    class Broken:
        name = "broken"

        def provide(self, questions):
            raise ConnectionError("no answer")

    class Late(Broken):
        name = "late"

        def provide(self, questions):
            return providers.Words(texts, "x").provide(questions).withColumn("text", F.raise_error(F.lit("while it ran")))

    class Fixed(Broken):
        name = "fixed"

        def provide(self, questions):
            return questions.select("question_id", F.lit(0).alias("place"), F.lit("k").alias("key"), F.lit("file").alias("label"), F.lit("of the other").alias("text"))

    rows, errors = providers.gather([Broken(), providers.Words(texts, "words"), Late(), Fixed(), providers.Nothing()], asked, top_k=3)
    got = {}
    for r in rows.orderBy("question_id", "number").collect():
        got.setdefault(r["question_id"], []).append((r["number"], r["key"]))
    assert set(errors) == {"broken", "late"} and "no answer" in errors["broken"]
    assert [n for n, _ in got[1]] == [1, 2, 3] and got[1][1] == (2, "fixed/k") and got[1][0][1].startswith("words/")
    assert got[2] == [(1, "words/2"), (2, "fixed/k")] and got[3] == [(1, "fixed/k")]
    small, _ = providers.gather([providers.Words(texts, "words"), Fixed()], asked, budget=3)
    assert {(r["question_id"], r["key"]) for r in small.collect()} >= {(3, "fixed/k")} and all(r["tokens"] <= 3 for r in small.collect())
    none, errors = providers.gather([Broken()], asked)
    assert none.count() == 0 and errors


def test_exports_take_no_file_away(spark, tmp_path):
    (tmp_path / "a.md").write_text("old")
    (tmp_path / "a-2.md").write_text("old too")
    rows = [("a", "one"), ("a", "two"), ("b.txt", "three"), (None, "four"), ("no/such/folder.md", "five"), ("c", None)]
    got = export.write_new(spark.createDataFrame(rows, "name string, body string").repartition(3), str(tmp_path)).collect()
    assert len(got) == 6 and [r["error"] is None for r in got].count(False) == 1
    assert (tmp_path / "a.md").read_text() == "old" and (tmp_path / "a-2.md").read_text() == "old too"
    assert {(tmp_path / "a-3.md").read_text(), (tmp_path / "a-4.md").read_text()} == {"one", "two"}
    assert (tmp_path / "b.txt").read_text() == "three" and (tmp_path / "conversation.md").read_text() == "four" and (tmp_path / "c.md").read_text() == ""
    for n in range(1, export.MOST + 1):
        (tmp_path / export.named("full", n)).touch()
    assert export.create(str(tmp_path), "full", "x") == (None, f"{tmp_path}/full : {export.TOO_MANY}")


def test_vectors_as_bytes(spark):
    df = spark.createDataFrame([(1, [1.0, -2.5]), (2, []), (3, None)], "k int, v array<double>")
    raw = {r["k"]: r["b"] for r in df.select("k", retrieval.vector_bytes(F.col("v")).alias("b")).collect()}
    assert raw == {1: bytes.fromhex("0000803f000020c0"), 2: b"", 3: None}
    back = spark.createDataFrame([(1, raw[1] + b"\x01\x02\x03"), (2, b"\x01"), (3, None)], "k int, b binary").select("k", retrieval.vector_of(F.col("b")).alias("v"))
    assert {r["k"]: r["v"] for r in back.collect()} == {1: [1.0, -2.5], 2: [], 3: None}


def test_a_collection_goes_everywhere(spark):
    collections = spark.createDataFrame([("a",), ("b",)], "name string")
    documents = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "collection string, path string")
    chunks = documents.withColumn("ordinal", F.lit(0))
    talks = spark.createDataFrame([(1, "a,b"), (2, "b"), (3, None)], "conv_id long, collections string")
    left = [sorted(map(tuple, t.collect()), key=repr) for t in messages.delete_collection("b", collections, documents, chunks, talks)]
    assert left == [[("a",)], [("a", "x")], [("a", "x", 0)], [(1, "a"), (2, None), (3, None)]]
    turns = spark.createDataFrame([(c, t) for c in (1, 2) for t in range(4)], "conv_id long, turn long")
    marks = spark.createDataFrame([(1, 1), (1, 2), (3, 0)], "conv_id long, turn long")
    assert sorted(map(tuple, messages.after(turns, marks).collect())) == [(1, 3)] and sorted(map(tuple, messages.before(turns, marks).collect())) == [(1, 0)]


def test_targets_in_all_shapes(spark):
    from quarry.operators import store

    shapes = {
        " o/n ": ("o/n", None, None), "https://hub.example/o/n/resolve/main/m.gguf?download=true#x": ("o/n", "main", "m.gguf"), "hub.example/o/n/tree/v1/": ("o/n", "v1", None),
        "o/n/tree": ("o/n", None, None), "o/n/issues/1": None, "https://other.example/o/n": None, "o": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in shapes], "t string").select("t", store.parsed_target(F.col("t"), ("hub.example",)).alias("x"))
    assert {r["t"]: tuple(r["x"]) if r["x"] else None for r in df.collect()} == shapes


def test_the_search_tool_answers_every_question(spark, tmp_path):
    texts = ["red apple pie", "green apple", "red car", "blue sky over a lake"]
    documents = [(k, t, "en", "s") for k, t in enumerate(texts)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "apple"), (2, "car"), (3, "sky"), (4, "nothing")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["question_id"]: r["output"] for r in catalogue.QUERIES["q_search_tool"](spark, str(tmp_path)).collect()}
    assert "apple pie" in got[1] and "green apple" in got[1] and got[2] == "[1] s/2.md\nred car" and got[3] == "[1] s/3.md\nblue sky over a lake"
    assert got[4] == retrieval.NOTHING_FOUND


@pytest.mark.parametrize("step", ["keyword", "nearest"])
def test_a_context_whose_provider_failed_is_no_result(spark, monkeypatch, step):
    def broken(*args, **more):
        raise ConnectionError("no answer")

    monkeypatch.setattr(retrieval, step, broken)
    with pytest.raises(RuntimeError, match=f"^{'words' if step == 'keyword' else 'meaning'}: ConnectionError: no answer$"):
        catalogue.QUERIES["q_context_providers"](spark, "/root/testdata/sf0.001")
