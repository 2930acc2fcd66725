"""Hybrid retrieval: vector similarity and keyword search for a set of questions, fused, limited to a token budget.

A set of questions is a parameter of a search: up to `BROADCAST_QUESTIONS` of them go to every task, more are taken in
blocks of that size. Everything that grows with the corpus is partitioned: texts are tokenised once into postings, which
are written (`postings`); each task keeps its own `k` nearest vectors and best texts of a question, and rankings are limited
before the exchange (the filter on `row_number` lets Spark do that).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import columns as C
from quarry.operators import postings

#: Candidates of each ranking, the constant of rank fusion, dimensions of the hash embedder.
CANDIDATES, FUSION, DIMENSIONS = 50, 60, 64
BROADCAST_QUESTIONS = 10_000
#: Questions whose scores with a batch of vectors are held at a time.
QUESTIONS_AT_ONCE = 128
#: Fixed value: what a search without results says.
NOTHING_FOUND = "Aucun passage ne correspond à cette recherche."

#: (texts, name of the key column) -> key and vector; an embedding model enters as such a function.
Embedder = Callable[[DataFrame, str], DataFrame]
#: (question_id, question, key, text) -> the same with a score; a reranking model enters as such a function.
Reranker = Callable[[DataFrame], DataFrame]


def buckets(column: pa.Array) -> np.ndarray:
    """FNV-1a of each word's UTF-8 bytes modulo 64: the low six bits follow from low six bits alone."""
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size, h = np.diff(ends), np.full(len(column), 37, np.int64)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        h[at] = ((h[at] ^ (data[ends[at] + k] & 63)) * 51) & 63
    return h


def hash_vectors(texts: DataFrame, key: str) -> DataFrame:
    """key and vector (unit length, zero without words): counts of hashed words longer than two characters.

    Words are split in the JVM and hashed a batch at a time, without a shuffle.
    """
    long = F.filter(C.words(F.lower(F.coalesce("text", F.lit("")))), lambda w: F.length(w) > 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            n, sizes = batch.num_rows, np.asarray(lists.value_lengths()).astype(np.int64)
            at = np.repeat(np.arange(n), sizes) * DIMENSIONS + buckets(lists.flatten())
            counts = np.bincount(at, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(float)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            vectors = counts / np.where(norm > 0, norm, 1)
            ends = pa.array(np.arange(n + 1) * DIMENSIONS, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], [key, "vector"])

    kind = texts.schema[key].dataType.simpleString()
    tables.small_batches(texts.sparkSession)
    return texts.select(key, long.alias("words")).mapInArrow(run, f"{key} {kind}, vector array<double>")


def vector_bytes(vector: Column) -> Column:
    """A vector as 32-bit floats, least byte first."""

    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in column:
            yield part.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")

    return F.pandas_udf(run, "binary")(vector.cast("array<float>"))


def vector_of(raw: Column) -> Column:
    """The vector of such bytes; bytes at the end that make no float are dropped."""

    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in column:
            yield part.map(lambda b: np.frombuffer(bytes(b)[: len(b) // 4 * 4], "<f4").astype(np.float32), na_action="ignore")

    return F.pandas_udf(run, "array<float>")(raw)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores; equal scores in order of key."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((keys[some], -scores[some]))][:k]


def nearest(vectors: DataFrame, questions: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """question_id, key, score and place (from 0) of the k nearest vectors; equal scores in order of key.

    `vectors`: key, vector; `questions`: question_id, question_vector. Vectors of another length are ignored. Each batch
    of vectors is multiplied by a block of questions, and a task keeps the k best of each question.
    """
    kind, key_kind = questions.schema["question_id"].dataType.simpleString(), vectors.schema["key"].dataType.simpleString()
    tables.small_batches(vectors.sparkSession)

    def block(part: DataFrame) -> DataFrame:
        asked = part.collect()  # a block of questions, BROADCAST_QUESTIONS at most
        ids = [r["question_id"] for r in asked]
        shared = vectors.sparkSession.sparkContext.broadcast([np.array(r["question_vector"], float) for r in asked])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(shared.value):
                by_size.setdefault(len(v), []).append(i)
            # so many questions at once that the scores of a batch stay small, however many there are
            parts = [(size, own[k : k + QUESTIONS_AT_ONCE]) for size, own in by_size.items() for k in range(0, len(own), QUESTIONS_AT_ONCE)]
            asked_of = [np.array([shared.value[i] for i in mine]).T for _, mine in parts]
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                sizes = np.asarray(batch.column("vector").value_lengths().fill_null(-1))
                of_size = {}
                for size in by_size:
                    rows = np.flatnonzero(sizes == size)
                    if len(rows):
                        take = pa.array(rows)
                        keys = batch.column("key").take(take).to_numpy(zero_copy_only=False)
                        matrix = batch.column("vector").take(take).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)
                        of_size[size] = (keys, matrix)
                for (size, mine), asked in zip(parts, asked_of, strict=True):
                    if size not in of_size:
                        continue
                    keys, matrix = of_size[size]
                    scores = np.round(matrix @ asked, 9)
                    for column, i in enumerate(mine):
                        own = _best(scores[:, column], keys, k)
                        found = (scores[own, column], keys[own])
                        if i in held:
                            found = tuple(np.concatenate(x) for x in zip(held[i], found, strict=True))
                            again = _best(*found, k)
                            found = (found[0][again], found[1][again])
                        held[i] = found
            for i, (scores, keys) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), i)), pa.array(keys), pa.array(scores)], ["question", "key", "score"]
                )

        found = vectors.select("key", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(
            run, f"question long, key {key_kind}, score double"
        )
        order = Window.partitionBy("question").orderBy(F.desc("score"), "key")
        named = vectors.sparkSession.createDataFrame(list(enumerate(ids)), f"question long, question_id {kind}")
        return (
            found.withColumn("n", F.row_number().over(order))
            .filter(F.col("n") <= k)
            .join(F.broadcast(named), "question")
            .select("question_id", "key", "score", (F.col("n") - 1).alias("place"))
        )

    blocks = max(1, -(-questions.count() // BROADCAST_QUESTIONS))
    if blocks == 1:
        return block(questions)
    share = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
    # one block's questions are held at a time
    return reduce(DataFrame.unionAll, [tables.written(block(questions.filter(share == i))) for i in range(blocks)])


def keyword(texts: DataFrame, questions: DataFrame, k: int = CANDIDATES, keep: Column | None = None, index: postings.Index | None = None) -> DataFrame:
    """question_id, key, score and place (from 0) by BM25; each search term is a prefix.

    `texts`: key, text; `questions`: question_id, text. Statistics are those of all texts; `keep`, a condition on `texts`, is
    applied before the limit, as a choice of collections is. An `index` that is at hand stands for the texts.
    """
    index = index or postings.build(texts, keep)
    blocks = max(1, -(-questions.count() // BROADCAST_QUESTIONS))
    share = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
    if blocks == 1:
        return ranked(postings.search(index, questions, k), k)
    # one block's questions are held at a time
    parts = [tables.written(postings.search(index, questions.filter(share == i), k)) for i in range(blocks)]
    return ranked(reduce(DataFrame.unionAll, parts), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The first k of each question by score, then key, with their place from 0."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "key")
    return (
        scored.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= k)
        .select("question_id", "key", "score", (F.col("n") - 1).alias("place"))
    )


def fuse(meaning: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Reciprocal rank fusion of two rankings (question_id, key, score, place): question_id, key, score."""
    m = meaning.filter(F.col("score") >= least).select("question_id", "key", F.col("place").alias("m"))
    w = words.select("question_id", "key", F.col("place").alias("w"))
    part = lambda c: F.coalesce(1 / (F.col(c) + FUSION + 1), F.lit(0.0))
    return m.join(w, ["question_id", "key"], "full_outer").select(
        "question_id", "key", F.round(part("m") + part("w"), 9).alias("score")
    )


def limit(ranked: DataFrame, top_k: int, budget: int) -> DataFrame:
    """In rank order, up to `top_k` texts of each question: a text already taken or beyond the rest of the budget is skipped.

    `ranked`: question_id, key, place, label, text; at most 2 * CANDIDATES rows of each question.
    """
    item = F.struct("place", "key", C.tokens(F.col("text")).alias("tokens"), F.md5("text").alias("digest"), "label")
    kind = f"place:int,key:{ranked.schema['key'].dataType.simpleString()},tokens:bigint,digest:string,label:string"
    empty = F.expr(f"named_struct('left', bigint({budget}), 'taken', cast(array() as array<struct<{kind}>>))")

    def step(state: Column, x: Column) -> Column:
        skip = (
            (F.size(state["taken"]) >= top_k)
            | (x["tokens"] > state["left"])
            | F.exists(state["taken"], lambda t: t["digest"] == x["digest"])
        )
        return F.when(skip, state).otherwise(
            F.struct((state["left"] - x["tokens"]).alias("left"), F.array_append(state["taken"], x).alias("taken"))
        )

    return (
        ranked.groupBy("question_id")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select("question_id", F.posexplode(F.aggregate("items", empty, step)["taken"]).alias("number", "x"))
        .select("question_id", (F.col("number") + 1).cast("long").alias("number"), "x.key", "x.label", "x.tokens")
    )


def word_scores(asked: DataFrame) -> DataFrame:
    """A reranker for tests: how many words of the question (of more than two bytes) the text holds."""
    words = F.array_distinct(F.filter(F.split(F.lower("question"), r"\s+"), lambda w: F.octet_length(w) > 2))
    return asked.withColumn("score", F.size(F.filter(words, lambda w: F.contains(F.lower("text"), w))).cast("double"))


def scores_in_order(items: DataFrame, scores: DataFrame) -> DataFrame:
    """`items` (question_id, number, ...) with the score of their number, minus infinity where none came back.

    `scores`: question_id, number, score. A score for a number that no item has makes the ranking unusable: `valid` is
    false for the whole question then.
    """
    unknown = scores.join(items, ["question_id", "number"], "left_anti").select("question_id").distinct().withColumn("strange", F.lit(True))
    return (
        items.join(scores, ["question_id", "number"], "left")
        .join(unknown, "question_id", "left")
        .withColumn("score", F.coalesce("score", F.lit(float("-inf"))))
        .withColumn("valid", F.col("strange").isNull())
        .drop("strange")
    )


def rerank(candidates: DataFrame, questions: DataFrame, reranker: Reranker = word_scores) -> DataFrame:
    """Candidates (question_id, key, place, text) with hits (the reranker's score) and new_place, ties as they were.

    A question for which the reranker doesn't return one score for each candidate keeps its order.
    """
    asked = candidates.select("question_id", "key", "place", "text").join(questions.select("question_id", F.col("text").alias("question")), "question_id")
    given = reranker(asked).select("question_id", "key", F.col("score").alias("hits"))
    complete = given.filter("hits IS NOT NULL").groupBy("question_id").agg(F.count("*").alias("got"))
    counted = candidates.groupBy("question_id").agg(F.count("*").alias("sent")).join(complete, "question_id", "left")
    usable = counted.select("question_id", (F.col("got") == F.col("sent")).alias("usable"))
    order = Window.partitionBy("question_id").orderBy(F.desc(F.when(F.col("usable"), F.col("hits"))), "place")
    return (
        candidates.join(given, ["question_id", "key"], "left")
        .join(usable, "question_id")
        .withColumn("new_place", F.row_number().over(order) - 1)
        .drop("usable")
    )


def check_models(collections: DataFrame, names: list[str], model: str) -> None:
    """Every named collection exists and was embedded by the model in use. `collections`: name, embedding_model."""
    known = {r["name"]: r["embedding_model"] for r in collections.filter(F.col("name").isin(*names)).collect()}
    for name in names:
        if name not in known:
            raise ValueError(f"unknown collection: {name}")
        if known[name] != model:
            raise ValueError(f"collection {name} was embedded with {known[name]}, not {model}: index it again")


def embedding_text(source: Column, location: Column, text: Column) -> Column:
    """What an embedder reads: `file — location`, a line feed, the text."""
    file = F.regexp_extract(source, "([^/]*)$", 1)
    return F.concat(F.concat_ws(" — ", file, F.nullif(location, F.lit(""))), F.lit("\n"), text)


def hybrid(
    texts: DataFrame,
    questions: DataFrame,
    top_k: int = 5,
    budget: int = 3000,
    least: float = 0.3,
    embedder: Embedder = hash_vectors,
    reranker: Reranker | None = None,
    candidates: int = 20,
    keep: Column | None = None,
    index: postings.Index | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """question_id, number, key, label, tokens: what each question takes from the corpus.

    `texts`: key, source, text (and what `keep`, a choice of collections, asks for); `questions`: question_id, text. With
    a reranker, the `candidates` best of the fused ranking are put in its order before the limits. An `index` and `vectors`
    (key, vector) that are at hand stand for those of the texts; what `keep` would leave out isn't in them then.
    """
    if index is None or vectors is None:
        # read by the postings, the vectors and the answers
        texts = tables.written(texts)
    asked = embedder(questions, "question_id").withColumnRenamed("vector", "question_vector")
    some = texts if keep is None else texts.filter(keep)
    vectors = embedder(some, "key") if vectors is None else vectors
    fused = fuse(nearest(vectors, asked), keyword(texts, questions, keep=keep, index=index), least)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "key")
    # at most 2 * CANDIDATES rows of each question get their text and label, in one join
    chosen = fused.withColumn("place", F.row_number().over(order)).select("question_id", "key", "place")
    found = tables.with_texts(chosen, texts.select("key", "text", F.col("source").alias("label")))
    if reranker is not None:
        wide = found.filter(F.col("place") <= max(candidates, top_k))
        found = rerank(wide, questions, reranker).drop("place", "hits").withColumnRenamed("new_place", "place")
    return limit(found, top_k, budget)


def tool_output(found: DataFrame) -> DataFrame:
    """question_id and the text that the search tool returns: numbered passages, or that there are none.

    `found`: question_id, number, label, text; a question without passages has one row whose number is null.
    """
    block = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("label"), F.lit("\n"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", block.alias("block")))))
    return found.groupBy("question_id").agg(
        F.coalesce(F.nullif(F.array_join(F.transform(rows, lambda x: x["block"]), "\n\n"), F.lit("")), F.lit(NOTHING_FOUND)).alias("output")
    )
