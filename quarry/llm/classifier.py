"""Operator 1, a quality classifier by supervised subword embeddings.

A document is a bag of hashed features: its words, the character n-grams inside them and a token for a word that
repeats the word before it. Each of `BUCKETS` buckets has
a learned vector; a document's vector is the average over its features, and a softmax layer turns it into two class
probabilities. Vectors and layer are trained together by stochastic gradient descent in numpy.

Training takes a bounded sample of labelled rows, `TRAIN_ROWS` documents of each label, chosen by a hash of the id among
rows whose crc32(doc_id as text) mod 3 is not 1. Their whole texts become bags of buckets where they stand, and only the
bags (at most `BUCKETS` counts each) come to the driver; the fitted parameters have a fixed size and go to every task. Scoring
reads each whole text once, without a shuffle. As a softmax over an average is linear in the features, each bucket's
vector is folded into one number for scoring.

Inputs of a score are the text's features only. Defined results: a null or empty text has no features and gets the
score of the layer's bias, which is learned from empty texts and otherwise the class prior; without training rows every
score is 0.5; repeated rows get equal scores; a null doc_id isn't held out and never trains; of documents that share an
id, the least text trains; an id with both labels trains as both; ids may be of any type; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import io
from quarry.llm.text import SPACED, Ranges, steps, utf8, words

BUCKETS, DIMENSIONS = 1 << 17, 8
#: Character n-grams, in bytes, with the blanks around a word.
NGRAMS = (2, 3, 4)
#: The bucket of a word that repeats the word before it.
AGAIN = 0
#: Documents of each label that training takes at most.
TRAIN_ROWS = 1500
EPOCHS, RATE, SEED = 12, 0.5, 20260101


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features, and the row of each."""
    start, end, first = words(data, offsets, SPACED)
    buckets, rows = [], []
    ranges = Ranges(data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if len(start):
        word = ranges(start, end, 1 << 20)
        # a word right after itself is a token of its own besides
        again = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1])) + 1
        buckets += [word % np.uint64(BUCKETS), np.full(len(again), AGAIN, np.uint64)]
        rows += [row, row[again]]
    # where each byte's word (with a blank on either side, inside the row) ends
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in NGRAMS:
        at = np.arange(max(0, len(data) - n + 1))
        if not len(at):
            continue
        one_row = owner[at] == owner[at + n - 1]
        inside = np.concatenate(([0], np.cumsum(SPACED[data])))
        whole = inside[at + n] - inside[at] >= n - 1  # one separator at most
        at = at[one_row & whole]
        buckets.append(ranges(at, at + n, n) % np.uint64(BUCKETS))
        rows.append(owner[at])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(rows)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text and how often each occurs."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return np.unique(features(raw, np.array([0, len(raw)]))[0], return_counts=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
    """One number for each bucket, and the bias: class 1 minus class 0."""
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    if not bags:
        return np.zeros(BUCKETS + 1)
    docs = [(found, count / max(1, count.sum())) for found, count in bags]
    target, steps_ = np.eye(2)[labels], EPOCHS * len(docs)
    # both labels weigh the same
    weight = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))
    for epoch in range(EPOCHS):
        for k, i in enumerate(random.permutation(len(docs))):
            rate = RATE * (1 - (epoch * len(docs) + k) / steps_)
            found, share = docs[i]
            hidden = share @ vectors[found]
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            slope = (p / p.sum() - target[i]) * weight[labels[i]]
            back = layer.T @ slope
            layer -= rate * np.outer(slope, hidden)
            bias -= rate * 0.1 * slope
            # each feature moves in proportion to its share, scaled so that long texts learn like short ones
            vectors[found] -= rate * (share / share.max())[:, None] * back if len(found) else 0
    margin = layer[1] - layer[0]
    return np.append(vectors @ margin, bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """The bags of at most TRAIN_ROWS documents of each label; only rows that aren't held out, chosen by a hash of the id."""
    known = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    chosen = []
    for label in (0, 1):
        ids = known.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
        chosen += [(r["doc_id"], label) for r in ids.limit(TRAIN_ROWS).select("doc_id").collect()]
    if not chosen:
        return [], []
    kind = labels.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(i for i, _ in chosen)], f"chosen_id {kind}")
    # the sample's bound is the broadcast's bound
    rows = io.texts(docs, "doc_id").join(F.broadcast(wanted), F.col("doc_id") == F.col("chosen_id"))
    one = rows.groupBy("chosen_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(x) for x in batch.column("text").to_pylist()]
            lists = [pa.array([list(x[k]) for x in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("chosen_id"), *lists], ["chosen_id", "buckets", "counts"])

    bags = {
        r["chosen_id"]: (np.array(r["buckets"], np.int64), np.array(r["counts"], np.int64))
        for r in one.mapInArrow(run, f"chosen_id {kind}, buckets array<long>, counts array<long>").collect()
    }
    found = sorted((i, label) for i, label in chosen if i in bags)
    return [bags[i] for i, _ in found], [label for _, label in found]


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and the score of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in steps(batches):
            data, offsets = utf8(batch.column("text"))
            buckets, rows = features(data, offsets)
            total = np.bincount(rows, weights=fitted[buckets], minlength=batch.num_rows)
            count = np.bincount(rows, minlength=batch.num_rows)
            margin = np.clip(total / np.maximum(count, 1) + fitted[-1], -500, 500)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-margin)))], ["doc_id", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return io.texts(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(*sample(docs, labels)))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(io.table(spark, sf_dir, "documents"), io.table(spark, sf_dir, "labels"))
