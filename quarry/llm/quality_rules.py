"""Operator 9, quality rules by suffix-array repetition.

Every text is read as a sequence of words. A suffix array over the words of a batch of documents (prefix doubling, in
numpy, documents kept apart) gives the longest common prefix of neighbouring suffixes; each run of suffixes that share
a prefix is an interval of the array and stands for a maximal repeated word sequence. The spans of all such sequences
of at least `min_repeat` words are united; a document is rejected if they cover too large a share of its words or if
the longest of them is too long.

Defined results: a null or empty text has zero words and fails the base rule; a repeated row is judged like the first;
ids may be null and of any type; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import io
from quarry.llm.text import SPACED, Ranges, steps, utf8, words

#: Words that a repeated sequence needs to count, the largest share of a text that such sequences may cover, and the
#: longest that one may be.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 6, 0.3, 60
#: The base rule: fewest words, and words in repeated windows of this many words, as a percentage of all.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30

#: Bytes of text that a task works on at a time.
STEP_BYTES = 1 << 18
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

#: The columns after doc_id, which keeps its type.
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, repeated_share double, longest_repeat long"
)


def longest_repeats(tokens: np.ndarray, first: np.ndarray, least: int = 4) -> np.ndarray:
    """For each word the length of the longest word sequence that starts there and elsewhere in the same document
    (exact from `least` words on, else 0). `first`: the number of each document's first word, and the number of words.

    Prefix doubling: `names` of level j are equal for positions whose next 2**j words are equal, and order them.
    Positions whose name is unique at some level drop out, so mostly unique text costs two or three levels. The longest
    common prefix of neighbours in the suffix array is then read off the levels, from the highest down.
    """
    n = len(tokens)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = first[1:][doc]
    order = np.lexsort((tokens, doc))
    token, owner = tokens[order], doc[order]
    new = np.ones(n, bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    # a name is the place of its group in the order; index n stands for the end of a document
    names = np.zeros(n + 1, np.int64)
    names[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    levels, width = [names], 1
    live = np.sort(order[_shared(new)])
    deep = live if least <= 1 else None
    while len(live):
        after = live + width
        second = names[np.where(after < stop[live], after, n)]
        by = np.lexsort((second, names[live]))
        order, a, b = live[by], names[live[by]], second[by]
        group, fresh = np.ones(len(by), bool), np.ones(len(by), bool)
        group[1:] = a[1:] != a[:-1]
        fresh[1:] = group[1:] | (b[1:] != b[:-1])
        at = np.arange(len(by))
        begin = np.maximum.accumulate(np.where(group, at, 0))
        names = names.copy()
        names[order] = a + np.maximum.accumulate(np.where(fresh, at, 0)) - begin
        levels.append(names)
        live = order[_shared(fresh)]
        width *= 2
        if deep is None and width * 2 > least:
            deep = live
    if deep is None or not len(deep):
        return out
    array = deep[np.argsort(names[deep], kind="stable")]
    same = doc[array[:-1]] == doc[array[1:]]
    left, right = array[:-1][same], array[1:][same]
    x, y, end, shared = left.copy(), right.copy(), stop[left], np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (x < end) & (y < end)
        equal = inside & (levels[level][np.where(inside, x, n)] == levels[level][np.where(inside, y, n)])
        step = equal.astype(np.int64) << level
        x, y, shared = x + step, y + step, shared + step
    np.maximum.at(out, left, shared)
    np.maximum.at(out, right, shared)
    return out


def _shared(new: np.ndarray) -> np.ndarray:
    """Which members of sorted groups have company; `new` marks each group's first."""
    last = np.ones(len(new), bool)
    last[:-1] = new[1:]
    return ~(new & last)


def covered(lengths: np.ndarray, least: int, first: np.ndarray, fixed: int | None = None) -> np.ndarray:
    """Words of each document inside a span of at least `least` words (cut to `fixed` words, if given)."""
    n = len(lengths)
    at = np.flatnonzero(lengths >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (lengths[at] if fixed is None else fixed), -1)
    total = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return total[first[1:]] - total[first[:-1]]


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(
    batches: Iterator[pa.RecordBatch], min_repeat: int, max_covered: float, max_longest: int
) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, limit=STEP_BYTES):
        data, offsets = utf8(batch.column("text"))
        start, end, first = words(data, offsets, SPACED)
        n_words = np.diff(first)
        inside = np.concatenate(([0], np.cumsum(SPACED[data] & ((data & 0xC0) != 0x80))))
        symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
        longest = longest_repeats(Ranges(data)(start, end), first, min(4, min_repeat))
        repeated = covered(longest, WINDOW, first, WINDOW)
        share = covered(longest, min_repeat, first) / np.maximum(n_words, 1)
        # the longest repeat of each document
        top = np.zeros(len(n_words), np.int64)
        np.maximum.at(top, np.repeat(np.arange(len(n_words)), n_words), longest)
        top[top < min_repeat] = 0
        failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
        columns = [
            batch.column("doc_id"),
            n_words,
            inside[offsets[1:]] - inside[offsets[:-1]],
            symbols[offsets[1:]] - symbols[offsets[:-1]],
            np.array([repeated_lines(x) for x in batch.column("text").to_pylist()], np.int64),
            repeated,
            failed,
            ~failed & (share <= max_covered) & (top <= max_longest),
            share,
            top,
        ]
        names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


def quality(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """One row per document with its counts and the verdict; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return measure(batches, min_repeat, max_covered, max_longest)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return io.texts(docs, "doc_id").mapInArrow(io.releasing(run), f"doc_id {kind}, {SCHEMA}")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(io.table(spark, sf_dir, "documents"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns as they are."""
    io.small_batches(docs.sparkSession)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            narrow = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], ["doc_id", "text"])
            for part, verdict in _paired(batch, measure(iter([narrow]), MIN_REPEAT, MAX_COVERED, MAX_LONGEST)):
                yield part.filter(verdict)

    return docs.mapInArrow(io.releasing(run), docs.schema).select(*columns)


def _paired(batch: pa.RecordBatch, measured: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    at = 0
    for part in measured:
        yield batch.slice(at, part.num_rows), part.column("kept")
        at += part.num_rows
