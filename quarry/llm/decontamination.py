"""Operator 10, benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows of `window` consecutive words (a shorter item is one window). A window is the set
of its shingles of three consecutive words (fewer if it is shorter). A document contains a window whole only if it
contains every shingle, so with containment 1 the necessary prefix of the window, its shingles ordered by rarity, is
one shingle: the one that is rarest over all documents. Documents emit an occurrence for each of their shingles that
is some window's prefix; an equality join brings both together, the shingle's place in the window gives the positions
that the window would take (bounded by the document's length), and the words are compared exactly.

Shingles are recognised by 64-bit hashes; every hit is verified by its words, so collisions cost time, not results.
What documents look for goes to every task as a bit table of a fixed size (two bits for each shingle); the shingles that
pass it, all that are looked for and few others, meet the shingle table by a join. Documents are read twice, however many
items there are. Equal texts of a batch are parsed once.

Defined results: a null or empty text has no words, as has a null item, which has no window; repeated items and rows
count as given; a null item_id can contaminate but isn't listed; other columns are ignored; without benchmark rows
nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import io
from quarry.llm.text import ALNUM, Ranges, lower_ascii, signed, steps, utf8, words

WINDOW, SHINGLE = 10, 3
#: Bits of the table that goes to every task, and bytes of it that one row carries.
BITS, CHUNK = 1 << 26, 1 << 12


def shingle_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words (the window's, joined by spaces), size, and its shingles as (hash, place)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, offsets = utf8(batch.column("text"))
            data = lower_ascii(data)
            start, end, first = words(data, offsets, ALNUM)
            hashes, raw = Ranges(Ranges(data)(start, end)), data.tobytes()
            ids, rows = batch.column("item_id"), []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                size = min(window, b - a)
                width = min(SHINGLE, size)
                for at in range(a, b - size + 1) if size else ():
                    text = b" ".join(raw[start[j] : end[j]] for j in range(at, at + size)).decode()
                    places = np.arange(at, at + size - width + 1)
                    rows.append((i, text, size, signed(hashes(places, places + width)).tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                ],
                ["item_id", "words", "size", "shingles"],
            )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(
        io.releasing(cut), f"item_id {kind}, words string, size int, shingles array<long>"
    )


def _hashes(batch: pa.RecordBatch, widths: list[int]) -> tuple:
    """The words of a batch, and for each shingle width the hashes and their first words."""
    data, offsets = utf8(batch.column("text"))
    data = lower_ascii(data)
    start, end, first = words(data, offsets, ALNUM)
    chain, last, out = Ranges(Ranges(data)(start, end)), np.repeat(first[1:], np.diff(first)), []
    for width in widths:
        at = np.flatnonzero(np.arange(len(start)) + width <= last)
        out.append((at, signed(chain(at, at + width))))
    return data, start, end, first, out


def _places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    h = values.view(np.uint64)
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)).astype(np.int64)


def _among(values: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The places of the hashes whose bits are set."""
    one, other = _places(values, 8 * len(marks))
    at = np.flatnonzero(marks[one >> 3] >> (one & 7).astype(np.uint8) & 1)
    other = other[at]
    return at[(marks[other >> 3] >> (other & 7).astype(np.uint8) & 1).astype(bool)]


def marks_of(shingles: DataFrame) -> np.ndarray:
    """The bit table of a column of hashes; tasks set bits, and BITS of them reach the driver."""
    bits = BITS
    size = min(CHUNK, bits // 8)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for places in _places(batch.column("shingle").to_numpy(), bits):
                np.bitwise_or.at(table, places >> 3, (1 << (places & 7)).astype(np.uint8))
        chunks = table.reshape(-1, size)
        some = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([chunks[k].tobytes() for k in some], pa.binary())], ["chunk", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                own[k] = own.get(k, 0) | np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([x.tobytes() for x in own.values()], pa.binary())], ["chunk", "bits"])

    parts = shingles.select("shingle").mapInArrow(io.releasing(mark), "chunk long, bits binary").repartition("chunk")
    out = np.zeros((bits // 8 // size, size), np.uint8)
    for r in parts.mapInArrow(io.releasing(unite), "chunk long, bits binary").collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def frequencies(texts: DataFrame, marks: np.ndarray, widths: list[int]) -> DataFrame:
    """How often each marked shingle (and a few others) occurs over all texts; counted in each task first."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            for _, hashes in _hashes(batch, widths)[-1]:
                found, n = np.unique(hashes[_among(hashes, shared.value)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["shingle", "n"])

    return texts.select("text").mapInArrow(io.releasing(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def occurrences(texts: DataFrame, marks: np.ndarray, widths: list[int], reach: int) -> DataFrame:
    """One row per distinct text of a batch: key, n_words, and its marked shingles with the words around (`reach` on either
    side)."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in steps(batches):
            _, first_of = np.unique(np.array(whole.column("key").to_pylist(), object), return_index=True)
            batch = whole.take(pa.array(np.sort(first_of)))
            data, start, end, first, found = _hashes(batch, widths)
            raw, per_row = data.tobytes(), [[] for _ in range(batch.num_rows)]
            for at, hashes in found:
                for j in _among(hashes, shared.value).tolist():
                    word = int(at[j])
                    row = int(np.searchsorted(first, word, "right")) - 1
                    a, b = max(int(first[row]), word - reach), min(int(first[row + 1]), word + reach)
                    around = b" ".join(raw[start[k] : end[k]] for k in range(a, b)).decode()
                    per_row[row].append({"shingle": int(hashes[j]), "word": word - int(first[row]), "left": word - a, "around": around})
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.diff(first)), pa.array(per_row, _FOUND)], ["key", "n_words", "found"]
            )

    return texts.mapInArrow(io.releasing(find), "key string, n_words long, found array<struct<shingle:long,word:long,left:int,around:string>>")


_FOUND = pa.list_(
    pa.struct([("shingle", pa.int64()), ("word", pa.int64()), ("left", pa.int32()), ("around", pa.string())])
)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """key (md5 of the text), spans (array of start and end word) and items (ids) of every text that contains a window."""
    windows = shingle_windows(benchmark, window)
    widths = [int(r["w"]) for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("w")).distinct().collect()]
    texts = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    shingles = windows.select(F.explode("shingles").alias("shingle"))
    rarity = frequencies(texts, marks_of(shingles), widths)
    listed = windows.select("item_id", "words", "size", F.posexplode("shingles").alias("place", "shingle"))
    rank = Window.partitionBy("words").orderBy(F.coalesce("n", F.lit(0)), "shingle", "place")
    prefix = (
        listed.groupBy("words", "size", "place", "shingle")
        .agg(F.collect_set("item_id").alias("item_ids"))
        .join(rarity, "shingle", "left")
        .withColumn("rank", F.row_number().over(rank))
        # a window with a shingle that no document has can't be contained
        .filter("rank = 1 and n > 0")
        .select("shingle", "words", "size", "place", "item_ids")
    )
    prefix = io.checkpointed(prefix)
    # written, as both the hits and the numbers of words are read from it
    found = io.written(occurrences(texts, marks_of(prefix), widths, window))
    around = F.split("around", " ")
    hits = (
        found.filter(F.size("found") > 0)
        .select("key", "n_words", F.inline("found"))
        .join(prefix, "shingle")
        # positional and length bounds
        .filter("word >= place and word - place + size <= n_words and left >= place")
        .filter(F.array_join(F.slice(around, F.col("left") - F.col("place") + 1, F.col("size")), " ") == F.col("words"))
        .select("key", F.struct((F.col("word") - F.col("place")).alias("a"), (F.col("word") - F.col("place") + F.col("size")).alias("b")).alias("span"), "item_ids")
    )
    return found, hits.groupBy("key").agg(
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"),
    )


def _union(spans):
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"),
            F.greatest(s["end"], x["b"]).alias("end"),
        ),
        lambda s: s["n"],
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = io.table(spark, sf_dir, "documents")
    return report(docs, io.table(spark, sf_dir, "benchmark"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document."""
    found, hits = decontaminate(docs, benchmark)
    counts = found.select("key", "n_words").dropDuplicates(["key"])
    judged = counts.join(hits, "key", "left").select(
        F.col("key").alias("text_key"),
        "n_words",
        F.coalesce(_union(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.transform(F.coalesce("items", F.array()), lambda x: x.cast("string"))).alias("names"),
    )
    return (
        docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
        .join(judged, F.col("key") == F.col("text_key"))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("names").cast("long").alias("n_items"),
            F.sha2(F.array_join("names", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no window, all columns as they are."""
    _, hits = decontaminate(docs, benchmark)
    # the row as one column, so that its names can't clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    return rows.join(hits.select("key"), "key", "left_anti").select("row.*")


ORACLE_SQL = r"""
WITH b AS (SELECT row_number() OVER () AS n, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
items AS (SELECT DISTINCT item_id, size, words FROM win),
d AS (SELECT row_number() OVER () AS n, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
dw AS (SELECT n, i, size, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM d, (SELECT DISTINCT size FROM items) WHERE len(w) >= size)),
hit AS (SELECT dw.n, dw.i, dw.size, items.item_id FROM dw JOIN items ON dw.words = items.words AND dw.size = items.size),
covered AS (SELECT n, count(DISTINCT k) AS n_hit
  FROM (SELECT n, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT n, i, size FROM hit)) GROUP BY n),
named AS (SELECT n, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS name FROM hit WHERE item_id IS NOT NULL) GROUP BY n)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.names, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.n = c.n LEFT JOIN named m ON d.n = m.n
"""
