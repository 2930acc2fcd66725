"""Operator 13, fill-in-middle transformation over an index of distinct texts.

Documents with the same text share one index entry. A text's lines (units) end at boundaries, kept as an Elias-Fano list
of code-point positions; that list is made once for the text, however many documents have it. Each document then joins
its text's entry and selects its two seeded cuts from the list.

Equal texts of a batch are grouped by content first, so that a text crosses the network once for each batch with the
ids of its documents. Groups meet by two 64-bit hashes and are told apart by the texts themselves. A text that many
documents share is dealt over `io.SALTS` keys by its documents; each key then builds the list once.

Defined results: a null text is empty; an empty text or one with a marker stays plain, with null lengths; a null doc_id
draws from the seed alone; repeated rows give repeated results; ids may be of any type; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import io
from quarry.llm.text import steps

SEED, RATE, SPM_SHARE = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters of outputs that a task holds before it hands them on.
HELD = 1 << 22
#: One-bits between two entries of the select directory.
EVERY = 256


class EliasFano:
    """A non-decreasing list of numbers up to `most`: low bits packed, high bits in unary, with a select directory."""

    def __init__(self, values: np.ndarray, most: int):
        self.n = len(values)
        self.width = max(0, (most // self.n).bit_length() - 1) if self.n else 0
        places = np.arange(self.width)
        self.low = np.packbits(((values[:, None] >> places) & 1).astype(np.uint8), bitorder="little")
        ones = (values >> self.width) + np.arange(self.n)
        high = np.zeros(int(ones[-1]) + 1 if self.n else 0, np.uint8)
        high[ones] = 1
        self.high = np.packbits(high, bitorder="little")
        self.directory = ones[::EVERY]

    def __getitem__(self, i: int) -> int:
        start = int(self.directory[i // EVERY])
        left, byte = i % EVERY, start >> 3
        window = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        window[: start & 7] = 0
        while (found := int(window.sum())) <= left:
            left, byte = left - found, byte + 64
            window = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        upper = byte * 8 + int(np.flatnonzero(window)[left]) - i
        first = i * self.width
        bits = np.unpackbits(self.low[first >> 3 : (first + self.width + 7) >> 3], bitorder="little")
        lower = bits[first & 7 : (first & 7) + self.width]
        return upper << self.width | int(lower @ (1 << np.arange(self.width, dtype=np.int64)))


class Entry:
    """What the index holds of a text."""

    def __init__(self, text: str):
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = np.flatnonzero(raw == 10)
        if len(raw) > len(text):
            # code points up to each newline: bytes that don't continue one
            ends = np.cumsum((raw & 0xC0) != 0x80)[ends] - 1
        ends = ends + 1
        if len(text) and (not len(ends) or ends[-1] < len(text)):
            ends = np.append(ends, len(text))
        self.text, self.n = text, len(ends)
        self.ends = EliasFano(ends.astype(np.int64), len(text))
        self.plain = not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE))

    def cut(self, units: int) -> int:
        """The position after so many units."""
        return self.ends[units - 1] if units else 0


def transformed(entry: Entry, doc_id: object, seed: int, rate: int, spm_share: int) -> tuple[str, int | None, int | None, str]:
    """form, prefix_chars, middle_chars, output"""
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(drawn[k : k + 4], "big") for k in (0, 4, 8, 12))
    if entry.plain or h3 % 100 >= rate:
        return "plain", None, None, entry.text
    first, second = sorted((h1 % (entry.n + 1), h2 % (entry.n + 1)))
    a, b = entry.cut(first), entry.cut(second)
    text = entry.text
    if h4 % 100 < spm_share:
        return "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def grouped(batches: Iterator[pa.RecordBatch], heavy: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """h1, h2, salt, text and doc_ids: the documents of a batch that have the same text."""
    for batch in steps(batches, limit=HELD):
        coded = pc.dictionary_encode(batch.column("text"))
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        lead = pa.array(order[first[:-1]])
        h1 = batch.column("h1").take(lead)
        hot = np.array([x in heavy for x in h1.to_pylist()], bool)
        salt = np.where(hot, batch.column("draw").to_numpy()[order[first[:-1]]] % io.SALTS, 0)
        ids = pa.ListArray.from_arrays(pa.array(first, pa.int32()), batch.column("doc_id").take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([h1, batch.column("h2").take(lead), pa.array(salt, pa.int32()), coded.dictionary, ids], ["h1", "h2", "salt", "text", "doc_ids"])


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars and output of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = io.texts(docs, "doc_id").select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.xxhash64("doc_id").alias("draw"))
    counts = rows.groupBy("h1").agg(F.count("*").alias("n"))
    # a heavy text has one in io.HEAVY rows, so there are fewer than that
    total = rows.count()
    heavy = frozenset(r["h1"] for r in counts.filter(F.col("n") > max(1, total // io.HEAVY)).collect())

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, entries, out, held = None, {}, [], 0
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_ids")
            for k, key in enumerate(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)):
                if key != at:
                    at, entries = key, {}
                text = texts[k].as_py()
                entry = entries.get(text)
                if entry is None:
                    entry = entries[text] = Entry(text)
                for doc_id in ids[k].as_py():
                    made = transformed(entry, doc_id, seed, rate, spm_share)
                    out.append((doc_id, entry.n, *made))
                    held += len(made[-1])
                    if held > HELD or len(out) >= 10_000:
                        yield _batch(out, ids.type.value_type)
                        out, held = [], 0
        if out:
            yield _batch(out, ids.type.value_type)

    return (
        rows.mapInArrow(lambda batches: grouped(batches, heavy), f"h1 long, h2 long, salt int, text string, doc_ids array<{kind}>")
        .repartition("h1", "salt")
        .sortWithinPartitions("h1", "h2")
        .mapInArrow(select, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    )


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def report(docs: DataFrame) -> DataFrame:
    made = fill_in_middle(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(io.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, h, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n,
    CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS h1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS h2,
    CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain
  FROM u),
p AS (SELECT *, coalesce(list_sum(list_transform(units[1:least(h1, h2)], lambda x: length(x))), 0) AS a,
    coalesce(list_sum(list_transform(units[1:greatest(h1, h2)], lambda x: length(x))), 0) AS b FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN t
    WHEN h4 < 50 THEN '<S>' || substring(t, CAST(b + 1 AS BIGINT)) || '<P>' || left(t, CAST(a AS BIGINT)) || '<M>' || substring(t, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))
    ELSE '<P>' || left(t, CAST(a AS BIGINT)) || '<S>' || substring(t, CAST(b + 1 AS BIGINT)) || '<M>' || substring(t, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
