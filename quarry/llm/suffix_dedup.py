"""Operator 5, exact substring dedup by prefix-free parsing.

Texts are read as UTF-8 bytes. A rolling hash over `PHRASE` bytes picks triggers: the least hash in each stretch that a
string of `length` bytes spans. So every string of that length holds a trigger, the choice depends on nothing but the
string's own bytes, and equal strings are parsed alike wherever they stand. The bytes at a trigger are its phrase; a phrase
together with all bytes of the strings that one trigger stands for is a context.

- Parse: each text is a sequence of contexts. Phrases that occur once rule out all their strings; for mostly unique text
  that ends the work.
- Dictionary: the distinct contexts with their counts. A context that occurs twice settles all its strings at once. The
  others are grouped by phrase and by half the bytes beside it, which any two equal strings share, and a suffix array of
  each group's contexts is built by prefix doubling on their bytes (`suffix_ranks`): 8, 16, ... bytes, up to `length`.
- Combined: as the result only asks whether two suffixes of the corpus agree on their first `length` bytes, order is
  needed up to that depth only; there the array of each group is the corpus order of its strings, and neighbours of equal
  rank are strings that occur twice. What lies in different groups differs.

Strings of a group are thus compared by their bytes. Phrases are told apart by 64 bits of hash (two phrases taken for
one only cost time), contexts and the strings of very large groups by 128 bits.

Counts, groupings and joins have partial aggregation, and keys that hold a large share of the rows are dealt over many
where they are joined, so no phrase, however common, collects in one task.

Defined results: a null or empty text has no bytes; copies of a text of `length` bytes or more lose everything; shorter
texts stay; repeated rows count as copies; columns other than `doc_id` and `text` are ignored; ids may be null.
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
from quarry.llm.text import Ranges, mix, ranges_of, signed, steps, utf8, window_minimum

LENGTH, PHRASE = 200, 32
#: Bytes of text, and of strings to compare, that a task works on at a time: arrays of some hundred bytes for each of them.
STEP_BYTES = 1 << 18
#: Contexts that meet in one task at most; strings of larger groups are counted row by row.
CROWD = 20_000

#: A span packs the first start (from bit 24), the number of further starts (bits 12 to 23) and the trigger's distance
#: from the first start (bits 0 to 11).
_ANCHOR = "phrase long, context long, context_2 long, before int, after int, k1 long, k2 long, span long"


def unpacked(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and trigger."""
    low = span >> 24
    return low, low + ((span >> 12) & 0xFFF), low + (span & 0xFFF)


def packed(low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (low << 24) | ((high - low) << 12) | (place - low)


def sides(ranges: Ranges, place: np.ndarray, low: np.ndarray, end: np.ndarray, phrase: int, half: int) -> list[np.ndarray]:
    """Hashes (32 bits) of each phrase with `half` more before it and with `half` more after it, 0 where low or end cut.

    A string with the phrase has half of its other content on at least one side of it.
    """
    out = []
    for a, b, seed in ((place - half, place + phrase, 1), (place, place + phrase + half, 2)):
        inside = (a >= low) & (b <= end)
        h = ranges(np.where(inside, a, 0), np.where(inside, b, 0), seed) >> np.uint64(33)
        out.append(np.where(inside, h + np.uint64(1), np.uint64(0)).astype(np.int64).astype(np.int32))
    return out


def text_key(text: Column) -> list[Column]:
    """128 bits of the text's md5, as two longs."""
    digest = F.md5(F.coalesce(text, F.lit("")))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return [half(1).alias("k1"), half(17).alias("k2")]


def triggers(grams: np.ndarray, row_end: np.ndarray, length: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each trigger, and the first and last start of the strings of `length` that it stands for.

    grams: a hash for each place; row_end: for each place where its row ends.
    """
    width = length - phrase + 1
    if len(grams) < width:
        return (np.empty(0, np.int64),) * 3
    places = np.arange(len(grams), dtype=np.uint64)
    # 32 bits of hash above the place: the leftmost of equal hashes wins, by content alone
    least = window_minimum((mix(grams) & np.uint64(0xFFFFFFFF00000000)) | places, width)
    start = np.flatnonzero(np.arange(len(least)) + length <= row_end[: len(least)])
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return (np.empty(0, np.int64),) * 3
    first = np.ones(len(start), bool)
    first[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(first)
    return place[at], start[at], start[np.append(at[1:], len(start)) - 1]


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """Every trigger of every text: its phrase, its context, its sides and the strings it stands for."""
    half = (length - PHRASE) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=STEP_BYTES):
            data, offsets = utf8(batch.column("text"))
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            n, ranges = len(data), Ranges(data)
            places = np.arange(max(0, n - PHRASE + 1))
            grams = ranges(places, places + PHRASE)
            place, low, high = triggers(grams, offsets[1:][row], length, PHRASE)
            owner = row[low]
            contexts = mix(ranges(low, high + length) + (place - low).astype(np.uint64))
            contexts_2 = Ranges(data, 1)(low, high + length)
            before, after = sides(ranges, place, low, high + length, PHRASE, half)
            take, base = pa.array(owner), offsets[owner]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(grams[place])),
                    pa.array(signed(contexts)),
                    pa.array(signed(contexts_2)),
                    pa.array(before),
                    pa.array(after),
                    batch.column("k1").take(take),
                    batch.column("k2").take(take),
                    pa.array(packed(low - base, high - base, place - base)),
                ],
                ["phrase", "context", "context_2", "before", "after", "k1", "k2", "span"],
            )

    return texts.mapInArrow(io.releasing(run), _ANCHOR)


def phrases(texts: DataFrame, length: int) -> DataFrame:
    """Every phrase that a trigger picks and how often; counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=STEP_BYTES):
            data, offsets = utf8(batch.column("text"))
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            places = np.arange(max(0, len(data) - PHRASE + 1))
            grams = Ranges(data)(places, places + PHRASE)
            place, _, _ = triggers(grams, offsets[1:][row], length, PHRASE)
            found, n = np.unique(grams[place], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n)], ["phrase", "n"])

    return texts.select("text").mapInArrow(io.releasing(run), "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("n"))


def marked_spans(found: DataFrame) -> DataFrame:
    """k1, k2, span, whether the row is `open` (its context occurs once), and the group of strings `left` and `right` of
    the middle that have to be compared: only where a side is shared by several contexts of which one is open, and only
    for one row of each context, which speaks for it. A group is (id, contexts in it). Rows without any are left out."""
    keys = ["phrase", "context", "context_2"]
    name = F.struct("k1", "k2", "span")
    one = found.groupBy(*keys, "before", "after").agg(F.count("*").alias("n"), F.min(name).alias("speaker"))
    both = one.select(
        *keys, "n",
        F.inline(F.array(F.struct(F.lit(True).alias("is_left"), F.col("before").alias("side")), F.struct(F.lit(False).alias("is_left"), F.col("after").alias("side")))),
    ).filter("side <> 0")
    shared = (
        both.groupBy("phrase", "is_left", "side")
        .agg(F.count("*").alias("kinds"), F.min("n").alias("fewest"))
        .filter("kinds > 1 AND fewest = 1")
        .select("phrase", "is_left", "side", F.struct(F.xxhash64("phrase", "is_left", "side").alias("id"), "kinds").alias("group"))
    )
    compared = (
        both.join(shared, ["phrase", "is_left", "side"])
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("is_left"), F.col("group"))).alias("left"),
            F.max(F.when(~F.col("is_left"), F.col("group"))).alias("right"),
        )
    )
    # an open context that shares no side with another has no repeated string
    status = one.join(compared, keys, "left").filter("n > 1 OR left IS NOT NULL OR right IS NOT NULL")
    status = io.written(status.select(*keys, "n", "speaker", "left", "right"))
    marked = io.joined_evenly(found.select(*keys, "k1", "k2", "span"), status, keys, status.select(*keys, "n"))
    speaks = name == F.col("speaker")
    return marked.select(
        "k1", "k2", "span", (F.col("n") == 1).alias("open"), *[F.when(speaks, F.col(c)).alias(c) for c in ("left", "right")]
    )


def to_compare(mark: dict, half: int) -> list[tuple[int, int, dict]]:
    """First and last start, and the group, of the strings that a mark has to compare."""
    low, high, place = unpacked(mark["span"])
    # strings with the whole left side start at the middle or before, those with the right one there or after
    parts = ((low, min(high, place - half), mark["left"]), (max(low, place - half), high, mark["right"]))
    return [(int(a), int(b), group) for a, b, group in parts if group is not None and a <= b]


def suffix_ranks(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix of `data` that starts at a place of `at`, by its first `depth` bytes (at least 8): equal
    for equal bytes, in the order of the bytes otherwise. Prefix doubling: ranks by 2k bytes from two ranks by k."""
    used = np.zeros(len(data) + 1, np.int32)
    np.add.at(used, at, 1)
    np.add.at(used, np.minimum(at + depth, len(data)), -1)
    # only places inside a suffix need a rank
    live = np.flatnonzero(np.cumsum(used[:-1]) > 0)
    padded = np.append(data, np.zeros(8, np.uint8))
    keys = np.zeros(len(live), np.uint64)
    for k in range(8):
        keys <<= np.uint64(8)
        keys |= padded[live + k]
    ranks, width = np.zeros(len(data), np.uint32), 8
    ranks[live] = dense_ranks(keys)
    while width < depth:
        # the last step overlaps, so that both halves end within the depth
        shift = min(width, depth - width)
        keys = ranks[live].astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= ranks[np.minimum(live + shift, len(data) - 1)]
        ranks[live] = dense_ranks(keys)
        width += shift
    return ranks[at]


def dense_ranks(keys: np.ndarray) -> np.ndarray:
    """The number of smaller distinct keys of each: what np.unique's inverse says, with half its memory."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.zeros(len(keys), np.uint32)
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    out = np.empty(len(keys), np.uint32)
    out[order] = np.cumsum(new, out=new)
    return out


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """Each distinct text (k1, k2, text) with the starts of its repeated strings: `settled` spans, single `starts`."""
    io.small_batches(docs.sparkSession)
    rows = docs.select(*text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    # most phrases occur once and end here; the anchors of the others are written, so that texts are parsed no more
    again = io.written(phrases(rows, length).filter("n > 1"))
    found = io.written(io.joined_evenly(anchors(rows, length), again.select("phrase"), ["phrase"], again))
    # copies of a text make equal marks: each is kept once, in each task first
    marks = (
        marked_spans(found)
        .select("k1", "k2", F.struct("span", "open", "left", "right").alias("mark"))
        .groupBy("k1", "k2")
        .agg(F.collect_set("mark").alias("marks"))
    )
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    marked = texts.join(marks, ["k1", "k2"])
    # only strings of groups are compared; the other marks don't go to Python
    to_deal = marked.select(
        "k1", "k2", "text", F.filter("marks", lambda m: m["left"].isNotNull() | m["right"].isNotNull()).alias("marks")
    ).filter(F.size("marks") > 0)
    half = (length - PHRASE) // 2

    def pieces(batches: Iterator[pa.RecordBatch], crowded: bool) -> Iterator[tuple]:
        """(k1, k2, open, group, first start, last start, UTF-8 text) of all strings in crowded groups, or in others."""
        for batch in steps(batches, limit=STEP_BYTES):
            columns = [batch.column(c).to_pylist() for c in ("k1", "k2", "text", "marks")]
            for k1, k2, text, marks_ in zip(*columns, strict=True):
                raw = None
                for mark in marks_:
                    for a, b, group in to_compare(mark, half):
                        if (group["kinds"] > CROWD) == crowded:
                            raw = text.encode() if raw is None else raw
                            yield k1, k2, mark["open"], group["id"], a, b, raw

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "k1", "k2", "open", "start", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        for k1, k2, is_open, group, a, b, raw in pieces(batches, False):
            rows.append((group, k1, k2, is_open, a, raw[a : b + length]))
            if len(rows) == 5000:
                yield _batch(rows, names, kinds)
                rows = []
        yield _batch(rows, names, kinds)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Starts of the open strings that occur twice in their group; a sorted partition's groups, whole ones at a time."""
        for ready in whole_groups(batches, STEP_BYTES):
            data, offsets = utf8(ready.column("bytes"))
            count = np.diff(offsets) - length + 1
            at = np.repeat(offsets[:-1], count) + ranges_of(count)
            row = np.repeat(np.arange(len(count)), count)
            # the group comes before the bytes in the order
            _, group = np.unique(ready.column("group").to_numpy(), return_inverse=True)
            strings = dense_ranks((group[row].astype(np.uint64) << np.uint64(32)) | suffix_ranks(data, at, length))
            is_open = ready.column("open").to_numpy(zero_copy_only=False)
            hit = (np.bincount(strings)[strings] > 1) & is_open[row]
            starts = (at - offsets[row] + ready.column("start").to_numpy()[row])[hit]
            some, first = np.unique(row[hit], return_index=True)
            yield pa.RecordBatch.from_arrays(
                [
                    ready.column("k1").take(pa.array(some)),
                    ready.column("k2").take(pa.array(some)),
                    pa.ListArray.from_arrays(pa.array(np.append(first, len(starts)), pa.int32()), pa.array(starts)),
                ],
                ["k1", "k2", "starts"],
            )

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["string", "string_2", "k1", "k2", "start", "open"], [pa.int64()] * 5 + [pa.bool_()]
        for k1, k2, is_open, _, a, b, raw in pieces(batches, True):
            at = np.arange(a, b + 1)
            part = np.frombuffer(raw, np.uint8)[a : b + length]
            hashes = [signed(Ranges(part, k)(at - a, at - a + length)).tolist() for k in (0, 1)]
            yield _batch([(h, g, k1, k2, s, is_open) for h, g, s in zip(*hashes, at.tolist(), strict=True)], names, kinds)

    in_groups = (
        to_deal.mapInArrow(io.releasing(deal), "group long, k1 long, k2 long, open boolean, start long, bytes binary")
        .repartition("group")
        .sortWithinPartitions("group")
        .mapInArrow(io.releasing(compare), "k1 long, k2 long, starts array<long>")
    )
    # groups of very many contexts: their strings are counted one by one, wherever they lie
    crowds = F.exists("marks", lambda m: (m["left"]["kinds"] > CROWD) | (m["right"]["kinds"] > CROWD))
    strings = to_deal.filter(F.coalesce(crowds, F.lit(False))).mapInArrow(io.releasing(single), "string long, string_2 long, k1 long, k2 long, start long, open boolean")
    name = ["string", "string_2"]
    twice = strings.groupBy(*name).agg(F.count("*").alias("n")).filter("n > 1").select(*name)
    crowded = strings.filter("open").join(twice, name).select("k1", "k2", F.array("start").alias("starts"))
    starts = (
        in_groups.unionByName(crowded).groupBy("k1", "k2").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    )
    settled = F.transform(F.filter("marks", lambda m: ~m["open"]), lambda m: m["span"])
    return marked.join(starts, ["k1", "k2"], "left").select("k1", "k2", "text", settled.alias("settled"), "starts")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def whole_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition sorted by group, in slices of whole groups: of at most `limit` of `bytes` and one group."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("group").to_numpy()
        sizes = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy())))
        edges = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
        begin = 0
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = int(sizes[b] - sizes[a])
            if size and group[a] != last and size + own > limit:
                yield pa.concat_batches([*held, batch.slice(begin, a - begin)])
                held, size, begin = [], 0, a
            size, last = size + own, group[a]
        held.append(batch.slice(begin))
    if held:
        yield pa.concat_batches(held)


def removed_runs(settled: list, starts: list | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    settled = [unpacked(x) for x in settled]
    spans = sorted([(low, high + length) for low, high, _ in settled] + [(s, s + length) for s in starts or ()])
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def remainders(docs: DataFrame, length: int = LENGTH, texts_too: bool = True) -> DataFrame:
    """k1, k2, n_bytes, n_removed, n_spans, kept_sha256 and kept (text) of each distinct text that has repeats."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=STEP_BYTES):
            out = []
            for text, settled, starts in zip(
                batch.column("text").to_pylist(), batch.column("settled").to_pylist(), batch.column("starts").to_pylist(), strict=True
            ):
                raw, at, parts = text.encode(), 0, []
                runs = removed_runs(settled, starts, length)
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                kept = b"".join([*parts, raw[at:]])
                out.append((len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), mended(raw, runs) if texts_too else None))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1"),
                    batch.column("k2"),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.string()),
                    pa.array([x[3] for x in out], pa.string()),
                ],
                ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return repeated(docs, length).mapInArrow(
        io.releasing(cut), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept string"
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(io.table(spark, sf_dir, "documents"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document."""
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(
        "doc_id", *text_key(F.col("text")), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own_sha256")
    )
    return whole.join(remainders(docs, texts_too=False), ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "own_sha256").alias("kept_sha256"),
    )


def mended(raw: bytes, runs: list[tuple[int, int]]) -> str:
    """The text without the runs; what a cut leaves of a character at its edges goes too."""
    parts, at = [], 0
    for a, b in [*runs, (len(raw), len(raw))]:
        # back to the character's first byte, on to the next character's
        end, begin = a, at
        while begin < end and at and raw[begin] & 0xC0 == 0x80:
            begin += 1
        if a < len(raw):
            while end > begin and raw[end] & 0xC0 == 0x80 and raw[end - 1] & 0x80:
                end -= 1
        parts.append(raw[begin:end])
        at = b
    return b"".join(parts).decode()


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without their repeated bytes (what is left of a cut character goes too); n_chars follows."""
    cut = remainders(docs, length).select("k1", "k2", F.struct("kept").alias("cut"))
    # the row as one column, so that its names can't clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *text_key(F.col("text")))
    text = F.when(F.col("cut").isNotNull(), F.col("cut.kept")).otherwise(F.col("row.text"))
    columns = []
    for field in docs.schema.fields:
        own = F.col("row").getField(field.name)
        if field.name == "text":
            own = text
        elif field.name == "n_chars":
            own = F.coalesce(F.length(text), F.lit(0)).cast(field.dataType)
        columns.append(own.alias(field.name))
    return rows.join(cut, ["k1", "k2"], "left").select(*columns)
