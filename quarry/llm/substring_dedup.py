"""Operator 6, removal of passages seen in earlier documents, by repeated-phrase automata.

Texts are read as words. Every window of `window` words holds a phrase of `PHRASE` words chosen by its own content (the
least hash inside the window), so equal windows share their phrase. A phrase with all words of the windows that it
stands for in one text is a context.

1. Confirm. Phrases that occur once rule out their windows. Of the others, each context is looked at once, in the text
   with the smallest doc_id, which speaks for it; where contexts share the half window before or after the phrase, their
   windows are grouped by hash. Each window's owner is its smallest doc_id. An owner's adjacent windows that also start
   elsewhere make a recurring passage, cut into pieces of `PIECE` window starts that overlap by a window.
2. Automata. A text needs the pieces that hold a repeated window of one of its contexts: both are found by equality of
   contexts and of windows, so there is one such row for each context and owner, however many texts share a line. Texts
   come with their pieces in record batches, and each batch compiles its pieces' seeds (PHRASE words every
   window - PHRASE + 1 words, so each window holds one whole) into an Aho-Corasick automaton: the automata are shards of
   the whole set.
3. Locate. Each batch's texts stream through its automaton. Every seed found is extended, word by word, along the piece;
   a common run of `window` words or more whose owner has a smaller doc_id is removed.

Texts cross the network once, compressed, and equal ones are combined before that: all but the smallest doc_id lose
every word if there are `window` words or more. Phrases and contexts with a large share of all rows are dealt over many
keys where they are joined.

Defined results: a null or empty text has no words; a document without an id neither removes nor loses anything; rows
with equal id count as one document; ids of any type are compared as Spark orders them; columns other than `doc_id` and
`text` are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import io
from quarry.llm.suffix_dedup import packed, sides, text_key, to_compare, triggers, unpacked
from quarry.llm.text import SPACED, Ranges, joined_words, mix, signed, steps, utf8, words

WINDOW, PHRASE = 50, 8
#: Window starts of a piece of a passage.
PIECE = 256


def _parsed(column: pa.Array, window: int) -> tuple:
    """Words of a batch, hashes of phrases, and the triggers with the windows they stand for."""
    data, offsets = utf8(column)
    start, end, first = words(data, offsets, SPACED)
    chain = Ranges(Ranges(data)(start, end))
    stop = first[1:][np.repeat(np.arange(len(first) - 1), np.diff(first))]
    places = np.arange(max(0, len(start) - PHRASE + 1))
    grams = chain(places, places + PHRASE)
    return (data, start, end, first, chain, grams, *triggers(grams, stop, window, PHRASE))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a batch once, with its least doc_id."""
    for batch in batches:
        chosen: dict[tuple[int, int], int] = {}
        ids = batch.column("doc_id").to_pylist()
        for i, key in enumerate(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)):
            if key not in chosen or ids[i] < ids[chosen[key]]:
                chosen[key] = i
        yield batch.take(pa.array(sorted(chosen.values()))) if len(chosen) < batch.num_rows else batch


def anchors(texts: DataFrame, window: int) -> DataFrame:
    """Every phrase trigger of every text with its context, its sides and the windows it stands for."""
    half = (window - PHRASE) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(_once(batches)):
            _, _, _, first, chain, grams, place, low, high = _parsed(batch.column("text"), window)
            owner = np.searchsorted(first, low, "right") - 1
            contexts = mix(chain(low, high + window) + (place - low).astype(np.uint64))
            before, after = sides(chain, place, low, high + window, PHRASE, half)
            take, base = pa.array(owner), first[owner]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(grams[place])),
                    pa.array(signed(contexts)),
                    pa.array(before),
                    pa.array(after),
                    *[batch.column(c).take(take) for c in ("k1", "k2", "doc_id")],
                    pa.array(packed(low - base, high - base, place - base)),
                ],
                ["phrase", "context", "before", "after", "k1", "k2", "doc_id", "span"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("k1", "k2", "doc_id", "text").mapInArrow(
        run, f"phrase long, context long, before int, after int, k1 long, k2 long, doc_id {kind}, span long"
    )


def phrases(texts: DataFrame, window: int) -> DataFrame:
    """Every phrase that a trigger picks and how often; counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(_once(batches)):
            _, _, _, _, _, grams, place, _, _ = _parsed(batch.column("text"), window)
            found, n = np.unique(grams[place], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n)], ["phrase", "n"])

    some = texts.select("k1", "k2", "doc_id", "text")
    return some.mapInArrow(run, "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("n"))


def spoken(found: DataFrame) -> DataFrame:
    """Each context once: cid, the text and span that speak for it, whether it occurs `twice`, how often (n), and
    whether the windows with the whole `left` or `right` half have to be compared with other contexts."""
    keys = ["phrase", "context", "before", "after"]
    place = F.xxhash64("k1", "k2", "span")
    one = found.groupBy(*keys).agg(
        F.min(F.struct("doc_id", "k1", "k2", "span")).alias("speaker"), (F.min(place) < F.max(place)).alias("twice"), F.count("*").alias("n")
    )
    both = one.select(
        "phrase", "context",
        F.inline(F.array(F.struct(F.lit(True).alias("is_left"), F.col("before").alias("side")), F.struct(F.lit(False).alias("is_left"), F.col("after").alias("side")))),
    ).filter("side <> 0")
    shared = both.groupBy("phrase", "is_left", "side").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    compared = (
        both.join(shared.drop("kinds"), ["phrase", "is_left", "side"])
        .groupBy("phrase", "context")
        .agg(F.max("is_left").alias("left"), F.max(~F.col("is_left")).alias("right"))
    )
    return (
        one.join(compared, ["phrase", "context"], "left")
        .filter("twice OR left OR right")
        .select(
            F.xxhash64("phrase", "context").alias("cid"),
            "speaker.k1", "speaker.k2", F.col("speaker.doc_id").alias("least"), "speaker.span", "twice", "n",
            F.when(F.col("left"), True).alias("left"), F.when(F.col("right"), True).alias("right"),
        )
    )


def settled(half: int) -> Column:
    """First and last start of the windows of a context that weren't compared."""
    low = F.shiftright("span", 24)
    high = low + F.shiftright("span", 12).bitwiseAND(0xFFF)
    place = low + F.col("span").bitwiseAND(0xFFF)
    return F.struct(
        F.when(F.col("left"), F.greatest(low, place - half + 1)).otherwise(low).cast("int").alias("a"),
        F.when(F.col("right"), F.least(high, place - half - 1)).otherwise(high).cast("int").alias("b"),
    )


def _text(payload: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(payload).decode()


def distinct_texts(own: DataFrame) -> DataFrame:
    """k1, k2, least (the smallest doc_id) and payload (the text, compressed) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in steps(_once(batches)):
            texts = pa.array([pack(x.encode()) for x in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("k1", "k2", "doc_id")], texts], ["k1", "k2", "least", "payload"])

    kind = own.schema["doc_id"].dataType.simpleString()
    rows = own.select("k1", "k2", "doc_id", "text").mapInArrow(run, f"k1 long, k2 long, least {kind}, payload binary")
    return rows.groupBy("k1", "k2").agg(F.min("least").alias("least"), F.first("payload").alias("payload"))


def windows(marked: DataFrame, window: int) -> DataFrame:
    """The windows that have to be compared: string and string_2 (128 bits of hash), cid, and where the context speaks."""
    half = (window - PHRASE) // 2

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "payload"):
            column = pa.array([_text(x) for x in batch.column("payload").to_pylist()], pa.string())
            data, offsets = utf8(column)
            start, end, first = words(data, offsets, SPACED)
            chains = [Ranges(Ranges(data, kind)(start, end), kind) for kind in (0, 1)]
            rows, starts, cids, times = [], [], [], []
            for i, marks in enumerate(batch.column("marks").to_pylist()):
                for m in marks:
                    for a, b, _ in to_compare(m, half):
                        rows.append(np.full(b - a + 1, i))
                        starts.append(np.arange(a, b + 1))
                        cids.append(np.full(b - a + 1, m["cid"]))
                        times.append(np.full(b - a + 1, 1 + m["twice"]))
            if not rows:
                continue
            row, at = np.concatenate(rows), np.concatenate(starts)
            place, take = first[row] + at, pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(signed(chain(place, place + window))) for chain in chains],
                    pa.array(np.concatenate(cids)),
                    *[batch.column(c).take(take) for c in ("k1", "k2", "least")],
                    pa.array(at.astype(np.int32)),
                    pa.array(np.concatenate(times)),
                ],
                ["string", "string_2", "cid", "k1", "k2", "least", "start", "n"],
            )

    kind = marked.schema["least"].dataType.simpleString()
    return marked.select("k1", "k2", "least", "payload", "marks").mapInArrow(
        compare, f"string long, string_2 long, cid long, k1 long, k2 long, least {kind}, start int, n long"
    )


def pieces(owned: DataFrame, window: int) -> DataFrame:
    """Pieces of the recurring passages of each owner: k1, k2, least, at (the first window's start) and words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "payload"):
            rows: list[tuple[int, int, str]] = []
            for i, (payload, runs, starts) in enumerate(
                zip(*[batch.column(c).to_pylist() for c in ("payload", "runs", "starts")], strict=True)
            ):
                own = _words(_text(payload))
                spans = sorted([(r["a"], r["b"]) for r in runs or ()] + [(s, s) for s in starts or ()])
                merged: list[list[int]] = []
                for a, b in spans:
                    if merged and a <= merged[-1][1] + 1:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                for a, b in merged:
                    rows += [(i, at, " ".join(own[at : min(at + PIECE - 1, b) + window])) for at in range(a, b + 1, PIECE)]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(take) for c in ("k1", "k2", "least")],
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.string()),
                ],
                ["k1", "k2", "least", "at", "words"],
            )

    kind = owned.schema["least"].dataType.simpleString()
    return owned.select("k1", "k2", "least", "payload", "runs", "starts").mapInArrow(
        cut, f"k1 long, k2 long, least {kind}, at int, words string"
    )


class Automaton:
    """The seeds of some pieces."""

    def __init__(self, owners: list, pieces_: list[str], window: int):
        self.window, self.owners = window, owners
        self.words = [p.split(" ") for p in pieces_]
        self.machine = ahocorasick.Automaton()
        seeds = defaultdict(list)
        step = window - PHRASE + 1
        for i, w in enumerate(self.words):
            for at in range(0, len(w) - PHRASE + 1, step):
                seeds[" " + " ".join(w[at : at + PHRASE]) + " "].append((i, at))
        for seed, places in seeds.items():
            self.machine.add_word(seed, (len(seed), places))
        if seeds:
            self.machine.make_automaton()
        self.empty = not seeds

    def removed(self, doc_id, own: list[str]) -> np.ndarray:
        """For each word whether it lies in a window that an earlier document owns."""
        gone = np.zeros(len(own), bool)
        if self.empty or len(own) < self.window:
            return gone
        text = " " + " ".join(own) + " "
        first = np.cumsum([0] + [len(w) + 1 for w in own])  # where the blank before each word is
        reached: dict[tuple[int, int], int] = {}  # (piece, shift) -> words up to here are compared
        for end, (size, places) in self.machine.iter(text):
            word = int(np.searchsorted(first, end - size + 1))
            for i, at in places:
                if self.owners[i] >= doc_id or reached.get((i, word - at), -1) > word:
                    continue
                other = self.words[i]
                a, b = word, word + PHRASE
                while a > 0 and at - (word - a) > 0 and own[a - 1] == other[at - (word - a) - 1]:
                    a -= 1
                while b < len(own) and at + b - word < len(other) and own[b] == other[at + b - word]:
                    b += 1
                reached[i, word - at] = b
                if b - a >= self.window:
                    gone[a:b] = True
        return gone


def _words(text: str | None) -> list[str]:
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]), SPACED)
    return [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def located(texts: DataFrame, needed: DataFrame, window: int, texts_too: bool) -> DataFrame:
    """k1, k2, n_removed, kept_sha256 and kept of the texts that need a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "payload"):
            lists = batch.column("pieces").to_pylist()
            shard = {(p["owner"], p["words"]) for found in lists for p in found}
            automaton = Automaton([x[0] for x in shard], [x[1] for x in shard], window)
            out = []
            for least, payload in zip(batch.column("least").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                own = _words(_text(payload))
                gone = automaton.removed(least, own)
                kept = " ".join(w for w, g in zip(own, gone.tolist(), strict=True) if not g)
                out.append((int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept if texts_too else None))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1"),
                    batch.column("k2"),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.string()),
                    pa.array([x[2] for x in out], pa.string()),
                ],
                ["k1", "k2", "n_removed", "kept_sha256", "kept"],
            )

    listed = needed.groupBy("k1", "k2").agg(F.collect_list(F.struct("owner", "words")).alias("pieces"))
    return texts.join(listed, ["k1", "k2"]).mapInArrow(run, "k1 long, k2 long, n_removed long, kept_sha256 string, kept string")


def dedup(docs: DataFrame, window: int = WINDOW, texts_too: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words, joined by spaces) of every document."""
    half = (window - PHRASE) // 2
    rows = docs.select("doc_id", *text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    own = rows.filter("doc_id IS NOT NULL")
    # most phrases occur once and end here; the anchors of the others are written, so that texts are parsed no more
    again = io.written(phrases(own, window).filter("n > 1"))
    found = io.written(io.joined_evenly(anchors(own, window), again.select("phrase"), ["phrase"], again))
    contexts = io.written(spoken(found))

    texts = distinct_texts(own)
    marks = contexts.groupBy("k1", "k2").agg(F.collect_list(F.struct("cid", "span", "twice", "left", "right")).alias("marks"))
    compared = io.written(windows(texts.join(marks.filter(F.exists("marks", lambda m: m["left"] | m["right"])), ["k1", "k2"]), window))
    owners = (
        compared.groupBy("string", "string_2")
        .agg(F.sum("n").alias("n"), F.min(F.struct("least", "k1", "k2", "start")).alias("owner"))
        .filter("n > 1")
        .select("string", "string_2", "owner.k1", "owner.k2", "owner.start")
    )
    owned = io.written(compared.select("string", "string_2", "cid").join(owners, ["string", "string_2"]).groupBy("cid", "k1", "k2").agg(F.collect_set("start").alias("starts")))

    calm = contexts.filter("twice").select("cid", "k1", "k2", settled(half).alias("run")).filter("run.a <= run.b")
    runs = calm.groupBy("k1", "k2").agg(F.collect_list("run").alias("runs"))
    starts = owned.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    passages = pieces(texts.join(runs.join(starts, ["k1", "k2"], "full"), ["k1", "k2"]), window)

    # one row for each context and owner of some of its windows
    refs = owned.select("cid", "k1", "k2", F.array_min("starts").alias("a"), F.array_max("starts").alias("b")).unionByName(
        calm.select("cid", "k1", "k2", "run.a", "run.b")
    )
    refs = refs.select("cid", F.struct("k1", "k2", "a", "b").alias("ref"))
    holders = found.select(F.xxhash64("phrase", "context").alias("cid"), "k1", "k2", "span")
    wanted = (
        io.joined_evenly(holders, refs, ["cid"], contexts.select("cid", "n"))
        .filter("k1 <> ref.k1 OR k2 <> ref.k2")
        .select("k1", "k2", "ref")
        .distinct()
        .select(F.struct("k1", "k2").alias("holder"), "ref.*")
    )
    needed = (
        wanted.join(passages, ["k1", "k2"])
        .filter(f"at <= b AND at + {PIECE} > a")
        .select("holder.k1", "holder.k2", F.col("least").alias("owner"), "words")
        .distinct()
    )
    judged = located(texts, needed, window, texts_too)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            raw, at, n = joined_words(*utf8(batch.column("text")))
            parts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "k1", "k2")],
                    pa.array(n),
                    pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()),
                    pa.array([x.decode() if texts_too else None for x in parts], pa.string()),
                ],
                ["doc_id", "k1", "k2", "n_words", "whole_sha256", "whole"],
            )

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    wholes = rows.mapInArrow(whole, f"doc_id {id_kind}, k1 long, k2 long, n_words long, whole_sha256 string, whole string")
    least = own.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    joined = wholes.join(least.join(judged, ["k1", "k2"], "left"), ["k1", "k2"], "left")
    # a later copy loses every word; a document without an id none
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_words") >= window)
    intact = F.col("doc_id").isNull() | F.col("n_removed").isNull()
    return joined.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(intact, 0).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(intact, F.col("whole_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.lit("")).when(intact, F.col("whole")).otherwise(F.col("kept")).alias("kept"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(io.table(spark, sf_dir, "documents"), texts_too=False).drop("kept")
