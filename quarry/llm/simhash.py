"""Operator 8, SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint is the bitwise majority of the hashes of its word shingles. Two fingerprints that differ in at most
`bits` bits are linked. Cut into segments, more than half as many as that, one of the segments differs by at most one
bit; if that bit is masked, both are equal. So every fingerprint is filed under each of its one-wildcard segment variants
(the masked bit's number and the rest of its segment), one for each bit; an equality grouping on the variant brings all
links together, and each candidate is verified on all bits. Components of the links give the classes.

A `Scheme` names the shingles, the hash, the segments and the distance. `CONTRACT` (4 words, 64 bits, 3 segments, 4 bits)
is the query's. `SIMILAR` is for near copies of 5-word shingles and a similarity of 0.8 or more: such pairs differ by 17
of 128 bits in the mean, so it takes up to 25 as candidates, and `keep` verifies them on their whole sets of shingles;
README says what share of such pairs it finds. Segments short enough for 25 bits give buckets that grow with the square of
the corpus, so `keep` files nodes by shingles instead, as operator 12 does: two sets of that similarity share one of the rare
shingles of their prefixes, or a run of frequent ones. Every pair of a bucket that is near by its fingerprints, and whose
ends aren't yet of one class, is verified.

Equal fingerprints are one class from the start, so only distinct fingerprints are filed, however many copies exist.
Within a variant's bucket no list of all pairs is made: fingerprints already reached leave the search, which gives a
spanning forest of the bucket's links (at most one row per fingerprint) and the same components. A bucket of more than
`BUCKET` fingerprints is cut into chunks that meet pairwise in tasks of bounded size.

Defined results: a null or empty text, or one of separators only, has fingerprint zero and is linked like any other;
texts with fewer words than a shingle have one shingle; repeated rows get equal results; a null doc_id is classed like
others and is never a component's name unless all its ids are null; ids may be of any type; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import io, jaccard_join
from quarry.llm.components import components
from quarry.llm.text import SPACED, lower_ascii, mix, signed, steps, utf8, words

#: Most distinct fingerprints of a bucket that meet in one task at once.
BUCKET = 1_000_000
#: Buckets up to this size are compared by shifts, all of a batch together.
SMALL = 12
#: Pairs of a larger bucket that are compared at once.
BLOCK = 1 << 18
#: The least similarity of near copies is 4 / 5.
SHARE = (4, 5)
#: A table of keys up to this many rows is broadcast.
BROADCAST_ROWS = 1_000_000
#: What a node carries besides its fingerprint: the number of its shingles and their sketch.
SIZED = ["n", *jaccard_join.SKETCH]


@dataclass(frozen=True)
class Scheme:
    """Words of a shingle, seed, 64-bit words of a fingerprint (1: XXH64, 2: XXH3-128), the most bits that a link differs
    by, and the first bit of each segment, with the end of the last; a segment lies in one of those words."""

    shingle: int
    seed: int
    width: int
    bits: int
    segments: tuple[int, ...]

    def __post_init__(self) -> None:
        if self.bits // (len(self.segments) - 1) > 1:
            raise ValueError("too few segments: each could differ by more than one bit")
        if self.segments[-1] != 64 * self.width or not set(range(0, 64 * self.width, 64)) <= set(self.segments):
            raise ValueError("segments must cover each 64-bit word")


CONTRACT = Scheme(4, 42, 1, 4, (0, 22, 43, 64))
SIMILAR = Scheme(5, 42, 2, 25, (0, 10, 19, 28, 37, 46, 55, 64, 75, 86, 97, 107, 118, 128))


def fingerprints_of(column: pa.Array, scheme: Scheme = CONTRACT) -> np.ndarray:
    """Unsigned fingerprints of the texts of a column, a row of 64-bit words each."""
    data, offsets = utf8(column)
    out = np.zeros((len(column), scheme.width), np.uint64)
    data = lower_ascii(data)
    start, end, first = words(data, offsets, SPACED)
    if not len(start):
        return out
    # words joined by one space: the byte after each word of a document but its last becomes that space
    keep = SPACED[data]
    inner = np.ones(len(end), bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    data[end[inner]] = 32
    keep[end[inner]] = True
    place = np.cumsum(keep) - 1
    raw = data[keep].tobytes()
    n, shingle = np.diff(first), scheme.shingle
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    at = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(at + shingle, first[1:][row]) - 1
    a, b = place[start[at]].tolist(), (place[end[last] - 1] + 1).tolist()
    digest = xxhash.xxh64_digest if scheme.width == 1 else xxhash.xxh3_128_digest
    seed = scheme.seed
    hashes = np.frombuffer(b"".join([digest(raw[x:y], seed) for x, y in zip(a, b, strict=True)]), ">u8").astype(np.uint64)
    some = np.flatnonzero(count)
    for k in range(scheme.width):
        own = np.ascontiguousarray(hashes[k :: scheme.width])
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int32)
        major = (2 * ones > count[some][:, None]).astype(np.uint8)
        out[some, k] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def node_of(fps: np.ndarray) -> np.ndarray:
    """One number for each fingerprint; of one word the fingerprint itself."""
    return signed(np.ascontiguousarray(fps[:, 0]) if fps.shape[1] == 1 else mix(fps[:, 0] ^ mix(fps[:, 1] + np.uint64(1))))


def _columns(scheme: Scheme) -> list[str]:
    return [f"fp{k}" for k in range(scheme.width)]


def _words(batch: pa.RecordBatch, scheme: Scheme) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy().view(np.uint64) for c in _columns(scheme)])


def fingerprints(rows: DataFrame, ids: dict[str, str], scheme: Scheme = CONTRACT, levels: Broadcast | None = None) -> DataFrame:
    """The `ids` (column: type) of `rows`, node, and the fingerprint's words fp0, ... (as signed longs); with the `levels` of classes
    of shingles also SIZED, and the keys under which a similar set is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            fps = fingerprints_of(batch.column("text"), scheme)
            more = []
            if levels is not None:
                tokens, row, n = jaccard_join.token_sets(batch.column("text"), scheme.shingle)
                sketch = jaccard_join.parities(tokens, row, np.full(len(n), 256)).view(np.int64).reshape(-1, 4)
                of, keys = jaccard_join.index_keys(tokens, row, n, *levels.value, SHARE, np.inf)
                order = np.argsort(of, kind="stable")
                bounds = np.searchsorted(of[order], np.arange(len(n) + 1))
                more = [pa.array(n), *[pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(4)]]
                more.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(keys[order]))))
            words_ = [pa.array(signed(np.ascontiguousarray(fps[:, k]))) for k in range(scheme.width)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ids], pa.array(node_of(fps)), *words_, *more], names)

    numbers = ["node", *_columns(scheme), *(SIZED if levels is not None else [])]
    lists = [] if levels is None else ["keys"]
    names = [*ids, *numbers, *lists]
    schema = ", ".join([*[f"{c} {kind}" for c, kind in ids.items()], *[f"{c} long" for c in numbers], *[f"{c} array<long>" for c in lists]])
    return rows.select(*ids, "text").mapInArrow(io.releasing(run), schema)


def variants(fps: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The one-wildcard segment variants of each fingerprint, bit after bit, all fingerprints for each."""
    keys = []
    for low, high in zip(scheme.segments[:-1], scheme.segments[1:], strict=True):
        part = (fps[:, low // 64] >> np.uint64(low % 64)) & np.uint64((1 << (high - low)) - 1)
        for bit in range(high - low):
            keys.append(np.uint64((low + bit) << 22) | (part & ~np.uint64(1 << bit)))
    return np.concatenate(keys)


def near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    counts = np.bitwise_count(x ^ y)
    total = counts[..., 0]
    for k in range(1, counts.shape[-1]):
        total = total + counts[..., k]
    return total <= bits


def linked(fps: np.ndarray, bits: int) -> np.ndarray:
    """Which fingerprints have another one near; in blocks of bounded size."""
    n = len(fps)
    out, step = np.zeros(n, bool), max(1, BLOCK // n)
    for a in range(0, n, step):
        hits = near(fps[a : a + step, None, :], fps[None, :, :], bits)
        hits[np.arange(len(hits)), np.arange(a, a + len(hits))] = False
        out[a : a + step] = hits.any(axis=1)
    return out


def forest(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components among distinct fingerprints. Those reached leave the search at once."""
    out, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = near(rest, x, bits)
            if hit.any():
                found = rest[hit]
                out.append((np.tile(x, (len(found), 1)), found))
                queue.extend(found)
                rest = rest[~hit]
    return out


def first_variant(x: np.ndarray, y: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The masked bit of the first variant that two near fingerprints share, of the many that they may share."""
    out = np.full(len(x), -1)
    for low, high in zip(scheme.segments[:-1], scheme.segments[1:], strict=True):
        differing = ((x[:, low // 64] ^ y[:, low // 64]) >> np.uint64(low % 64)) & np.uint64((1 << (high - low)) - 1)
        n = np.bitwise_count(differing)
        bit = low + np.where(n == 1, np.bitwise_count(differing - np.uint64(1)), 0).astype(np.int64)
        out = np.where((out < 0) & (n <= 1), bit, out)
    return out


def _buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[np.ndarray]:
    """The rows of some buckets (the first two columns name them) of a sorted partition; one that goes on in the next
    batch waits for it."""
    held = None
    for batch in batches:
        if batch.num_rows:
            now = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            held = now if held is None else np.vstack((held, now))
            cut = len(held) - int((held[:, :2] == held[-1, :2]).all(axis=1).sum())
            if cut:
                yield held[:cut]
            held = held[cut:]
    if held is not None:
        yield held


def bucket_links(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """Links within the buckets of a sorted partition."""
    for ready in _buckets(batches, ["variant", "chunks", *_columns(scheme)]):
        fps = np.ascontiguousarray(ready[:, 2:]).view(np.uint64)
        new = np.ones(len(ready), bool)
        new[1:] = (ready[1:, :2] != ready[:-1, :2]).any(axis=1)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(fps)))
        run = np.repeat(np.arange(len(begin)), size)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        small = size[run] <= SMALL
        for shift in range(1, min(SMALL, len(fps))):
            x = np.flatnonzero(small[:-shift] & (run[:-shift] == run[shift:]))
            x = x[near(fps[x], fps[x + shift], scheme.bits)]
            found.append((fps[x], fps[x + shift]))
        for i in np.flatnonzero(size > SMALL):
            own = fps[begin[i] : begin[i] + size[i]]
            some = own[linked(own, scheme.bits)]
            found += forest(np.unique(some, axis=0), scheme.bits) if len(some) else []
        if found:
            a, b = (node_of(np.concatenate(x)) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(fps: DataFrame, scheme: Scheme = CONTRACT) -> DataFrame:
    """Links (a, b) of nodes whose components are those of all pairs of distinct fingerprints (fp0, ...) at most
    `scheme.bits` bits apart."""
    names = _columns(scheme)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(variants(_words(batch, scheme), scheme), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n)], ["variant", "n"])

    # buckets above BUCKET: fewer keys than bits x fingerprints / BUCKET, a few integers even for billions of documents
    heavy = {}
    if fps.count() > BUCKET:
        sizes = fps.mapInArrow(io.releasing(counted), "variant long, n long").groupBy("variant").agg(F.sum("n").alias("n"))
        heavy = {r["variant"]: -(-r["n"] // BUCKET) for r in sizes.filter(F.col("n") > BUCKET).collect()}

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = np.sort(np.array(list(heavy), np.int64))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = _words(batch.slice(at, 4096), scheme)
                keys = signed(variants(some, scheme))
                own = np.tile(np.arange(len(some)), len(keys) // len(some))
                chunks = np.zeros(len(keys), np.int64)
                if len(large):
                    # a heavy bucket's fingerprint meets every chunk: one row for each pair of its chunk and another
                    hot = np.flatnonzero(np.isin(keys, large))
                    more_keys, more_own, more_chunks = [], [], []
                    for i in hot.tolist():
                        m = heavy[int(keys[i])]
                        c = int(node_of(some[own[i]][None])[0] % m)
                        for d in range(m):
                            more_keys.append(int(keys[i]))
                            more_own.append(int(own[i]))
                            more_chunks.append(min(c, d) * m + max(c, d))
                    cold = np.setdiff1d(np.arange(len(keys)), hot)
                    keys = np.concatenate((keys[cold], np.array(more_keys, np.int64)))
                    own = np.concatenate((own[cold], np.array(more_own, np.int64)))
                    chunks = np.concatenate((chunks[cold], np.array(more_chunks, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(chunks), *[pa.array(signed(np.ascontiguousarray(some[own, k]))) for k in range(scheme.width)]],
                    ["variant", "chunks", *names],
                )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return bucket_links(batches, scheme)

    return (
        fps.select(*names)
        .mapInArrow(io.releasing(filed), ", ".join(["variant long, chunks long", *[f"{c} long" for c in names]]))
        .repartition("variant", "chunks")
        .sortWithinPartitions("variant", "chunks")
        .mapInArrow(io.releasing(searched), "a long, b long")
        .distinct()
    )


def distinct_nodes(marked: DataFrame, scheme: Scheme) -> DataFrame:
    return io.checkpointed(marked.select("node", *_columns(scheme)).dropDuplicates(["node"]))


def classes(docs: DataFrame, scheme: Scheme = CONTRACT) -> DataFrame:
    """doc_id, the fingerprint's words and component_id (the least doc_id reachable over links) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = io.checkpointed(fingerprints(io.texts(docs, "doc_id"), {"doc_id": kind}, scheme))
    own = marked.groupBy("node").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct_nodes(marked, scheme), scheme))
    rooted = own.join(roots, "node", "left").select(F.col("node").alias("own_node"), F.coalesce("root", "node").alias("root"), "least")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("own_node", "component_id")
    return marked.join(named, F.col("node") == F.col("own_node")).select("doc_id", *_columns(scheme), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(io.table(spark, sf_dir, "documents"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document."""
    return classes(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns as one, so that names can't clash) with a hash of it in two columns; nulls count as values."""
    values = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64(F.lit(1), *values).alias("h1"),
        F.xxhash64(F.lit(2), *values).alias("h2"),
    )


def similar_links(marked: DataFrame, nodes: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Links whose components are those of all pairs of nodes that are at most `scheme.bits` apart and similar. `marked`: node
    and keys; `nodes`: node, fingerprint, SIZED, and the hashes of its text."""

    def similar(pairs: DataFrame) -> DataFrame:
        near_ = jaccard_join.possible(pairs, nodes, SHARE, tuple(_columns(scheme)), scheme.bits)
        return jaccard_join.verified(near_, nodes, docs, scheme.shingle, SHARE)

    buckets = jaccard_join.bucketed(marked.select(F.explode("keys").alias("key"), "node"))
    return jaccard_join.search(buckets, nodes, similar, components, SHARE, tuple(_columns(scheme)), scheme.bits)


def keep(docs: DataFrame, scheme: Scheme = SIMILAR) -> DataFrame:
    """One row of each class stays: the one with the least doc_id (null: last), then by a hash of the row; of equal rows,
    one. Rows are found again by that hash, so a repeated id or none doesn't matter."""
    whole = keyed(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = whole.select(F.col("row.doc_id").alias("doc_id"), "h1", "h2", F.coalesce("row.text", F.lit("")).alias("text"))
    rows = rows.select("*", *jaccard_join.text_hashes())
    counts = jaccard_join.class_counts(rows, scheme.shingle)
    levels = docs.sparkSession.sparkContext.broadcast(jaccard_join.levels_of(counts))  # CLASSES bytes
    ids = {"doc_id": kind, "h1": "long", "h2": "long", "k1": "long", "k2": "long"}
    marked = io.written(fingerprints(rows, ids, scheme, levels))
    rest = ["k1", "k2", *_columns(scheme), *SIZED]
    item = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", *rest)
    own = io.checkpointed(marked.groupBy("node").agg(F.min(item).alias("least")))
    nodes = own.select("node", *[F.col(f"least.{c}").alias(c) for c in rest])
    roots = components(similar_links(marked, nodes, docs, scheme))
    best = own.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    chosen = io.checkpointed(best.select(F.col("least.h1").alias("h1"), F.col("least.h2").alias("h2")))
    counts = marked.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    twice = io.checkpointed(counts.filter("n > 1").select("h1", "h2").join(chosen, ["h1", "h2"], "left_semi"))
    lost = counts.select("h1", "h2").join(chosen, ["h1", "h2"], "left_anti")
    gone = io.checkpointed(lost.unionByName(twice))
    single = whole.join(_few(gone), ["h1", "h2"], "left_anti")
    again = whole.join(_few(twice), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    return single.unionByName(again).select("row.*")
