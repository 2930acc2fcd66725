"""Operator 12, an exact Jaccard self-join of word shingles by token-combination prefixes.

A text is the set of its distinct shingles (tokens, by 64-bit hashes). Tokens fall into `CLASSES` classes by hash; how
often each class occurs over all texts orders the tokens, rare classes first, and a class that occurs far more often than
the mean is frequent. Let two sets be similar. Each of them lacks at most a = |x| - ceil(share * |x|) tokens of its own in
the other, so the first token that both have is among the first a + 1 of each:

- if that token is rare, both are filed under it: rare tokens of the first a + 1 are indexed one by one;
- if it is frequent, so is every later one, and the prefix is extended until both have more than
  (a + b + 1) * (`COMBINATION` - 1) common tokens in it. At most a + b other tokens stand between these, so some
  `COMBINATION` common tokens follow each other in both sets: frequent tokens are indexed by such runs.

Sets of `LARGE` tokens or more, which share single tokens with many others, are indexed by runs of any tokens in the same
way; sets up to a similar one's size above that are indexed both ways. So all similar pairs share a key, whatever the
frequencies are. Equal sets are one node from the start. Keys that the same
nodes have are one bucket. Within a bucket not all pairs are candidates. First each
node meets the bucket's least one; then, across the classes that this has joined, nodes that lengths and a parity sketch
(its differing bits never outnumber the differing tokens) allow to be similar, as a forest (buckets of up to `SMALL`
nodes: all such pairs); and last, all such pairs that
are still in different classes and haven't been compared. Candidates are verified on whole texts. Buckets of more than
`BUCKET` nodes are cut into chunks that meet pairwise in separate tasks.

Defined results: a text without words has no shingle and links with nothing; fewer words than a shingle are one token;
repeated rows get equal results; a null doc_id is linked like others but never names a component unless all its ids are
null; ids may be of any type; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import io
from quarry.llm.components import components, stars
from quarry.llm.text import SPACED, Ranges, lower_ascii, mix, ranges_of, signed, steps, utf8, words

SHINGLE = 3
#: The least similarity is 9 / 10.
SHARE = (9, 10)
#: Classes of tokens (one byte each goes to every task), and the counters that one row carries.
CLASSES, CHUNK = 1 << 20, 1 << 12
#: Frequent tokens that one key combines.
COMBINATION = 2
#: Sets from this size on are indexed by runs alone; a sketch of 256 bits tells smaller ones apart.
LARGE = 800
#: Nodes of a bucket that meet in one task at once, and pairs that it compares at once.
BUCKET, BLOCK = 50_000, 1 << 18
#: Buckets up to this size are compared by shifts, all of a batch together.
SMALL = 12
#: Tokens of a text in the mean from which each text's are sorted by themselves.
LONG = 32
#: A table of the asked texts' hashes up to this many rows is broadcast.
BROADCAST_ROWS = 200_000
SKETCH = [f"s{k}" for k in range(4)]


def token_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct tokens, sorted, one text after the other; the row of each; how many each row has."""
    data, offsets = utf8(column)
    data = lower_ascii(data)
    start, end, first = words(data, offsets, SPACED)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    at = np.repeat(first[:-1], count) + ranges_of(count)
    tokens = Ranges(Ranges(data)(start, end))(at, np.minimum(at + shingle, first[1:][row])) if len(start) else np.empty(0, np.uint64)
    if len(tokens) >= LONG * len(n):
        ends = np.cumsum(count)
        for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
            tokens[a:b].sort()
    else:
        tokens = tokens[np.lexsort((tokens, row))]
    new = np.ones(len(row), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
    return tokens[new], row[new], np.bincount(row[new], minlength=len(n))


def class_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int64) % CLASSES


def class_counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many tokens of all texts' sets each class has; summed by chunks, so CLASSES numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in steps(batches):
            total += np.bincount(class_of(token_sets(batch.column("text"), shingle)[0]), minlength=CLASSES)
        kind = np.int32 if total.max() < 1 << 31 else np.int64
        yield _chunks(range(CLASSES // CHUNK), total.reshape(-1, CHUNK).astype(kind))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int32 if len(raw) == 4 * CHUNK else np.int64)
        yield _chunks(sums, sums.values())

    parts = texts.select("text").mapInArrow(io.releasing(count), "chunk int, counts binary").repartition("chunk")
    out = np.zeros((CLASSES // CHUNK, CHUNK), np.int64)
    for r in parts.mapInArrow(io.releasing(add), "chunk int, counts binary").collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int32 if len(r["counts"]) == 4 * CHUNK else np.int64)
    return out.ravel()


def _chunks(numbers, rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], ["chunk", "counts"])


def levels_of(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """A level for each class, higher the more often it occurs, and the first level that is frequent: its count exceeds
    the mean by more than chance gives, so the class holds a token of many texts."""
    mean = counts.mean()
    bound = mean + 8 * mean**0.5 + 8
    level = np.minimum(8 * np.log2(counts + 1.0), 254).astype(np.uint8)
    return level, int(min(8 * np.log2(bound + 1.0), 254)) + 1


def lacking(n: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """Tokens of a set of n that a similar set may lack, at most."""
    t, u = share
    return n - -(-n * t // u)


def index_keys(
    tokens: np.ndarray, row: np.ndarray, n: np.ndarray, level: np.ndarray, frequent: int, share: tuple[int, int] = SHARE, large: float | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every rare token of the prefixes, and of every run of frequent tokens of the extended prefixes. Tokens are
    those of `token_sets`, sorted in each row; sets of `large` tokens (LARGE) or more are indexed by runs alone."""
    large = LARGE if large is None else large
    own_level = level[class_of(tokens)]
    order = np.lexsort((own_level, row.astype(np.uint16) if len(n) <= 1 << 16 else row))
    tokens, own_level, row = tokens[order], own_level[order], row[order]
    place = ranges_of(n)
    a = lacking(n, share)
    b = lacking(n * share[1] // share[0], share)
    # a set that may lack nothing, and of which the other may lack nothing, has no other partner than its equals
    some = (a + b > 0)[row]
    often = own_level >= frequent
    single = some & ~often & (place <= a[row]) & (n - a < large)[row]
    k = COMBINATION
    reach = a + (a + b + 1) * (k - 1) + 1
    if len(tokens) >= k:
        last = len(tokens) - k + 1
        run = some[:last] & (often | (n >= large)[row])[:last] & (place[:last] + k <= reach[row[:last]]) & (row[:last] == row[k - 1 :])
        at = np.flatnonzero(run)
        keys = tokens[at]
        for j in range(1, k):
            keys = mix(keys + np.uint64(0x9E3779B97F4A7C15)) ^ tokens[at + j]
    else:
        at, keys = np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate((row[single], row[at])), np.concatenate((mix(tokens[single]), mix(keys + np.uint64(1))))


def parities(tokens: np.ndarray, row: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The parities of each set, `width` bits (a power of two) for each row, as bytes one row after the other."""
    start = np.cumsum(width) - width
    bit = (tokens >> np.uint64(8)).astype(np.int64) & (width[row] - 1)
    return np.packbits((np.bincount(start[row] + bit, minlength=int(width.sum())) & 1).astype(np.uint8))


def wide_enough(n: np.ndarray) -> np.ndarray:
    """Bits of a sketch that isn't full with n tokens: half as many, 256 at least."""
    return 1 << np.maximum(8, np.ceil(np.log2(np.maximum(n, 2) / 2)).astype(np.int64))


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch as one of fewer bytes."""
    bits = np.frombuffer(sketch, np.uint8)
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def text_hashes() -> list[Column]:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]


def marked(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Written, one row per document: row, doc_id, the text's hashes k1 and k2, the set's hashes h1 and h2, its size n,
    keys, and its sketch, of 256 bits (in four columns) and as wide as its size asks for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = io.texts(docs, "doc_id")
    counts = class_counts(texts, shingle)
    shared = docs.sparkSession.sparkContext.broadcast(levels_of(counts))  # CLASSES bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, frequent = shared.value
        for batch in steps(batches):
            tokens, row, n = token_sets(batch.column("text"), shingle)
            ends, sums = np.concatenate(([0], np.cumsum(n))), []
            for x in (mix(tokens), mix(tokens ^ np.uint64(0x6A09E667F3BCC909))):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
                sums.append(total[ends[1:]] - total[ends[:-1]])
            of, keys = index_keys(tokens, row, n, level, frequent)
            order = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[order], np.arange(len(n) + 1))
            width = wide_enough(n)
            sketch = parities(tokens, row, np.full(len(n), 256)).view(np.int64).reshape(-1, 4)
            wide = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(width // 8))).astype(np.int32)), pa.py_buffer(parities(tokens, row, width))])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "k1", "k2")],
                    *[pa.array(signed(x)) for x in sums],
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(keys[order]))),
                    *[pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(4)],
                    wide,
                ],
                ["doc_id", "k1", "k2", "h1", "h2", "n", "keys", *SKETCH, "sketch"],
            )

    schema = f"doc_id {kind}, k1 long, k2 long, h1 long, h2 long, n long, keys array<long>, " + ", ".join(f"{c} long" for c in SKETCH) + ", sketch binary"
    named = texts.select("doc_id", "text", *text_hashes())
    return io.written(named.mapInArrow(io.releasing(run), schema).withColumn("row", F.monotonically_increasing_id()))


def allowed(n: np.ndarray, m: np.ndarray, differing: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """Whether sizes n and m and a bound on the differing tokens allow the least similarity t / u: the differing tokens
    are at most (u - t) / (u + t) of both sizes together."""
    t, u = share
    return (np.minimum(n, m) * u >= np.maximum(n, m) * t) & (differing * (u + t) <= (n + m) * (u - t))


def sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and whole sketches allow to be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differing = np.zeros(batch.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), strict=True)):
                size = min(len(x), len(y))
                differing[k] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            yield batch.select(["a", "b"]).filter(pa.array(allowed(n, m, differing)))

    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    other = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    t, u = SHARE
    near = F.least("n_a", "n_b") * u >= F.greatest("n_a", "n_b") * t
    return pairs.join(one, "a").join(other, "b").filter(near).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(io.releasing(run), "a long, b long")


def texts_of(asked: DataFrame, docs: DataFrame, name: str, text: str) -> DataFrame:
    """A text of each asked node (node, k1, k2), under the given names."""
    asked = io.checkpointed(asked)
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    texts = io.texts(docs).select("text", *text_hashes())
    return texts.join(asked, ["k1", "k2"]).select(F.col("node").alias(name), F.col("text").alias(text)).dropDuplicates([name])


def possible(pairs: DataFrame, nodes: DataFrame, share: tuple[int, int], prints: tuple[str, ...] = (), bits: int = 0) -> DataFrame:
    """The pairs (a, b) that sizes and sketches of 256 bits allow to be similar, and whose fingerprints differ by at most
    `bits`. `nodes`: node, n, SKETCH and the fingerprint's words `prints`."""
    one, other = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), *[F.col(x).alias(f"{x}_{c}") for x in (*SKETCH, *prints)]) for c in ("a", "b"))
    differing = lambda names: reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in names], F.lit(0))
    t, u = share
    fits = (F.least("n_a", "n_b") * u >= F.greatest("n_a", "n_b") * t) & (differing(SKETCH) * (u + t) <= (F.col("n_a") + F.col("n_b")) * (u - t)) & (differing(prints) <= bits)
    return pairs.join(one, "a").join(other, "b").filter(fits).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, share: tuple[int, int] = SHARE) -> DataFrame:
    """The pairs whose sets of shingles have a similarity of `share` or more; sets without shingles are equal. Each pair has
    its texts brought together, first the second one's. `nodes`: node, and the hashes k1 and k2 of its text."""
    pairs = io.checkpointed(pairs)

    def of(side: str) -> DataFrame:
        asked = pairs.select(F.col(side).alias("node")).distinct().join(nodes.select("node", "k1", "k2"), "node")
        return texts_of(asked, docs, side, f"text_{side}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, u = share
        for batch in steps(batches, "text_b"):
            for part in steps(iter([batch]), "text_a"):
                x, row_x, n = token_sets(part.column("text_a"), shingle)
                y, row_y, m = token_sets(part.column("text_b"), shingle)
                row, value = np.concatenate((row_x, row_y)), np.concatenate((x, y))
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
                both = np.bincount(row[1:][twice], minlength=len(n))
                good = pa.array(both * (t + u) >= t * (n + m))
                yield part.select(["a", "b"]).filter(good)

    return io.checkpointed(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(io.releasing(run), "a long, b long"))


def across(batches: Iterator[pa.RecordBatch], whole: bool, share: tuple[int, int] = SHARE, prints: tuple[str, ...] = (), bits: int = 0) -> Iterator[pa.RecordBatch]:
    """Of each bucket (a sorted partition's rows of one key and chunk) the pairs of nodes of different classes that sizes
    and sketches allow, and fingerprints (words `prints`) at most `bits` apart; all of them if `whole`, else of large
    buckets a forest of the classes. Where rows have the node's keys before this one (`earlier`), a large bucket's pair that
    has met in one of these isn't returned again."""
    names = ["key", "chunk", "node", "root", "n", *SKETCH, *prints]
    held, before = None, []
    for batch in _with_end(batches):
        if batch is not None:
            now = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            held = now if held is None else np.vstack((held, now))
            before += map(frozenset, batch.column("earlier").to_pylist()) if "earlier" in batch.schema.names else [frozenset()] * len(now)
            same = (held[:, :2] == held[-1, :2]).all(axis=1)
            cut = len(held) - int(same.sum())
            ready, held = held[:cut], held[cut:]
            met, before = before[:cut], before[cut:]
        else:
            ready, met = held, before
        if ready is None or not len(ready):
            continue
        new = np.flatnonzero(np.concatenate(([True], (ready[1:, :2] != ready[:-1, :2]).any(axis=1))))
        size = np.diff(np.append(new, len(ready)))
        rows, large = ready[:, 2:], np.flatnonzero(size > SMALL)
        found = [small_pairs(rows, np.repeat(np.arange(len(new)), size), size, share, bits)]
        for first, n in zip(new[large], size[large], strict=True):
            own = dict(zip(rows[first : first + n, 0].tolist(), met[first : first + n], strict=True))
            for pairs in bucket_pairs(rows[first : first + n], whole, share, bits):
                found.append(pairs[[own[a].isdisjoint(own[b]) for a, b in pairs.tolist()]])
            if sum(map(len, found)) > BLOCK:
                yield _ordered(found)
                found = []
        if sum(map(len, found)):
            yield _ordered(found)


def _ordered(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2)], ["a", "b"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def fitting(rows: np.ndarray, x: np.ndarray, y: np.ndarray, share: tuple[int, int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows x and y those of different classes that sizes, sketches and fingerprints allow. `rows`: node, root,
    n, sketch, and a fingerprint or none."""
    good = rows[x, 1] != rows[y, 1]
    x, y = x[good], y[good]
    differing = np.bitwise_count((rows[x, 3:] ^ rows[y, 3:]).view(np.uint64))
    k = len(SKETCH)
    good = allowed(rows[x, 2], rows[y, 2], differing[:, :k].sum(axis=1, dtype=np.int64), share) & (differing[:, k:].sum(axis=1, dtype=np.int64) <= bits)
    return x[good], y[good]


def small_pairs(rows: np.ndarray, run: np.ndarray, size: np.ndarray, share: tuple[int, int], bits: int) -> np.ndarray:
    """The pairs of nodes of all buckets of at most `SMALL` rows; `run` is each row's bucket, `size` each bucket's."""
    some, found = np.flatnonzero((size[run] <= SMALL) & (size[run] > 1)), [np.empty((0, 2), np.int64)]
    for shift in range(1, SMALL):
        x = some[some + shift < len(run)]
        x, y = fitting(rows, *(lambda x: (x, x + shift))(x[run[x] == run[x + shift]]), share, bits)
        found.append(np.column_stack((rows[x, 0], rows[y, 0])))
    return np.concatenate(found)


def bucket_pairs(rows: np.ndarray, whole: bool, share: tuple[int, int], bits: int) -> Iterator[np.ndarray]:
    """The pairs of nodes of a bucket; `rows` as in `fitting`."""
    t, u = share
    rows = rows[np.argsort(rows[:, 2], kind="stable")]
    node, root, n = rows[:, 0], rows[:, 1], rows[:, 2]
    sketch, prints = (np.ascontiguousarray(x).view(np.uint64) for x in (rows[:, 3 : 3 + len(SKETCH)], rows[:, 3 + len(SKETCH) :]))
    joined: dict[int, int] = {}
    # rows of a class that has nearly all of the bucket needn't be compared with each other
    values, counts = np.unique(root, return_counts=True)
    if len(values) < 2:
        return
    few = np.flatnonzero(root != values[np.argmax(counts)])
    # rows of a block have sizes not far apart
    step = max(1, min(BLOCK // len(rows), max(SMALL, len(few) // SMALL)))
    for at in range(0, len(few), step):
        i = few[at : at + step]
        low = np.searchsorted(n, -(-n[i[0]] * t // u))
        high = np.searchsorted(n, n[i[-1]] * u // t, "right")
        if prints.shape[1]:
            hit = np.bitwise_count(prints[i, None, :] ^ prints[None, low:high, :]).sum(axis=2, dtype=np.int64) <= bits
        else:
            hit = allowed(n[i, None], n[None, low:high], np.bitwise_count(sketch[i, None, :] ^ sketch[None, low:high, :]).sum(axis=2, dtype=np.int64), share)
        x, y = np.nonzero(hit & (root[i, None] != root[None, low:high]))
        x, y = fitting(rows, i[x], y + low, share, bits)
        if not whole and len(x):
            keep = joining(root[x], root[y], joined)
            x, y = x[keep], y[keep]
        if len(x):
            yield np.column_stack((node[x], node[y]))


def joining(one: np.ndarray, other: np.ndarray, joined: dict[int, int]) -> list[int]:
    """Which pairs of classes join two that weren't joined yet; `joined` keeps what is."""

    def top(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    _, first = np.unique(np.sort(np.column_stack((one, other)), axis=1), axis=0, return_index=True)
    keep = []
    for k in first.tolist():
        p, q = top(int(one[k])), top(int(other[k]))
        if p != q:
            joined[p] = q
            keep.append(k)
    return keep


def links(rows: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """`rows`: as `marked` returns. Nodes (written): h1, h2, node, least, n ...; links (a, b) of nodes whose components are
    those of all similar pairs."""
    own = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.min("row").alias("node"), F.first("n").alias("n"))
    stands = rows.select(F.col("row").alias("node"), "k1", "k2", *SKETCH, "sketch")
    nodes = io.written(own.join(stands, "node"))
    spread = rows.filter(F.size("keys") > 0).join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.explode("keys").alias("key"), F.col("row").alias("node"))
    return nodes, search(bucketed(spread), nodes, lambda pairs: verified(sketched(pairs, nodes), nodes, docs, shingle), components)


def bucketed(spread: DataFrame) -> DataFrame:
    """Written: key, node and center (the least node) of the keys that several nodes have. Of the keys that the same nodes
    have, as near copies share all of their rare tokens, one stays; two hashes of the nodes tell."""
    one = Window.partitionBy("key")
    met = spread.distinct().withColumn("center", F.min("node").over(one)).withColumn("z", F.max("node").over(one)).filter("center <> z")
    marks = {"size": F.count("*"), **{f"x{k}": F.bit_xor(F.xxhash64(F.lit(k), "node")) for k in (1, 2)}}
    # only a bucket's center carries the marks
    met = io.written(met.select("key", "node", "center", *[F.when(F.col("node") == F.col("center"), x.over(one)).alias(name) for name, x in marks.items()]))
    chosen = met.filter("node = center").groupBy("center", *marks).agg(F.min("key").alias("key")).select("key")
    return io.written(met.select("key", "node", "center").join(chosen, "key", "left_semi"))


def search(
    buckets: DataFrame, nodes: DataFrame, tested_good: Callable[[DataFrame], DataFrame], classed_by: Callable[[DataFrame], DataFrame],
    share: tuple[int, int] = SHARE, prints: tuple[str, ...] = (), bits: int = 0,
) -> DataFrame:
    """Links whose components are those of all pairs (a, b) that share a bucket and that `tested_good` returns. `nodes`: node, n,
    SKETCH and fingerprints (`prints`), which `bits` bounds the distance of; `classed_by`: components of links."""
    tested = io.checkpointed(buckets.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct())
    found = tested_good(tested)
    for whole in (False, True):
        roots = classed_by(found)
        found = stars(roots)
        classed = buckets.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        spans = classed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"))
        # the two nodes of a bucket of two have been compared; buckets above BUCKET are cut into chunks, and a node meets every chunk
        parts = F.ceil(F.col("size") / F.lit(BUCKET)).cast("int")
        mixed = io.checkpointed(spans.filter("lo <> hi AND size > 2").select("key", parts.alias("parts")))
        mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda d: F.least(mine, d) * F.col("parts") + F.greatest(mine, d))
        rows_ = classed.join(mixed, "key").join(nodes.select("node", "n", *SKETCH, *prints), "node").withColumn("chunk", F.explode(met))
        if whole:
            # near copies meet in many buckets: all of a node's keys tell the first one of a pair
            listed = classed.join(mixed, "key").groupBy("node").agg(F.collect_list("key").alias("all_keys"))
            rows_ = rows_.join(listed, "node").withColumn("earlier", F.filter("all_keys", lambda k: k < F.col("key")))
        pairs = (
            rows_.select("key", F.col("chunk").cast("long").alias("chunk"), "node", "root", F.col("n").cast("long").alias("n"), *SKETCH, *prints, *(["earlier"] if whole else []))
            .repartition("key", "chunk")
            .sortWithinPartitions("key", "chunk")
            .mapInArrow(lambda batches, whole=whole: across(batches, whole, share, prints, bits), "a long, b long")
            .distinct()
            .join(tested, ["a", "b"], "left_anti")
        )
        pairs = io.checkpointed(pairs)
        found = found.unionByName(tested_good(pairs))
        tested = tested.unionByName(pairs)
    return found


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    rows = marked(docs, shingle)
    nodes, found = links(rows, docs, shingle)
    roots = components(found)
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").filter("n > 0").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "component_id")
    return rows.join(named, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(io.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) END AS s FROM d),
kinds AS (SELECT row_number() OVER () AS k, s, len(s) AS n, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT k, n, unnest(s) AS token FROM kinds),
counts AS (SELECT x.k AS a, y.k AS b, count(*) AS common FROM tokens x JOIN tokens y ON x.token = y.token AND x.k < y.k AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n) GROUP BY x.k, y.k),
links AS (SELECT a, b FROM counts JOIN kinds x ON x.k = a JOIN kinds y ON y.k = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT k AS a, k AS b FROM kinds UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
named AS (SELECT reach.a AS k, min(kinds.least) AS component_id FROM reach JOIN kinds ON kinds.k = reach.b GROUP BY reach.a)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE named.component_id END AS component_id
FROM sets LEFT JOIN kinds ON kinds.s = sets.s LEFT JOIN named ON named.k = kinds.k
"""
