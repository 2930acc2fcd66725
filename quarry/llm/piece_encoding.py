"""Operator 2, SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units that no piece crosses: at every blank, and between two characters that no piece holds side by
side. Each distinct unit is encoded once:

- lattice: substrings up to the longest piece are exploded and joined by equality with the piece table; the edges found
  are grouped by unit. A single character is an edge between its two places without a row of its own;
- path: a forward fold over a unit's edges in order of their ends keeps one last edge for each prefix; a backward fold
  reads the path. Byte-pair models fold all units of a record batch at once, place by place.

For unigram models the fold is Viterbi's: it keeps the best sum of scores of each prefix. For byte-pair models, as the
public piece file is one, it has that shape but sums no scores, which are ranks of merges there; the path of the best sum
isn't the one that merging gives. It admits an edge after a prefix's last edge only
if no merge across their border would have come first: an edge of the lattice that crosses the border, made of a suffix
of the one and a prefix of the other that both exist while merging, with a better rank than what they become part of.
Exactly one edge passes for each prefix, and the path is the tokenizer's own.

Documents are taken in blocks of the scan, `BLOCK_BYTES` of text or one document more. One pass gives each block's
distinct units, another the packed texts; both go to the block's partition, sorted so that a block's units come first, and
its texts stream past them. What a task holds is one block's units and one slice of text. Should the two passes see
different blocks (an input whose order changes between two reads), a unit that a block lacks is merged where it stands,
with the same result. So are blanks before a blank, which merge last and from the left.

A unit of more than `LONG` characters, a run of letters that all join, doesn't enter the lattice: its characters are merged
by a queue in the task that holds its block, in time that grows with its length and the logarithm of it.

Decoding joins pieces and bytes and drops the first blank. It gives the text back but for the character U+2581, which
stands for a blank, and malformed bytes.

Defined results: a null or empty text has no pieces and decodes to the empty text; ids may be null and of any type;
repeated rows get equal results; other columns are ignored; an empty table gives an empty result. Unknown characters
become bytes.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import io
from quarry.llm.text import ranges_of, steps

BLANK = "▁"
#: Bytes of text in a block, and for each partition of the units.
BLOCK_BYTES, UNIT_BYTES = 32_000_000, 8_000_000
#: Most partitions of the units; beyond, they grow and spill.
MOST_PARTITIONS = 20_000
#: Partitions of the units of a smaller corpus, if it has as many times `FEW_BYTES` of text. It has more distinct units for
#: its size, and a task sorts the edges of all its units at once.
FEW_PARTITIONS, FEW_BYTES = 96, 1_000_000
#: Level of compression of the texts that wait for their units.
PACKED = 6
#: Characters of a unit in the lattice at most.
LONG = 64
#: Words that a task holds until it looks for their units.
SEEN = 100_000
#: Characters that are cut into units at once.
CUT = 1 << 18
#: Pairs of unit and block that a task packs at once.
DEALT = 200_000
#: Of the units that are folded at once, the sum of the squares of their numbers of edges (or one unit).
FOLDED = 1_000_000
#: A piece table up to this many rows is broadcast.
BROADCAST_PIECES = 1_000_000
#: Of a single character: no merge precedes it.
NEVER = 2**31 - 1


def model_path() -> str:
    """The public piece file of the box; any SentencePiece byte-pair model with byte fallback will do."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model, with the merges that make each of them, or the scores of a `unigram` model. Of the latter, every
    character that is inside a piece has to be one itself, and no piece may be of several blanks."""

    def __init__(self, path: str, unigram: bool = False):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        own = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in own}
        #: what each id decodes to
        self.decoded = [b""] * n
        for i in own:
            self.decoded[i] = text[i].replace(BLANK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.decoded[i] = bytes([b])
        #: runs of blanks by length
        self.blanks = {len(t): i for i, t in text.items() if set(t) == {BLANK}}
        self.rank = {t: int(-model.get_score(i)) for i, t in text.items() if len(t) == 1 or set(t) != {BLANK}}
        self.id = {t: i for i, t in text.items()}
        self.unigram, self.score = unigram, {t: model.get_score(i) for i, t in text.items()}
        if unigram and (max(self.blanks, default=0) != 1 or any(c not in self.id for t in self.id for c in t)):
            raise ValueError("a unigram model needs a piece for each character, and none of several blanks")
        self.longest = max(map(len, self.rank))
        #: characters that stand side by side in some piece; a blank only begins one
        self.pairs = {t[k : k + 2] for t in self.rank for k in range(len(t) - 1) if t[k + 1] != BLANK}

    @cached_property
    def beside(self) -> tuple[np.ndarray, int, np.ndarray]:
        """The number of each code point among those of the pairs (0: it is in none), how many numbers there are, and a bit for
        each two of them: whether they are a pair."""
        chars = sorted({ord(c) for pair in self.pairs for c in pair})
        numbers, n = np.zeros(0x110000, np.int32), len(chars) + 1
        numbers[chars] = np.arange(1, n)
        at = np.array([int(numbers[ord(a)]) * n + int(numbers[ord(b)]) for a, b in self.pairs], np.int64)
        bits = np.zeros(n * n // 8 + 1, np.uint8)
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return numbers, n, bits

    def ends(self, text: str) -> np.ndarray:
        """Where the units of a text with `BLANK` for each blank end."""
        (numbers, n, bits), out = self.beside, []
        for at in range(0, len(text) - 1, CUT):
            kinds = numbers[np.frombuffer(text[at : at + CUT + 1].encode("utf-32-le"), "<u4")].astype(np.int64)
            pair = kinds[:-1] * n + kinds[1:]
            out.append(np.flatnonzero(bits[pair >> 3] >> (pair & 7) & 1 ^ 1) + at + 1)
        return np.concatenate([*out, [len(text)]])

    def best(self, unit: str) -> list[int]:
        """The ids of the path with the best sum of scores (32-bit floats); of equal ones the longest last piece."""
        if len(unit) == 1:
            return [self.id[unit]] if unit in self.id else [self.bytes[b] for b in unit.encode()]
        sums, last = [np.float32(0)] + [np.float32(-np.inf)] * len(unit), [0] * (len(unit) + 1)
        for e in range(1, len(unit) + 1):
            for s in range(max(0, e - self.longest), e):
                if (p := unit[s:e]) in self.score and (total := sums[s] + np.float32(self.score[p])) > sums[e]:
                    sums[e], last[e] = total, s
        out, e = [], len(unit)
        while e:
            out.append(self.id[unit[last[e] : e]])
            e = last[e]
        return out[::-1]

    def merged(self, unit: str) -> list[int]:
        """The ids that merging gives: the best rank first, of equal ones the leftmost."""
        if self.unigram:
            return self.best(unit)
        n, rank, part = len(unit), self.rank, list(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank[p], k, p) for k in range(n - 1) if (p := unit[k : k + 2]) in rank]
        heapq.heapify(queue)
        while queue:
            _, k, p = heapq.heappop(queue)
            right = after[k]
            # a part that was merged away is empty
            if not part[k] or right == n or part[k] + part[right] != p:
                continue
            part[k], part[right] = p, ""
            after[k] = right = after[right]
            if right < n:
                before[right] = k
                if (q := p + part[right]) in rank:
                    heapq.heappush(queue, (rank[q], k, q))
            if (left := before[k]) >= 0 and (q := part[left] + p) in rank:
                heapq.heappush(queue, (rank[q], left, q))
        out: list[int] = []
        for p in filter(None, part):
            out += [self.id[p]] if p in rank else [self.bytes[b] for b in p.encode()]
        return out

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merge into a piece last; None if merging its characters doesn't give the piece."""
        parts, last = list(piece), None
        while len(parts) > 1:
            merges = [(self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank]
            if not merges:
                return None
            _, k = min(merges)
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return last

    @cached_property
    def lengths(self) -> np.ndarray:
        """Characters that each id decodes to."""
        return np.array([len(x.decode(errors="replace")) for x in self.decoded], np.int64)

    def rows(self) -> list[tuple]:
        """(piece, id, rank, prefixes, suffixes) of each piece that merging makes: under the length of each prefix
        (suffix) that it makes on the way stands the rank of the merge that ends it; 0 for other lengths."""
        split = {t: self.split(t) for t in self.rank if len(t) > 1}
        out = []
        for t, parts in split.items():
            if parts is None:
                continue
            sides = []
            for side in (0, 1):
                ends, now, until = [0] * (len(t) + 1), t, NEVER
                while True:
                    ends[len(now)] = until
                    if len(now) == 1:
                        break
                    until, now = self.rank[now], split[now][side]
                sides.append(ends)
            out.append((t, self.id[t], self.rank[t], *sides))
        return out

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By id the rank, and where its prefixes and suffixes begin in the lists of all; these two lists."""
        rows = self.rows()
        rank, at = np.zeros(len(self.decoded), np.int64), np.zeros(len(self.decoded), np.int64)
        ids = [row[1] for row in rows]
        rank[ids] = [row[2] for row in rows]
        at[ids] = np.cumsum([0, *(len(row[3]) for row in rows)])[:-1]
        return rank, at, *(np.array([x for row in rows for x in row[side]], np.int32) for side in (3, 4))

    @cached_property
    def single(self) -> np.ndarray:
        """The id of each code point that is a piece, else -1."""
        out = np.full(0x110000, -1, np.int32)
        for t, i in self.id.items():
            if len(t) == 1:
                out[ord(t)] = i
        return out


def best_paths(units: DataFrame, pieces: Pieces) -> DataFrame:
    """unit and ids of the distinct units, by the scores of a unigram model: the lattice's path with the best sum."""
    rows = [(t, pieces.id[t], pieces.score[t]) for t in pieces.rank]
    table = units.sparkSession.createDataFrame(rows, "piece string, id int, score float").withColumn("key", F.xxhash64("piece"))
    edges = (
        units.filter("length(unit) > 1")
        .select("unit", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s"))
        .select("unit", "s", F.explode(F.expr(f"sequence(1, least({pieces.longest}, length(unit) - s))")).alias("size"))
        .withColumn("part", F.expr("substring(unit, s + 1, size)"))
        .withColumn("key", F.xxhash64("part"))
        .join(F.broadcast(table) if len(rows) <= BROADCAST_PIECES else table, "key")
        .filter("piece >= part AND piece <= part")
        .select("unit", F.struct((F.col("s") + F.col("size")).alias("e"), "s", "id", "score").alias("edge"))
    )
    lattice = edges.groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    # edges come in order of their ends, then of their starts: of equal sums the first stays
    forward = F.expr("""
        aggregate(
          transform(edges, (y, i) -> named_struct('y', y, 'i', i)),
          named_struct('sums', transform(sequence(0, length(unit)), k -> if(k = 0, float(0), float('-infinity'))), 'best', array_repeat(-1, length(unit) + 1)),
          (now, n) -> if(now.sums[n.y.s] + n.y.score > now.sums[n.y.e],
            named_struct('sums', transform(now.sums, (x, k) -> if(k = n.y.e, now.sums[n.y.s] + n.y.score, x)), 'best', transform(now.best, (x, k) -> if(k = n.y.e, n.i, x))),
            now),
          now -> now.best)
    """)
    backward = F.expr("""
        aggregate(
          sequence(1, length(unit)),
          named_struct('at', length(unit), 'ids', cast(array() as array<int>)),
          (path, k) -> if(path.at = 0, path, named_struct('at', edges[best[path.at]].s, 'ids', array_append(path.ids, edges[best[path.at]].id))),
          path -> reverse(path.ids))
    """)
    return lattice.withColumn("best", forward).select("unit", backward.alias("ids"))


def lattices(units: DataFrame, pieces: Pieces) -> DataFrame:
    """unit and edges of the distinct units that hold a piece of two or more characters, in order of their ends and then of
    their starts. An edge is its end, its start and the id of its piece, in 8, 8 and 32 bits. `units` is partitioned by
    unit, and nothing here shuffles."""
    rows = [row[:2] for row in pieces.rows()]
    columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate([pa.string(), pa.int32()])]
    table = units.sparkSession.createDataFrame(pa.table(columns, ["piece", "id"]))
    # a join on one number is far cheaper than one on strings; the strings are compared after it
    table = table.withColumn("key", F.xxhash64("piece"))
    edges = (
        units.filter("length(unit) > 1")
        .select("unit", F.explode(F.sequence(F.lit(0), F.length("unit") - 2)).alias("s"))
        .select("unit", "s", F.explode(F.expr(f"sequence(2, least({pieces.longest}, length(unit) - s))")).alias("size"))
        .withColumn("part", F.expr("substring(unit, s + 1, size)"))
        .withColumn("key", F.xxhash64("part"))
        .join(F.broadcast(table) if len(rows) <= BROADCAST_PIECES else table, "key")
        # equality, in words that don't make it a second join key
        .filter("piece >= part AND piece <= part")
        .select("unit", F.expr("shiftleft(bigint(s + size), 40) + shiftleft(bigint(s), 32) + id").alias("edge"))
    )
    return edges.groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def paths(pieces: Pieces, units: pa.Array, edges: pa.Array) -> pa.Array:
    """The ids of each unit of a byte-pair model, from its edges."""
    weight = np.cumsum(edges.value_lengths().to_numpy().astype(np.int64) ** 2)
    out, first = [], 0
    while first < len(units):
        last = max(first + 1, int(np.searchsorted(weight, (weight[first - 1] if first else 0) + FOLDED, "right")))
        out.append(_paths(pieces, units[first:last].to_pylist(), edges[first:last]))
        first = last
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


def _paths(pieces: Pieces, units: list[str], edges: pa.Array) -> pa.Array:
    rank, at, prefixes, suffixes = pieces.merges
    packed = edges.flatten().to_numpy()
    end, start, ids = packed >> 40, packed >> 32 & 255, packed & 0xFFFFFFFF
    unit = np.repeat(np.arange(len(units)), edges.value_lengths().to_numpy())
    size = np.array([len(x) for x in units])
    width = int(size.max())
    # what may keep out an edge n: an edge c that crosses its start and ends inside of it, with a better rank than what the
    # prefix of n that c takes becomes part of
    key = unit << 8 | end
    low = np.searchsorted(key, unit << 8 | start, "right")
    some = np.where(start > 0, np.searchsorted(key, key, "right") - low, 0)
    n, c = np.repeat(np.arange(len(end)), some), np.repeat(low, some) + ranges_of(some)
    crosses = start[c] < start[n]
    n, c = n[crosses], c[crosses]
    first = rank[ids[c]] <= prefixes[at[ids[n]] + end[c] - start[n]]
    n, c = n[first], c[first]
    # forward: for each place the number of the edge that ends there, -1 for the single character
    best, out = np.full((len(units), width + 1), -1), np.zeros(len(end), bool)
    places = np.arange(width + 2)
    edge, pair = np.argsort(end, kind="stable"), np.argsort(end[n], kind="stable")
    n, c = n[pair], c[pair]
    upto, pairs_upto = np.searchsorted(end[edge], places), np.searchsorted(end[n], places)
    for place in range(2, width + 1):
        here, x, y = edge[upto[place] : upto[place + 1]], *(v[pairs_upto[place] : pairs_upto[place + 1]] for v in (n, c))
        before = best[unit[x], start[x]]
        # the last edge of the prefix has to hold the start of c, and to have a suffix from there on while c's rank comes
        holds = start[y] >= np.where(before < 0, start[x] - 1, start[before])
        x, y, before = x[holds], y[holds], before[holds]
        until = np.where(before < 0, NEVER, suffixes[at[ids[before]] + start[x] - start[y]])
        out[x[rank[ids[y]] < until]] = True
        # of several the longest, which is written last
        free = here[~out[here]][::-1]
        best[unit[free], place] = free
    # backward
    codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
    begin, now, path, taken = np.cumsum(size) - size, size.copy(), np.zeros((len(units), width), np.int32), np.zeros(len(units), np.int64)
    live = np.arange(len(units))
    while len(live):
        place = now[live]
        last = best[live, place]
        path[live, width - 1 - taken[live]] = np.where(last < 0, pieces.single[codes[begin[live] + place - 1]], ids[last])
        taken[live] += 1
        now[live] = np.where(last < 0, place - 1, start[last])
        live = live[now[live] > 0]
    flat = path[np.arange(width) >= width - taken[:, None]]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(taken))), pa.int32()), pa.array(flat, pa.int32()))


def unit_partitions(total: int, least: int) -> int:
    """Partitions of the units of `total` bytes of text."""
    return max(least, min(FEW_PARTITIONS, -(-total // FEW_BYTES)), min(MOST_PARTITIONS, -(-total // UNIT_BYTES)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the scan with the number of their block. `part` is the partition of the scan, which isn't the task's
    own number where the scan runs under a union."""
    block, size = -1, 0
    for batch in steps(batches):
        if block < 0:
            block = batch.column("part")[0].as_py() << 24
        if size >= BLOCK_BYTES:
            block, size = block + 1, 0
        size += batch.column("text").nbytes
        yield block, batch


def _packed(blocks: np.ndarray, ids: np.ndarray, sizes: np.ndarray, wide: bool) -> Iterator[tuple[int, bytes]]:
    """The units of each block, packed: their number, the length of each and their ids."""
    order = np.argsort(blocks, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    blocks, sizes = blocks[order], sizes[order]
    ends = np.cumsum(sizes)
    ids = ids[np.repeat(begin - (ends - sizes), sizes) + np.arange(len(ids))].astype("<u4" if wide else "<u2")
    edges = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(blocks)).tolist(), strict=True):
        part = ids[ends[a] - sizes[a] : ends[b - 1]]
        body = (b - a).to_bytes(4, "little") + sizes[a:b].astype(np.uint8).tobytes() + part.tobytes()
        yield int(blocks[a]), zstandard.ZstdCompressor(level=3).compress(body)


class Block:
    """The coded units of a block, and the ids of texts made of them."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.lengths = pieces.lengths
        self.wide = len(pieces.decoded) > 1 << 16
        self.lone = np.int32(pieces.blanks[1]).tobytes()
        #: by word, without the blank before it; and by unit, of those that no blank begins
        self.words: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def add(self, packed: bytes) -> None:
        body = zstandard.ZstdDecompressor().decompress(packed)
        n = int.from_bytes(body[:4], "little")
        sizes = np.frombuffer(body, np.uint8, n, 4)
        ids = np.frombuffer(body, "<u4" if self.wide else "<u2", -1, 4 + n)
        last = np.cumsum(sizes, dtype=np.int64)
        # a unit is what its ids decode to, so it isn't named
        names = b"".join(map(self.pieces.decoded.__getitem__, ids.tolist())).decode()
        upto = np.concatenate(([0], np.cumsum(self.lengths[ids])))[last].tolist()
        raw, at, begin = ids.astype(np.int32).tobytes(), 0, 0
        words, inner = self.words, self.inner
        for a, b in zip(upto, (4 * last).tolist(), strict=True):
            if names[at] == " ":
                words[names[at + 1 : a]] = raw[begin:b]
            else:
                inner[names[at:a]] = raw[begin:b]
            at, begin = a, b

    def found(self, table: dict[str, bytes], blank: str, units: list[str]) -> Iterator[bytes]:
        """The ids of units of a table; what the lattice didn't have is merged here."""
        ids = list(map(table.get, units))
        if None in ids:
            for unit in {unit for unit, x in zip(units, ids, strict=True) if x is None}:
                table[unit] = np.array(self.pieces.merged(blank + unit), np.int32).tobytes()
            ids = map(table.__getitem__, units)
        return iter(ids)

    def learn(self, new: set[str]) -> None:
        """Puts words together of their units."""
        if not new:
            return
        text = BLANK + BLANK.join(new)
        ends = self.pieces.ends(text)
        begin = np.append(0, ends[:-1])
        # where each word begins, at its blank
        at = np.cumsum([0, *map(len, new)])[:-1] + np.arange(len(new))
        first = np.searchsorted(begin, at)
        rest = np.delete(np.arange(len(begin)), first)
        lead = self.found(self.words, BLANK, [text[a:b] for a, b in zip((at + 1).tolist(), ends[first].tolist(), strict=True)])
        others = self.found(self.inner, "", [text[a:b] for a, b in zip(begin[rest].tolist(), ends[rest].tolist(), strict=True)])
        for word, ids, n in zip(new, lead, np.diff(np.append(first, len(begin))).tolist(), strict=True):
            self.words[word] = ids if n == 1 else ids + b"".join(islice(others, n - 1))

    def run(self, k: int) -> bytes:
        """A run of blanks: the longest pieces from the left."""
        out, longest = [], max(self.pieces.blanks)
        while k > 0:
            out.append(self.pieces.blanks[min(k, longest)])
            k -= min(k, longest)
        return np.array(out, np.int32).tobytes()

    def with_runs(self, own: list[str]) -> bytes:
        """Of words with blanks in a row: a run takes in the blank that its next word leaves alone."""
        parts, wait = [], 0
        for word in own:
            if not word:
                wait += 1
                continue
            ids = self.words[word]
            if wait and ids[:4] == self.lone:
                parts.append(self.run(wait + 1))
                ids = ids[4:]
            elif wait:
                parts.append(self.run(wait))
            parts.append(ids)
            wait = 0
        return b"".join([*parts, self.run(wait)])

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        texts = [text.replace(BLANK, " ") for text in texts]
        owns = [text.split(" ") for text in texts]
        self.learn(set().union(*owns).difference(self.words))
        word, out = self.words.__getitem__, []
        for text, own in zip(texts, owns, strict=True):
            if not text:
                out.append(b"")
            elif text[0] == " " or "  " in text:
                out.append(self.with_runs(own))
            else:
                out.append(b"".join(map(word, own)))
        return out


def decoded_texts(ids: np.ndarray, sizes: np.ndarray, decoded: pa.Array) -> list[str]:
    """The texts of lists of ids, one after the other, of `sizes` ids each. `decoded`: the bytes of each id."""
    taken = decoded.take(pa.array(ids))
    _, ends, data = taken.buffers()
    data = memoryview(data if data is not None else b"")
    at = np.frombuffer(ends, np.int32, len(ids) + 1)[np.concatenate(([0], np.cumsum(sizes)))].tolist() if len(ids) else [0] * (len(sizes) + 1)
    # without the first blank
    return [str(data[a + 1 : b], "utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def encode(docs: DataFrame, path: str | None = None, whole: bool = True, unigram: bool = False) -> DataFrame:
    """doc_id, n_pieces, pieces (ids), pieces_sha256 (of the ids as little-endian 32-bit integers), decoded (text) and
    lossless (whether the text came back) of every document; `whole` false leaves pieces and decoded null. `unigram` says
    that the model at `path` is one."""
    spark, pieces = docs.sparkSession, Pieces(path or model_path(), unigram)
    io.small_batches(spark)
    if not unigram:
        # made here, once
        _ = pieces.merges
    # plain values, which a worker reads once and not with every task
    state = spark.sparkContext.broadcast(vars(pieces))

    def shared() -> Pieces:
        own = object.__new__(Pieces)
        own.__dict__ = state.value
        return own

    rows = io.texts(docs, "doc_id").withColumn("part", F.spark_partition_id())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared()

        def gather(found: set[str], seen: set[str]) -> None:
            """Adds the units of the words seen, which are then forgotten."""
            words = list(seen)
            seen.clear()
            for at in range(0, len(words), 20_000):
                text = BLANK + BLANK.join(words[at : at + 20_000])
                ends = pieces.ends(text)
                begin = np.append(0, ends[:-1])
                # a single character has no lattice, and long runs are merged where they stand
                own = (ends - begin > 1) & (ends - begin <= LONG)
                found.update([text[a:b] for a, b in zip(begin[own].tolist(), ends[own].tolist(), strict=True)])

        def rows_of(block: int, found: set[str]) -> Iterator[pa.RecordBatch]:
            units = iter(found)
            while some := list(islice(units, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(np.full(len(some), block))], ["unit", "block"])
            found.clear()
            io.release()

        io.release()
        seen: set[str] = set()
        found: set[str] = set()
        now = None
        for block, batch in _blocks(batches):
            if now is not None and block != now:
                gather(found, seen)
                yield from rows_of(now, found)
                found = set()
            now = block
            for text in batch.column("text").to_pylist():
                seen.update(text.split(" "))
            if len(seen) > SEEN:
                gather(found, seen)
        if now is not None:
            gather(found, seen)
            yield from rows_of(now, found)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        io.release()
        for block, batch in _blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.select(["doc_id", "text"]).schema) as out:
                out.write_batch(batch.select(["doc_id", "text"]))
            yield _payload([(block, zstandard.ZstdCompressor(level=PACKED).compress(sink.getvalue()))], True)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, wide = shared(), len(state.value["decoded"]) > 1 << 16
        held: list[tuple[pa.Array, pa.Array]] = []

        def flush() -> pa.RecordBatch:
            lists = pa.concat_arrays([x[1] for x in held])
            blocks = np.concatenate([x[0].to_numpy() for x in held])
            return _payload(list(_packed(blocks, lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), wide)), False)

        for batch in batches:
            if batch.num_rows:
                ids = batch.column(2)
                if not pieces.unigram:
                    # a unit's rows come one after the other
                    units = batch.column(1)
                    new = np.append(True, pc.not_equal(units[1:], units[:-1]).to_numpy(zero_copy_only=False))
                    rows = pa.array(np.flatnonzero(new))
                    ids = paths(pieces, units.take(rows), ids.take(rows)).take(pa.array(np.cumsum(new) - 1))
                held.append((batch.column(0), ids))
            if sum(len(x[0]) for x in held) >= DEALT:
                yield flush()
                held = []
        if held:
            yield flush()
        io.release()

    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    least = spark.sparkContext.defaultParallelism
    parts = unit_partitions(total, least)
    # each block names a unit once, so combining before the exchange would gain nothing
    seen = rows.mapInArrow(io.releasing(cut), "unit string, block long").repartition(parts, "unit")
    distinct = seen.groupBy("unit").agg(F.count("block").alias("n")).filter("n > 0").select("unit")
    coded = best_paths(distinct, pieces) if unigram else lattices(distinct, pieces)
    dealt = seen.join(coded.hint("merge"), "unit").select("block", *coded.columns).mapInArrow(io.releasing(deal), "block long, text boolean, payload binary")
    packed = rows.mapInArrow(io.releasing(pack), "block long, text boolean, payload binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = Block(shared()), None
        table = pa.array(state.value["decoded"], pa.binary())
        io.release()
        for batch in batches:
            for i in range(batch.num_rows):
                number, is_text = batch.column("block")[i].as_py(), batch.column("text")[i].as_py()
                payload = batch.column("payload")[i].as_py()
                if number != now:
                    block = None
                    io.release()
                    block, now = Block(shared()), number
                if not is_text:
                    block.add(payload)
                    continue
                for docs_ in pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)):
                    yield answer(block, docs_, table)

    def answer(block: Block, batch: pa.RecordBatch, table: pa.Array) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        raws = block.encoded(texts)
        sizes = np.array([len(x) // 4 for x in raws], np.int64)
        ids = np.frombuffer(b"".join(raws), np.int32)
        back = decoded_texts(ids, sizes, table)
        same = [x == y for x, y in zip(back, texts, strict=True)]
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))
        columns = [
            batch.column("doc_id"),
            pa.array(sizes),
            listed if whole else pa.nulls(len(raws), listed.type),
            pa.array([hashlib.sha256(x).hexdigest() for x in raws], pa.string()),
            pa.array(back if whole else [None] * len(back), pa.string()),
            pa.array(same, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "pieces", "pieces_sha256", "decoded", "lossless"])

    return (
        dealt.unionByName(packed)
        .repartition(max(least, min(MOST_PARTITIONS, -(-2 * total // BLOCK_BYTES))), "block")
        # a block's units before its texts
        .sortWithinPartitions("block", "text")
        .mapInArrow(
            io.releasing(build), f"doc_id {kind}, n_pieces long, pieces array<int>, pieces_sha256 string, decoded string, lossless boolean"
        )
    )


def _payload(rows: list[tuple[int, bytes]], is_text: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in rows], pa.int64()), pa.array([is_text] * len(rows), pa.bool_()), pa.array([x[1] for x in rows], pa.binary())],
        ["block", "text", "payload"],
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(io.table(spark, sf_dir, "documents"), whole=False).select(
        "doc_id", "n_pieces", "pieces_sha256", "lossless"
    )
