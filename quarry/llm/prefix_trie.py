"""Operator 11, conversation prefix trie by distributed MSD radix partitioning.

Turns (role and text) are dictionary-encoded: each distinct turn gets a number. A conversation is then a sequence of
numbers; equal sequences are one item with their members counted, so that copies cost one row. All items start in one
bucket, the root. A bucket of more than `LOCAL` items (or `LOCAL_TURNS` turns) is split by the number at its depth, after
the turns that all its items share (the common prefix of its least and greatest item) have been skipped and emitted as a
chain of nodes; a smaller one is local: it goes to one task, whose multikey quicksort (three-way by one turn at a time)
emits its nodes as it recurs. Each round is a table of the items whose bucket is still large, and rounds go on while
there are any. What subtrees sum up is added to all large buckets above by one grouping on their names.

A node is named by its smallest member and its depth. Digests of members are taken in order, streaming, so a group of
equal conversations never has to fit in memory. A conversation itself is one row of numbers, 16 bytes a turn.

Defined results: turns are ordered by turn (null first), then by the md5 of their role and text; a null role or text is
empty; rows without a conv_id belong to no conversation and are left out; an empty table has no root; other columns are
ignored; repeated rows are turns like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import io

#: Items, and their turns in all, that one task sorts at most.
LOCAL, LOCAL_TURNS = 4_000, 1_000_000
#: Conversations up to the next multiple share its first turns; the most of them, plus one.
SHARED, MOST_SHARED = 100, 6
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean, path array<string>"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as an array of (id, chars); ids are numbers of distinct turns."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
        F.length(text).cast("long").alias("chars"),
    )
    rows = io.written(rows)
    coded = io.written(rows.select("key").distinct().withColumn("id", F.monotonically_increasing_id()))
    numbered = rows.join(coded, "key")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "key", "id", "chars")
    ordered = numbered.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the one that it shares them with."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("int")


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id and turns: the first h turns of conversation c - c % 100, then the own turns after the first h."""
    base = own.filter(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("lead"))
    h = shared_turns(F.col("conv_id"))
    none = F.slice("turns", 1, 0)
    return (
        own.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED)
        .join(base, "base", "left")
        .select("conv_id", F.concat(F.slice(F.coalesce("lead", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))
    )


def ends_of(members: DataFrame) -> DataFrame:
    """item, least (conv_id), n and digest of each group of equal conversations: their ids in order, one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least, n, digest, out = None, 0, 0, None, []
        for batch in batches:
            for key, c in zip(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True), batch.column("conv_id").to_pylist(), strict=True):
                if key == now:
                    digest.update(b",%d" % c)
                    n += 1
                    continue
                if now is not None:
                    out.append((*now, least, n, digest.hexdigest()))
                now, least, n, digest = key, c, 1, hashlib.sha256(b"%d" % c)
            yield _rows(out, "k1 k2 least n ends")
            out = []
        if now is not None:
            yield _rows([(*now, least, n, digest.hexdigest())], "k1 k2 least n ends")

    one = members.select("k1", "k2", "conv_id").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
    return one.mapInArrow(run, "k1 long, k2 long, least long, n long, ends string")


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"ends": pa.string(), "ends_sha256": pa.string(), "top": pa.bool_(), "path": pa.list_(pa.string())}
    columns = list(zip(*rows, strict=True)) or [()] * len(names.split())
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.int64())) for k, c in zip(names.split(), columns, strict=True)], names.split())


def items(conversations: DataFrame) -> DataFrame:
    """One row for each distinct rebuilt conversation: least, n, ends, turns."""
    turns = rebuilt(own_turns(conversations))
    numbers = F.transform("turns", lambda t: t["id"])
    members = io.written(turns.select("conv_id", "turns", F.xxhash64(numbers).alias("k1"), F.xxhash64(F.lit(1), numbers).alias("k2")))
    ends = ends_of(members)
    return ends.join(members.select(F.col("conv_id").alias("least"), "turns"), "least").select("least", "n", "ends", "turns")


def quicksorted(turns: list[np.ndarray], chars: list[np.ndarray], least: np.ndarray, n: np.ndarray, ends: list[str], depth: int, parent: int | None) -> list[list]:
    """The nodes of a local bucket, its top (at `depth`) first: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends. Items are distinct sequences that share their first `depth` turns."""
    nodes: list[list] = []

    def node(some: np.ndarray, at: int, above: int | None) -> int:
        """Emit the node that `some` share, and find who ends there."""
        members = int(n[some].sum())
        last = int(chars[some[0]][at - 1]) if at else 0
        ending = NO_ENDS
        for i in some:
            if len(turns[i]) == at:
                ending = ends[i]
                break
        nodes.append([int(least[some].min()), at, above, members, 0, 0, (members - 1) * last, ending])
        return len(nodes) - 1

    root = node(np.arange(len(turns)), depth, None)
    up = [-1]
    # (items that go on, depth of their next turn, node above)
    stack = [(np.arange(len(turns)), depth, root)]
    while stack:
        some, at, above = stack.pop()
        if len(some) == 1:
            i = int(some[0])
            for k in range(at, len(turns[i])):
                nodes[above][4] += 1
                nodes.append([int(least[i]), k + 1, above, int(n[i]), 0, 0, (int(n[i]) - 1) * int(chars[i][k]), ends[i] if k + 1 == len(turns[i]) else NO_ENDS])
                up.append(above)
                above = len(nodes) - 1
            continue
        some = some[[len(turns[i]) > at for i in some]]
        if not len(some):
            continue
        digit = np.array([turns[i][at] for i in some])
        pivot = digit[len(digit) // 2]
        same = some[digit == pivot]
        nodes[above][4] += 1
        below = node(same, at + 1, above)
        up.append(above)
        for part, level, top in ((some[digit < pivot], at, above), (same, at + 1, below), (some[digit > pivot], at, above)):
            if len(part):
                stack.append((part, level, top))
    # each node comes after the one above it
    for k in range(len(nodes) - 1, -1, -1):
        if not nodes[k][4]:
            nodes[k][5] = 1
        if up[k] >= 0:
            nodes[up[k]][5] += nodes[k][5]
            nodes[up[k]][6] += nodes[k][6]
    for x in nodes[1:]:
        x[2] = nodes[x[2]][0]
    nodes[0][2] = parent
    return nodes


def finished(local: DataFrame) -> DataFrame:
    """The nodes of local buckets; `top` marks each bucket's highest, whose sums count for the buckets above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> list[tuple]:
            ids = [np.array([t["id"] for t in r["turns"]], np.int64) for r in held]
            chars = [np.array([t["chars"] for t in r["turns"]], np.int64) for r in held]
            least, n = (np.array([r[c] for r in held], np.int64) for c in ("least", "n"))
            made = quicksorted(ids, chars, least, n, [r["ends"] for r in held], held[0]["depth"], held[0]["parent"])
            path = held[0]["path"]
            return [(*x, k == 0, path if k == 0 else None) for k, x in enumerate(made)]

        out = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["bucket"], row["depth"]) != (held[0]["bucket"], held[0]["depth"]):
                    out += done()
                    held = []
                held.append(row)
                if len(out) > 10_000:
                    yield _rows(out, names)
                    out = []
        if held:
            out += done()
        if out:
            yield _rows(out, names)

    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256 top path"
    return local.repartition("bucket", "depth").sortWithinPartitions("bucket", "depth").mapInArrow(run, NODE)


def split(opened: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: the items of local buckets; large buckets, each with the turns that it shares; items of the latter
    with their next bucket."""
    bucket = ["bucket", "depth"]
    sizes = opened.groupBy(*bucket).agg(
        F.count("*").alias("items"),
        F.sum(F.size("turns").cast("long")).alias("all_turns"),
        F.sum("n").alias("n_convs"),
        F.min("turns").alias("lo"),
        F.max("turns").alias("hi"),
        F.first("parent").alias("parent"),
        F.first("path").alias("path"),
    )
    sizes = io.written(sizes.withColumn("large", (F.col("items") > 1) & ((F.col("items") > LOCAL) | (F.col("all_turns") > LOCAL_TURNS))))
    local = opened.join(sizes.filter("not large").select(*bucket), bucket, "left_semi")
    # equal turns of the least and the greatest item are shared by all between
    both = F.zip_with("lo", "hi", lambda x, y: F.coalesce(x["id"] == y["id"], F.lit(False)))
    length = F.coalesce(F.nullif(F.array_position(both, F.lit(False)) - 1, F.lit(-1)), F.size(both).cast("long"))
    large = sizes.filter("large").withColumn("shared", length.cast("int"))
    large = io.written(large.select(*bucket, "n_convs", "parent", "path", "shared", F.slice("lo", F.lit(1), F.col("shared")).alias("chain")))
    named = F.concat(F.col("path"), F.array(F.concat_ws(":", "bucket", "shared")))
    going = opened.join(large.select(*bucket, "shared", named.alias("below")), bucket).withColumn("next", F.get("turns", F.col("shared"))["id"])
    return local, large, going


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    root = conversations.agg(F.min(F.col("conv_id").cast("long"))).first()[0]
    above = [F.lit(root).cast("long").alias("bucket"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.array().cast("array<string>").alias("path")]
    opened = io.written(items(conversations).select("least", "n", "ends", "turns", *above))
    locals_, chains, children, ends = [], [], [], []
    while True:
        local, large, going = split(opened)
        locals_.append(local)
        if large.isEmpty():
            break
        chains.append(large)
        at = ["bucket", "shared"]
        ends.append(going.filter("next is null").select(*at, F.col("ends").alias("own_ends")))
        firsts = io.written(going.filter("next is not null").groupBy(*at, "next").agg(F.min("least").alias("child")))
        children.append(firsts.groupBy(*at).agg(F.count("*").alias("n_children")))
        opened = io.written(
            going.join(firsts, [*at, "next"]).select("least", "n", "ends", "turns", F.col("child").alias("bucket"), (F.col("shared") + 1).alias("depth"), F.col("bucket").alias("parent"), F.col("below").alias("path"))
        )
    nodes = finished(reduce(DataFrame.unionByName, locals_))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not chains:
        return nodes.select(*columns)
    nodes = io.written(nodes)
    # a large bucket's node for each turn that it shares, from its own depth to where it branches
    every = reduce(DataFrame.unionByName, chains)
    saved = lambda k: (F.col("n_convs") - 1) * F.when(k > 0, F.get("chain", k - 1)["chars"]).otherwise(F.lit(0))
    steps_ = F.transform(F.sequence("depth", "shared"), lambda k: F.struct(k.alias("k"), saved(k).alias("own")))
    every = io.written(every.withColumn("steps", steps_).withColumn("own", F.aggregate("steps", F.lit(0).cast("long"), lambda s, x: s + x["own"])))
    # what local buckets and chains sum up, for every large bucket above
    parts = nodes.filter("top").select("path", "n_leaves", "saved_tokens").unionByName(every.select("path", F.lit(0).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens")))
    sums = parts.select(F.explode("path").alias("name"), "n_leaves", "saved_tokens").groupBy("name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("under"))
    counted = reduce(DataFrame.unionByName, children)
    ending = reduce(DataFrame.unionByName, ends)
    at = ["bucket", "shared"]
    whole = (
        every.withColumn("name", F.concat_ws(":", *at))
        .join(sums, "name")
        .join(counted, at)
        .join(ending, at, "left")
        .select("*", F.explode("steps").alias("step"))
    )
    k = F.col("step.k")
    rest = F.aggregate(F.filter("steps", lambda x: x["k"] >= F.col("step.k")), F.lit(0).cast("long"), lambda s, x: s + x["own"])
    high = whole.select(
        F.col("bucket").alias("conv_id"),
        k.cast("long").alias("depth"),
        F.when(k == F.col("depth"), F.col("parent")).otherwise(F.col("bucket")).alias("parent_conv_id"),
        "n_convs",
        F.when(k == F.col("shared"), F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("under") + rest).alias("saved_tokens"),
        F.when(k == F.col("shared"), F.coalesce("own_ends", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return nodes.select(*columns).unionByName(high)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(io.table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, length(coalesce(text, '')) AS chars, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
whole AS (SELECT ids.conv_id, t.pos, t.k, t.chars FROM ids JOIN t ON t.conv_id = ids.base AND t.pos <= ids.h
  UNION ALL SELECT ids.conv_id, t.pos, t.k, t.chars FROM ids JOIN t ON t.conv_id = ids.conv_id AND t.pos > ids.h),
placed AS (SELECT conv_id, chars, row_number() OVER w AS depth, md5(string_agg(k, '') OVER w) AS path FROM whole WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
prefixes AS (SELECT conv_id, depth, path, chars, lag(path, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS above, lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last FROM placed
  UNION ALL SELECT conv_id, 0, 'root', 0, NULL, conv_id NOT IN (SELECT conv_id FROM placed) FROM ids),
nodes AS (SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, path),
kids AS (SELECT above, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
sums AS (SELECT p.path, count(*) FILTER (kids.above IS NULL) AS n_leaves, sum(n.own) AS saved_tokens
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids ON kids.above = n.path GROUP BY p.path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(kids.n_children, 0) AS BIGINT) AS n_children,
  CAST(sums.n_leaves AS BIGINT) AS n_leaves, CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums ON sums.path = n.path LEFT JOIN kids ON kids.above = n.path LEFT JOIN nodes parent ON parent.path = n.above
"""
