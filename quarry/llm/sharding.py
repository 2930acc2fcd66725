"""Operator 7, a uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in `partitions` logical partitions, by a hash of id, text and size, and of their number among equal rows (so a
retried task finds the same ones, and no id, text or group of equal rows shares a partition). Shard sizes are fixed first: row counts differ by one at most. How many rows of each partition go to each shard is drawn from the
multivariate hypergeometric distribution, one partition after the other, from what the shards still lack: the same law
that a uniform permutation of all rows would give. Each partition is then permuted locally and cut by its row of the
matrix, the rows are exchanged, and each shard is permuted again, by random keys cut into ranges so that no task sorts
a whole shard.

Only counts meet on the driver (partitions x shards integers, both parameters' bounds). Random keys are hashes of a
seed and the row, so a lost executor's rows get the same keys again. Rows that are equal in id, size and checksum are
counted first and numbered by that count: they are interchangeable.

Defined results: a null text has no bytes (size 1, crc32 0); null and repeated ids are rows like any other; an empty
table gives an empty result; columns of the input other than `doc_id` and `text` are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import io

SHARDS, SEED = 16, 20260101
#: Rows that one logical partition and one range of a shard aim at, and the most partitions (the driver's matrix).
PARTITION_ROWS, RANGE_ROWS, MOST_PARTITIONS = 100_000, 100_000, 1 << 16
#: Populations from here on are beyond numpy's sampler.
SAMPLER_LIMIT = 1_000_000_000
#: Equal rows that one task numbers at most.
COPIES = 10_000


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows for each partition and shard; column sums differ by one at most."""
    random, total = np.random.default_rng(seed), sum(counts)
    left = np.full(shards, total // shards, np.int64)
    left[random.permutation(shards)[: total % shards]] += 1
    matrix = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        # one conditional draw after the other
        rest, need = int(left.sum()), n
        for s in range(shards):
            rest -= int(left[s])
            take = hypergeometric(random, int(left[s]), rest, need)
            matrix[p, s] = take
            need -= take
        left -= matrix[p]
    return matrix


def hypergeometric(random: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among draws without replacement."""
    if not draws or not good:
        return 0
    if not bad:
        return draws
    if good + bad < SAMPLER_LIMIT:
        return int(random.hypergeometric(good, bad, draws))
    # Beyond numpy's range, the same law by inversion: probabilities relative to the mode's follow from the ratios of
    # neighbours. What lies more than 12 deviations (and 100) from the mode weighs less than a double can hold.
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    deviation = (draws * (good / total) * (bad / total) * ((total - draws) / (total - 1))) ** 0.5
    reach = int(12 * deviation) + 100
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    below = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.cumsum(np.concatenate((below[::-1], [1.0], above)))
    return mode - len(below) + int(np.searchsorted(weights, random.random() * weights[-1], "right"))


def _key(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (0, 1, ... in each shard), grown_shard (null: the law isn't `key`)."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    own = ["doc_id", "size", "text_crc32"]
    # equal rows are counted before the exchange, then numbered in runs, each in a task of its own
    runs = rows.groupBy(*own).agg(F.count("*").alias("n")).select(
        *own, "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")).alias("run")
    )
    numbered = runs.repartition(*own, "run").select(
        *own, F.explode(F.expr(f"sequence(run * {COPIES}L, least(n, (run + 1) * {COPIES}L) - 1)")).alias("copy")
    )
    total = docs.count()
    partitions = min(MOST_PARTITIONS, max(64, -(-total // PARTITION_ROWS)))
    ranges = max(1, -(-total // (shards * RANGE_ROWS)))
    # written, as the counts and the ranks are both taken from it
    homed = io.written(numbered.withColumn("home", F.pmod(_key(seed, *own, "copy"), F.lit(partitions)).cast("int")))
    counts = {r["home"]: r["count"] for r in homed.groupBy("home").count().collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(partitions)], shards, seed)
    bounds = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(matrix[p])]) for p in range(partitions)], "home int, upto array<long>"
    )
    local = Window.partitionBy("home").orderBy(_key(seed + 1, *own, "copy"), *own, "copy")
    placed = (
        homed.withColumn("rank", F.row_number().over(local) - 1)
        .join(F.broadcast(bounds), "home")  # at most MOST_PARTITIONS short rows
        .withColumn("shard", F.size(F.filter("upto", lambda x: x <= F.col("rank"))))
        .withColumn("again", _key(seed + 2, *own, "copy"))
        # the random key as a whole number below 2**53, cut into equal ranges
        .withColumn("range", (F.shiftrightunsigned("again", 11) * F.lit(ranges) / F.lit(1 << 53)).cast("int"))
        .select(*own, "copy", "shard", "range", "again")
    )
    placed = io.written(placed)
    sizes = placed.groupBy("shard", "range").count()
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    final = Window.partitionBy("shard", "range").orderBy("again", *own, "copy")
    return (
        placed.withColumn("inside", F.row_number().over(final) - 1)
        .join(offsets, ["shard", "range"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("offset") + F.col("inside")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(io.table(spark, sf_dir, "documents"))
