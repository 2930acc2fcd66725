"""Connected components by alternating large-star and small-star steps, all of them joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import io

#: Edges of a task, and tasks at least: a few edges in each of many partitions make more files than rows.
TASK_EDGES, LEAST_TASKS = 50_000, 4


def components(links: DataFrame) -> DataFrame:
    """`links` has columns a and b; returns (node, root) for every node with a link: root is the least node reachable.

    Every step keeps the components; after a logarithmic number of rounds each node points at its root. A node with very
    many links only ever contributes a minimum (combined before the shuffle) and a join on its key, which adaptive
    execution splits. Each round is cut off by a checkpoint, and only a count and a checksum reach the driver.
    """
    shuffled = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = io.checkpointed(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        tasks = max(LEAST_TASKS, -(-mark[0] // TASK_EDGES))
        dense = (lambda df, tasks=tasks: df.coalesce(tasks)) if tasks < shuffled else (lambda df: df)
        edges = dense(edges)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = dense(dense(large.filter("u <> v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = io.checkpointed(dense(dense(stars.filter("u <> v")).distinct()))
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def stars(roots: DataFrame) -> DataFrame:
    """Links (a, b) with the components that `roots` (node, root) names, one for each node that isn't a root."""
    return roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def contracted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The links (a, b) between components that `roots` (node, root) names, each as one link of their roots."""
    for side in ("a", "b"):
        named = roots.select(F.col("node").alias(side), F.col("root").alias("named"))
        links = links.join(named, side, "left").withColumn(side, F.coalesce("named", side)).drop("named")
    return links.select("a", "b").filter("a <> b").distinct()
