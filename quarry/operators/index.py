"""Incremental index maintenance as a comparison of two listings.

`scan`: path, size, mtime, hash of the files found; `known`: the same of the files indexed, with skipped (a reason or
null). One full outer join classifies every file; content is compared only where size or time differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan(scan: DataFrame, known: DataFrame) -> DataFrame:
    """path and action: unchanged, touched (same content, new time), added, updated or removed."""
    s, k = scan.alias("s"), known.alias("k")
    same_stat = (F.col("s.size") == F.col("k.size")) & (F.col("s.mtime") == F.col("k.mtime"))
    same_text = (F.col("s.hash") == F.col("k.hash")) & F.col("k.skipped").isNull()
    action = (
        F.when(F.col("s.path").isNull(), "removed")
        .when(F.col("k.path").isNull(), "added")
        .when(same_stat, "unchanged")
        .when(same_text, "touched")
        .when(F.col("k.skipped").isNotNull(), "added")
        .otherwise("updated")
    )
    joined = s.join(k, F.col("s.path") == F.col("k.path"), "full_outer")
    return joined.select(F.coalesce("s.path", "k.path").alias("path"), action.alias("action"))


def report(planned: DataFrame) -> DataFrame:
    """The counters of a run, in one row."""
    n = lambda *of: F.count_if(F.col("action").isin(*of))
    return planned.agg(
        F.count_if(F.col("action") != "removed").alias("files"),
        n("added").alias("added"),
        n("updated").alias("updated"),
        n("unchanged", "touched").alias("unchanged"),
        n("removed").alias("removed"),
    )


def staleness(scan: DataFrame, known: DataFrame) -> DataFrame:
    """What a run would find by size and time alone, in one row."""
    s, k = scan.alias("s"), known.alias("k")
    joined = s.join(k, F.col("s.path") == F.col("k.path"), "full_outer")
    differs = (F.col("s.size") != F.col("k.size")) | (F.col("s.mtime") != F.col("k.mtime"))
    out = joined.agg(
        F.count_if(F.col("k.path").isNull()).alias("added"),
        F.count_if(F.coalesce(differs, F.lit(False))).alias("modified"),
        F.count_if(F.col("s.path").isNull()).alias("removed"),
    )
    return out.withColumn("is_stale", F.col("added") + F.col("modified") + F.col("removed") > 0)


def _counted(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(f"1 {one}")).when(n > 1, F.concat(n.cast("string"), F.lit(f" {many}")))


def staleness_sentence(added: Column, modified: Column, removed: Column) -> Column:
    return F.concat_ws(
        ", ",
        _counted(added, "nouveau fichier", "nouveaux fichiers"),
        _counted(modified, "fichier modifié", "fichiers modifiés"),
        _counted(removed, "fichier supprimé", "fichiers supprimés"),
    )


def replace_documents(stored: DataFrame, changed: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """Copy on write: rows of changed or removed documents go, the changed ones' new rows come."""
    gone = changed.select(*key).unionByName(removed.select(*key)).distinct()
    return stored.join(gone, key, "left_anti").unionByName(changed)


def collection_summary(collections: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that aren't skipped and chunks of each collection; empty ones show 0. Counts are made before the join."""
    docs = documents.groupBy("collection").agg(F.count_if(F.col("skipped").isNull()).alias("n_documents"))
    parts = chunks.groupBy("collection").agg(F.count("*").alias("n_chunks"), F.max("chunk_id").alias("last_chunk"))
    return collections.join(docs, "collection", "left").join(parts, "collection", "left").select(
        "collection",
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.coalesce("last_chunk", F.lit(0)).alias("last_chunk"),
    )


def collections_touched(roots: DataFrame, paths: DataFrame) -> DataFrame:
    """Collections whose root holds a changed path: each path's ancestors meet the roots by equality.

    `roots`: name, root; `paths`: path.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return paths.select(F.explode(ancestors).alias("root")).distinct().join(roots, "root").select("name").distinct()
