"""Tables of collections: what an indexing run writes, and the inventories beside them.

`documents`: collection, path, size, mtime, hash, skipped (a reason or null); `chunks`: collection, path, ordinal,
location, text. All writes are copies: rows that change are left out of the old table and united with the new ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import columns as C

KEY = ["collection", "path"]
DOCUMENT = [*KEY, "size", "mtime", "hash", "skipped"]


def write_documents(documents: DataFrame, chunks: DataFrame, new: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their passages in the place of what was there. `new`: collection, path, size, mtime, hash."""
    changed = new.select(*KEY).distinct()
    return (
        documents.select(*DOCUMENT).join(changed, KEY, "left_anti").unionByName(new.withColumn("skipped", F.lit(None).cast("string")).select(*DOCUMENT)),
        chunks.join(changed, KEY, "left_anti").unionByName(new_chunks),
    )


def write_skipped(documents: DataFrame, chunks: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that can't be read, with the reason, without a hash and without passages. `skipped`: collection, path, size,
    mtime, reason."""
    changed = skipped.select(*KEY).distinct()
    rows = skipped.select(*KEY, "size", "mtime", F.lit("").alias("hash"), F.col("reason").alias("skipped"))
    return documents.select(*DOCUMENT).join(changed, KEY, "left_anti").unionByName(rows), chunks.join(changed, KEY, "left_anti")


def touch_documents(documents: DataFrame, touched: DataFrame) -> DataFrame:
    """New times of documents whose content is the same. `touched`: collection, path, new_mtime; the latest counts."""
    latest = touched.groupBy(*KEY).agg(F.max("new_mtime").alias("new_mtime"))
    return documents.join(latest, KEY, "left").withColumn("mtime", F.coalesce("new_mtime", "mtime")).select(*documents.columns)


def remove_documents(documents: DataFrame, chunks: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = removed.select(*KEY).distinct()
    return documents.join(gone, KEY, "left_anti"), chunks.join(gone, KEY, "left_anti")


def open_collections(collections: DataFrame, documents: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collections and documents once the wanted ones exist: a new one is empty, one with another embedding model loses its
    documents and its number of dimensions. `collections`: name, root, embedding_model, dims; `wanted`: name, root, model; of
    several rows of a name the greatest root, then model, counts."""
    single = wanted.groupBy("name").agg(F.max(F.struct(F.col("root").alias("new_root"), "model")).alias("x")).select("name", "x.*")
    joined = collections.join(single, "name", "full_outer")
    reset = F.coalesce(F.col("embedding_model") != F.col("model"), F.lit(False))
    opened = joined.select(
        "name",
        F.coalesce("new_root", "root").alias("root"),
        F.coalesce("model", "embedding_model").alias("embedding_model"),
        F.when(reset | F.col("dims").isNull(), 0).otherwise(F.col("dims")).alias("dims"),
        reset.alias("reset"),
    )
    emptied = opened.filter("reset").select(F.col("name").alias("collection"))
    return opened, documents.join(emptied, "collection", "left_anti")


def set_dims(collections: DataFrame, measured: DataFrame) -> DataFrame:
    """The number of dimensions of collections that have none yet. `measured`: name, found; the greatest counts."""
    joined = collections.join(measured.groupBy("name").agg(F.max("found").alias("found")), "name", "left")
    return joined.withColumn("dims", F.when(F.col("dims") == 0, F.coalesce("found", F.lit(0))).otherwise(F.col("dims"))).select(*collections.columns)


def load_passages(chunks: DataFrame, documents: DataFrame, names: list[str]) -> DataFrame:
    """Passages of the named collections' documents that aren't skipped, by path and ordinal."""
    known = documents.filter(F.col("collection").isin(*names) & F.col("skipped").isNull()).select(*KEY)
    return chunks.join(known, KEY).orderBy("path", "ordinal")


def index_report(planned: DataFrame, skipped: DataFrame, written: DataFrame) -> DataFrame:
    """The counters of each collection's run. `planned`: collection, path, action; `skipped`: collection, path; `written`:
    the passages of the run."""
    failed = skipped.select(*KEY).distinct().withColumn("failed", F.lit(True))
    n = lambda *of: F.count_if(F.col("action").isin(*of) & F.col("failed").isNull())
    runs = planned.join(failed, KEY, "left").groupBy("collection").agg(
        F.count_if(F.col("action") != "removed").alias("files"), n("added").alias("added"), n("updated").alias("updated"),
        n("unchanged", "touched").alias("unchanged"), F.count_if(F.col("action") == "removed").alias("removed"),
        F.count_if(F.col("failed")).alias("skipped"),
    )
    passages = written.groupBy("collection").agg(F.count("*").alias("passages"))
    return runs.join(passages, "collection", "left").withColumn("passages", F.coalesce("passages", F.lit(0)))


def index_sentence(collection: Column, counts: dict[str, Column], passages: Column, reset: Column) -> Column:
    """One sentence on a run; counters that are zero aren't named, but for the files."""
    labels = {"added": "ajoutés", "updated": "modifiés", "removed": "retirés", "unchanged": "inchangés", "skipped": "ignorés"}
    named = [F.when(counts[c] > 0, F.concat(counts[c].cast("string"), F.lit(f" {label}"))) for c, label in labels.items()]
    return F.concat(
        F.lit("« "), collection, F.lit(" » indexée : "),
        F.concat_ws(", ", F.concat(counts["files"].cast("string"), F.lit(" fichiers")), *named),
        F.lit(", "), C.format_count(passages), F.lit(" passages écrits"),
        F.when(reset, F.lit(" (modèle d'embedding changé : réindexé)")).otherwise(F.lit("")),
    )


def staleness(roots: DataFrame, scan: DataFrame, known: DataFrame) -> DataFrame:
    """added, modified, removed, missing_root and is_stale of each collection, by size and time alone. A collection whose
    root is missing counts nothing. `roots`: collection, present; `scan`, `known`: collection, path, size, mtime."""
    s, k = scan.alias("s"), known.alias("k")
    joined = s.join(k, (F.col("s.collection") == F.col("k.collection")) & (F.col("s.path") == F.col("k.path")), "full_outer")
    differs = (F.col("s.size") != F.col("k.size")) | (F.col("s.mtime") != F.col("k.mtime"))
    counts = joined.groupBy(F.coalesce("s.collection", "k.collection").alias("collection")).agg(
        F.count_if(F.col("k.path").isNull()).alias("added"),
        F.count_if(F.coalesce(differs, F.lit(False))).alias("modified"),
        F.count_if(F.col("s.path").isNull()).alias("removed"),
    )
    own = lambda c: F.when(F.col("present"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    out = roots.join(counts, "collection", "left").select("collection", own("added"), own("modified"), own("removed"), (~F.col("present")).alias("missing_root"))
    return out.withColumn("is_stale", F.col("added") + F.col("modified") + F.col("removed") > 0)


def documents_selected(summary: DataFrame, names: Column) -> DataFrame:
    """How many documents the chosen collections hold together. `summary`: collection, n_documents."""
    return summary.filter(F.array_contains(names, F.col("collection"))).agg(F.coalesce(F.sum("n_documents"), F.lit(0)).alias("n_documents"))


# --- inventories of models -----------------------------------------------------------------------------------------


def listed_files(listing: Column) -> Column:
    """Single model files of a repository's listing (a JSON array): path, size (of the stored object if given), sha256."""
    kind = "array<struct<type:string,path:string,size:bigint,lfs:struct<oid:string,size:bigint>>>"
    rows = F.from_json(listing, kind)
    kept = F.filter(
        rows,
        lambda x: (F.coalesce(x["type"], F.lit("")) != "directory")
        & F.lower(x["path"]).endswith(".gguf")
        & ~x["path"].rlike(r"[/\\]")
        & ~x["path"].rlike(r"-[0-9]+-of-[0-9]+\.[^.]*$"),
    )
    stored = lambda x, value: F.when(x["lfs"]["size"] > 0, value)
    return F.transform(
        kept,
        lambda x: F.struct(
            x["path"].alias("path"),
            F.coalesce(stored(x, x["lfs"]["size"]), x["size"], F.lit(0)).alias("size"),
            F.nullif(stored(x, F.regexp_replace(x["lfs"]["oid"], "^(sha256:)+", "")), F.lit("")).alias("sha256"),
        ),
    )


def smallest_first(files: DataFrame) -> DataFrame:
    """`files`: repo, path, size."""
    return files.orderBy("size", "path")


def inventory(log: DataFrame) -> DataFrame:
    """Models on disk from a log of downloads and deletions, the newest first. `log`: repo, file, op, deleted, bytes,
    downloaded_at."""
    last = log.groupBy("repo", "file").agg(F.max(F.struct("op", "deleted", "bytes", "downloaded_at")).alias("x"))
    return last.filter("NOT x.deleted").select("repo", "file", "x.bytes", "x.downloaded_at").orderBy(F.desc("downloaded_at"), "repo", "file")


def model_rows(models: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Models on disk, then those of the catalogue whose repository isn't there yet."""
    have = models.select("repo", "file", F.lit(True).alias("downloaded"))
    rest = catalogue.join(models.select("repo").distinct(), "repo", "left_anti")
    return have.unionByName(rest.select("repo", "file", F.lit(False).alias("downloaded")))


def dominant_type(types: DataFrame) -> DataFrame:
    """The commonest tensor type of each model but 0; of equally common ones the least. `types`: model, tensor_type."""
    counts = types.filter("tensor_type <> 0").groupBy("model", "tensor_type").agg(F.count("*").alias("n"))
    order = Window.partitionBy("model").orderBy(F.desc("n"), "tensor_type")
    return counts.withColumn("place", F.row_number().over(order)).filter("place = 1").select("model", "tensor_type")


def parsed_target(target: Column, hosts: tuple[str, ...] = ()) -> Column:
    """repo, revision and file of `owner/name`, or of an address of a repository or file on one of the hosts; null if it is
    none of these."""
    plain = F.regexp_replace(F.trim(target), "^https?://", "")
    for host in hosts:
        plain = F.regexp_replace(plain, f"^{re.escape(host)}/", "")
    parts = F.filter(F.split(F.regexp_replace(plain, r"(?s)[?#].*$", ""), "/"), lambda x: x != "")
    at = lambda k: F.get(parts, F.lit(k))
    n, kind = F.size(parts), at(2)
    whole = (n == 2) | ((n == 3) & (kind == "tree"))
    tree, file = (n == 4) & (kind == "tree"), (n == 5) & kind.isin("blob", "resolve")
    return F.when(
        whole | tree | file,
        F.struct(F.concat_ws("/", at(0), at(1)).alias("repo"), F.when(tree | file, at(3)).alias("revision"), F.when(file, at(4)).alias("file")),
    )
