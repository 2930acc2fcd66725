"""An index that is kept: documents, passages, postings and vectors of a collection as one versioned set of tables.

An update compares a listing with what is indexed and writes a delta segment of each table with the rows of the documents
that changed; all of them become visible together. Rows of documents that changed later or went away stay in their
segments and are left out on reading, by the few documents that this concerns; after `merge_after` deltas an update
rewrites the rows that count. Answers are those of an index built anew, whose passages have the same keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import index, passages, postings, retrieval
from quarry.sources.versioned import Conflict, Versioned

DOCUMENTS = "path string, size long, mtime long, hash string, skipped string, content long, since long, removed boolean"
PASSAGES = "key string, path string, content long, location string, text string"
POSTINGS = "path string, content long, key string, kept boolean, size int, terms array<string>, tf array<int>"
VECTORS = "path string, content long, key string, vector array<double>"
#: Documents whose rows are left out are broadcast up to this many.
BROADCAST_ROWS = 1_000_000


class LiveIndex:
    """`embedder` and `tokens` as in retrieval and passages; every version of the tables was made with the same ones."""

    def __init__(self, spark: SparkSession, folder: str, embedder: retrieval.Embedder = retrieval.hash_vectors, tokens: int = 800, merge_after: int = 8):
        self.tables, self.embedder, self.tokens, self.merge_after = Versioned(spark, folder), embedder, tokens, merge_after

    # --- reading

    def _log_of_documents(self, version: int) -> DataFrame:
        newest = Window.partitionBy("path").orderBy(F.desc("since"))
        return self.tables.table("documents", DOCUMENTS, version).withColumn("place", F.row_number().over(newest))

    def documents(self, version: int | None = None) -> DataFrame:
        """path, size, mtime, hash, skipped and content (the version that wrote its passages)."""
        version = self.tables.version() if version is None else version
        return self._log_of_documents(version).filter("place = 1 AND NOT removed").drop("place", "removed")

    def _current(self, name: str, schema: str, version: int) -> DataFrame:
        """The rows of a table that belong to what its document is now."""
        log = self._log_of_documents(version)
        last = log.filter("place = 1").select("path", F.when(~F.col("removed"), F.col("content")).alias("now"))
        old = log.select("path", "content").distinct().join(last, "path").filter("now IS NULL OR now <> content").select("path", "content")
        n = old.count()
        rows = self.tables.table(name, schema, version)
        return rows.join(F.broadcast(old) if n <= BROADCAST_ROWS else old, ["path", "content"], "left_anti") if n else rows

    def passages(self, version: int | None = None) -> DataFrame:
        """key, path, content, location and text."""
        return self._current("passages", PASSAGES, self.tables.version() if version is None else version)

    def search(self, questions: DataFrame, **limits) -> DataFrame:
        """As `retrieval.hybrid`, over the tables as they are."""
        version = self.tables.version()
        facts = self.tables.entry(version)["facts"]
        texts = self.passages(version).select("key", F.concat_ws(" ", "path", "location").alias("source"), "text")
        own = postings.Index(
            self._current("postings", POSTINGS, version).drop("path", "content"), facts.get("n_texts", 0), facts.get("n_words", 0)
        )
        vectors = self._current("vectors", VECTORS, version).select("key", "vector")
        return retrieval.hybrid(texts, questions, embedder=self.embedder, index=own, vectors=vectors, **limits)

    # --- writing

    def update(self, scan: DataFrame, attempts: int = 3) -> dict[str, int]:
        """Bring the index to a listing: path, size, mtime, hash and text (null: nothing to index). Returns the counters of
        the run. If another writer was faster, the listing is compared again."""
        for left in range(attempts - 1, -1, -1):
            try:
                return self._update(scan)
            except Conflict:
                if not left:
                    raise
        raise ValueError("attempts must be 1 or more")

    def _update(self, scan: DataFrame) -> dict[str, int]:
        change = self.tables.begin()
        known = self.documents(change.base)
        listed = scan.select("path", "size", "mtime", "hash")
        planned = index.plan(listed, known.select("path", "size", "mtime", "hash", "skipped"))
        counters = {k: int(v) for k, v in index.report(planned).first().asDict().items()}
        if counters["added"] + counters["updated"] + counters["removed"] + planned.filter("action = 'touched'").count() == 0:
            return counters
        acted = planned.filter("action <> 'unchanged'").join(listed, "path", "left").join(known.select("path", F.col("content").alias("had"), F.col("skipped").alias("was")), "path", "left")
        anew = F.col("action").isin("added", "updated")
        texts = scan.join(planned.filter(anew).select("path"), "path", "left_semi")
        empty = texts.select("path", F.coalesce(F.trim("text") == "", F.lit(True)).alias("empty"))
        documents = acted.join(empty, "path", "left").select(
            "path", "size", "mtime", "hash",
            F.when(anew, F.when(F.col("empty"), F.lit("no text"))).otherwise(F.col("was")).alias("skipped"),
            F.when(anew, F.lit(change.version)).otherwise(F.col("had")).cast("long").alias("content"),
            F.lit(change.version).cast("long").alias("since"),
            (F.col("action") == "removed").alias("removed"),
        )
        change.append("documents", documents)
        cut = passages.split(texts.select(F.col("path").alias("key"), "text"), self.tokens)
        keyed = cut.select(
            F.concat("key", F.format_string("#%08d", "ordinal")).alias("key"), F.col("key").alias("path"), F.lit(change.version).cast("long").alias("content"), "location", F.col("passage").alias("text")
        )
        written = change.append("passages", keyed)
        path = F.expr("left(key, length(key) - 9)").alias("path")
        content = F.lit(change.version).cast("long").alias("content")
        found = change.append("postings", postings.postings(written.select("key", "text")).select(path, content, "key", "kept", "size", "terms", "tf"))
        change.append("vectors", self.embedder(written.select("key", "text"), "key").select(path, content, "key", "vector"))
        self._count(change, written, found, known, planned)
        change.commit()
        if change.segments("passages") > self.merge_after:
            self.merge()
        return counters

    def _count(self, change, written: DataFrame, found: DataFrame, known: DataFrame, planned: DataFrame) -> None:
        """Passages and words of the whole index: those of before, without the documents that changed, and the new ones."""
        gone = known.select("path", "content").join(planned.filter(F.col("action").isin("added", "updated", "removed")).select("path"), "path", "left_semi")
        lost = self.tables.table("passages", PASSAGES, change.base).join(gone, ["path", "content"], "left_semi").count()
        words = self.tables.table("postings", POSTINGS, change.base).join(gone, ["path", "content"], "left_semi").agg(F.sum("size")).first()[0] or 0
        change.facts["n_texts"] = change.facts.get("n_texts", 0) - lost + written.count()
        change.facts["n_words"] = change.facts.get("n_words", 0) - words + (found.agg(F.sum("size")).first()[0] or 0)

    def merge(self) -> None:
        """One segment of each table, with the rows that count."""
        change = self.tables.begin()
        base = change.base
        tables = {"passages": PASSAGES, "postings": POSTINGS, "vectors": VECTORS}
        rows = {name: self._current(name, schema, base) for name, schema in tables.items()}
        rows["documents"] = self.documents(base).withColumn("removed", F.lit(False))
        for name, df in rows.items():
            change.replace(name, df)
        change.commit()
