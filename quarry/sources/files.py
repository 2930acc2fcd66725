"""Folders of files as DataFrames: listing, type filter, size limits and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.sources.ignore import ignored

#: Largest text and office files in bytes.
TEXT_LIMIT, OFFICE_LIMIT = 2 * 1024 * 1024, 50 * 1024 * 1024


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """path (relative), size, mtime of the files that are neither hidden nor ignored, by path, without reading them.
    `ignore`: lines of ignore files and patterns to leave out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    relative = F.substring(inside, F.length(F.lit(root.rstrip("/"))) + 2, F.length(inside))
    return files.select(
        relative.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime")
    ).filter(~F.col("path").rlike(r"(^|/)\.[^/]") & ~ignored(F.col("path"), ignore or [])).orderBy("path")


def accepted(path: Column, types: list[str]) -> Column:
    """Whether the types (extensions, or code; none: all) take the file."""
    kind = C.file_kind(path)
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    wanted = ext.isin(*types) | (F.lit("code" in types) & (kind == "code")) if types else F.lit(True)
    return kind.isNotNull() & wanted


def skip_reason(path: Column, size: Column) -> Column:
    kind = C.file_kind(path)
    most = F.when(kind.isin("pdf", "docx", "odt"), F.lit(OFFICE_LIMIT)).otherwise(F.lit(TEXT_LIMIT))
    return F.when(kind.isNull(), "unsupported").when(size > most, "too large")
