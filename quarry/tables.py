"""Intermediate tables: written once where several steps of an operator read the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset and the master is local, as in tests.
LOCAL = "/tmp/checkpoints"
#: Bytes of a batch of rows that goes to Python.
ARROW_BYTES = 8_000_000
#: Rows of a ranking whose keys go to every task.
BROADCAST_ROWS = 1_000_000


def folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    out = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not out and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return out or LOCAL


def written(df: DataFrame, *by: str) -> DataFrame:
    """The same rows from a table in the shared folder, in a folder for each value of the columns `by`."""
    path = f"{folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let a session that has no limit of its own hand rows to Python in batches of `ARROW_BYTES` at most: rows are texts or
    files, of which a worker holds several forms at a time."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name) == default:
        spark.conf.set(name, str(ARROW_BYTES))


def with_texts(ranking: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of a ranking with the columns of their `key` in `texts`. Only texts that it names are exchanged."""
    ranking = written(ranking)
    if ranking.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(ranking.select("key").distinct()), "key", "left_semi")
    return ranking.join(texts, "key")
