"""Shared input handling: which columns an operator reads, and where intermediate tables go."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset and the master is local, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bytes of a batch of texts.
ARROW_BYTES = 8_000_000
#: A key with more than one in so many rows is heavy (so there are fewer than that many such keys); keys that it becomes.
HEAVY, SALTS = 2_000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *ids: str) -> DataFrame:
    """Only the id columns and the text (null: empty); whatever else the input holds can't clash with later columns."""
    return docs.select(*[F.col(c) for c in ids], F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors see."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_CHECKPOINTS


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows from a compressed table in that folder: later readers take only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let a session that has no limit of its own hand texts to Python in batches of `ARROW_BYTES` at most: both sides hold
    some at a time, and the JVM twice as much while a batch grows."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name) == default:
        spark.conf.set(name, str(ARROW_BYTES))


def release() -> None:
    """Give memory that a worker no longer uses back to the system, for the tasks beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same step, whose worker gives its memory back at the end of a task: it is kept, and others run beside it."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return released


def joined_evenly(many: DataFrame, few: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """`many` (with columns k1, k2 and span) and the columns of `few` that have its keys; `counts` says how many rows n
    of `many` each key has. Heavy keys are dealt over SALTS keys: their rows of `few` are repeated, and each row of
    `many` takes one by a hash of its own content."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    # fewer than HEAVY keys, whatever the size
    heavy = F.broadcast(counts.filter(F.col("n") > max(1, total // HEAVY)).select(*keys, F.lit(True).alias("heavy")))
    salt = F.pmod(F.xxhash64("k1", "k2", "span"), F.lit(SALTS)).cast("int")
    left = many.join(heavy, keys, "left").withColumn("salt", F.when(F.col("heavy"), salt).otherwise(0)).drop("heavy")
    copies = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = few.join(heavy, keys, "left").withColumn("salt", F.explode(copies)).drop("heavy")
    return left.join(right, [*keys, "salt"]).drop("salt")
