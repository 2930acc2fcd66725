"""Versions of conversations: what follows a branch point is kept under a number when another answer takes its place.

`messages`: conv_id, turn, role, text; `tails`: conv_id, after_seq (null: the start), number, turn, role, text, one row
for each archived message. Branch points are compared so that null equals null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT = ["conv_id", "after_seq", "number", "turn", "role", "text"]


def free_numbers(tails: DataFrame) -> DataFrame:
    """The least number that no archived version of a branch point has: that of the shown one."""
    used = tails.groupBy("conv_id", "after_seq").agg(F.collect_set(F.col("number").cast("long")).alias("used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1).cast("long"), F.size("used").cast("long") + 1), "used"))
    return used.select("conv_id", "after_seq", free.alias("shown"))


def _after(branch: Column) -> Column:
    return branch.isNull() | (F.col("turn") > branch)


def _same_branch(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joined on the conversation and the branch point, null being one of its values."""
    r = right.withColumnRenamed("conv_id", "own_conv").withColumnRenamed("after_seq", "own_after")
    on = (F.col("conv_id") == F.col("own_conv")) & F.col("after_seq").eqNullSafe(F.col("own_after"))
    return left.join(r, on, how).drop("own_conv", "own_after")


def _first(rows: DataFrame, *rest: str) -> DataFrame:
    """One row for each conversation, that of its earliest branch point (null: the start)."""
    least = F.min(F.struct(F.col("after_seq").isNotNull().alias("later"), "after_seq", *rest))
    return rows.groupBy("conv_id").agg(least.alias("x")).select("conv_id", *[F.col(f"x.{c}").alias(c) for c in ("after_seq", *rest)])


def archive(messages: DataFrame, tails: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and tails after what follows each branch point was put away under its number. `cuts`: conv_id, after_seq;
    of several cuts of a conversation the earliest leaves nothing for the others."""
    named = _same_branch(_first(cuts), free_numbers(tails), "left").select(
        "conv_id", "after_seq", F.coalesce("shown", F.lit(1)).alias("number"), F.lit(True).alias("cut")
    )
    marked = messages.join(named, "conv_id", "left")
    gone = F.coalesce(F.col("cut") & _after(F.col("after_seq")), F.lit(False))
    kept = marked.filter(~gone).select(*messages.columns)
    return kept, tails.select(*KEPT).unionByName(marked.filter(gone).select(*KEPT))


def switch(messages: DataFrame, tails: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and tails after another version is shown: the present tail is archived and the target's messages return.
    `targets`: conv_id, after_seq, number of an archived version; others are ignored, as are all but the earliest branch
    point (then the least number) of a conversation."""
    known = _same_branch(targets.withColumnRenamed("number", "target"), tails.select("conv_id", "after_seq", F.col("number").alias("n")).distinct(), "inner")
    known = _first(known.filter("n = target"), "target")
    kept, archived = archive(messages, tails, known.select("conv_id", "after_seq"))
    back = _same_branch(archived, known, "left")
    shown = F.coalesce(F.col("number") == F.col("target"), F.lit(False))
    restored = back.filter(shown).select("conv_id", "turn", "role", "text")
    return kept.select("conv_id", "turn", "role", "text").unionByName(restored), back.filter(~shown).select(*KEPT)


def branch_points(messages: DataFrame, tails: DataFrame) -> DataFrame:
    """conv_id, after_seq and the first message after it, of the branch points whose message is still there."""
    points = tails.select("conv_id", "after_seq").distinct()
    turns = messages.select("conv_id", "turn").distinct()
    start = turns.groupBy("conv_id").agg(F.min("turn").alias("mark"))
    following = turns.select("conv_id", F.col("turn").alias("after_seq"), F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("mark"))
    whole = points.filter("after_seq IS NULL").join(start, "conv_id", "left").select("conv_id", "after_seq", "mark")
    return whole.unionByName(points.join(following, ["conv_id", "after_seq"]))


def keep_reply(messages: DataFrame, tails: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of two replies that were compared, the chosen one stays and the other becomes a version after the question.
    `pairs`: conv_id, question, chosen, other (turns); of several pairs of a question the one with the least other counts."""
    single = pairs.groupBy("conv_id", "question").agg(F.min("other").alias("turn"))
    gone = single.groupBy("conv_id", "turn").agg(F.min("question").alias("question"))
    number = free_numbers(tails).withColumnRenamed("after_seq", "question_").withColumnRenamed("conv_id", "conv_")
    put = messages.join(gone, ["conv_id", "turn"]).join(
        number, (F.col("conv_id") == F.col("conv_")) & F.col("question").eqNullSafe(F.col("question_")), "left"
    )
    put = put.select("conv_id", F.col("question").alias("after_seq"), F.coalesce("shown", F.lit(1)).alias("number"), "turn", "role", "text")
    return messages.join(gone, ["conv_id", "turn"], "left_anti").select(*messages.columns), tails.select(*KEPT).unionByName(put)


def delete_conversations(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Every table without the rows of some conversations. `gone`: conv_id."""
    return [t.join(gone.select("conv_id").distinct(), "conv_id", "left_anti") for t in tables]


def point_updates(conversations: DataFrame, log: DataFrame, columns: list[str]) -> DataFrame:
    """Conversations after updates of single columns: the latest of each column counts; `cleared` lists columns set to
    null. `log`: conv_id, op, cleared (array) and the columns, null where unchanged."""
    touched = {c: F.col(c).isNotNull() | F.array_contains("cleared", c) for c in columns}
    latest = log.groupBy("conv_id").agg(
        *[F.max(F.when(touched[c], F.struct("op", F.col(c).alias("value")))).alias(f"new_{c}") for c in columns]
    )
    joined = conversations.join(latest, "conv_id", "left")
    changed = {c: F.when(F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}")["value"]).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(changed).select(*conversations.columns)
