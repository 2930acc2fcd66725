"""What is sent to a model: message lists, system text with sources, summaries, citations, and what they cost.

`messages` have conv_id, turn, role (system, user, assistant, attachment, summary, tool), text, status, source (of a file
or tool, or null) and image (or null). One row of a conversation never needs another conversation's, so every step is
partitioned by conv_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators.messages import usable

#: Texts that go into prompts, and characters of a past tool result.
CONTEXT_INTRO = "Use the following context to answer when it is relevant. Cite sources by their number."
SUMMARY_INTRO = "Summary of the conversation so far (earlier messages are not included):"
NO_NAME, NO_TOOL, TOOL_CHARS = "fichier joint", "outil", 8_000


def _usable() -> Column:
    return usable(F.col("text"), F.col("status"))


def sent_attachment() -> Column:
    """An attachment whose text goes into the prompt as a numbered source."""
    return (F.col("role") == "attachment") & F.col("image").isNull() & _usable()


def in_context(messages: DataFrame, starts: DataFrame) -> DataFrame:
    """Messages from each conversation's start of context on. `starts`: conv_id, context_start."""
    return messages.join(starts, "conv_id", "left").filter(F.col("turn") >= F.coalesce("context_start", F.lit(0))).drop("context_start")


def context_boundary(messages: DataFrame, starts: DataFrame) -> DataFrame:
    """The first message that is still in the context of each conversation."""
    return in_context(messages, starts).groupBy("conv_id").agg(F.min("turn").alias("turn"))


def tool_note(source: Column, text: Column) -> Column:
    """A past tool result as the assistant's note."""
    return F.concat(F.lit("["), F.lit(f"{NO_TOOL} : "), F.coalesce(source, F.lit(NO_TOOL)), F.lit("]\n"), C.truncated(text, TOOL_CHARS))


def first_context_numbers(messages: DataFrame) -> DataFrame:
    """The number of the first retrieved passage: attached files come first."""
    return messages.groupBy("conv_id").agg((F.count_if(sent_attachment()) + 1).alias("first_number"))


def sources(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """conv_id, number, label, path, location, text: attached files, then retrieved passages, numbered on.

    `chunks`: conv_id, position, source, location, text.
    """
    attached = messages.filter(sent_attachment()).select(
        "conv_id", F.lit(0).alias("kind"), F.col("turn").alias("position"),
        F.coalesce("source", F.lit(NO_NAME)).alias("path"), F.lit("").alias("location"), "text",
    )
    retrieved = chunks.select("conv_id", F.lit(1).alias("kind"), "position", F.col("source").alias("path"), "location", "text")
    order = Window.partitionBy("conv_id").orderBy("kind", "position")
    return attached.unionByName(retrieved).select(
        "conv_id", F.row_number().over(order).alias("number"), "kind", C.label(F.col("path"), F.col("location")).alias("label"), "path", "location", "text"
    )


def citations(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """The retrieved passages of each conversation with their numbers in the prompt, in order of retrieval."""
    return sources(messages, chunks).filter("kind = 1").select("conv_id", "number", "path", "location")


def _joined(rows: Column, joiner: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["line"]), joiner)


def system_messages(messages: DataFrame, chunks: DataFrame, system: str) -> DataFrame:
    """conv_id and content of each conversation's system message: prompt, latest summary, numbered sources."""
    block = F.concat(F.lit("\n["), F.col("number").cast("string"), F.lit("] "), F.col("label"), F.lit("\n"), C.strip(F.col("text")), F.lit("\n"))
    context = sources(messages, chunks).groupBy("conv_id").agg(_joined(F.struct("number", block.alias("line")), "").alias("context"))
    done = F.when((F.col("role") == "summary") & (F.col("status") == "complete") & _usable(), F.struct("turn", "text"))
    summary = messages.groupBy("conv_id").agg(F.max(done)["text"].alias("summary"))
    intro = F.concat(F.lit(f"{CONTEXT_INTRO}\n"), F.col("context"))
    return (
        summary.join(context, "conv_id", "left")
        .select(
            "conv_id",
            F.concat_ws(
                "\n\n",
                F.nullif(C.strip(F.lit(system)), F.lit("")),
                F.concat(F.lit(f"{SUMMARY_INTRO}\n"), C.strip(F.col("summary"))),
                F.regexp_replace(intro, r"\s+$", ""),
            ).alias("content"),
        )
        .filter("content <> ''")
    )


def build_messages(messages: DataFrame, chunks: DataFrame, system: str) -> DataFrame:
    """conv_id, position, role, content and images of every message sent: the system message (position -1), then the
    usable turns; attachments and summaries are part of the former, tool results notes of the assistant, and images go
    with the next question, or the last one if none follows."""
    first = system_messages(messages, chunks, system).select(
        "conv_id", F.lit(-1).cast("long").alias("position"), F.lit("system").alias("role"), "content"
    )
    ahead = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    question = F.when((F.col("role") == "user") & _usable(), F.col("turn"))
    placed = messages.withColumns({
        "question": F.coalesce(F.min(question).over(ahead), F.max(question).over(Window.partitionBy("conv_id"))),
    })
    images = (
        placed.filter("role = 'attachment' AND image IS NOT NULL AND question IS NOT NULL")
        .groupBy("conv_id", F.col("question").alias("position"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "image"))), lambda x: x["image"]).alias("images"))
    )
    note = F.col("role") == "tool"
    turns = messages.filter(_usable() & F.col("role").isin("system", "user", "assistant", "tool")).select(
        "conv_id", F.col("turn").cast("long").alias("position"),
        F.when(note, "assistant").otherwise(F.col("role")).alias("role"),
        F.when(note, tool_note(F.col("source"), F.col("text"))).otherwise(F.col("text")).alias("content"),
    )
    whole = first.unionByName(turns).join(images, ["conv_id", "position"], "left")
    return whole.withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


def summary_requests(messages: DataFrame) -> DataFrame:
    """conv_id and the transcript that a summary is asked of: usable messages as `### who` sections."""
    named = F.coalesce("source", F.lit(""))
    who = (
        F.when(F.col("role") == "user", F.lit("User"))
        .when(F.col("role") == "assistant", F.lit("Assistant"))
        .when(F.col("role") == "system", F.lit("System"))
        .when(F.col("role") == "summary", F.lit("Summary of earlier messages"))
        .when(F.col("role") == "tool", F.concat(F.lit("Tool result ("), named, F.lit(")")))
        .otherwise(F.concat(F.lit("Attached file "), named))
    )
    line = F.concat(F.lit("### "), who, F.lit("\n"), C.strip(F.col("text")))
    return messages.filter(_usable()).groupBy("conv_id").agg(
        F.concat(F.lit("Summarize this conversation:\n\n"), _joined(F.struct("turn", line.alias("line")), "\n\n")).alias("request")
    )


def estimate(prompt: DataFrame) -> DataFrame:
    """Estimated tokens of each conversation's message list; an image counts as a fixed number."""
    size = C.message_tokens(F.col("content")) + F.size("images") * C.IMAGE_TOKENS
    return prompt.groupBy("conv_id").agg(F.sum(size).alias("tokens"))


def context_usage(messages: DataFrame, prompt: DataFrame, measured: DataFrame) -> DataFrame:
    """conv_id, tokens and whether they are `measured`: the server's count of the last request and an estimate of what
    came after it, else an estimate of the whole prompt.

    `measured`: conv_id, input_tokens, output_tokens, n_messages (in the conversation when it was measured).
    """
    place = Window.partitionBy("conv_id").orderBy("turn")
    known = measured.select("conv_id", (F.col("input_tokens") + F.coalesce("output_tokens", F.lit(0))).alias("total"), "n_messages")
    numbered = messages.select("conv_id", C.message_tokens(F.col("text")).alias("own"), F.row_number().over(place).alias("place"))
    sums = numbered.join(known, "conv_id", "left").groupBy("conv_id", "total", "n_messages").agg(
        F.coalesce(F.sum(F.when(F.col("place") > F.col("n_messages"), F.col("own"))), F.lit(0)).alias("newer"), F.count("*").alias("n")
    )
    usable_measure = F.coalesce(F.col("n_messages") <= F.col("n"), F.lit(False))
    return sums.join(estimate(prompt), "conv_id", "left").select(
        "conv_id",
        F.when(usable_measure, F.col("total") + F.col("newer")).otherwise(F.coalesce("tokens", F.lit(0))).alias("tokens"),
        F.coalesce(F.col("n_messages") == F.col("n"), F.lit(False)).alias("measured"),
    )


def breakdown(messages: DataFrame, chunks: DataFrame, system: str) -> DataFrame:
    """Estimated tokens of the parts of each prompt: system text without what it carries, passages, attachments, images,
    summary, history; and each one's share of system and history together, in percent."""
    built = build_messages(messages, chunks, system)
    size = C.message_tokens(F.col("content"))
    sums = built.groupBy("conv_id").agg(
        F.coalesce(F.sum(F.when(F.col("role") == "system", size)), F.lit(0)).alias("all_system"),
        F.coalesce(F.sum(F.when(F.col("role") != "system", size)), F.lit(0)).alias("history"),
    )
    own, attached = C.tokens(F.col("text")), F.col("role") == "attachment"
    parts = messages.groupBy("conv_id").agg(
        F.coalesce(F.sum(F.when(attached & F.col("image").isNull(), own)), F.lit(0)).alias("attachments"),
        (F.count_if(attached & F.col("image").isNotNull()) * C.IMAGE_TOKENS).alias("images"),
        F.coalesce(F.sum(F.when((F.col("role") == "summary") & (F.col("status") == "complete"), own)), F.lit(0)).alias("summary"),
    )
    retrieved = chunks.groupBy("conv_id").agg(F.sum(own).alias("retrieved"))
    joined = sums.join(parts, "conv_id").join(retrieved, "conv_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(0)))
    total = F.greatest(F.col("all_system") + F.col("history"), F.lit(1))
    net = F.greatest(F.col("all_system") - F.col("attachments") - F.col("summary") - F.col("retrieved"), F.lit(0))
    names = ["system", "retrieved", "attachments", "images", "summary", "history"]
    return joined.withColumn("system", net).select(
        "conv_id", *names, *[C.percent(F.col(c), total).alias(f"{c}_percent") for c in names]
    )


def last_usage(reports: DataFrame) -> DataFrame:
    """Each request's latest known counts: a report without one leaves what was known. `reports`: request_id, pos,
    input_tokens, output_tokens."""
    return reports.groupBy("request_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in ("input_tokens", "output_tokens")]
    )


def request_costs(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """conv_id, turn, micros (null without a price or counts) and the conversation's running total.

    `requests`: conv_id, turn, model, input_tokens, output_tokens; `prices`: model, input_price, output_price in
    micro-units for a million tokens, each direction rounded down.
    """
    priced = requests.join(prices, "model", "left")
    micros = F.expr("input_tokens * input_price div 1000000 + coalesce(output_tokens, 0) * output_price div 1000000")
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return priced.select("conv_id", "turn", micros.alias("micros")).withColumn("total", F.coalesce(F.sum("micros").over(so_far), F.lit(0)))


def speeds(replies: DataFrame) -> DataFrame:
    """conv_id, turn, tokens per second, and the live speed, which needs half a second of tokens. `replies`: conv_id,
    turn, text, tokens, first_ms (null: nothing yet), now_ms."""
    ms = F.col("now_ms") - F.col("first_ms")
    return replies.select(
        "conv_id", "turn",
        F.expr("tokens * 1000 div greatest(now_ms - first_ms, 1)").alias("per_second"),
        F.when(ms >= 500, F.floor(C.tokens(F.col("text")) * 1000 / ms)).alias("live"),
    )


def compactable(messages: DataFrame, starts: DataFrame) -> DataFrame:
    """Whether a conversation's context has a question and an answer at least."""
    return in_context(messages, starts).groupBy("conv_id").agg((F.count_if(F.col("role").isin("user", "assistant")) >= 2).alias("compactable"))
