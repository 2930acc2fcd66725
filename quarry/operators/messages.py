"""Conversations: prompts, context accounting, search, history and versions.

Messages have conv_id, turn, role, text (and, where an operator needs them, status, source and image). Every ordered
step names its sort key.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import columns as C


def usable(text: Column, status: Column | None = None) -> Column:
    """Neither failed nor still streaming, and not blank."""
    filled = text.rlike(r"(?U)\S")
    return filled if status is None else filled & ~status.isin("failed", "streaming")


def prompt_tokens(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.sum(C.message_tokens(F.col("text"))).alias("prompt_tokens")
    )


def longest(messages: DataFrame, n: int = 5) -> DataFrame:
    rank = Window.partitionBy("conv_id").orderBy(F.desc("tokens"), "turn")
    return (
        messages.select("conv_id", "turn", "role", C.message_tokens(F.col("text")).alias("tokens"))
        .withColumn("place", F.row_number().over(rank))
        .filter(F.col("place") <= n)
    )


def context_breakdown(messages: DataFrame) -> DataFrame:
    """Tokens of the system prompt and of the history, and each one's share of all."""
    size = C.message_tokens(F.col("text"))
    sums = messages.filter(usable(F.col("text"))).groupBy("conv_id").agg(
        F.coalesce(F.sum(F.when(F.col("role") == "system", size)), F.lit(0)).alias("system_tokens"),
        F.coalesce(F.sum(F.when(F.col("role") != "system", size)), F.lit(0)).alias("history_tokens"),
    )
    total = F.col("system_tokens") + F.col("history_tokens")
    return sums.select(
        "*",
        total.alias("total_tokens"),
        C.percent(F.col("system_tokens"), total).alias("system_percent"),
        C.percent(F.col("history_tokens"), total).alias("history_percent"),
    )


def costs(messages: DataFrame, input_price: int, output_price: int) -> DataFrame:
    """Micro-units of each request and in total; prices in micro-units for a million tokens, each direction rounded down."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    priced = messages.select(
        "conv_id", "turn", "role",
        F.coalesce(F.sum(C.message_tokens(F.col("text"))).over(before), F.lit(0)).alias("input_tokens"),
        C.tokens(F.col("text")).alias("output_tokens"),
    ).filter("role = 'assistant'")
    cost = F.expr(f"input_tokens * {input_price} div 1000000 + output_tokens * {output_price} div 1000000")
    return priced.withColumn("micros", cost).groupBy("conv_id").agg(
        F.count("*").alias("requests"), F.sum("micros").alias("micros")
    )


def search_texts(messages: DataFrame, short: int = 6) -> DataFrame:
    """The last question of each conversation, after the one before it if it has few words."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    asked = messages.filter((F.col("role") == "user") & (F.trim("text") != ""))
    last = F.trim("text")
    few = F.size(F.split(last, r"\s+")) < short
    return (
        asked.withColumn("previous", F.lag("text").over(order))
        .withColumn("rest", F.lead("turn").over(order))
        .filter("rest IS NULL")
        .select(
            "conv_id",
            F.when(few & F.col("previous").isNotNull(), F.concat(F.trim("previous"), F.lit("\n"), last))
            .otherwise(last)
            .alias("search_text"),
        )
    )


def find_conversations(messages: DataFrame, titles: DataFrame, query: str, most: int | None = 200) -> DataFrame:
    """The latest `most` conversations (None: all) with a message that has every word of the query as a prefix, or the query
    in their title; a blank query lists all, without a limit. `excerpt` is of the first such message (null: only the title
    fits)."""
    if not query.strip():
        return titles.orderBy(F.desc("updated_at"), F.desc("conv_id")).select(
            "conv_id", "title", "updated_at", F.lit(False).alias("in_messages"), F.lit(None).cast("string").alias("excerpt")
        )
    inside = (
        messages.filter(C.matches_prefixes(F.col("text"), query))
        .groupBy("conv_id")
        .agg(F.min_by(excerpt(F.col("text"), query), "turn").alias("excerpt"))
    )
    plain = query.strip().replace("%", "").replace("_", "").lower()
    hit = titles.join(inside.withColumn("found", F.lit(True)), "conv_id", "left")
    fits = hit.filter(F.col("found") | F.contains(F.lower("title"), F.lit(plain))).orderBy(F.desc("updated_at"), F.desc("conv_id"))
    latest = fits if most is None else fits.limit(most)
    return latest.select("conv_id", "title", "updated_at", F.coalesce("found", F.lit(False)).alias("in_messages"), "excerpt")


def excerpt(text: Column, query: str, n_words: int = 10) -> Column:
    """The `n_words` words that hold the most words of the query (as prefixes); of equally good places the one where these
    stand closest, then the first. … marks text that is left out."""
    words = F.filter(F.split(C.strip(text), r"(?U)\s+"), lambda w: w != "")
    wanted = list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))

    def found(w: Column) -> Column:
        """Which words of the query a word begins with, a bit for each."""
        plain = F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+", "")
        return reduce(lambda a, b: a + b, [F.when(F.startswith(plain, F.lit(x)), 1 << k).otherwise(0) for k, x in enumerate(wanted)]).cast("long")

    # the text's postings: places of words that count
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), found(w).alias("mask"))), lambda h: h["mask"] > 0)

    def window(h: Column, i: Column) -> Column:
        # so many words hold as many hits at most
        inside = F.filter(F.slice(hits, i + 1, F.lit(n_words)), lambda x: x["at"] < h["at"] + n_words)
        covered = F.aggregate(inside, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x["mask"]))
        # the last word that adds to what is covered
        needed = F.aggregate(
            inside, F.struct(F.lit(0).cast("long").alias("seen"), h["at"].alias("last")),
            lambda s, x: F.when(s["seen"].bitwiseOR(x["mask"]) > s["seen"], F.struct(s["seen"].bitwiseOR(x["mask"]).alias("seen"), x["at"].alias("last"))).otherwise(s),
        )["last"]
        return F.struct(F.bit_count(covered).alias("covered"), (h["at"] - needed).alias("closeness"), (-h["at"]).alias("early"))

    best = F.array_max(F.transform(hits, window))
    first = F.greatest(F.lit(1), F.least(1 - best["early"], F.size(words) - n_words + 1))
    cut = F.array_join(F.slice(words, first, n_words), " ")
    return F.concat(F.when(first > 1, "…").otherwise(""), cut, F.when(first + n_words - 1 < F.size(words), "…").otherwise(""))


def overview(messages: DataFrame) -> DataFrame:
    """Title (from the first question), first and last time, and number of messages of each conversation."""
    asked = F.when((F.col("role") == "user") & (F.trim("text") != ""), F.struct("turn", "text"))
    time = F.col("conv_id") * 1000 + F.col("turn")
    return messages.groupBy("conv_id").agg(
        C.title_from(F.coalesce(F.min(asked)["text"], F.lit(""))).alias("title"),
        F.min(time).alias("created_at"),
        F.max(time).alias("updated_at"),
        F.count("*").alias("n_messages"),
    )


def input_history(messages: DataFrame, most: int = 500) -> DataFrame:
    """The latest questions, oldest first, without immediate repeats."""
    latest = (
        messages.filter((F.col("role") == "user") & (F.trim("text") != ""))
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("time"), "text")
        .orderBy(F.desc("time"))
        .limit(most)
    )
    order = Window.orderBy("time")  # over `most` rows
    return (
        latest.withColumn("before", F.lag("text").over(order))
        .filter(~F.col("text").eqNullSafe(F.col("before")))
        .select("time", "text")
    )


def preview_anchor(messages: DataFrame, words: list[str]) -> DataFrame:
    """The first message with all folded words, else the first with any."""
    hay = C.fold(F.col("text"))
    every, some = F.lit(True), F.lit(False)
    for w in words:
        every, some = every & F.contains(hay, F.lit(w)), some | F.contains(hay, F.lit(w))
    return messages.groupBy("conv_id").agg(
        F.coalesce(F.min(F.when(every, F.col("turn"))), F.min(F.when(some, F.col("turn")))).alias("turn")
    ).filter("turn IS NOT NULL")


def occurrences(messages: DataFrame, needle: str) -> DataFrame:
    """Places of a text in folded text, without regard to accents and case, not overlapping: conv_id, turn, k, and start
    and end as characters of the text itself, where one character may fold to two."""
    wanted = C.fold(F.lit(needle))
    chars = F.split("text", "")
    # how many folded characters there are before each character, and behind the last
    sizes = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.length(C.fold(c)))
    parts = F.split(C.fold(F.col("text")), F.concat(F.lit("\\Q"), F.replace(wanted, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    found = messages.select("conv_id", "turn", "text", sizes.alias("sizes"), F.transform(parts, F.length).alias("lengths"))
    found = found.filter((F.size("lengths") > 1) & (wanted != ""))
    places = found.select(
        "conv_id", "turn", "sizes", F.length(wanted).alias("n"), "lengths",
        F.explode(F.sequence(F.lit(0), F.size("lengths") - 2)).alias("k"),
    ).withColumn("at", F.aggregate(F.slice("lengths", F.lit(1), F.col("k") + 1), F.lit(0), lambda a, x: a + x) + F.col("k") * F.col("n"))

    def original(folded: Column, end: bool) -> Column:
        """The character that holds a folded place: the first that ends behind it, or reaches the end."""
        start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("n"))
        goes_on = (lambda s: s["seen"] < folded) if end else (lambda s: s["seen"] <= folded)
        step = F.aggregate(
            "sizes", start, lambda s, x: F.when(goes_on(s), F.struct((s["seen"] + x).alias("seen"), (s["n"] + 1).alias("n"))).otherwise(s)
        )
        return (step["n"] if end else step["n"] - 1).cast("long")

    return places.select(
        "conv_id", "turn", F.col("k").cast("int").alias("k"), original(F.col("at"), False).alias("start"), original(F.col("at") + F.col("n"), True).alias("end")
    )


def ordered_text(messages: DataFrame, line: Column, joiner: str, *order: str) -> DataFrame:
    """The lines of each conversation in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), joiner).alias("body"))


def export_markdown(messages: DataFrame) -> DataFrame:
    who = F.when(F.col("role") == "user", "## Vous").when(F.col("role") == "assistant", "## Assistant").otherwise("## Système")
    return ordered_text(messages.filter(usable(F.col("text"))), F.concat(who, F.lit("\n\n"), F.rtrim("text"), F.lit("\n")), "\n", "turn")


def chatml(messages: DataFrame) -> DataFrame:
    line = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    done = ordered_text(messages.filter(usable(F.col("text"))), line, "", "turn")
    return done.select("conv_id", F.concat("body", F.lit("<|im_start|>assistant\n")).alias("body"))


def build_prompt(messages: DataFrame, chunks: DataFrame, system: str) -> DataFrame:
    """One row per sent message: the system text with its numbered sources first (position -1), then the usable turns.

    `chunks`: conv_id, position, source, location, text of what retrieval gave.
    """
    place = Window.partitionBy("conv_id").orderBy("position")
    numbered = chunks.withColumn("number", F.row_number().over(place))
    block = F.concat(
        F.lit("["), F.col("number").cast("string"), F.lit("] "), C.label(F.col("source"), F.col("location")), F.lit("\n"), F.col("text")
    )
    sources = numbered.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("sources")
    )
    ids = messages.select("conv_id").distinct()
    first = ids.join(sources, "conv_id", "left").select(
        "conv_id", F.lit(-1).cast("long").alias("position"), F.lit("system").alias("role"),
        F.concat_ws("\n\n", F.nullif(F.lit(system), F.lit("")), "sources").alias("content"),
    ).filter("content <> ''")
    turns = messages.filter(usable(F.col("text"))).select("conv_id", F.col("turn").alias("position"), "role", F.col("text").alias("content"))
    return first.unionByName(turns)


def images_to_questions(messages: DataFrame) -> DataFrame:
    """Each image goes with the next question, trailing ones with the last: (conv_id, turn of the image, turn of the question)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("conv_id")
    question = F.when(F.col("role") == "user", F.col("turn"))
    return (
        messages.withColumn("next", F.first(question, ignorenulls=True).over(ahead))
        .withColumn("last", F.max(question).over(whole))
        .filter("role = 'attachment' AND image IS NOT NULL")
        .select("conv_id", "turn", F.coalesce("next", "last").alias("question"))
    )


def versions(tails: DataFrame) -> DataFrame:
    """For each branch point (null: the start) how many versions there are and which number the shown one has.

    `tails`: conv_id, after_seq, number of each archived version.
    """
    kept = tails.groupBy("conv_id", "after_seq").agg(F.count("*").alias("kept"), F.collect_set("number").alias("used"))
    total = F.col("kept") + 1
    shown = F.array_min(F.array_except(F.sequence(F.lit(1).cast("long"), total), F.transform("used", lambda x: x.cast("long"))))
    return kept.select("conv_id", "after_seq", total.alias("total"), shown.alias("shown"))


def merge_log(log: DataFrame, key: list[str], first: list[str], last: list[str], order: str) -> DataFrame:
    """Upserts as a fold over an append-only log: `first` columns keep their first value, `last` ones take the latest."""
    return log.groupBy(*key).agg(
        *[F.min_by(c, order).alias(c) for c in first], *[F.max_by(c, order).alias(c) for c in last]
    )


def truncate(messages: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages before each conversation's cut, and those from it on (the archived tail). `cuts`: conv_id, from_turn."""
    marked = messages.join(cuts, "conv_id", "left")
    gone = F.col("from_turn").isNotNull() & (F.col("turn") >= F.col("from_turn"))
    return marked.filter(~gone).drop("from_turn"), marked.filter(gone).drop("from_turn")


def after(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages that follow each conversation's mark. `marks`: conv_id, turn; of several the last counts."""
    last = marks.groupBy("conv_id").agg(F.max("turn").alias("mark"))
    return messages.join(last, "conv_id").filter("turn > mark").select(*messages.columns)


def before(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages that come before each conversation's mark; of several marks the first counts."""
    first = marks.groupBy("conv_id").agg(F.min("turn").alias("mark"))
    return messages.join(first, "conv_id").filter("turn < mark").select(*messages.columns)


def delete_collection(name: str, collections: DataFrame, documents: DataFrame, chunks: DataFrame, conversations: DataFrame) -> list[DataFrame]:
    """The four tables without a collection: its row, its documents with their passages, and its name in the conversations."""
    own = [t.filter(~F.col("collection").eqNullSafe(F.lit(name))) for t in (documents, chunks)]
    return [collections.filter(~F.col("name").eqNullSafe(F.lit(name))), *own, forget_collection(conversations, name)]


def forget_collection(conversations: DataFrame, name: str) -> DataFrame:
    """The name leaves every conversation's comma list; an empty list becomes null."""
    left = F.array_remove(C.names(F.col("collections")), name)
    return conversations.withColumn("collections", F.nullif(F.array_join(left, ","), F.lit("")))
