"""JSON that goes to model servers or comes from them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import columns as C

CITATIONS = "array<struct<number:int,path:string,location:string>>"
#: Parts of model names that can't chat; characters of a description's arguments and of a tool's result.
NOT_CHAT = "embedding tts whisper transcribe dall-e image moderation realtime audio davinci babbage search computer-use sora".split()
MOST_ARGUMENTS, MOST_OUTPUT = 120, 60_000


def citations_json(citations: Column) -> Column:
    """An empty list is null."""
    return F.when(F.size(citations) > 0, F.to_json(citations))


def citations_of(text: Column) -> Column:
    """Null and the empty string are an empty list."""
    return F.coalesce(F.from_json(F.nullif(text, F.lit("")), CITATIONS), F.from_json(F.lit("[]"), CITATIONS))


def can_chat(model: Column) -> Column:
    return ~model.rlike("|".join(NOT_CHAT))


def context_window(configured: Column, reported: Column) -> Column:
    """What is configured counts more than what a server reports."""
    return F.coalesce(configured, reported)


def _same(name: Column, model: Column) -> Column:
    return F.coalesce((name == model) | (name == F.concat(model, F.lit(":latest"))), F.lit(False))


def reported_window(body: Column, model: Column) -> Column:
    """The context window in a server's answer: a list of running models, a list of models, or properties."""
    running = F.from_json(F.get_json_object(body, "$.models"), "array<struct<name:string,model:string,key:string,id:string,context_length:bigint,"
        "max_context_length:bigint,loaded_instances:array<struct<config:struct<context_length:bigint>>>>>")  # fmt: skip
    first = lambda found: F.get(F.filter(running, found), F.lit(0))
    named = first(lambda m: _same(m["name"], model) | _same(m["model"], model))
    listed = first(lambda m: F.coalesce((m["key"] == model) | (m["id"] == model), F.coalesce(m["key"] == model, m["id"] == model), F.lit(False)))
    own = lambda path: F.get_json_object(body, path).cast("bigint")
    return F.coalesce(
        named["context_length"],
        F.get(listed["loaded_instances"], F.lit(0))["config"]["context_length"],
        listed["max_context_length"],
        own("$.default_generation_settings.n_ctx"),
        own("$.n_ctx"),
    )


def described_call(name: Column, arguments: Column) -> Column:
    """What a tool call does, for a person. Arguments that can't be read give a general description."""
    own = lambda key: F.get_json_object(arguments, f"$.{key}")
    one = lambda key, known, otherwise: F.coalesce(F.concat(F.lit(f"{known} "), own(key)), F.lit(otherwise))
    found = F.concat(F.lit("chercher « "), own("query"), F.lit(" » dans "))
    search = F.coalesce(F.concat(found, F.lit("« "), own("collection"), F.lit(" »")), F.concat(found, F.lit("les documents")), F.lit("chercher dans les documents"))
    values = F.map_entries(F.from_json(arguments, "map<string,string>"))
    listed = F.array_join(F.transform(F.array_sort(values), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    cut = F.coalesce(F.substring(listed, 1, MOST_ARGUMENTS), F.lit(""))
    cut = F.when(F.length(cut) == MOST_ARGUMENTS, F.concat(cut, F.lit("…"))).otherwise(cut)
    parts = F.split(name, "__", 2)
    outside = F.concat(
        F.lit("utiliser "), F.get(parts, F.lit(0)), F.lit(" › "), F.get(parts, F.lit(1)),
        F.when(cut != "", F.concat(F.lit(" ("), cut, F.lit(")"))).otherwise(F.lit("")),
    )
    return (
        F.when(name == "read_file", one("path", "lire", "lire un fichier"))
        .when(name == "list_dir", one("path", "lister", "lister un dossier"))
        .when(name == "fetch_url", one("url", "ouvrir", "ouvrir une page web"))
        .when(name == "search_documents", search)
        .when(F.contains(name, F.lit("__")), outside)
        .otherwise(F.concat(F.lit("outil inconnu : "), name))
    )


def tool_result(result: Column) -> Column:
    """ok and text of a tool server's answer: its parts by their kind, one to a line, up to `MOST_OUTPUT` characters."""
    kind = "array<struct<type:string,text:string,mimeType:string,uri:string,resource:struct<text:string,uri:string>>>"
    items = F.from_json(F.get_json_object(result, "$.content"), kind)
    empty = F.lit("")
    parts = F.transform(
        items,
        lambda x: F.when(x["type"] == "text", F.coalesce(x["text"], empty))
        .when(x["type"] == "image", F.concat(F.lit("[image "), F.coalesce(x["mimeType"], empty), F.lit("]")))
        .when(x["type"] == "audio", F.lit("[audio]"))
        .when(x["type"] == "resource", F.coalesce(x["resource"]["text"], F.concat(F.lit("[ressource "), F.coalesce(x["resource"]["uri"], empty), F.lit("]"))))
        .when(x["type"] == "resource_link", F.concat(F.lit("[lien "), F.coalesce(x["uri"], empty), F.lit("]"))),
    )
    kept = F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: x.isNotNull())
    text = F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(F.coalesce(F.get_json_object(result, "$.structuredContent"), empty))
    failed = F.coalesce(F.get_json_object(result, "$.isError") == "true", F.lit(False))
    return F.struct((~failed).alias("ok"), C.truncated(text, MOST_OUTPUT, "\n[… résultat tronqué]").alias("text"))


def chat_messages(messages: DataFrame) -> DataFrame:
    """conv_id and the JSON array of a chat-completions request. `messages`: conv_id, position, role, content, call_id
    (of a tool's result, or null)."""
    item = F.struct("role", "content", F.col("call_id").alias("tool_call_id"))
    rows = F.array_sort(F.collect_list(F.struct("position", item.alias("item"))))
    return messages.groupBy("conv_id").agg(F.to_json(F.transform(rows, lambda x: x["item"])).alias("body"))


def turn_messages(messages: DataFrame) -> DataFrame:
    """conv_id, system and turns (JSON) of a messages request: system texts apart, tool results that follow each other in
    one turn of the user. Columns as above."""
    order = Window.partitionBy("conv_id").orderBy("position")
    rest = messages.filter("role <> 'system'").withColumn("before", F.lag("role").over(order))
    starts = F.when((F.col("role") == "tool") & F.col("before").eqNullSafe(F.lit("tool")), 0).otherwise(1)
    # gaps and islands: a run of tool results shares its number
    grouped = rest.withColumn("number", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    block = F.when(
        F.col("role") == "tool",
        F.struct(F.lit("tool_result").alias("type"), F.col("call_id").alias("tool_use_id"), F.col("content").alias("text")),
    ).otherwise(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("tool_use_id"), F.col("content").alias("text")))
    one = grouped.groupBy("conv_id", "number").agg(
        F.when(F.first("role") == "tool", "user").otherwise(F.first("role")).alias("role"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", block.alias("block")))), lambda x: x["block"]).alias("content"),
    )
    turns = one.groupBy("conv_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("number", F.struct("role", "content").alias("turn")))), lambda x: x["turn"])).alias("turns")
    )
    texts = F.array_sort(F.collect_list(F.struct("position", "content")))
    system = messages.filter("role = 'system'").groupBy("conv_id").agg(F.array_join(F.transform(texts, lambda x: x["content"]), "\n\n").alias("system"))
    return turns.join(system, "conv_id", "full_outer")
