"""Event streams: server-sent frames, tool-call deltas, debounce, throttle. The same functions serve batch and stream:
sessions take a watermark when their input is a stream, and what depends on earlier items of a request keeps them as state
(`folds`); `clock` has what waits for a time without events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.streaming import folds


def debounce(events: DataFrame, gap: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """One row for each burst of a key's events: key, first, last, n. `events`: key, ts."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        timed.groupBy(F.session_window("ts", gap).alias("w"), "key")
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
        .select("key", "first", "last", "n")
    )


def throttle(events: DataFrame, ms: int = 500) -> DataFrame:
    """The first event of each key in each stretch of `ms`, and the last of all. `events`: key, ts, event_id."""
    slot = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / ms)
    order = Window.partitionBy("key", "slot").orderBy("ts", "event_id")
    final = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("event_id"))
    return (
        events.withColumn("slot", slot)
        .withColumn("first", F.row_number().over(order) == 1)
        .withColumn("final", F.row_number().over(final) == 1)
        .filter("first OR final")
        .select("key", "event_id", "final")
    )


def current_only(events: DataFrame, current: DataFrame) -> DataFrame:
    """Events of requests that are still current. `current`: request_id (of a session each)."""
    return events.join(current, "request_id", "left_semi")


def stream_text(tokens: DataFrame) -> DataFrame:
    """The tokens of each request in order, joined. `tokens`: request_id, pos, text."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return tokens.groupBy("request_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("text"))


def tool_calls(deltas: DataFrame) -> DataFrame:
    """Calls put together from fragments. `deltas`: request_id, round, pos, call_index, call_id, call_name, arguments. A call
    without an id is named by its round and its place among the round's calls. Of a stream, whose items have a kind, the
    calls of a round come when it is done."""
    if deltas.isStreaming:
        return folds.folded(deltas, folds.Calls)

    def joined(c: str):
        rows = F.array_sort(F.collect_list(F.struct("pos", F.coalesce(c, F.lit("")).alias("part"))))
        return F.array_join(F.transform(rows, lambda x: x["part"]), "")

    found = deltas.groupBy("request_id", "round", "call_index").agg(
        joined("call_id").alias("id"), joined("call_name").alias("name"), joined("arguments").alias("args")
    )
    place = F.row_number().over(Window.partitionBy("request_id", "round").orderBy("call_index")) - 1
    own = F.concat(F.lit("call_"), F.col("round").cast("string"), F.lit("_"), place.cast("string"))
    return found.select(
        "request_id", "round", "call_index",
        F.when(F.col("id") == "", own).otherwise(F.col("id")).alias("call_id"),
        F.col("name").alias("call_name"),
        F.when(F.trim("args") == "", F.lit("{}")).otherwise(F.col("args")).alias("arguments"),
    )


class Frames:
    """Payloads of server-sent events from bytes that may break anywhere: what is unfinished waits for the next bytes."""

    def __init__(self, rest: bytes = b"", data: list[str] | None = None):
        self.rest, self.data = rest, list(data or [])

    def feed(self, raw: bytes) -> list[str]:
        *lines, self.rest = (self.rest + raw).split(b"\n")
        return [x for line in lines for x in self._line(line.removesuffix(b"\r"))]

    def finish(self) -> list[str]:
        """The event that the end of the stream cuts off."""
        line, self.rest = self.rest.removesuffix(b"\r"), b""
        return [*(self._line(line) if line else []), *self._line(b"")]

    def _line(self, line: bytes) -> list[str]:
        name, _, value = line.partition(b":")
        if name == b"data":
            self.data.append(value.removeprefix(b" ").decode(errors="replace"))
        if line or not self.data:
            return []
        done, self.data = "\n".join(self.data), []
        return [done]


def sse(chunks: DataFrame) -> DataFrame:
    """stream_id, pos, data of every frame; chunks (stream_id, chunk_seq, bytes) may break anywhere.

    As a batch, each stream's chunks pass in order and only an unfinished event is held. As a stream, that event is the
    state of its stream_id; a chunk without bytes ends the stream there.
    """
    kind = chunks.schema["stream_id"].dataType.simpleString()
    if chunks.isStreaming:
        return chunks.groupBy("stream_id").applyInPandasWithState(
            _framed, f"stream_id {kind}, pos long, data string", "rest binary, data array<string>, pos long", "append", "NoTimeout"
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, pos = None, Frames(), 0
        for frame in frames:
            rows = []
            for s, raw in zip(frame["stream_id"], frame["bytes"], strict=True):
                if s != now:
                    rows += [(now, pos + k, x) for k, x in enumerate(held.finish())]
                    now, held, pos = s, Frames(), 0
                found = held.feed(bytes(raw)) if raw is not None else held.finish()
                rows += [(s, pos + k, x) for k, x in enumerate(found)]
                pos += len(found)
            yield pd.DataFrame(rows, columns=["stream_id", "pos", "data"])
        yield pd.DataFrame([(now, pos + k, x) for k, x in enumerate(held.finish())], columns=["stream_id", "pos", "data"])

    ordered = chunks.select("stream_id", "chunk_seq", "bytes").repartition("stream_id").sortWithinPartitions("stream_id", "chunk_seq")
    return ordered.mapInPandas(run, f"stream_id {kind}, pos long, data string")


def _framed(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rest, data, pos = state.get if state.exists else (b"", [], 0)
    held = Frames(bytes(rest), list(data))
    whole = pd.concat(list(frames)).sort_values("chunk_seq")
    found = [x for raw in whole["bytes"] for x in (held.feed(bytes(raw)) if raw is not None else held.finish())]
    state.update((held.rest, held.data, pos + len(found)))
    yield pd.DataFrame({"stream_id": [key[0]] * len(found), "pos": range(pos, pos + len(found)), "data": found})


#: What a decoded frame holds: items of a kind (text, tool, usage, done, error) with the fields of that kind.
ITEM = (
    "struct<kind:string,text:string,call_index:int,call_id:string,call_name:string,arguments:string,input_tokens:bigint,output_tokens:bigint>"
)


def _item(kind: str, **fields: Column) -> Column:
    names = ["text", "call_index", "call_id", "call_name", "arguments", "input_tokens", "output_tokens"]
    return F.struct(F.lit(kind).alias("kind"), *[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(ITEM)


def _decoded(frames: DataFrame, items: Column) -> DataFrame:
    kept = F.filter(items, lambda x: x.isNotNull())
    return frames.select("request_id", "pos", F.posexplode(kept).alias("item", "x")).select("request_id", "pos", "item", "x.*")


def chat_items(frames: DataFrame) -> DataFrame:
    """Items of a chat-completions stream: request_id, pos, item and the fields of ITEM. `frames`: request_id, pos, data.

    The texts of all choices of a frame are one item. A frame that can't be read is an error.
    """
    kind = (
        "struct<choices:array<struct<delta:struct<content:string,tool_calls:array<struct<index:int,id:string,"
        "function:struct<name:string,arguments:string>>>>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>,error:string>"
    )
    body = F.from_json("data", kind)
    nothing = F.array().cast(f"array<{ITEM}>")
    deltas = F.coalesce(F.transform(body["choices"], lambda c: c["delta"]), F.array().cast("array<struct<content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>>"))
    text = F.array_join(F.transform(deltas, lambda d: F.coalesce(d["content"], F.lit(""))), "")
    calls = F.flatten(F.filter(F.transform(deltas, lambda d: d["tool_calls"]), lambda x: x.isNotNull()))
    tools = F.transform(calls, lambda c: _item(
        "tool", call_index=F.coalesce(c["index"], F.lit(0)), call_id=c["id"], call_name=c["function"]["name"],
        arguments=F.coalesce(c["function"]["arguments"], F.lit("")),
    ))
    usage = F.when(body["usage"].isNotNull(), F.array(_item("usage", input_tokens=body["usage"]["prompt_tokens"], output_tokens=body["usage"]["completion_tokens"])))
    error = F.coalesce(F.get_json_object("data", "$.error.message"), body["error"])
    readable = F.try_parse_json("data").isNotNull()
    items = (
        F.when(F.trim("data") == "[DONE]", F.array(_item("done")))
        .when(~readable, F.array(_item("error", text=F.substring("data", 1, 80))))
        .when(error.isNotNull(), F.array(_item("error", text=error)))
        .otherwise(F.concat(F.when(text != "", F.array(_item("text", text=text))).otherwise(nothing), tools, F.coalesce(usage, nothing)))
    )
    return _decoded(frames, items)


def message_items(frames: DataFrame) -> DataFrame:
    """Items of a messages stream, columns as above. Input tokens count what a cache took in or gave; event types and
    parts that aren't known give nothing."""
    at = lambda path: F.get_json_object("data", f"$.{path}")
    number = lambda path: at(path).cast("bigint")
    kind, delta = at("type"), at("delta.type")
    counts = [F.coalesce(number(f"message.usage.{c}"), F.lit(0)) for c in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")]
    total = F.when(at("message.usage").isNotNull(), counts[0] + counts[1] + counts[2])
    index = F.coalesce(at("index").cast("int"), F.lit(0))
    item = (
        F.when(F.try_parse_json("data").isNull(), _item("error", text=F.substring("data", 1, 80)))
        .when(kind == "message_start", _item("usage", input_tokens=total))
        .when((kind == "content_block_delta") & (delta == "text_delta") & (at("delta.text") != ""), _item("text", text=at("delta.text")))
        .when((kind == "content_block_start") & (at("content_block.type") == "tool_use"),
              _item("tool", call_index=index, call_id=at("content_block.id"), call_name=at("content_block.name"), arguments=F.lit("")))
        .when((kind == "content_block_delta") & (delta == "input_json_delta"), _item("tool", call_index=index, arguments=at("delta.partial_json")))
        .when((kind == "message_delta") & at("usage").isNotNull(), _item("usage", output_tokens=number("usage.output_tokens")))
        .when(kind == "message_stop", _item("done"))
        .when(kind == "error", _item("error", text=at("error.message")))
    )
    return _decoded(frames, F.array(item))


def phases_shown(items: DataFrame) -> DataFrame:
    """Without the phases that come after a request's first token. `items`: request_id, pos, kind, ..."""
    if items.isStreaming:
        return folds.folded(items, folds.Phases)
    first = F.min(F.when(F.col("kind") == "text", F.col("pos"))).over(Window.partitionBy("request_id"))
    return items.withColumn("first", first).filter("kind <> 'phase' OR first IS NULL OR pos < first").drop("first")


def limited_rounds(rounds: DataFrame, most: int = 8) -> DataFrame:
    """Tool rounds of each request up to `most`; one more is the error that ends it. `rounds`: request_id, round (from 0)."""
    return rounds.filter(F.col("round") <= most).select("request_id", "round", F.when(F.col("round") == most, "error").otherwise("tools").alias("kind"))


def timings(items: DataFrame, ms: int = 500) -> DataFrame:
    """request_id, first_ms (from the start to the first item), n (timings sent: one in each stretch of `ms`, and the last).
    `items`: request_id, at_ms (since the request's start). Of a stream, each timing when it is due: first_ms, elapsed_ms, final."""
    if items.isStreaming:
        return folds.folded(items, folds.Timings)
    last = F.max("at_ms").over(Window.partitionBy("request_id"))
    slots = items.withColumn("last", last).groupBy("request_id", "last", F.expr(f"at_ms div {ms}").alias("slot")).agg(F.min("at_ms").alias("at_ms"))
    return slots.groupBy("request_id").agg(
        F.min("at_ms").alias("first_ms"), (F.count("*") + F.max((F.col("at_ms") < F.col("last")) & (F.col("slot") == F.expr(f"last div {ms}"))).cast("int")).alias("n")
    )


def until_done(items: DataFrame) -> DataFrame:
    """Items of each request before the first that ends it. `items`: request_id, pos, kind, ..."""
    if items.isStreaming:
        return folds.folded(items, folds.UntilDone)
    ended = F.min(F.when(F.col("kind").isin("done", "error"), F.col("pos"))).over(Window.partitionBy("request_id"))
    return items.withColumn("end", ended).filter("end IS NULL OR pos < end OR (pos = end AND kind = 'error')").drop("end")
