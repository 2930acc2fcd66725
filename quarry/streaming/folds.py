"""Per-request state: what depends on earlier items of a request, as a fold over its items in order.

A fold keeps a few fields for each request. As a batch, items pass sorted by request, and one fold is held at a time. As a
stream, the fields are the state of the request (`applyInPandasWithState`): however the items are dealt over micro-batches,
the rows are those of the batch. A request begins with the item at pos 0; its state goes when the request ends, and items
that come later, which have another pos, are dropped with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: What a request that calls tools too often ends with, the rounds that it may take, the time between timings.
TOO_MANY_ROUNDS = "trop d'appels d'outils d'affilée (%d)"
MOST_ROUNDS, TIMING_MS = 8, 500


class Fold:
    """Fields with their types and first values; `step` takes an item (a dict) and returns rows; `over` ends the request."""

    fields: dict[str, tuple[str, object]] = {}
    #: Columns of the rows that `step` returns; the request comes first.
    result = ""

    def __init__(self, values: tuple | None = None):
        first = tuple(value for _, value in self.fields.values())
        for name, value in zip(self.fields, first if values is None else values, strict=True):
            setattr(self, name, list(value) if isinstance(value, (list, tuple)) else value)
        self.over = False

    def values(self) -> tuple:
        return tuple(getattr(self, name) for name in self.fields)

    def step(self, item: dict) -> list[tuple]:
        raise NotImplementedError

    def finish(self) -> list[tuple]:
        """What a batch still has to say of a request that never ended."""
        return []


class UntilDone(Fold):
    """Items before the first that ends the request, and that one if it is an error."""

    result = "kind string, text string, pos long"

    def step(self, item: dict) -> list[tuple]:
        self.over = item["kind"] in ("done", "error")
        return [] if item["kind"] == "done" else [(item["kind"], item.get("text"), item["pos"])]


class Phases(Fold):
    """Items without the phases that come after the first token."""

    fields = {"spoken": ("boolean", False)}
    result = "kind string, text string, pos long"

    def step(self, item: dict) -> list[tuple]:
        self.over = item["kind"] in ("done", "error")
        self.spoken = self.spoken or item["kind"] == "text"
        return [] if item["kind"] == "phase" and self.spoken else [(item["kind"], item.get("text"), item["pos"])]


class Calls(Fold):
    """Tool calls, put together from fragments, when their round is done; an error drops what is pending."""

    fields = {
        "round": ("int", 0), "index": ("array<int>", []), "call_id": ("array<string>", []), "call_name": ("array<string>", []),
        "arguments": ("array<string>", []),
    }
    result = "round int, call_index int, call_id string, call_name string, arguments string"

    def step(self, item: dict) -> list[tuple]:
        if item["kind"] == "tool":
            self.take(item)
        elif item["kind"] == "error":
            self.over = True
        elif item["kind"] == "done":
            self.over = not self.index
            return self.finished()
        return []

    def take(self, item: dict) -> None:
        number = int(item["call_index"])
        if number not in self.index:
            self.index.append(number)
            for parts in (self.call_id, self.call_name, self.arguments):
                parts.append("")
        k = self.index.index(number)
        for name in ("call_id", "call_name", "arguments"):
            getattr(self, name)[k] += item.get(name) or ""

    def finished(self) -> list[tuple]:
        """The calls of the round in order of index; one without an id is named by its round and place."""
        order = sorted(range(len(self.index)), key=lambda k: self.index[k])
        out = [
            (self.round, self.index[k], self.call_id[k] or f"call_{self.round}_{place}", self.call_name[k], self.arguments[k] if self.arguments[k].strip() else "{}")
            for place, k in enumerate(order)
        ]
        self.round += bool(out)
        self.index, self.call_id, self.call_name, self.arguments = [], [], [], []
        return out


class Timings(Fold):
    """A timing for a token that comes `TIMING_MS` or more after the last one, and a last one when the request is done:
    milliseconds to the first token (null: none yet) and since the start."""

    fields = {"first_ms": ("long", None), "sent_ms": ("long", 0)}
    result = "first_ms long, elapsed_ms long, final boolean"

    def step(self, item: dict) -> list[tuple]:
        at = item["at_ms"]
        if item["kind"] == "text":
            self.first_ms = at if self.first_ms is None else self.first_ms
            if at - self.sent_ms >= TIMING_MS:
                self.sent_ms = at
                return [(self.first_ms, at, False)]
        elif item["kind"] == "done":
            self.over = True
            return [(self.first_ms, at, True)]
        self.over = item["kind"] == "error"
        return []


class Reply(Calls):
    """Everything that a reader of a reply is told, numbered: phases up to the first token, tokens, timings, usage, the
    calls of each round, and how it ends. A request that calls tools in `MOST_ROUNDS` rounds ends with an error."""

    fields = Calls.fields | Timings.fields | {"n": ("long", 0)}
    result = (
        "n long, kind string, text string, call_id string, call_name string, arguments string, input_tokens long, output_tokens long, first_ms long, elapsed_ms long"
    )

    def _told(self, kind: str, text: str | None = None, call: tuple = (None, None, None), usage: tuple = (None, None), times: tuple = (None, None)) -> tuple:
        self.n += 1
        return (self.n - 1, kind, text, *call, *usage, *times)

    def step(self, item: dict) -> list[tuple]:
        kind, at = item["kind"], item["at_ms"]
        if kind == "text":
            self.first_ms = at if self.first_ms is None else self.first_ms
            out = [self._told("token", item["text"])]
            if at - self.sent_ms >= TIMING_MS:
                self.sent_ms = at
                out.append(self._told("timing", times=(self.first_ms, at)))
            return out
        if kind == "phase":
            return [] if self.first_ms is not None else [self._told("phase", item["text"])]
        if kind == "usage":
            return [self._told("usage", usage=(item.get("input_tokens"), item.get("output_tokens")))]
        if kind == "tool":
            self.take(item)
            return []
        self.over = True
        if kind == "error":
            return [self._told("error", item["text"])]
        calls = self.finished()
        if not calls:
            return [self._told("timing", times=(self.first_ms, at)), self._told("done")]
        self.over = self.round >= MOST_ROUNDS
        out = [self._told("call", call=c[2:]) for c in calls]
        return out + ([self._told("error", TOO_MANY_ROUNDS % MOST_ROUNDS)] if self.over else [])


def _plain(value: object) -> object:
    """Pandas has floats and NaN where a column of whole numbers holds nulls."""
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    return int(value) if isinstance(value, float) and value.is_integer() else value


def _items(frame: pd.DataFrame) -> Iterator[dict]:
    names = list(frame.columns)
    for row in frame.itertuples(index=False, name=None):
        yield dict(zip(names, map(_plain, row), strict=True))


def folded(items: DataFrame, kind: type[Fold]) -> DataFrame:
    """request_id and the fold's rows. `items`: request_id, pos, and what the fold reads (kind, text, at_ms, call_index, call_id,
    call_name, arguments, input_tokens, output_tokens), in order of pos; a micro-batch brings what follows earlier ones."""
    own = items.schema["request_id"].dataType.simpleString()
    order = [c for c in ("pos", "item") if c in items.columns]
    schema = f"request_id {own}, {kind.result}"
    names = ["request_id", *[x.split()[0] for x in kind.result.split(", ")]]

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names, dtype=object)

    if items.isStreaming:
        fields = ", ".join(f"{name} {type_}" for name, (type_, _) in kind.fields.items()) or "begun boolean"

        def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            now = kind(state.get if kind.fields else ()) if state.exists else None
            out = []
            # the rows of one request in one micro-batch
            for item in _items(pd.concat(list(frames)).sort_values(order, kind="stable")):
                if now is None and item["pos"] == 0 and not item.get("item"):
                    now = kind()
                if now is not None:
                    out += [(key[0], *x) for x in now.step(item)]
                    now = None if now.over else now
            if now is not None:
                state.update(now.values() if kind.fields else (True,))
            elif state.exists:
                state.remove()
            yield frame_of(out)

        return items.groupBy("request_id").applyInPandasWithState(run, schema, fields, "append", "NoTimeout")

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now, fresh = None, None, True
        for frame in frames:
            out = []
            for item in _items(frame):
                if fresh or item["request_id"] != at:
                    at, fresh = item["request_id"], False
                    now = kind()
                if now is not None:
                    out += [(at, *x) for x in now.step(item)]
                    now = None if now.over else now
            yield frame_of(out)

    return items.repartition("request_id").sortWithinPartitions("request_id", *order).mapInPandas(whole, schema)
