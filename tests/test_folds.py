"""Requests as a fold: plain versions, batch, and streams that get the items in every way of dealing them out."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.streaming import clock, events, folds

ITEM = "request_id string, pos long, kind string, text string, at_ms long, call_index int, call_id string, call_name string, arguments string, input_tokens long, output_tokens long"


def item(request, pos, kind, text=None, at=0, call=(None, None, None, None), usage=(None, None)):
    return (request, pos, kind, text, at, *call, *usage)


def reply(seed, request, rounds=2, end="done"):
    """A request with phases, tokens, calls in fragments and usage; after its end, items that nobody wants."""
    r, out, at = random.Random(seed), [], 0

    def add(kind, **more):
        nonlocal at
        at += r.choice([0, 30, 200, 700])
        out.append(item(request, len(out), kind, at=at, **more))

    for k in range(rounds):
        add("phase", text="preparing")
        add("phase", text="waiting")
        for w in range(r.randint(0, 5)):
            add("text", text=f"w{w} ")
        add("phase", text="late")
        for part in ("{\"a\":", "1}"):
            for i in r.sample([4, 1, 7], r.randint(0, 3)):
                add("tool", call=(i, f"id{i}" if i == 1 and part[0] == "{" else None, f"n{i}" if part[0] == "{" else None, part))
        if not any(x[2] == "tool" for x in out) or not r.randint(0, 2):
            add("tool", call=(0, None, "blank", " "))
        add("usage", usage=(10 * k, None))
        if k + 1 < rounds:
            add("done")
    if end == "error":
        add("error", text="broken")
    elif end == "done":
        add("done")
        add("text", text="the answer")
        add("done")
    add("text", text="after the end")
    add("done")
    return out


REQUESTS = [*reply(1, "a"), *reply(2, "b", 3, "error"), *reply(3, "c", 1), *reply(4, "d", 10), *reply(5, "e", 2, "error"), item("f", 0, "done"), item("f", 1, "text", "x"), item("g", 0, "error", "no")]
KINDS = [folds.UntilDone, folds.Phases, folds.Calls, folds.Timings, folds.Reply]


def by_hand(kind):
    names = [x.split()[0] for x in ITEM.split(", ")]
    out, now = [], {}
    for row in REQUESTS:
        x = dict(zip(names, row, strict=True))
        one = now.setdefault(x["request_id"], kind())
        if one is not None:
            out += [(x["request_id"], *y) for y in one.step(x)]
            if one.over:
                now[x["request_id"]] = None
    return sorted(out, key=repr)


def test_what_a_reader_is_told():
    told = [x[2:4] for x in by_hand(folds.Reply) if x[0] == "g"] + [x[2:4] for x in by_hand(folds.Reply) if x[0] == "f"]
    assert told == [("error", "no"), ("timing", None), ("done", None)]
    last = max(x for x in by_hand(folds.Reply) if x[0] == "d")
    assert last[2:4] == ("error", "trop d'appels d'outils d'affilée (8)")
    assert len({x[1] for x in by_hand(folds.Calls) if x[0] == "d"}) == 10
    one = folds.Calls()
    for i, text in ((5, "{}"), (2, " ")):
        one.step({"kind": "tool", "call_index": i, "call_id": "", "call_name": "n", "arguments": text})
    assert one.step({"kind": "done"}) == [(0, 2, "call_0_0", "n", "{}"), (0, 5, "call_0_1", "n", "{}")] and not one.over
    one.step({"kind": "tool", "call_index": 0, "call_id": "i", "call_name": "n", "arguments": "x"})
    assert one.step({"kind": "error"}) == [] and one.over


@pytest.mark.parametrize("kind", KINDS)
def test_state_may_be_put_away_after_any_item(kind):
    names = [x.split()[0] for x in ITEM.split(", ")]
    for request in "abcde":
        rows = [dict(zip(names, r, strict=True)) for r in REQUESTS if r[0] == request]
        whole, cut = kind(), kind()
        for x in rows:
            again = kind(cut.values())
            expected = whole.step(x)
            assert again.step(x) == expected and again.over == whole.over
            cut = again
            if whole.over:
                break


@pytest.mark.parametrize("kind", KINDS)
def test_batch_gives_the_rows_of_the_fold(spark, kind):
    shuffled = random.Random(3).sample(REQUESTS, len(REQUESTS))
    got = folds.folded(spark.createDataFrame(shuffled, ITEM), kind)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(kind)


@pytest.mark.parametrize("kind, per_file", [(k, n) for k in KINDS for n in (7,)] + [(folds.Reply, 1), (folds.Reply, 1000), (folds.Calls, 2)])
def test_stream_gives_the_rows_of_the_batch(spark, tmp_path, kind, per_file):
    """Files that hold the next few items of every request."""
    by, deepest = {}, 0
    for r in REQUESTS:
        by.setdefault(r[0], []).append(r)
        deepest = max(deepest, len(by[r[0]]))
    step = max(per_file, deepest // 12)
    for k in range(0, deepest, step):
        rows = [x for own in by.values() for x in own[k : k + step]]
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    stream = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"told_{kind.__name__}_{per_file}"
    run = folds.folded(stream, kind).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table(name).collect()), key=repr) == by_hand(kind)
    # ended requests leave no state; c ends with its last but one item, all do
    left = run.recentProgress[-1].stateOperators[0].numRowsTotal
    assert left == 0


def test_operators_take_a_stream(spark, tmp_path):
    """The batch operators hand a stream to the fold."""
    df = spark.createDataFrame([r for r in REQUESTS if r[0] in "abc"], ITEM)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ITEM).parquet(f"{tmp_path}/in")
    for k, f in enumerate((events.until_done, events.phases_shown, events.tool_calls, events.timings)):
        run = f(stream).writeStream.format("memory").queryName(f"own{k}").option("checkpointLocation", f"{tmp_path}/s{k}").trigger(availableNow=True).start()
        run.awaitTermination()
        assert spark.table(f"own{k}").count()
    kept = {(r["request_id"], r["pos"]) for r in events.until_done(df).collect()}
    assert {(r["request_id"], r["pos"]) for r in spark.table("own0").collect()} == kept


def wait_for(spark, table, rows, seconds=40):
    until = time.time() + seconds
    while time.time() < until and spark.table(table).count() < rows:
        time.sleep(0.3)
    return sorted(map(tuple, spark.table(table).collect()), key=repr)


def test_a_burst_ends_by_the_clock(spark, tmp_path):
    """No event follows the last one of each key."""
    rows = [("a", 0), ("a", 1), ("a", 2), ("b", 1), ("a", 60)]
    spark.createDataFrame(rows, "key string, s long").select("key", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/in")
    run = clock.debounce(stream, 1500).writeStream.format("memory").queryName("closed").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    try:
        got = wait_for(spark, "closed", 3)
        time.sleep(1)
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        run.stop()
    assert [(k, int(b.timestamp()), n) for k, _, b, n in got] == [("a", 2, 3), ("a", 60, 1), ("b", 1, 1)]


def test_the_last_event_is_sent_by_the_clock(spark, tmp_path):
    rows = [("a", 0, 1), ("a", 100, 2), ("a", 499, 3), ("a", 600, 4), ("a", 700, 5), ("b", 5, 6)]
    spark.createDataFrame(rows, "key string, ms long, event_id long").select("key", F.timestamp_millis("ms").alias("ts"), "event_id").coalesce(1).write.parquet(f"{tmp_path}/in")
    whole = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/in")
    run = clock.throttle(stream, 500).writeStream.format("memory").queryName("sent").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    try:
        got = wait_for(spark, "sent", 5)
    finally:
        run.stop()
    assert {(k, e) for k, e, _ in got} == {(r["key"], r["event_id"]) for r in clock.throttle(whole, 500).collect()}
    assert {(k, e) for k, e, final in got if final} == {("a", 5), ("b", 6)}


def test_the_query_of_replies_against_a_fold_by_hand(spark):
    from quarry.plans import catalogue, checked

    items = sorted((r.asDict() for r in checked._items(spark, "/root/testdata/sf0.001").collect()), key=lambda x: x["pos"])
    expected, now = [], {}
    for x in items:
        one = now.setdefault(x["request_id"], folds.Reply())
        if one is not None:
            expected += [(x["request_id"], *y) for y in one.step(x)]
            now[x["request_id"]] = None if one.over else one
    got = catalogue.QUERIES["q_reply"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
