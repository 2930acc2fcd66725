"""Answers that were wrong once, and passages against a plain version."""

import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.operators import passages, store, versions
from quarry.sources import ignore


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


MESSAGES = "conv_id long, turn long, role string, text string"
TAILS = "conv_id long, after_seq long, number long, turn long, role string, text string"


@pytest.fixture
def talk(spark):
    return spark.createDataFrame([(c, t, "user", f"{c}.{t}") for c in (1, 2) for t in range(5)], MESSAGES)


def test_two_cuts_of_a_conversation(spark, talk):
    cuts = spark.createDataFrame([(1, 1), (1, 2), (1, 1), (2, None), (2, 3)], "conv_id long, after_seq long")
    kept, tails = versions.archive(talk, spark.createDataFrame([], TAILS), cuts)
    assert rows(kept) == [(1, 0, "user", "1.0"), (1, 1, "user", "1.1")]
    assert rows(tails) == sorted([(1, 1, 1, t, "user", f"1.{t}") for t in (2, 3, 4)] + [(2, None, 1, t, "user", f"2.{t}") for t in range(5)], key=repr)


def test_two_targets_of_a_conversation(spark, talk):
    tails = spark.createDataFrame([(1, 1, 2, 2, "user", "old b"), (1, 3, 2, 4, "user", "old d"), (1, 1, 3, 2, "user", "old c")], TAILS)
    targets = spark.createDataFrame([(1, 3, 2), (1, 1, 3), (1, 1, 2), (1, 0, 7)], "conv_id long, after_seq long, number long")
    shown, kept = versions.switch(talk.filter("conv_id = 1"), tails, targets)
    assert rows(shown) == [(1, 0, "user", "1.0"), (1, 1, "user", "1.1"), (1, 2, "user", "old b")]
    assert len(rows(kept)) == 2 + 3


def test_two_pairs_of_replies(spark, talk):
    pairs = spark.createDataFrame([(1, 0, 1, 2), (1, 3, 1, 4), (1, 0, 1, 2), (1, 0, 1, 4)], "conv_id long, question long, chosen long, other long")
    kept, tails = versions.keep_reply(talk, spark.createDataFrame([], TAILS), pairs)
    assert len(rows(kept)) == 8 and rows(tails) == [(1, 0, 1, 2, "user", "1.2"), (1, 3, 1, 4, "user", "1.4")]


def test_branch_points_without_and_with_their_message(spark, talk):
    tails = spark.createDataFrame([(1, None, 2, 0, "user", "x"), (1, 2, 2, 3, "user", "x"), (1, 4, 2, 5, "user", "x"), (2, 9, 2, 10, "user", "x"), (3, None, 2, 0, "user", "x")], TAILS)
    assert rows(versions.branch_points(talk, tails)) == sorted([(1, None, 0), (1, 2, 3), (1, 4, None), (3, None, None)], key=repr)


def test_two_touches_of_a_document(spark):
    documents = spark.createDataFrame([("c", "a", 1, 5, "h", None), ("c", "b", 1, 5, "h", None)], "collection string, path string, size long, mtime long, hash string, skipped string")
    touched = spark.createDataFrame([("c", "a", 7), ("c", "a", 9)], "collection string, path string, new_mtime long")
    assert [(r["path"], r["mtime"]) for r in store.touch_documents(documents, touched).orderBy("path").collect()] == [("a", 9), ("b", 5)]
    collections = spark.createDataFrame([("c", "r", "m", 0)], "name string, root string, embedding_model string, dims int")
    assert rows(store.set_dims(collections, spark.createDataFrame([("c", 3), ("c", 4)], "name string, found int"))) == [("c", "r", "m", 4)]
    wanted = spark.createDataFrame([("c", "r", "m"), ("c", "s", "m")], "name string, root string, model string")
    assert store.open_collections(collections, documents, wanted)[0].count() == 1


LINES = ["# note", "", "target/", "!keep.md", "*.log", "!keep.log", "a[", "/top", "docs/**/x", "**/build", "q?.t", "[!a-c]1", r"\#odd", r"sp\ ", "end\\", "deep/**", "é*", "[]x", "!", "/", "foo/*.c"]
PATHS = [
    "target/keep.md", "target", "a/target/x", "keep.md", "x.log", "keep.log", "a/keep.log", "z", "top", "top/x", "a/top", "docs/x", "docs/a/b/x", "docs/a/y", "build/z",
    "a/build", "q1.t", "q12.t", "d1", "a1", "#odd", "sp ", "sp", "deep/a", "deep", "élan", "a[", "foo/a.c", "foo/b/a.c", "x.log/file", "new\nline.log", "foo/.c",
]


def test_ignore_rules(spark, tmp_path):
    """Against git itself, where it is installed."""
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    got = {r["path"] for r in df.filter(ignore.ignored(F.col("path"), LINES)).collect()}
    assert "target/keep.md" in got and "keep.log" not in got and "z" not in got and "keep.md" not in got
    # git takes an empty range for its first character; here the rule is no pattern
    assert ignore.rules_of(["[z-a]", "a[", "x\\", "#", ""]) == [] and df.filter(ignore.ignored(F.col("path"), ["[z-a]"])).count() == 0
    (tmp_path / ".gitignore").write_text("\n".join(LINES))
    try:
        subprocess.run(["git", "init", "-q", str(tmp_path)], check=True, capture_output=True)
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("no git")
    asked = "\0".join(PATHS).encode()
    found = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "-z", "--stdin"], input=asked, capture_output=True).stdout
    assert got == {x for x in found.decode().split("\0") if x}


# --- passages


def plain_passages(text, tokens, sections, page=None):
    """Line by line, with every list and length computed anew."""
    most = max(50, tokens) * 4
    lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    found, heading, k = [], "", 0
    while k < len(lines):
        m = re.match(r"\s*(#+) (.*)$", lines[k]) if sections else None
        if m and len(m[1]) <= 6 and m[2].strip():
            heading = m[2].strip()
            found.append((lines[k].strip(), k + 1, k + 1, heading, len(m[1]) <= 2))
            k += 1
            continue
        if not lines[k].strip():
            k += 1
            continue
        run = k
        while k < len(lines) and lines[k].strip() and not (sections and re.match(r"\s*#{1,6} .*\S", lines[k])):
            k += 1
        whole = "\n".join(lines[run:k])
        if len(whole) <= most:
            found.append((whole, run + 1, k, heading, False))
            continue
        now, first = "", run + 1
        for number in range(run + 1, k + 1):
            rest = lines[number - 1]
            while len(rest) > most:
                if now:
                    found.append((now, first, number, heading, False))
                found.append((rest[:most], number, number, heading, False))
                now, rest = "", rest[most:]
            if now and len(now) + 1 + len(rest) > most:
                found.append((now, first, number - 1, heading, False))
                now = ""
            now, first = (now + "\n" + rest, first) if now else (rest, number)
        if now.strip():
            found.append((now, first, k, heading, False))
    out, held, handed = [], [], False

    def emit():
        place = f"p. {page}" if page else (f"§ {held[0][3]}" if held[0][3] else "début") if sections else f"L{held[0][1]}-{held[-1][2]}"
        out.append((place, "\n\n".join(x[0] for x in held)))

    for block in found:
        full = sum(len(x[0]) + 2 for x in held) + len(block[0]) + 2 > most
        if len(held) > handed and (block[4] or full):
            emit()
            last = held[-1]
            handed = len(last[0]) <= most // 8 and not last[4] and not block[4]
            held = [last] if handed else []
        held.append(block)
    if len(held) > handed:
        emit()
    return out


BITS = ["# A", "## B b", "### c ", "#", "x" * 30, "y " * 60, "z" * 450, "", "  ", "w", "\r", "####### no", " # in", "q" * 201, "e\r", "ü" * 199, "# ", "k" * 400]


def test_passages_against_a_plain_version():
    r = random.Random(7)
    for _ in range(6000):
        text = "\n".join(r.choices(BITS, k=r.randint(0, 16)))
        for tokens in (10, 50, 60, 250):
            for sections in (False, True):
                assert passages.pack(text, tokens, sections) == plain_passages(text, tokens, sections), (text, tokens, sections)


@pytest.mark.parametrize("tokens, sections", [(250, False), (250, True), (100, False), (800, False)])
def test_passages_of_a_table(spark, tokens, sections):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS key", "text", "lang")
    expected = [(r["key"], k, *p) for r in df.collect() for k, p in enumerate(plain_passages(r["text"] or "", tokens, sections))]
    assert rows(passages.split(df, tokens, sections)) == sorted(expected, key=repr)


def test_passages_of_pages_and_other_keys(spark):
    pages = spark.createDataFrame([("k1", ["Page un.", None, "Page deux."], "s"), (None, None, "t")], "key string, pages array<string>, source string")
    assert rows(passages.split(pages, keep=("source",))) == [("k1", "s", 0, "p. 1", "Page un."), ("k1", "s", 1, "p. 3", "Page deux.")]
    texts = spark.createDataFrame([("k", "# T\nx"), ("k", "# T\nx"), (None, None)], "key string, text string")
    assert rows(passages.split(texts, sections=True)) == [("k", 0, "§ T", "# T\n\nx")] * 2
