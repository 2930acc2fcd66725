"""The folder source against git's own listing, and its conditions."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.sources import folder


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    r = random.Random(2)
    names = ["a.md", "b.py", "c.log", "keep.log", "d.txt", "makefile", "e.bin", "tmp.md", "x1.rs", ".hidden.md"]
    folders = ["", "src", "src/deep", "src/deep/er", "build", "build/out", "docs", "docs/build", "target", "target/debug", "docs/old/older", ".dot", "src/keepme", "vendor/a", "vendor/b"]
    for f in folders:
        (root / f).mkdir(parents=True, exist_ok=True)
        for n in names:
            (root / f / n).write_text("x" * r.randint(0, 50))
    rules = {
        "": "# top\n*.log\n!keep.log\n/target/\nbuild/\n!target/keep\n[z-\ntmp.*\n",
        "docs": "!build/\n/old/*\n!/old/older\n*.txt\n",
        "docs/old/older": "a.*\n",
        "src": "deep/er\nkeepme/\n!keepme/\n!c.log\n",
        "src/deep": "*\n!*.py\n!.gitignore\n!keepme\n",
        "vendor": "b\n!b/a.md\n",
        "vendor/a": "*.md\n",
        "target": "!*\n",
    }
    for f, text in rules.items():
        (root / f / ".gitignore").write_text(text)
    os.symlink(root / "a.md", root / "link.md")
    os.symlink(root / "src", root / "linked")
    return root


def listed(df):
    return {r["path"] for r in df.collect()}


def test_the_same_files_as_git_lists(spark, tree):
    try:
        subprocess.run(["git", "init", "-q", str(tree)], check=True, capture_output=True)
        found = subprocess.run(["git", "-C", str(tree), "ls-files", "-z", "--others", "--exclude-per-directory=.gitignore"], check=True, capture_output=True).stdout.decode().split("\0")
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("no git")
    known = {p for p in found if p and not any(x.startswith(".") for x in p.split("/")) and p not in ("link.md", "linked") and folder.kind_of(p.rpartition("/")[2])}
    got = listed(folder.read(spark, str(tree)))
    assert got == known and "docs/build/a.md" in got and "build/a.md" not in got and "src/deep/b.py" in got and "target/a.md" not in got


@pytest.mark.parametrize("parts", [1, 4, 1000])
def test_parts_list_every_file_once(spark, tree, monkeypatch, parts):
    whole = listed(folder.read(spark, str(tree)))
    monkeypatch.setattr(folder, "PARTS", parts)
    rows = [r["path"] for r in folder.read(spark, str(tree)).collect()]
    assert sorted(rows) == sorted(whole)


def test_conditions_are_applied_while_listing(spark, tree):
    df = folder.read(spark, str(tree))
    every = df.collect()
    for condition, keep in (
        ((F.col("size") > 20) & (F.col("size") <= 40), lambda r: 20 < r["size"] <= 40),
        (F.col("kind").isin("code", "text"), lambda r: r["kind"] in ("code", "text")),
        (F.col("kind") == "markdown", lambda r: r["kind"] == "markdown"),
        (F.col("path").startswith("src/deep"), lambda r: r["path"].startswith("src/deep")),
        (F.col("path") == "src/b.py", lambda r: r["path"] == "src/b.py"),
        ((F.col("kind") == "code") & (F.col("size") < 30) & F.col("path").endswith(".rs"), lambda r: r["kind"] == "code" and r["size"] < 30 and r["path"].endswith(".rs")),
    ):
        assert sorted(map(tuple, df.filter(condition).collect())) == sorted(tuple(r) for r in every if keep(r))
    reader = folder.FolderReader({"path": str(tree)})
    rest = list(reader.pushFilters([folder.D.StringStartsWith(("path",), "src/deep"), folder.D.LessThan(("size",), 9), folder.D.StringEndsWith(("path",), "x")]))
    assert len(rest) == 1 and {p.path for p in reader.partitions()} == {"", "src", "src/deep"}


def test_excluded_and_typed(spark, tree):
    got = listed(folder.read(spark, str(tree), exclude=["docs/", "*.py", "[z-a]"], types=["md", "code"]))
    assert got and not any(p.startswith("docs/") or p.endswith(".py") for p in got) and {p.rpartition(".")[2].rpartition("/")[2] for p in got} == {"md", "rs", "makefile"}
    (tree / ".ignore").write_text("!c.log\nsrc\n")
    try:
        first = listed(folder.read(spark, str(tree)))
        assert "c.log" in first and not any(p.startswith("src/") for p in first)
        assert any(p.startswith("src/") for p in listed(folder.read(spark, str(tree), ignore_files=".gitignore")))
    finally:
        (tree / ".ignore").unlink()


def test_kinds_are_those_of_the_column_function(spark):
    names = ["a.md", "A.MD", ".md", "makefile", "Dockerfile", "x.tar.gz", "a.", "noext", "x.PDF", "b.docx", "c.odt", "d.yaml", ".hidden.py", "e.csv"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r["name"]: r["k"] for r in df.select("name", C.file_kind(F.col("name")).alias("k")).collect()} == {n: folder.kind_of(n) for n in names}


def test_a_folder_that_is_not_there(spark, tmp_path):
    assert folder.read(spark, str(tmp_path / "none")).count() == 0
