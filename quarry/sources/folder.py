"""A folder of files as a data source: `spark.read.format("folder")`.

Lists path (relative, with slashes), size, mtime (seconds) and kind of the files below a folder that every worker can read,
without reading them. Hidden files, symbolic links and what ignore files leave out aren't listed; each folder may have
ignore files of its own, and a folder that is left out isn't entered. Tasks list subfolders side by side; conditions on
path, kind and size are applied while listing.

Options: `path`; `ignore_files`, names of ignore files, those before others outweighing them; `exclude`, a JSON list of
rules that outweigh all; `types`, a JSON list of extensions (or `code`; none: all). Files of no known kind are left out.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from quarry.functions import columns as C
from quarry.sources.ignore import python_pattern, rules_of

IGNORE_FILES = ".ignore,.gitignore"
#: Folders that tasks list, about, and rows of a batch.
PARTS, ROWS = 64, 5_000
SCHEMA = "path string, size long, mtime long, kind string"

#: One folder's rules of one ignore file: the folder, and (pattern, folders only, takes in again) of each line.
Rules = tuple[str, list[tuple[re.Pattern, bool, bool]]]


def compiled(folder: str, lines: list[str]) -> Rules:
    return folder, [(python_pattern(r.pattern), r.folders_only, r.again) for r in rules_of(lines)]


def decision(rules: list[Rules], path: str, is_folder: bool) -> bool | None:
    """Whether the last fitting rule, of the deepest folder that has one, leaves the path out; null: none fits."""
    for folder, own in reversed(rules):
        inside = path[len(folder) + 1 :] if folder else path
        for pattern, folders_only, again in reversed(own):
            if (is_folder or not folders_only) and pattern.match(inside):
                return not again
    return None


def kind_of(name: str) -> str | None:
    """As `columns.file_kind`."""
    low = name.lower()
    if low in C.CODE_NAMES:
        return "code"
    stem, dot, ext = low.rpartition(".")
    if not dot or not stem:
        return None
    kinds = {"markdown": C.MARKDOWN, "text": C.TEXT, "code": C.CODE}
    return next((k for k, own in kinds.items() if ext in own), ext if ext in ("pdf", "docx", "odt") else None)


@dataclass
class Folder(D.InputPartition):
    """A folder with the rules that hold in it: of each ignore-file name, from the root down. `deep`: with its subfolders."""

    path: str
    rules: list[list[Rules]]
    deep: bool

    def __init__(self, path: str, rules: list[list[Rules]], deep: bool = True):
        self.path, self.rules, self.deep = path, rules, deep


@dataclass
class Wanted:
    """Conditions that were pushed down."""

    prefix: str = ""
    kinds: set[str] | None = None
    least: int = 0
    most: int = 1 << 62
    equal: set[str] | None = field(default=None)


class FolderReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file:").rstrip("/") or "/"
        self.names = [n for n in options.get("ignore_files", IGNORE_FILES).split(",") if n]
        self.exclude = [compiled("", json.loads(options.get("exclude", "[]")))]
        self.types = set(json.loads(options.get("types", "[]")))
        self.wanted = Wanted()

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            w = self.wanted
            if isinstance(f, D.EqualTo) and column == "kind":
                w.kinds = {f.value} & (w.kinds if w.kinds is not None else {f.value})
            elif isinstance(f, D.In) and column == "kind":
                w.kinds = set(f.value) & (w.kinds if w.kinds is not None else set(f.value))
            elif isinstance(f, D.EqualTo) and column == "path":
                w.equal = {f.value} & (w.equal if w.equal is not None else {f.value})
            elif isinstance(f, D.StringStartsWith) and column == "path" and f.value.startswith(w.prefix):
                w.prefix = f.value
            elif isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual)) and column == "size":
                w.least = max(w.least, f.value + isinstance(f, D.GreaterThan))
            elif isinstance(f, (D.LessThan, D.LessThanOrEqual)) and column == "size":
                w.most = min(w.most, f.value - isinstance(f, D.LessThan))
            elif not (isinstance(f, D.IsNotNull) and column in ("path", "size", "mtime", "kind")):
                yield f

    def partitions(self) -> list[Folder]:
        """Folders from the top down, until there are enough: those opened for it are parts without their subfolders."""
        queue, opened = deque([Folder("", [[] for _ in self.names])]), []
        while queue and len(queue) + len(opened) < PARTS:
            now = queue.popleft()
            opened.append(Folder(now.path, now.rules, False))
            queue.extend(self._subfolders(now))
        return [*opened, *queue]

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        stack = [part]
        while stack:
            now = stack.pop()
            rows += self._files(now)
            if part.deep:
                stack += self._subfolders(now)
            while len(rows) >= ROWS:
                yield self._batch(rows[:ROWS])
                rows = rows[ROWS:]
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "size", "mtime", "kind"])

    def _rules_in(self, folder: Folder) -> list[list[Rules]]:
        """The rules for what lies in a folder: those that hold for it, and those of its own ignore files."""
        out = []
        for name, above in zip(self.names, folder.rules, strict=True):
            try:
                with open(os.path.join(self.root, folder.path, name), encoding="utf-8", errors="replace") as f:
                    out.append([*above, compiled(folder.path, f.read().split("\n"))])
            except OSError:
                out.append(above)
        return out

    def _listed(self, folder: Folder, rules: list[list[Rules]], folders: bool) -> Iterator[tuple[os.DirEntry, str]]:
        try:
            with os.scandir(os.path.join(self.root, folder.path)) as entries:
                found = sorted(entries, key=lambda e: e.name)
        except OSError:
            # a folder that went away or can't be read has no files
            return
        for e in found:
            path = f"{folder.path}/{e.name}" if folder.path else e.name
            if (e.is_dir(follow_symlinks=False) if folders else e.is_file(follow_symlinks=False)) and not self._left_out(path, folders, rules):
                yield e, path

    def _left_out(self, path: str, is_folder: bool, rules: list[list[Rules]]) -> bool:
        for own in (self.exclude, *rules):
            found = decision(own, path, is_folder)
            if found is not None:
                return found
        return path.rpartition("/")[2].startswith(".")

    def _subfolders(self, folder: Folder) -> list[Folder]:
        rules, w = self._rules_in(folder), self.wanted
        return [
            Folder(path, rules)
            for _, path in self._listed(folder, rules, True)
            if f"{path}/".startswith(w.prefix[: len(path) + 1]) and (w.equal is None or any(x.startswith(f"{path}/") for x in w.equal))
        ]

    def _files(self, folder: Folder) -> Iterator[tuple]:
        w = self.wanted
        for e, path in self._listed(folder, self._rules_in(folder), False):
            kind = kind_of(e.name)
            ext = e.name.lower().rpartition(".")[2]
            if kind is None or self.types and ext not in self.types and not (kind == "code" and "code" in self.types):
                continue
            if not path.startswith(w.prefix) or w.kinds is not None and kind not in w.kinds or w.equal is not None and path not in w.equal:
                continue
            try:
                stat = e.stat(follow_symlinks=False)
            except OSError:
                continue
            if w.least <= stat.st_size <= w.most:
                yield path, stat.st_size, int(stat.st_mtime), kind


class FolderSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def read(spark: SparkSession, root: str, exclude: list[str] | None = None, types: list[str] | None = None, ignore_files: str = IGNORE_FILES) -> DataFrame:
    """The files below a folder; see above. Lets the session hand conditions to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
    reader = spark.read.format("folder").option("path", root).option("ignore_files", ignore_files)
    return reader.option("exclude", json.dumps(exclude or [])).option("types", json.dumps(types or [])).load()
