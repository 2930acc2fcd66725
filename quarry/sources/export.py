"""Texts as files that never take the place of another: a name that is taken gets -2, -3, ... before its extension."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import tables

#: The most files of one name, and what is said beyond it.
MOST, TOO_MANY = 999, "trop de fichiers du même nom"


def named(name: str, n: int) -> str:
    """The n-th name: `.md` is added to one without an extension."""
    stem, dot, ext = name.rpartition(".")
    stem, ext = (stem, ext) if dot and stem else (name, "md")
    return f"{stem}.{ext}" if n == 1 else f"{stem}-{n}.{ext}"


def create(folder: str, name: str, body: str) -> tuple[str | None, str | None]:
    """The path written, or why there is none. Creation is exclusive, so two writers never share a file."""
    for n in range(1, MOST + 1):
        path = os.path.join(folder, named(name, n))
        try:
            with open(path, "x", encoding="utf-8") as f:
                f.write(body)
            return path, None
        except FileExistsError:
            continue
        except OSError as e:
            return None, f"{path} : {e.strerror}"
    return None, f"{os.path.join(folder, name)} : {TOO_MANY}"


def write_new(texts: DataFrame, folder: str) -> DataFrame:
    """name, path and error of each text after it was written below a folder that every worker can reach. `texts`: name, body.
    A task that runs again writes its files again under the next free names. The files are there when this returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name").to_pylist()
            made = [create(folder, n, b) for n, b in zip(names, batch.column("body").to_pylist(), strict=True)]
            columns = (names, [m[0] for m in made], [m[1] for m in made])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["name", "path", "error"])

    rows = texts.select(F.coalesce("name", F.lit("conversation")).alias("name"), F.coalesce("body", F.lit("")).alias("body"))
    return tables.written(rows.mapInArrow(run, "name string, path string, error string"))
