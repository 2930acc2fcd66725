"""Texts into passages with their place: one pass over the rows, each text on its own."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import tables

HEADING = re.compile(r"\s*(#{1,6}) (.*\S)\s*$")


def blocks(text: Column) -> Column:
    """Runs of lines that aren't blank."""
    parts = F.split(text, r"\n(?:[ \t\r]*\n)+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\n+|\n+$", "")), lambda x: F.trim(x) != "")


@dataclass(frozen=True)
class Block:
    """Lines that stay together: their numbers, the heading above them, whether they open a section."""

    text: str
    first: int
    last: int
    heading: str = ""
    opens: bool = False


def pieces(lines: list[str], first: int, most: int) -> Iterator[Block]:
    """A run of lines in parts of up to `most` characters: whole lines where they fit, else parts of a line."""
    together: list[str] = []
    begin = first
    for number, line in enumerate(lines, first):
        long = len(line) > most
        for start in range(0, max(1, len(line)), most):
            part = line[start : start + most]
            if together and len("\n".join([*together, part])) > most:
                # what a long line interrupts counts up to that line
                yield Block("\n".join(together), begin, number if long else number - 1)
                together = []
            begin = begin if together else number
            together.append(part)
    if "".join(together).strip():
        yield Block("\n".join(together), begin, first + len(lines) - 1)


def blocks_of(text: str, sections: bool, most: int) -> Iterator[Block]:
    """The blocks of a text; with `sections`, a heading is a block of its own."""
    numbered = [(n, line.removesuffix("\r")) for n, line in enumerate(text.split("\n"), 1)]
    titles = {n: m for n, line in numbered if sections and (m := HEADING.match(line))}
    heading = ""
    # a heading stands alone, other lines run on up to a blank one
    for kind, run in groupby(numbered, lambda x: x[0] if x[0] in titles else -1 if x[1].strip() else 0):
        rows = list(run)
        if kind > 0:
            heading = titles[kind][2].strip()
            yield Block(rows[0][1].strip(), kind, kind, heading, len(titles[kind][1]) <= 2)
        elif kind < 0:
            for b in pieces([line for _, line in rows], rows[0][0], most):
                yield Block(b.text, b.first, b.last, heading)


def gathered(found: Iterable[Block], most: int) -> Iterator[list[Block]]:
    """Blocks in passages of up to `most` characters, two more for each block. A passage begins with the last block of the
    one before if that is short and no section begins there; such a block alone is never handed on."""
    held: list[Block] = []
    repeated = 0
    for block in chain(found, [None]):
        size = sum(len(b.text) + 2 for b in held)
        if len(held) > repeated and (block is None or block.opens or size + len(block.text) + 2 > most):
            yield held
            tail = held[-1]
            again = block is not None and not block.opens and not tail.opens and len(tail.text) <= most // 8
            held, repeated = ([tail], 1) if again else ([], 0)
        if block is not None:
            held = [*held, block]


def pack(text: str, tokens: int, sections: bool, page: int | None = None) -> list[tuple[str, str]]:
    """(location, passage) of about four characters a token: the page, else the section or the lines."""
    most = max(tokens, 50) * 4
    out = []
    for held in gathered(blocks_of(text, sections, most), most):
        if page is not None:
            place = f"p. {page}"
        elif sections:
            place = f"§ {held[0].heading}" if held[0].heading else "début"
        else:
            place = f"L{held[0].first}-{held[-1].last}"
        out.append((place, "\n\n".join(b.text for b in held)))
    return out


def split(texts: DataFrame, tokens: int = 800, sections: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of `keep`, ordinal, location, passage. `texts`: key (any type), and text or pages (an array of
    texts: passages never span two of them); null: none."""
    body = "pages" if "pages" in texts.columns else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, value in enumerate(batch.column(body).to_pylist()):
                parts = [(value or "", None)] if body == "text" else [(p or "", n) for n, p in enumerate(value or [], 1)]
                own = [x for part, page in parts for x in pack(part, tokens, sections, page)]
                at += [i] * len(own)
                found += [(k, *x) for k, x in enumerate(own)]
            rows = pa.array(at, pa.int64())
            cut = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in names], *cut], [*names, "ordinal", "location", "passage"])

    names = ["key", *keep]
    tables.small_batches(texts.sparkSession)
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names)
    return texts.select(*names, body).mapInArrow(run, f"{kinds}, ordinal int, location string, passage string")
