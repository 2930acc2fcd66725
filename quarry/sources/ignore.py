"""Ignore rules: which paths the lines of ignore files leave out.

A rule is a line of such a file. Among the rules that fit a path the last decides, and one with `!` takes it in again;
what lies in a folder that is left out can't be taken in again. Lines that make no valid pattern are skipped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`pattern` fits a whole path, relative to the folder of the ignore file."""

    pattern: str
    folders_only: bool
    again: bool


def _character_class(body: str) -> str | None:
    """A bracket expression for both regular-expression engines; null if it isn't valid."""
    negated = body[:1] in ("!", "^")
    inner = body[1:] if negated else body
    out, i = "", 0
    while i < len(inner):
        first = inner[i]
        if inner[i + 1 : i + 2] == "-" and i + 2 < len(inner):
            last = inner[i + 2]
            if last < first:
                return None
            out, i = out + f"\\x{{{ord(first):x}}}-\\x{{{ord(last):x}}}", i + 3
        else:
            out, i = out + f"\\x{{{ord(first):x}}}", i + 1
    return f"[{'^/' if negated else ''}{out}]" if out else None


def rule_of(line: str) -> Rule | None:
    """The rule of a line; null for comments, blank lines and what isn't a valid pattern."""
    body = line.rstrip("\r\n")
    while body.endswith(" ") and not body.endswith("\\ "):
        body = body[:-1]
    if not body or body.startswith("#"):
        return None
    again = body.startswith("!")
    body = body[1:] if again else body
    folders_only = body.endswith("/")
    body = body[:-1] if folders_only else body
    anchored = "/" in body
    body = body.removeprefix("/")
    if not body:
        return None
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body[i:] == "**" and i and body[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            while body[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            end = body.find("]", i + 2)
            piece = _character_class(body[i + 1 : end]) if end > 0 else None
            if piece is None:
                return None
            out, i = out + piece, end + 1
        else:
            if c == "\\":
                if i + 1 == len(body):
                    return None
                i, c = i + 1, body[i + 1]
            out, i = out + (c if c.isalnum() or c in "_/" else f"\\x{{{ord(c):x}}}"), i + 1
    return Rule(f"(?s)^{'' if anchored else '(?:.*/)?'}{out}$", folders_only, again)


def rules_of(lines: list[str]) -> list[Rule]:
    return [r for r in map(rule_of, lines) if r is not None]


def python_pattern(pattern: str) -> re.Pattern:
    """The same pattern for Python, which writes a code point in another way."""
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the rules leave out a file: the file itself, or a folder that it lies in."""
    rules = rules_of(lines)
    parts = F.split(path, "/")

    def left_out(depth: Column) -> Column:
        part = F.array_join(F.slice(parts, F.lit(1), depth), "/")
        out = F.lit(False)
        for rule in rules:
            fits = part.rlike(rule.pattern) & (F.lit(not rule.folders_only) | (depth < F.size(parts)))
            out = F.when(fits, F.lit(not rule.again)).otherwise(out)
        return out

    return F.exists(F.sequence(F.lit(1), F.size(parts)), left_out) if rules else F.lit(False)
