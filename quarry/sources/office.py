"""Contents of files as text: decoded text, word-processor files, attachments. Each file is one row and one helper call;
files beyond the size limits are left out before their content is read."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import columns as C

#: Reasons why a file has no text, and the largest attachments in bytes.
BINARY, NO_TEXT, UNREADABLE = "fichier binaire", "aucun texte", "document illisible"
ATTACHMENT_LIMIT, IMAGE_LIMIT, MOST_ENTRIES = 256 * 1024, 5 * 1024 * 1024, 300
IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}

_STYLE = re.compile(r"(?:heading|titre)\s*\+?(\d+)\s*$", re.I)


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _value(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def _paragraphs(found: Iterator[tuple[str, int]]) -> str:
    """Each paragraph after its heading marks, ended by a blank line; empty ones don't count."""
    return "".join(f"{'#' * level + ' ' if level else ''}{text.strip()}\n\n" for text, level in found if text.strip())


def docx_text(raw: bytes) -> str:
    """word/document.xml with headings as Markdown."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))

    def each() -> Iterator[tuple[str, int]]:
        marks = {"tab": "\t", "br": "\n", "cr": "\n"}
        for paragraph in (x for x in root.iter() if _local(x.tag) == "p"):
            level, parts = 0, []
            for x in paragraph.iter():
                name = _local(x.tag)
                if name == "pStyle":
                    m = _STYLE.fullmatch((_value(x, "val") or "").strip())
                    level = int(m[1]) if m and 1 <= int(m[1]) <= 6 else 0
                elif name == "t":
                    parts.append(x.text or "")
                elif name in marks and x is not paragraph:
                    parts.append(marks[name])
            yield "".join(parts), level

    return _paragraphs(each())


def odt_text(raw: bytes) -> str:
    """content.xml with headings as Markdown; a paragraph inside another belongs to it."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("content.xml"))
    marks = {"s": " ", "tab": "\t", "line-break": "\n"}

    def inner(x: ElementTree.Element) -> str:
        return (x.text or "") + "".join(marks.get(_local(y.tag), "") + inner(y) + (y.tail or "") for y in x)

    def each(x: ElementTree.Element) -> Iterator[tuple[str, int]]:
        for y in x:
            if _local(y.tag) in ("p", "h"):
                level = (_value(y, "outline-level") or "1") if _local(y.tag) == "h" else "0"
                yield inner(y), int(level) if level.isdigit() else 1
            else:
                yield from each(y)

    return _paragraphs(each(root))


def text_of(kind: str, raw: bytes) -> tuple[str | None, str | None]:
    """The text, or the reason why there is none."""
    try:
        if kind in ("docx", "odt"):
            text = docx_text(raw) if kind == "docx" else odt_text(raw)
        elif b"\x00" in raw:
            return None, BINARY
        else:
            text = raw.decode(errors="replace")
    except (KeyError, ElementTree.ParseError, zipfile.BadZipFile) as e:
        return None, f"{UNREADABLE} ({type(e).__name__})"
    return (text, None) if text.strip() else (None, NO_TEXT)


def extract(files: DataFrame) -> DataFrame:
    """path, kind, text and reason (why there is no text). `files`: path, content; kinds that can't be read are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [text_of(kind, bytes(raw)) for kind, raw in zip(frame["kind"], frame["content"], strict=True)]
            yield frame[["path", "kind"]].assign(text=[x[0] for x in found], reason=[x[1] for x in found])

    tables.small_batches(files.sparkSession)
    known = files.select("path", C.file_kind(F.col("path")).alias("kind"), "content").filter("kind IS NOT NULL AND kind <> 'pdf'")
    return known.mapInPandas(run, "path string, kind string, text string, reason string")


def attachments(files: DataFrame) -> DataFrame:
    """path, text or image (media_type, base64), or the reason for a refusal. `files`: path, size, content."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    media = F.create_map(*[F.lit(x) for pair in IMAGES.items() for x in pair])[ext]
    image = media.isNotNull()
    text = F.try_validate_utf8(F.col("content").cast("string"))
    reason = (
        F.when(image & (F.col("size") > IMAGE_LIMIT), "too large")
        .when(~image & (F.col("size") > ATTACHMENT_LIMIT), "too large")
        .when(~image & F.contains(F.hex("content"), F.lit("00")) & F.hex("content").rlike("^(..)*00"), "not text")
        .when(~image & text.isNull(), "not UTF-8")
    )
    return files.select("path", reason.alias("reason"), media.alias("media"), text.alias("own"), "content").select(
        "path", "reason",
        F.when(F.col("reason").isNull() & F.col("media").isNull(), F.col("own")).alias("text"),
        F.when(F.col("reason").isNull() & F.col("media").isNotNull(), F.struct(F.col("media").alias("media_type"), F.base64("content").alias("base64"))).alias("image"),
    )


def listings(entries: DataFrame) -> DataFrame:
    """folder and text: the first names of each folder in order, folders with a slash, hidden ones left out, and how many
    more there are. `entries`: folder, name, is_folder."""
    shown = entries.filter(~F.col("name").startswith(".")).withColumn("name", F.concat("name", F.when(F.col("is_folder"), "/").otherwise("")))
    # names of one folder: what a listing shows has a limit, so only those come together
    order = Window.partitionBy("folder").orderBy("name")
    first = shown.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MOST_ENTRIES)
    text = first.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), "\n").alias("text"))
    count = shown.groupBy("folder").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > MOST_ENTRIES, F.concat(F.lit("\n[… "), (F.col("n") - MOST_ENTRIES).cast("string"), F.lit(" autres]"))).otherwise("")
    return (
        entries.select("folder").distinct().join(text, "folder", "left").join(count, "folder", "left")
        .select("folder", F.coalesce(F.concat("text", more), F.lit("(dossier vide)")).alias("text"))
    )
