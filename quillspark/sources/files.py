"""Files as sources: upload guards, DOCX by the standard library, plain text; other formats by a pluggable reader."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lines import MARKER

MOST_MB = 25
SUFFIXES = ["docx", "pdf"]

# Names of the document format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"


class Unreadable(ValueError):
    """A file that gives no text; its message says why."""


def guarded(files: DataFrame, most_mb: int = MOST_MB) -> DataFrame:
    """Adds ``error`` to ``files(path, length, ...)``: a suffix that isn't read, an empty file, one that is too large; null if it may pass."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("error", F.when(~suffix.isin(SUFFIXES), "unsupported type").when(F.col("length") == 0, "empty file").when(F.col("length") > most_mb * 1024 * 1024, "too large"))


def _paragraphs(root: ElementTree.Element) -> Iterator[str]:
    """The own text of each paragraph, text boxes as paragraphs of their own; tabs are spaces, soft breaks new lines."""

    def own(node: ElementTree.Element, out: list[str], boxes: list[ElementTree.Element]) -> None:
        for child in node:
            if child.tag == FALLBACK:
                continue
            if child.tag == f"{W}p":
                boxes.append(child)
            elif child.tag == f"{W}t":
                out.append(child.text or "")
            elif child.tag == f"{W}tab":
                out.append(" ")
            elif child.tag in (f"{W}br", f"{W}cr"):
                out.append("\n")
            else:
                own(child, out, boxes)

    waiting = [root]
    while waiting:
        node = waiting.pop(0)
        out: list[str] = []
        boxes: list[ElementTree.Element] = []
        own(node, out, boxes)
        if node.tag == f"{W}p":
            yield "".join(out)
        waiting = boxes + waiting


def docx_lines(content: bytes) -> list[str]:
    """The lines of a document: links whose target the text doesn't show, the body, then marked headers and footers."""
    try:
        parts = zipfile.ZipFile(io.BytesIO(content))
        body = ElementTree.fromstring(parts.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise Unreadable("not a readable document") from e
    lines, seen = [], set()
    for paragraph in _paragraphs(body):
        for line in map(str.strip, paragraph.splitlines()):
            letters = [c for c in line if c.isalpha()]
            shaped = len(line) <= 60 and len(line.split()) <= 8 and (line.endswith(":") or bool(letters) and sum(map(str.isupper, letters)) / len(letters) >= 0.7)
            if line and not (shaped and line.casefold() in seen):
                lines.append(line)
                seen.add(line.casefold())
    text, links = "\n".join(lines), []
    if "word/_rels/document.xml.rels" in parts.namelist():
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(parts.read("word/_rels/document.xml.rels"))}
        for link in body.iter(f"{W}hyperlink"):
            target = targets.get(link.get(f"{R}id"), "")
            label = "".join(t.text or "" for t in link.iter(f"{W}t")).strip()
            if target.startswith("http") and target not in text and (line := f"{label}: {target}" if label else target) not in links:
                links.append(line)
    margins = []
    for name in sorted(parts.namelist()):
        if name.startswith(("word/header", "word/footer")) and name.endswith(".xml"):
            for paragraph in _paragraphs(ElementTree.fromstring(parts.read(name))):
                margins += [MARKER + x for x in map(str.strip, paragraph.splitlines()) if x and MARKER + x not in margins]
    if not lines:
        raise Unreadable("no text")
    return links + lines + margins


#: Readers by suffix; add one for a format that needs a library of its own.
READERS: dict[str, Callable[[bytes], list[str]]] = {"docx": docx_lines}


def texts(files: DataFrame, readers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """``files(path, content, error)`` with ``text`` in place of content: lines joined by breaks, or why there is none. Files are read where they lie, one by one."""
    known = {**READERS, **(readers or {})}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, errors = [], []
            for p, content, error in zip(*(b.column(c).to_pylist() for c in ("path", "content", "error")), strict=True):
                text = None
                if error is None:
                    reader = known.get(p.rsplit(".", 1)[-1].lower())
                    try:
                        text, error = ("\n".join(reader(content)), None) if reader else (None, "no reader for this type")
                    except Unreadable as e:
                        error = str(e)
                found.append(text)
                errors.append(error)
            rest = [b.column(i) for i, name in enumerate(b.schema.names) if name not in ("content", "error")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found, pa.string()), pa.array(errors, pa.string())], names)

    kept = [f for f in files.schema.fields if f.name not in ("content", "error")]
    names = [*(f.name for f in kept), "text", "error"]
    return files.select(*[f.name for f in kept], "content", "error").mapInArrow(read, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "text string, error string"]))


def read_files(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """(path, text, error) of the files under ``path``."""
    files = guarded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    return texts(files.select("path", "content", "error"), readers)
