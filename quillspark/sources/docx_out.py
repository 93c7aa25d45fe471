"""Finished documents as DOCX: rendered lines to bytes, one file for each document, checked by reading it again."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import W, Unreadable, docx_lines

_NS = W.strip("{}")
# The parts that the format asks for.
_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}
#: Style of a line: bold, and size in half points.
STYLES = {"full_name": (True, 32), "job_title": (False, 24), "heading": (True, 24), "subheading": (True, 22)}
_NOT_XML = {c: None for c in [*range(9), 11, 12, *range(14, 32)]}


def docx_bytes(lines: list[tuple[str, str]]) -> bytes:
    """A document of (text, style) lines; breaks within a line stay."""
    body = []
    for text, style in lines:
        bold, size = STYLES.get(style, (False, 22))
        looks = f"<w:rPr>{'<w:b/>' if bold else ''}<w:sz w:val=\"{size}\"/></w:rPr>"
        runs = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(part.translate(_NOT_XML))}</w:t>' for part in text.split("\n"))
        body.append(f"<w:p><w:r>{looks}{runs}</w:r></w:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in _PARTS.items():
            z.writestr(name, part)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_NS}"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


def documents(lines: DataFrame) -> DataFrame:
    """(doc_id, content, error) of ``lines(doc_id, section_ord, line_ord, text, style)``: a file for each document, and why it can't be read again if it can't."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents, errors = [], []
            for rows in b.column("lines").to_pylist():
                content, error = docx_bytes([(r["text"], r["style"]) for r in rows]), None
                try:
                    docx_lines(content)
                except Unreadable as e:
                    error = str(e)
                contents.append(content)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], ["doc_id", "content", "error"])

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "line_ord", "text", "style"))), lambda x: F.struct(x["text"].alias("text"), x["style"].alias("style")))
    whole = lines.where("text is not null").groupBy("doc_id").agg(ordered.alias("lines"))
    return whole.mapInArrow(made, f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, content binary, error string")
