"""Documents read from files, guards on uploads, and the audit stream."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import headings, lines
from quillspark.plans import structure
from quillspark.sources import files
from quillspark.streaming import audit

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def docx(body, header="", links=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {W}>{header}</w:hdr>")
        if links:
            z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
    return out.getvalue()


def p(*runs):
    return "<w:p>" + "".join(f"<w:r>{r if r.startswith('<') else f'<w:t>{r}</w:t>'}</w:r>" for r in runs) + "</w:p>"


def test_docx_lines():
    box = "<mc:AlternateContent><mc:Choice>" + p("In a box") + "</mc:Choice><mc:Fallback>" + p("In a box") + "</mc:Fallback></mc:AlternateContent>"
    body = p("EDUCATION") + p("A", "<w:tab/>", "B", "<w:br/>", "C") + p("EDUCATION") + p("same words here") + p("same words here") + p(box)
    link = '<w:p><w:hyperlink r:id="r1"><w:r><w:t>Home</w:t></w:r></w:hyperlink></w:p>'
    got = files.docx_lines(docx(body + link, p("Page head"), '<Relationship Id="r1" Target="https://uni.example/rin"/>'))
    assert got[0] == "Home: https://uni.example/rin"
    assert got.count("EDUCATION") == 1 and got.count("same words here") == 2 and got.count("In a box") == 1
    assert "A B" in got and "C" in got
    assert got[-1] == lines.MARKER + "Page head"
    with pytest.raises(files.Unreadable):
        files.docx_lines(b"no zip")
    with pytest.raises(files.Unreadable):
        files.docx_lines(docx(""))


def test_files_and_guards(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(p("Hello there")))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.exe").write_bytes(b"x")
    got = {r["path"][-6:]: (r["text"], r["error"]) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("Hello there", None), "/c.pdf": (None, "no reader for this type"), "/d.exe": (None, "unsupported type")}


def test_upload_guard(spark):
    rows = spark.createDataFrame([("/x/a.DOCX", 5), ("/x/b.docx", 0), ("/x/c.pdf", 26 << 20), ("/x/d", 5)], "path string, length long")
    assert [r["error"] for r in files.guarded(rows).orderBy("path").collect()] == [None, "empty file", "too large", "unsupported type"]


def test_empty_and_null_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n")], "doc_id long, text string")
    assert structure.structured(docs).count() == 0


def test_audit_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, "2026-01-01 00:10:00", 1, "a"), (2, "2026-01-01 00:20:00", 1, "a"), (3, "2026-01-01 01:20:00", 2, "b")], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in audit.counts_by_window(events).collect()}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = audit.counts_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("audit").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("audit").collect()} == batch and len(batch) == 2
    assert {tuple(r) for r in audit.latest_status(events).collect()} == {(1, "a"), (2, "b")}


def test_fuzzy_is_pruned_soundly():
    from difflib import SequenceMatcher

    for line in ("ACADAMIC QUALIFCATIONS", "SKILS", "PUBLICATION", "AWARD AND RECOGNITION", "WEATHER"):
        best = max(SequenceMatcher(None, line, phrase).ratio() for phrase, _ in headings.PHRASES)
        assert (headings.fuzzy_key(line) is not None) == (best >= 0.86)
