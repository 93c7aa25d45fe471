"""The tables of a store, and an upload, a review and a finished document from end to end."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.engine import Engine, NotReady
from quillspark.operators import lines, reconcile
from quillspark.sources import docx_out, files, store


def test_tables_by_key(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "key string, value string")
    got = lambda: sorted(map(tuple, s.read("settings").collect()))
    assert s.read("settings") is None and s.get("settings", "a") is None and s.listed("settings") is None and s.delete("settings", rows()) is None
    s.append("settings", rows(("a", "1"), ("b", "2")))
    s.upsert("settings", rows(("b", "3"), ("c", "4")))
    assert got() == [("a", "1"), ("b", "3"), ("c", "4")]
    s.upsert("settings", rows(("a", "9"), ("a", "5")), at="value")
    s.update("settings", F.col("key") == "c", value=F.lit("7"))
    assert got() == [("a", "9"), ("b", "3"), ("c", "7")] and s.get("settings", "b").first()["value"] == "3"
    s.delete("settings", rows(("b", "")).select("key"))
    s.replace("settings", rows(("x", "7")), ["value"])
    assert got() == [("a", "9"), ("x", "7")]
    assert [r["key"] for r in s.listed("settings", F.desc("value")).collect()] == ["a", "x"]
    assert len(s._versions("settings")) <= 2


def test_documents_are_written_and_read_again(spark):
    rows = [(1, 0, 1, "A & B <c>", "full_name"), (1, 2, 3, "line\nbroken \x01here", "item"), (2, 0, 0, "two", "item"), (3, 0, 0, " ", "item")]
    made = {r["doc_id"]: r for r in docx_out.documents(spark.createDataFrame(rows, "doc_id long, section_ord int, line_ord int, text string, style string")).collect()}
    assert files.docx_lines(bytes(made[1]["content"])) == ["A & B <c>", "line", "broken here"] and made[1]["error"] is None
    assert made[3]["error"] == "no text" and zipfile.ZipFile(io.BytesIO(bytes(made[2]["content"]))).testzip() is None


def test_passages_are_quoted_by_either_way(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "x"), (3, None), (4, "aone two three fourb")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "two three four five six seven eight"), (2, "x"), (3, None), (4, "one two three four"), (5, "two  three four")], "item long, passage string")
    few = sorted(map(tuple, reconcile.quoted(passages, docs, "item").collect()))
    monkeypatch.setattr(reconcile, "MOST_SHORT", 0)
    assert few == sorted(map(tuple, reconcile.quoted(passages, docs, "item").collect())) == [(1, 1), (2, 1), (2, 2), (4, 1), (4, 4), (5, 1), (5, 4)]


def test_lines_of_any_number_of_pieces_keep_their_order(spark):
    long = " ".join(["word AA BB CC"] * 150)
    rows = spark.createDataFrame([(1, 0, long), (1, 1, "after")], "doc_id long, line_no long, line string")
    got = lines.split_caps_runs(rows).orderBy("line_no", "piece").collect()
    assert len(got) == 152 and got[-1]["line"] == "after"


TEXT = """RIN EXAMPLE
Tutor, North College
rin.example@uni.example | +10 55 555 0100

SITE VISITS
Walked the hills north of the old town

AWARDS AND RECOGNITIONS
First prize for teaching of statistics."""


def test_an_upload_to_a_finished_document(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "tables"), 2026)
    engine.teach(spark.createDataFrame([("Site visits", "knowledge_exchange"), ("x", "nowhere")], "heading string, section string"))
    assert [r["heading"] for r in engine.mappings().collect()] == ["Site visits"]
    engine.ingest(spark.createDataFrame([("d1", TEXT), ("d2", None)], "doc_id string, text string"))
    items = {r["section"]: r for r in engine.items("d1").collect()}
    assert items["email"]["fields"]["value"] == "rin.example@uni.example" and items["full_name"]["display"] == "RIN EXAMPLE"
    assert items["knowledge_exchange"]["raw_text"] == "Walked the hills north of the old town" and items["awards"]["status"] == "approved"
    with pytest.raises(NotReady):
        engine.generate("d1")
    done = engine.command(spark.createDataFrame([("d1", "approve all")], "doc_id string, text string")).collect()
    assert done[0]["said"].startswith("Approved ")
    report = engine.report("d1").first()
    assert report["ready"] and report["pending_count"] == 0 and report["coverage"] > 0
    text = files.docx_lines(engine.generate("d1"))
    assert text[0] == "RIN EXAMPLE" and "AWARDS AND RECOGNITIONS" in text and "First prize for teaching of statistics." in text
    engine.save_profiles()
    assert [r["profile_id"] for r in engine.profiles().collect()] == ["rin-example"]
    engine.set_threshold(2)
    assert engine.threshold() == 2.0
    with pytest.raises(ValueError):
        engine.set_threshold(0)
    assert {r["action"] for r in engine.audit().collect()} == {"uploaded", "command"}
    assert engine.sections("d1").count() == 23 and engine.documents().count() == 2
