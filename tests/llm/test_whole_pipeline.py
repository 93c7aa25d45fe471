"""Passages of the benchmark without an id mark words, and the pipeline takes out what holds them."""

import corpus_pipeline
import pytest
from quillspark.llm import decontaminate


@pytest.mark.parametrize("pass_bytes, segment", [(8 << 20, 1 << 18), (60, 20)])
def test_passages_without_an_id_go(spark, tmp_path, monkeypatch, pass_bytes, segment):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(decontaminate, "SEGMENT_TOKENS", segment)
    passages = {k: " ".join(f"{k}{i}" for i in range(15)) for k in "abc"}
    items = spark.createDataFrame([(None, passages["a"]), (7, passages["b"]), (None, None)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(passages.values())), "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [2]
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    assert [(got[d]["n_hit"], list(got[d]["items"])) for d in range(3)] == [(15, []), (15, ["7"]), (0, [])]
