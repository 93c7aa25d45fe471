"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, langid, mixing, sharding, simhash
from quillspark.llm.common import cut, remove, shared_folder, small, swept, table

def _key() -> Column:
    return F.xxhash64("row.doc_id", "row.text")


def _packed(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as one struct, so that no name of its columns meets one used here."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows that have the id and the hash of id and text of one of ``rows(doc_id, row_key)``; few are broadcast, many are joined by shuffle."""
    gone = small(cut(rows.select(F.col("row_key").alias("gone"), F.col("doc_id").alias("id")).distinct()))
    return _packed(docs).join(gone, (_key() == F.col("gone")) & F.col("row.doc_id").eqNullSafe(F.col("id")), "left_anti").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language identifier rejects go: no letter (so also null and empty texts), or too far from every centroid.

    Each row is judged by its text where it lies, without a join; repeated rows alike, long texts whole. An empty table, or one
    without labels to learn from, keeps nothing.
    """
    return docs.where(langid.accepted(langid.fit(docs))(F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id, once if its row is repeated.

    Null, empty and blank texts are one group. Of rows that share the least id, one stays: that with the least hash of id and text. A group
    without any id keeps one row. Long texts are compared whole; an empty table stays empty.
    """
    found = cut(simhash.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "row_key", "component", "component_id"))
    # of each group the least id, and of rows that share that id one key
    leaders = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row_key").alias("stays"), F.count("*").alias("rows"))
    leaders = cut(leaders)
    kept = _without(docs, found.join(leaders.select("component", F.col("stays").alias("row_key")), ["component", "row_key"], "left_anti"))
    if leaders.where("rows > 1").isEmpty():
        return kept
    again = small(cut(leaders.where("rows > 1").select(F.col("stays").alias("again"))))
    held = _packed(kept)
    once = held.join(again, _key() == F.col("again"), "left_semi").withColumn("key", _key()).dropDuplicates(["key"]).select("row.*")
    return held.join(again, _key() == F.col("again"), "left_anti").select("row.*").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go, also of passages without an id.

    Null and empty texts hold none and stay; repeated rows go or stay alike; long texts are searched whole; an empty table stays empty.
    """
    return _without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it, in whole copies.

    A null source is one of its own; null and empty texts weigh nothing and follow their source's rate; repeated rows draw alike; an empty table stays empty.
    """
    return mixing.emitted(mixing.mix(docs))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the shard it belongs to.

    Null ids share their bits, and the copies of a document its shard; a bucket of one id above the limit goes on in pages; null texts weigh nothing; a text above
    the limit has a page of its own; an empty table stays empty.
    """
    return sharding.shard(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
    ("shards", shards),
]

#: SQL can't express the language identifier; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what lies between them is in the shared folder, as long as it is needed."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        if before is not None:
            remove(spark, before)
        before = f"{folder}/{k}-{name}"
        docs = spark.read.parquet(before)
    return docs
