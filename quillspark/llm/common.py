"""What the training-data operators share: tables, cut lineage, size-checked and spread joins."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000
#: Rows of one key of a join that go to one task; a key with more is dealt out.
HOT_ROWS = 1 << 14

#: Texts that a Python worker holds at a time.
SLICE = 256

#: Whitespace that separates words: space and U+0009 to U+000D.
NOT_SPACE = r"[^\x20\x09-\x0D]+"

_SCOPES: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that ``spark.checkpoint.dir`` names; only a local session without one gets one made here."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="quillspark-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    for made in _SCOPES:
        made.append(out)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that its path names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Checkpoints that are made inside go at the end; what is read from them must be written by then."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES[:] = [x for x in _SCOPES if x is not made]
        for df in made:
            file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
            if file.isDefined():
                remove(spark, file.get())


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted at ``rows`` rows or fewer, else as it is.

    ``df`` should be cut or cheap: it is read once to count it. A larger side is left
    to a sort-merge join, whose skewed partitions adaptive execution splits. Rows must be of
    bounded size; where they hold arrays, count what the arrays hold instead.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_join(left: DataFrame, right: DataFrame, key: str, to: str, how: str = "inner", counts: DataFrame | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """``left`` joined with ``right(to, ...)``, which has a row for each key at most, on ``key = to``; ``to`` is dropped.

    Keys with over ``hot`` rows in ``left`` are known by a pre-aggregated count, or from ``counts(k, c)``
    if that was taken before. Their rows are dealt out by a hash, and their one row of ``right`` goes to
    each part, so that no task holds a key, whatever the join makes of it.
    """
    counts = left.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("c")) if counts is None else counts
    heavy = cut(counts.where(F.col("c") > hot).select(F.col("k").alias("__k"), F.ceil(F.col("c") / hot).cast("int").alias("__of")))
    if heavy.isEmpty():
        return left.join(right, left[key] == right[to], how).drop(to)
    heavy = small(heavy)
    dealt = left.join(heavy, left[key] == F.col("__k"), "left")
    dealt = dealt.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("__of")).cast("int"), F.lit(0))).drop("__k", "__of")
    copies = right.join(heavy, right[to] == F.col("__k"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__of", F.lit(1)) - 1))).drop("__k", "__of")
    return dealt.join(copies, (dealt[key] == copies[to]) & (dealt["__salt"] == copies["__part"]), how).drop(to, "__salt", "__part")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that only few texts at a time are held as Python objects beside their batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def row_key() -> Column:
    """A key of a document row, also for null or repeated ids: equal rows share it."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def spans_text(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` joined by commas, of an array of (s, k, e), ordered by start, then kind."""
    names = F.array(*[F.lit(k) for k in kinds])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
