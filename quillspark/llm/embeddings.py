"""Embedding near-duplicates by PCA-ordered tiles: leading dimensions first, the rest bounded by suffix norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import cut, small, spread_join, table
from .components import connected_components
from .simhash import forest

THRESHOLD = 0.93
#: Vectors of one side of a tile.
TILE = 2048
#: Leading principal coordinates by which vectors are put in blocks.
LEADING = 3
#: Steps of a coordinate to a unit.
BINS = 512
#: Dimensions whose products are taken in one step.
STEP = 8
#: Rounding that a bound in rotated double-precision coordinates may be off by.
ROUNDING = 1e-9
#: Tasks that add up the matrices of all others.
ADDERS = 16


def usable(embeddings: DataFrame) -> DataFrame:
    """(k1, k2, label, vector, least, n): the distinct vectors of each label that can link at all.

    Equal vectors of a label are one class of n rows, by a pre-aggregated count; k1 and k2 are its 128-bit key, least its
    least vec_id. Vectors that are null, zero or hold null, NaN or infinite components, and those
    of null labels, are left out.
    """
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = v.isNotNull() & F.col("label").isNotNull() & ~odd & F.exists(v, lambda x: x != 0)
    classes = embeddings.where(F.coalesce(fine, F.lit(False))).select("label", v.alias("vector"), "vec_id")
    return classes.groupBy(*keys()).agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.count("*").alias("n"))


def keys(vector: str = "vector") -> list[Column]:
    """A key of a vector and its label in two halves; the two zeros count as one."""
    plain = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))
    return [F.xxhash64(F.col("label"), plain).alias("k1"), F.xxhash64(F.lit("second"), F.col("label"), plain).alias("k2")]


def principal(classes: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, the principal axes (columns, leading first) of the unit vectors.

    Each task sums the outer products of its own vectors where they lie. Of each task and length one matrix of d by d
    is shuffled, to a few tasks that add them up, and theirs reach the driver. Lengths are few; vectors of
    other lengths never link.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, (_, x) in _by_length(b).items():
                sums[d] = sums.get(d, 0) + x.T @ x
        yield from _matrices(sums)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, s in zip(b.column("d").to_pylist(), b.column("s").to_pylist(), strict=True):
                sums[d] = sums.get(d, 0) + np.frombuffer(s).reshape(d, d)
        yield from _matrices(sums)

    total: dict[int, np.ndarray] = {}
    parts = classes.select("vector").mapInArrow(moments, "d int, s binary")
    for r in parts.repartition(ADDERS).mapInArrow(added, "d int, s binary").collect():
        total[r["d"]] = total.get(r["d"], 0) + np.frombuffer(bytes(r["s"])).reshape(r["d"], r["d"])
    return {d: np.ascontiguousarray(np.linalg.eigh(s)[1][:, ::-1]) for d, s in total.items()}


def _matrices(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["d", "s"])


def _by_length(b: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each vector length: the rows that have it, and their unit vectors."""
    column = b.column("vector")
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    out = {}
    for d in np.unique(lens):
        at = np.flatnonzero(lens == d)
        x = flat[(ends[at] - d)[:, None] + np.arange(d)].astype(np.float64)
        # scaled first: squares of very large or small numbers stay finite
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out[int(d)] = (at, x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
    return out


def near(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of unit vectors with cosine of at least ``threshold``.

    Products of the leading principal coordinates are summed step by step. What is still to
    come is at most the product of the two suffix norms; pairs that can't reach the threshold
    are left there. Those that come through are taken again in the coordinates given.
    """
    p, q = a @ axes, b @ axes
    left = np.sqrt(np.cumsum((p * p)[:, ::-1], axis=1))[:, ::-1]
    right = np.sqrt(np.cumsum((q * q)[:, ::-1], axis=1))[:, ::-1]
    d = p.shape[1]
    sums, at = p[:, :step] @ q[:, :step].T, step
    i, j = np.nonzero(sums + np.outer(left[:, at], right[:, at]) >= threshold - ROUNDING) if at < d else np.nonzero(sums >= threshold - ROUNDING)
    sums = sums[i, j]
    while at < d and len(i):
        sums = sums + np.einsum("ij,ij->i", p[i, at : at + step], q[j, at : at + step])
        at += step
        rest = left[i, at] * right[j, at] if at < d else 0
        ok = sums + rest >= threshold - ROUNDING
        i, j, sums = i[ok], j[ok], sums[ok]
    whole = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
    return i[whole], j[whole]


def placed(classes: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """``classes`` with ``at``: the leading principal coordinates of their unit vectors and the norm of all others, in steps of 1 / BINS."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = np.zeros((b.num_rows, LEADING + 1), np.int32)
            for d, (rows, x) in _by_length(b).items():
                lead = x @ axes[d][:, :LEADING]
                rest = np.sqrt(np.maximum(0, 1 - (lead * lead).sum(axis=1)))
                steps[rows, : lead.shape[1]] = np.floor(lead * BINS)
                steps[rows, LEADING] = np.floor(rest * BINS)
            yield b.append_column("at", pa.array(list(steps), pa.list_(pa.int32())))

    return classes.mapInArrow(put, StructType([*classes.schema.fields, StructField("at", ArrayType(IntegerType()))]))


def blocks(rows: DataFrame, size: int = TILE) -> DataFrame:
    """(label, d, at, cell, c, path): of each place ``at`` that rows of ``rows(label, d, at)`` have, the block it is in, their number, and the blocks above.

    A label is cut along its leading coordinate into slabs of about as many rows, each of these along the next, and so
    on; a block has about ``size`` rows. Only counts by step of a coordinate are put in order, so no task
    holds a label. ``path`` names a block's slab of each level, so that pairs can be looked for from above.
    """
    places = cut(rows.groupBy("label", "d", "at").agg(F.count("*").alias("c")).withColumn("cell", F.lit("")))
    paths = []
    for k in range(LEADING):
        own = ["label", "d", "cell"]
        bins = places.groupBy(*own, F.col("at")[k].alias("bin")).agg(F.sum("c").alias("c"))
        before = Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumns({"before": F.coalesce(F.sum("c").over(before), F.lit(0)), "all": F.sum("c").over(Window.partitionBy(*own))})
        slabs = F.ceil(F.pow(F.col("all") / size, F.lit(1.0 / (LEADING - k))))
        bins = bins.select(*own, "bin", F.floor(F.col("before") * slabs / F.col("all")).alias("slab"))
        joined = places.withColumn("bin", F.col("at")[k]).join(small(cut(bins)), [*own, "bin"])
        paths.append(f"p{k}")
        places = joined.withColumn("cell", F.concat_ws(".", F.nullif("cell", F.lit("")), "slab")).withColumn(f"p{k}", F.col("cell")).select("label", "d", "at", "cell", "c", *paths)
    return cut(places.select("label", "d", "at", "cell", "c", F.array(*paths).alias("path")))


def meetings(places: DataFrame, threshold: float) -> DataFrame:
    """(label, d, a, b): the pairs of blocks (a at most b) that vectors with a cosine of ``threshold`` can be in.

    Unit vectors with cosine t are sqrt(2 - 2 t) apart; so are at most the points of their leading coordinates and suffix
    norms, as that difference is a lower bound of the one between the suffixes themselves. Pairs of slabs whose boxes of
    such points are farther apart are left out with all that they hold: each level looks only inside the pairs of the one above.
    """
    reach, pairs = float(np.sqrt(max(0.0, 2 - 2 * threshold)) * BINS), None
    for k in range(LEADING):
        box = [x for i in range(LEADING + 1) for x in (F.min(F.col("at")[i]).alias(f"low{i}"), F.max(F.col("at")[i]).alias(f"high{i}"))]
        above = F.col("path")[k - 1] if k else F.lit("")
        cells = cut(places.groupBy("label", "d", above.alias("above"), F.col("path")[k].alias("cell")).agg(*box))
        if pairs is None:
            pairs = cells.select("label", "d", F.lit("").alias("a"), F.lit("").alias("b")).distinct()
        side = lambda s: cells.select("label", "d", F.col("above").alias(s), F.struct("cell", *[f"{x}{i}" for i in range(LEADING + 1) for x in ("low", "high")]).alias(f"{s}_"))  # noqa: E731, B023
        both = pairs.join(side("a"), ["label", "d", "a"]).join(side("b"), ["label", "d", "b"])
        gaps = F.lit(0.0)
        for i in range(LEADING + 1):  # a step more to the far side: steps are rounded down
            gap = F.greatest(F.col(f"b_.low{i}") - F.col(f"a_.high{i}") - 1, F.col(f"a_.low{i}") - F.col(f"b_.high{i}") - 1, F.lit(0))
            gaps = gaps + gap * gap
        near = both.where((gaps <= reach * reach + 1e-6) & ((F.col("a") != F.col("b")) | (F.col("a_.cell") <= F.col("b_.cell"))))
        pairs = cut(near.select("label", "d", F.col("a_.cell").alias("a"), F.col("b_.cell").alias("b")))
    return pairs


def tiled(rows: DataFrame, threshold: float, size: int = TILE) -> DataFrame:
    """(label, tile, side, node, n, d, vector): each row in all tiles in which it has to be compared.

    A tile is a pair of blocks that can meet (``meetings``), or of pieces of them, where a block holds more than ``size`` rows
    at places that can't be told apart. Blocks are dealt out one by one, so that no task holds a label.
    """
    rows = rows.withColumn("d", F.size("vector"))
    places = blocks(rows, size)
    of = cut(places.groupBy("label", "d", "cell").agg(F.ceil(F.sum("c") / size).cast("int").alias("pieces")))
    pairs = meetings(places, threshold).join(of.withColumnsRenamed({"cell": "a", "pieces": "na"}), ["label", "d", "a"]).join(of.withColumnsRenamed({"cell": "b", "pieces": "nb"}), ["label", "d", "b"])
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = pairs.where((F.col("a") != F.col("b")) | (F.col("i") <= F.col("j")))
    alone = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    tile = F.concat_ws(" ", "a", "i", "b", "j")
    ends = F.when(alone, F.array(F.struct(F.col("a").alias("cell"), F.col("i").alias("piece"), F.lit(2).alias("side")))).otherwise(
        F.array(F.struct(F.col("a").alias("cell"), F.col("i").alias("piece"), F.lit(0).alias("side")), F.struct(F.col("b").alias("cell"), F.col("j").alias("piece"), F.lit(1).alias("side"))))
    meets = cut(pairs.select("label", "d", tile.alias("tile"), F.inline(ends)))
    at = rows.join(small(places.select("label", "d", "at", "cell")), ["label", "d", "at"]).join(small(of), ["label", "d", "cell"])
    at = at.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    return at.join(small(meets), ["label", "d", "cell", "piece"]).select("label", "tile", "side", "node", "n", "d", "vector")


def links(tiles: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(u, v, c): for each node of a tile that has links there, the rows it links with there, and a node it is joined with (null if itself is the least)."""

    def compared(group: pa.Table) -> pa.Table:
        b = group.combine_chunks().to_batches()[0]
        side, nodes, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("side", "node", "n"))
        ((d, (_, x)),) = _by_length(b).items()
        if side[0] == 2:
            i, j = near(x, x, axes[d], threshold)
            i, j = i[i != j], j[i != j]
        else:
            p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            i, j = near(x[p], x[q], axes[d], threshold)
            i, j = np.concatenate((p[i], q[j])), np.concatenate((q[j], p[i]))
        c = np.bincount(i, n[j], minlength=len(nodes)).astype(np.int64)
        root, at = forest(len(nodes), i, j), np.flatnonzero(c)
        return pa.table({"u": pa.array(nodes[at]), "v": pa.array(nodes[root[at]], mask=root[at] == at), "c": pa.array(c[at])})

    return tiles.groupBy("label", "d", "tile").applyInArrow(compared, "u long, v long, c long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, size: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings(vec_id, embedding, label)``.

    Links are pairs of one label (and length) with a cosine of at least ``threshold`` in double
    precision. Rows that can't link (see ``usable``) have no links and are their own component.
    Repeated rows and equal vectors link with each other and count one by one. Where ids are null,
    the component is the least id there is, and the row isn't kept unless ids are equal. An empty
    table gives no rows; other columns are not looked at.
    """
    slim = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    classes = cut(usable(slim).withColumn("node", F.monotonically_increasing_id()))  # a number, not a hash: no two classes share one
    axes = principal(classes)
    found = cut(links(tiled(cut(placed(classes.select("node", "label", "vector", "n"), axes)), threshold, size), axes, threshold))
    joined = connected_components(found.where("v is not null").select("u", "v"), classes.select("node", F.col("least").alias("id")))
    counted = found.groupBy(F.col("u").alias("node")).agg(F.sum("c").alias("c"))
    named = classes.select("node", "k1", "k2", "least", "n").join(joined, "node", "left").join(counted, "node", "left")
    component = F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id"))
    named = cut(named.select(F.struct("k1", "k2").alias("key"), (F.coalesce("c", F.lit(0)) + F.col("n") - 1).alias("n_links"), component.alias("component_id"), "n"))
    rows = slim.select("vec_id", F.struct(*keys("embedding")).alias("__key"))
    whole = spread_join(rows, named.drop("n"), "__key", "key", "left", counts=named.select(F.col("key").alias("k"), F.col("n").alias("c")))
    component = F.coalesce("component_id", "vec_id")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = f"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from v),
links as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}
), reach as (select vec_id, vec_id as reached from embeddings union select reach.vec_id, links.b from reach join links on reach.reached = links.a),
c as (select vec_id, min(reached) as component_id from reach group by vec_id), n as (select a, count(*) as n from links group by a)
select c.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, c.component_id, c.vec_id = c.component_id as kept from c left join n on c.vec_id = n.a
"""
