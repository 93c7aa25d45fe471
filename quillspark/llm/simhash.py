"""SimHash near-duplicates found by anchor-point covering.

Fingerprints have 64 bits and link at four or fewer differing bits. Each half of 32
bits is covered on 31 of them by the perfect Hamming code [31, 26], whose codewords
are the anchors: every point lies within the covering radius 1 of one. Two linked
fingerprints differ in at most two bits in one of the halves, so a point between
them is within one bit of each, and the codeword nearest to it is within radius 1 +
1 = 2 of both. Every fingerprint therefore goes to all anchors within the covering
radius plus half of what the threshold leaves to a half-word (one or 16 anchors a
half), and comparing the members of each anchor finds every link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, small, spread_join, table
from .components import connected_components

WORDS = 4
BITS_APART = 4
SEED = 42
#: Members of an anchor that are compared in one piece; larger anchors are dealt out in pairs of pieces.
PIECE = 2048
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The SimHash of a text's word shingles, 0 if it has no words; unsigned."""
    parts = (text or b"").lower().split()  # of bytes: A-Z only, and splits at space and U+0009 to U+000D
    if not parts:
        return 0
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    if len(parts) <= words:
        return digest(line, SEED)
    n, over = len(parts) - words + 1, np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        pieces = zip(starts[at : min(n, at + AT_ONCE)], ends[at + words - 1 :], strict=False)
        h = np.array([digest(line[s:e], SEED) for s, e in pieces], np.uint64)
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * over > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp) of every row; fp is the fingerprint's 64 bits as a long."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(fps, pa.int64())], ["doc_id", "row_key", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(made, "doc_id long, row_key long, fp long")


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Of the Hamming code whose check column for bit i is i + 1: the exclusive or of the positions of set bits."""
    s = np.zeros(len(x), np.uint32)
    for k in range(5):
        mask = np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1))
        s |= (np.bitwise_count(x & mask).astype(np.uint32) & 1) << k
    return s


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``half``, codeword) for every codeword of [31, 26] within two bits of each 31-bit word.

    With syndrome s, flipping position s gives the codeword at distance 1; flipping
    positions p and p ^ s gives those at distance 2. A codeword is its own only anchor.
    """
    s, at = _syndromes(half), np.arange(len(half))
    flip = lambda p: np.where(p > 0, np.uint32(1) << (np.maximum(p, 1) - 1).astype(np.uint32), np.uint32(0))
    index, words = [at], [half ^ flip(s)]
    off = s > 0
    for p in range(1, 32):
        q = s ^ np.uint32(p)
        ok = off & (q > p)  # each pair of positions once; q = 0 is the single flip
        index.append(at[ok])
        words.append(half[ok] ^ np.uint32(1 << (p - 1)) ^ flip(q[ok]))
    return np.concatenate(index), np.concatenate(words)


def anchored(fps: DataFrame) -> DataFrame:
    """(anchor, fp): each fingerprint of ``fps(fp)`` at all anchors near it, of both halves."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 8192):
                part = fp[at : at + 8192]
                u = part.view(np.uint64)
                for k in (0, 1):
                    i, word = anchors(((u >> np.uint64(32 * k)) & np.uint64(0x7FFFFFFF)).astype(np.uint32))
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64) | (k << 32)), pa.array(part[i])], ["anchor", "fp"])

    return fps.mapInArrow(made, "anchor long, fp long")


def _near(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index into a, index into b) that differ in ``most`` bits or fewer, compared in blocks."""
    left, right, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)], max(1, 2_000_000 // max(1, len(b)))
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= most)
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that pairs (i, j) join it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _stars(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, pair, own, fp) sorted by anchor and pair: the members of each compared, as links from a member to the least one joined with it.

    own marks the two pieces of a dealt-out anchor (0 and 1; 2 for a piece against itself and for plain anchors).
    Rows of the last group of a batch wait for the next batch; groups of one member are skipped.
    """

    def linked(bounds: np.ndarray, own: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        sizes, us, vs = np.diff(bounds), [], []
        two = bounds[:-1][sizes == 2]  # most that have company have one neighbour: all at once
        a, b = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
        ok = (np.bitwise_count(a ^ b) <= most) & ((own[two] == 2) | (own[two] != own[two + 1]))
        us.append(fp[two][ok])
        vs.append(fp[two + 1][ok])
        for s, e in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2], strict=True):
            f, o = fp[s:e].view(np.uint64), own[s:e]
            if o[0] == 2:
                i, j = _near(f, f, most)
            else:
                left, right = np.flatnonzero(o == 0), np.flatnonzero(o == 1)
                i, j = _near(f[left], f[right], most)
                i, j = left[i], right[j]
            root = forest(len(f), i, j)
            moved = np.flatnonzero(root != np.arange(len(f)))
            us.append(fp[s:e][moved])
            vs.append(fp[s:e][root[moved]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    rest = [np.empty(0, np.int64)] * 4
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "pair", "own", "fp")]
        anchor, pair, own, fp = (np.concatenate(x) for x in zip(rest, now, strict=True))
        if not len(anchor):
            continue
        begins = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (pair[1:] != pair[:-1])])
        last = int(begins[-1])
        rest = [anchor[last:], pair[last:], own[last:], fp[last:]]
        if last:
            yield linked(begins, own[:last], fp[:last])
    if len(rest[0]):
        yield linked(np.array([0, len(rest[0])]), rest[2], rest[3])


def links(fps: DataFrame, most: int = BITS_APART, piece: int = PIECE) -> DataFrame:
    """(u, v) links that join all of the distinct ``fps(fp)`` within ``most`` (4 at most) bits of one another.

    Not every pair is named: each anchor gives a link from a member to the least member it
    is joined with there, so that the components are those of all pairs. Anchors of more than
    ``piece`` members are known by a pre-aggregated count; their members go to pairs of pieces,
    so that no task holds an anchor, however many fingerprints lie near it.
    """
    if most > BITS_APART:
        raise ValueError(f"these anchors cover {BITS_APART} differing bits at most")
    placed = cut(anchored(fps))
    heavy = small(cut(placed.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > piece)))
    tagged = placed.join(heavy, "anchor", "left")
    pieces = F.ceil(F.col("n") / piece).cast("int")
    mine = F.pmod(F.xxhash64("fp"), pieces).cast("int")
    # a piece meets every other one, itself included; pair numbers the two, and is -1 for plain anchors
    pair = lambda x: F.least(x, mine).cast("long") * pieces + F.greatest(x, mine)
    meets = F.when(F.col("n").isNull(), F.array(F.struct(F.lit(-1).cast("long").alias("pair"), F.lit(2).alias("own")))).otherwise(
        F.transform(F.sequence(F.lit(0), pieces - 1), lambda x: F.struct(pair(x).alias("pair"), F.when(x == mine, 2).when(x > mine, 0).otherwise(1).alias("own")))
    )
    dealt = tagged.select("anchor", "fp", F.explode(meets).alias("m")).select("anchor", "m.pair", F.col("m.own").cast("long").alias("own"), "fp")
    grouped = dealt.repartition("anchor", "pair").sortWithinPartitions("anchor", "pair")
    return grouped.mapInArrow(lambda batches: _stars(batches, most), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, most: int = BITS_APART, piece: int = PIECE) -> DataFrame:
    """(doc_id, row_key, fp, component, component_id) of every row of ``docs(doc_id, text)``.

    component names the group, component_id is the least id of the rows that links join. Null and empty texts have
    fingerprint 0 and are linked like any other; very long texts are read whole, their shingles hashed in
    pieces; rows with a null id take part, but give no component its id (null if all of its ids are);
    repeated rows share all values; an empty table gives no rows; other columns are not looked at. Equal
    fingerprints are one node, however many rows have them, and its rows are dealt out when they are named.
    """
    fps = cut(fingerprints(docs))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = connected_components(links(nodes.select("fp"), most, piece), nodes.select(F.col("fp").alias("node"), F.col("least").alias("id")))
    alone = F.col("component").isNull()
    named = nodes.join(found, nodes.fp == found.node, "left").select(F.col("fp").alias("__fp"), F.coalesce("component", "fp").alias("component"), F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return spread_join(fps, cut(named), "fp", "__fp", counts=nodes.select(F.col("fp").alias("k"), F.col("n").alias("c")))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
