"""Benchmark decontamination over a distributed positional inverted index of the training tokens."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Proximity: the words of a window may each stand so many places off.
SLACK = 3
#: Places left free after a document: two neighbouring words of a near passage are at most one less apart.
GAP = 2 * SLACK + 1
#: Tokens of one segment of the index (more only if one document has more).
SEGMENT_TOKENS = 1 << 18
#: Bytes of benchmark text searched in one pass over the index; a larger benchmark takes more passes.
PASS_BYTES = 8 << 20
#: Places of the segment looked at in one step of an intersection.
STEP = 1 << 18

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def index(docs: DataFrame) -> DataFrame:
    """The inverted index of ``docs(doc_id, text)``, a row for each segment, built where the documents are: no shuffle.

    A segment holds whole documents: the number of its first row, their ids, keys and word counts, its terms, and for each
    term the sorted places where it stands. Places run on through a segment; GAP of them are left free
    after each document, so that no passage, exact or near, crosses from one to the next.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, counts, tokens, held = [], [], [], [], 0
        first = TaskContext.get().partitionId() << 33

        def segment() -> pa.RecordBatch:
            number: dict = defaultdict()
            number.default_factory = number.__len__
            lens = np.array(counts, np.int64)
            flat = np.fromiter((number[w] for doc in tokens for w in doc), np.int32, int(lens.sum()))
            starts = np.concatenate(([0], np.cumsum(lens + GAP)[:-1])) if len(lens) else np.empty(0, np.int64)
            places = (np.arange(len(flat)) + GAP * np.repeat(np.arange(len(lens)), lens)).astype(np.int32)
            order = np.argsort(flat, kind="stable")
            postings, sizes = places[order], np.bincount(flat, minlength=len(number)).astype(np.int32)
            columns = [pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.int64())), pa.array([starts.tolist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))]
            blobs = [b" ".join(number), sizes.tobytes(), postings.tobytes()]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.binary()) for x in blobs)], ["first", "doc_ids", "row_keys", "starts", "counts", "terms", "sizes", "postings"])

        for b in slices(batches):
            for i, k, t in zip(b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words(t)
                if ids and held + len(w) > SEGMENT_TOKENS:
                    yield segment()
                    first += len(ids)
                    ids, keys, counts, tokens, held = [], [], [], [], 0
                ids.append(i)
                keys.append(k)
                counts.append(len(w))
                tokens.append(w)
                held += len(w) + GAP
        if ids:
            yield segment()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(made, SEGMENT)


@dataclass
class Windows:
    """The distinct windows of some benchmark items: their words, the items of each, and by width a table of them.

    A table (numbers, words, begins) is in order of each window's key, its rarest word in the benchmark;
    begins says for each word where the windows of that key begin. A window is looked at only where its key stands.
    """

    terms: list[bytes]
    items: list[list[str]]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def windows(items: list[tuple], width: int = WINDOW) -> Windows:
    number: dict = defaultdict()
    number.default_factory = number.__len__
    found: dict[tuple[int, ...], set[str]] = defaultdict(set)
    often: Counter = Counter()
    for item, text in items:
        w = tuple(number[x] for x in words(text))
        often.update(w)
        for at in range(max(len(w) - width, 0) + 1 if w else 0):
            found[w[at : at + width]].update(() if item is None else (str(item),))
    by_width: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for n, w in enumerate(found):
        by_width[len(w)].append((n, w))
    counts, tables = np.array([often[k] for k in range(len(number))] or [0]), {}
    for size, own in by_width.items():
        numbers, w = np.array([n for n, _ in own]), np.array([w for _, w in own], np.int32)
        keys = np.take_along_axis(w, np.argmin(counts[w], axis=1)[:, None], axis=1)[:, 0]
        order = np.argsort(keys, kind="stable")
        tables[size] = (numbers[order], w[order], np.searchsorted(keys[order], np.arange(len(number) + 1)))
    return Windows(list(number), [sorted(x) for x in found.values()], tables)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after another."""
    lens = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(int(lens.sum())) if len(lens) else np.empty(0, np.int64)


def _search(segment: dict, asked: Windows, number: dict[bytes, int], slack: int) -> tuple[np.ndarray, dict[int, set[str]], dict[int, set[str]]]:
    """Of one segment: a mark on each place that is hit, and by document the items found exactly and nearby.

    The places of each window's rarest word, moved back by its offset, are the starts to look
    at; those at which the next rarer word doesn't stand at its own offset fall out, and so on.
    For proximity, a place first keeps what has each word within twice the slack of where the rarest word puts it; of
    what is left, every start within the slack is tried, so it doesn't matter which word is the rarest.
    """
    names = segment["terms"].split(b" ") if segment["terms"] else []
    sizes, postings = np.frombuffer(segment["sizes"], np.int32), np.frombuffer(segment["postings"], np.int32)
    starts, counts = np.array(segment["starts"], np.int64), np.array(segment["counts"], np.int64)
    ends, end = np.cumsum(sizes), int(starts[-1] + counts[-1] + 1) if len(starts) else 0
    hit, exact, nearby = np.zeros(end + 1, np.int32), defaultdict(set), defaultdict(set)
    pairs = [(number[t], i) for i, t in enumerate(names) if t in number]
    to_here = np.full(len(asked.terms) + 1, -1)
    present = np.array(sorted(k for k, _ in pairs), np.int64)
    for k, i in pairs:
        to_here[k] = i
    # the same lists seen from the places: which term stands there; -1 between documents and beyond the ends
    pad = WINDOW + GAP
    at_place = np.full(end + 2 * pad, -1, np.int32)
    at_place[postings + pad] = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def stands(begin: np.ndarray, want: np.ndarray, off: int) -> np.ndarray:
        ok = np.zeros(len(begin), bool)
        for d in range(-off, off + 1):
            ok |= at_place[begin + (d + pad)] == want
        return ok

    for width, (numbers, table_, begins) in asked.tables.items():
        if width > WINDOW:
            raise ValueError("a window has more words than the width")
        own = _ranges(begins[present], begins[present + 1])
        terms = to_here[table_[own]]
        whole = (terms >= 0).all(axis=1)  # a word that isn't in the segment has an empty list
        number_of, terms = numbers[own][whole], terms[whole]
        if not len(terms):
            continue
        rarest = np.argsort(sizes[terms], axis=1, kind="stable")
        first = np.take_along_axis(terms, rarest[:, :1], axis=1)[:, 0]
        for part in _steps(sizes[first]):
            of = np.repeat(part, sizes[first[part]])
            anchor = postings[_ranges((ends - sizes)[first[part]], ends[first[part]])].astype(np.int64)
            start = anchor - rarest[of, 0]
            ok = (start >= 0) & (start + width <= end)
            begin, which = start[ok], of[ok]
            for k in range(1, width):
                offset = rarest[which, k]
                ok = at_place[begin + offset + pad] == terms[which, offset]
                begin, which = begin[ok], which[ok]
                if not len(begin):
                    break
            np.add.at(hit, begin, 1)
            np.add.at(hit, begin + width, -1)
            near, near_of, near_at = (start, of, anchor) if slack else (begin, which, begin)
            for k in range(1, width if slack else 1):
                offset = rarest[near_of, k]
                ok = stands(near + offset, terms[near_of, offset], 2 * slack)
                near, near_of, near_at = near[ok], near_of[ok], near_at[ok]
                if not len(near):
                    break
            found = np.zeros(len(near), bool)
            for shift in range(-slack, slack + 1):
                ok = ~found
                for k in range(1, width):
                    offset = rarest[near_of, k]
                    ok[ok] = stands(near[ok] + offset[ok] + shift, terms[near_of[ok], offset[ok]], slack)
                found |= ok
            for places, of_, out in ((begin, which, exact), (near_at[found], near_of[found], nearby)):
                doc = np.searchsorted(starts, places, side="right") - 1
                for d, n in set(zip(doc.tolist(), number_of[of_].tolist(), strict=True)):
                    out[d].update(asked.items[n])
    return np.cumsum(hit)[:end] > 0, exact, nearby


def _steps(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of windows whose lists together have about STEP places."""
    step = (np.cumsum(sizes.astype(np.int64)) // STEP) if len(sizes) else np.empty(0, np.int64)
    for s in np.unique(step):
        yield np.flatnonzero(step == s)


SEGMENT = "first long, doc_ids array<long>, row_keys array<long>, starts array<long>, counts array<long>, terms binary, sizes binary, postings binary"
MATCHES = "doc_id long, row_key long, n_words long, n_hit long, items array<string>, near_items array<string>"
HITS = "row long, spans array<struct<s: int, e: int>>, items array<string>, near_items array<string>"


def matches(segments: DataFrame, benchmark: DataFrame, slack: int = SLACK) -> DataFrame:
    """(doc_id, row_key, n_words, n_hit, items, near_items) of every document of an index.

    items are those with a window that occurs exactly, near_items those with one that has a place from
    which each of its words stands at most ``slack`` (SLACK at most) places off (exact ones included).
    A benchmark of more than PASS_BYTES is searched in blocks, one after the other; the index is read for
    each, never written again: what a block finds, stretches and items of the documents that have any, is kept by the
    number of the row, and put together at the end. Items without an id mark words, but are none of the items.
    """
    if slack > SLACK:
        raise ValueError(f"documents of this index lie too close for a slack of {slack}")

    def run(asked: Windows, whole: bool):
        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = {t: k for k, t in enumerate(asked.terms)}
            for b in batches:
                for nth in range(b.num_rows):  # one segment in memory at a time
                    (segment,) = b.slice(nth, 1).to_pylist()
                    yield (_rows if whole else _hits)(segment, *_search(segment, asked, number, slack))

        return searched

    blocks = _blocks(benchmark)
    if blocks == 1:
        return segments.mapInArrow(run(_asked(benchmark, 1, 0), True), MATCHES)
    found = None
    for k in range(blocks):
        hits = cut(segments.mapInArrow(run(_asked(benchmark, blocks, k), False), HITS))
        found = hits if found is None else found.unionByName(hits)
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    places = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("spans")), lambda x: F.sequence(x["s"], x["e"] - 1))))
    found = found.groupBy("row").agg(F.size(places).cast("long").alias("n_hit"), every("items"), every("near_items"))
    none = F.array().cast("array<string>")
    rows = segments.select(F.posexplode(F.arrays_zip("doc_ids", "row_keys", "counts")).alias("nth", "x"), "first").select((F.col("first") + F.col("nth")).alias("row"), F.col("x.doc_ids").alias("doc_id"), F.col("x.row_keys").alias("row_key"), F.col("x.counts").alias("n_words"))
    return rows.join(found, "row", "left").select("doc_id", "row_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def _hits(segment: dict, hit: np.ndarray, exact: dict, nearby: dict) -> pa.RecordBatch:
    """The documents of a segment that have anything: stretches hit, from the document's first word on, and items."""
    starts = np.array(segment["starts"], np.int64)
    bounds = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).reshape(-1, 2)
    doc = np.searchsorted(starts, bounds[:, 0], side="right") - 1
    spans = defaultdict(list)
    for d, (s, e) in zip(doc.tolist(), bounds.tolist(), strict=True):
        spans[d].append({"s": s - int(starts[d]), "e": e - int(starts[d])})
    which, strings = sorted({*spans, *exact, *nearby}), pa.list_(pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([segment["first"] + d for d in which], pa.int64()),
            pa.array([spans.get(d, []) for d in which], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
            pa.array([sorted(exact.get(d, ())) for d in which], strings),
            pa.array([sorted(nearby.get(d, ())) for d in which], strings),
        ],
        ["row", "spans", "items", "near_items"],
    )


def _rows(segment: dict, hit: np.ndarray, exact: dict, nearby: dict) -> pa.RecordBatch:
    below = np.concatenate(([0], np.cumsum(hit)))
    starts, counts = np.array(segment["starts"], np.int64), np.array(segment["counts"], np.int64)
    n = range(len(starts))
    strings = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(segment["doc_ids"], pa.int64()),
            pa.array(segment["row_keys"], pa.int64()),
            pa.array(counts),
            pa.array(below[starts + counts] - below[starts], pa.int64()),
            pa.array([sorted(exact.get(d, ())) for d in n], strings),
            pa.array([sorted(nearby.get(d, ())) for d in n], strings),
        ],
        ["doc_id", "row_key", "n_words", "n_hit", "items", "near_items"],
    )


def _sized(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))


def _blocks(benchmark: DataFrame) -> int:
    total = _sized(benchmark).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return -(-total // PASS_BYTES) or 1


def _asked(benchmark: DataFrame, blocks: int, k: int) -> Windows:
    """The windows of one of ``blocks`` blocks: about PASS_BYTES of text, as the total was counted first."""
    own = _sized(benchmark)
    own = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else own
    return windows([(r["item"], bytes(r["text"])) for r in own.collect()])


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = SHARE) -> DataFrame:
    """``matches`` of documents against a benchmark, with ``contaminated``.

    Null and empty texts have no words and are never contaminated; very long ones are indexed whole, in a segment of their own;
    items that are null or empty ask for nothing; items without an id mark the words of their windows, but are not counted
    or listed; items that share an id count as one; repeated rows are
    each judged alike; empty tables give no rows or no hits. Other columns are not looked at.
    """
    found = matches(cut(index(docs)), benchmark)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
    )


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[0-9a-z\x{80}-\x{10FFFF}]+')"

#: Windows of both sides joined by their words; near ones from the places of their rarest word.
OP5_SQL = f"""
with d as (select doc_id, row_number() over () as r, coalesce({_WORDS}, []) as w from documents),
i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where text is not null),
iw as (
  select distinct item, len(x) as width, array_to_string(x, ' ') as win, x
  from (select item, unnest(list_transform(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1), lambda k: w[k:k + {WINDOW - 1}])) as x from i where len(w) > 0)
), widths as (select distinct width from iw),
dw as (
  select r, width, k, array_to_string(w[k:k + width - 1], ' ') as win
  from (select r, w, width, unnest(range(1, len(w) - width + 2)) as k from d, widths where len(w) >= width)
), m as (select dw.r, dw.k, dw.width, iw.item from dw join iw on dw.width = iw.width and dw.win = iw.win),
h as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + width)) as p from m) group by r),
t as (select r, count(distinct item) as n_items, array_to_string(list_sort(list_distinct(list(item) filter (item is not null))), ',') as items from m group by r),
dp as (select r, unnest(w) as word, generate_subscripts(w, 1) as p from d),
f as (select word, count(*) as n from dp group by word),
wk as (select win, width, x, unnest(x) as word, generate_subscripts(x, 1) as o from (select distinct win, width, x from iw)),
a as (select win, any_value(x) as x, any_value(width) as width, arg_min(o, n) as o, arg_min(wk.word, n) as word from wk join f using (word) group by win having count(*) = any_value(width)),
s as (select distinct dp.r, a.win, a.x, a.width, dp.p - a.o + unnest(range(-{SLACK}, {SLACK + 1})) as b from dp join a using (word)),
nw as (select distinct s.r, s.win from s join d using (r) where len(list_filter(range(1, s.width + 1), lambda k: not list_contains(d.w[greatest(s.b + k - {SLACK}, 1):greatest(s.b + k + {SLACK}, 0)], s.x[k]))) = 0),
n as (select r, count(distinct iw.item) as n_near_items from nw join iw using (win) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit, cast(coalesce(t.n_items, 0) as bigint) as n_items,
  sha256(coalesce(t.items, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 and {SHARE} * coalesce(h.n_hit, 0) >= len(d.w) as contaminated,
  cast(coalesce(n.n_near_items, 0) as bigint) as n_near_items
from d left join h on d.r = h.r left join t on d.r = t.r left join n on d.r = n.r
"""
