"""Reconciliation of source lines with items, and enrichment from saved profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, line) of every line that isn't blank; breaks as Unicode has them."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.col(text), r"\R")).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no").cast("long")).where(T.strip(F.col("line")) != "")


def uncovered(lines: DataFrame, items: DataFrame, cap: int = vocab.REPORT_CAP) -> DataFrame:
    """(doc_id, line_no, value, context): lines of ``lines(doc_id, line_no, line, heading_key)`` that no item covers.

    What a document's items say is joined to one text, a line each, so that no match spans two;
    a line is covered if that has it, with or without its label, or if a long field value makes
    up most of it. The context is the last heading above. The cap of a report is per document.
    """
    said = items.select("doc_id", F.explode(F.concat(F.array(F.col("raw_text")), F.filter(F.map_values(F.coalesce("fields", F.create_map().cast("map<string,string>"))), lambda v: F.char_length(T.strip(v)) >= vocab.REPORT_CHARS))).alias("said"))
    said = said.select("doc_id", T.comparable(F.col("said")).alias("said")).where("said <> ''")
    blobs = said.groupBy("doc_id").agg(F.array_join(F.collect_set("said"), "\n").alias("blob"))
    values = items.select("doc_id", F.explode(F.map_values("fields")).alias("v")).where(F.char_length(T.strip(F.col("v"))) >= vocab.REPORT_CHARS).groupBy("doc_id").agg(F.collect_set(T.comparable(F.col("v"))).alias("values"))
    names = items.where("section = 'full_name'").groupBy("doc_id").agg(F.min_by(T.squash(F.lower(F.col("fields")["value"])), "item_ord").alias("name"))
    lines = T.settled(lines, __line=T.strip(F.col("line")))
    lines = T.settled(lines, __shaped=T.heading_shaped(F.col("__line")))
    line, shaped = F.col("__line"), F.col("__shaped")
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    told = lines.withColumn("context", F.coalesce(F.last(F.when(shaped, F.regexp_replace(T.squash(line), ":+$", "")), ignorenulls=True).over(w), F.lit(vocab.TOP)))
    left = T.settled(told.where(F.col("heading_key").isNull() & ~shaped & T.reportable(line)), own=T.comparable(line))
    left = T.settled(left, unlabelled=F.when(line.rlike(T.LABEL), T.comparable(F.regexp_replace(line, T.LABEL, ""))).otherwise(F.col("own")))
    left = left.join(blobs, "doc_id", "left").join(values, "doc_id", "left").join(names, "doc_id", "left")
    blob = F.coalesce("blob", F.lit(""))
    inside = F.exists(F.coalesce("values", F.array().cast("array<string>")), lambda v: F.contains(F.col("own"), v) & (F.char_length(v) >= F.char_length("own") * vocab.COVERED))
    left = left.where(~F.contains(blob, F.col("own")) & ~((F.col("unlabelled") != F.col("own")) & F.contains(blob, F.col("unlabelled"))) & ~inside & ~F.col("own").eqNullSafe(F.col("name")))
    once = left.groupBy("doc_id", "own").agg(F.min_by(F.struct("line_no", line.alias("value"), "context"), "line_no").alias("x")).select("doc_id", "x.*")
    return once.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))).where(F.col("nth") <= cap).drop("nth")


def verbatim(items: DataFrame, docs: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """Items whose source text stands in their document, as it is or with white space made one space, in a known section.

    ``bodies(doc_id, text)`` are further copies of a document, a row each: without the page furniture that stands
    between parts of a wrapped line, and with headings put together; what stands in one of them is no invention either.
    """
    copies = docs.select("doc_id", "text") if bodies is None else docs.select("doc_id", "text").unionByName(bodies.select("doc_id", "text"))
    copies = copies.where("text is not null").groupBy("doc_id").agg(F.collect_list(F.struct("text", T.squash(F.col("text")).alias("norm"))).alias("__copies"))
    joined = items.join(copies, "doc_id")
    there = F.exists("__copies", lambda c: F.contains(c["text"], F.col("raw_text")) | F.contains(c["norm"], T.squash(F.col("raw_text"))))
    return joined.where(there & (T.strip(F.col("raw_text")) != "") & F.col("section").isin(vocab.SECTION_KEYS)).select(*items.columns)


#: Rows that are looked for in every document must be few.
MOST_SHORT = 200_000


def quoted(passages: DataFrame, docs: DataFrame, key: str, width: int = 6) -> DataFrame:
    """(key, doc_id): the passages of ``passages(key, passage)`` that stand word for word in ``docs(doc_id, text)``, as they are or with white space made one space.

    A passage of three words or more is contained where its inner words are, ``width`` of them at most (its first and last may be
    parts of longer words). Runs of words are hashed where the documents are. If all hashes asked for are few, they go to the documents, and a document
    that has none is let go before it is compared; if they are many, documents and passages are joined by them. A passage of fewer words has no
    inner word and is looked for in every document.
    """
    whole = docs.where("text is not null").select("doc_id", F.col("text").alias("whole"), T.squash(F.col("text")).alias("norm"))
    items = passages.where("passage is not null").select(key, "passage", T.squash(F.col("passage")).alias("pnorm")).withColumn("w", F.split("pnorm", " ")).withColumn("width", F.least(F.size("w") - 2, F.lit(width)))
    widths = {r["width"]: r["n"] for r in items.groupBy("width").agg(F.count("*").alias("n")).collect()}
    long, short = sorted(k for k in widths if k > 0), sum(n for k, n in widths.items() if k <= 0)
    stands = F.contains("whole", F.col("passage")) | F.contains("norm", F.col("pnorm"))
    asked = items.where("width > 0").select(key, "passage", "pnorm", F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.col("width")), " ")).alias("key"))
    none = F.array().cast("array<bigint>")
    runs = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " ")))).otherwise(none)
    hashed = whole.withColumn("w", F.split("norm", " ")).withColumn("keys", F.concat(none, *[runs(k) for k in long])).drop("w")
    if sum(widths[k] for k in long) <= MOST_SHORT:
        # all that is asked for as one array: a set intersection leaves the few keys that a document has of them
        every = F.broadcast(asked.agg(F.collect_set("key").alias("every")))
        met = hashed.join(every).withColumn("key", F.explode(F.array_intersect("keys", "every"))).select("doc_id", "whole", "norm", "key")
        met = met.join(F.broadcast(asked), "key")
    else:
        met = hashed.select("doc_id", F.explode(F.array_distinct("keys")).alias("key")).join(asked, "key").join(whole, "doc_id")
    found = met.where(stands).select(key, "doc_id")
    if short:
        few = items.where("width <= 0").select(key, "pnorm", "passage")
        found = found.unionByName(whole.join(F.broadcast(few) if short <= MOST_SHORT else few, stands).select(key, "doc_id"))
    return found.distinct()


def unmapped_items(left: DataFrame) -> DataFrame:
    """Items that report what nothing covers, of ``left(doc_id, line_no, value, context)``: low, flagged and for a person to see."""
    value = F.col("value")
    return left.select(
        "doc_id", ((1 << 41) + F.col("line_no")).cast("long").alias("item_ord"), F.lit("unmapped").alias("section"),
        F.create_map(F.lit("value"), value, F.lit("context"), F.col("context")).alias("fields"), value.alias("raw_text"), F.lit(0.4).alias("confidence"),
        F.array(F.lit("unmapped_content")).alias("flags"), F.lit("pending_review").alias("status"), F.array(F.lit("flagged_unmapped")).alias("actions"),
    )


def prefill(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, section, value, origin) after a saved profile is applied.

    ``profiles(doc_id, email, phone, job_title, links, memberships)``: contact data and title take
    the place of what was extracted; links and memberships come only where their section is empty.
    """
    singles = F.array(*[F.struct(F.lit(s).alias("section"), F.col(c).alias("value")) for s, c in (("email", "email"), ("contact_info", "phone"), ("job_title", "job_title"))])
    forced = profiles.select("doc_id", F.inline(singles)).where("value <> ''")
    lists = profiles.select("doc_id", F.explode(F.concat(F.transform(F.map_entries("links"), lambda e: F.struct(F.lit("profiles_links").alias("section"), F.concat_ws(": ", e["key"], e["value"]).alias("value"))), F.transform("memberships", lambda m: F.struct(F.lit("associations").alias("section"), F.trim(m).alias("value"))))).alias("x")).select("doc_id", "x.*").where("value <> ''")
    have = items.select("doc_id", "section").distinct()
    kept = items.join(forced.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti").select("doc_id", "section", F.coalesce(F.col("fields")["value"], F.col("raw_text")).alias("value"), F.lit("extracted").alias("origin"))
    added = forced.unionByName(lists.join(have, ["doc_id", "section"], "left_anti")).withColumn("origin", F.lit("profile"))
    return kept.unionByName(added)
