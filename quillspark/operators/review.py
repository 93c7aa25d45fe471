"""Validation, approval and quality of extracted items: ``items(doc_id, item_ord, section, fields, raw_text, confidence, flags, status, actions)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T

EMPLOYMENT = ["present_employment", "previous_employment"]
ADVISORY = ["low_confidence", "medium_confidence"]


def merged_flags(*parts: Column) -> Column:
    """Sorted distinct flags of several arrays; null entries vanish."""
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*parts))))


def row_flags(items: DataFrame) -> DataFrame:
    """Adds the flags that one item shows by itself: low confidence, malformed contact data, dates out of order."""
    value = F.coalesce(F.nullif(F.col("fields")["value"], F.lit("")), F.col("raw_text"))
    url, start, end = (F.coalesce(F.col("fields")[k], F.lit("")) for k in ("url", "start_date", "end_date"))
    job = F.col("section").isin(EMPLOYMENT)
    found = F.array(
        F.when(F.col("confidence") < vocab.MEDIUM, "low_confidence").when(F.col("confidence") < vocab.HIGH, "medium_confidence"),
        F.when((F.col("section") == "email") & (value != "") & ~T.strip(value).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "invalid_email_format"),
        F.when((F.col("section") == "profiles_links") & (url != "") & ~T.strip(url).rlike(r"(?i)^(https?://|www\.)[^\s]+\.[a-z]{2,}"), "invalid_url_format"),
        F.when(job & (T.partial_date(end) < T.partial_date(start)), "end_date_before_start_date"),
        F.when((F.col("section") == "present_employment") & (end != ""), "present_employment_has_end_date_review_section"),
    )
    return items.withColumn("flags", merged_flags(F.col("flags"), found))


def overlapping(rows: DataFrame, key: str, start: str, end: str, order: str) -> DataFrame:
    """Adds ``overlaps``: whether a row's closed interval meets another one of its key; a null end is open.

    Instead of a self-join of all pairs, rows of a key are put in order of their start: one
    overlaps if the furthest end before it reaches its start, or the next start lies within it.
    """
    w = Window.partitionBy(key).orderBy(F.col(start), F.col(order))
    last = F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))
    reach = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    following = F.lead(start).over(w)
    return rows.withColumn("overlaps", F.coalesce(reach >= F.col(start), F.lit(False)) | F.coalesce(following <= last, F.lit(False)))


def overlap_flags(items: DataFrame) -> DataFrame:
    dated = items.where(F.col("section").isin(EMPLOYMENT)).withColumns({"s": T.partial_date(F.col("fields")["start_date"]), "e": T.partial_date(F.col("fields")["end_date"])}).where("s is not null")
    hits = overlapping(dated, "doc_id", "s", "e", "item_ord").where("overlaps").select("doc_id", "item_ord", F.lit("overlapping_employment_dates").alias("more"))
    joined = items.join(hits, ["doc_id", "item_ord"], "left")
    return joined.withColumn("flags", merged_flags(F.col("flags"), F.array("more"))).select(*items.columns)


def citation_key(citation: Column, lower: Callable[[Column], Column] = F.lower) -> Column:
    """The first 120 characters by which citations are compared; null if empty."""
    return F.nullif(F.substring(T.squash(lower(F.coalesce(citation, F.lit("")))), 1, 120), F.lit(""))


def duplicate_flags(items: DataFrame, by_source: bool = False, lower: Callable[[Column], Column] = F.lower) -> DataFrame:
    """Flags publications of a document whose citations agree. With ``by_source``, items without a citation go by their source text."""
    citation = F.coalesce(F.col("fields")["citation"], F.col("raw_text")) if by_source else F.col("fields")["citation"]
    key = F.when(F.col("section") == "publications", citation_key(citation, lower))
    keyed = items.withColumn("__key", key)
    n = F.count("__key").over(Window.partitionBy("doc_id", "__key"))
    flagged = keyed.withColumn("flags", merged_flags(F.col("flags"), F.array(F.when(F.col("__key").isNotNull() & (n > 1), "possible_duplicate_publication"))))
    return flagged.select(*items.columns)


def validate(items: DataFrame) -> DataFrame:
    return duplicate_flags(overlap_flags(row_flags(items)))


def needs_review(threshold: Column | float = vocab.APPROVE) -> Column:
    return (F.col("confidence") < threshold) | (F.size(F.array_except("flags", F.array(*map(F.lit, ADVISORY)))) > 0)


def approve(items: DataFrame, threshold: Column | float = vocab.APPROVE) -> DataFrame:
    """Approves pending items that are confident and have no flag but advisory ones, and says so in their history."""
    sure = (F.col("status") == "pending_review") & ~needs_review(threshold)
    return items.withColumns({"status": F.when(sure, "approved").otherwise(F.col("status")), "actions": F.when(sure, F.array_append("actions", F.lit("auto_approved"))).otherwise(F.col("actions"))})


def missing_mandatory(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, section) of mandatory sections that a document lacks."""
    wanted = docs.select("doc_id").distinct().withColumn("section", F.explode(F.array(F.lit("full_name"), F.lit("email"))))
    return wanted.join(items.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti")


def section_report(items: DataFrame, sections: DataFrame) -> DataFrame:
    """A row for each document and section, also empty ones: items, approved, flagged and a verdict.

    Items are counted per document and section first; only those counts meet the catalogue.
    """
    flagged = (F.size("flags") > 0) | (F.col("status") == "pending_review")
    counts = items.groupBy("doc_id", "section").agg(F.count("*").alias("item_count"), F.count_if(F.col("status").isin("approved", "edited")).alias("approved_count"), F.count_if(flagged).alias("flagged_count"))
    frame = items.select("doc_id").distinct().join(F.broadcast(sections.select("section")))  # the catalogue has 23 rows
    whole = frame.join(counts, ["doc_id", "section"], "left").fillna(0, ["item_count", "approved_count", "flagged_count"])
    verdict = F.when(F.col("item_count") == 0, "missing").when(F.col("flagged_count") > 0, "needs_review").otherwise("verified")
    return whole.withColumn("verdict", verdict)


def summary_report(items: DataFrame) -> DataFrame:
    """A row for each document: mean confidence, pending and automatic approvals, coverage and readiness. One shuffle."""
    live = F.col("status") != "rejected"
    mapped, loose = F.count_if(live & (F.col("section") != "unmapped")), F.count_if(live & (F.col("section") == "unmapped"))
    pending = F.count_if(F.col("status") == "pending_review")
    return items.groupBy("doc_id").agg(
        F.count("*").alias("total_items"),
        F.round(F.coalesce(F.avg(F.when(live, F.col("confidence").cast("decimal(12,8)"))).cast("double"), F.lit(0.0)), 3).alias("overall_confidence"),
        pending.alias("pending_count"),
        F.count_if((F.col("status") == "approved") & F.array_contains("actions", "auto_approved")).alias("auto_approved_count"),
        mapped.alias("mapped_count"),
        loose.alias("unmapped_count"),
        F.round(F.coalesce(F.try_divide(mapped, mapped + loose), F.lit(0.0)), 3).alias("coverage"),
        ((pending == 0) & (F.count("*") > 0)).alias("ready"),
    )


def mean_confidence(items: DataFrame, *keys: str, digits: int = 3) -> DataFrame:
    """(keys, mean): the mean confidence of what isn't rejected, added up as decimals, so that it doesn't depend on the order of rows; 0 without any."""
    live = F.when(F.col("status") != "rejected", F.col("confidence").cast("decimal(12,8)"))
    return items.groupBy(*keys).agg(F.round(F.coalesce(F.avg(live).cast("double"), F.lit(0.0)), digits).alias("mean"))


def stored(items: DataFrame) -> DataFrame:
    """Items as they are kept: an id that reruns give again, confidence between 0 and 1, its band, and pending where no status is given."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    key = F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "section", F.col("item_ord").cast("string"), F.coalesce("raw_text", F.lit(""))), 256)
    return items.withColumns({"item_id": F.substring(key, 1, 32), "confidence": sure, "status": F.coalesce("status", F.lit("pending_review"))}).withColumn("band", T.band(F.col("confidence")))


def remarks(items: DataFrame) -> DataFrame:
    """(doc_id, duplicates, discarded, short): what a report says of single items: possible duplicates, rejected ones, accepted ones with a field too short to be one. Sorted lists."""
    said = F.concat(F.col("section"), F.lit(": "), F.substring("raw_text", 1, 80))
    every = lambda c: F.array_sort(F.collect_list(c))
    listed = items.groupBy("doc_id").agg(every(F.when(F.array_contains("flags", "possible_duplicate_publication"), said)).alias("duplicates"), every(F.when(F.col("status") == "rejected", said)).alias("discarded"))
    short = short_fields(items).groupBy("doc_id").agg(every(F.concat(F.col("section"), F.lit("."), F.col("field"), F.lit(": "), F.col("value"))).alias("short"))
    return listed.join(short, "doc_id", "left").withColumn("short", F.coalesce("short", F.array().cast("array<string>")))


def short_fields(items: DataFrame) -> DataFrame:
    """Accepted items with a field of one or two characters, sorted by field."""
    kinds = ["title", "employer", "unit", "institution", "subject", "project_title", "role", "funding_agency"]
    rows = items.where(F.col("status").isin("approved", "edited")).select("doc_id", "item_ord", "section", F.explode("fields").alias("field", "value"))
    return rows.where(F.col("field").isin(kinds) & F.char_length(T.strip(F.col("value"))).between(1, 2)).select("doc_id", "item_ord", "section", "field", T.strip(F.col("value")).alias("value"))


def unmapped_headings(rows: DataFrame, taught: DataFrame | None = None, top: int = vocab.DASHBOARD_TOP) -> DataFrame:
    """The headings whose content most documents leave unmapped, of ``rows(doc_id, context, value, item_ord)``; a top-k report."""
    context = F.trim("context")
    live = rows.withColumn("context", context).where((F.col("context") != "") & ~F.col("context").isin(vocab.TOP, vocab.NO_HOME))
    found = live.groupBy("context").agg(F.count("*").alias("occurrences"), F.countDistinct("doc_id").alias("cv_count"), F.min_by("value", F.struct("item_ord", "value")).alias("example"))
    if taught is not None:
        found = found.join(taught.select(F.lower(F.trim("heading")).alias("__taught")).distinct(), F.lower("context") == F.col("__taught"), "left_anti")
    return found.orderBy(F.desc("cv_count"), F.desc("occurrences"), "context").limit(top)


def suggested_mappings(rows: DataFrame, taught: DataFrame | None = None, least_docs: int = vocab.SUGGEST_DOCS, share: float = vocab.SUGGEST_SHARE, top: int | None = vocab.SUGGEST_TOP) -> DataFrame:
    """Headings that corrections send to one section most of the time, of ``rows(doc_id, section, context, value, item_ord)``.

    Corrections are counted by heading and section first; a heading's dominant section is the
    maximum of those few counts. Distinct documents of a heading are counted apart.
    """
    live = rows.withColumn("context", F.trim("context")).where((F.col("context") != "") & ~F.col("context").isin(vocab.TOP, vocab.NO_HOME))
    if taught is not None:
        live = live.join(taught.select(F.lower(F.trim("heading")).alias("__taught")).distinct(), F.lower("context") == F.col("__taught"), "left_anti")
    by_section = live.groupBy("context", "section").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
    best = by_section.groupBy("context").agg(F.sum("n").alias("all_n"), F.max_by(F.struct("section", "n", "docs"), F.struct("n", "docs", "section")).alias("top"))
    spread = live.groupBy("context").agg(F.countDistinct("doc_id").alias("all_docs"))
    found = best.join(spread, "context").where((F.col("all_docs") >= least_docs) & (F.col("top.n") / F.col("all_n") >= share))
    out = found.select("context", F.col("top.section").alias("suggested_section"), F.col("top.docs").alias("cv_count"), F.col("top.n").alias("occurrences"), F.round(F.col("top.n") / F.col("all_n"), 2).alias("agreement"))
    return out.orderBy(F.desc("cv_count"), F.desc("occurrences"), "context").limit(top) if top else out
