"""Lines of the finished document: each item as it reads there, in section and sub-group order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from .fields import employment_line, qualification_line

# Sub-headings of publications and editorial roles, the order of the latter, and labels of grant fields.
PUBLICATION_GROUPS = {"journal": "Peer-reviewed journals, book chapters, and books", "book_chapter": "Book chapters and books", "industry_government": "Academic blogs, reports, and media publications", "conference": "Selected conference presentations", "forthcoming": "Upcoming and forthcoming publications"}
EDITORIAL_GROUPS = {"Editor-in-Chief": "Editor-in-Chief roles", "Editor": "Editor roles", "Editorial board member": "Editorial board memberships", "Reviewer": "Reviewer roles", "Examiner": "Examiner roles", "External examiner": "External examiner roles"}
GRANT_LABELS = {"project_title": "Project Title", "role": "Role", "duration": "Duration", "funding_agency": "Funding Agency"}
METADATA = ["kind", "subgroup", "context", "provenance"]


def _field(name: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col("fields")[name], F.lit(""))), F.lit(""))


def item_line(order: Column | None = None) -> Column:
    """The line of an item of ``(section, fields, raw_text)``: an override first, then the section's own form, else the source text.

    ``order`` is an array of field names in the order in which a plain item joins them; by name if it isn't given.
    """
    section, source = F.col("section"), F.col("raw_text")
    names = order if order is not None else F.array_sort(F.map_keys("fields"))
    plain = F.array_join(F.filter(F.transform(F.filter(names, lambda k: ~k.isin(METADATA)), lambda k: F.trim(F.try_element_at("fields", k))), lambda v: v != ""), " — ")
    ongoing = F.lower(F.col("fields")["is_current"]) == "true"
    line = (
        F.when(section == "present_employment", employment_line(_field("title"), _field("unit"), _field("start_date"), _field("end_date"), F.lit(True)))
        .when(section == "previous_employment", employment_line(_field("title"), _field("employer"), _field("start_date"), _field("end_date"), ongoing))
        .when(section == "qualifications", qualification_line(_field("degree"), _field("subject"), _field("institution"), _field("country"), _field("year"), source))
        .when(section == "grants", F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), _field(k)) for k, label in GRANT_LABELS.items()]))
        .when(section == "publications", F.coalesce(_field("citation"), source))
        .when(section == "profiles_links", F.concat_ws(": ", _field("platform"), _field("url")))
        .when(section == "unmapped", F.coalesce(_field("value"), source))
        .otherwise(F.coalesce(_field("description"), plain))
    )
    return F.coalesce(_field("_line_override"), F.nullif(F.trim(line), F.lit("")), source)


def letterhead_lines(items: DataFrame) -> DataFrame:
    """(doc_id, section_ord, line_ord, text, style): name, titles (a line each), contact and address of accepted items, as a document opens with them; the first item of each counts."""
    accepted = items.where(F.col("status").isin("approved", "edited") & F.col("section").isin("full_name", "job_title", "contact_info", "email"))
    value = F.coalesce(_field("value"), F.col("raw_text"))
    first = accepted.groupBy("doc_id", "section").agg(F.min_by(value, "item_ord").alias("value"))
    place = F.array_position(F.array(*[F.lit(x) for x in ("full_name", "job_title", "contact_info", "email")]), F.col("section")).cast("int")
    return first.select("doc_id", F.lit(0).alias("section_ord"), "section", place.alias("place"), F.posexplode(F.split("value", "\n")).alias("nth", "text")).select("doc_id", "section_ord", (F.col("place") * 1000 + F.col("nth")).alias("line_ord"), "text", F.col("section").alias("style"))


def rendered(items: DataFrame) -> DataFrame:
    """(doc_id, section_ord, line_ord, text, style) of accepted items: headings of sections that have content, sub-headings where the group changes.

    The texts of a biography are one paragraph; letterhead sections have no heading here (see ``letterhead_lines``).

    Editorial roles go by kind, unknown kinds last, else in item order. Empty sections and unmapped items leave no line.
    """
    accepted = items.where(F.col("status").isin("approved", "edited") & (F.col("section") != "unmapped"))
    lives = accepted.where("section = 'biography'").groupBy("doc_id").agg(F.min("item_ord").alias("item_ord"), F.lit("biography").alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_ord", item_line().alias("line")))), lambda x: x["line"]), " ").alias("__life"))
    accepted = accepted.where(~F.col("section").isin("biography", "full_name", "job_title", "contact_info", "email", "profile_photo")).withColumn("__life", F.lit(None).cast("string"))
    accepted = accepted.unionByName(lives, allowMissingColumns=True)
    keys = F.array(*map(F.lit, vocab.SECTION_KEYS))
    headings = F.create_map(*[F.lit(x) for key, heading, label in vocab.SECTIONS for x in (key, heading or label.upper())])
    kinds = F.array(*map(F.lit, EDITORIAL_GROUPS))
    place = F.array_position(kinds, F.coalesce(F.col("fields")["kind"], F.lit("")))
    rank = F.when(F.col("section") == "editorial_roles", F.when(place > 0, place).otherwise(99)).otherwise(0)
    labels = lambda groups, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in groups.items() for x in kv]), c)
    group = F.when(F.col("section") == "publications", labels(PUBLICATION_GROUPS, F.col("fields")["subgroup"])).when(F.col("section") == "editorial_roles", labels(EDITORIAL_GROUPS, F.col("fields")["kind"]))
    rows = accepted.select("doc_id", "item_ord", "section", F.array_position(keys, F.col("section")).cast("int").alias("section_ord"), rank.alias("rank"), group.alias("group"), F.coalesce("__life", item_line()).alias("text"))
    w = Window.partitionBy("doc_id", "section_ord").orderBy("rank", "item_ord")
    rows = rows.withColumns({"n": F.row_number().over(w), "changed": F.col("group").isNotNull() & ~F.col("group").eqNullSafe(F.lag("group").over(w))})
    out = F.array_compact(F.array(
        F.when(F.col("n") == 1, F.struct(F.lit(0).alias("k"), F.try_element_at(headings, F.col("section")).alias("text"), F.lit("heading").alias("style"))),
        F.when(F.col("changed"), F.struct(F.lit(1).alias("k"), F.col("group").alias("text"), F.lit("subheading").alias("style"))),
        F.struct(F.lit(2).alias("k"), F.col("text").alias("text"), F.lit("item").alias("style")),
    ))
    lines = rows.select("doc_id", "section_ord", "n", F.inline(out))
    return lines.select("doc_id", "section_ord", (F.col("n") * 3 + F.col("k")).alias("line_ord"), "text", "style")
