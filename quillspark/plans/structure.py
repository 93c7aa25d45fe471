"""The whole flow for many documents at once: text to lines, sections, items, fields, flags, approvals and what is left over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import patterns as P
from .. import vocab
from ..functions import text as T
from ..operators import enrich, fields, grouping, headings, letterhead, lines, reconcile, review, rewrites, routing, zones
from .stage import staged

JOBS = ["_generic_employment", "present_employment", "previous_employment"]
PAIRED = ["title", "employer", "start_date", "end_date", "is_current"]
DEGREE_PARTS = ["degree", "subject", "institution", "country", "year"]
GRANT_PARTS = ["project_title", "role", "duration", "funding_agency", "value_to_university"]
#: Phrases that are headings as they stand; lines are put together only to one of these.
PHRASES = [p for p, _ in headings.PHRASES]


def _map(**pairs: Column) -> Column:
    """A map of the pairs that have a value."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in pairs.items()]), lambda x: x["v"].isNotNull())
    return F.map_from_entries(entries)


def _item(ord_: Column, section: Column, pairs: Column, raw: Column, confidence: float | Column, flag: Column | None = None) -> list[Column]:
    none = F.array().cast("array<string>")
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return [ord_.cast("long").alias("item_ord"), section.alias("section"), pairs.alias("fields"), raw.alias("raw_text"), sure.alias("confidence"), (none if flag is None else F.array_compact(F.array(flag))).alias("flags"), F.lit("pending_review").alias("status"), none.alias("actions")]


def bodies(docs: DataFrame, taught: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines (doc_id, line_no, line) of ``docs(doc_id, text)`` as they are and without page furniture, wrapped and letter-spaced headings
    put together, and the furniture (doc_id, norm)."""
    raw = staged(lines.header_footer(reconcile.split_lines(docs.where("text is not null"))))
    furniture = staged(lines.running_headers(raw, taught))
    whole = lines.without_furniture(raw, furniture).select("doc_id", "line_no", "line")
    body = staged(lines.merge_spaced(lines.merge_wrapped(whole, PHRASES), PHRASES))
    return raw.select("doc_id", "line_no", "line"), body, furniture


def sectioned(body: DataFrame, taught: DataFrame | None = None) -> DataFrame:
    """Lines of a body with their sections: cut where headings are embedded or glued on, numbered anew, headings resolved and carried forward."""
    cut = lines.split_caps_runs(body)
    parts = headings.split_glued(cut.withColumn("line_no", F.struct("line_no", "piece")))
    order = Window.partitionBy("doc_id").orderBy("line_no", "part")
    numbered = parts.withColumn("at", F.row_number().over(order).cast("long")).select("doc_id", F.col("at").alias("line_no"), F.lit(0).alias("part"), "line")
    known = headings.authoritative(headings.resolve(numbered, taught=taught), asked=F.col("heading_key").isNotNull())
    return staged(headings.assign_sections(known))


def items_of(docs: DataFrame, taught: DataFrame | None = None, as_of_year: int = 2026, parts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Items of ``docs(doc_id, text)``: (doc_id, item_ord, section, fields, raw_text, confidence, flags, status, actions).

    Every step is partitioned by document; vocabularies are constants in the plan, and only fuzzy
    headings leave the JVM. The rows of each stage are written once (see ``staged``). A null or empty text gives no items. A column
    ``document`` may name the file that a text is from; names of owners are looked for in it. ``parts`` are the ``bodies`` of the documents, if they are known.
    """
    raw, body, furniture = parts or bodies(docs, taught)
    placed = sectioned(body, taught)
    officially = placed.where("is_heading").groupBy("doc_id", "section").agg(F.max("authoritative").alias("authoritative"))
    line = F.col("line")
    content = staged(placed.where(F.col("section").isNotNull() & (F.col("section") != "_ignored")).withColumn("is_break", F.col("is_heading") | T.junk(line) | T.bare_contact(line)))
    zoned = zones.zones(content)
    practice = (F.col("zone") == "knowledge_exchange") & F.col("section").isin(JOBS)
    zoned = zoned.withColumns({"section": F.when(practice, "_practice").otherwise(F.col("section")), "is_break": F.col("is_break") | (practice & T.strip(line).rlike(P.PRACTICE))})
    grouped = staged(grouping.group_items(zoned.select("doc_id", "section", "line_no", "line", "is_break")))
    funded = fields.grants(grouped.where("section = 'grants'").select("doc_id", F.col("item_no").alias("ord"), F.col("text").alias("line")), as_of_year)
    funded = funded.join(grouped.where("section = 'grants'").select("doc_id", F.col("item_no").alias("ord"), "first_line"), ["doc_id", "ord"])
    pairs = zones.paired(zones.subgroups(grouped.where("section <> 'grants'"))).withColumnsRenamed({c: f"p_{c}" for c in PAIRED})
    typed = staged(fields.qualification(staged(fields.employment(pairs, as_of_year=as_of_year))))
    typed = typed.withColumns({c: F.when(F.col("p_title").isNotNull(), F.col(f"p_{c}")).otherwise(F.col(c)) for c in PAIRED})
    typed = zones.inherited(typed).withColumn("target", F.when(F.col("section") == "_practice", "knowledge_exchange").otherwise(F.col("target")))
    section, job, text = F.col("section"), F.col("section").isin(JOBS), F.col("text")
    present = F.col("target") == "present_employment"
    degrees = _map(**{c: F.col(c) for c in DEGREE_PARTS})
    # under the heading of a biography a line that is no prose may be a degree; under that of qualifications a bare line stays, and one without any sign of a degree is a skill
    bare = (section == "qualifications") & (F.char_length("text") <= 40) & ~text.rlike(P.SENTENCE_END)
    told = text.rlike(fields.DEGREE) | text.rlike(P.INSTITUTION) | text.rlike(P.INSTITUTION_OF) | text.rlike(P.YEAR)
    skill = (section == "qualifications") & ~bare & ~told
    stray = (section == "biography") & ~T.prose(text)
    parsed = (
        F.when(job & F.col("start_date").isNotNull(), _map(title=F.col("title"), unit=F.when(present, F.col("employer")), employer=F.when(~present, F.col("employer")), start_date=F.col("start_date"), end_date=F.col("end_date"), is_current=F.when(F.col("is_current"), "true"), _line_override=F.col("line_override")))
        .when(stray | ((section == "qualifications") & ~bare & ~skill), degrees)
        .when(section == "publications", _map(subgroup=F.col("subgroup")))
        .when(section.isin("associations", "editorial_roles"), _map(kind=T.role_kind(text)))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    level = F.when((section == "_practice") | skill, 0.6).when(section == "_generic_employment", 0.65).when(bare | stray, 0.7).otherwise(0.8)
    target = F.when(stray, "qualifications").when(skill, "skills").otherwise(F.col("target"))
    kept = typed.where(~stray | text.rlike(fields.DEGREE))
    own = kept.join(officially, ["doc_id", "section"], "left").select("doc_id", *_item(F.col("first_line"), target, parsed, text, level, F.when(skill, "rerouted_by_content")), "authoritative")
    grants = funded.join(officially.where("section = 'grants'").drop("section"), "doc_id", "left").select("doc_id", *_item(F.col("first_line"), F.lit("grants"), _map(**{c: F.col(c) for c in GRANT_PARTS}), F.col("line"), 0.75), "authoritative")
    spoken = placed.where((F.col("section") == "_ignored") & ~F.col("is_heading") & T.strip(line).rlike(P.LANGUAGE_LIST)).select("doc_id", *_item(F.col("line_no"), F.lit("language_proficiency"), F.create_map().cast("map<string,string>"), T.strip(line), 0.75))
    # page headers first, the longest before the others: on many documents they are the contact strip
    above = lines.longest_first(furniture).select("doc_id", (F.col("place") - (1 << 30)).alias("ord"), F.col("norm").alias("line")).unionByName(placed.where("section is null").select("doc_id", F.col("line_no").alias("ord"), "line"))
    files = letterhead.names_in_files(docs.select("doc_id", "text", "document")) if "document" in docs.columns else None
    found_heads = staged(letterhead.letterhead(raw, above, files))
    heads = found_heads.select("doc_id", *_item(F.array_position(F.array(*map(F.lit, rewrites.LETTERHEAD)), F.col("section")) - 10, F.col("section"), _map(value=F.col("value")), F.col("source"), F.col("confidence")))
    lives = letterhead.biography(above.where("ord >= 0"), found_heads).select("doc_id", *_item(F.lit(-1), F.lit("biography"), F.create_map().cast("map<string,string>"), F.col("text"), 0.75))
    links = fields.identifiers(raw).select("doc_id", *_item(F.pmod(F.xxhash64("platform", "url"), F.lit(1 << 30)) + (1 << 40), F.lit("profiles_links"), _map(platform=F.col("platform"), url=F.col("url")), F.col("line"), 0.9))
    found = own.unionByName(grants)
    for more in (spoken, heads, lives, links):
        found = found.unionByName(more.withColumn("authoritative", F.lit(False)))
    # from here on, items move by what they say: echoes of the name, role words, mixed sections, content
    # without a home, the present role, and titles, in that order
    found = rewrites.drop_name_echoes(staged(found))
    found = staged(routing.reroute(rewrites.attach_details(found)).drop("authoritative"))
    found = staged(rewrites.without_home(rewrites.untangle(found)))
    found = staged(rewrites.clean_titles(rewrites.promote_present(found)))
    return staged(rewrites.clean_titles(rewrites.guess_title(found)))


def structured(docs: DataFrame, taught: DataFrame | None = None, threshold: float = vocab.APPROVE, classify: Callable[[DataFrame], DataFrame] | None = None, parts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Items validated, approved where sure, and cross-checked.

    ``classify(docs)`` may take the place of the rules and give items of its own; those whose source text doesn't stand in the
    document are dropped, and a document for which it gives none goes by the rules, with a flag.
    """
    found = items_of(docs, taught, parts=parts) if classify is None else _advised(docs, taught, classify)
    return routing.disagreements(review.approve(review.validate(found), threshold))


def _advised(docs: DataFrame, taught: DataFrame | None, classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    said = staged(reconcile.verbatim(classify(docs), docs))
    rest = docs.join(said.select("doc_id").distinct(), "doc_id", "left_anti")
    ruled = items_of(rest, taught).withColumn("flags", review.merged_flags(F.col("flags"), F.array(F.lit("classifier_fell_back"))))
    return said.select(*ruled.columns).unionByName(ruled)


def copies(docs: DataFrame, taught: DataFrame | None = None, parts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(doc_id, text): documents without page furniture, and with headings put together as well; what an item quotes may stand only there."""
    raw, body, furniture = parts or bodies(docs, taught)
    joined = lambda rows: lines.gathered(rows).select("doc_id", F.array_join("lines", "\n").alias("text"))
    return joined(lines.without_furniture(raw, furniture)).unionByName(joined(body)).unionByName(joined(lines.split_caps_runs(body).select("doc_id", F.struct("line_no", "piece").alias("line_no"), "line")))


def left_over(docs: DataFrame, items: DataFrame, taught: DataFrame | None = None) -> DataFrame:
    """Lines of the documents that no item covers, as unmapped items hold them."""
    rows = headings.resolve(reconcile.split_lines(docs.where("text is not null")), taught=taught, approximate=False)
    return reconcile.uncovered(rows, items)


def processed(docs: DataFrame, this_year: int, taught: DataFrame | None = None, threshold: float = vocab.APPROVE, classify: Callable[[DataFrame], DataFrame] | None = None, write: Callable[[DataFrame], DataFrame] | None = None, parts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """All items that an upload leads to, as they are stored: structured ones, what nothing covers, and drafted biographies, with ids and bands."""
    found = staged(structured(docs, taught, threshold, classify, parts))
    rest = reconcile.unmapped_items(left_over(docs, found, taught))
    drafts = enrich.biography_items(found, this_year, write)
    columns = found.columns
    return review.stored(found.unionByName(rest.select(*columns)).unionByName(drafts.select(*columns)))
