"""Queries over fixtures: letterheads, reports, advice, commands, and what is written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..catalog import register
from ..functions import text as T
from ..operators import advice, commands, enrich, fields, letterhead, lines, reconcile, render, review, routing
from ..sources import docx_out, files, store
from .fixture_queries import _FX_FACTS, _FX_REWRITE, _ITEM, _items, _pairs
from .tables import Fixture, table

_FX_SPACED = Fixture("line string", (("R I N E X A M P L E .",), ("RIN EXAMPLE",), ("S K I L L S",), ("r i n e x a",)))


@register("collapsed_names", Fixture("line string, joined string, person boolean", (("R I N E X A M P L E .", "RINEXAMPLE", True), ("RIN EXAMPLE", None, False), ("S K I L L S", "SKILLS", False), ("r i n e x a", "rinexa", False))).sql())
def collapsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written letter by letter."""
    joined = T.unspaced_name(F.col("line"))
    return _FX_SPACED.frame(spark).select("line", joined.alias("joined"), F.coalesce(T.collapsed_name(joined, F.lit(None).cast("string")), F.lit(False)).alias("person"))


_FX_SITES = Fixture("doc_id int, line_no int, line string", (
    (1, 0, "https://www.rin-example.org/ and https://doi.org/10.1/x"), (1, 1, "https://rin-example.org/a-long-path-that-a-line-break-cut-"), (1, 2, "http://a.bc"), (1, 3, "https://github.com/rin"),
    *((1, 4 + i, f"line {i} of text") for i in range(24)), (1, 40, "see https://too-late.example/page"), (1, 41, "My Online Profiles"), (1, 42, "https://lab.example/rin"), (1, 43, "AWARDS"), (1, 44, "https://prize.example/rin"),
    (1, 45, "Links"), (1, 46, "http://www.RIN-example.org and HTTPS://lab.example/rin/"),
))


@register("own_sites", Fixture("platform string, url string", (("GitHub", "https://github.com/rin"), ("Website", "https://www.rin-example.org/"), ("Website", "https://lab.example/rin"), ("Website", "http://www.RIN-example.org"))).sql())
def own_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the owner's own: no publishers, nothing that a line break cut, only from the top or under a heading of profiles."""
    return fields.identifiers(_FX_SITES.frame(spark)).select("platform", "url")


_FX_NAMED = Fixture("doc_id int, text string, document string", ((1, "BIOGRAPHY\nDr Rin Example is a lecturer.", "/in/Example Rin CV final (2).docx"), (2, "Elementary Teacher at large", "Elementary-Teacher-Resume.docx"), (3, "RIN EXAMPLE\nJob title: x", "rin_example_2020.pdf"), (4, "nothing", "CV.docx"), (5, "a\\\\E b", None)))


@register("names_in_files", Fixture("doc_id int, name string", ((1, "Dr Rin Example"), (3, "RIN EXAMPLE"))).sql())
def names_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that files are called by, as their texts write them."""
    return letterhead.names_in_files(_FX_NAMED.frame(spark))


_FX_HEADS = Fixture("doc_id int, line_no int, line string", (
    (1, 0, "RIN EXAMPLE PHONE: +10 55 555 0100"), (1, 1, "Job title: Senior Lecturer"), (1, 2, "rin.example@uni.example"),
    (2, 0, "Risk Management"), (2, 1, "Contact: 4th floor"), (2, 2, "fatima.arain@uni.example"),
    (3, 0, "A N N O T H E R ."), (3, 1, "Tel +10 55 555 0111"),
    (4, 0, "Ann Other"), (4, 1, "Ann Other, Head of Arts"), (4, 2, "Some Body"), (4, 3, "ann@x.example"), (4, 4, "Some Body"),
))
_FX_ABOVE = Fixture("doc_id int, ord long, line string", ((4, -5, "Page header"),))


@register("letterheads", Fixture("doc_id int, section string, value string, source string, confidence double", (
    (1, "email", "rin.example@uni.example", "rin.example@uni.example", 0.95), (1, "full_name", "RIN EXAMPLE", "RIN EXAMPLE", 0.8), (1, "job_title", "Senior Lecturer", "Senior Lecturer", 0.7), (1, "contact_info", "+10 55 555 0100", "+10 55 555 0100", 0.75),
    (2, "email", "fatima.arain@uni.example", "fatima.arain@uni.example", 0.95), (2, "full_name", "Fatima Arain", "fatima.arain@uni.example", 0.7), (2, "contact_info", ": 4th floor", ": 4th floor", 0.75),
    (3, "full_name", "ANNOTHER", "A N N O T H E R .", 0.8), (3, "contact_info", "+10 55 555 0111", "+10 55 555 0111", 0.75),
    (4, "email", "ann@x.example", "ann@x.example", 0.95), (4, "full_name", "Some Body", "Some Body", 0.85), (4, "job_title", "Ann Other, Head of Arts", "Ann Other, Head of Arts", 0.7),
)).sql().replace("': 4th floor'", "'4th floor'"))
def letterheads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners by label, by shape, by address, letter by letter, and by standing twice in the document."""
    return letterhead.letterhead(_FX_HEADS.frame(spark), _FX_ABOVE.frame(spark))


_PROSE = "I have taught the statistics of rivers and of roads for more than ten long years"
_FX_PREAMBLE = Fixture("doc_id int, ord long, line string", ((1, 0, "RIN EXAMPLE"), (1, 1, f"Title: {_PROSE}"), (1, 2, f"{_PROSE} in Quito."), (2, 0, "Too short to be prose")))
_FX_USED = Fixture("doc_id int, source string", ((1, _PROSE), (1, "RIN EXAMPLE")))


@register("preamble_biographies", Fixture("doc_id int, text string", ((1, f"{_PROSE} in Quito."),)).sql())
def preamble_biographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose above the first heading that the letterhead doesn't hold."""
    return letterhead.biography(_FX_PREAMBLE.frame(spark), _FX_USED.frame(spark))


_FX_PAGES = Fixture("doc_id int, line_no long, line string, is_header_footer boolean", (
    *((1, 10 * i, "Dr Rin Example, page header", False) for i in range(3)), *((1, 10 * i + 1, "North University, Canada", False) for i in range(4)), (1, 50, "only in the footer", True), *((1, 60 + i, "TEACHING AND LEARNING", False) for i in range(3)), (1, 70, "text", False),
))


@register("page_furniture", Fixture("norm string", (("Dr Rin Example, page header",), ("only in the footer",), ("TEACHING AND LEARNING",))).sql())
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and marked lines, but organisations with a place, which repeat as content."""
    return lines.running_headers(_FX_PAGES.frame(spark)).select("norm")


_FX_COPIES = Fixture("doc_id int, line_no int, line string", ((1, 0, "AWARDS"), (1, 1, "AWARDS"), (1, 2, "A prize"), (1, 3, "A prize"), (1, 4, "Awards:"), (2, 0, "AWARDS")))


@register("deduped_headings", Fixture("doc_id int, line_no int", ((1, 0), (1, 2), (1, 3), (1, 4), (2, 0))).sql())
def deduped_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedupe_headings(_FX_COPIES.frame(spark)).select("doc_id", "line_no")


_FX_SIZES = Fixture("doc_id int, line string, size double", ((1, "Skills", 14.0), (1, "body a", 10.0), (1, "body  b", 10.0), (1, "body c", 11.0), (1, "a long line of more than ten words in a large font here", 20.0), (1, "unsized", None), (2, "Big", 20.0), (2, "a", 10.0), (2, "b", 10.0)))


@register("font_headings", Fixture("doc_id int, norm string", ((1, "skills"),)).sql())
def font_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand out by their font, in documents with enough sized lines to tell."""
    return lines.font_headings(_FX_SIZES.frame(spark))


_FX_BREAKS = Fixture("doc_id int, item_ord int, section string, raw_text string", ((1, 0, "awards", "A prize for bridges"), (1, 1, "awards", "An invented prize"), (1, 2, "nowhere", "A prize"), (1, 3, "awards", "Second prize"), (1, 4, "awards", " ")))
_FX_WHOLE = Fixture("doc_id int, text string", ((1, "A prize for\nPage header\nbridges\nSecond\n prize"),))
_FX_CUT = Fixture("doc_id int, text string", ((1, "A prize for\nbridges"),))


@register("quoted_items", Fixture("item_ord int", ((0,), (3,))).sql())
def quoted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stand in their document, also where page furniture parts them."""
    return reconcile.verbatim(_FX_BREAKS.frame(spark), _FX_WHOLE.frame(spark), _FX_CUT.frame(spark)).select("item_ord")


_FX_LEFT = Fixture("doc_id int, line_no long, value string, context string", ((1, 7, "The hills north of the old town", "PLACES"),))


@register("unmapped_items", Fixture("doc_id int, section string, fields string, confidence double, flags string, status string", ((1, "unmapped", "context=PLACES|value=The hills north of the old town", 0.4, "unmapped_content", "pending_review"),)).sql())
def unmapped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.unmapped_items(_FX_LEFT.frame(spark)).select("doc_id", "section", _pairs().alias("fields"), "confidence", F.array_join("flags", ",").alias("flags"), "status")


_FX_STORED = Fixture(_ITEM, ((1, 0, "awards", "", "", "a", 1.5, None), (1, 1, "awards", "", "", "a", -0.2, "approved"), (1, 2, "awards", "", "", "a", None, "rejected"), (2, 0, "awards", "", "", "a", 0.75, "edited")))


@register("stored_items", Fixture("doc_id int, item_ord long, confidence double, band string, status string, twins long", ((1, 0, 1.0, "high", "pending_review", 1), (1, 1, 0.0, "low", "approved", 1), (1, 2, 0.0, "low", "rejected", 1), (2, 0, 0.75, "medium", "edited", 1))).sql())
def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with ids, bands and bounds."""
    kept = review.stored(_items(spark, _FX_STORED))
    twins = kept.groupBy("item_id").agg(F.count("*").alias("twins"))
    return kept.join(twins, "item_id").select("doc_id", "item_ord", "confidence", "band", "status", "twins")


_FX_REMARKS = Fixture(_ITEM, (
    (1, 0, "publications", "citation", "A, 2019", "A, 2019", 0.8, "approved"), (1, 1, "publications", "citation", "a, 2019", "a, 2019", 0.8, "approved"), (1, 2, "awards", "", "", "No prize", 0.8, "rejected"),
    (1, 3, "previous_employment", "title|employer", "X|Delta", "X, Delta", 0.8, "edited"), (1, 4, "previous_employment", "title", "Y", "Y", 0.8, "pending_review"), (2, 0, "awards", "", "", "A prize", 0.8, "approved"),
))


@register("remarks", Fixture("doc_id int, duplicates string, discarded string, short string", ((1, "publications: A, 2019|publications: a, 2019", "awards: No prize", "previous_employment.title: X"), (2, "", "", ""))).sql())
def remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review.remarks(review.duplicate_flags(_items(spark, _FX_REMARKS)))
    return found.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("duplicates", "discarded", "short")])


@register("readiness", Fixture("doc_id int, pending_count long, ready boolean, coverage double", ((1, 1, False, 1.0), (2, 0, True, 1.0))).sql())
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is ready when nothing of it waits."""
    return review.summary_report(_items(spark, _FX_REMARKS)).select("doc_id", "pending_count", "ready", "coverage")


_FX_DEGREES = Fixture(_ITEM, (
    (1, 0, "qualifications", "degree|institution", "MSc|North College", "x", 0.8, "approved"), (1, 1, "qualifications", "degree", "msc", "x", 0.8, "approved"), (1, 2, "qualifications", "degree", "Ph.D", "x", 0.8, "approved"),
    (1, 3, "qualifications", "degree", "Diploma", "x", 0.8, "approved"), (1, 4, "awards", "degree", "BA", "x", 0.8, "approved"), (1, 5, "full_name", "value", "Rin Example", "x", 0.8, "approved"), (1, 6, "job_title", "value", "Tutor", "x", 0.8, "approved"),
))


@register("distinct_degrees", Fixture("doc_id int, degrees string", ((1, "MSc from North College|Ph.D|Diploma"),)).sql())
def distinct_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.degrees(_items(spark, _FX_DEGREES)).select("doc_id", F.array_join("degrees", "|").alias("degrees"))


@register("biography_items", Fixture("section string, line string, confidence double, flags string, status string", (("biography", "Rin Example works as a Tutor and holds an MSc from North College, a Ph.D, and a Diploma.", 0.5, "drafted_not_extracted", "pending_review"),)).sql())
def biography_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = enrich.biography_items(_items(spark, _FX_DEGREES), 2026)
    return drafts.select("section", render.item_line().alias("line"), "confidence", F.array_join("flags", ",").alias("flags"), "status")


@register("saved_profiles", Fixture("doc_id int, profile_id string, email string", ((1, "rin-example", "rin@uni.example"),)).sql())
def saved_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles found by the owner's name."""
    profiles = Fixture("profile_id string, email string", (("rin-example", "rin@uni.example"), ("no-one", "x@uni.example"))).frame(spark)
    return enrich.saved_profiles(_items(spark, _FX_FACTS), profiles).select("doc_id", "profile_id", "email")


_SAID = [
    ({"status": "CLASSIFY", "section": "Awards and Recognitions", "confidence": 0.9, "reasoning": " a prize "}, ("CLASSIFY", "awards", 0.9, "a prize"), None),
    ({"status": "CLASSIFY", "section": "hobbies", "confidence": 0.9, "reasoning": "x"}, None, None),
    ({"status": "REVIEW_REQUIRED", "section": "awards", "confidence": 0, "reasoning": "x"}, ("REVIEW_REQUIRED", None, 0.0, "x"), None),
    ({"status": "CLASSIFY", "section": "AWARDS", "confidence": 1.1, "reasoning": "x"}, None, None),
    ({"status": "CLASSIFY", "section": "awards", "confidence": "0.9", "reasoning": "x"}, None, None),
    ({"status": "CLASSIFY", "section": "awards", "confidence": 0.9, "reasoning": " "}, None, None),
    ({"verdict": "CHANGE", "section": "grants", "confidence": 1, "reasoning": "x"}, None, ("CHANGE", "grants", 1.0, "x")),
    ({"verdict": "ACCEPT", "section": "nothing", "confidence": 0.5, "reasoning": "x"}, None, ("ACCEPT", None, 0.5, "x")),
    ({"verdict": "CHANGE", "confidence": 0.5, "reasoning": "x"}, None, None),
]
_FX_SAID = Fixture("id int, said string", (*((i, json.dumps(x)) for i, (x, _, _) in enumerate(_SAID)), (90, "no json"), (91, None)))


@register("classifier_answers", Fixture("id int, status string, section string, confidence double, reasoning string, verdict string, changed string", tuple((i, *(a or (None,) * 4), *((b or (None,) * 2)[:2])) for i, (a, b) in [*((i, x[1:]) for i, x in enumerate(_SAID)), (90, (None, None)), (91, (None, None))])).sql())
def classifier_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that fit the form; what almost fits counts as none."""
    x, y = advice.classified(F.col("said")), advice.classified(F.col("said"), review=True)
    return _FX_SAID.frame(spark).withColumns({"x": x, "y": y}).select("id", "x.status", "x.section", "x.confidence", "x.reasoning", F.col("y.status").alias("verdict"), F.col("y.section").alias("changed"))


_OFFERED = [(k, label) for k, h, label in vocab.SECTIONS if h or k in ("skills", "language_proficiency")]
_KNOWN = json.dumps({"sections": {k: {"description": f"What {k} holds.", "examples": [f"an example of {k}"], "include": [], "exclude": ["else"] if k == "awards" else []} for k, _ in _OFFERED}})


@register("prompt_lines", Fixture("section string, line string", tuple((k, f'- {k} ({label}): What {k} holds.\n    e.g. "an example of {k}"' + ("\n    NOT: else" if k == "awards" else "")) for k, label in _OFFERED)).sql())
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as prompts state them, from a file of what is known of them."""
    return advice.prompt_lines(advice.knowledge(Fixture("value string", ((_KNOWN,),)).frame(spark)))


_FX_PARTS = Fixture("doc_id int, item_ord long, texts string, sections string", ((1, 4, "First|prize", "awards|Skills"), (1, 2, "Diploma in Welding|Canada", "qualifications|awards"), (1, 1, "RIN|EXAMPLE", "awards|nowhere")))


@register("split_items", Fixture("section string, raw_text string, confidence double, flags string", (
    ("full_name", "Dr Rin Example", 0.8, ""), ("awards", "RIN EXAMPLE", 0.8, ""), ("skills", "Diploma in Welding, North College, Canada 2011", 0.8, ""), ("awards", "SENIOR ANALYST Delta Works / Quito, EC / 2015 - 2018 Led the team", 0.9, ""),
    ("awards", "First", 0.5, "ai_segmented"), ("skills", "prize", 0.5, "ai_segmented"),
)).sql())
def split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items replaced by their parts, where the parts cover them whole."""
    rows = _FX_PARTS.frame(spark).select("doc_id", "item_ord", F.transform(F.arrays_zip(F.split("texts", r"\|").alias("t"), F.split("sections", r"\|").alias("s")), lambda x: F.struct(x["t"].alias("text"), x["s"].alias("section"))).alias("segments"))
    return advice.split_items(_items(spark, _FX_REWRITE).where("doc_id = 1"), rows).select("section", "raw_text", "confidence", F.array_join("flags", ",").alias("flags"))


_FX_TYPED = Fixture("doc_id int, text string", ((1, "approve all"), (2, "add Best Paper to the moon"), (3, "dance"), (4, ""), (5, "set email to “”"), (6, "set email to a@b.example"), (7, "add A medal to awards"), (8, "reject skills")))


@register("command_answers", Fixture("doc_id int, action string, answer string", (
    (1, "bulk_status", None), (2, None, "Couldn't find a section called “the moon”."), (3, None, f"Didn't understand “dance”. {commands.HELP}"), (4, None, f"Type a command first. {commands.HELP}"),
    (5, None, f"Couldn't tell which field to set from “set email to “””. {commands.HELP}"), (6, "set_field", None), (7, "add_item", None), (8, "bulk_status", None),
)).sql())
def command_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.answered(_FX_TYPED.frame(spark)).select("doc_id", "action", "answer")


_FX_REVIEWED = Fixture(_ITEM, tuple((d, i, section, "value", "v", "v", 0.8, "pending_review") for d in (1, 6, 7, 8) for i, section in enumerate(("email", "skills"))))


@register("applied_commands", Fixture("doc_id int, section string, raw_text string, status string", (
    (1, "email", "v", "approved"), (1, "skills", "v", "approved"), (6, "email", "a@b.example", "edited"), (6, "skills", "v", "pending_review"), (7, "email", "v", "pending_review"), (7, "skills", "v", "pending_review"), (7, "awards", "A medal", "edited"),
    (8, "email", "v", "pending_review"), (8, "skills", "v", "rejected"),
)).sql())
def applied_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.applied(_items(spark, _FX_REVIEWED), commands.parse(_FX_TYPED.frame(spark))).select("doc_id", "section", "raw_text", "status")


@register("command_confirmations", Fixture("doc_id int, said string", ((1, "Approved 2 pending item(s) in all sections."), (6, "Set Email to “a@b.example”."), (7, "Added a new item to Awards and Recognitions."), (8, "Rejected 1 pending item(s) in Skills."))).sql())
def command_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.confirmations(_items(spark, _FX_REVIEWED), commands.parse(_FX_TYPED.frame(spark)))


_FX_FINISHED = Fixture(_ITEM, (
    (1, 0, "full_name", "value", "Rin Example", "x", 0.8, "approved"), (1, 1, "job_title", "value", "Tutor\nHead of Arts", "x", 0.8, "edited"), (1, 2, "email", "value", "rin@uni.example", "x", 0.8, "rejected"),
    (1, 3, "biography", "", "", "First part.", 0.8, "approved"), (1, 4, "biography", "", "", "Second part.", 0.8, "approved"), (1, 5, "skills", "", "", "Welding", 0.8, "approved"),
))
_FINISHED = (("Rin Example", "full_name"), ("Tutor", "job_title"), ("Head of Arts", "job_title"), ("BIOGRAPHY", "heading"), ("First part. Second part.", "item"), ("SKILLS", "heading"), ("Welding", "item"))


@register("finished_documents", Fixture("nth int, text string, style string", tuple((i, *x) for i, x in enumerate(_FINISHED))).sql())
def finished_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a finished document, letterhead first, a biography as one paragraph."""
    items = _items(spark, _FX_FINISHED)
    rows = render.letterhead_lines(items).unionByName(render.rendered(items))
    ordered = F.array_sort(F.collect_list(F.struct("section_ord", "line_ord", "text", "style")))
    return rows.groupBy("doc_id").agg(ordered.alias("x")).select(F.posexplode("x").alias("nth", "y")).select("nth", "y.text", "y.style")


@register("written_documents", Fixture("doc_id int, text string, error string", ((1, "\n".join(t for t, _ in _FINISHED), None),)).sql())
def written_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same document as a file, read again."""
    items = _items(spark, _FX_FINISHED)
    made = docx_out.documents(render.letterhead_lines(items).unionByName(render.rendered(items)))
    return files.texts(made.select("doc_id", F.lit("x.docx").alias("path"), "content", "error")).select("doc_id", "text", "error")


@register("merged_rows", "select o_orderkey, o_custkey, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as status from orders where o_orderkey % 5 <> 1 union all select -c_custkey - 1, c_custkey, 'new' from customer where c_custkey % 2 = 0")
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with some replaced, some new, and some deleted, as the tables of a store are changed."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    changed = orders.where("o_orderkey % 3 = 0").withColumn("status", F.lit("X"))
    new = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select((-F.col("c_custkey") - 1).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("new").alias("status"))
    whole = store.merged(orders, store.latest(changed.unionByName(new).unionByName(new), ["o_orderkey"]), ["o_orderkey"])
    return whole.join(orders.where("o_orderkey % 5 = 1").select("o_orderkey"), "o_orderkey", "left_anti")


_FX_ROUTED = Fixture(_ITEM, (
    (1, 0, "awards", "", "", "Associate Editor, Journal of Roads", 0.8, "approved"), (1, 1, "skills", "", "", "Managed a team", 0.8, "approved"), (1, 2, "skills", "", "", "React course - Academy", 0.8, "approved"), (1, 3, "publications", "", "", "Reviewer of papers", 0.8, "approved"),
    (1, 4, "committees", "", "", "Best Paper prize", 0.8, "approved"), (1, 5, "biography", "", "", "A reviewer", 0.8, "approved"),
))


@register("rerouted_items", Fixture("item_ord long, section string, confidence double, flags string", ((0, "editorial_roles", 0.7, "rerouted_by_content"), (1, "previous_employment", 0.7, "rerouted_by_content"), (2, "qualifications", 0.7, "rerouted_by_content"), (3, "publications", 0.8, "possible_fit_for_editorial_roles"), (4, "committees", 0.8, "possible_fit_for_awards"), (5, "biography", 0.8, ""))).sql())
def rerouted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items moved by their words, but from official headings; what then still points elsewhere is flagged."""
    rows = _items(spark, _FX_ROUTED).withColumn("authoritative", F.col("section") == "committees")
    return routing.disagreements(routing.reroute(rows)).select("item_ord", "section", "confidence", F.array_join("flags", ",").alias("flags"))


_CV = """R I N E X A M P L E
Senior Lecturer
rin.example@uni.example
I have taught the statistics of rivers and of roads for more than ten long years in Quito.

S U M M A R Y
Master of Arts, North College, 2009
Active and motivated.

EDUCATION
Bachelor of Science in Physics, South University, Canada (2004)
Planning and running of many long and busy workshops for staff

RESEARCH GRANTS
Project Title: Water and Light
Role: Lead
Duration: 2020-2022

PERSONAL DETAILS
Date of birth: 1 May 1980
Languages known: English, French

C A R E E R
The first half of what I aim at.
O B J E C T I V E"""
_FX_CV = Fixture("doc_id long, text string, document string", ((1, _CV, "CV.docx"),))


@register("structured_branches", Fixture("section string, raw_text string, fields string, flags string", (
    ("email", "rin.example@uni.example", "value=rin.example@uni.example", ""), ("full_name", "rin.example@uni.example", "value=Rin Example", ""), ("job_title", "Senior Lecturer", "value=Senior Lecturer", ""),
    ("biography", "I have taught the statistics of rivers and of roads for more than ten long years in Quito.", "", ""),
    ("qualifications", "Master of Arts, North College, 2009", "degree=Master of Arts|institution=North College|year=2009", ""),
    ("qualifications", "Bachelor of Science in Physics, South University, Canada (2004)", "country=Canada|degree=Bachelor of Science|institution=South University|subject=Physics|year=2004", ""),
    ("skills", "Planning and running of many long and busy workshops for staff", "", "rerouted_by_content"),
    ("grants", "Project Title: Water and Light", "duration=2020-2022|project_title=Water and Light|role=Lead", ""),
    ("language_proficiency", "Languages known: English, French", "", ""),
)).sql())
def structured_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow where sections hold what belongs elsewhere: a letter-spaced name and headings, prose above all headings, a degree under a summary, a skill among degrees, a grant in labelled lines, languages among personal details."""
    from . import structure

    found = structure.items_of(_FX_CV.frame(spark))
    return found.select("section", "raw_text", _pairs().alias("fields"), F.array_join("flags", ",").alias("flags"))
