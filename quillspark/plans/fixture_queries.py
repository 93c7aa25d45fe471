"""Queries over fixtures: invented inputs, with the expected rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text as T
from ..operators import advice, commands, enrich, fields, grouping, headings, lines, render, review, rewrites, routing, zones
from ..sources import files
from .tables import Fixture

HEADINGS = ["EDUCATION", "Selected Awards 2019-2021", "ACADAMIC QUALIFCATIONS", "RESEARCH GRANTS, FUNDING AND CONSULTANCY PROJECTS:", "I like awards and books.", "SUMMARY OF MY LIFE", "MY BEST JOURNAL ARTICLES EVER", "CAREER DETAILS — PRESENT EMPLOYMENT", "Hello world", "TEACHING AND LEARNING", "Key Skills", "SITE VISITS"]
_KEYS = ["qualifications", "awards", "qualifications", "grants", None, "biography", "publications", "present_employment", None, "teaching_learning", "skills", "knowledge_exchange"]
_FX_HEADINGS = Fixture("id int, line string", tuple(enumerate(HEADINGS)))
_FX_TAUGHT = Fixture("heading string, section string", (("Site Visits", "knowledge_exchange"),))


@register("heading_resolution", Fixture("id int, heading_key string", tuple(enumerate(_KEYS))).sql())
def heading_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.resolve(_FX_HEADINGS.frame(spark), taught=_FX_TAUGHT.frame(spark)).select("id", "heading_key")


@register("authoritative_headings", Fixture("id int", ((3,), (7,), (9,))).sql())
def authoritative_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.authoritative(_FX_HEADINGS.frame(spark)).where("authoritative").select("id")


_FX_DOC = Fixture("doc_id int, line_no int, part int, line string", tuple((1, i, 0, x) for i, x in enumerate(["RIN EXAMPLE", "Senior Lecturer in Data Systems", "EDUCATION", "Diploma in Arts", "AWARDS", "First prize.", "EDUCATION", "Second degree", "PUBLICATIONS", "JOURNAL ARTICLES", "A paper, 2019"])))


@register("carried_sections", Fixture("line_no int, section string, run long, is_heading boolean", ((0, None, 0, False), (1, None, 0, False), (2, "qualifications", 1, True), (3, "qualifications", 1, False), (4, "awards", 2, True), (5, "awards", 2, False), (6, "qualifications", 3, True), (7, "qualifications", 3, False), (8, "publications", 4, True), (9, "publications", 4, False), (10, "publications", 4, False))).sql())
def carried_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.assign_sections(headings.resolve(_FX_DOC.frame(spark))).select("line_no", "section", "run", "is_heading")


_GROUPS = {
    "awards": ["• First prize for work", "• Supervising and evaluating", "• projects.", "• Third thing 2019", "Present"],
    "skills": ["Python programming", "and much more", "English: fluent", "French: basic"],
    "previous_employment": ["Lecturer, Blue University", "2010-2012", "Duties included:", "Managing things", "Writing papers"],
    "committees": ["Member of the board", "of trustees"],
    "language_proficiency": ["English (C2)", "German (B1)"],
}
_FX_GROUPS = Fixture("doc_id int, section string, line_no int, line string, is_break boolean", tuple((1, s, i, x, False) for s, xs in _GROUPS.items() for i, x in enumerate(xs)))


@register(
    "grouped_items",
    Fixture("section string, text string", (
        ("awards", "First prize for work"), ("awards", "Supervising and evaluating projects."), ("awards", "Third thing 2019 Present"),
        ("skills", "Python programming and much more"), ("skills", "English: fluent"), ("skills", "French: basic"),
        ("previous_employment", "Lecturer, Blue University 2010-2012 Duties included:"), ("previous_employment", "Managing things"), ("previous_employment", "Writing papers"),
        ("committees", "Member of the board of trustees"), ("language_proficiency", "English (C2)"), ("language_proficiency", "German (B1)"),
    )).sql(),
)
def grouped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_items(_FX_GROUPS.frame(spark)).select("section", "text")


_FX_JOBS = Fixture("id int, text string", ((1, "Lecturer | East Institute | Quito, Ecuador October 2015 – July 2019"), (2, "Adjunct Tutor (Jan 2021-Present) West Academy"), (3, "Analyst, Delta Advisory, 2018-20"), (4, "Research text without any year"), (5, "2010 - 2014 Northern College, Senior Lecturer"), (6, "08/2020 - 12/2022 Assistant Manager, Blue Ltd")))


@register("employment_fields", Fixture("id int, title string, employer string, start_date string, end_date string, is_current boolean", ((1, "Lecturer", "East Institute, Quito, Ecuador", "2015", "2019", False), (2, "Adjunct Tutor", "West Academy", "2021", "", True), (3, "Analyst", "Delta Advisory", "2018", "2020", False), (4, None, None, None, None, False), (5, "Senior Lecturer", "Northern College", "2010", "2014", False), (6, "Assistant Manager", "Blue Ltd", "2020", "2022", False))).sql())
def employment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.employment(_FX_JOBS.frame(spark)).drop("text", "line_override").fillna(False, ["is_current"])


_FX_DEGREES = Fixture("id int, text string", ((1, "Master of Science in Statistics, North College, Canada (2012)"), (2, "Ph.D. in Applied Physics, University of Westland, United Kingdom, 1999-2003"), (3, "PGCE (distinction) City Academy, Dubai 2010"), (4, "nothing here")))


@register("qualification_fields", Fixture("id int, degree string, subject string, institution string, country string, year string", ((1, "Master of Science", "Statistics", "North College", "Canada", "2012"), (2, "Ph.D", "Applied Physics", "University of Westland", "United Kingdom", "2003"), (3, "PGCE", None, "City Academy", "United Arab Emirates", "2010"), (4, None, None, None, None, None))).sql())
def qualification_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.qualification(_FX_DEGREES.frame(spark)).drop("text")


_FX_GRANTS = Fixture("doc_id int, ord int, line string", ((1, 0, "Project Title: Water and Light"), (1, 1, "Role: Lead"), (1, 2, "Duration: 2020-2022"), (1, 3, 'Principal Investigator: "Deep Roads"'), (1, 4, "(Funded by Road Council, 2025-26)"), (2, 0, "A plain first project"), (2, 1, "A second project of note, May 2019")))


@register("grant_records", Fixture("doc_id int, grant_ord long, project_title string, role string, duration string, funding_agency string, value_to_university string", ((1, 1, "Water and Light", "Lead", "2020-2022", None, None), (1, 2, "Deep Roads", "Principal Investigator", "2025-2026", "Road Council", None), (2, 1, "A plain first project", None, None, None, None), (2, 2, "A second project of note, May 2019", None, None, None, None))).sql())
def grant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.grants(_FX_GRANTS.frame(spark)).drop("ord", "line")


_FX_LINKS = Fixture("doc_id int, line_no int, line string", ((1, 0, "linkedin.com/in/rin-ex"), (1, 1, "see https://www.linkedin.com/in/rin-example-long."), (1, 2, "ORCID iD: 0000-0001-2345-6789"), (2, 0, "https://orcid.org/0000-0002-0000-0001 github.com/rin")))


@register("identifiers", Fixture("doc_id int, platform string, url string", ((1, "LinkedIn", "https://www.linkedin.com/in/rin-example-long"), (1, "ORCID", "https://orcid.org/0000-0001-2345-6789"), (2, "GitHub", "https://github.com/rin"), (2, "ORCID", "https://orcid.org/0000-0002-0000-0001"))).sql())
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.identifiers(_FX_LINKS.frame(spark)).drop("line")


_FX_YEARS = Fixture("text string", (("2025-26",), ("1999 - 02",), ("2020-2021",), ("2020-09",), ("no year",), ("1950-10",)))


@register("short_years", Fixture("text string, expanded string", (("2025-26", "2025-2026"), ("1999 - 02", "1999-2002"), ("2020-2021", "2020-2021"), ("2020-09", "2020-09"), ("no year", "no year"), ("1950-10", "1950-2010"))).sql())
def short_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FX_YEARS.frame(spark).withColumn("expanded", T.expand_short_years(F.col("text"), 2026))


_FX_ROLES = Fixture("text string", (("Associate Editor, Journal of Roads",), ("External Examiner, MSc",), ("Life Member of the Guild",), ("Chartered Engineer",), ("Wrote a book",)))


@register("role_kinds", Fixture("text string, kind string, section string", (("Associate Editor, Journal of Roads", "Editor", "editorial_roles"), ("External Examiner, MSc", "External examiner", "editorial_roles"), ("Life Member of the Guild", "Membership", "associations"), ("Chartered Engineer", "Chartered status", "associations"), ("Wrote a book", None, None))).sql())
def role_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FX_ROLES.frame(spark).select("text", T.role_kind(F.col("text")).alias("kind"), routing.route(F.col("text")).alias("section"))


_FX_COMMANDS = Fixture("text string", (("approve all",), ("Reject  teaching",), ("add Best Paper Award 2025 to awards",), ("set email to a.b@uni.example",), ("dance",), ("approve the moon",)))


@register("review_commands", Fixture("text string, action string, section string, value string, status string", (("approve all", "bulk_status", None, None, "approved"), ("Reject  teaching", "bulk_status", "teaching_learning", None, "rejected"), ("add Best Paper Award 2025 to awards", "add_item", "awards", "Best Paper Award 2025", None), ("set email to a.b@uni.example", "set_field", "email", "a.b@uni.example", None), ("dance", None, None, None, None), ("approve the moon", None, None, None, None))).sql())
def review_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.parse(_FX_COMMANDS.frame(spark)).select("text", "action", "section", "value", "status")


_FX_PASSES = Fixture("id int, pass1_status string, pass1_section string, pass1_conf double, pass2_verdict string, pass2_section string, pass2_conf double, current_section string", ((1, "CLASSIFY", "awards", 0.9, "ACCEPT", None, 0.8, "unmapped"), (2, "CLASSIFY", "awards", 0.9, "ACCEPT", None, 0.8, "awards"), (3, "CLASSIFY", "awards", 0.9, "CHANGE", "awards", 0.8, "grants"), (4, "CLASSIFY", "awards", 0.9, "CHANGE", "grants", 0.8, "grants"), (5, "CLASSIFY", "awards", 0.9, None, None, None, "grants"), (6, "REVIEW_REQUIRED", None, 0.2, None, None, None, "grants"), (7, "CLASSIFY", "awards", 0.9, "REVIEW_REQUIRED", None, 0.3, "awards")))


@register("two_pass_confidence", Fixture("id int, final_status string, final_section string, final_confidence double", ((1, "CLASSIFY", "awards", 0.72), (2, "CLASSIFY", "awards", 0.79), (3, "CLASSIFY", "awards", 0.61), (4, "REVIEW_REQUIRED", None, 0.0), (5, "CLASSIFY", "awards", 0.63), (6, "REVIEW_REQUIRED", None, 0.0), (7, "REVIEW_REQUIRED", None, 0.0))).sql())
def two_pass_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.two_passes(_FX_PASSES.frame(spark)).select("id", "final_status", "final_section", "final_confidence")


_FX_SPLITS = Fixture("id int, original string, segments string", ((1, "Won a prize; led a team.", "Won a prize|led a team"), (2, "Won a prize; led a team.", "Won a prize|ran a team"), (3, "Won a prize; led a team and sang.", "Won a prize|led a team"), (4, "Won a prize", "Won a prize"), (5, "a b a b", "a b|a b")))


@register("segment_coverage", Fixture("id int, valid boolean", ((1, True), (2, False), (3, False), (4, False), (5, True))).sql())
def segment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FX_SPLITS.frame(spark).select("id", advice.covers(F.col("original"), F.split("segments", r"\|")).alias("valid"))


_ITEM = "doc_id int, item_ord int, section string, keys string, vals string, raw_text string, confidence double, status string"


def _items(spark: SparkSession, fixture: Fixture) -> DataFrame:
    rows = fixture.frame(spark)
    none = F.array().cast("array<string>")
    made = F.when(F.col("keys") == "", F.create_map().cast("map<string,string>")).otherwise(F.map_from_arrays(F.split("keys", r"\|"), F.split("vals", r"\|")))
    return rows.select("doc_id", F.col("item_ord").cast("long").alias("item_ord"), "section", made.alias("fields"), "raw_text", "confidence", none.alias("flags"), "status", none.alias("actions"))


_FX_VALIDATE = Fixture(_ITEM, (
    (1, 0, "email", "value", "bad-at-example", "bad", 0.95, "pending_review"),
    (1, 1, "previous_employment", "start_date|end_date", "2010|2014", "a", 0.8, "pending_review"),
    (1, 2, "previous_employment", "start_date|end_date", "2014|2016", "b", 0.8, "pending_review"),
    (1, 3, "present_employment", "start_date|end_date", "2020|2021", "c", 0.8, "pending_review"),
    (1, 4, "publications", "citation", "A Title, 2019", "d", 0.8, "pending_review"),
    (1, 5, "publications", "citation", "a  title, 2019", "e", 0.8, "pending_review"),
    (1, 6, "awards", "", "", "f", 0.76, "pending_review"),
    (1, 7, "previous_employment", "start_date|end_date", "2009|2008", "g", 0.92, "pending_review"),
    (1, 8, "profiles_links", "url", "not a url", "h", 0.6, "pending_review"),
))


@register("validated_items", Fixture("item_ord long, flags string, status string", (
    (0, "invalid_email_format", "pending_review"), (1, "medium_confidence,overlapping_employment_dates", "pending_review"), (2, "medium_confidence,overlapping_employment_dates", "pending_review"),
    (3, "medium_confidence,present_employment_has_end_date_review_section", "pending_review"), (4, "medium_confidence,possible_duplicate_publication", "pending_review"), (5, "medium_confidence,possible_duplicate_publication", "pending_review"),
    (6, "medium_confidence", "approved"), (7, "end_date_before_start_date", "pending_review"), (8, "invalid_url_format,low_confidence", "pending_review"),
)).sql())
def validated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.approve(review.validate(_items(spark, _FX_VALIDATE))).select("item_ord", F.array_join("flags", ",").alias("flags"), "status")


_FX_RENDER = Fixture(_ITEM, (
    (1, 0, "previous_employment", "title|employer|start_date|end_date", "Analyst|Delta|2018|2020", "raw", 0.8, "approved"),
    (1, 1, "editorial_roles", "kind", "Reviewer", "Reviewer, Journal A", 0.8, "approved"),
    (1, 2, "editorial_roles", "kind", "Editor", "Editor, Journal B", 0.8, "approved"),
    (1, 3, "profiles_links", "platform|url", "GitHub|https://github.com/rin", "raw", 0.9, "edited"),
    (1, 4, "awards", "", "", "A prize", 0.8, "approved"),
    (1, 5, "awards", "", "", "No prize", 0.8, "rejected"),
    (1, 6, "unmapped", "value", "x", "x", 0.4, "approved"),
))


@register("rendered_lines", Fixture("section_ord int, line_ord int, text string, style string", (
    (10, 3, "CAREER DETAILS – PREVIOUS EMPLOYMENT", "heading"), (10, 5, "Analyst, Delta (2018 – 2020)", "item"),
    (15, 3, "AWARDS AND RECOGNITIONS", "heading"), (15, 5, "A prize", "item"),
    (18, 3, "EDITORIAL BOARD MEMBERSHIPS, REVIEW, AND EXAMINER ROLES", "heading"), (18, 4, "Editor roles", "subheading"), (18, 5, "Editor, Journal B", "item"), (18, 7, "Reviewer roles", "subheading"), (18, 8, "Reviewer, Journal A", "item"),
    (20, 3, "PROFESSIONAL PROFILES, LINKS, AND IDENTIFIERS", "heading"), (20, 5, "GitHub: https://github.com/rin", "item"),
)).sql())
def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.rendered(_items(spark, _FX_RENDER)).drop("doc_id")


_FX_WRAPPED = Fixture("doc_id int, text string", ((1, "PROFESSIONAL ASSOCIATION|MEMBERSHIPS AND FELLOWSHIPS|Member of a guild"), (2, "TEACHING|AND|LEARNING|TEACHING"), (3, "K E Y S K I L L S|Python"), (4, "C A R E E R|I build bridges|O B J E C T I V E|and roads"), (5, "R I N E X A M P L E|S K I L L S"), (6, "CAREER|OBJECTIVE|BOOKS"), (7, "H O B B I E S|E D U C A T I O N")))


@register("wrapped_headings", Fixture("doc_id int, merged string", ((1, "PROFESSIONAL ASSOCIATION MEMBERSHIPS AND FELLOWSHIPS|Member of a guild"), (2, "TEACHING AND LEARNING|TEACHING"), (3, "KEY SKILLS|Python"), (4, "CAREER OBJECTIVE|I build bridges|and roads"), (5, "R I N E X A M P L E|SKILLS"), (6, "CAREER OBJECTIVE|BOOKS"), (7, "HOBBIES|EDUCATION"))).sql())
def wrapped_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _FX_WRAPPED.frame(spark).select("doc_id", F.posexplode(F.split("text", r"\|")).alias("line_no", "line"))
    phrases = [p for p, _ in headings.PHRASES]
    merged = lines.merge_spaced(lines.merge_wrapped(rows, phrases), phrases)
    return lines.gathered(merged).select("doc_id", F.array_join("lines", "|").alias("merged"))


_PREDICATES = [("Date of birth: 1 May 1980", True, False), ("Springfield, IL 62704", True, False), ("Email", False, True), ("rin@uni.example", False, True), ("+10 55 555 0100", False, True), ("https://uni.example/rin", True, False), ("AWARDS AND RECOGNITIONS TEACHING AND LEARNING", True, False), ("Full-Time", True, False), ("Taught statistics", False, False)]
_FX_PREDICATES = Fixture("line string", tuple((x,) for x, _, _ in _PREDICATES))


@register("junk_and_contact_lines", Fixture("line string, junk boolean, contact boolean", tuple(_PREDICATES)).sql())
def junk_and_contact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FX_PREDICATES.frame(spark).select("line", T.junk(F.col("line")).alias("junk"), T.bare_contact(F.col("line")).alias("contact"))


_FX_NAMES = Fixture("line string", (("Rin Example",), ("DR. RIN EXAMPLE",), ("Example University",), ("Senior Lecturer",), ("one two",), ("rin.example@uni.example",)))


@register("names", Fixture("line string, person boolean, from_email string, slug string", (("Rin Example", True, None, "rin-example"), ("DR. RIN EXAMPLE", True, None, "rin-example"), ("Example University", False, None, "example-university"), ("Senior Lecturer", False, None, "senior-lecturer"), ("one two", False, None, "one-two"), ("rin.example@uni.example", False, "Rin Example", "rin-example-uni-example"))).sql())
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headings.resolve(_FX_NAMES.frame(spark), approximate=False)
    return rows.select("line", T.person_name(F.col("line"), F.col("heading_key")).alias("person"), T.name_from_email(F.col("line")).alias("from_email"), T.slug(F.col("line")).alias("slug"))


_CV = """RIN EXAMPLE
Senior Lecturer in Data Systems
rin.example@uni.example | +10 55 555 0100

EDUCATION
• Master of Science in Statistics, North College, Canada (2012)
• Bachelor of Arts in History, South University, Canada (2009)

WORK EXPERIENCE
Lecturer, East Institute, 2012 - 2016
Senior Lecturer, West Academy, 2017 - Present

AWARDS AND RECOGNITIONS
First prize for teaching of statistics.

FAVOURITE PLACES TO WALK
The hills north of the old town"""
_FX_CV = Fixture("doc_id long, text string", ((1, _CV), (2, None), (3, "")))


@register("structured_items", Fixture("section string, raw_text string, fields string, status string", (
    ("email", "rin.example@uni.example | +10 55 555 0100", "value=rin.example@uni.example", "approved"),
    ("full_name", "RIN EXAMPLE", "value=RIN EXAMPLE", "approved"),
    ("job_title", "Senior Lecturer, West Academy, 2017 - Present", "value=Senior Lecturer", "pending_review"),
    ("contact_info", "+10 55 555 0100", "value=+10 55 555 0100", "approved"),
    ("qualifications", "Master of Science in Statistics, North College, Canada (2012)", "country=Canada|degree=Master of Science|institution=North College|subject=Statistics|year=2012", "approved"),
    ("qualifications", "Bachelor of Arts in History, South University, Canada (2009)", "country=Canada|degree=Bachelor of Arts|institution=South University|subject=History|year=2009", "approved"),
    ("previous_employment", "Lecturer, East Institute, 2012 - 2016", "employer=East Institute|end_date=2016|start_date=2012|title=Lecturer", "pending_review"),
    ("present_employment", "Senior Lecturer, West Academy, 2017 - Present", "end_date=|is_current=true|start_date=2017|title=Senior Lecturer|unit=West Academy", "pending_review"),
    ("awards", "First prize for teaching of statistics.", "", "approved"),
    ("awards", "FAVOURITE PLACES TO WALK", "", "approved"),
    ("awards", "The hills north of the old town", "", "approved"),
)).sql())
def structured_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow on one document with all parts, one null and one empty text."""
    from . import structure

    found = structure.structured(_FX_CV.frame(spark))
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")
    return found.select("section", "raw_text", pairs.alias("fields"), "status")


_FX_SAID = Fixture("doc_id long, item_ord int, section string, value string, raw_text string", ((1, 0, "full_name", "RIN EXAMPLE", "RIN EXAMPLE"), (1, 1, "email", "rin.example@uni.example", "rin.example@uni.example | +10 55 555 0100"), (1, 2, "qualifications", "", "Master of Science in Statistics, North College, Canada (2012)"), (1, 3, "job_title", "Senior Lecturer in Data Systems", "Senior Lecturer in Data Systems")))


@register("unmapped_lines", Fixture("line_no long, value string, context string", (
    (6, "• Bachelor of Arts in History, South University, Canada (2009)", "EDUCATION"),
    (9, "Lecturer, East Institute, 2012 - 2016", "WORK EXPERIENCE"),
    (10, "Senior Lecturer, West Academy, 2017 - Present", "WORK EXPERIENCE"),
    (13, "First prize for teaching of statistics.", "AWARDS AND RECOGNITIONS"),
    (16, "The hills north of the old town", "FAVOURITE PLACES TO WALK"),
)).sql())
def unmapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import structure

    items = _FX_SAID.frame(spark).select("doc_id", "item_ord", "section", F.create_map(F.lit("value"), F.col("value")).alias("fields"), "raw_text")
    return structure.left_over(_FX_CV.frame(spark), items).select("line_no", "value", "context")


_FX_REWRITE = Fixture(_ITEM, (
    (1, 0, "full_name", "value", "Dr Rin Example", "Dr Rin Example", 0.8, "pending_review"),
    (1, 1, "awards", "", "", "RIN EXAMPLE", 0.8, "pending_review"),
    (1, 2, "skills", "", "", "Diploma in Welding, North College, Canada 2011", 0.8, "pending_review"),
    (1, 3, "awards", "", "", "SENIOR ANALYST Delta Works / Quito, EC / 2015 - 2018 Led the team", 0.9, "pending_review"),
    (1, 4, "awards", "", "", "First prize", 0.8, "pending_review"),
    (2, 0, "knowledge_exchange", "", "", "MEDIA COVERAGE", 0.8, "pending_review"),
    (2, 1, "knowledge_exchange", "", "", "Radio talk on bridges", 0.8, "pending_review"),
    (2, 2, "knowledge_exchange", "", "", "A paper on bridges, 2019", 0.8, "pending_review"),
    (2, 3, "knowledge_exchange", "", "", "Another talk", 0.8, "pending_review"),
    (2, 4, "skills", "", "", "VISA STATUS: resident", 0.4, "pending_review"),
))


@register("name_echoes", Fixture("doc_id int, item_ord long", ((1, 0), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4))).sql())
def name_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrites.drop_name_echoes(_items(spark, _FX_REWRITE)).select("doc_id", "item_ord")


@register("untangled_items", Fixture("item_ord long, section string, fields string, confidence double", (
    (2, "qualifications", "country=Canada|degree=Diploma|institution=North College|subject=Welding|year=2011", 0.7),
    (3, "previous_employment", "_line_override=SENIOR ANALYST, Delta Works (2015 – 2018)\nLed the team|employer=Delta Works|end_date=2018|start_date=2015|title=SENIOR ANALYST", 0.7),
    (4, "awards", "", 0.8),
)).sql())
def untangled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rewrites.untangle(_items(spark, _FX_REWRITE)).where("doc_id = 1 and item_ord >= 2")
    return found.select("item_ord", "section", _pairs().alias("fields"), "confidence")


def _pairs():
    return F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")


@register("items_without_home", Fixture("item_ord long, section string, confidence double", ((0, "unmapped", 0.5), (1, "unmapped", 0.5), (2, "knowledge_exchange", 0.8), (3, "knowledge_exchange", 0.8), (4, "unmapped", 0.4))).sql())
def items_without_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrites.without_home(_items(spark, _FX_REWRITE)).where("doc_id = 2").select("item_ord", "section", "confidence")


_FX_ROLES_NOW = Fixture(_ITEM, (
    (1, 0, "present_employment", "title|unit", "Dean of Arts|West", "Dean of Arts, West, 2020 - Present", 0.8, "pending_review"),
    (1, 1, "job_title", "value", "Lecturer", "Lecturer", 0.7, "pending_review"),
    (2, 0, "previous_employment", "title|employer|is_current", "Analyst|Delta|true", "Analyst, Delta, 2021 - Present", 0.65, "pending_review"),
    (3, 0, "awards", "", "", "Senior Lecturer | 2019 to present", 0.8, "pending_review"),
    (4, 0, "previous_employment", "title|employer", "Tutor|East", "Tutor, East, 2010 - 2012", 0.65, "pending_review"),
    (5, 0, "present_employment", "title", "Dean", "Dean", 0.8, "pending_review"),
    (5, 1, "present_employment", "title", "Chair", "Chair", 0.8, "pending_review"),
    (5, 2, "job_title", "value", "Lecturer", "Lecturer", 0.7, "pending_review"),
))


@register("promoted_roles", Fixture("doc_id int, section string, value string, confidence double", (
    (1, "present_employment", "Dean of Arts", 0.8), (1, "job_title", "Dean of Arts", 0.7),
    (2, "present_employment", "Analyst", 0.65), (2, "job_title", "Analyst", 0.7),
    (3, "awards", "Senior Lecturer | 2019 to present", 0.8), (3, "present_employment", "Senior Lecturer", 0.6), (3, "job_title", "Senior Lecturer", 0.7),
    (4, "previous_employment", "Tutor", 0.65), (4, "job_title", "Tutor", 0.5),
    (5, "present_employment", "Dean", 0.8), (5, "present_employment", "Chair", 0.8), (5, "job_title", "Lecturer", 0.7),
)).sql())
def promoted_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The present role as the title, and a title guessed for a document that has none."""
    found = rewrites.guess_title(rewrites.promote_present(_items(spark, _FX_ROLES_NOW)))
    return found.select("doc_id", "section", F.coalesce(F.col("fields")["value"], F.col("fields")["title"], "raw_text").alias("value"), "confidence")


_FX_TITLES = Fixture(_ITEM, (
    (1, 0, "job_title", "value", "Senior Lecturer and Head of Research", "t", 0.7, "pending_review"),
    (2, 0, "job_title", "value", "Senior Lecturer, Northern Lights University", "t", 0.7, "pending_review"),
    (3, 0, "job_title", "value", "Lecturer • Quito", "t", 0.7, "pending_review"),
    (4, 0, "awards", "value", "A, North University", "t", 0.8, "pending_review"),
))


@register("clean_titles", Fixture("doc_id int, value string, confidence double, flags string", ((1, "Senior Lecturer\nHead of Research", 0.65, "multi_title_split"), (2, "Senior Lecturer", 0.65, "institution_stripped_from_title"), (3, "Lecturer", 0.7, ""), (4, "A, North University", 0.8, ""))).sql())
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrites.clean_titles(_items(spark, _FX_TITLES)).select("doc_id", F.col("fields")["value"].alias("value"), "confidence", F.array_join("flags", ",").alias("flags"))


_FX_DETAILS = Fixture(_ITEM, (
    (1, 0, "qualifications", "degree", "Diploma", "Diploma in Arts", 0.8, "pending_review"),
    (1, 1, "qualifications", "", "", "GPA: 3.7/4.0", 0.7, "pending_review"),
    (1, 2, "qualifications", "", "", "Thesis title: On bridges", 0.7, "pending_review"),
    (1, 3, "qualifications", "", "", "Certificate in Maths", 0.7, "pending_review"),
    (2, 0, "qualifications", "", "", "GPA 3.0", 0.7, "pending_review"),
))


@register("attached_details", Fixture("doc_id int, item_ord long, raw_text string, confidence double", ((1, 0, "Diploma in Arts GPA: 3.7/4.0 Thesis title: On bridges", 0.8), (1, 3, "Certificate in Maths", 0.7), (2, 0, "GPA 3.0", 0.7))).sql())
def attached_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrites.attach_details(_items(spark, _FX_DETAILS)).select("doc_id", "item_ord", "raw_text", "confidence")


_FX_FACTS = Fixture(_ITEM, (
    (1, 0, "full_name", "value", "Dr. Rin Example", "x", 0.8, "approved"),
    (1, 1, "job_title", "value", "Economist", "x", 0.7, "approved"),
    (1, 2, "qualifications", "degree", "MSc", "MSc, North College", 0.8, "approved"),
    (1, 3, "previous_employment", "title|start_date", "Analyst|2016", "x", 0.8, "approved"),
    (1, 4, "profiles_links", "platform|url", "Google Scholar|https://scholar.example/1", "x", 0.9, "approved"),
    (1, 5, "associations", "", "", "Guild of Bridges", 0.8, "approved"),
    (2, 0, "full_name", "value", "Ann Other", "x", 0.8, "approved"),
    (2, 1, "job_title", "value", "Tutor", "x", 0.7, "approved"),
))


@register("seeded_profiles", Fixture("profile_id string, full_name string, job_title string, links string, memberships string", (("rin-example", "Dr. Rin Example", "Economist", "google_scholar=https://scholar.example/1", "Guild of Bridges"), ("ann-other", "Ann Other", "Tutor", "", ""))).sql())
def seeded_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrich.seed_profiles(_items(spark, _FX_FACTS))
    return found.select("profile_id", "full_name", "job_title", F.array_join(F.transform(F.map_entries("links"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("links"), F.array_join("memberships", "|").alias("memberships"))


@register("drafted_biographies", Fixture("doc_id int, text string", ((1, "Dr. Rin Example works as an Economist and holds an MSc. Dr. Example has worked for 10 years."),)).sql())
def drafted_biographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.biographies(_items(spark, _FX_FACTS), 2026)


_FX_PHOTOS = Fixture("doc_id int, photo_id int, digest string, width int, height int", ((1, 1, "a", 100, 120), (1, 2, "b", 300, 320), (1, 3, "b", 300, 320), (1, 4, "c", 900, 90), (1, 5, "d", 110, 130), (2, 1, "e", 10, 1)))


@register("portraits", Fixture("doc_id int, photo_id int", ((1, 5),)).sql())
def portraits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.best_photo(_FX_PHOTOS.frame(spark))


@register("invariants", "select cast(null as varchar) as rule, cast(null as bigint) as doc_id where false")
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of what must hold of structured documents: there are none."""
    from . import invariants as rules
    from . import structure

    docs = _FX_CV.frame(spark)
    return rules.breaches(structure.structured(docs), docs)


_FX_BROKEN = Fixture(_ITEM, (
    (1, 0, "full_name", "value", "Example University", "Example University", 0.8, "approved"),
    (1, 1, "email", "value", "nobody", "nobody", 0.9, "approved"),
    (1, 2, "awards", "", "", "2010 - 2012", 0.8, "approved"),
    (1, 3, "profiles_links", "platform|url", "GitHub|github.com/rin", "github.com/rin", 0.9, "approved"),
    (1, 4, "qualifications", "degree|year", "MSc|2001", "Diploma 2002", 0.8, "approved"),
    (1, 5, "awards", "", "", "Example University", 0.8, "approved"),
    (1, 6, "previous_employment", "title|start_date", "|2010", "2010 onwards", 0.8, "approved"),
))
_FX_BROKEN_DOCS = Fixture("doc_id int, text string", ((1, "Example University nobody 2010 - 2012 github.com/rin Diploma 2002 2010 onwards"), (2, "only text")))


@register("invariant_breaches", Fixture("rule string, doc_id int", (("name", 1), ("email", 1), ("date only", 1), ("link", 1), ("degree", 1), ("year", 1), ("name echo", 1), ("employment of dates", 1), ("items", 2), ("no email", 2))).sql())
def invariant_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import invariants as rules

    return rules.breaches(_items(spark, _FX_BROKEN), _FX_BROKEN_DOCS.frame(spark))


_FX_ZONES = Fixture("doc_id int, section string, line_no int, line string", tuple((1, "previous_employment", i, x) for i, x in enumerate(["Lecturer, East, 2010 - 2012", "Keynote Speeches", "On bridges, Quito", "Delta Works, 2013 - 2015", "Senior Analyst", "Led a team"])))


@register("practice_zones", Fixture("line_no int, zone string", ((0, "employment"), (1, "knowledge_exchange"), (2, "knowledge_exchange"), (3, "employment"), (4, "employment"), (5, "employment"))).sql())
def practice_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.zones(_FX_ZONES.frame(spark)).select("line_no", "zone")


_FX_PAIRS = Fixture("doc_id int, section string, item_no int, text string", ((1, "_generic_employment", 1, "Senior Analyst"), (1, "_generic_employment", 2, "Delta Works, Quito, EC (2015 - Present"), (1, "_generic_employment", 3, "Led a team of ten"), (1, "_generic_employment", 4, "Tutor"), (1, "_generic_employment", 5, "East, Lima, PE 2010 - 2012"), (1, "_generic_employment", 6, "Marked papers")))


@register("paired_entries", Fixture("item_no int, title string, employer string, start_date string, end_date string, target string", (
    (1, "Senior Analyst", "Delta Works", "2015", "", "present_employment"), (3, None, None, None, None, "present_employment"),
    (4, "Tutor", "East", "2010", "2012", "previous_employment"), (6, None, None, None, None, "previous_employment"),
)).sql())
def paired_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.inherited(zones.paired(_FX_PAIRS.frame(spark))).select("item_no", "title", "employer", "start_date", "end_date", "target")


_FX_PAPERS = Fixture("doc_id int, section string, item_no int, text string", tuple((1, "publications", i, x) for i, x in enumerate(["An early paper, 2001", "JOURNAL ARTICLES", "A paper, 2010", "CONFERENCE PAPERS", "A talk, 2012"])))


@register("publication_groups", Fixture("item_no int, subgroup string", ((0, None), (2, "journal"), (4, "conference"))).sql())
def publication_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.subgroups(_FX_PAPERS.frame(spark)).select("item_no", "subgroup")


_FX_FILES = Fixture("path string, length long", (("/in/a.DOCX", 5), ("/in/b.docx", 0), ("/in/c.pdf", 27262976), ("/in/d.txt", 5)))


@register("upload_guard", Fixture("path string, error string", (("/in/a.DOCX", None), ("/in/b.docx", "empty file"), ("/in/c.pdf", "too large"), ("/in/d.txt", "unsupported type"))).sql())
def upload_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.guarded(_FX_FILES.frame(spark)).select("path", "error")


_FX_EDITS = Fixture("doc_id int, item_ord long, new_value string, new_section string, new_status string", ((1, 0, "New name", None, None), (1, 4, None, "skills", None), (1, 2, None, None, "rejected")))


@register("patched_items", Fixture("item_ord long, section string, value string, status string", ((0, "full_name", "New name", "edited"), (1, "awards", None, "pending_review"), (2, "skills", None, "rejected"), (3, "awards", None, "pending_review"), (4, "skills", None, "edited"))).sql())
def patched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _FX_EDITS.frame(spark).select("doc_id", "item_ord", F.when(F.col("new_value").isNotNull(), F.create_map(F.lit("value"), F.col("new_value"))).alias("new_fields"), "new_section", "new_status")
    found = commands.patch(_items(spark, _FX_REWRITE).where("doc_id = 1"), edits)
    return found.select("item_ord", "section", F.col("fields")["value"].alias("value"), "status")
