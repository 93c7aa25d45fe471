"""Line cleaning and predicates as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import patterns as P
from .. import vocab
from ..patterns import (BULLET, CALENDAR_YEAR, DATE_ANCHOR, DATE_ONLY, EMAIL, ENTRY_END_YEAR, HONORIFIC, LABEL, MONTH, OPEN_LEAD, ORG_WORD, PHONE, PRESENT, SENTENCE_END, TITLE_WORD, YEAR_RANGE)



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often and in whatever lambda it is used; null for a null."""
    return F.get(F.transform(F.array(value), lambda x: F.when(x.isNotNull(), body(x))), F.lit(0))


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once for a row, however often they are used and filtered by.

    A generator of one row stands between them and their uses: a planner moves no filter through it, and so never
    puts a costly expression in the place of each use.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    return rows.select(*kept, F.struct(*[c.alias(name) for name, c in columns.items()]).alias("__settled")).select(*kept, F.inline(F.array("__settled")))


def constant(v: object) -> str:
    """A literal as SQL text: constant tables are parsed in one piece instead of being built cell by cell."""
    return str(v) if isinstance(v, int) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant_map(pairs: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"{constant(k)}, {constant(v)}" for k, v in pairs.items()) + ")")


def constant_rows(names: str, rows: list[tuple]) -> Column:
    """An array of structs with the fields ``names``."""
    cells = ("named_struct(" + ", ".join(f"'{n}', {constant(v)}" for n, v in zip(names.split(), row, strict=True)) + ")" for row in rows)
    return F.expr("array(" + ", ".join(cells) + ")")


def squash(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r" \s+|[\t\n\x0B\f\r]\s*", " "))  # single spaces stay as they are


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def n_words(c: Column) -> Column:
    return F.get(F.transform(F.array(squash(c)), lambda s: F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))), F.lit(0))


def n_chars(c: Column, kind: str) -> Column:
    """Characters of a Unicode class."""
    return F.char_length(F.regexp_replace(c, rf"[^{kind}]+", ""))


def has_email(c: Column) -> Column:
    return c.contains("@") & c.rlike(EMAIL)


def emails(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0))


def phones(c: Column) -> Column:
    """Phone numbers: a plus sign or nine digits tell them from bracketed years."""
    found = F.transform(F.regexp_extract_all(c, F.lit(PHONE), F.lit(0)), lambda x: strip(x))
    told = F.filter(found, lambda x: x.startswith("+") | (F.char_length(F.regexp_replace(x, "[^0-9]", "")) >= 9))
    return F.when(c.rlike(r"[0-9][0-9\s().\-]{7}"), told).when(c.isNotNull(), F.array().cast("array<string>"))


def has_phone(c: Column) -> Column:
    return F.size(phones(c)) > 0


def caps_share(c: Column) -> Column:
    """Upper-case letters among letters; null without a letter."""
    return F.try_divide(n_chars(c, r"\p{Lu}"), n_chars(c, r"\p{L}"))


def heading_shaped(raw: Column) -> Column:
    """A line of up to 100 characters and ten words that ends in a colon or is mostly in capitals, and is no sentence."""
    return let(strip(raw), lambda text: (
        (text != "") & (F.char_length(text) <= 100) & (n_words(normal_heading(text)) <= 10) & ~text.rlike(r"[.!?,;]$")
        & (n_chars(text, r"\p{L}") > 0) & (text.endswith(":") | (F.coalesce(caps_share(text), F.lit(0.0)) >= 0.7))
    ))


def repeated_heading_shaped(raw: Column) -> Column:
    """The stricter shape by which repeats are dropped while text is read: 60 characters, eight words, a colon or capitals."""
    text = strip(raw)
    return (text != "") & (F.char_length(text) <= 60) & (n_words(text) <= 8) & (text.endswith(":") | (F.coalesce(caps_share(text), F.lit(0.0)) >= 0.7))


def normal_heading(line: Column) -> Column:
    """Upper case, dashes alike, no punctuation but comma, slash and dash."""
    dashes = F.replace(F.replace(F.upper(line), F.lit("–"), F.lit("-")), F.lit("—"), F.lit("-"))
    return squash(F.regexp_replace(dashes, r"(?U)[^\w\s,/-]", ""))


def prose(text: Column) -> Column:
    """Ten words or more, no contact data, not mostly in capitals."""
    return (n_words(text) >= 10) & ~has_phone(text) & ~has_email(text) & ~(F.coalesce(caps_share(text), F.lit(0.0)) >= 0.6)


def has_title_word(text: Column) -> Column:
    return text.rlike(TITLE_WORD)


def job_title_shaped(text: Column, heading_key: Column) -> Column:
    t = strip(text)
    return (t != "") & (F.char_length(t) <= 170) & ~t.endswith(":") & heading_key.isNull() & ~t.rlike(r"[.;?!](?:\s|$)")




def person_name(line: Column, heading_key: Column) -> Column:
    """Two or three capitalised or all-capital words that are no heading, organisation, title or contact data."""
    text = strip(line)
    bare = strip(F.regexp_replace(text, HONORIFIC, ""))
    return (
        (text != "") & (F.char_length(text) <= 60) & heading_key.isNull() & ~normal_heading(text).isin(vocab.NEVER_NAMES)
        & ~text.rlike(EMAIL) & ~has_phone(text) & ~text.rlike(r"[0-9:@]") & ~has_title_word(text) & ~text.rlike(ORG_WORD)
        & bare.rlike(P.NAME_LINE) & ((bare == F.upper(bare)) | ~F.exists(F.split(bare, r"\s+"), lambda w: ~w.rlike(r"^\p{Lu}")))
    )


def letter_spaced(line: Column) -> Column:
    """Six single letters or more, and nothing else."""
    return line.rlike(r"^\s*\p{L}(?:\s+\p{L}){5,}\s*$")




def collapsed_name(text: Column, heading_key: Column) -> Column:
    """The one word in capitals that a letter-spaced name leaves when its letters are put together."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(r"^\p{L}{1,40}$") & (t == F.upper(t)) & heading_key.isNull() & ~normal_heading(t).isin(vocab.NEVER_NAMES)


def unspaced_name(line: Column) -> Column:
    """A letter-spaced line put together, without the signs at its end; null for other lines."""
    bare = F.regexp_replace(strip(line), r"(?:\s+[^\p{L}\s])+$", "")
    return F.when(line.rlike(r"^\s*\p{L}\s") & letter_spaced(bare), F.regexp_replace(bare, r"\s+", ""))


def several_headings(line: Column) -> Column:
    """A line that is two or more official headings run together."""
    return normal_heading(line).rlike(SEVERAL)


def _official_names() -> list[str]:
    return [h.replace("–", "-").replace("—", "-") for key, h, _ in vocab.SECTIONS if h and key != "full_name"]


SEVERAL = r"^(?:(?:" + "|".join(sorted(_official_names(), key=len, reverse=True)) + r")\s*){2,}$"


def junk(line: Column) -> Column:
    """Personal details, advertising, placeholders, bare places, dates and links: never content."""
    t = strip(line)
    # one pattern, so that a line's form is computed once
    known = "^(?:" + "|".join(rf"\Q{p}\E" for p in vocab.JUNK_PREFIXES) + ")|" + SEVERAL
    return (
        normal_heading(line).rlike(known) | (let(F.lower(line), lambda x: _any(x, P.VENDOR_SIGNS)) & line.rlike(P.VENDOR)) | line.rlike(P.PLACEHOLDER) | t.rlike(P.CITY_STATE_ZIP) | t.rlike(P.GLUED_ICON) | t.rlike(P.BIRTH_DATE)
        | t.rlike(rf"(?i)^{P.COUNTRY}$") | t.rlike(rf"(?i)^[A-Za-z .]{{2,30}},\s*{P.COUNTRY}$") | t.rlike(P.EMPLOYMENT_TYPE) | letter_spaced(t) | t.rlike(P.BARE_LINK)
    )


def _any(text: Column, signs: list[str]) -> Column:
    out = F.lit(False)
    for s in signs:
        out = out | F.contains(text, F.lit(s))
    return out


def bare_contact(line: Column) -> Column:
    """A contact label, an e-mail address or a phone number, and nothing else."""
    t = strip(F.regexp_replace(strip(line), r"^[|·•,;]+|[|·•,;]+$", ""))
    return (t != "") & (normal_heading(t).isin(vocab.CONTACT_LABELS) | (F.regexp_extract(t, EMAIL, 0) == t) | F.coalesce(F.get(phones(t), F.lit(0)) == t, F.lit(False)))


def title_with_date(line: Column, head_key: Column) -> Column:
    """A job title followed by a date range; ``head_key`` is the heading key of what stands before it."""
    head = before_date(line)
    return line.rlike(YEAR_RANGE) & (head != "") & job_title_shaped(head, head_key) & has_title_word(head)


def before_date(line: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(line, r"(?s)^(.*?)(?:" + YEAR_RANGE.replace("(?i)", "(?i:", 1) + "))", 1), r"^[ ,\-–—]+|[ ,\-–—]+$", "")


def short_caps_label(line: Column) -> Column:
    return n_words(line).between(1, 4) & ~line.rlike("[0-9]") & line.rlike(r"^[A-Z][A-Z '&/-]{1,40}$")


def short_labelled(line: Column) -> Column:
    t = strip(line)
    return n_words(t).between(2, 5) & t.rlike(r"^[A-Za-z][A-Za-z .]{0,24}(?:\s*:\s*[A-Za-z][A-Za-z /]{0,24}|\s*\([A-Za-z][A-Za-z0-9 /,]{0,40}\))$")


def short_dash(line: Column) -> Column:
    t = strip(line)
    return ~t.rlike("[0-9]") & ~t.rlike(r"[.,:;]$") & n_words(t).between(2, 8) & t.rlike(r"^[^-–—:;]{2,40}[-–—][^-–—:;]{2,40}$")




def list_goes_on(line: Column, previous: Column) -> Column:
    """A list that lost its bullets: lines that open with a gerund after a colon or after one another."""
    t, p = strip(line), strip(previous)
    return F.when(t.rlike(P.GERUND), p.rlike(r":\s*$") | p.rlike(P.GERUND)).otherwise(p.rlike(P.GERUND) & t.rlike(r"^\p{Lu}") & ~p.contains("|"))




def bare_affiliation(text: Column, heading_key: Column) -> Column:
    """An organisation and where it is: up to twelve words, no date, no sentence, no contact data."""
    t = strip(text)
    return ~t.rlike(BULLET) & (t != "") & (n_words(t) <= 12) & ~t.rlike(SENTENCE_END) & ~t.rlike(CALENDAR_YEAR) & ~t.rlike(EMAIL) & ~has_phone(t) & t.rlike(ORG_WORD) & heading_key.isNull()


def skill_category(line: Column) -> Column:
    token = r"(?:[A-Z][A-Z0-9/]*|&)"
    label = F.regexp_extract(strip(line), rf"^({token}(?:\s+{token}){{0,4}})\s+(?=\S)", 1)
    return (label != "") & ((n_chars(label, "A-Za-z") >= 6) | (n_words(label) >= 2))




def reportable(line: Column) -> Column:
    """Worth reporting when nothing covers it: long enough, and no decoration, page mark, label or junk."""
    t = strip(line)
    return (F.char_length(t) >= vocab.REPORT_CHARS) & (n_words(t) >= vocab.REPORT_WORDS) & ~t.rlike(P.DECORATION) & ~t.rlike(P.PAGE_MARK) & ~t.rlike(P.LABEL_ONLY) & ~junk(t)


def comparable(text: Column) -> Column:
    """Text as coverage compares it: no leading bullets, one space, lower case."""
    return F.lower(squash(F.regexp_replace(text, r"^[\s•●▪‣⁃*\-–—]+", "")))


# Kinds of roles, by the first pattern that the head of a line has; publication groups by the first word it has.
ROLE_KINDS = [
    (r"\beditor[- ]in[- ]chief\b|\bmanaging editor\b", "Editor-in-Chief"),
    (r"\b(?:associate|guest|section|co-)\s*editor\b", "Editor"),
    (r"\beditorial (?:board|advisory board)\b", "Editorial board member"),
    (r"\beditor\b", "Editor"),
    (r"\bexternal examiner\b", "External examiner"),
    (r"\bexaminer\b", "Examiner"),
    (r"\breviewer\b|\brefere+\b|\bpeer review\b", "Reviewer"),
    (r"\bvisiting (?:professor|fellow|scholar|lecturer|researcher)\b", "Visiting appointment"),
    (r"\b(?:senior |principal |life |honorary )?fellow(?:ship)?\b", "Fellowship"),
    (r"\bchartered\b", "Chartered status"),
    (r"\bmember(?:ship)?\b|\baffiliate\b", "Membership"),
]


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first rule whose pattern, in any case, is found."""
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), value).otherwise(out)
    return out


def role_kind(text: Column) -> Column:
    return first_match(F.substring(text, 1, vocab.ROLE_SPAN), ROLE_KINDS)


def partial_date(value: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as a date; null for anything else."""
    v = strip(value)
    whole = F.when(v.rlike("^[0-9]{4}$"), F.concat(v, F.lit("-01-01"))).when(v.rlike("^[0-9]{4}.[0-9]{2}$"), F.concat(F.substring(v, 1, 4), F.lit("-"), F.substring(v, 6, 2), F.lit("-01"))).when(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), v)
    return whole.try_cast("date")


def band(confidence: Column) -> Column:
    return F.when(confidence >= vocab.HIGH, "high").when(confidence >= vocab.MEDIUM, "medium").otherwise("low")


def expand_short_years(text: Column, as_of_year: int) -> Column:
    """``2025-26`` as ``2025-2026`` and ``1999-02`` as ``1999-2002``; no year after ``as_of_year`` + 5 by wrapping."""
    one = r"\b([0-9]{2})([0-9]{2})\s*([-–—])\s*([0-9]{2})\b"
    century, start, dash, end = (F.regexp_extract(text, one, i) for i in range(1, 5))
    first, last = F.concat(century, start).cast("int"), F.concat(century, end).cast("int")
    wrapped = F.when(last < first, last + 100).otherwise(last)
    fixed = F.when((last < first) & (wrapped > as_of_year + 5), text).otherwise(F.regexp_replace(text, F.lit(one), F.concat(century, start, dash, wrapped.cast("string"))))
    return F.when(text.rlike(one), fixed).otherwise(text)


def slug(name: Column) -> Column:
    """A key of a person's name: no honorific, lower case, runs of others as one dash."""
    bare = F.regexp_replace(strip(name), r"(?i)^(?:dr|prof|professor|mr|mrs|ms|miss)\.?\s+", "")
    return F.regexp_replace(F.regexp_replace(F.lower(bare), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def name_from_email(text: Column) -> Column:
    """A name spelled by the parts of an address: two or more of three letters each, none of them an office."""
    local = F.substring_index(F.regexp_extract(text, EMAIL, 0), "@", 1)
    parts = F.filter(F.split(F.regexp_replace(local, r"(?<=[a-z])(?=[A-Z])", "."), r"[._\-]+"), lambda p: p != "")
    fine = (F.size(parts) >= 2) & ~F.exists(parts, lambda p: ~p.rlike(r"^[A-Za-z]{3,}$") | F.lower(p).isin("info", "admin", "contact", "mail", "hello", "office"))
    return F.when(fine, F.array_join(F.transform(F.slice(parts, 1, 3), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 100)))), " "))
