"""Letterheads: e-mail, phone, name and title of a document's owner, from the lines around the contact data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import patterns as P
from ..functions import text as T
from ..plans.stage import staged
from .headings import resolve

WINDOW = 6
#: The longest line that ``person_name`` takes for a name; letter-spaced names are shorter.
NAME_CHARS = 60


def pieces(line: Column) -> Column:
    """What of a line may be a field of its own: the line, what lies between bars, contact labels or wide gaps, and what stands before an address or a number."""
    before = F.get(F.transform(F.array(F.get(T.phones(line), F.lit(0))), lambda x: F.when(F.position(x, line) > 1, F.substring(line, F.lit(1), F.position(x, line) - 1))), F.lit(0))
    parts = F.concat(
        F.array(T.strip(line)), F.split(line, r"\s*[|•·]\s*"), F.when(line.rlike(P.CONTACT_SIGN), F.split(line, P.CONTACT_LABEL)).otherwise(F.array(line)),
        F.array(F.when(line.contains("@"), F.regexp_extract(line, rf"^(.*?){T.EMAIL}", 1)), before),
        F.split(line, r"\s{3,}|\t"),
    )
    return F.filter(F.array_distinct(F.transform(F.array_distinct(F.array_compact(parts)), lambda s: T.squash(s))), lambda s: s != "")


def names_in_files(docs: DataFrame) -> DataFrame:
    """(doc_id, name) of ``docs(doc_id, text, document)``: the name that the file is called by, as the text writes it.

    Words of the file name but noise, dates and numbers are looked for in their order; a find is two to four words on one line.
    """
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("document", r"^.*[/\\]", ""), r"\.[^.]*$", ""), r"\(.*?\)", " "), r"[._\-]+", " ")
    words = F.filter(F.split(stem, r"\s+"), lambda w: (F.char_length(w) >= 3) & ~F.lower(w).isin(P.FILE_NOISE) & ~w.rlike("[0-9]") & ~w.rlike(P.MONTH_PREFIX))
    asked = docs.where("document is not null").select("doc_id", "text", F.posexplode(words).alias("nth", "word"))
    pattern = F.concat(F.lit(r"\b((?:(?:Dr|Prof|Professor|Mr|Mrs|Ms|Miss)\.?[^\S\n]+)?(?i:\Q"), F.col("word"), F.lit(r"\E)(?:[^\S\n]+[A-Z][A-Za-z.'\-]*){1,3})"))
    found = asked.select("doc_id", "nth", T.squash(F.call_function("regexp_extract", F.col("text"), pattern, F.lit(1))).alias("name"))
    found = resolve(found.where((F.col("name") != "") & (F.char_length("name") <= 60)), "name", approximate=False)
    return found.where(F.col("heading_key").isNull() & ~T.has_title_word(F.col("name"))).groupBy("doc_id").agg(F.min_by("name", "nth").alias("name"))


def letterhead(lines: DataFrame, preamble: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(doc_id, section, value, source, confidence) of ``lines(doc_id, line_no, line)``: at most one of each section.

    The first e-mail and the first phone are anchors; lines up to six away from one are candidates, then those of
    ``preamble(doc_id, ord, line)``: page headers, longest first, and what stands above the first heading. A name that the file
    is called by (``files(doc_id, name)``) counts first, then one that stands in the document twice, then one known by its shape alone;
    a shape that disagrees with the address gives way to the name the address spells. A letter-spaced name counts put together.
    """
    text = F.col("line")
    email = F.when(text.contains("@"), F.nullif(F.regexp_extract(text, T.EMAIL, 0), F.lit("")))
    found = T.settled(lines.select("doc_id", "line_no", "line"), email=email, phone=F.get(T.phones(text), F.lit(0)))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("line_no", c, "line")))
    anchors = staged(found.where("email is not null or phone is not null").groupBy("doc_id").agg(first("email").alias("e"), first("phone").alias("p")))
    within = lambda a: F.coalesce(F.abs(F.col("line_no") - F.col(f"{a}.line_no")) <= WINDOW, F.lit(False))
    tiers = F.filter(F.array(F.when(within("e"), 0), F.when(within("p"), 1)), lambda t: t.isNotNull())
    near = staged(lines.join(anchors, "doc_id").select("doc_id", F.explode(tiers).alias("tier"), F.col("line_no").cast("long").alias("ord"), "line"))
    above = lines.sparkSession.createDataFrame([], near.schema) if preamble is None else preamble.select("doc_id", F.lit(2).alias("tier"), F.col("ord").cast("long").alias("ord"), "line")
    offered = near.unionByName(above)
    joined = T.unspaced_name(text)
    candidates = offered.select("doc_id", "tier", "ord", F.col("line").alias("source"), F.posexplode(F.concat(F.transform(pieces(text), lambda s: F.struct(s.alias("line"), F.lit(False).alias("spaced"))), F.filter(F.array(F.struct(joined.alias("line"), F.lit(True).alias("spaced"))), lambda x: x["line"].isNotNull()))).alias("pos", "x"))
    # a name has 60 characters at most; longer pieces are kept for the number they hold
    number = F.when(text.rlike("(?i)^contact"), F.nullif(T.strip(F.regexp_replace(text, P.CONTACT_LEAD, "")), F.lit(""))).when(~text.rlike("(?i)job title"), F.get(T.phones(text), F.lit(0)))
    candidates = T.settled(candidates.select("doc_id", "tier", "ord", "pos", "source", "x.line", "x.spaced"), number=number, short=F.char_length(T.strip(text)) <= NAME_CHARS)
    candidates = staged(candidates.where("short or number is not null"))
    key = F.col("heading_key")
    named = resolve(candidates.where("short"), approximate=False).where(T.person_name(text, key) | (F.col("spaced") & T.collapsed_name(text, key)))
    named = staged(named.select("doc_id", "tier", "ord", "pos", "source", "line"))
    short = T.settled(lines.select("doc_id", "line"), line=T.strip(text)).where(F.char_length("line") <= NAME_CHARS)
    repeats = short.groupBy("doc_id", "line").agg(F.count("*").alias("repeats"))
    plain = T.settled(above.select("doc_id", "line"), line=T.squash(text)).where(F.char_length("line") <= NAME_CHARS).distinct().withColumn("__above", F.lit(True))
    named = named.join(repeats, ["doc_id", "line"], "left").join(plain, ["doc_id", "line"], "left").withColumn("twice", F.coalesce(F.col("repeats") >= 2, F.lit(False)))
    shape = F.struct("line", "source", "twice", F.coalesce("__above", F.lit(False)).alias("above"))
    best = named.groupBy("doc_id").agg(F.min_by(shape, F.struct(~F.col("twice"), "tier", "ord", "pos")).alias("shape"))
    numbers = candidates.where("number is not null").groupBy("doc_id").agg(F.min_by("number", F.struct("tier", "ord", "pos")).alias("number"))
    whole = anchors.join(best, "doc_id", "full").join(numbers, "doc_id", "full").withColumn("spelled", T.name_from_email(F.col("e.email")))
    whole = whole.withColumn("filed", F.lit(None).cast("string")) if files is None else whole.join(files.withColumnRenamed("name", "filed"), "doc_id", "full")
    words = lambda c: F.filter(F.split(F.lower(c), r"[\s.,]+"), lambda w: F.char_length(w) >= 3)
    agrees = F.col("spelled").isNull() | F.arrays_overlap(words(F.col("shape.line")), words(F.col("spelled")))
    spelled = F.col("filed").isNull() & F.col("spelled").isNotNull() & (F.col("shape").isNull() | ~(F.col("shape.twice") | agrees))
    sure = F.when(F.col("filed").isNotNull(), 0.9).when(spelled, 0.7).when(F.col("shape.twice"), 0.85).when(F.col("shape.above"), 0.75).otherwise(0.8)
    name = F.when(spelled, F.col("spelled")).otherwise(F.coalesce("filed", "shape.line"))
    source = F.when(spelled, T.strip(F.col("e.line"))).when(F.col("filed").isNotNull(), F.col("filed")).otherwise(F.coalesce(F.when(F.col("shape.line") == F.upper("shape.line"), T.strip(F.col("shape.source"))), "shape.line"))
    source = F.when(F.contains(source, name), name).otherwise(source)
    whole = whole.withColumns({"name": name, "name_source": source, "sure": sure})
    bare = T.strip(F.regexp_replace(text, T.BULLET, ""))
    titled = resolve(near.join(whole.select("doc_id", "name"), "doc_id", "left").withColumn("line", bare), approximate=False)
    rest = T.strip(F.regexp_replace(F.substring(text, F.char_length("name") + 1, F.char_length(text)), r"^[ ,:\-–—]+", ""))
    said = F.when(F.startswith(F.lower(text), F.lower("name")) & (rest != ""), rest).otherwise(text)
    labelled = F.nullif(T.strip(F.regexp_replace(said, P.TITLE_LABEL, "")), F.lit(""))
    title = F.when(said.rlike("(?i)^job title"), labelled).when(~said.eqNullSafe(F.col("name")) & T.has_title_word(said) & ~said.rlike(T.EMAIL) & T.job_title_shaped(said, key), said)
    titles = titled.withColumn("title", title).where("title is not null").groupBy("doc_id").agg(F.min_by("title", F.struct("tier", "ord")).alias("title"))
    whole = whole.join(titles, "doc_id", "left")
    row = lambda section, value, source, confidence: F.struct(F.lit(section).alias("section"), value.alias("value"), F.coalesce(source, value).alias("source"), confidence.alias("confidence"))
    out = F.array(
        row("email", F.col("e.email"), T.strip(F.col("e.line")), F.lit(0.95)),
        row("full_name", F.col("name"), F.col("name_source"), F.col("sure")),
        row("job_title", F.col("title"), F.col("title"), F.lit(0.7)),
        row("contact_info", F.col("number"), F.col("number"), F.lit(0.75)),
    )
    return whole.select("doc_id", F.inline(out)).where("value is not null")


def biography(preamble: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, text): the first line of prose above the first heading that the letterhead doesn't hold, with its label or without."""
    used = heads.groupBy("doc_id").agg(F.collect_set(T.strip(F.col("source"))).alias("used"))
    text = F.col("__text")
    bare = T.strip(F.regexp_replace(text, P.LETTERHEAD_LABEL, ""))
    told = T.settled(preamble, __text=T.strip(F.col("line")))
    rows = T.settled(told, __prose=T.prose(text)).where("__prose").join(used, "doc_id", "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>")))
    rows = rows.where(~F.array_contains("used", text) & ~((bare != text) & F.array_contains("used", bare)))
    return rows.groupBy("doc_id").agg(F.min_by(text, "ord").alias("text"))
