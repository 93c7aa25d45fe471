"""Passes that move, merge or drop items by what they say, each a window or a join per document; in the order in which a flow applies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import patterns as P
from .. import vocab
from ..functions import text as T
from .fields import DEGREE, employment_line, qualification
from .review import merged_flags

LETTERHEAD = ["full_name", "job_title", "contact_info", "email"]


def _moved(items: DataFrame, where: Column, section: Column, most: float, flag: str) -> DataFrame:
    """Items with the section, the cap on confidence and the flag set where ``where`` holds."""
    return items.withColumns({
        "section": F.when(where, section).otherwise(F.col("section")),
        "confidence": F.when(where, F.least("confidence", F.lit(most))).otherwise(F.col("confidence")),
        "flags": F.when(where, merged_flags(F.col("flags"), F.array(F.lit(flag)))).otherwise(F.col("flags")),
    })


def drop_name_echoes(items: DataFrame) -> DataFrame:
    """Items outside the letterhead that are nothing but the owner's name, with or without an honorific, go."""
    names = items.where("section = 'full_name'").groupBy("doc_id").agg(F.min_by(F.lower(T.squash(F.col("fields")["value"])), "item_ord").alias("__name"))
    joined = items.join(names, "doc_id", "left")
    said = F.regexp_replace(F.lower(T.squash(F.col("raw_text"))), r"^[ ,.;:\-]+|[ ,.;:\-]+$", "")
    echo = (said == F.col("__name")) | (said == F.trim(F.regexp_replace("__name", r"(?i)^(?:dr|prof|professor|mr|mrs|ms|miss|sir|dame)\.?\s+", "")))
    return joined.where(F.col("section").isin(LETTERHEAD) | ~F.coalesce(echo & (F.col("__name") != ""), F.lit(False))).select(*items.columns)




def untangle(items: DataFrame) -> DataFrame:
    """Skills and awards that hold a degree become qualifications; those that open like a job entry become employment."""
    c = F.col("raw_text")
    mixed = F.col("section").isin("skills", "awards")
    degree, job = mixed & c.rlike(DEGREE), mixed & ~c.rlike(DEGREE) & c.rlike(P.JOB_HEADER)
    part = lambda i: F.trim(F.regexp_extract(c, P.JOB_HEADER, i))
    on = F.lower(part(6)).isin("present", "present time", "current")
    rest = F.regexp_replace(F.regexp_replace(c, P.JOB_HEADER, ""), r"^[ ,\-–—]+|[ ,\-–—]+$", "")
    end = F.when(on, "").otherwise(part(6))
    line = employment_line(part(1), part(2), part(5), end, on)
    as_job = F.map_filter(F.create_map(F.lit("title"), part(1), F.lit("unit"), F.when(on, part(2)), F.lit("employer"), F.when(~on, part(2)), F.lit("start_date"), part(5), F.lit("end_date"), end, F.lit("is_current"), F.when(on, "true"), F.lit("_line_override"), F.when(rest != "", F.concat_ws("\n", line, rest))), lambda k, v: v.isNotNull())
    names = ["degree", "subject", "institution", "country", "year"]
    parsed = qualification(items, "raw_text")
    as_degree = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda k, v: v.isNotNull())
    found = parsed.withColumn("__target", F.when(degree, "qualifications").when(job, F.when(on, "present_employment").otherwise("previous_employment")))
    found = found.withColumn("fields", F.when(degree, as_degree).when(job, as_job).otherwise(F.col("fields")))
    return _moved(found, F.col("__target").isNotNull(), F.col("__target"), 0.7, "rerouted_by_content").select(*items.columns)




def without_home(items: DataFrame) -> DataFrame:
    """Items that no section is for become unmapped: single facts, and blocks under a media label until a citation or another section.

    A block is an island: items of one section after a label, up to the first that looks like a citation.
    """
    head = T.squash(F.substring("raw_text", 1, 40))
    w = Window.partitionBy("doc_id").orderBy("item_ord")
    letter = F.col("section").isin([*LETTERHEAD, "profiles_links"])
    label, fact = head.rlike(P.MEDIA_BLOCK) & ~letter, head.rlike(P.ONE_FACT) & ~letter
    stops = letter | fact | F.col("raw_text").rlike(P.CITATION) | ~F.coalesce(F.col("section") == F.lag("section").over(w), F.lit(False))
    rows = items.withColumns({"__label": label, "__fact": fact, "__cut": (stops & ~label) | label})
    rows = rows.withColumn("__island", F.sum(F.col("__cut").cast("int")).over(w))
    first = F.first("__label").over(Window.partitionBy("doc_id", "__island").orderBy("item_ord").rowsBetween(Window.unboundedPreceding, 0))
    lost = F.col("__fact") | first
    rows = rows.withColumn("__lost", lost)
    rows = rows.withColumn("fields", F.when(F.col("__lost"), F.create_map(F.lit("value"), F.col("raw_text"), F.lit("context"), F.lit(vocab.NO_HOME))).otherwise(F.col("fields")))
    return _moved(rows, F.col("__lost"), F.lit("unmapped"), 0.5, "no_home_heading").select(*items.columns)


def promote_present(items: DataFrame) -> DataFrame:
    """The present role as the job title: from present employment, else an ongoing entry of previous employment, else a line that says so.

    Candidates of three tiers are ranked per document; the first decides. Several present roles beside a
    title already found are ambiguous, and change nothing.
    """
    c, title = F.col("raw_text"), F.nullif(F.trim(F.coalesce(F.col("fields")["title"], F.lit(""))), F.lit(""))
    role = F.coalesce(F.nullif(F.trim(F.get(F.split(c, r"\s*[|•·]\s*"), F.lit(0))), F.lit("")), F.trim(c))
    ongoing = (F.lower(F.col("fields")["is_current"]) == "true") & c.rlike(T.PRESENT)
    free = c.rlike(T.PRESENT) & T.has_title_word(role) & T.job_title_shaped(role, F.lit(None).cast("string"))
    tier = F.when(F.col("section") == "present_employment", 1).when((F.col("section") == "previous_employment") & title.isNotNull() & ongoing, 2).when(free, 3)
    ranked = items.withColumn("__tier", tier).withColumn("__role", F.when(tier == 3, role).otherwise(title))
    per = ranked.groupBy("doc_id").agg(
        F.min_by(F.struct("__tier", "item_ord", "__role", "raw_text"), F.when(F.col("__tier").isNotNull(), F.struct("__tier", "item_ord"))).alias("__won"),
        F.count_if((F.col("section") == "present_employment") & title.isNotNull()).alias("__roles"), F.count_if(F.col("section") == "job_title").alias("__titles"),
    )
    decided = per.where(F.col("__won.__role").isNotNull() & ~((F.col("__won.__tier") == 1) & (F.col("__roles") > 1) & (F.col("__titles") > 0))).select("doc_id", "__won")
    joined = items.join(decided, "doc_id", "left")
    kept = joined.where(F.col("__won").isNull() | (F.col("section") != "job_title"))
    second = (F.col("__won.__tier") == 2) & (F.col("__won.item_ord") == F.col("item_ord"))
    unit = F.map_from_entries(F.transform(F.map_entries("fields"), lambda e: F.struct(F.when(e["key"] == "employer", "unit").otherwise(e["key"]).alias("key"), e["value"].alias("value"))))
    kept = kept.withColumns({"section": F.when(second, "present_employment").otherwise(F.col("section")), "fields": F.when(second, unit).otherwise(F.col("fields"))})
    none = F.array().cast("array<string>")
    new = decided.select("doc_id", F.inline(F.filter(F.array(
        F.struct(F.lit("job_title").alias("section"), F.create_map(F.lit("value"), F.col("__won.__role")).alias("fields"), F.lit(0.7).alias("confidence"), F.lit(True).alias("make")),
        F.struct(F.lit("present_employment").alias("section"), F.create_map(F.lit("title"), F.col("__won.__role"), F.lit("end_date"), F.lit("")).alias("fields"), F.lit(0.6).alias("confidence"), (F.col("__won.__tier") == 3).alias("make")),
    ), lambda x: x["make"])), F.col("__won.raw_text").alias("raw_text"), F.col("__won.item_ord").alias("__from"))
    new = new.withColumns({"item_ord": F.xxhash64("section", "__from").cast(items.schema["item_ord"].dataType), "flags": none, "status": F.lit("pending_review"), "actions": none})
    return kept.select(*items.columns).unionByName(new.select(*items.columns))




def clean_titles(items: DataFrame) -> DataFrame:
    """Job titles without a trailing institution, and two titles in one as two lines."""
    value = F.coalesce(F.col("fields")["value"], F.lit(""))
    first = F.coalesce(F.nullif(F.trim(F.get(F.split(value, r"\s*[|•·]\s*"), F.lit(0))), F.lit("")), value)
    bare = lambda c: F.trim(F.regexp_replace(c, P.TAIL_INSTITUTION, ""))
    two = first.rlike(P.SECOND_TITLE)
    head, tail = bare(F.regexp_replace(F.regexp_replace(first, P.SECOND_TITLE, ""), "[ ,]+$", "")), bare(F.regexp_extract(first, P.SECOND_TITLE, 1))
    here = (F.col("section") == "job_title") & ~value.contains("\n")
    split, cut = here & two & (head != "") & (tail != ""), here & ~two & (bare(first) != "") & (bare(first) != value)
    new = F.when(split, F.concat_ws("\n", head, tail)).when(cut, bare(first))
    flagged = F.when(split, "multi_title_split").when(cut & (bare(first) != first), "institution_stripped_from_title")
    return items.withColumns({
        "fields": F.when(new.isNotNull(), F.map_concat(F.map_filter("fields", lambda k, v: k != "value"), F.create_map(F.lit("value"), new))).otherwise(F.col("fields")),
        "confidence": F.when(flagged.isNotNull(), F.least("confidence", F.lit(0.65))).otherwise(F.col("confidence")),
        "flags": F.when(flagged.isNotNull(), merged_flags(F.col("flags"), F.array(flagged))).otherwise(F.col("flags")),
    })


def guess_title(items: DataFrame) -> DataFrame:
    """A job title for documents without one, from the first employment entry whose text has a title word, present before previous."""
    words = "|".join(vocab.TITLE_WORDS)
    segment = F.get(F.filter(F.split("raw_text", ","), lambda s: s.rlike(T.TITLE_WORD)), F.lit(0))
    guess = F.trim(F.get(F.split(F.regexp_replace(segment, "^[ .]+|[ .]+$", ""), r"[.\n]"), F.lit(0)))
    jobs = items.where(F.col("section").isin("present_employment", "previous_employment") & F.col("raw_text").rlike(rf"(?i)\b(?:{words})\b")).withColumn("__g", F.when(F.char_length(guess).between(1, 60), guess))
    lacking = jobs.where("__g is not null").join(items.where("section = 'job_title'").select("doc_id").distinct(), "doc_id", "left_anti")
    best = lacking.groupBy("doc_id").agg(F.min_by(F.struct("__g", "raw_text", "item_ord"), F.struct(F.col("section") != "present_employment", F.col("item_ord"))).alias("x"))
    none = F.array().cast("array<string>")
    new = best.select("doc_id", F.xxhash64(F.lit("guess"), "x.item_ord").cast(items.schema["item_ord"].dataType).alias("item_ord"), F.lit("job_title").alias("section"), F.create_map(F.lit("value"), F.col("x.__g")).alias("fields"), F.col("x.raw_text").alias("raw_text"), F.lit(0.5).alias("confidence"), none.alias("flags"), F.lit("pending_review").alias("status"), none.alias("actions"))
    return items.unionByName(new.select(*items.columns))


def attach_details(items: DataFrame) -> DataFrame:
    """Grade and thesis lines of qualifications go to the entry before them."""
    detail = (F.col("section") == "qualifications") & F.trim("raw_text").rlike(r"(?i)^(?:(?:GPA|CGPA)\s*:?\s*[0-9.]+(?:\s*/\s*[0-9.]+)?\.?$|thesis(?:\s+title)?\s*:|supervised\s+by\b)")
    w = Window.partitionBy("doc_id").orderBy("item_ord")
    rows = items.withColumn("__detail", detail & (F.lag("section").over(w) == "qualifications"))
    rows = rows.withColumn("__island", F.sum(F.when(F.coalesce("__detail", F.lit(False)), 0).otherwise(1)).over(w))
    rest = [c for c in items.columns if c not in ("doc_id", "item_ord", "raw_text")]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_ord", "raw_text"))), lambda x: x["raw_text"]), " ")
    merged = rows.groupBy("doc_id", "__island").agg(F.min("item_ord").alias("item_ord"), joined.alias("raw_text"), *[F.min_by(c, "item_ord").alias(c) for c in rest])
    return merged.select(*items.columns)
