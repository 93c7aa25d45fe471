"""Profiles seeded from items, the best qualification, and a biography drafted from facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import patterns as P
from ..functions import text as T



def _value() -> Column:
    return F.nullif(F.trim(F.coalesce(F.nullif(F.col("fields")["value"], F.lit("")), F.col("fields")["title"], F.lit(""))), F.lit(""))


def seed_profiles(items: DataFrame) -> DataFrame:
    """(profile_id, full_name, job_title, email, phone, links, memberships): one row for each document that names its owner. One shuffle."""
    first = lambda s: F.min_by(F.when(F.col("section") == s, _value()), F.when(F.col("section") == s, F.col("item_ord")))
    platform = F.replace(F.lower(F.trim(F.coalesce(F.col("fields")["platform"], F.lit("")))), F.lit(" "), F.lit("_"))
    url = F.trim(F.coalesce(F.col("fields")["url"], F.lit("")))
    link = F.when((F.col("section") == "profiles_links") & (platform != "") & (url != ""), F.struct(platform.alias("key"), F.col("item_ord"), url.alias("value")))
    member = F.when(F.col("section") == "associations", F.struct("item_ord", F.trim(F.coalesce(F.col("fields")["description"], F.col("raw_text"))).alias("v")))
    found = items.groupBy("doc_id").agg(first("full_name").alias("full_name"), first("job_title").alias("job_title"), first("email").alias("email"), first("contact_info").alias("phone"), F.array_sort(F.collect_list(link)).alias("__l"), F.array_sort(F.collect_list(member)).alias("__m"))
    last = F.map_from_entries(F.transform(F.filter("__l", lambda x, i: ~F.exists(F.slice("__l", i + 2, F.size("__l")), lambda y: y["key"] == x["key"])), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))
    return found.where("full_name is not null").select(T.slug(F.col("full_name")).alias("profile_id"), "full_name", "job_title", "email", "phone", last.alias("links"), F.transform("__m", lambda x: x["v"]).alias("memberships"))


def article(noun: Column) -> Column:
    """A noun with the article that is spoken before it."""
    return F.concat(F.when(noun.rlike(P.SPOKEN_VOWEL), "an ").otherwise("a "), noun)


def degrees(items: DataFrame) -> DataFrame:
    """(doc_id, degrees): every distinct degree of a document in item order, whatever its case, with the institution of the same item."""
    degree, place = (F.nullif(F.trim(F.coalesce(F.col("fields")[k], F.lit(""))), F.lit("")) for k in ("degree", "institution"))
    rows = items.where(F.col("section") == "qualifications").select("doc_id", "item_ord", degree.alias("degree"), place.alias("place")).where("degree is not null")
    once = rows.groupBy("doc_id", F.lower("degree").alias("key")).agg(F.min(F.struct("item_ord", "degree", "place")).alias("x"))
    worded = F.when(F.col("x.place").isNull(), F.col("x.degree")).otherwise(F.concat(F.col("x.degree"), F.lit(" from "), F.col("x.place")))
    return once.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("x.item_ord", worded.alias("said")))), lambda x: x["said"]).alias("degrees"))


def enumerated(phrases: Column) -> Column:
    """Phrases with their articles, as a sentence lists them."""
    worded = F.transform(phrases, article)
    n = F.size(worded)
    return F.when(n <= 2, F.array_join(worded, " and ")).otherwise(F.concat(F.array_join(F.slice(worded, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(worded, -1)))


def short_name(name: Column) -> Column:
    """What a second sentence calls a person: honorific and last word, or the first word."""
    lead = F.regexp_extract(name, r"(?i)^((?:dr|prof|professor|mr|mrs|ms|miss)\.?)\s+", 1)
    return F.when(lead != "", F.concat(lead, F.lit(" "), F.element_at(F.split(F.trim(name), r"\s+"), -1))).otherwise(F.get(F.split(F.trim(name), r"\s+"), F.lit(0)))


def biographies(items: DataFrame, this_year: int) -> DataFrame:
    """(doc_id, text) drafted for documents without a biography, from two facts or more: title, degrees or best qualification, years at work, counts.

    Structured degrees count as the qualification before a text with the words of one, that isn't the owner's name. Nothing is said of
    a person but what items say; drafts always wait for review.
    """
    first = lambda s, v: F.min_by(F.when(F.col("section") == s, v), F.when((F.col("section") == s) & v.isNotNull(), F.col("item_ord")))
    told = F.when((F.col("section") == "qualifications") & F.col("raw_text").rlike("(?i)" + "|".join(P.QUALIFICATION_WORDS)), F.col("raw_text"))
    start = F.when(F.col("section").isin("present_employment", "previous_employment"), F.col("fields")["start_date"].try_cast("int"))
    per = items.groupBy("doc_id").agg(
        first("full_name", _value()).alias("name"), first("job_title", _value()).alias("title"), first("qualifications", told).alias("told"),
        F.min(start).alias("since"), F.count_if(F.col("section") == "publications").alias("papers"), F.count_if(F.col("section") == "awards").alias("prizes"), F.count_if(F.col("section") == "biography").alias("has"),
    )
    per = per.join(degrees(items), "doc_id", "left")
    years = F.lit(this_year) - F.col("since")
    facts = F.array_compact(F.array(
        F.when(F.col("title").isNotNull(), F.concat(F.lit("works as "), article(F.col("title")))),
        F.when(F.size("degrees") > 0, F.concat(F.lit("holds "), enumerated(F.col("degrees")))).when(F.lower("told") != F.lower("name"), F.concat(F.lit("holds "), article(F.col("told")))),
        F.when(years >= 2, F.concat(F.lit("has worked for "), years.cast("string"), F.lit(" years"))),
        F.when(F.col("papers") >= 2, F.concat(F.lit("lists "), F.col("papers").cast("string"), F.lit(" publications"))),
        F.when(F.col("prizes") >= 2, F.concat(F.lit("lists "), F.col("prizes").cast("string"), F.lit(" awards"))),
    ))
    drafted = per.where((F.col("has") == 0) & F.col("name").isNotNull()).withColumn("facts", facts).where(F.size("facts") >= 2)
    rest = F.slice("facts", F.lit(3), F.greatest(F.size("facts") - 2, F.lit(0)))
    more = F.when(F.size("facts") > 2, F.concat(F.lit(" "), short_name(F.col("name")), F.lit(" "), F.array_join(rest, " and "), F.lit("."))).otherwise("")
    return drafted.select("doc_id", F.concat(F.col("name"), F.lit(" "), F.array_join(F.slice("facts", 1, 2), " and "), F.lit("."), more).alias("text"))


DRAFT_NOTE = "(draft of facts from this document; to be read and edited)"


def biography_items(items: DataFrame, this_year: int, write=None) -> DataFrame:
    """Drafted biographies as items that always wait for a person: low, flagged, the text as their line.

    ``write(drafts)`` may put other words to ``drafts(doc_id, text)``, as a language model would; where it gives none, the draft stays.
    """
    drafts = biographies(items, this_year)
    if write is not None:
        drafts = drafts.join(write(drafts).select("doc_id", F.col("text").alias("__t")), "doc_id", "left").select("doc_id", F.coalesce(F.nullif(F.trim("__t"), F.lit("")), "text").alias("text"))
    return drafts.select(
        "doc_id", F.lit(1 << 42).cast("long").alias("item_ord"), F.lit("biography").alias("section"), F.create_map(F.lit("_line_override"), F.col("text")).alias("fields"),
        F.concat(F.col("text"), F.lit("  " + DRAFT_NOTE)).alias("raw_text"), F.lit(0.5).alias("confidence"), F.array(F.lit("drafted_not_extracted")).alias("flags"), F.lit("pending_review").alias("status"), F.array(F.lit("biography_drafted")).alias("actions"),
    )


def saved_profiles(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """``profiles(profile_id, ...)`` with the ``doc_id`` of each document whose owner's name is the key of one."""
    names = items.where("section = 'full_name'").groupBy("doc_id").agg(F.min_by(T.slug(_value()), "item_ord").alias("profile_id")).where("profile_id <> ''")
    return names.join(profiles, "profile_id")


def best_photo(photos: DataFrame) -> DataFrame:
    """(doc_id, photo_id) of ``photos(doc_id, photo_id, digest, width, height)``: the largest that occurs once and has the shape of a portrait."""
    ratio = F.col("width") / F.col("height")
    once = photos.groupBy("doc_id", "digest").agg(F.count("*").alias("n"), F.min_by(F.struct("photo_id", "width", "height"), "photo_id").alias("x")).where("n = 1").select("doc_id", "x.*")
    return once.where(ratio.between(0.55, 1.6)).groupBy("doc_id").agg(F.max_by("photo_id", F.struct(F.col("width") * F.col("height"), -F.col("photo_id"))).alias("photo_id"))
