"""Checks on advice from outside classifiers: what two passes agree on, and whether a proposed split covers its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T

AGREE, DISAGREE, ALONE = 1.10, 0.85, 0.7


def section_key(said: Column) -> Column:
    """The key of a section named by key or label, in any case; null for anything else."""
    known = {}
    for key, _, label in vocab.SECTIONS:
        known.setdefault(key.lower(), key)
        known.setdefault(label.lower(), key)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.lower(T.strip(said)))


def two_passes(rows: DataFrame) -> DataFrame:
    """Adds final_status, final_section and final_confidence to rows of two passes' results.

    The second pass confirms by accepting or by naming the same section. Confidences then multiply;
    agreement with the rules raises the product (to 1 at most), disagreement lowers it. A missing second
    pass leaves the first at a lower confidence; anything else needs a person.
    """
    c1, c2, s1, now = F.col("pass1_conf"), F.col("pass2_conf"), F.col("pass1_section"), F.col("current_section")
    proposed = (F.col("pass1_status") == "CLASSIFY") & s1.isNotNull()
    confirmed = (F.col("pass2_verdict") == "ACCEPT") | (F.col("pass2_verdict") == "CHANGE") & F.col("pass2_section").eqNullSafe(s1)
    both = c1 * c2
    weighed = F.when(now == "unmapped", both).when(s1 == now, F.least(F.lit(1.0), both * AGREE)).otherwise(both * DISAGREE)
    value = F.when(proposed & F.col("pass2_verdict").isNull(), c1 * ALONE).when(proposed & confirmed, weighed)
    return rows.withColumns({
        "final_status": F.when(value.isNotNull(), "CLASSIFY").otherwise("REVIEW_REQUIRED"),
        "final_section": F.when(value.isNotNull(), s1),
        "final_confidence": F.round(F.coalesce(value, F.lit(0.0)), 2),
    })


def covers(original: Column, segments: Column) -> Column:
    """Whether segments, taken in order, stand in the text word for word and leave nothing but punctuation.

    A fold over the segments keeps what is left of the text; what it skips over may hold no letter or digit.
    Two segments at least are a split.
    """
    start = F.struct(T.squash(original).alias("left"), F.lit(True).alias("ok"))

    def step(acc: Column, s: Column) -> Column:
        said = T.squash(s)
        at = F.position(said, acc["left"])
        skipped = F.substring(acc["left"], F.lit(1), at - 1)
        fine = acc["ok"] & (said != "") & (at > 0) & ~skipped.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.when(fine, F.substring(acc["left"], at + F.char_length(said), F.char_length(acc["left"]))).otherwise(acc["left"]).alias("left"), fine.alias("ok"))

    end = F.aggregate(segments, start, step)
    return (F.size(segments) >= 2) & F.coalesce(end["ok"] & ~end["left"].rlike(r"[\p{L}\p{N}]"), F.lit(False))


def classified(said: Column, review: bool = False) -> Column:
    """A classifier's answer in JSON as (status, section, confidence, reasoning), or null if anything about it is wrong.

    A suggestion is CLASSIFY, with a section that is known by key or label, or REVIEW_REQUIRED; with ``review``, a verdict
    on a suggestion: ACCEPT, CHANGE (with a section) or REVIEW_REQUIRED. Confidence lies between 0 and 1, and reasons are given; what almost fits counts as no answer.
    """
    x = F.from_json(said, "status string, verdict string, section string, confidence string, reasoning string")
    kind = x["verdict"] if review else x["status"]
    section = F.when(kind == ("CHANGE" if review else "CLASSIFY"), section_key(x["section"]))
    number = F.when(F.get_json_object(said, "$.confidence").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$") & ~said.rlike(r'"confidence"\s*:\s*"'), x["confidence"].try_cast("double"))
    fine = kind.isin("ACCEPT", "CHANGE", "REVIEW_REQUIRED") if review else kind.isin("CLASSIFY", "REVIEW_REQUIRED")
    fine = fine & ((kind != ("CHANGE" if review else "CLASSIFY")) | section.isNotNull()) & number.between(0, 1) & (T.strip(x["reasoning"]) != "")
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(kind.alias("status"), section.alias("section"), number.alias("confidence"), T.strip(x["reasoning"]).alias("reasoning")))


def knowledge(files: DataFrame) -> DataFrame:
    """(section, description, examples, include, exclude, headings) of ``files(value)``: JSON texts, whole, of what is known of sections; raises if a section that may be proposed has no entry.

    ``headings`` are the official one, then the synonyms.
    """
    kind = "struct<description: string, examples: array<string>, include: array<string>, exclude: array<string>>"
    rows = files.select(F.explode(F.from_json("value", f"sections map<string, {kind}>")["sections"]).alias("section", "x")).select("section", "x.*")
    offered = [key for key, heading, _ in vocab.SECTIONS if heading or key in ("skills", "language_proficiency")]
    wanted = files.sparkSession.createDataFrame([(k,) for k in offered], "section string")
    missing = sorted(r["section"] for r in wanted.join(rows, "section", "left_anti").collect())  # a row for each section at most
    if missing:
        raise ValueError(f"nothing is known of the sections {missing}")
    names = {key: list(dict.fromkeys([*([h] if h else []), *vocab.SYNONYMS.get(key, [])])) for key, h, _ in vocab.SECTIONS}
    headings = files.sparkSession.createDataFrame(list(names.items()), "section string, headings array<string>")
    return rows.join(F.broadcast(headings), "section", "left")  # a row for each section


def prompt_lines(known: DataFrame) -> DataFrame:
    """(section, line): a section as a prompt states it: key, label, description, one example, and what doesn't belong there."""
    labels = F.create_map(*[F.lit(x) for key, _, label in vocab.SECTIONS for x in (key, label)])
    line = F.concat_ws(
        "\n", F.concat(F.lit("- "), "section", F.lit(" ("), F.try_element_at(labels, F.col("section")), F.lit("): "), "description"),
        F.concat(F.lit('    e.g. "'), F.get("examples", F.lit(0)), F.lit('"')), F.concat(F.lit("    NOT: "), F.get("exclude", F.lit(0))),
    )
    return known.select("section", line.alias("line"))


def split_items(items: DataFrame, splits: DataFrame) -> DataFrame:
    """Items with those that ``splits(doc_id, item_ord, segments)`` name replaced by their segments, (text, section) each.

    A split counts only if its segments cover the item's source text as it is now (``covers``) and their sections are known; else the item stays
    untouched. The parts wait for review.
    """
    asked = items.join(splits, ["doc_id", "item_ord"])
    parts = F.transform("segments", lambda s: F.struct(s["text"].alias("text"), section_key(s["section"]).alias("section")))
    sound = asked.withColumn("__parts", parts).where(covers(F.col("raw_text"), F.transform("__parts", lambda p: p["text"])) & ~F.exists("__parts", lambda p: p["section"].isNull()))
    new = sound.select("doc_id", "item_ord", F.posexplode("__parts").alias("__nth", "__p"))
    kind = items.schema["fields"].dataType
    rows = new.select(
        "doc_id", F.xxhash64("item_ord", "__nth").cast(items.schema["item_ord"].dataType).alias("item_ord"), F.col("__p.section").alias("section"), F.create_map().cast(kind).alias("fields"), F.col("__p.text").alias("raw_text"),
        F.lit(0.5).alias("confidence"), F.array(F.lit("ai_segmented")).alias("flags"), F.lit("pending_review").alias("status"), F.array(F.concat(F.lit("split from "), F.col("item_ord").cast("string"))).alias("actions"),
    )
    return items.join(sound.select("doc_id", "item_ord"), ["doc_id", "item_ord"], "left_anti").select(*rows.columns).unionByName(rows)
