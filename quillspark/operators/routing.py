"""Routing items by what they say: the earliest role word within a line's head points to a section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import patterns as P
from .. import vocab
from ..functions import text as T
from .review import merged_flags


def route(text: Column, rules: list[tuple[str, str]] = vocab.ROUTES, span: int = vocab.ROLE_SPAN) -> Column:
    """The section of the rule that matches earliest in the first ``span`` characters; of equals, the first rule. Null if none does."""
    head = F.substring(text, 1, span)
    places = [F.struct(F.nullif(F.regexp_instr(head, F.lit(f"(?i){p}")), F.lit(0)).alias("at"), F.lit(i).alias("i"), F.lit(s).alias("section")) for i, (p, s) in enumerate(rules)]
    return F.array_min(F.filter(F.array(*places), lambda x: x["at"].isNotNull()))["section"]




def reroute(items: DataFrame) -> DataFrame:
    """Moves items of inferred sections to the one their words point to; capped in confidence and flagged.

    ``items`` has ``authoritative``: whether the section's heading was an official one; such items stay.
    """
    section, said = F.col("section"), F.col("raw_text")
    by_words = route(said)
    scoped = F.when(section.isin("qualifications", "skills", "language_proficiency") & T.strip(said).rlike(P.ACTION_VERB), "previous_employment").when((section == "skills") & T.strip(said).rlike(P.TRAINING), "qualifications")
    target = F.when(by_words.isNull(), scoped).when((by_words == section) | by_words.isin(vocab.PROTECTED) | section.isin(vocab.PROTECTED), None).otherwise(by_words)
    moved = items.withColumn("__to", F.when(section.isin(vocab.ROUTABLE) & ~F.coalesce(F.col("authoritative"), F.lit(False)), target))
    moves = F.col("__to").isNotNull() & (F.col("__to") != section)
    return moved.withColumns({
        "section": F.when(moves, F.col("__to")).otherwise(section),
        "confidence": F.when(moves, F.least("confidence", F.lit(0.7))).otherwise(F.col("confidence")),
        "flags": F.when(moves, merged_flags(F.col("flags"), F.array(F.lit("rerouted_by_content")))).otherwise(F.col("flags")),
    }).drop("__to")


def disagreements(items: DataFrame) -> DataFrame:
    """Adds a flag that names the section an item's words point to, where that isn't the one it is in; moves nothing."""
    to = route(F.col("raw_text"))
    differs = to.isNotNull() & (to != F.col("section")) & ~F.col("section").isin(vocab.NOT_CROSS_CHECKED)
    return items.withColumn("flags", merged_flags(F.col("flags"), F.array(F.when(differs, F.concat(F.lit("possible_fit_for_"), to)))))
