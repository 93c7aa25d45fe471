"""Employment sections: zones of practice among jobs, titles and employers on neighbouring lines, and what carries forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import patterns as P
from ..functions import text as T
from .headings import resolve

# What publications of a group are called, in the order in which names are tried.
GROUPS = [("upcoming|forthcoming|in preparation|submitted", "forthcoming"), ("conference|presentation|symposium|panel", "conference"), ("blog|media|report|online|industry|government", "industry_government"), ("journal|peer-review|peer review", "journal"), ("book chapter|chapters|books", "book_chapter")]


def zones(lines: DataFrame) -> DataFrame:
    """Adds ``zone`` to ``lines(doc_id, section, line_no, line)`` of employment sections: a label opens a zone of practice, a
    dated line before a bare title goes back to jobs. The last such event carries forward."""
    w = Window.partitionBy("doc_id", "section").orderBy("line_no")
    following = F.coalesce(T.strip(F.lead("line").over(w)), F.lit(""))
    back = F.col("line").rlike(T.YEAR_RANGE) & following.rlike(P.BARE_TITLE) & T.has_title_word(following)
    event = F.when(T.strip(F.col("line")).rlike(P.PRACTICE), "knowledge_exchange").when(back, "employment")
    rows = lines.withColumn("__event", event)
    return rows.withColumn("zone", F.coalesce(F.last("__event", ignorenulls=True).over(w), F.lit("employment"))).drop("__event")


def paired(items: DataFrame) -> DataFrame:
    """Adds title, employer, start_date, end_date, is_current where a bare title stands before a line of employer, place and
    date; the two become one item. An employer line is never a bare title, so pairs don't overlap."""
    w = Window.partitionBy("doc_id", "section").orderBy("item_no")
    text, following, before = T.strip(F.col("text")), T.strip(F.lead("text").over(w)), T.strip(F.lag("text").over(w))
    title = lambda c: c.rlike(P.BARE_TITLE) & T.has_title_word(c) & ~c.rlike(r"[.;?!](?:\s|$)")
    rows = items.withColumns({"__opens": F.coalesce(title(text) & following.rlike(P.EMPLOYER_LINE), F.lit(False)), "__taken": F.coalesce(text.rlike(P.EMPLOYER_LINE) & title(before), F.lit(False)), "__next": following})
    part = lambda i: F.when(F.col("__opens"), F.trim(F.regexp_extract("__next", P.EMPLOYER_LINE, i)))
    on = F.lower(part(5)).isin("present", "present time", "current")
    rows = rows.withColumns({"title": F.when(F.col("__opens"), text), "employer": part(1), "start_date": part(4), "end_date": F.when(on, "").otherwise(part(5)), "is_current": F.when(F.col("__opens"), on), "text": F.when(F.col("__opens"), F.concat_ws(" ", text, "__next")).otherwise(F.col("text"))})
    return rows.where(~F.col("__taken")).drop("__opens", "__taken", "__next")


def inherited(items: DataFrame) -> DataFrame:
    """Adds ``target`` to items of generic employment: present where an entry goes on, previous where it ended; items without a
    date have that of the entry before."""
    w = Window.partitionBy("doc_id", "section").orderBy("item_no")
    own = F.when(F.col("start_date").isNotNull(), F.when(F.col("is_current"), "present_employment").otherwise("previous_employment"))
    carried = F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit("previous_employment"))
    return items.withColumn("target", F.when(F.col("section") == "_generic_employment", carried).otherwise(F.col("section")))


def subgroups(items: DataFrame) -> DataFrame:
    """Adds ``subgroup`` to publications from the sub-heading above, which goes; a sub-heading of no group leaves the last one."""
    keyed = resolve(items, "text", out="__key", approximate=False)
    label = (F.col("section") == "publications") & F.col("__key").eqNullSafe(F.lit("publications"))
    named = F.when(label, T.first_match(F.col("text"), [(f"(?:{p})", v) for p, v in GROUPS]))
    w = Window.partitionBy("doc_id", "section").orderBy("item_no")
    rows = keyed.withColumns({"__label": label, "subgroup": F.when(F.col("section") == "publications", F.last(named, ignorenulls=True).over(w))})
    return rows.where(~F.col("__label")).drop("__label", "__key")
