"""What must hold of any collection of structured documents; a row for each breach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reconcile, render, rewrites

LEAST_ITEMS = 5


def breaches(items: DataFrame, docs: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """(rule, doc_id) of documents with text that break a rule.

    Enough items; a name that reads like one; a well-formed address; no item that is only a date; no echo
    of the name; no employment that is only dates; links with a scheme; degrees that stand in their text;
    years that stand in their text; every body text verbatim in its document; nothing unmapped rendered.
    """
    c, section, value = F.col("raw_text"), F.col("section"), F.col("fields")["value"]
    told = docs.where(T.strip(F.coalesce("text", F.lit(""))) != "").select("doc_id", "text")
    jobs = section.isin("present_employment", "previous_employment")
    degree, year = F.col("fields")["degree"], F.col("fields")["year"]
    rules = {
        "name": (section == "full_name") & (value.rlike("[0-9@:]") | value.rlike(T.ORG_WORD) | (T.n_words(value) > 4)),
        "email": (section == "email") & ~value.rlike(rf"^{T.EMAIL}$"),
        "date only": c.rlike(T.DATE_ONLY),
        "employment of dates": jobs & (F.coalesce(F.col("fields")["title"], F.lit("x")) == ""),
        "link": (section == "profiles_links") & ~F.coalesce(F.col("fields")["url"].rlike("(?i)^https?://"), F.lit(False)),
        "degree": (section == "qualifications") & degree.isNotNull() & ~F.contains(c, degree),
        "year": (section == "qualifications") & year.isNotNull() & ~F.contains(c, year),
    }
    broken = items.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))).alias("rule"))
    few = told.select("doc_id").join(items.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").where(F.coalesce("n", F.lit(0)) < LEAST_ITEMS).select("doc_id", F.lit("items").alias("rule"))
    nameless = told.select("doc_id").join(items.where("section = 'email'").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("no email").alias("rule"))
    keys = ["doc_id", "item_ord", "section"]
    echoes = items.select(*keys).join(rewrites.drop_name_echoes(items).select(*keys), keys, "left_anti").select("doc_id", F.lit("name echo").alias("rule"))
    invented = items.select(*keys).join(reconcile.verbatim(items, docs.where("text is not null"), bodies).select(*keys), keys, "left_anti").where(~section.isin("profiles_links", "contact_info")).select("doc_id", F.lit("verbatim").alias("rule"))
    shown = render.rendered(items).where("style = 'heading' and text = 'UNMAPPED INFORMATION'").select("doc_id", F.lit("unmapped shown").alias("rule"))
    out = broken.select("rule", "doc_id")
    for more in (few, nameless, echoes, invented, shown):
        out = out.unionByName(more.select("rule", "doc_id"))
    return out.distinct()
