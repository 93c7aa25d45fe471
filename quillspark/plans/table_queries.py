"""Queries over the test tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..catalog import register
from ..functions import text as T
from ..operators import lines as L
from ..operators import commands, fields, reconcile, review, routing
from ..streaming import audit
from .tables import document_lines, score_items, table

_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)"
_STRIP = r"regexp_replace({0}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
_SQUASH = r"trim(regexp_replace({0}, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
_PHONE = r"\(?[ \t\n\x0B\f\r]*\+?[ \t\n\x0B\f\r]*\(?[0-9][0-9 \t\n\x0B\f\r().\-]{7,}[0-9]\)?"


def _strip(c: str) -> str:
    return _STRIP.format(c)


def _squash(c: str) -> str:
    return _SQUASH.format(c)


@register("running_headers", f"select doc_id, {_squash('line')} as norm, count(*) as repeats from {_LINES} where length({_strip('line')}) > 12 group by 1, 2 having count(*) >= 3")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.repeated_lines(document_lines(spark, sf_dir))


@register(
    "body_lines",
    f"""with l as {_LINES}, h as (select doc_id, {_squash('line')} as norm from l where length({_strip('line')}) > 12 group by 1, 2 having count(*) >= 3)
    select l.doc_id, count(*) as n_lines, cast(sum(length(l.line)) as bigint) as n_chars from l anti join h on l.doc_id = h.doc_id and {_squash('l.line')} = h.norm group by 1""",
)
def body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without its page furniture."""
    lines = document_lines(spark, sf_dir)
    return L.without_furniture(lines, L.repeated_lines(lines)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line")).cast("long").alias("n_chars"))


@register("line_stats", f"select doc_id, count(*) as n_lines, count(*) filter ({_squash('line')} = '') as n_blank, max(length({_squash('line')})) as longest from {_LINES} group by doc_id")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = T.squash(F.col("line"))
    return document_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(norm == "").alias("n_blank"), F.max(F.char_length(norm)).cast("long").alias("longest"))


@register("rejoined_text", f"select doc_id, sha256(string_agg({_squash('line')}, chr(10) order by line_no)) as digest from {_LINES} group by doc_id")
def rejoined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines put together again in order."""
    rows = document_lines(spark, sf_dir).withColumn("line", T.squash(F.col("line")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id").agg(F.sha2(whole, 256).alias("digest"))


@register(
    "garble_scores",
    f"""with t as (select doc_id, list_filter(string_split({_squash('text')}, ' '), lambda x: x <> '') as tokens from documents),
    r as (select doc_id, len(tokens) as n, list_filter(string_split(array_to_string(list_transform(tokens, lambda x: case when regexp_full_match(x, '\\pL') then 'a' else '|' end), ''), '|'), lambda x: length(x) between 1 and 5) as runs from t)
    select doc_id, case when n >= 100 then coalesce(list_sum(list_transform(runs, lambda x: length(x))), 0) / cast(n as double) end as score from r""",
)
def garble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.garble_score(F.col("text")).alias("score"))


@register("emails_per_document", rf"select doc_id, len(regexp_extract_all(text, '{T.EMAIL}')) as n, regexp_extract(text, '{T.EMAIL}') as first from documents")
def emails_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.emails(F.col("text"))).cast("long").alias("n"), F.regexp_extract("text", T.EMAIL, 0).alias("first"))


@register(
    "phones_per_document",
    f"""with p as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '{_PHONE}'), lambda x: {_strip('x')}), lambda x: starts_with(x, '+') or length(regexp_replace(x, '[^0-9]', '', 'g')) >= 9) as found from documents)
    select doc_id, len(found) as n, array_to_string(found, '; ') as found from p""",
)
def phones_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.phones(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, "; ").alias("found"))


@register("caps_lines", f"select doc_id, line_no, {_strip('line')} as line from {_LINES} where length({_strip('line')}) between 1 and 60 and len(string_split({_squash('line')}, ' ')) <= 8 and length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) > 0 and length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) / length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) >= 0.7 or {_strip('line')} like '%:' and length({_strip('line')}) <= 60 and len(string_split({_squash('line')}, ' ')) <= 8")
def caps_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the shape by which repeated headings are known while text is read."""
    return document_lines(spark, sf_dir).where(T.repeated_heading_shaped(F.col("line"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.strip(F.col("line")).alias("line"))


@register(
    "section_assignment",
    f"""with l as {_LINES}, k as (select doc_id, line_no, line, case when {_squash('line')} <> '' and length({_strip('line')}) <= 100 and length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) > 3 and regexp_replace(line, '[^\\p{{L}}]', '', 'g') = regexp_replace(line, '[^\\p{{Lu}}]', '', 'g') then {_squash('line')} end as head from l)
    select doc_id, line_no, coalesce(last_value(head ignore nulls) over (partition by doc_id order by line_no), '{vocab.TOP}') as context from k""",
)
def section_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the last line in capitals above it; the shape alone counts here, as these documents have no headings."""
    return L.in_capitals(document_lines(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "context")


@register("hyperlink_targets", """with h as (select page_id, html, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as url from pages)
    select page_id, rtrim(lower(url), '/') as key, min(url) as url, count(*) as n from h where not contains(regexp_replace(html, '<[^>]*>', '', 'g'), url) group by 1, 2""")
def hyperlink_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets that the visible text doesn't show, once each."""
    return fields.link_targets(table(spark, sf_dir, "pages"))


_ROUTED = [("the", r"\bthe\b"), ("and", r"\band\b"), ("of", r"\bof\b"), ("that", r"\bthat\b"), ("with", r"\bwith\b")]


@register(
    "route_by_first_word",
    f"with d as (select doc_id, substr({_FOLD}, 1, 60) as head from documents), p as (select doc_id, ["
    + ", ".join(rf"{{'at': case when regexp_matches(head, '{p}') then length(regexp_extract(head, '^(?s:.*?){p}')) - {len(w)} + 1 end, 'i': {i}, 'w': '{w}'}}" for i, (w, p) in enumerate(_ROUTED))
    + "] as places from d) select doc_id, list_sort(list_filter(places, lambda x: x.at is not null))[1].w as word from p",
)
def route_by_first_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest of some words in the head of a document, by the operator that routes items; the vocabulary is a stand-in."""
    return table(spark, sf_dir, "documents").select("doc_id", routing.route(F.col("text"), [(p, w) for w, p in _ROUTED]).alias("word"))


_SCORES = "select l_suppkey as doc_id, l_orderkey * 10 + l_linenumber as item_ord, case when l_linenumber = 7 then 'unmapped' else 'section' || l_linenumber end as section, round(1 - l_discount * 5, 4) as confidence, l_tax > 0.06 as flagged, case l_returnflag when 'A' then 'approved' when 'N' then 'pending_review' else 'rejected' end as status from lineitem"


@register("confidence_bands", f"with i as ({_SCORES}) select section, case when confidence >= 0.9 then 'high' when confidence >= 0.7 then 'medium' else 'low' end as band, count(*) as n from i group by 1, 2")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_items(spark, sf_dir).groupBy("section", T.band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


@register("auto_approval", f"with i as ({_SCORES}) select doc_id, count(*) filter (status = 'approved' or status = 'pending_review' and confidence >= 0.75 and not flagged) as approved, count(*) filter (status = 'pending_review' and confidence >= 0.75 and not flagged) as automatic, count(*) filter (status = 'pending_review' and (confidence < 0.75 or flagged)) as pending from i group by doc_id")
def auto_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = review.approve(review.row_flags(score_items(spark, sf_dir)))
    return items.groupBy("doc_id").agg(F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.array_contains("actions", "auto_approved")).alias("automatic"), F.count_if(F.col("status") == "pending_review").alias("pending"))


@register("auto_approval_sweep", f"with i as ({_SCORES}), t as (select unnest([0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.99]) as threshold) select cast(threshold as double) as threshold, count(*) filter (status = 'pending_review' and confidence >= threshold and not flagged) as automatic from i, t group by 1")
def auto_approval_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic approvals at several thresholds, in one pass and one row."""
    items = review.row_flags(score_items(spark, sf_dir))
    steps = [0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.99]
    counts = items.agg(*[F.count_if((F.col("status") == "pending_review") & ~review.needs_review(t)).alias(f"n{i}") for i, t in enumerate(steps)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("automatic")) for i, t in enumerate(steps)])))


@register("overlapping_intervals", """with o as (select o_orderkey, o_custkey, cast(o_orderdate as date) as s, cast(o_orderdate as date) + cast(o_orderkey % 60 as integer) as e from orders)
    select distinct a.o_orderkey, a.o_custkey from o a join o b on a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey and a.s <= b.e and b.s <= a.e""")
def overlapping_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a customer that overlap another one, without joining all pairs."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("s")).withColumn("e", F.date_add("s", (F.col("o_orderkey") % 60).cast("int")))
    return review.overlapping(rows, "o_custkey", "s", "e", "o_orderkey").where("overlaps").select("o_orderkey", "o_custkey")


_DUPLICATES = f"with d as (select doc_id, source, nullif(substr({_squash(_FOLD)}, 1, 120), '') as key from documents) select doc_id from d where key is not null qualify count(*) over (partition by source, key) > 1"


@register("duplicate_citations", _DUPLICATES)
def duplicate_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source, in any language or none, whose first 120 characters agree; ASCII letters alone are folded, as other case rules differ."""
    return _duplicates(table(spark, sf_dir, "documents"), lambda c: F.translate(c, _UPPER, _UPPER.lower()))


@register("duplicate_citations_all", _DUPLICATES)
def duplicate_citations_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows under the name that they had while ``duplicate_citations`` covered English documents only."""
    return duplicate_citations(spark, sf_dir)


def _duplicates(docs: DataFrame, lower: Callable[[Column], Column] = F.lower) -> DataFrame:
    """Documents of a source that agree, by the operator that flags duplicate publications."""
    none = F.array().cast("array<string>")
    items = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("item_ord"), F.lit("publications").alias("section"), F.create_map(F.lit("citation"), F.col("text")).alias("fields"), F.lit("").alias("raw_text"), none.alias("flags"))
    return review.duplicate_flags(items, lower=lower).where(F.array_contains("flags", "possible_duplicate_publication")).select(F.col("item_ord").alias("doc_id"))


_CATALOGUE = "(select unnest(['section1', 'section2', 'section3', 'section4', 'section5', 'section6', 'unmapped', 'skills']) as section)"


@register("quality_report_sections", f"with i as ({_SCORES}), c as (select doc_id, section, count(*) as item_count, count(*) filter (status = 'approved') as approved_count, count(*) filter (flagged or confidence < 0.9 or status = 'pending_review') as flagged_count from i group by 1, 2), w as (select d.doc_id, s.section, coalesce(item_count, 0) as item_count, coalesce(approved_count, 0) as approved_count, coalesce(flagged_count, 0) as flagged_count from (select distinct doc_id from i) d cross join {_CATALOGUE} s left join c on c.doc_id = d.doc_id and c.section = s.section) select *, case when item_count = 0 then 'missing' when flagged_count > 0 then 'needs_review' else 'verified' end as verdict from w")
def quality_report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = spark.range(1).select(F.explode(F.array(*[F.lit(f"section{i}") for i in range(1, 7)], F.lit("unmapped"), F.lit("skills"))).alias("section"))
    return review.section_report(review.row_flags(score_items(spark, sf_dir)), catalogue)


_APPROVED = "status = 'pending_review' and confidence >= 0.75 and not flagged"


@register(
    "quality_report_summary",
    f"""with s as ({_SCORES}), i as (select * replace (case when {_APPROVED} then 'approved' else status end as status), {_APPROVED} as automatic from s)
    select doc_id, count(*) as total_items, coalesce(count(*) filter (status <> 'rejected' and confidence >= 0.9), 0) as high_count, round(coalesce(cast(sum(cast(confidence as decimal(12, 8))) filter (status <> 'rejected') as double) / nullif(count(*) filter (status <> 'rejected'), 0), 0), 3) as overall_confidence,
    count(*) filter (status = 'pending_review') as pending_count, count(*) filter (automatic) as auto_approved_count, count(*) filter (status <> 'rejected' and section <> 'unmapped') as mapped_count, count(*) filter (status <> 'rejected' and section = 'unmapped') as unmapped_count,
    round(coalesce(mapped_count / nullif(cast(mapped_count + unmapped_count as double), 0), 0.0), 3) as coverage, pending_count = 0 as ready from i group by doc_id""",
)
def quality_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each document after items that are sure were approved."""
    items = review.approve(review.row_flags(score_items(spark, sf_dir)))
    high = items.groupBy("doc_id").agg(F.count_if((F.col("status") != "rejected") & (F.col("confidence") >= 0.9)).alias("high_count"))
    return review.summary_report(items).join(high, "doc_id")


@register("mean_confidence", f"with i as ({_SCORES}) select section, round(coalesce(cast(sum(cast(confidence as decimal(12, 8))) filter (status <> 'rejected') as double) / nullif(count(*) filter (status <> 'rejected'), 0), 0), 6) as mean from i group by section")
def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.mean_confidence(score_items(spark, sf_dir), "section", digits=6)


@register("unmapped_heading_dashboard", """with e as (select event_id, user_id, 'k' || regexp_extract(props, '"k": *([0-9]+)', 1) as context, event_type as value from events),
    g as (select context, count(*) as occurrences, count(distinct user_id) as cv_count, arg_min(value, event_id) as example from e where context <> 'k' and not regexp_full_match(context, 'k[0-9]') group by context)
    select * from g order by cv_count desc, occurrences desc, context limit 30""")
def unmapped_heading_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 30 contexts of events by distinct users; one-digit contexts count as taught."""
    context = F.concat(F.lit("k"), F.regexp_extract("props", '"k": *([0-9]+)', 1))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), context.alias("context"), F.col("event_type").alias("value"), F.col("event_id").alias("item_ord")).where("context <> 'k'")
    taught = spark.range(10).select(F.concat(F.lit("K"), F.col("id").cast("string")).alias("heading"))
    return review.unmapped_headings(rows, taught)


_SUGGESTED = """with g as (select l_orderkey, l_linestatus, count(*) as n, count(distinct l_suppkey) as docs from lineitem group by 1, 2),
    b as (select l_orderkey, sum(n) as all_n, max({'n': n, 'docs': docs, 's': l_linestatus}) as top from g group by 1),
    a as (select l_orderkey, count(distinct l_suppkey) as all_docs from lineitem group by 1),
    c as (select cast(l_orderkey as varchar) as context, top.s as suggested_section, top.docs as cv_count, top.n as occurrences, round(top.n / cast(all_n as double), 2) as agreement from b join a using (l_orderkey) where all_docs >= 2 and top.n / cast(all_n as double) >= 0.7)
    select * from c"""


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linestatus").alias("section"), F.col("l_orderkey").cast("string").alias("context"), F.lit("").alias("value"), F.col("l_linenumber").alias("item_ord"))


@register("mapping_suggestions", _SUGGESTED)
def mapping_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines mostly share a status, as headings whose corrections mostly share a section: all of them."""
    return review.suggested_mappings(_corrections(spark, sf_dir), top=None)


@register("top_mapping_suggestions", _SUGGESTED + " order by cv_count desc, occurrences desc, context limit 20")
def top_mapping_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the top twenty."""
    return review.suggested_mappings(_corrections(spark, sf_dir))


@register("verbatim_guard", f"select b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text) or contains({_squash('d.text')}, {_squash('b.text')})")
def verbatim_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that stand in documents word for word."""
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return reconcile.quoted(passages, table(spark, sf_dir, "documents"), "item_id")


@register("profile_prefill", """select s_suppkey as doc_id, 'contact_info' as section, 'desk ' || s_nationkey as value, 'profile' as origin from supplier where s_acctbal > 0
    union all select s_suppkey, 'email', s_name || '@example.org', 'profile' from supplier
    union all select s_suppkey, 'contact_info', 'extracted', 'extracted' from supplier where not s_acctbal > 0
    union all select s_suppkey, 'associations', n_name, 'profile' from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 2 = 0
    union all select s_suppkey, 'associations', 'extracted', 'extracted' from supplier where s_suppkey % 2 = 1""")
def profile_prefill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents with saved profiles: contact data are replaced, memberships come where there are none."""
    sup, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    profiles = sup.join(nation, sup.s_nationkey == nation.n_nationkey).select(F.col("s_suppkey").alias("doc_id"), F.concat("s_name", F.lit("@example.org")).alias("email"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("desk "), F.col("s_nationkey").cast("string"))).alias("phone"), F.lit("").alias("job_title"), F.create_map().cast("map<string,string>").alias("links"), F.array("n_name").alias("memberships"))
    said = F.create_map(F.lit("value"), F.lit("extracted")).alias("fields")
    items = sup.select(F.col("s_suppkey").alias("doc_id"), F.lit("contact_info").alias("section"), said, F.lit("").alias("raw_text"))
    items = items.unionByName(sup.where("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("doc_id"), F.lit("associations").alias("section"), said, F.lit("").alias("raw_text")))
    return reconcile.prefill(items, profiles)


@register("audit_timeline", "select event_id, user_id, event_type, coalesce(lag(event_type) over w, '') as previous, coalesce(cast(date_diff('microsecond', lag(ts) over w, ts) as bigint), -1) as waited_us, row_number() over w as step from events window w as (partition by user_id order by ts, event_id)")
def audit_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of a user with the one before it."""
    return audit.timeline(table(spark, sf_dir, "events"))


@register("missing_mandatory", "select d.c_custkey as doc_id, s.section from customer d, (select unnest(['full_name', 'email']) as section) s where not (s.section = 'full_name' and c_custkey % 3 <> 0 or s.section = 'email' and c_custkey % 4 <> 0)")
def missing_mandatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    items = docs.where("doc_id % 3 <> 0").withColumn("section", F.lit("full_name")).unionByName(docs.where("doc_id % 4 <> 0").withColumn("section", F.lit("email")))
    return review.missing_mandatory(items, docs)


@register("last_write_wins", "select user_id, arg_max(event_type, {'ts': ts, 'event_id': event_id}) as status, max(ts) as at, count(*) as writes from events group by user_id")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upsert of keyed rows: of each key the last write."""
    return audit.last_writes(table(spark, sf_dir, "events"))


@register("page_font_mode", "with m as (select p_brand, p_size, count(*) as n from part group by 1, 2), b as (select p_brand, arg_max(p_size, {'n': n, 's': -p_size}) as body from m group by 1) select p_partkey, p_size from part join b using (p_brand) where p_size >= 1.15 * body")
def page_font_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows well above the most common size of their group, as headings stand out from the body by their font."""
    return L.outsized(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size").select("p_partkey", "p_size")


@register("audit_counts", "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and kind, by the plan that also runs on a stream."""
    return audit.counts_by_window(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("bulk_status", f"with i as ({_SCORES}) select section, case when section = 'section2' and status = 'pending_review' and confidence >= 0.7 and confidence < 0.9 then 'rejected' else status end as status, count(*) as n from i group by 1, 2")
def bulk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending items of one section and band rejected at once."""
    return commands.bulk_status(score_items(spark, sf_dir), "rejected", "section2", "medium").groupBy("section", "status").agg(F.count("*").alias("n"))


@register("garbled_documents", f"""with t as (select doc_id, list_filter(string_split({_squash('text')}, ' '), lambda x: x <> '') as tokens from documents),
    r as (select doc_id, len(tokens) as n, list_filter(string_split(array_to_string(list_transform(tokens, lambda x: case when regexp_full_match(x, '\\pL') then 'a' else '|' end), ''), '|'), lambda x: length(x) between 1 and 5) as runs from t)
    select doc_id, n >= 100 and coalesce(list_sum(list_transform(runs, lambda x: length(x))), 0) / cast(n as double) > 0.12 as garbled from r""")
def garbled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents too garbled to be read."""
    return L.unreadable(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("garbled", F.lit(False)).alias("garbled"))


@register("longest_headers", f"with h as (select doc_id, {_squash('line')} as norm from {_LINES} where length({_strip('line')}) > 12 group by 1, 2 having count(*) >= 3) select doc_id, norm, row_number() over (partition by doc_id order by length(norm) desc, norm) as place from h")
def longest_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page headers of a document, the longest first."""
    return L.longest_first(L.repeated_lines(document_lines(spark, sf_dir))).select("doc_id", "norm", "place")


@register("structured_documents", f"""with d as (select doc_id, text from documents where text is not null)
    select doc_id, nullif(regexp_extract(text, '{T.EMAIL}'), '') as email, cast(0 as bigint) as invented, cast(0 as bigint) as unknown, cast(0 as bigint) as misshapen, cast(0 as bigint) as banded_wrong, true as ids from d""")
def structured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow over every document, held to what must come out of any text: the first address as the address, no item whose text isn't
    in the document, none in an unknown section, none that is only a date, bands that follow confidence, an id for every item and no id twice."""
    from . import structure

    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    parts = structure.bodies(docs)
    items = structure.staged(structure.processed(docs, 2026, parts=parts))
    fine = reconcile.verbatim(items, docs, structure.copies(docs, parts=parts)).select("item_id").distinct()
    drafted = F.array_contains("flags", "drafted_not_extracted")
    judged = items.join(fine.withColumn("quoted", F.lit(True)), "item_id", "left").withColumn("quoted", F.coalesce("quoted", F.lit(False)) | drafted)
    per = judged.groupBy("doc_id").agg(
        F.min(F.when(F.col("section") == "email", F.col("fields")["value"])).alias("email"),
        F.count_if(~F.col("quoted")).alias("invented"), F.count_if(~F.col("section").isin(vocab.SECTION_KEYS)).alias("unknown"),
        F.count_if(F.col("raw_text").rlike(T.DATE_ONLY) & (F.col("section") != "unmapped")).alias("misshapen"), F.count_if(F.col("band") != T.band(F.col("confidence"))).alias("banded_wrong"),
        (F.count("*") == F.count_distinct("item_id")).alias("ids"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", "email", zero("invented"), zero("unknown"), zero("misshapen"), zero("banded_wrong"), F.coalesce("ids", F.lit(True)).alias("ids"))
