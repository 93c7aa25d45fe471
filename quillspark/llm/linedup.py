"""Site-relative line dedup: a line on too large a share of its host's pages is boilerplate there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, small, table

#: A line is dropped if more than this share of its host's pages have it.
RATIO = 0.1
#: A line of a single page repeats nowhere; the ratio alone would take it from every host of fewer than 1 / RATIO pages.
REPEATED = 2
#: Pages of more lines than this are compared by a join of their lines instead of within the row.
LONG_PAGE = 4096

# What isn't text, and tags that end a line. Written for Java's and RE2's expressions alike. What
# never ends takes the rest of the page with it, as in a browser, so that no page is read again from each opening.
_NO_TEXT = r"(?is)<!--.*?(?:-->|\z)|<title[ \t\r\n>].*?(?:</title>|\z)|<script[ \t\r\n>].*?(?:</script>|\z)|<style[ \t\r\n>].*?(?:</style>|\z)|<template[ \t\r\n>].*?(?:</template>|\z)|<noscript[ \t\r\n>].*?(?:</noscript>|\z)"
_BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)(?:[ \t\r\n/][^>]*)?(?:>|\z)"
_TAGS = r"<[a-zA-Z/!?][^>]*(?:>|\z)"
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
_SPACE = r"[ \t\r\f]+"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: Column) -> Column:
    """The lower-case host of a URL; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def page_lines(html: Column) -> Column:
    """The lines of a page's text: block tags end one, other tags vanish, white space is one space; empty ones are left out."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _NO_TEXT, "\n"), _BREAKS, "\n"), _TAGS, "")
    for entity, char in _ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(F.regexp_replace(text, _SPACE, " "), "\n"), lambda x: F.trim(x))
    return F.coalesce(F.filter(lines, lambda x: x != ""), F.array().cast("array<string>"))


def _known(line: Column) -> Column:
    """128 bits that stand for a line in counts and shuffles."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def boilerplate(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(host, mark): of each host of ``pages(host, lines)`` the lines to drop.

    Pages with a line are counted by host and line, map-side first, so a host with a third of all
    pages, or a line that all pages have, costs a row a task. A host has at most its mean number of
    lines a page, divided by ``ratio``, of such lines: marks stay small however large the host is.
    """
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    seen = pages.select("host", F.explode(F.array_distinct(F.transform("lines", _known))).alias("mark"))
    often = seen.groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED)
    often = cut(often).join(small(cut(totals)), "host")
    return often.where(F.col("n") > ratio * F.col("pages")).select("host", "mark")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Every row of ``pages(page_id, host, lines)`` with the lines kept: (page_id, host, text, n_lines, n_dropped).

    Pages without lines (null, empty) count among their host's pages; null hosts should come as one
    value. Repeated rows count as pages each; a line repeated on a page counts once and is dropped at
    each place; very long pages are read whole. An empty table gives no rows; other columns are not looked at.

    Pages are split into lines once, and written. Marks are broadcast only if there are few of them in all; else the
    join's skewed hosts are split by adaptive execution. A page's own marks are found by a set intersection, and its
    lines looked up among these. Pages of very many lines meet the marks as rows instead, and are put together again.
    """
    pages = cut(pages.select("page_id", "host", "lines", F.monotonically_increasing_id().alias("__row")))
    marks = cut(boilerplate(pages, ratio))
    few = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    of_host = marks.groupBy("host").agg(F.collect_list("mark").alias("marks"))
    joined = pages.where(F.size("lines") <= LONG_PAGE).join(F.broadcast(of_host) if few else of_host, "host", "left")
    met = F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), F.transform("marks", lambda m: m["a"]))
    own = joined.withColumn("__own", F.when(F.size(met) > 0, F.filter("marks", lambda m: F.array_contains(met, m["a"]))))
    kept = F.when(F.col("__own").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("__own"), _known(x))))
    short = own.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    long = pages.where(F.size("lines") > LONG_PAGE)
    rows = long.select("__row", "host", F.posexplode("lines").alias("at", "line")).withColumn("mark", _known(F.col("line")))
    left = rows.join(F.broadcast(marks) if few else marks, ["host", "mark"], "left_anti").groupBy(F.col("__row").alias("__of")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("left"))
    whole = long.join(left, F.col("__row") == F.col("__of"), "left")
    whole = whole.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.transform("left", lambda x: x["line"]), F.array().cast("array<string>")).alias("kept"))
    out = short.unionByName(whole)
    return out.select("page_id", "host", F.array_join("kept", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"), page_lines(F.col("html")).alias("lines"))
    return drop_boilerplate(pages)


def _sql_text() -> str:
    text = "html"
    for pattern, to in ((_NO_TEXT, "chr(10)"), (_BREAKS, "chr(10)"), (_TAGS, "''")):
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    for entity, char in _ENTITIES.items():
        text = f"replace({text}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({text}, '{_SPACE}', ' ', 'g')"


OP3_SQL = f"""
with p as (
  select page_id, row_number() over () as r, coalesce(lower(regexp_extract(url, '{_HOST}', 1)), '') as host,
    coalesce(list_filter(list_transform(string_split({_sql_text()}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), []) as lines
  from pages
), t as (select host, count(*) as pages from p group by host),
l as (select r, host, i, line from (select r, host, unnest(lines) as line, generate_subscripts(lines, 1) as i from p)),
b as (
  select host, line from (select distinct r, host, line from l) join t using (host) group by host, line, pages
  having count(*) >= {REPEATED} and count(*) > {RATIO} * pages
), k as (select r, string_agg(line, chr(10) order by i) as text, count(*) as n from l anti join b using (host, line) group by r)
select p.page_id, p.host, coalesce(k.text, '') as text, cast(len(p.lines) as bigint) as n_lines, cast(len(p.lines) - coalesce(k.n, 0) as bigint) as n_dropped
from p left join k using (r)
"""
