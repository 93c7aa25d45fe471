"""Lines of documents: page furniture, letter-spaced and wrapped headings, garbled text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import patterns as P
from .. import vocab
from ..functions import text as T
from .headings import resolve

MARKER = ""


def header_footer(lines: DataFrame) -> DataFrame:
    """Adds ``is_header_footer`` from the marker that readers put before such lines, and takes the marker away."""
    marked = F.col("line").startswith(MARKER)
    return lines.withColumns({"is_header_footer": marked, "line": F.when(marked, F.substring("line", 2, 1 << 30)).otherwise(F.col("line"))})


def content_repeats(line: Column, heading_key: Column) -> Column:
    """A repeated line that is content all the same: an organisation and a comma, no contact data, no heading."""
    return ~line.rlike(T.EMAIL) & ~T.has_phone(line) & heading_key.isNull() & line.rlike(T.ORG_WORD) & line.contains(",")


def repeated_lines(lines: DataFrame, repeats: int = vocab.REPEATS, longer_than: int = vocab.REPEAT_CHARS) -> DataFrame:
    """(doc_id, norm, repeats): lines that a document has at least so many times, pre-aggregated before the shuffle."""
    kept = lines.where(F.char_length(T.strip(F.col("line"))) > longer_than)
    return kept.groupBy("doc_id", T.squash(F.col("line")).alias("norm")).agg(F.count("*").alias("repeats")).where(F.col("repeats") >= repeats)


def without_furniture(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines but those of ``headers(doc_id, norm)``."""
    return lines.withColumn("norm", T.squash(F.col("line"))).join(headers.select("doc_id", "norm"), ["doc_id", "norm"], "left_anti").select(*lines.columns)


def garble_score(text: Column) -> Column:
    """The share of single letters among tokens, runs of six and more (spaced headings) left out; null below 100 tokens.

    Runs are found in the text itself: tokens that aren't single letters become a bar, and what
    lies between bars is a run.
    """
    tokens = F.filter(F.split(T.squash(text), " "), lambda t: t != "")
    letters = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^\p{L}$"), "a").otherwise("|")), "")
    runs = F.filter(F.split(letters, r"\|"), lambda r: F.char_length(r).between(1, 5))
    return F.when(F.size(tokens) >= 100, F.aggregate(runs, F.lit(0), lambda s, r: s + F.char_length(r)) / F.size(tokens))


def dedupe_headings(lines: DataFrame) -> DataFrame:
    """Drops later copies of heading-shaped lines of ``lines(doc_id, line_no, line)``; repeated content stays."""
    shaped = T.repeated_heading_shaped(F.col("line"))
    nth = F.row_number().over(Window.partitionBy("doc_id", F.when(shaped, F.lower(T.strip(F.col("line")))).otherwise(F.concat(F.lit("\x00"), F.col("line_no").cast("string")))).orderBy("line_no"))
    return lines.withColumn("__nth", nth).where(F.col("__nth") == 1).drop("__nth")


def split_caps_runs(lines: DataFrame) -> DataFrame:
    """Lines cut where three words or more in capitals begin inside them."""
    pieces = F.filter(F.transform(F.split("line", P.EMBEDDED_RUN), lambda p: T.strip(p)), lambda p: p != "")
    return lines.select(*[c for c in lines.columns if c != "line"], F.posexplode(pieces).alias("piece", "line"))


def collapse_spaced(line: Column) -> Column:
    """A letter-spaced line as one word; others as they are."""
    return F.when(T.letter_spaced(line), F.regexp_replace(line, r"\s+", "")).otherwise(line)


def running_headers(lines: DataFrame, taught: DataFrame | None = None) -> DataFrame:
    """(doc_id, norm): page furniture of ``lines(doc_id, line, is_header_footer)``: marked lines, and repeated ones that don't repeat as content."""
    repeated = resolve(repeated_lines(lines), "norm", taught=taught, approximate=False)
    repeated = repeated.where(~content_repeats(F.col("norm"), F.col("heading_key"))).select("doc_id", "norm")
    return repeated.unionByName(lines.where("is_header_footer").select("doc_id", T.squash(F.col("line")).alias("norm"))).distinct()


def longest_first(headers: DataFrame) -> DataFrame:
    """Adds ``place`` to ``headers(doc_id, norm)``: the longest of a document first, as that is most often its contact strip."""
    return headers.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.char_length("norm").desc(), "norm")).cast("long"))


def gathered(lines: DataFrame) -> DataFrame:
    """(doc_id, lines): the lines of each document in order."""
    return lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))


def merge_wrapped(lines: DataFrame, phrases: list[str]) -> DataFrame:
    """(doc_id, line_no, line) in which a heading wrapped over two or three lines is one again.

    Lines that are heading-shaped and, put together, exactly a known heading become one, three before two, the first before those it
    overlaps. One window a document looks at the lines after each one and, for what is taken, at those before.
    """
    w, known = Window.partitionBy("doc_id").orderBy("line_no"), T.constant_map({p: "" for p in phrases})
    named = lambda c: F.try_element_at(known, c).isNotNull()
    rows = lines.select("doc_id", "line_no", "line", F.when(T.heading_shaped(F.col("line")), T.squash(F.col("line"))).alias("part"))
    rows = rows.withColumns({"second": F.lead("part").over(w), "third": F.lead("part", 2).over(w)})
    rows = rows.withColumns({"two": F.concat("part", F.lit(" "), "second"), "three": F.concat("part", F.lit(" "), "second", F.lit(" "), "third")})
    rows = rows.withColumn("takes", F.when(named(T.normal_heading(F.col("three"))), 2).when(named(T.normal_heading(F.col("two"))), 1).otherwise(0))
    taken = lambda c: (F.coalesce(F.lag(c).over(w), F.lit(0)) >= 1) | (F.coalesce(F.lag(c, 2).over(w), F.lit(0)) >= 2)
    rows = rows.withColumn("takes", F.when(taken("takes"), 0).otherwise(F.col("takes"))).withColumn("gone", taken("takes"))
    return rows.where(~F.col("gone")).select("doc_id", "line_no", F.when(F.col("takes") == 2, F.col("three")).when(F.col("takes") == 1, F.col("two")).otherwise(F.col("line")).alias("line"))


def merge_spaced(lines: DataFrame, phrases: list[str], ahead: int = 6) -> DataFrame:
    """(doc_id, line_no, line) in which letter-spaced headings are readable again.

    Put together, such a line is a known heading, or two words of one that is cut where they meet, or the first word of
    one whose second stands letter-spaced among the next ``ahead`` lines; that one is taken out, and what lies between
    stays as it is. A line that is none of these keeps its spaces. One window a document.
    """
    words = sorted(set(phrases))
    pairs: dict[str, str] = {p: p for p in words}
    for p in sorted((p for p in words if p.count(" ") == 1), key=lambda p: p.index(" ")):
        pairs.setdefault(p.replace(" ", ""), p)
    w, table = Window.partitionBy("doc_id").orderBy("line_no"), T.constant_map(pairs)
    rows = lines.select("doc_id", "line_no", "line", F.when(T.letter_spaced(F.col("line")), F.regexp_replace(F.upper(T.strip(F.col("line"))), r"\s+", "")).alias("own"))
    rows = rows.withColumn("alone", F.try_element_at(table, F.col("own"))).withColumn("next", F.array(*[F.lead("own", k).over(w) for k in range(1, ahead + 1)]))
    both = F.transform("next", lambda x, k: F.struct((k + 1).alias("k"), F.try_element_at(table, F.concat("own", F.lit(" "), x)).alias("said")))
    rows = rows.withColumn("pair", F.when(F.col("own").isNotNull() & F.col("alone").isNull(), F.get(F.filter(both, lambda x: x["said"].isNotNull()), F.lit(0))))
    before = [F.lag("pair.k", k).over(w) for k in range(1, ahead + 1)]
    inside, met = F.lit(False), F.lit(False)
    for k, reach in enumerate(before, 1):
        inside, met = inside | F.coalesce(reach >= k, F.lit(False)), met | F.coalesce(reach == k, F.lit(False))
    rows = rows.withColumns({"inside": inside, "gone": met})
    return rows.where(~F.col("gone")).select("doc_id", "line_no", F.when(F.col("inside"), F.col("line")).otherwise(F.coalesce("alone", "pair.said", "line")).alias("line"))


def body_size(lines: DataFrame, keys: list[str], size: str) -> DataFrame:
    """(keys, body): the most common size of the rows of ``lines`` that have one, the smallest of equals; the median of no more than one row each way is the same."""
    counted = lines.where(F.col(size).isNotNull()).groupBy(*keys, size).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.max_by(size, F.struct("n", -F.col(size))).alias("body"))


def outsized(lines: DataFrame, keys: list[str], size: str, ratio: float = vocab.OUTSIZED) -> DataFrame:
    """Rows at least ``ratio`` times the most common size of their group, as headings stand out from the body by their font."""
    return lines.join(body_size(lines, keys, size), keys).where(F.col(size) >= ratio * F.col("body")).drop("body")


def font_headings(lines: DataFrame, least: int = 4, most_words: int = 10) -> DataFrame:
    """(doc_id, norm): lines of ``lines(doc_id, line, size)`` whose font may make them headings; documents with fewer than ``least`` sized lines give none."""
    sized = lines.select("doc_id", F.lower(T.squash(F.col("line"))).alias("norm"), "size").where("norm <> '' and size is not null").groupBy("doc_id", "norm").agg(F.max("size").alias("size"))
    enough = sized.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("doc_id")
    return outsized(sized.join(enough, "doc_id", "left_semi"), ["doc_id"], "size").where(T.n_words(F.col("norm")) <= most_words).select("doc_id", "norm")


def unreadable(docs: DataFrame, most: float = vocab.GARBLED) -> DataFrame:
    """Adds ``garbled`` to ``docs(text)``: whether too many of its tokens are single letters for the text to be used."""
    return docs.withColumn("garbled", F.coalesce(garble_score(F.col("text")) > most, F.lit(False)))


def in_capitals(lines: DataFrame) -> DataFrame:
    """Adds ``context`` to ``lines(doc_id, line_no, line)``: the last line in capitals above, by its shape alone, for documents without known headings."""
    letters = F.regexp_replace("line", r"[^\p{L}]", "")
    head = F.when((T.squash(F.col("line")) != "") & (F.char_length(T.strip(F.col("line"))) <= 100) & (F.char_length(letters) > 3) & (letters == F.regexp_replace("line", r"[^\p{Lu}]", "")), T.squash(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("context", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit(vocab.TOP)))
