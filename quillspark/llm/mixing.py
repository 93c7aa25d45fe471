"""Mixing sources to target weights: repetition rates from token totals, then hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, NOT_SPACE, cut, table

#: By rank of the source name in code-point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: A source is repeated at most so many times.
CAP = 3
SEED = "quillspark-mix"
#: Bits of the hash that a Bernoulli draw uses; exact in a double.
DRAW_BITS = 48


def word_count(text: Column) -> Column:
    """Words of a text (null: 0), counted without building them: word characters that end a word."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) of ``source`` by code point, null last, without a one-task window.

    Rows are range-partitioned and sorted; a partition's rows are then numbered from the
    count of rows before it. Only one count per partition reaches the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    lined = cut(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, before, starts = F.shiftright("at", 33), 0, []
    for row in lined.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts += [F.lit(row["p"]), F.lit(before)]
        before += row["n"]
    start = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return lined.withColumn("rank", (start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("at")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of ``sizes(source, size)``.

    Targets share the sum of all sizes by weight. One that would pass ``cap`` times its
    source's size stops there, and the excess is shared again by weight, until none is
    above. Each round is one aggregation over a table with a row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.array(*[F.lit(w) for w in weights])
    known = cut(ranked(per_source).withColumn("weight", F.element_at(order, (F.col("rank") % len(weights) + 1).cast("int")).cast("long")))
    capped, was = F.lit(False), -1
    while True:
        n, total, fixed, rest = known.agg(
            F.count(F.when(capped, 1)),
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(capped, cap * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        if n == was or not rest:
            break
        was, left = n, total - fixed
        # exact: weight * left against cap * size * rest, as decimals
        capped = (F.col("weight").cast("decimal(38,0)") * F.lit(str(left)).cast("decimal(20,0)") > F.col("source_size").cast("decimal(20,0)") * F.lit(str(cap * rest)).cast("decimal(18,0)")) if left else F.lit(True)
    shared = (F.col("weight") * F.lit(total - fixed)).cast("double") / F.lit(rest or 1).cast("double")
    return known.select("source", F.col("source_size").cast("long").alias("source_size"), F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(shared).alias("target"))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id, the text and the seed only: rows without an id, or with the id of another, draw by their text."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}:"), F.coalesce(F.md5(text), F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, DRAW_BITS // 4), 16, 10).cast("double") / F.lit(float(1 << DRAW_BITS))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(row, size, source_size, target, copies): ``row`` holds every column of a row of ``docs``, whatever their names.

    copies is floor(rate) plus one more with probability rate - floor(rate), rate being the
    source's target over its size. Null texts have size 0, very long ones count whole, a null source is a source of its
    own, rows that are equal in id and text draw alike, and an empty table gives no rows.
    """
    sized = docs.select(F.struct(*docs.columns).alias("row")).withColumn("size", word_count(F.col("row.text")))
    targets = cut(source_targets(sized.select(F.col("row.source").alias("source"), "size")))
    if targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # a row per source
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col("row.source").eqNullSafe(targets["source"]), "left")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(1.0))
    whole = F.floor(rate)
    extra = F.when(draw(F.col("row.doc_id"), F.col("row.text"), seed) < rate - whole, 1).otherwise(0)
    return joined.select("row", "size", "source_size", "target", (whole + extra).cast("int").alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """Each row, with its own columns, as many times as the mix takes it."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


#: The water level by prefix sums: sources in order of cap by weight; the first that stays below its cap ends the capped ones.
OP7_SQL = rf"""
with d as (
  select doc_id, source, coalesce(md5(text), '') as said, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size from d group by source
), w as (
  select *, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)}] as weight from s
), p as (
  select *, sum(source_size) over () as total, sum(weight) over () as all_weight,
    coalesce(sum({CAP} * source_size) over before, 0) as capped_size, coalesce(sum(weight) over before, 0) as capped_weight
  from w window before as (order by source_size * 1.0 / weight, source nulls last rows between unbounded preceding and 1 preceding)
), l as (
  select cast(total - capped_size as bigint) as left_over, cast(all_weight - capped_weight as bigint) as rest from p
  where weight * (total - capped_size) <= {CAP} * source_size * (all_weight - capped_weight)
  order by source_size * 1.0 / weight, source nulls last limit 1
), t as (
  select source, source_size, case when weight * left_over > {CAP} * source_size * rest then cast({CAP} * source_size as double)
    else cast(weight * left_over as double) / cast(rest as double) end as target
  from w, l
), r as (
  select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then least(t.target / t.source_size, {float(CAP)}) else 1.0 end as rate,
    cast(cast('0x' || substr(md5(coalesce(cast(d.doc_id as varchar), 'null') || ':{SEED}:' || d.said), 1, {DRAW_BITS // 4}) as bigint) as double) / {float(1 << DRAW_BITS)} as draw
  from d join t on d.source is not distinct from t.source
), c as (
  select *, cast(floor(rate) as integer) + case when draw < rate - floor(rate) then 1 else 0 end as copies from r
)
select doc_id, size, source_size, target, cast(size * copies as bigint) as taken, cast(copies as integer) as copies from c
"""
