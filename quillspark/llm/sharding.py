"""Extendible hashing: buckets are hash prefixes, and only oversized buckets split on another bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, small, table

#: Bytes of text that a shard may hold.
LIMIT_BYTES = 16 << 20
#: Hash bits in use, and how many more are looked at in one round of splits.
BITS, STEP = 60, 10
ADDED = ["shard", "shard_bytes", "shard_items", "shard_page"]


def hash_bits(doc_id: Column) -> Column:
    """The first 60 bits of the id's MD5 as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def prefix(bits: Column, depth: Column | int, of: int = BITS) -> Column:
    """The first ``depth`` bits of ``bits``, which has ``of`` bits."""
    return F.call_function("shiftright", bits, (F.lit(of) - (depth if isinstance(depth, Column) else F.lit(depth))).cast("int"))


def directory(cells: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(depth, prefix, bytes, items): the buckets, for ``cells(bits, bytes)``.

    A round looks at the next ten bits of what is still oversized: sizes are summed in
    cells of that depth (pre-aggregated), rolled up to each depth between, and a bucket
    stays at the first depth where it fits. Only rows of cells that fit nowhere go on to
    the next round. A bucket of one hash can't split: it ends at the last depth.
    """
    found, depth, rows = None, 0, cells
    while True:
        low, high = depth + (depth > 0), min(depth + STEP, BITS)
        fine = cut(rows.groupBy(prefix(F.col("bits"), high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("items")))
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", prefix(F.col("cell"), F.col("depth"), high))
        sums = cut(levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("items").alias("items")))
        over = sums.where(F.col("bytes") > limit)
        leaf = sums.where((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        split = over.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        leaf = leaf.where(F.col("depth") == low).unionByName(leaf.where(F.col("depth") > low).join(split, ["depth", "prefix"], "left_semi"))
        found = leaf if found is None else found.unionByName(leaf)
        deep = over.where(F.col("depth") == high).select(F.col("prefix").alias("cell"))
        if high == BITS or deep.isEmpty():
            return cut(found)
        rows = cut(rows.withColumn("cell", prefix(F.col("bits"), high)).join(small(deep), "cell", "left_semi").drop("cell"))
        depth = high


def shard(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``shard`` (its bucket's bits as 0s and 1s), its bytes and items, and ``shard_page``.

    Columns of ``docs`` by those names give way; others pass through, whatever their names. Null texts weigh 0 bytes, very
    long ones their whole length; null ids hash alike; an empty table
    gives no rows. Rows that share an id share all bits: such a bucket above the limit is
    chained in pages of at most ``limit`` bytes (or of one row, if that alone is larger);
    else the page is 0.

    The directory has a row for each bucket, which grows with the data: it is looked up by
    a join on its shallowest depth, broadcast only after counting its buckets.
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    rows = docs.select(F.struct(*kept).alias("row")).withColumns({"bits": hash_bits(F.col("row.doc_id")), "bytes": text_bytes(F.col("row.text"))})
    leaves = directory(cut(rows.select("bits", "bytes")), limit)
    root, chained = leaves.agg(F.coalesce(F.min("depth"), F.lit(0)), F.count(F.when((F.col("bytes") > limit) & (F.col("items") > 1), 1))).first()
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    under = leaves.groupBy(F.call_function("shiftright", F.col("prefix"), (F.col("depth") - root).cast("int")).alias("root")).agg(
        F.collect_list(F.struct("depth", "prefix", name.alias("shard"), F.col("bytes").alias("shard_bytes"), F.col("items").alias("shard_items"))).alias("leaves")
    )
    few = leaves.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # of buckets: a row of ``under`` holds many
    found = rows.withColumn("root", prefix(F.col("bits"), root)).join(F.broadcast(under) if few else under, "root", "left")
    own = F.filter(F.col("leaves"), lambda x: prefix(F.col("bits"), x["depth"]) == x["prefix"])[0]
    found = found.withColumn("own", own).select("row", "bytes", "own.shard", "own.shard_bytes", "own.shard_items")
    zero = F.lit(0).cast("long").alias("shard_page")
    if not chained:
        return found.select("row.*", *ADDED[:3], zero)
    chain = (F.col("shard_bytes") > limit) & (F.col("shard_items") > 1)
    return _paged(found.where(chain), limit).unionByName(found.where(~chain).select("row.*", *ADDED[:3], zero))


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of buckets of one id: what lies before a row, counted by part and then within the part, so that no task holds a bucket.

    A row of over half the limit has a page of its own. Of the others, those that begin within the same stretch of
    ``limit`` less the largest of them share a page, which leaves none but the last less than half full.
    """
    large = F.col("bytes") * 2 > limit
    parts = cut(rows.withColumns({"part": F.spark_partition_id(), "large": large, "small": F.when(large, 0).otherwise(F.col("bytes"))}))
    sums = parts.groupBy("shard", "part").agg(F.sum("small").alias("sum"), F.max("small").alias("most"), F.count_if("large").alias("n"))
    whole, before = Window.partitionBy("shard"), Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "part", F.max("most").over(whole).alias("most"), F.sum("n").over(whole).alias("all_large"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("large_before"))
    up_to = Window.partitionBy("shard", "part").orderBy("large", F.xxhash64("row.text")).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({"at": F.coalesce(F.sum("small").over(up_to), F.lit(0)), "nth": F.coalesce(F.count_if("large").over(up_to), F.lit(0))})
    placed = placed.join(small(cut(sums)), ["shard", "part"])
    page = F.when(F.col("large"), F.col("nth") + F.col("large_before")).otherwise(F.col("all_large") + F.floor((F.col("at") + F.col("bytes_before")) / F.greatest(F.lit(limit) - F.col("most"), F.lit(1))))
    return placed.withColumn("shard_page", page.cast("long")).select("row.*", *ADDED)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharded.select("doc_id", text_bytes(F.col("text")).alias("bytes"), *ADDED)


def op10_sql(limit: int = LIMIT_BYTES) -> str:
    """A row's bucket is the shortest prefix whose rows fit: sums fall with depth."""
    return f"""
with d as (
  select doc_id, coalesce(strlen(text), 0) as bytes, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, {BITS // 4}) as bigint) as bits from documents
), n as (select unnest(range(0, {BITS + 1})) as depth),
b as (select depth, bits >> ({BITS} - depth) as prefix, sum(bytes) as bytes, count(*) as items from d, n group by 1, 2),
x as (
  select d.doc_id, d.bytes, d.bits, b.depth, b.prefix, b.bytes as shard_bytes, b.items as shard_items,
    row_number() over (partition by d.rowid_ order by case when b.bytes <= {limit} or b.depth = {BITS} then 0 else 1 end, b.depth) as k
  from (select *, row_number() over () as rowid_ from d) d, b where b.prefix = d.bits >> ({BITS} - b.depth)
)
select doc_id, cast(bytes as bigint) as bytes, case when depth = 0 then '' else lpad(bin(prefix), cast(depth as integer), '0') end as shard,
  cast(shard_bytes as bigint) as shard_bytes, cast(shard_items as bigint) as shard_items, cast(0 as bigint) as shard_page
from x where k = 1
"""


OP10_SQL = op10_sql()
