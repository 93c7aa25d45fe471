"""Connected components of a graph of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, cut, spread_join


def connected_components(links: DataFrame, ids: DataFrame | None = None, most_rounds: int = 60, hot: int = HOT_ROWS) -> DataFrame:
    """(node, component, component_id) for every node that ``links(u, v)`` join to another one.

    ``ids(node, id)`` has a row for each node of the links; without it, a node is its own id.
    component_id is the least id of the nodes that links reach, component the node that has it
    (the least of equals). Null ids come last: a component all of whose ids are null has a null one.

    Labels are (id, node) in that order, so the least label says both, and no join by component is
    needed. Each round takes the smallest label among a node's neighbours (one join, one
    pre-aggregated minimum), then follows labels one step (pointer jumping), so that a chain of n
    nodes needs about log n rounds. Nodes with very many neighbours, and labels that very many nodes
    share, are dealt out (``spread_join``). It ends when no label falls. An empty table gives an
    empty result; loops and repeated links don't matter.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = cut(both.where("u <> v").distinct())
    nodes = both.select(F.col("u").alias("node")).distinct()
    label = lambda i: F.struct(i.isNull().alias("none"), i.alias("id"), F.col("node").alias("at")).alias("label")
    known = nodes.select("node", label(F.col("node"))) if ids is None else nodes.join(ids.select("node", F.col("id").alias("__id")), "node").select("node", label(F.col("__id")))
    labels = cut(known)
    degrees = cut(both.groupBy(F.col("v").alias("k")).agg(F.count("*").alias("c")).where(F.col("c") > hot))
    for _ in range(most_rounds):
        near = spread_join(both, labels.withColumnRenamed("node", "n"), "v", "n", counts=degrees, hot=hot).select(F.col("u").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        lower = cut(near.unionByName(labels.withColumn("was", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")))
        own = lower.withColumn("at", F.col("label.at"))
        target = lower.select(F.col("node").alias("to"), F.col("label").alias("next"))
        jumped = cut(spread_join(own, target, "at", "to", hot=hot).select("node", F.col("next").alias("label"), (F.col("next") != F.col("was")).alias("fell")))
        labels = jumped.select("node", "label")
        if jumped.where("fell").isEmpty():
            return labels.select("node", F.col("label.at").alias("component"), F.col("label.id").alias("component_id"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
