"""Spot checks of chunked documents: an anchor, the window around it, the chunks seen there, and what the anchor cites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pools an anchor is taken from, the first that is not empty: has a parent and cites, cites, has a parent, any.
POOLS = ("parent_and_edges", "edges", "parent", "any")


def anchors(docs: DataFrame, chunks: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    """``doc, anchor, pool, center, low, high``: of each document's first pool that is not empty the chunk nearest its middle, and the window around it.

    ``docs`` has ``doc, length``, ``chunks`` ``doc, chunk_id, start, stop, parent``, ``edges``
    ``doc, chunk_id, target``. Pools are a rank, so one minimum finds both; ties go by
    chunk id. Documents without chunks have no anchor.
    """
    cites = edges.select("doc", "chunk_id").distinct().withColumn("cites", F.lit(True))
    rows = chunks.join(cites, ["doc", "chunk_id"], "left").join(docs, "doc")
    has, points = F.col("parent").isNotNull(), F.coalesce("cites", F.lit(False))
    tier = F.when(has & points, 0).when(points, 1).when(has, 2).otherwise(3)
    center = F.floor((F.col("start") + F.col("stop")) / 2)
    order = F.struct(tier.alias("tier"), F.abs(center - F.floor(F.col("length") / 2)).alias("off"), "chunk_id", center.alias("center"))
    best = rows.groupBy("doc").agg(F.min(order).alias("b"), F.first("length").alias("length"))
    low, high = F.greatest(F.col("b.center") - radius, F.lit(0)), F.least(F.col("b.center") + radius, F.col("length"))
    return best.select("doc", F.col("b.chunk_id").alias("anchor"), F.element_at(F.array(*map(F.lit, POOLS)), F.col("b.tier") + 1).alias("pool"), F.col("b.center").alias("center"), low.alias("low"), high.alias("high"))


def tracks(chunks: DataFrame, anchored: DataFrame) -> DataFrame:
    """The chunks (``config, doc, chunk_id, start, stop``) seen in their document's window, where in it in percent, and of each configuration the shortest that holds the center."""
    seen = chunks.join(anchored, "doc").where("start < high AND low < stop")
    holds = F.when(F.col("center").between(F.col("start"), F.col("stop")), F.struct(F.col("stop") - F.col("start"), "chunk_id"))
    holders = seen.groupBy("config", "doc").agg(F.min(holds)["chunk_id"].alias("holder"))
    left, size = F.greatest("start", "low"), F.col("high") - F.col("low")
    return seen.join(holders, ["config", "doc"]).select(
        "doc", "anchor", "pool", "config", "chunk_id", F.coalesce(F.col("chunk_id") == F.col("holder"), F.lit(False)).alias("holds_center"),
        (100.0 * (left - F.col("low")) / size).alias("left_percent"), (100.0 * (F.least("stop", "high") - left) / size).alias("width_percent"),
    )


def cited(anchored: DataFrame, chunks: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc, anchor, parent, target, in_window``: each chunk of ``targets`` that an anchor cites, once."""
    own = anchored.join(chunks.select("doc", F.col("chunk_id").alias("anchor"), "parent"), ["doc", "anchor"])
    met = own.join(edges.select("doc", F.col("chunk_id").alias("anchor"), "target").distinct(), ["doc", "anchor"])
    found = met.join(targets.select("doc", F.col("chunk_id").alias("target"), "start", "stop"), ["doc", "target"])
    return found.select("doc", "anchor", "parent", "target", ((F.col("start") < F.col("high")) & (F.col("low") < F.col("stop"))).alias("in_window"))
