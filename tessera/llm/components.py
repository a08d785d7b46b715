"""Connected components by alternating large and small stars, as joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def parts_of(df: DataFrame) -> int:
    """Into so many parts a group's rows are dealt, so that one key with most of the rows is no task of its own: as many as the cluster shuffles into."""
    return max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` and, as ``name``, the least ``value`` among the rows of the same ``key``.

    A key's rows are dealt into parts by their values; the least of each part is
    found first, and the key's least goes back to the parts that exist. So neither
    the aggregate nor the join has all rows of a key in one task.
    """
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(value), F.lit(parts_of(rows))).cast("int"))
    parts = dealt.groupBy(key, "__part").agg(F.min(value).alias("__least"))
    least = parts.groupBy(key).agg(F.min("__least").alias(name), F.collect_set("__part").alias("__parts"))
    return dealt.join(least.select(key, name, F.explode("__parts").alias("__part")), [key, "__part"]).drop("__part")


def connected(edges: DataFrame) -> DataFrame:
    """``v, root`` for every end of ``edges`` (``a, b``, any order, repeats allowed); ``root`` is the component's least vertex.

    A large star hangs the neighbours above a vertex on the least neighbour, a
    small star those below it; both keep components and together end in stars,
    after a number of rounds that grows with the logarithm of the size. Each
    round is written to the shared folder and replaces the one before. The
    neighbours of one vertex are never all in one task.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = stash(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    seen = _fingerprint(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, "a", "b", "m").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        small = with_least(large, "a", "b", "m")
        ends = F.when(F.col("b") == F.col("m"), F.struct(F.col("a").alias("a"), F.col("m").alias("b"))).otherwise(F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        after = stash(small.select(ends.alias("e")).select("e.a", "e.b").distinct(), "edges")
        unstash(now)
        now, before, seen = after, seen, _fingerprint(after)
        if seen == before:
            break
    roots = now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h
