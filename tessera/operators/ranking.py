"""Ranked lists, answer units and information-retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "f1", "r_precision", "mrr", "ndcg")


def ranked_units(hits: DataFrame, *by: str) -> DataFrame:
    """``by..., unit, unit_rank``: units of ranked hits (``rank, unit``), first occurrence kept, renumbered from 1."""
    first = hits.groupBy(*by, "unit").agg(F.min("rank").alias("first"))
    return first.select(*by, "unit", F.row_number().over(W.partitionBy(*by).orderBy("first", "unit")).alias("unit_rank"))


def _asked(gold: DataFrame, units: DataFrame, by: tuple[str, ...], asked: DataFrame | None) -> DataFrame:
    """``by..., n_gold``: the queries that are scored, each with gold. Beyond the query, what is scored must be told, or is what has units."""
    sizes = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    if asked is None:
        rest = [c for c in by if c != "query_id"]
        asked = units.select(*by).distinct() if rest else sizes.select("query_id")
    return asked.select(*by).join(sizes, "query_id")


def ir_metrics(units: DataFrame, gold: DataFrame, *by: str, asked: DataFrame | None = None) -> DataFrame:
    """The six metrics per query from deduplicated ranked units and gold (``query_id, unit``).

    Precision divides by the units found, r-precision by the number of gold units,
    and the ideal gain has as many hits as gold and units allow. Every query with
    gold is scored, those without units 0. Where ``by`` has more than the query,
    ``asked`` lists what is scored (``by...``); without it, that is what has units.
    """
    marked = units.join(gold.select("query_id", "unit", F.lit(1.0).alias("hit")), ["query_id", "unit"], "left").fillna({"hit": 0.0})
    scored = _asked(gold, units, by, asked)
    place = F.col("unit_rank")
    per = marked.join(scored, list(by)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.sum("hit").alias("hits"),
        F.sum(F.when(place <= F.col("n_gold"), F.col("hit")).otherwise(0.0)).alias("early"),
        F.min(F.when(F.col("hit") > 0, place)).alias("first"),
        F.sum(F.col("hit") / F.log2(place + 1)).alias("dcg"),
    )
    per = scored.join(per, list(by), "left").fillna({"n_units": 0, "hits": 0.0, "early": 0.0, "dcg": 0.0})
    return _rated(per, *by)


def _rated(per: DataFrame, *by: str) -> DataFrame:
    """The six metrics from ``n_gold, n_units, hits, early, first, dcg``."""
    ideal = F.expr("aggregate(sequence(1, cast(least(n_gold, n_units) AS int)), 0D, (s, i) -> s + 1 / log2(i + 1))")
    found = F.col("n_units") > 0
    p, r = F.col("precision"), F.col("recall")
    rated = per.select("*", F.when(found, F.col("hits") / F.col("n_units")).otherwise(0.0).alias("precision"), (F.col("hits") / F.col("n_gold")).alias("recall"))
    return rated.select(
        *by, "n_gold", "n_units", "precision", "recall",
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        (F.col("early") / F.col("n_gold")).alias("r_precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(found, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


def rescored(stored: DataFrame, gold: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """``k, query_id`` and the six metrics of stored rankings (``query_id, rank, units``) at each cut-off, for queries with gold; no search is made.

    A unit is in every cut that reaches its first rank, and the units before it are
    too, so its place is the same in all of them: units are placed once, beside the
    gold of their query, and a query's sums for all cut-offs are one row.
    """
    hits = stored.select("query_id", "rank", F.explode_outer(F.when(F.col("rank") <= max(cuts), F.col("units"))).alias("unit"))
    ranks = hits.select("query_id", "unit", F.when(F.col("unit").isNotNull(), F.col("rank")).alias("rank"), F.lit(1).alias("asked"), F.lit(0.0).alias("hit"))
    wanted = gold.select("query_id", "unit", F.lit(None).cast(dict(stored.dtypes)["rank"]).alias("rank"), F.lit(0).alias("asked"), F.lit(1.0).alias("hit"))
    # A fixed number of parts, which are not put together again: several sorts and sums of one part are in memory at a time.
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ranks.unionByName(wanted).where("query_id is not null").repartition(parts, "query_id")
    each = rows.groupBy("query_id", "unit").agg(F.min("rank").alias("first"), F.max("asked").alias("asked"), F.max("hit").alias("hit"))
    whole = W.partitionBy("query_id")
    placed = each.withColumns({"place": F.row_number().over(whole.orderBy(F.asc_nulls_last("first"), "unit")), "n_gold": F.sum("hit").over(whole).cast("long")})
    place, hit = F.col("place"), F.col("hit")

    def sums(k: int) -> list:
        inside = F.col("first") <= k
        return [
            F.count_if(inside).alias(f"n_units_{k}"),
            F.sum(F.when(inside, hit).otherwise(0.0)).alias(f"hits_{k}"),
            F.sum(F.when(inside & (place <= F.col("n_gold")), hit).otherwise(0.0)).alias(f"early_{k}"),
            F.min(F.when(inside & (hit > 0), place)).alias(f"first_{k}"),
            F.sum(F.when(inside, hit / F.log2(place + 1)).otherwise(0.0)).alias(f"dcg_{k}"),
        ]

    per = placed.groupBy("query_id").agg(F.max("asked").alias("asked"), F.max("n_gold").alias("n_gold"), *(c for k in cuts for c in sums(k))).where("asked = 1 and n_gold > 0")
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"{n}_{k}").alias(n) for n in ("n_units", "hits", "early", "first", "dcg"))) for k in cuts))).alias("at")
    return _rated(per.select("query_id", "n_gold", at).select("query_id", "n_gold", "at.*"), "k", "query_id")


def modified_metrics(hits: DataFrame, gold: DataFrame, k: int, *by: str, asked: DataFrame | None = None) -> DataFrame:
    """The published convention: units are not deduplicated but cut to ``k``.

    Precision is the distinct hits over the least of k and the gold; recall the hits
    over the least of k and the units given; the ideal gain sorts the list's own hits.
    Queries are scored as in :func:`ir_metrics`, those without units 0.
    """
    place = F.row_number().over(W.partitionBy(*by).orderBy("rank", "unit"))
    given = hits.withColumn("place", place).where(F.col("place") <= k)
    marked = given.join(gold.select("query_id", "unit", F.lit(1.0).alias("hit")), ["query_id", "unit"], "left").fillna({"hit": 0.0})
    per = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_given"),
        F.sum("hit").alias("hits"),
        F.count_distinct(F.when(F.col("hit") > 0, F.col("unit"))).alias("distinct_hits"),
        F.sum(F.col("hit") / F.log2(F.col("place") + 1)).alias("dcg"),
    )
    per = _asked(gold, hits, by, asked).join(per, list(by), "left").fillna({"n_given": 0, "hits": 0.0, "distinct_hits": 0, "dcg": 0.0})
    p = F.col("distinct_hits") / F.least(F.lit(k), F.col("n_gold"))
    r = F.when(F.col("n_given") > 0, F.col("hits") / F.least(F.lit(k), F.col("n_given"))).otherwise(0.0)
    ideal = F.expr("CASE WHEN hits > 0 THEN aggregate(sequence(1, cast(hits AS int)), 0D, (s, i) -> s + 1 / log2(i + 1)) END")
    return per.select(
        *by, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg")
    )
