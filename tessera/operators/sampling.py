"""Stratified samples: how many rows each stratum gives, solved over counts, and which rows those are.

Allocation sees one row a stratum. Picking takes the rows of least digests of a seed
and the row's key; digests are dealt by their first digits, and only the parts that
the share reaches are put in order, so a stratum with most of the rows is many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def condition_targets(strata: DataFrame, size: int, *, common: str = "high") -> DataFrame:
    """``condition, target``: ``size`` over conditions in proportion to their rows.

    ``strata`` has ``condition, band, n``. What rounding down leaves goes to the largest
    fractions, then to the conditions with most rows outside the ``common`` band, then
    to the largest, then to the last by name.
    """
    every = W.partitionBy()
    n = F.sum("n").alias("n")
    sums = strata.groupBy("condition").agg(n, F.sum(F.when(F.col("band") != common, F.col("n")).otherwise(0)).alias("rare"))
    raw = F.lit(size) * F.col("n") / F.sum("n").over(every)
    shared = sums.withColumn("raw", raw).withColumn("target", F.floor("raw"))
    place = F.row_number().over(W.orderBy(F.desc(F.col("raw") - F.col("target")), F.desc("rare"), F.desc("n"), F.desc("condition")))
    left = F.lit(size) - F.sum("target").over(every)
    return shared.select("condition", (F.col("target") + F.when(place <= left, 1).otherwise(0)).alias("target"))


def band_shares(strata: DataFrame, targets: DataFrame) -> DataFrame:
    """``condition, band, n, share``: a condition's target over its bands, at least one each, the rest in proportion to what is left of each.

    A target below the number of bands gives one each to the smallest bands, by name
    among equals. What rounding down leaves goes to the largest fractions, then to the
    bands with most left, then to the last by name; a full band is passed over.
    """
    own = W.partitionBy("condition")
    rows = strata.where("n > 0").join(targets, "condition").withColumn("bands", F.count(F.lit(1)).over(own)).withColumn("free", F.col("n") - 1)
    smallest = F.row_number().over(own.orderBy("n", "band"))
    rest, all_free = F.col("target") - F.col("bands"), F.sum("free").over(own)
    raw = F.when(all_free > 0, F.greatest(rest, F.lit(0)) * F.col("free") / all_free).otherwise(0.0)
    rows = rows.withColumn("smallest", smallest).withColumn("rest", F.when(all_free > 0, F.greatest(rest, F.lit(0))).otherwise(0)).withColumn("raw", raw)
    rows = rows.withColumn("added", F.least("free", F.floor("raw")))
    open_ = F.col("added") < F.col("free")
    order = W.partitionBy("condition", "open").orderBy(F.desc(F.col("raw") - F.col("added")), F.desc("free"), F.desc("band"))
    rows = rows.withColumn("open", open_).withColumn("place", F.row_number().over(order)).withColumn("left", F.col("rest") - F.sum("added").over(own))
    more = F.when(F.col("open") & (F.col("place") <= F.col("left")), 1).otherwise(0)
    share = F.when(F.col("bands") > F.col("target"), F.when(F.col("smallest") <= F.col("target"), 1).otherwise(0)).otherwise(1 + F.col("added") + more)
    return rows.select("condition", "band", "n", share.cast("long").alias("share"))


def allocation(strata: DataFrame, size: int, *, common: str = "high") -> DataFrame:
    """``condition, band, n, share`` of a sample of ``size``: targets by condition, then shares by band."""
    return band_shares(strata, condition_targets(strata, size, common=common))


def picked(rows: DataFrame, shares: DataFrame, key: Column, *by: str) -> DataFrame:
    """The rows of the ``share`` least digests of ``key`` in each stratum ``by``; keys are meant to be distinct within a stratum.

    ``shares`` has ``*by, share``. A stratum of no more rows than its share comes whole.
    """
    digest = F.md5(key.cast("string"))
    dealt = rows.withColumn("__h", digest).withColumn("__part", F.substring("__h", 1, 2))
    before = F.sum("__m").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    parts = dealt.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__m")).select(*by, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    reached = parts.join(shares.select(*by, "share"), list(by)).where("__before < share")
    place = F.row_number().over(W.partitionBy(*by, "__part").orderBy("__h"))
    found = dealt.join(reached, [*by, "__part"]).withColumn("__place", F.col("__before") + place)
    return found.where(F.col("__place") <= F.col("share")).select(*rows.columns)
