"""Paired statistics as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ordering


def average_rank(order: Column, *by: str) -> Column:
    """Ranks in which equal values share the mean of their places, for groups of few rows: a window takes a group whole."""
    part = W.partitionBy(*by)
    return F.rank().over(part.orderBy(order)) + (F.count(F.lit(1)).over(W.partitionBy(*by, order)) - 1) / 2


def signed_sizes(pairs: DataFrame, difference: str, *by: str) -> DataFrame:
    """The distinct sizes of the non-zero differences (rounded to 12 digits) with their rank ``r``, rows ``t`` and ``plus``, the rows with a positive sign."""
    d = pairs.select(*by, F.round(difference, 12).alias("d")).where("d <> 0").select(*by, F.abs("d").alias("size"), "d")
    return ordering.ranked(ordering.counted(d, "size", *by, plus=(F.col("d") > 0).cast("long")), *by)


def wilcoxon(pairs: DataFrame, difference: str, *by: str) -> DataFrame:
    """Signed-rank sums of the non-zero differences, rank-biserial effect and normal z with tie correction.

    Equal sizes are counted, not ranked row by row, so a group is never in one task.
    """
    t, plus = F.col("t"), F.col("plus")
    sums = signed_sizes(pairs, difference, *by).groupBy(*by).agg(
        F.sum("t").alias("n"), F.sum(plus * F.col("r")).alias("w_plus"), F.sum((t - plus) * F.col("r")).alias("w_minus"), F.sum(t.cast("double") * t * t - t).alias("ties")
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    found = sums.select(
        *by, "n", "w_plus", "w_minus",
        ((F.col("w_plus") - F.col("w_minus")) / (n * (n + 1) / 2)).alias("rank_biserial"),
        ((F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.nullif(spread, F.lit(0.0))).alias("z"),
    )
    return found.where("n > 0")


def friedman(scores: DataFrame, block: str, condition: str, value: str) -> DataFrame:
    """Chi-squared with tie correction and Kendall's W over complete blocks."""
    k = scores.agg(F.count_distinct(condition).alias("k"))
    sizes = scores.groupBy(block).agg(F.count(F.lit(1)).alias("m"))
    full = scores.join(sizes, block).join(F.broadcast(k), F.col("m") == F.col("k"))
    ranked = full.select(block, condition, "k", average_rank(F.col(value), block).alias("r"), F.count(F.lit(1)).over(W.partitionBy(block, value)).alias("t"))
    columns = ranked.groupBy(condition, "k").agg(F.sum("r").alias("rj"), F.count(F.lit(1)).alias("n"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    total = columns.groupBy("k", "n").agg(F.sum(F.col("rj") * F.col("rj")).alias("squares"), F.sum("ties").alias("ties"))
    n, kk = F.col("n"), F.col("k")
    plain = 12 / (n * kk * (kk + 1)) * F.col("squares") - 3 * n * (kk + 1)
    chi = plain / (1 - F.col("ties") / (n * kk * (kk * kk - 1)))
    return total.select("n", "k", chi.alias("chi_squared")).withColumn("kendall_w", F.col("chi_squared") / (F.col("n") * (F.col("k") - 1)))


def holm(tests: DataFrame, p: str, *by: str) -> DataFrame:
    """Step-down adjustment: the running maximum of (m - rank + 1) p, at most 1."""
    order = W.partitionBy(*by).orderBy(p, "test")
    m = F.count(F.lit(1)).over(W.partitionBy(*by))
    stepped = tests.withColumn("__step", (m - F.row_number().over(order) + 1) * F.col(p))
    running = F.max("__step").over(order.rowsBetween(W.unboundedPreceding, 0))
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), running)).drop("__step")


def families(tests: DataFrame, allowed: Column, p: str) -> DataFrame:
    """``tests`` with ``family`` and ``p_holm``: confirmatory where ``allowed`` holds and adjusted among those, else exploratory and not adjusted. A null gate does not open."""
    named = tests.withColumn("family", F.when(F.coalesce(allowed, F.lit(False)), "confirmatory").otherwise("exploratory"))
    adjusted = holm(named, p, "family")
    return adjusted.withColumn("p_holm", F.when(F.col("family") == "confirmatory", F.col("p_holm")))


def spearman(pairs: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Rank correlation. Rows alike in both values are one, with a weight; ranks of either value come from counts."""
    both = pairs.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    alike = both.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("m"))
    ranks = {c: ordering.ranked(ordering.counted(both, c, *by), *by).select(*by, F.col("v").alias(c), F.col("r").alias(f"r{c}")) for c in ("x", "y")}
    met = ordering.beside(ordering.beside(alike, ranks["x"], *by, "x"), ranks["y"], *by, "y")
    m, rx, ry, n = F.col("m"), F.col("rx"), F.col("ry"), F.col("n").cast("double")
    # The mean of either's ranks is (n + 1) / 2.
    sums = met.groupBy(*by).agg(F.sum("m").alias("n"), F.sum(m * rx * ry).alias("xy"), F.sum(m * rx * rx).alias("xx"), F.sum(m * ry * ry).alias("yy"))
    middle = n * (n + 1) * (n + 1) / 4
    rho = (F.col("xy") - middle) / F.nullif(F.sqrt((F.col("xx") - middle) * (F.col("yy") - middle)), F.lit(0.0))
    return sums.select(*by, "n", rho.alias("rho"))


def largest_remainder(strata: DataFrame, size: str, total: int) -> DataFrame:
    """Shares of ``total`` in proportion to ``size``, remainders to the largest fractions, then the largest and last stratum."""
    everything = W.partitionBy()
    exact = F.col(size) * F.lit(total) / F.sum(size).over(everything)
    shared = strata.withColumn("__exact", exact).withColumn("share", F.floor("__exact"))
    left = F.lit(total) - F.sum("share").over(everything)
    place = F.row_number().over(W.orderBy(F.desc(F.round(F.col("__exact") - F.col("share"), 9)), F.desc(size), F.desc("stratum")))
    return shared.withColumn("share", (F.col("share") + F.when(place <= left, 1).otherwise(0)).cast("long")).drop("__exact")
