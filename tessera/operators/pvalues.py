"""P-values in closed form, and grouped operators that use them. A group is one contrast, whose rows are the paired queries."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordering, stats


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_tail(x: float, df: int) -> float:
    """P(X >= x) for a whole number of degrees of freedom, as the finite sums for even and odd numbers."""
    half = x / 2
    if df % 2 == 0:
        return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(df // 2))
    return math.erfc(math.sqrt(half)) + math.exp(-half) * sum(half ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (df - 1) // 2 + 1))


def sign_flip_p(ranks: list[float], w_plus: float) -> float:
    """Two-sided exact p over all signs of the ranks; doubled ranks are whole numbers, so sums are counted by subset."""
    counts = Counter({0: 1})
    for r in ranks:
        step, grown = round(2 * r), Counter(counts)
        for s, c in counts.items():
            grown[s + step] += c
        counts = grown
    seen, every = round(2 * w_plus), 2 ** len(ranks)
    low, high = sum(c for s, c in counts.items() if s <= seen), sum(c for s, c in counts.items() if s >= seen)
    return min(1.0, 2 * min(low, high) / every)


#: Up to so many differences p is exact over all signs: with ties among their sizes, and without.
EXACT_TIED, EXACT = 20, 50


def signed_rank_tests(pairs: DataFrame, difference: str, *by: str) -> DataFrame:
    """Wilcoxon's test of paired differences: ``*by, n, w_plus, w_minus, rank_biserial, p, method``, a row for every group.

    Zeros after rounding to twelve digits are dropped; a group of zeros has p 1.
    With ties and at most 20 differences p is exact over signs; with ties and more it
    is normal with tie correction; without ties it is exact up to 50 and normal beyond.
    Ranks of a group are gathered only where p is exact, so there are 50 of them at most.
    """
    tied = F.max("t") > 1
    n = F.sum("t")
    exact = F.when(tied, n <= EXACT_TIED).otherwise(n <= EXACT)
    few = stats.signed_sizes(pairs, difference, *by).where(F.col("n") <= EXACT).groupBy(*by).agg(exact.alias("exact"), F.flatten(F.collect_list(F.array_repeat("r", F.col("t").cast("int")))).alias("ranks"))
    sums = stats.wilcoxon(pairs, difference, *by)

    @F.pandas_udf("double")
    def p_value(exact: pd.Series, ranks: pd.Series, w_plus: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([sign_flip_p(list(r), w) if e else normal_two_sided(x) for e, r, w, x in zip(exact, ranks, w_plus, z, strict=True)])

    groups = pairs.select(*by).distinct()
    found = ordering.beside(ordering.beside(groups, sums, *by, how="left"), few, *by, how="left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    none, zero = F.col("n").isNull(), F.lit(0.0)
    p = p_value("exact", F.coalesce("ranks", F.array().cast("array<double>")), F.coalesce("w_plus", zero), F.coalesce("z", zero))
    return found.select(
        *by, F.coalesce("n", F.lit(0)).alias("n"), *(F.coalesce(c, zero).alias(c) for c in ("w_plus", "w_minus", "rank_biserial")),
        F.when(none, F.lit(1.0)).otherwise(p).alias("p"), F.when(none, "none").when(F.col("exact"), "exact").otherwise("normal").alias("method"),
    )


def friedman_p(found: DataFrame) -> DataFrame:
    """Adds ``p`` to the one row of :func:`tessera.operators.stats.friedman`."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chi_squared_tail(a, int(b) - 1) for a, b in zip(x, k, strict=True)])

    return found.withColumn("p", tail("chi_squared", "k"))
