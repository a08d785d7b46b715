"""Exact ranks and quantiles of groups of any size, from counts over cells of values.

A value's place among its group's follows from counts: how many lie in lower cells,
and how many below it in its own. Cells are a fixed, monotone function of the value
(steps of its logarithm, each cut into equal parts), so no pass is needed to find them,
every plan that uses them sees the same ones, and windows run over cells, which are
bounded in number, or over the distinct values of one cell. No window holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sizes below the first lie in the steps around zero, those above the second in the outermost; steps per unit of the natural logarithm; cells of a step.
_UNIT, _LARGE, _STEPS, _CELLS = 1e-9, 1e298, 16, 4096


def _step(v: Column) -> Column:
    size = F.floor(F.log1p(F.least(F.abs(v), F.lit(_LARGE)) / _UNIT) * _STEPS)
    return F.when(v < 0, -size - 1).otherwise(size)


def _cell(v: Column, step: Column) -> Column:
    """The part of its step a value lies in, rising with the value; what rounding puts outside is moved to the ends."""
    low = F.when(step < 0, -step - 1).otherwise(step)
    start, end = F.expm1(low / _STEPS) * _UNIT, F.expm1((low + 1) / _STEPS) * _UNIT
    part = F.floor((F.least(F.abs(v), F.lit(_LARGE)) - start) / (end - start) * _CELLS)
    inside = F.greatest(F.lit(0), F.least(F.lit(_CELLS - 1), part))
    return F.when(v < 0, _CELLS - 1 - inside).otherwise(inside)


def beside(left: DataFrame, right: DataFrame, *by: str, how: str = "inner") -> DataFrame:
    """The rows of ``left`` with the other columns of ``right`` where ``by`` is equal; nulls equal each other."""
    other = right.select(*(F.col(c).alias(f"__{c}") for c in by), *(c for c in right.columns if c not in by))
    met = F.lit(True)
    for c in by:
        met = met & left[c].eqNullSafe(other[f"__{c}"])
    return left.join(other, met, how).drop(*(f"__{c}" for c in by))


def counted(rows: DataFrame, value: str, *by: str, **sums: Column) -> DataFrame:
    """``*by, v, t`` and ``sums``: each distinct value of a group, as a double, and how many rows have it. Null and NaN are left out."""
    return rows.select(*by, F.col(value).cast("double").alias("v"), *(c.alias(n) for n, c in sums.items())).where("v is not null and not isnan(v)").withColumn("v", F.col("v") + 0.0).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("t"), *(F.sum(n).alias(n) for n in sums))


def _celled(values: DataFrame) -> DataFrame:
    return values.withColumn("step", _step(F.col("v"))).withColumn("cell", _cell(F.col("v"), F.col("step")))


def _cells(values: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``*by, step, cell, m, before, n``: rows of each cell, rows of the group below it, and rows of the group."""
    cells = values.groupBy(*by, "step", "cell").agg(F.sum("t").alias("m"))
    below = lambda *keys: W.partitionBy(*by, *keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    steps = cells.groupBy(*by, "step").agg(F.sum("m").alias("m"))
    steps = steps.select(*by, "step", F.coalesce(F.sum("m").over(below("step")), F.lit(0)).alias("lower"), F.sum("m").over(W.partitionBy(*by)).alias("n"))
    inner = cells.withColumn("inner", F.coalesce(F.sum("m").over(below("step", "cell")), F.lit(0)))
    return beside(inner, steps, *by, "step").select(*by, "step", "cell", "m", (F.col("lower") + F.col("inner")).alias("before"), "n")


def _placed(values: DataFrame, cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    inside = W.partitionBy(*by, "step", "cell").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    own = values.withColumn("inner", F.coalesce(F.sum("t").over(inside), F.lit(0)))
    return beside(own, cells.select(*by, "step", "cell", "before", "n"), *by, "step", "cell").withColumn("before", F.col("before") + F.col("inner")).drop("inner", "step", "cell")


def ranked(values: DataFrame, *by: str) -> DataFrame:
    """The rows of :func:`counted` with ``before`` (rows of the group below the value), ``n`` (rows of the group) and ``r``, the mean of the places that equal values share."""
    if not by:
        return ranked(values.withColumn("__all", F.lit(0)), "__all").drop("__all")
    values = _celled(values)
    placed = _placed(values, _cells(values, by), by)
    return placed.withColumn("r", F.col("before") + (F.col("t") + 1) / 2)


def quantiles(rows: DataFrame, value: str, wanted: dict[str, float], *by: str) -> DataFrame:
    """``*by`` and a column for each of ``wanted``: exact quantiles, interpolated between neighbours.

    The cells that hold the wanted places are found from the counts of all cells, and
    only their values are put in order. Groups without a value have no row; without
    ``by`` there is one row, of nulls where there is no value.
    """
    if not by:
        found = quantiles(rows.withColumn("__all", F.lit(0)), value, wanted, "__all")
        # One row beside one row: null where no value is.
        return found.groupBy().agg(*(F.max(n).alias(n) for n in wanted))
    values = _celled(counted(rows, value, *by))
    cells = _cells(values, by)
    position = lambda n: {name: (n - 1) * F.lit(float(q)) for name, q in wanted.items()}
    ends = [F.floor(p) for p in position(F.col("n")).values()] + [F.ceil(p) for p in position(F.col("n")).values()]
    holds = lambda first, many: F.exists(F.array(*ends), lambda x: (x >= F.col(first)) & (x < F.col(first) + F.col(many)))
    chosen = cells.where(holds("before", "m"))
    placed = _placed(beside(values, chosen.select(*by, "step", "cell"), *by, "step", "cell"), chosen, by)

    def at(place: Column) -> Column:
        return F.max(F.when((place >= F.col("before")) & (place < F.col("before") + F.col("t")), F.col("v")))

    sides = [c for name, p in position(F.col("n")).items() for c in (at(F.floor(p)).alias(f"__low_{name}"), at(F.ceil(p)).alias(f"__high_{name}"))]
    found = placed.groupBy(*by).agg(F.first("n").alias("n"), *sides)

    def between(name: str, p: Column) -> Column:
        low, high = F.col(f"__low_{name}"), F.col(f"__high_{name}")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(name)

    return found.select(*by, *(between(name, p) for name, p in position(F.col("n")).items()))


def numbered(rows: DataFrame, key: str, name: str = "row") -> DataFrame:
    """The rows with their number from 1 in the order of ``key``, a number; keys are meant to be distinct, and rows without one are left out."""
    order = W.partitionBy("v").orderBy(key)
    keyed = rows.where(F.col(key).isNotNull()).withColumn("v", F.col(key).cast("double") + 0.0)
    places = ranked(counted(rows, key)).select("v", "before")
    # Whole numbers too long for a double share a value.
    return beside(keyed, places, "v").withColumn(name, F.col("before") + F.row_number().over(order)).drop("v", "before")
