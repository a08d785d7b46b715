"""Validation gates: what violates a rule is a table, and a gate is an error where that table has rows."""

from __future__ import annotations

from collections.abc import Iterable

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def require_none(violations: DataFrame, message: str, shown: int = 10) -> None:
    """An error that names the first few violations; only those reach the driver."""
    rows = violations.limit(shown).collect()
    if rows:
        raise ValueError(f"{message}: {[tuple(r) for r in rows]}")


def unresolved(refs: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not among the values of ``known``."""
    return refs.join(known.select(column).distinct(), column, "left_anti")


def first_by_key(rows: DataFrame, order: list[str], *key: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def compared(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """``key, status`` over both sides: match, changed, missing or unexpected."""
    both = expected.select(key, F.col(value).alias("__e"), F.lit(True).alias("__x")).join(actual.select(key, F.col(value).alias("__a"), F.lit(True).alias("__y")), key, "full")
    status = F.when(F.col("__x").isNull(), "unexpected").when(F.col("__y").isNull(), "missing").when(F.col("__e").eqNullSafe(F.col("__a")), "match").otherwise("changed")
    return both.select(key, status.alias("status"))


def named_order(column: Column, names: Iterable[str]) -> Column:
    """The place of a name in a fixed order; names it lacks come after all, in order of name."""
    listed = F.array(*map(F.lit, names))
    at = F.array_position(listed, column)
    return F.struct(F.when(at == 0, F.size(listed) + 1).otherwise(at).alias("at"), column.alias("name"))


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def highlighted(text: Column, start: Column, stop: Column) -> Column:
    """Escaped text with the characters from ``start`` to ``stop`` marked."""
    parts = (F.substr(text, F.lit(1), start), F.substr(text, start + 1, stop - start), F.substr(text, stop + 1))
    before, inside, after = map(escaped, parts)
    return F.concat(before, F.lit("<mark>"), inside, F.lit("</mark>"), after)


def scaled(value: Column, low: Column, high: Column, top: float, bottom: float) -> Column:
    """A value's place between ``bottom`` (the lowest) and ``top``; the middle where all are equal."""
    return F.when(high == low, (top + bottom) / 2).otherwise(bottom - (value - low) / (high - low) * (bottom - top))


def numbered_list(rows: DataFrame, place: str, text: Column, *by: str, name: str = "text") -> DataFrame:
    """``by..., name``: the texts of a key in order, a blank line between them."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), text.alias("t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias(name))


def merged_usage(records: DataFrame, key: str, place: str, usage: str) -> DataFrame:
    """``key, name, total, carried``: numbers of a JSON object added up over a key's records, other values taken from the last record.

    A name is a number's if any record has a number under it; true and false are no
    numbers, but count as 1 and 0 under such a name. Null, unreadable and empty objects
    are passed over. ``carried`` is the value as JSON writes it, without quotes.
    """
    objects = records.select(F.col(key), F.col(place).alias("__at"), F.expr(f"try_parse_json({usage})").alias("__u")).where("__u is not null")
    objects.createOrReplaceTempView(view := f"usage_{uuid.uuid4().hex}")
    try:
        each = objects.sparkSession.sql(f"SELECT u.`{key}`, u.__at, e.key AS name, e.value AS v, schema_of_variant(e.value) AS kind FROM {view} u, LATERAL variant_explode(u.__u) e WHERE e.key IS NOT NULL")
    finally:
        objects.sparkSession.catalog.dropTempView(view)
    number = F.col("kind").isin("BIGINT", "DOUBLE", "FLOAT") | F.col("kind").startswith("DECIMAL")
    amount = F.when(number, F.expr("try_variant_get(v, '$', 'double')")).when(F.col("kind") == "BOOLEAN", F.expr("cast(try_variant_get(v, '$', 'boolean') as int)")).otherwise(0.0)
    last = each.groupBy(key).agg(F.max("__at").alias("__last"))
    text = F.when(F.col("kind") != "VOID", F.expr("try_variant_get(v, '$', 'string')"))
    sums = each.join(last, key).groupBy(key, "name").agg(F.max(number).alias("numeric"), F.sum(amount).alias("total"), F.max(F.when(F.col("__at") == F.col("__last"), 1).otherwise(0)).alias("in_last"), F.max(F.when(F.col("__at") == F.col("__last"), text)).alias("carried"))
    kept = sums.where("numeric or in_last = 1")
    return kept.select(key, "name", F.when(F.col("numeric"), F.col("total")).alias("total"), F.when(~F.col("numeric"), F.col("carried")).alias("carried"))
