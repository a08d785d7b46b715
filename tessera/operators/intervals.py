"""Offsets, windows and interval overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def block_offsets(docs: DataFrame, text: str, *by: str, gap: int = 2) -> DataFrame:
    """``by..., block_no, block, start, stop``: the non-empty lines of a text and where each stands when they are joined with ``gap`` characters between."""
    lines = docs.select(*by, F.posexplode(F.filter(F.split(text, "\n"), lambda x: x != "")).alias("block_no", "block"))
    before = F.sum(F.length("block") + gap).over(W.partitionBy(*by).orderBy("block_no").rowsBetween(W.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    return lines.select(*by, "block_no", "block", start.alias("start"), (start + F.length("block")).alias("stop"))


def overlapping_windows(start: str, stop: str, size: int, step: int) -> Column:
    """Numbers of the windows ``[i * step, i * step + size)`` that overlap ``[start, stop)``: arithmetic in place of a range join."""
    first = F.greatest(F.lit(0), F.floor((F.col(start) - size) / step) + 1)
    last = F.floor((F.col(stop) - 1) / step)
    return F.when(F.col(stop) > F.col(start), F.sequence(first, last)).otherwise(F.array().cast("array<long>"))


def token_windows(count: Column, size: int, step: int) -> Column:
    """Starts of fixed windows over ``count`` tokens: a window is made while the one before it did not reach the end."""
    last = F.greatest(F.lit(0), F.ceil((count - size) / step)).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def merged_length(spans: DataFrame, *by: str) -> DataFrame:
    """``by..., covered, islands``: length of the union of ``start, stop`` spans; spans that touch are one island."""
    order = W.partitionBy(*by).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    ends = island.groupBy(*by, "island").agg((F.max("stop") - F.min("start")).alias("length"))
    return ends.groupBy(*by).agg(F.sum("length").alias("covered"), F.count(F.lit(1)).alias("islands"))


def overlapping(left: DataFrame, right: DataFrame, by: str, *, width: int = 4096) -> DataFrame:
    """Every pair of rows of one ``by`` whose spans overlap; both sides have ``start, stop``, the right one's as ``other_start, other_stop``.

    Spans are dealt into bins of ``width``, and a pair is made in the bin where the
    later of the two begins, so a large document is many join keys and no pair comes
    twice. Empty spans overlap nothing.
    """

    def binned(rows: DataFrame, start: str, stop: str) -> DataFrame:
        first, last = (F.floor(F.col(c) / width) for c in (start, stop))
        return rows.where(F.col(stop) > F.col(start)).withColumn("bin", F.explode(F.sequence(first, last)))

    right = right.withColumnsRenamed({"start": "other_start", "stop": "other_stop"})
    pairs = binned(left, "start", "stop").join(binned(right, "other_start", "other_stop"), [by, "bin"])
    return pairs.where((F.col("start") < F.col("other_stop")) & (F.col("other_start") < F.col("stop")) & (F.col("bin") == F.floor(F.greatest("start", "other_start") / width))).drop("bin")


def match_spans(docs: DataFrame, text: str, pattern: str, *by: str) -> DataFrame:
    """``by..., place, raw, start, stop``: what ``pattern`` matches, trimmed at its end, and where; running sums of the lengths of matches and of what lies between them."""
    parts = docs.select(*by, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    rows = parts.select(*by, F.posexplode(F.arrays_zip("found", "gaps")).alias("place", "m")).select(*by, "place", F.col("m.found").alias("raw"), F.length("m.gaps").alias("gap"))
    before = F.sum(F.coalesce(F.length("raw"), F.lit(0)) + F.col("gap")).over(W.partitionBy(*by).orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    start = (F.coalesce(before, F.lit(0)) + F.col("gap")).cast("long")
    trimmed = F.regexp_replace("raw", r"\s+$", "")
    return rows.withColumn("start", start).where("raw IS NOT NULL").select(*by, "place", trimmed.alias("raw"), "start", (F.col("start") + F.length(trimmed)).alias("stop"))


def match_lengths(docs: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """``keep..., found, kept, gaps``: for each text the lengths of what ``pattern`` matches, before and after trimming at its end, and of what lies before and after each."""
    parts = docs.where(F.col(text).isNotNull()).select(*keep, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    long = lambda c: c.cast("long")
    return parts.select(*keep, F.transform("m", lambda x: long(F.length(x))).alias("found"), F.transform("m", lambda x: long(F.length(F.regexp_replace(x, r"\s+$", "")))).alias("kept"), F.transform("g", lambda x: long(F.length(x))).alias("gaps"))


def even_pieces(count: Column, most: int) -> Column:
    """``first, last`` of the pieces of a run of ``count`` tokens that has more than ``most``: as few as will do, as even as can be, the longer ones first."""
    n = F.greatest(F.ceil(count / most), F.lit(1))
    size, extra = F.floor(count / n), count % n

    def begin(i: Column) -> Column:
        return i * size + F.least(i, extra)

    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(begin(i).alias("first"), begin(i + 1).alias("last")))
