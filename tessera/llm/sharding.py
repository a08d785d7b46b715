"""Sharding by global byte-size prefix sums, in DataFrame operations only.

Documents are put in order of (id, crc32 of the text, size) by a range partitioning,
which takes ids of any type, and each row gets its partition and its place there.
The partitions' totals are summed up, and each partition adds its own running sum,
so a global running sum needs no single-task window. The byte axis is then cut at
equal targets; a document goes to the shard that holds the middle of its bytes.
Shards are contiguous, and each holds the target give or take one document.

Rows alike in all three values are counted first and expanded last, in parts of a
bounded number, so many copies of one row do not gather in one task. Rows of one
id, or of none, are parted by their checksums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash

LAW = "bytes"
#: Copies of one row that are made in one go.
_COPIES = 4096


def shard_by_bytes(docs: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus one; very long texts are not cut. A null
    text counts as an empty one (size 1, crc32 0). Null ids come first. Rows alike in
    id and text take neighbouring slots, as do rows of one id. Ids may be of any type
    that has an order. An empty input gives no rows. Other columns are not read.
    ``grown_shard`` is null: under this law a further shard moves all cuts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("k"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    counted = slim.groupBy("k", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    # The upper bits of the number are the partition, the lower 33 the place in it.
    placed = stash(counted.orderBy(F.col("k").asc_nulls_first(), "crc", "size").withColumn("at", F.monotonically_increasing_id()), "shard-rows")
    placed = placed.withColumn("part", F.shiftright("at", 33))

    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("r"))
    # One row per partition of the range partitioning.
    starts = totals.select(
        "part",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("r").over(before), F.lit(0)).alias("rows_before"),
        F.sum("b").over(W.partitionBy()).alias("total"),
    )
    inside = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    run = placed.select(
        "*",
        F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)).alias("bytes_in"),
        F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("rows_in"),
    )
    each = _copies(run.join(starts, "part"))
    first_byte = F.col("bytes_before") + F.col("bytes_in") + F.col("copy") * F.col("size")
    cut = F.expr(f"(2 * first_byte + size) * {shards} div (2 * total)")
    laid = each.withColumn("first_byte", first_byte).select("k", "size", "crc", F.least(cut, F.lit(shards - 1)).cast("int").alias("shard"), (F.col("rows_before") + F.col("rows_in") + F.col("copy")).alias("row"))
    laid = stash(laid, "shard-laid")
    first = laid.groupBy("shard").agg(F.min("row").alias("first_row"))
    # As many rows as shards.
    return laid.join(F.broadcast(first), "shard").select(
        F.col("k").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _copies(rows: DataFrame) -> DataFrame:
    """``n`` rows for each, numbered by ``copy``; a row with many copies is dealt over the tasks before it is expanded."""
    few = rows.where(F.col("n") <= _COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    parts = rows.where(F.col("n") > _COPIES).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_COPIES).cast("long")))).repartition("at", "first")
    many = parts.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + _COPIES, F.col("n")) - 1))).drop("first")
    return few.unionByName(many)


def shard_totals(assigned: DataFrame) -> DataFrame:
    """Rows and bytes per shard, for a manifest."""
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("n_bytes"))
