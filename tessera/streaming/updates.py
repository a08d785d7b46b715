"""Incremental forms: windowed sums over an event stream and a resumable upsert of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import upsert, upsert_buckets


def read_events(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_totals(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum per event type and window; events later than ``late`` are left out."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, *key: str, latest: str | None = None, buckets: int | None = None) -> StreamingQuery:
    """Every micro-batch replaces rows of its keys; a batch that runs again after a failure gives the same table.

    With ``buckets`` the table is one of key buckets: a batch writes only those of its
    keys, and one that was committed already is left out by its number.

    Of several rows of a key in one batch the one with the greatest ``latest`` wins,
    and among equals, or without such a column, the one whose other columns are greatest.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        order = F.struct(*([latest] if latest else []), *rest)
        best = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
        best = best.select(*batch.columns)
        if buckets:
            upsert_buckets(batch.sparkSession, path, best, *key, batch=number, buckets=buckets)
        else:
            upsert(batch.sparkSession, path, best, *key)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
