"""Sinks: partitioned overwrite, upsert of whole tables and of key buckets, cache append, CSV and vector tables with a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.vectors import norm, normalized
from .readers import index_facts


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that ``df`` holds rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, *key: str) -> None:
    """Merge by key, new rows winning. The result is written beside the table and moved into place, so a failure leaves the old one. Two new rows of one key are an error."""
    twice = new.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one new row of {twice[0].asDict()}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target, made, old = fs_path(path), fs_path(f"{path}.new"), fs_path(f"{path}.old")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)
    merged = new
    if fs.exists(target):
        merged = spark.read.parquet(path).join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)
    fs.delete(made, True)
    merged.write.parquet(made.toString())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(made, target)
    fs.delete(old, True)


def _entries(spark: SparkSession, path: str) -> tuple[object, object, list[str]]:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, jpath, sorted(x.getPath().getName() for x in fs.listStatus(jpath)) if fs.exists(jpath) else []


def _last_commit(spark: SparkSession, path: str) -> dict | None:
    """The newest commit record: which batch it was, the number of buckets, and where each bucket's rows are."""
    fs, jpath, names = _entries(spark, f"{path}/_commits")
    done = [n for n in names if n.endswith(".json")]
    if not done:
        return None
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(jpath, done[-1]))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def upsert_buckets(spark: SparkSession, path: str, new: DataFrame, *key: str, batch: int | None = None, buckets: int = 256, before_commit=None) -> bool:
    """Merge by key, new rows winning, into a table of key buckets; only the buckets of the new keys are read and written.

    The buckets of a merge are written to a folder of its own, and a commit record
    names the folder of every bucket; it appears by one rename, so a reader sees all
    of a merge or nothing, and a merge that fails before leaves the table as it was.
    A ``batch`` that the last record has, or a later one, is not merged again; the
    answer is whether it was. The number of buckets is that of the first merge. Two
    new rows of one key are an error, found in the bucket. One writer at a time.
    ``before_commit`` is called between the two steps, for tests.
    """
    last = _last_commit(spark, path)
    if last and batch is not None and last["batch"] is not None and last["batch"] >= batch:
        return False
    number, buckets = (last["number"] + 1, last["buckets"]) if last else (0, buckets)
    where = dict(last["where"]) if last else {}
    bucket = F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in key)), F.lit(buckets)).cast("int")
    twice = F.when(F.count(F.lit(1)).over(W.partitionBy("__bucket", *key)) > 1, F.raise_error(F.lit("more than one new row of a key")).cast("int")).otherwise(F.col("__bucket"))
    rows = new.withColumn("__bucket", bucket).withColumn("__bucket", twice)
    merge = f"{path}/merge-{number:09d}-{uuid.uuid4().hex[:8]}"
    # At most as many numbers as there are buckets.
    touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]
    parts = [f"{where[str(b)]}/__bucket={b}" for b in touched if str(b) in where]
    if parts:
        old = spark.read.schema(new.schema).parquet(*(f"{path}/{p}" for p in parts))
        rows = old.withColumn("__bucket", bucket).join(new.select(*key), list(key), "left_anti").select(rows.columns).unionByName(rows)
    rows.repartition("__bucket").write.partitionBy("__bucket").parquet(merge)
    if before_commit:
        before_commit()
    where |= {str(b): merge.rsplit("/", 1)[1] for b in touched}
    _commit(spark, path, {"number": number, "batch": batch if batch is not None else (last or {}).get("batch"), "buckets": buckets, "where": where})
    _clear(spark, path, {*where.values(), *(last["where"].values() if last else ())})
    return True


def _commit(spark: SparkSession, path: str, record: dict) -> None:
    jvm, name = spark._jvm, f"{record['number']:09d}"
    made = jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/.{name}-{uuid.uuid4().hex}")
    fs = made.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(made, False)
    stream.write(bytearray(json.dumps(record).encode()))
    stream.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{name}.json")
    if fs.exists(final) or not fs.rename(made, final):
        fs.delete(made, False)
        raise RuntimeError("another writer committed first")


def _clear(spark: SparkSession, path: str, kept: set[str]) -> None:
    """Delete folders that neither the last commit nor the one before names; failed merges leave such too."""
    fs, jpath, names = _entries(spark, path)
    for name in names:
        if name.startswith("merge-") and name not in kept:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(jpath, name), True)


def read_buckets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the last commit; of a table without one, none."""
    last = _last_commit(spark, path)
    if not last or not last["where"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{folder}/__bucket={b}" for b, folder in sorted(last["where"].items(), key=lambda x: int(x[0]))))


def append_cache(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], *, line: str = "\n", empty_is_error: bool = False) -> None:
    """One CSV of fixed columns; meant for reports, which fit one file."""
    if empty_is_error and df.isEmpty():
        raise ValueError("no rows to write")
    df.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True, lineSep=line)


def write_flat_index(chunks: DataFrame, path: str, *, kind: str = "flat_inner_product", metadata: dict | None = None) -> DataFrame:
    """Unit vectors with their position, and a one-row manifest that is bound to them by digests; no other kind of index is known."""
    if kind != "flat_inner_product":
        raise ValueError(f"unknown index: {kind}")
    unit = chunks.select("chunk_id", "pos", normalized("embedding").alias("embedding"))
    unit.write.mode("overwrite").parquet(f"{path}/vectors")
    stored = chunks.sparkSession.read.parquet(f"{path}/vectors")
    size = stored.agg(F.max(F.size("embedding")).alias("dimension"), F.min(norm("embedding")).alias("min_norm"), F.max(norm("embedding")).alias("max_norm"), F.lit(kind).alias("kind"))
    manifest = index_facts(stored).join(size, F.lit(True))
    for name, value in (metadata or {}).items():
        manifest = manifest.withColumn(name, F.lit(value))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return stored


def write_json_report(df: DataFrame, path: str) -> None:
    """Replace a report by these rows, which fit one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """Replace a report by one JSON document, an indented array of its rows; a report fits one value."""
    numbered = df.select(F.monotonically_increasing_id().alias("n"), F.struct(*df.columns).alias("r"))
    rows = F.sort_array(F.collect_list(F.struct("n", "r")))
    text = F.to_json(F.transform(rows, lambda x: x["r"]), {"pretty": "true", "ignoreNullFields": "false"})
    numbered.agg(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_configs(chunks: DataFrame, path: str, *, key: str = "config_id") -> None:
    """All configurations in one write, a folder each; folders of configurations that are not written stay."""
    overwrite_partitions(chunks, path, key)
