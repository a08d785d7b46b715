"""Shared helpers: table reads, shared-folder staging, text primitives."""

from __future__ import annotations

import hashlib
import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Fixed value: the ASCII white space that separates words, as a regex class body.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Fixed value: the same characters, for bytes.translate.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers."""
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own if all of Spark runs in this process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "/tmp/checkpoints/tessera"
    return found.rstrip("/")


#: What this process has written to the shared folder and not deleted, in order.
_WRITTEN: dict[str, None] = {}


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and later passes read only the columns they use. What a result still reads stays
    until :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = None
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def unstash(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_tessera_path", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    _WRITTEN.pop(path, None)


def written() -> list[str]:
    """What this process has in the shared folder."""
    return list(_WRITTEN)


def release(spark: SparkSession, *, since: list[str] = (), kept: DataFrame | None = None) -> None:
    """Delete what this process has written to the shared folder, once the results that read it are written themselves.

    With ``since``, an earlier :func:`written`, only what came after; ``kept`` stays.
    """
    stays = {*since, getattr(kept, "_tessera_path", None)}
    for path in written():
        if path not in stays:
            _delete(spark, path)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column written as text, modulo ``modulus`` (null counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than ASCII white space, as UTF-8."""
    return text.encode().split() if text else []


#: Bytes of text that are taken together where texts stay Arrow buffers.
GROUP_BYTES = 4 << 20


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each value begins and ends among them; nulls are empty. Offsets may have 32 or 64 bits."""
    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    if not (wide or pa.types.is_string(kind) or pa.types.is_binary(kind)):
        raise TypeError(f"not a column of texts or bytes: {kind}")
    column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "", kind))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    blob = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return blob, at - at[0]


def values(blob: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The column whose values lie end to end in ``blob`` and begin and end at ``at``. More than offsets of 32 bits can tell is an error."""
    if at[-1] > np.iinfo(np.int32).max:
        raise OverflowError(f"{at[-1]} bytes do not fit in one column")
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(blob))])


def row_groups(column: pa.Array):
    """Rows of a text column in groups of about ``GROUP_BYTES``, a longer text alone: where each group starts and stops."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + GROUP_BYTES, "right")))
        yield start, stop
        start = stop


def publish(spark: SparkSession, data: bytes, label: str) -> str:
    """Write a file to the shared folder, from which any executor, also a later one, fetches it; the name it has there."""
    name = f"{label}-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        out = fs.create(jpath, True)
        out.write(bytearray(data))
        out.close()
    _WRITTEN[jpath.toString()] = None
    spark.sparkContext.addFile(fs.makeQualified(jpath).toString())
    return name


def published(name: str) -> str:
    """Where a task finds a published file."""
    return SparkFiles.get(name)


def slices(batch, rows: int = 256):
    """An Arrow record batch in short slices, so that Python copies of texts stay small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


#: Rows of sorted batches that are taken together; rows that belong together are never parted.
_RUN_ROWS = 1 << 16


def whole_runs(batches, names: list[str]):
    """Sorted batches as tables that never part rows alike in ``names``."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _RUN_ROWS:
            table = pa.Table.from_batches(held)
            changes = np.flatnonzero(np.any([np.diff(table.column(n).to_numpy()) != 0 for n in names], axis=0))
            if len(changes):
                cut = int(changes[-1]) + 1
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
                rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def run_numbers(table: pa.Table, names: list[str]) -> np.ndarray:
    """A number for each row that changes where one of ``names`` does."""
    return np.concatenate(([0], np.cumsum(np.any([np.diff(table.column(n).to_numpy()) != 0 for n in names], axis=0)))).astype(np.int64)


def most_frequent(counts: DataFrame, most: int, *, word_col: str = "word", count_col: str = "n") -> DataFrame:
    """The rows of the highest counts, at most ``most`` of them.

    Counts are compared by their logarithm to base two in steps of a sixteenth. The
    few hundred steps are counted on the driver, and the rows of all steps that fit
    are taken, so no task sends more than its share of them. Places that are left go
    to rows of the next step, in order of count and word: that step alone is sorted
    over the tasks, and the place of the last row follows from the tasks' numbers of rows.
    """
    stepped = stash(counts.select(word_col, count_col, F.floor(F.log2(count_col) * 16).cast("int").alias("step")), "counts")
    cut, rest, left = None, None, most
    for r in stepped.groupBy("step").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("step")).collect():
        if r.m > left:
            rest = r.step
            break
        cut, left = r.step, left - r.m
    whole = stepped.where(F.lit(False) if cut is None else F.col("step") >= cut).select(word_col, count_col)
    if rest is None or left <= 0:
        return whole
    # The upper bits of the number are the task, the lower 33 the row in it.
    part = stash(stepped.where(F.col("step") == rest).orderBy(F.desc(count_col), word_col).select(word_col, count_col, F.monotonically_increasing_id().alias("at")), "counts-step")
    for r in part.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count(F.lit(1)).alias("m")).orderBy("task").collect():
        if r.m > left:
            return whole.unionByName(part.where(F.col("at") < (r.task << 33) + left).select(word_col, count_col))
        left -= r.m
    return whole
