"""Readers: JSON in three layouts, CSV with contracts, question dictionaries, configurations, prompts, snapshots and checked indexes.

Files are read by Spark (``binaryFile``, ``text`` or the format's own reader), so paths
may be in any store that Spark knows. Small files that steer a job come to the driver.
"""

from __future__ import annotations

import ast
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_question_dict(spark: SparkSession, text: str, name: str = "question_dict") -> DataFrame:
    """``question, position, answers`` of a Python dictionary literal and its ``update`` calls, read as syntax and never run.

    A key keeps its first place and its last value.
    """
    found: dict[str, list[str]] = {}
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Assign) and any(getattr(t, "id", "") == name for t in node.targets):
            found |= ast.literal_eval(node.value)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "update" and getattr(node.func.value, "id", "") == name:
            found |= ast.literal_eval(node.args[0])
    rows = [(k, i, [str(x) for x in (v if isinstance(v, (list, tuple)) else [v])]) for i, (k, v) in enumerate(found.items())]
    return spark.createDataFrame(rows, "question string, position int, answers array<string>")


def read_json_array(spark: SparkSession, path: str, schema: str, *, wrapper: str | None = None) -> DataFrame:
    """Rows of a JSON array, or of the array in field ``wrapper`` of an object, whichever the file holds."""
    if wrapper is None:
        return spark.read.schema(schema).json(path, multiLine=True)
    text = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.from_json("value", f"struct<{wrapper}:array<struct<{_as_struct(schema)}>>>")[wrapper], F.from_json("value", f"array<struct<{_as_struct(schema)}>>"))
    return text.select(F.inline(inner))


def _as_struct(schema: str) -> str:
    return ", ".join(":".join(c.strip().split(" ", 1)) for c in re.split(r",(?![^<]*>)", schema))


def read_cache_lines(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Rows of JSON lines; of several with one key the last line of the last file wins. Lines that don't parse are left out.

    The place of a line is its file, the start of its block in the file and its place
    in the block, so the order holds however files are split.
    """
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path, columnNameOfCorruptRecord="_corrupt_record")
    where = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    placed = rows.withColumn("__at", where).where("_corrupt_record is null").drop("_corrupt_record")
    columns = [c for c in placed.columns if c not in (key, "__at")]
    last = placed.groupBy(key).agg(F.max_by(F.struct(*columns), "__at").alias("r"))
    return last.select(key, "r.*")


def read_keyed_csv(spark: SparkSession, path: str, required: list[str], key: str) -> DataFrame:
    """A CSV of strings that must have the required columns and one row per key."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    twice = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one row of {key} {twice[0][key]}")
    return rows.fillna("")


def read_partitions(spark: SparkSession, path: str, schema: str, wanted: list[str] | None = None) -> DataFrame:
    """JSON below ``condition_id=...`` folders; ``wanted`` prunes folders, and one that is missing is an error."""
    rows = spark.read.schema(schema).option("basePath", path).json(path)
    if wanted is None:
        return rows
    kept = rows.where(F.col("condition_id").isin(wanted))
    have = {r.condition_id for r in kept.select("condition_id").distinct().collect()}
    if set(wanted) - have:
        raise FileNotFoundError(f"no rows for {sorted(set(wanted) - have)}")
    return kept


def read_text(spark: SparkSession, path: str) -> str:
    """One small text file."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise FileNotFoundError(f"one file expected: {path}")
    return rows[0].value


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration in YAML, or in JSON where no YAML parser is installed."""
    text = read_text(spark, path)
    try:
        import yaml
    except ModuleNotFoundError:
        return json.loads(text)
    return yaml.safe_load(text)


def read_prompt(spark: SparkSession, path: str) -> tuple[str, str]:
    """The system and the user section of a prompt file; a file without both, in this order, is an error."""
    found = re.fullmatch(r"System:\n(.*?)\nUser:\n(.*)", read_text(spark, path).strip(), re.DOTALL)
    if not found:
        raise ValueError(f"no System and User sections: {path}")
    return found[1].strip(), found[2].strip()


def read_output_schema(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def parse_env(text: str) -> dict[str, str]:
    """``KEY=value`` lines; comments and other lines are passed over, quotes around values go, and the first of a key counts."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        key, equals, value = line.strip().partition("=")
        if equals and key.strip() and not key.startswith("#"):
            out.setdefault(key.strip(), value.strip().strip('"').strip("'"))
    return out


def config_value(config: dict, *keys: str, default=None):
    """A value below some keys, or a default; without one, a key that is missing is an error that names it."""
    for n, key in enumerate(keys):
        if not isinstance(config, dict) or key not in config:
            if default is None:
                raise ValueError(f"not configured: {'.'.join(keys[: n + 1])}")
            return default
        config = config[key]
    return config


def read_first_named(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The rows of the first file, in order of path, of that name below a folder."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(folder, multiLine=True).withColumn("__path", F.col("_metadata.file_path"))
    first = rows.agg(F.min("__path").alias("p")).first().p
    if first is None:
        raise FileNotFoundError(f"no {name} below {folder}")
    return rows.where(F.col("__path") == first).drop("__path")


def read_configs(spark: SparkSession, path: str, schema: str, wanted: list[str], *, key: str = "config_id") -> DataFrame:
    """Chunks of the wanted configurations below ``config_id=...`` folders; other folders are not read, and a missing one is an error."""
    rows = spark.read.schema(f"{schema}, {key} string").option("basePath", path).parquet(path).where(F.col(key).isin(wanted))
    have = {r[key] for r in rows.select(key).distinct().collect()}
    if set(wanted) - have:
        raise FileNotFoundError(f"no chunks of {sorted(set(wanted) - have)}")
    return rows


def last_by_key(key: str, *tables: DataFrame) -> DataFrame:
    """The union of tables of which a later one's row replaces an earlier one's of the same key."""
    every = None
    for number, table in enumerate(tables):
        part = table.withColumn("__table", F.lit(number))
        every = part if every is None else every.unionByName(part)
    columns = [c for c in every.columns if c not in (key, "__table")]
    return every.groupBy(key).agg(F.max_by(F.struct(*columns), "__table").alias("r")).select(key, "r.*")


def read_flat_index(spark: SparkSession, path: str, expected: dict) -> DataFrame:
    """The vectors of an index in their order, after its manifest has been held against ``expected`` and against the vectors.

    A manifest field that is missing counts as ``text`` if it names the embedded text.
    Other differences, another number of rows and a digest that does not fit are errors.
    """
    manifest = spark.read.json(f"{path}/manifest").first().asDict()
    manifest.setdefault("embedding_text_field", "text")
    differ = {k: (manifest.get(k), v) for k, v in expected.items() if manifest.get(k) != v}
    if differ:
        raise ValueError(f"the index was made otherwise: {differ}")
    stored = spark.read.parquet(f"{path}/vectors")
    found = index_facts(stored).first().asDict()
    if any(manifest[k] != v for k, v in found.items()):
        raise ValueError("the vectors are not those of the manifest")
    return stored.orderBy("pos")


def index_facts(stored: DataFrame) -> DataFrame:
    """Number of vectors and digests of the vectors and of the order of ids, in one row; the digests are sums of hashes, so no order of rows matters."""
    def digest(*columns):
        return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")

    return stored.agg(F.count(F.lit(1)).alias("n_vectors"), digest("chunk_id", "embedding").alias("embeddings_digest"), digest("chunk_id", "pos").alias("order_digest"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``name, sha256, length`` of the files below a path, for comparing them with a pinned snapshot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")
