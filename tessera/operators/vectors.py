"""Vector expressions and exact top-k search.

Search is a blocked matrix product: each task multiplies its chunks by a block of
queries and keeps its own k best per query, so the shuffle carries at most k rows
per query and task, and the final ranking works on those. Few queries are sent to
the chunks; many are met with them in a grid of strips and lanes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Digits to which scores are rounded before they are ranked, so that equal vectors tie.
SCORE_DIGITS = 9


def dot(x: str, y: str) -> Column:
    return F.expr(f"aggregate(zip_with({x}, {y}, (a, b) -> cast(a AS double) * cast(b AS double)), 0D, (s, v) -> s + v)")


def norm(x: str) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: str, y: str) -> Column:
    """0 where either vector has no length."""
    lengths = norm(x) * norm(y)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(x, y) / lengths)


def normalized(x: str) -> Column:
    """The vector over its length, which is found once a vector; one without length is an error."""
    squares = f"aggregate({x}, 0D, (s, a) -> s + cast(a AS double) * a)"
    # An array of the one length, so that the division within the inner function does not find it again.
    length = f"transform(array(sqrt({squares})), n -> CASE WHEN n = 0 THEN raise_error('vector without length') ELSE n END)"
    return F.expr(f"flatten(transform({length}, n -> transform({x}, v -> cast(v AS double) / n)))")


def _unit_rows(vectors) -> np.ndarray:
    """Rows of a list of vectors, or of an Arrow list column without nulls, over their lengths."""
    if isinstance(vectors, pa.Array):
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(float)
    else:
        x = np.array([np.asarray(v, float) for v in vectors], float)
    lengths = np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x
    if len(x) and (lengths == 0).any():
        raise ValueError("vector without length")
    return x / lengths if len(x) else x


class _Best:
    """The k best chunks of each of ``n`` queries so far, ties by chunk id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.names = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, names: np.ndarray) -> None:
        """Take in ``scores``: a row for each of ``rows``, a column for each of ``names``. Only what can be among the best is sorted."""
        k, m = self.k, scores.shape[1]
        floor = self.scores[rows, -1]
        if m > k:
            floor = np.maximum(floor, np.partition(scores, m - k, axis=1)[:, m - k])
        at, column = np.nonzero(scores >= floor[:, None])
        if not len(at):
            return
        touched, at_touched = np.unique(at, return_inverse=True)
        held = rows[touched]
        row = np.concatenate((np.repeat(np.arange(len(held)), k), at_touched))
        score = np.concatenate((self.scores[held].ravel(), scores[at, column]))
        name = np.concatenate((self.names[held].ravel(), names[column]))
        order = np.lexsort((name, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = order[place < k]
        self.scores[held], self.names[held] = score[best].reshape(-1, k), name[best].reshape(-1, k)

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        found = self.scores > -np.inf
        query = np.broadcast_to(ids[:, None], found.shape)
        return pa.RecordBatch.from_arrays([pa.array(query[found], pa.int64()), pa.array(self.names[found], pa.int64()), pa.array(self.scores[found], pa.float64())], names=["query_id", "chunk_id", "score"])


class _Queries:
    """A block of queries ready to be multiplied: ids, unit rows, and the rows of each scope."""

    def __init__(self, ids: list[int], vectors, allowed: list, k: int) -> None:
        self.ids, self.units, self.best = np.array(ids, np.int64), _unit_rows(vectors), _Best(len(ids), k)
        scopes: dict[frozenset | None, list[int]] = {}
        for i, a in enumerate(allowed):
            scopes.setdefault(None if a is None else frozenset(a), []).append(i)
        self.scopes = [(None if a is None else np.array(sorted(a)), np.array(rows)) for a, rows in scopes.items()]

    def search(self, names: np.ndarray, codes: np.ndarray, vectors: pa.Array) -> None:
        if not len(names) or not len(self.ids):
            return
        units = _unit_rows(vectors)
        for allowed, rows in self.scopes:
            inside = slice(None) if allowed is None else np.flatnonzero(np.isin(codes, allowed))
            if allowed is None or len(inside):
                self.best.add(rows, np.round(self.units[rows] @ units[inside].T, SCORE_DIGITS), names[inside])


#: Chunks that are multiplied at a time.
_CHUNKS = 4096
#: Strips into which queries are cut at most while a strip has no more queries than the second: chunks cross the shuffle once a strip.
_STRIPS, _STRIP = 16, 16_384
_FOUND = "query_id long, chunk_id long, score double"


def top_k(chunks: DataFrame, queries: DataFrame, k: int, *, scope: Column | None = None, held: int = 1_000, strip: int = 16_384, lanes: int | None = None) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the k chunks of greatest cosine per query, ties by chunk id.

    ``chunks`` has ``chunk_id, document_code, embedding``; ``queries`` has ``query_id,
    allowed, embedding`` where ``allowed`` is an array of document codes or null for
    all. Restriction comes before ranking; chunks come in any order.

    Up to ``held`` queries travel to the tasks as they are, and chunks stay where they
    lie. Beyond that both sides are cut into blocks: queries into strips of about
    ``strip``, into no more than 16 where those hold up to 16,384, chunks into
    ``lanes`` (as many as shuffle partitions unless given).
    Strip and lane are the shuffle key: a task holds one strip and streams one
    lane, and keeps k chunks a query. Chunks cross the shuffle once a strip, queries
    once a lane; the plan and the number of jobs are the same for any number of
    queries, and no query is on the driver.
    """
    wanted = queries.select("query_id", "allowed", "embedding")
    slim = chunks.select("chunk_id", "document_code", "embedding")
    if scope is not None:
        slim = slim.where(scope)
    if wanted.limit(held + 1).count() <= held:
        found = _pass(slim, wanted.orderBy("query_id").collect(), k)
    else:
        lanes = lanes or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = _grid(slim, wanted, k, strip, lanes)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _pass(slim: DataFrame, part: list, k: int) -> DataFrame:
    """A bounded number of queries against all chunks. They travel as a broadcast, which Spark moves out of the driver's heap into blocks of its own."""
    sent = slim.sparkSession.sparkContext.broadcast(([r.query_id for r in part], [r.embedding for r in part], [r.allowed for r in part]))

    def run(batches):
        asked = _Queries(*sent.value, k)
        for batch in batches:
            _search(asked, batch)
        yield asked.best.batch(asked.ids)

    return slim.mapInArrow(run, _FOUND)


def _search(asked: _Queries, batch) -> None:
    for start in range(0, batch.num_rows, _CHUNKS):
        part = batch.slice(start, _CHUNKS)
        asked.search(part.column("chunk_id").to_numpy(), np.array(part.column("document_code").to_pylist()), part.column("embedding"))


def _grid(slim: DataFrame, wanted: DataFrame, k: int, strip: int, lanes: int) -> DataFrame:
    """Strips of queries against lanes of chunks; the number of strips is a row of the plan."""
    n = F.count(F.lit(1))
    strips = F.least(F.ceil(n / strip), F.greatest(F.lit(_STRIPS), F.ceil(n / _STRIP)))
    sizes = wanted.agg(strips.cast("int").alias("strips"))
    # One row.
    sized = F.broadcast(sizes)
    to_all = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    asked = wanted.crossJoin(sized).select(
        F.pmod(F.xxhash64("query_id"), F.col("strips")).cast("int").alias("x"), to_all.alias("y"), F.lit(0).alias("side"),
        F.col("query_id").cast("long").alias("id"), "allowed", F.lit(None).cast(slim.schema["document_code"].dataType).alias("code"), "embedding",
    )
    stored = slim.crossJoin(sized).select(
        F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("x"), F.pmod(F.xxhash64("chunk_id"), F.lit(lanes)).cast("int").alias("y"), F.lit(1).alias("side"),
        F.col("chunk_id").cast("long").alias("id"), F.lit(None).cast(wanted.schema["allowed"].dataType).alias("allowed"), F.col("document_code").alias("code"), "embedding",
    )

    def run(batches):
        cell, rows, asked = None, [], None
        for batch in batches:
            x, y, side = (batch.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(side) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (x[a], y[a]) != cell:
                    if asked is not None:
                        yield asked.best.batch(asked.ids)
                    cell, rows, asked = (x[a], y[a]), [], None
                if side[a] == 0:
                    rows.append(part)
                    continue
                if asked is None and rows:
                    held = pa.Table.from_batches(rows).combine_chunks()
                    asked = _Queries(held.column("id").to_pylist(), held.column("embedding").chunk(0), held.column("allowed").to_pylist(), k)
                    rows = []
                if asked is not None:
                    _search(asked, part.rename_columns(["x", "y", "side", "chunk_id", "allowed", "document_code", "embedding"]))
        if asked is not None:
            yield asked.best.batch(asked.ids)

    return asked.unionByName(stored).repartition("x", "y").sortWithinPartitions("x", "y", "side").mapInArrow(run, _FOUND)
