"""Bootstrap intervals of a mean without a row for each draw and place.

Rows are dealt into blocks of a bounded number. How many of a draw's picks fall into
a block is drawn down a binary tree of block sizes, from generators that are seeded by
tree node, so every block finds its own share and all shares add up; which rows they
are is a hash of draw and place. A block's task gives one array, its sum of each
draw; arrays are added up by draw. With a single block, draw i of place j takes the
row that the hash of (i, j) points to, which any engine can compute.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the hash: its odd factor and the number of its values.
FACTOR, VALUES = 0x45D9F3B, 1 << 32
SEED = 42
_ELEMENTS = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one hash of 32-bit numbers held in unsigned 64-bit ones."""
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(FACTOR) & np.uint64(VALUES - 1)
    return (x >> np.uint64(16)) ^ x


def mix_sql(source: str, column: str) -> str:
    """The same of ``column`` of ``source``, as a subquery for DuckDB."""
    for i in range(2):
        source = f"(SELECT * REPLACE ((xor({column} >> 16, {column}) * {FACTOR}) % {VALUES} AS {column}) FROM {source} m{i})"
    return f"(SELECT * REPLACE (xor({column} >> 16, {column}) AS {column}) FROM {source} m2)"


def block_sums(values: np.ndarray, first_place: int, picks: np.ndarray) -> np.ndarray:
    """For each draw the sum of so many ``picks`` among ``values``."""
    n, draws, most = len(values), len(picks), int(picks.max(initial=0))
    out = np.zeros(draws)
    if not n or not most:
        return out
    of_draw = mix(np.arange(1, draws + 1, dtype=np.uint64))
    of_place = mix(np.arange(first_place, first_place + most, dtype=np.uint64) & np.uint64(VALUES - 1))
    step, even = max(1, _ELEMENTS // most), int(picks.min()) == most
    for a in range(0, draws, step):
        at = mix(of_draw[a : a + step, None] ^ of_place) % np.uint64(n)
        taken = values[at.astype(np.int64)]
        if not even:
            taken *= np.arange(most) < picks[a : a + step, None]
        out[a : a + step] = taken.sum(axis=1)
    return out


def shares(total: int, path: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """For each draw how many of ``total`` picks reach the block at the end of ``path``: rows of node, size, left size, and whether to go left."""
    left = np.full(draws, total, np.int64)
    for node, size, low, goes_left in path.reshape(-1, 4).tolist():
        first = np.random.Generator(np.random.Philox(key=[seed, node])).binomial(left, low / size)
        left = first if goes_left else left - first
    return left


def _paths(sizes: dict[int, int]) -> dict[int, list[int]]:
    """From the root of the tree over block numbers to each block: node, size, left size, whether left, end to end."""
    depth = max(sizes).bit_length() if len(sizes) > 1 else 0
    totals: dict[int, int] = {}
    for b, m in sizes.items():
        for up in range(depth + 1):
            node = (1 << depth) + b >> up
            totals[node] = totals.get(node, 0) + m
    out = {}
    for b in sizes:
        leaf, out[b] = (1 << depth) + b, []
        for up in range(depth, 0, -1):
            node, child = leaf >> up, leaf >> up - 1
            out[b] += [node, totals[node], totals.get(2 * node, 0), int(child == 2 * node)]
    return out


def draw_sums(values: DataFrame, key: str, value: str, *by: str, draws: int = 10_000, block: int = 65_536, seed: int = SEED) -> DataFrame:
    """``*by, draw, n, total``: for each draw the sum of ``n`` rows picked with replacement from the ``n`` of a group. Null values are left out."""
    spark, (group, *more) = values.sparkSession, by or ("__all",)
    if not by:
        values = values.withColumn(group, F.lit(0))
    names = [group, *more]
    slim = values.where(F.col(value).isNotNull()).select(*names, F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = slim.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = slim.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int"))
    dealt = dealt.join(sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [*names, "part"])
    dealt = dealt.select(*names, "k", "v", "n", F.pmod(F.xxhash64("k", F.lit("block")), F.col("blocks")).cast("int").alias("b"))
    kinds = ", ".join(f"{c} {t}" for c, t in slim.select(*names).dtypes)

    def routes(table: pa.Table) -> pa.Table:
        found = _paths(dict(zip(table.column("b").to_pylist(), table.column("m").to_pylist(), strict=True)))
        return table.select(names + ["b"]).append_column("path", pa.array([found[b] for b in table.column("b").to_pylist()], pa.list_(pa.int64())))

    # One row per block of a group goes to one task.
    paths = dealt.groupBy(*names, "b").agg(F.count(F.lit(1)).alias("m")).groupBy(*names).applyInArrow(routes, f"{kinds}, b int, path array<long>")

    def sums(_, rows: pa.Table, path: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("k", "ascending"), ("v", "ascending")]))
        n, b = rows.column("n")[0].as_py(), rows.column("b")[0].as_py()
        picks = shares(n, np.array(path.column("path")[0].as_py(), np.int64), draws, seed)
        total = block_sums(rows.column("v").to_numpy(), b * 2 * block, picks)
        return rows.slice(0, 1).select(names + ["n"]).append_column("totals", pa.array([total.tolist()], pa.list_(pa.float64())))

    each = dealt.groupBy(*names, "b").cogroup(paths.groupBy(*names, "b")).applyInArrow(sums, f"{kinds}, n long, totals array<double>")
    drawn = each.select(*names, "n", F.posexplode("totals").alias("draw", "total"))
    return drawn.groupBy(*names, "draw").agg(F.first("n").alias("n"), F.sum("total").alias("total")).select(*by, "draw", "n", "total")


def interval(values: DataFrame, key: str, value: str, *by: str, draws: int = 10_000, level: float = 0.95, block: int = 65_536, seed: int = SEED) -> DataFrame:
    """``*by, ci_low, ci_high``: the percentile interval of a group's mean, its ends at floored indices of the sorted means of ``draws`` resamples.

    Keys put a block's rows in order and are meant to be distinct within a group.
    The same draws serve every group. A group of one row has that row as both ends.
    """
    low, high = int((1 - level) / 2 * (draws - 1)), int((1 + level) / 2 * (draws - 1))
    means = draw_sums(values, key, value, *by, draws=draws, block=block, seed=seed)
    # As many numbers a group as there are draws.
    listed = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.round(F.col("total") / F.col("n"), 9))).alias("means"))
    return listed.select(*by, F.col("means")[low].alias("ci_low"), F.col("means")[high].alias("ci_high"))
