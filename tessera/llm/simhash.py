"""SimHash near-duplicates by deletion variants of fingerprint segments.

A fingerprint of 64 bits sums up a text's word shingles. Where two fingerprints
differ in at most ``bits`` bits, the pigeonhole principle gives, among
``bits // 2 + 1`` segments, one that differs in at most one bit; an exact match of a
whole segment would need ``bits + 1`` of them, each shorter and shared by more. So every
segment is indexed once for each of its bits, with that bit deleted, and segments
that differ in that bit alone, or in none, meet by an equality join on segment,
deleted place and the bits that are left. Each meeting is verified on the whole
fingerprints.

Documents of one fingerprint are one class from the start, and only distinct
fingerprints are indexed. Members of a key are compared in their task, and links are
given only between members that are not connected yet, so a key of n members gives
fewer than n links. A key of more than ``block`` fingerprints is dealt into blocks;
each is compared inside, and then the members outside the key's largest component,
in blocks of their own, meet every block. Both are shuffle keys of a bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import run_numbers, slices, stash, unstash, whole_runs
from .components import connected, with_least

SEED = 42
_CHUNK = 1 << 15


@dataclass(frozen=True)
class Plan:
    """Words of a shingle, most differing bits of linked fingerprints, and most fingerprints of a block."""

    words: int = 4
    bits: int = 4
    block: int = 8192

    def segments(self) -> list[tuple[int, int]]:
        """First bit and length of each segment; two at least, so that a key fits in 64 bits."""
        n = max(2, self.bits // 2 + 1)
        ends = [64 * i // n for i in range(n + 1)]
        return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def fingerprint(text: str | None, q: int) -> int:
    """The bits set in over half of the shingles' hashes; 0 for texts without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    q = min(q, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - q + 1].tolist()
    ends = ends[q - 1 :].tolist()
    n, total, digest = len(starts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, _CHUNK):
        h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK], strict=True)), "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, plan: Plan, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k, fp, deal``: id, fingerprint as a signed integer and a running number by which rows of one fingerprint are dealt; a row per input row."""
    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    deals = max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        at = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(t, plan.words) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64)), pa.array((np.arange(len(found)) + at) % deals, pa.int32())], names=["k", "fp", "deal"])
                at += len(found)

    return slim.mapInArrow(run, f"k {dict(slim.dtypes)['k']}, fp long, deal int")


def variants(plan: Plan) -> Column:
    """The keys of ``fp``: for each of its bits, the segment around it without that bit, under the bit's number."""
    keys = []
    for first, length in plan.segments():
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << length) - 1))
        for at in range(length):
            left = F.shiftleft(F.shiftright(value, at + 1), at).bitwiseOR(value.bitwiseAND(F.lit((1 << at) - 1)))
            keys.append(left.bitwiseOR(F.lit(len(keys) << 32)))
    return F.explode(F.array(*keys))


class _Ties:
    """Which fingerprints are connected so far, and the links that connected them."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, v: int) -> int:
        parent = self.parent
        while (p := parent.get(v, v)) != v:
            parent[v] = parent.get(p, p)
            v = parent[v]
        return v

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            ra, rb = self.find(a), self.find(b)
            if ra != rb:
                self.parent[ra] = rb
                self.links.append((a, b))

    def labels(self, members: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.find, members.tolist()), np.int64, len(members))


def link_runs(run: np.ndarray, fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect all members of the same run that differ in at most ``bits`` bits. Equal runs lie together."""
    ties, seen = _Ties(), fp.view(np.uint64)
    at, lag, label = np.arange(len(fp) - 1), 1, fp.copy()
    while len(at := at[at + lag < len(fp)]) and len(at := at[run[at] == run[at + lag]]):
        near = at[(label[at] != label[at + lag]) & (np.bitwise_count(seen[at] ^ seen[at + lag]) <= bits)]
        if len(near):
            # One pair of each pair of components is enough.
            _, one = np.unique(np.column_stack([label[near], label[near + lag]]), axis=0, return_index=True)
            ties.add(fp[near[one]], fp[near[one] + lag])
            label = ties.labels(fp)
        lag += 1
    return ties.links


def link_sides(fp: np.ndarray, comp: np.ndarray, left: int, bits: int) -> list[tuple[int, int]]:
    """Links between the first ``left`` members and the others that are near and of different components."""
    ties, seen = _Ties(), fp.view(np.uint64)
    for i in range(left):
        near = left + np.flatnonzero((comp[left:] != comp[i]) & (np.bitwise_count(seen[left:] ^ seen[i]) <= bits))
        if len(near):
            # Components, not fingerprints, are tied; a link stands for one pair of them.
            names, one = np.unique(comp[near], return_index=True)
            before = len(ties.links)
            ties.add(np.full(len(names), comp[i]), names)
            kept = {b for _, b in ties.links[before:]}
            ties.links[before:] = [(int(fp[i]), int(fp[j])) for j in near[one] if int(comp[j]) in kept]
    return ties.links


def _sorted(rows: DataFrame, names: list[str], *then: str) -> DataFrame:
    return rows.repartition(*names).sortWithinPartitions(*names, *then)


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def _with_plan(index: DataFrame, plans: DataFrame, how: str) -> DataFrame:
    """The index with the row of its key; members of one key are dealt over as many parts as there are shuffle partitions."""
    parts = max(32, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    copies = plans.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return index.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(parts)).cast("int")).join(copies, ["key", "part"], how).drop("part")


def _dealt(name: str, salt: str) -> Column:
    return F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(name)).cast("int")


def links(classes: DataFrame, plan: Plan) -> DataFrame:
    """Confirmed links ``a, b`` between distinct fingerprints ``fp``, enough to connect all that differ in at most ``bits`` bits."""
    index = classes.select("fp", variants(plan).alias("key"))
    crowded = stash(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > plan.block).select("key", F.ceil(F.col("n") / plan.block).cast("int").alias("blocks")), "crowded")
    some, bits = not crowded.isEmpty(), plan.bits
    blocks = _with_plan(index, crowded, "left").withColumn("block", F.coalesce(_dealt("blocks", "y"), F.lit(0))) if some else index.withColumn("block", F.lit(0))
    run_of = ["key", "block"]

    def inside(batches):
        for table in whole_runs(batches, run_of):
            yield _pairs(link_runs(run_numbers(table, run_of), table.column("fp").to_numpy(), bits))

    found = stash(_sorted(blocks.select(*run_of, "fp"), run_of).mapInArrow(inside, "a long, b long"), "links")
    if not some:
        unstash(crowded)
        return found

    met_at = ["key", "x", "y"]

    def across(batches):
        for table in whole_runs(batches, met_at):
            number, side = run_numbers(table, met_at), table.column("side").to_numpy()
            fp, comp = table.column("fp").to_numpy(), table.column("comp").to_numpy()
            cuts = [*np.flatnonzero(np.diff(number, prepend=-1)).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield _pairs(link_sides(fp[a:b], comp[a:b], int((side[a:b] == 0).sum()), bits))

    met = _meetings(_with_plan(index, crowded, "inner"), connected(found), plan)
    every = stash(found.unionByName(_sorted(met.select(*met_at, "side", "fp", "comp"), met_at, "side").mapInArrow(across, "a long, b long")), "links")
    unstash(crowded, found)
    return every


def _meetings(members: DataFrame, comps: DataFrame, plan: Plan) -> DataFrame:
    """Of crowded keys: blocks of members outside the key's largest component (side 0) against every block (side 1)."""
    named = stash(members.join(comps.select(F.col("v").alias("fp"), F.col("root").alias("comp")), "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "crowd")
    sizes = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("main"), F.sum("m").alias("n"))
    plans = main.select("key", F.col("main.comp").alias("main"), F.ceil((F.col("n") - F.col("main.m")) / plan.block).cast("int").alias("outside")).where("outside > 0")
    every = _with_plan(named, plans, "inner")
    first = every.where("comp <> main").withColumns({"side": F.lit(0), "x": _dealt("outside", "x"), "y": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    second = every.withColumns({"side": F.lit(1), "y": _dealt("blocks", "y"), "x": F.explode(F.sequence(F.lit(0), F.col("outside") - 1))})
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008  frozen
    """One row per input row: ``id_col, fingerprint, component_id``.

    Documents are linked where their fingerprints differ in at most ``bits`` bits;
    ``component_id`` is the least id reachable, ``fingerprint`` 16 lower-case hex
    digits. A text of fewer words than a shingle is one shingle; null, empty and
    blank texts have the fingerprint zero and are linked like any other. Every row is
    judged by its own text, also where ids repeat or are null; null ids are never the
    least id of a component unless all of it is null. Repeated rows come out as often
    as they came in. Very long texts are hashed whole. An empty input gives no rows.
    Other columns are not read.
    """
    each = stash(fingerprints(docs, plan, id_col=id_col, text_col=text_col), "fingerprints")
    parts = stash(each.groupBy("fp", "deal").agg(F.min("k").alias("k")), "parts")
    classes = stash(parts.groupBy("fp").agg(F.min("k").alias("k")), "classes")
    found = links(classes.select("fp"), plan)
    comps = connected(found).select(F.col("v").alias("fp"), "root")
    rooted = classes.join(comps, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = with_least(rooted, "root", "k", "component_id").select("fp", "component_id")
    placed = parts.select("fp", "deal").join(named, "fp")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return each.join(placed, ["fp", "deal"]).select(F.col("k").alias(id_col), digits.alias("fingerprint"), "component_id")
