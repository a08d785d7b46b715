"""The trie of conversation prefixes by partition refinement.

All conversations start in one class. Turn by turn, each active class is split by its
members' next turn; the parts are the nodes of the next depth. A class of one distinct
sequence is retired: its tail is a chain of nodes with one child each, which needs no
further splitting. Then sums are folded back from the deepest nodes to the root.

Turns are slim from the start: a digest of 128 bits and a number of characters.
Conversations of equal turns are one sequence with a multiplicity, so that many copies
do not stay active for their whole length. Classes of up to ``small`` turns are refined
to their ends inside one task each, so a round of jobs is only needed for each turn
that larger classes share. A class's rows are dealt into parts before its size goes back
to them, and long sequences are cut into blocks of turns: neither one first
turn nor one conversation with most of the rows is a task of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import run_numbers, stash, unstash, whole_runs

#: Turns of one sequence that are joined as one key.
BLOCK = 4096
#: Ids that are written out as one string.
_IDS = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``c, depth, digest, chars``: conversations in order of turn, null first, then role and text; ``depth`` counts from 1.

    Null roles and texts count as empty. Rows without a conversation id belong to no
    conversation. The order is that of a sort over all rows, so a long conversation
    lies in several partitions, whose numbers of rows are added up.
    """
    blank = F.lit("")
    role, text = F.coalesce(F.col(role_col), blank), F.coalesce(F.col(text_col), blank)
    named = rows.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    both = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    ordered = named.orderBy("c", F.col("turn").asc_nulls_first(), "role", "text")
    # The upper bits of the number are the partition, the lower 33 the row in it.
    slim = ordered.select("c", F.substring(F.unhex(both), 1, 16).alias("digest"), F.char_length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("at"))
    placed = stash(slim.withColumn("part", F.shiftright("at", 33)), "turns")
    starts = placed.groupBy("part", "c").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("part", "c", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return placed.join(starts, ["part", "c"]).select("c", (F.col("before") + F.col("at") - F.col("first") + 1).alias("depth"), "digest", "chars")


def _block(depth: str = "depth") -> Column:
    return F.floor(F.col(depth) / BLOCK)


def _blocks(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))).alias("block")


def rebuilt(numbered: DataFrame, *, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with turns of another: rows like ``numbered``, and ``c, n`` of all conversations, also those left without turns.

    The first ``h`` turns of conversation ``c`` become those of ``c - c % group``, as
    far as there are any; ``h`` is the crc32 of ``c`` in decimal digits, modulo ``most + 1``.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1)
    opening = F.sort_array(F.collect_list(F.struct("depth", "digest", "chars")))
    openings = numbered.where((F.col("depth") <= most) & (F.col("c") % group == 0)).groupBy("c").agg(opening.alias("opening"))
    sizes = numbered.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": h, "base": F.col("c") - F.col("c") % group})
    lent = sizes.join(openings.withColumnRenamed("c", "base"), "base", "left").withColumn("lent", F.least("h", F.coalesce(F.size("opening"), F.lit(0)).cast("long")))
    plan = stash(lent.select("c", "n", "h", "lent", F.when(F.col("lent") > 0, F.slice("opening", F.lit(1), F.col("lent").cast("int"))).alias("opening")), "openings")
    heads = plan.where("lent > 0").select("c", F.explode("opening").alias("t")).select("c", "t.depth", "t.digest", "t.chars")
    shift = plan.where("n > h").select("c", "h", "lent", _blocks(F.col("h") + 1, F.col("n")))
    own = numbered.where(F.col("depth") > h).withColumn("block", _block()).join(shift, ["c", "block"])
    rows = heads.unionByName(own.select("c", (F.col("depth") - F.col("h") + F.col("lent")).alias("depth"), "digest", "chars"))
    return rows, plan.select("c", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def sequences(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``seq, n, m, ends``: each distinct sequence of turns under its least conversation, its length, how many conversations are equal to it, and the hash of their ids.

    A sequence is known by its length and two 64-bit sums over depths and digests. Ids are
    sorted over all tasks and written out in strings of up to 4096, which are hashed
    in order; a task holds one of them at a time.
    """
    sums = [F.bit_xor(F.xxhash64(F.lit(i), "depth", "digest")).alias(f"s{i}") for i in (1, 2)]
    known = convs.join(rows.groupBy("c").agg(*sums), "c", "left").fillna(0, ["s1", "s2"])
    key = ["n", "s1", "s2"]

    def written(batches):
        for table in whole_runs(batches, key):
            at = run_numbers(table, key)
            starts = np.unique(np.concatenate((np.flatnonzero(np.diff(at, prepend=-1)), np.arange(0, len(at), _IDS))))
            ids = table.column("c").to_numpy()
            lines = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])]
            out = table.select(key).take(pa.array(starts)).to_pydict()
            yield pa.RecordBatch.from_pydict(out | {"first": ids[starts].tolist(), "m": np.diff(np.append(starts, len(ids))).tolist(), "ids": lines}, schema=pa.schema([*((k, pa.int64()) for k in (*key, "first", "m")), ("ids", pa.string())]))

    def hashed(batches):
        now, state, done = None, None, []
        for batch in batches:
            for n, s1, s2, first, m, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (n, s1, s2) != now:
                    if state:
                        done.append((*state[:3], state[3].hexdigest()))
                    now, state = (n, s1, s2), [first, n, m, hashlib.sha256(ids.encode())]
                else:
                    state[2] += m
                    state[3].update(b"," + ids.encode())
            yield _rows(done, ["seq", "n", "m", "ends"])
            done = []
        if state:
            yield _rows([(*state[:3], state[3].hexdigest())], ["seq", "n", "m", "ends"])

    parts = known.select(*key, "c").orderBy(*key, "c").mapInArrow(written, "n long, s1 long, s2 long, first long, m long, ids string")
    return parts.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(hashed, "seq long, n long, m long, ends string")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("ends", "ends_sha256") else pa.bool_() if n == "top" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def split(active: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """``active`` one turn further: each member with its new class ``node``, the class above as ``parent``, and the class's ``n_convs, n_seqs, n_turns``.

    Members are dealt into parts by ``seq``; sizes are summed by part, then by class,
    and go back to the parts that exist.
    """
    parts = max(32, int(active.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    moved = active.join(steps, "seq").withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(parts)).cast("int"))
    left = F.sum(F.col("n") - depth + 1)
    some = moved.groupBy("node", "digest", "part").agg(F.min("seq").alias("least"), F.sum("m").alias("convs"), F.count(F.lit(1)).alias("seqs"), left.alias("turns"))
    whole = some.groupBy("node", "digest").agg(F.min("least").alias("least"), F.sum("convs").alias("n_convs"), F.sum("seqs").alias("n_seqs"), F.sum("turns").alias("n_turns"), F.collect_set("part").alias("parts"))
    sized = moved.join(whole.withColumn("part", F.explode("parts")).drop("parts"), ["node", "digest", "part"])
    return sized.select("seq", "n", "m", "ends", F.col("node").alias("parent"), F.col("least").alias("node"), F.lit(depth).cast("long").alias("depth"), "chars", "n_convs", "n_seqs", "n_turns")


def refine(depth: int, parent: int | None, members: list[tuple]) -> list[tuple]:
    """The nodes of one class: members are ``(seq, n, m, ends, digests, chars)`` with turns from ``depth`` on; children stand behind their parents."""
    nodes: list[list] = []
    stack = [(members, depth, -1)]
    while stack:
        group, d, up = stack.pop()
        here = [x for x in group if x[1] == d]
        nodes.append([min(x[0] for x in group), d, nodes[up][0] if up >= 0 else parent, sum(x[2] for x in group), 0, 0, 0, here[0][3] if here else NO_ENDS, up, group[0][5][d - depth]])
        up = len(nodes) - 1
        if len(group) == 1:
            seq, n, m, ends, _, chars = group[0]
            nodes += [[seq, e, seq, m, 0, 0, 0, ends if e == n else NO_ENDS, up + e - d - 1, chars[e - depth]] for e in range(d + 1, n + 1)]
            continue
        parts: dict[bytes, list] = {}
        for x in group:
            if x[1] > d:
                parts.setdefault(x[4][d + 1 - depth], []).append(x)
        stack += [(part, d + 1, up) for part in parts.values()]
    for node in reversed(nodes):
        node[5] += node[4] == 0
        node[6] += (node[3] - 1) * node[9]
        if node[8] >= 0:
            above = nodes[node[8]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    return [(*node[:8], node[8] < 0) for node in nodes]


def _small_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of the classes in ``rows``, each refined in one task, with ``top`` for the class itself."""
    at, names = ["start", "node"], [*(x.split()[0] for x in NODE.split(", ")), "top"]

    def run(batches):
        for table in whole_runs(batches, at):
            number = run_numbers(table, at)
            cuts = [*np.flatnonzero(np.diff(number, prepend=-1)).tolist(), len(number)]
            columns = {n: table.column(n).to_pylist() for n in table.column_names}
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                members: list[tuple] = []
                for i in range(a, b):
                    if i == a or columns["seq"][i] != columns["seq"][i - 1]:
                        members.append((columns["seq"][i], columns["n"][i], columns["m"][i], columns["ends"][i], [], []))
                    members[-1][4].append(columns["digest"][i])
                    members[-1][5].append(columns["chars"][i])
                out += refine(columns["start"][a], columns["parent"][a], members)
            yield _rows(out, names)

    slim = rows.select(*at, "seq", "depth", "parent", "n", "m", "ends", "digest", "chars")
    return slim.repartition(*at).sortWithinPartitions(*at, "seq", "depth").mapInArrow(run, NODE + ", top boolean")


def _chains(rows: DataFrame) -> DataFrame:
    """Nodes of retired sequences: one a turn, with the sums of what lies behind it, by block and then inside each block."""
    saved = (F.col("m") - 1) * F.col("chars")
    # A sequence of one conversation saves nothing, so it needs no sums.
    alone = rows.where("m = 1").withColumn("saved", F.lit(0).cast("long"))
    several = rows.where("m > 1").withColumn("own", saved)
    behind = W.partitionBy("seq").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    later = several.groupBy("seq", "block").agg(F.sum("own").alias("own")).select("seq", "block", F.coalesce(F.sum("own").over(behind), F.lit(0)).alias("later"))
    inside = W.partitionBy("seq", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    summed = several.withColumn("inner", F.sum("own").over(inside)).join(later, ["seq", "block"]).withColumn("saved", F.col("inner") + F.col("later"))
    rows = alone.unionByName(summed.select(*alone.columns))
    last, first = F.col("depth") == F.col("n"), F.col("depth") == F.col("start")
    return rows.select(
        F.col("seq").alias("conv_id"), "depth", F.when(first, F.col("parent")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("m").alias("n_convs"),
        (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"), first.alias("top"),
    )


def trie(rows: DataFrame, convs: DataFrame, *, small: int = 20_000) -> DataFrame:
    """One row per node of the trie over ``c, depth, digest, chars`` (``rows``) and ``c, n`` (``convs``, with the turns of each).

    Returns ``conv_id`` (the least member), ``depth``, ``parent_conv_id`` (null for the
    root), ``n_convs, n_children, n_leaves``, ``saved_tokens`` (over the subtree, the
    characters of each node's last turn once for each member but one) and
    ``ends_sha256`` (of the sorted, comma-joined ids of members that end there).
    An empty input gives no rows.
    """
    rows = stash(rows, "rebuilt")
    seqs = stash(sequences(rows, convs), "sequences")
    spread = seqs.where("n > 0").select(F.col("seq").alias("c"), _blocks(F.lit(1), F.col("n")))
    own = rows.withColumn("block", _block()).join(spread, ["c", "block"]).select(F.col("c").alias("seq"), "depth", "block", "digest", "chars")
    steps = stash(own.sortWithinPartitions("depth"), "steps")
    unstash(rows)

    no, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    total = seqs.agg(F.min("seq").alias("least"), F.sum("m").alias("convs"), F.count(F.lit(1)).alias("seqs"), F.sum(F.col("n") + 1).alias("turns")).first()
    if not total.seqs:
        return steps.sparkSession.createDataFrame([], NODE)
    sizes = [F.lit(x).cast("long").alias(n) for n, x in (("n_convs", total.convs), ("n_seqs", total.seqs), ("n_turns", total.turns))]
    placed = seqs.select("seq", "n", "m", "ends", no.alias("parent"), F.lit(total.least).cast("long").alias("node"), zero.alias("depth"), zero.alias("chars"), *sizes)
    settles = (F.col("n_seqs") == 1) | (F.col("n_turns") <= small)
    settled, large = [], []
    while True:
        depth = len(large)
        placed = stash(placed, "placed")
        settled.append(placed.where(settles).select("seq", "n", "m", "ends", "parent", "node", F.col("depth").alias("start"), (F.col("n_seqs") == 1).alias("single")))
        ends = F.max(F.when(F.col("n") == F.col("depth"), F.col("ends")))
        big = stash(placed.where(~settles).groupBy("node").agg(F.first("parent").alias("parent"), F.first("n_convs").alias("n_convs"), F.first("chars").alias("chars"), ends.alias("ends")), "classes")
        if big.isEmpty():
            break
        large.append(big)
        active = placed.where(~settles & (F.col("n") > depth)).select("seq", "n", "m", "ends", "node")
        placed = split(active, steps.where(F.col("depth") == depth + 1).select("seq", "digest", "chars"), depth + 1)

    done = settled[0]
    for x in settled[1:]:
        done = done.unionByName(x)
    inner = done.where("n > 0").select("*", _blocks(F.greatest("start", F.lit(1)), F.col("n")))
    below = steps.join(inner, ["seq", "block"]).where("depth >= start")
    roots = settled[0].select("*", zero.alias("depth"), zero.alias("block"), F.lit(None).cast("binary").alias("digest"), zero.alias("chars"))
    below = stash(below.unionByName(roots.where("start = 0")), "settled")
    nodes = stash(_small_nodes(below.where("not single")).unionByName(_chains(below.where("single"))), "nodes")

    out, under = nodes.drop("top"), None
    for depth in reversed(range(len(large))):
        children = nodes.where(F.col("top") & (F.col("depth") == depth + 1)).select("parent_conv_id", "n_leaves", "saved_tokens")
        children = children if under is None else children.unionByName(under.select("parent_conv_id", "n_leaves", "saved_tokens"))
        sums = children.groupBy("parent_conv_id").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        joined = large[depth].join(sums.withColumnRenamed("parent_conv_id", "node"), "node", "left").fillna(0, ["n_children", "saved"])
        folded = joined.select(
            F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        under = stash(folded, "folded")
        out = out.unionByName(under)
    return out


def prefix_trie(conversations: DataFrame, *, small: int = 20_000) -> DataFrame:
    """The trie of all conversations as they are: see :func:`turns` for what null and repeated turns mean, :func:`trie` for the result."""
    numbered = stash(turns(conversations), "numbered")
    return trie(numbered, numbered.groupBy("c").agg(F.count(F.lit(1)).alias("n")), small=small)


def rebuilt_trie(conversations: DataFrame, *, small: int = 20_000) -> DataFrame:
    """The trie of conversations that open with turns of another, as :func:`rebuilt` says.

    Turns are put in order as :func:`turns` says; other columns are not read, and rows
    of equal turns count each. Very long texts are digested whole.
    """
    return trie(*rebuilt(stash(turns(conversations), "numbered")), small=small)


def oracle_sql() -> str:
    """The rows of :func:`rebuilt_trie` in DuckDB's SQL, over ``conversations``; crc32 is worked out bit by bit."""
    return """
WITH o AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, r, t) AS ts, c - c % 100 AS b,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda s, x: list_reduce(list_prepend(xor(s, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h
  FROM o GROUP BY c),
s AS (SELECT l.c, list_concat(list_slice(coalesce(b.ts, []), 1, l.h), list_slice(l.ts, l.h + 1, len(l.ts))) AS ts FROM l LEFT JOIN l b ON b.c = l.b),
p AS (SELECT c, d, list_slice(ts, 1, d) AS pre, CASE WHEN d > 0 THEN length(ts[d].t) ELSE 0 END AS chars, len(ts) = d AS done FROM s, unnest(generate_series(0, len(ts))) u(d)),
g AS (SELECT pre, d, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (done), '') AS ends FROM p GROUP BY pre, d),
k AS (SELECT list_slice(pre, 1, d - 1) AS pre, count(*) AS n FROM g WHERE d > 0 GROUP BY 1),
n AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k USING (pre)),
x AS (SELECT list_slice(pre, 1, a) AS pre, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM n, unnest(generate_series(0, d)) u(a) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, x.leaves AS n_leaves, CAST(x.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN x USING (pre) LEFT JOIN n up ON n.d > 0 AND up.pre = list_slice(n.pre, 1, n.d - 1)"""
