"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its word shingles. Its signature has ``chunks`` chunks of
``width`` MinHash symbols of 8 bits. Two signatures that differ in at most
``2 * chunks - 1`` symbols agree, by the pigeonhole principle, on some chunk up to
one symbol; so every chunk is indexed under ``width`` keys, each leaving one symbol
out, and all such pairs share a key. For the default similarity of 0.85, 9 chunks of
8 symbols miss a pair that lies exactly on the threshold with probability 7e-5, and
pairs above it less often still. Shared keys only propose: links are confirmed on
the full sets.

Equal sets are one class from the start, known by 128 bits of a digest. Documents that share keys form families,
found as components of stars, so a key with many members costs one edge each.
Classes that meet in one Arrow batch are tied there, and only one of them takes
each key further, so a key that most documents share crosses the shuffle once a
batch. Families are dealt into blocks of a bounded number of bytes; a block is a
shuffle key of its own, so a family's blocks go to different tasks. A block compares its
members' signatures, then their sets, nearest first, and skips pairs that are
connected already. In families of several blocks, two differently salted dealings
join nearly all; the rest, members outside the family's largest component, meet
every block. No step holds more than two blocks or emits more links than members.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import publish, published, slices, stash, unstash
from .components import connected, parts_of, with_least

_MIX1, _MIX2, _STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_LOW_BITS, _TOP_BITS = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
_CACHE = 500_000


@dataclass(frozen=True)
class Plan:
    """Shingle length, threshold in percent, the signature's shape, and how many bits of a set's first number are kept (fewer only in tests)."""

    words: int = 3
    percent: int = 85
    chunks: int = 9
    width: int = 8
    block_bytes: int = 8 << 20
    id_bits: int = 64

    @staticmethod
    def near(words: int, percent: int, miss: float = 1e-4) -> Plan:
        """The fewest chunks that miss a pair on the threshold with probability at most ``miss``."""
        s = percent / 100
        width = 8 if percent >= 85 else 6
        alone = 1 - (s**width + width * (1 - s) * s ** (width - 1))
        return Plan(words, percent, int(np.ceil(np.log(miss) / np.log(alone))), width)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, q: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``q``-word shingles; a shorter text is one shingle, a text without words none."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    q = min(q, n)
    out = np.full(n - q + 1, q, np.uint64)
    for j in range(q):
        out = _mix(out * _STEP + h[j : n - q + 1 + j])
    return np.unique(out)


def set_id(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """128 bits of a digest of the set, as two signed numbers; the first may be cut short to try collisions."""
    high, low = divmod(xxhash.xxh3_128_intdigest(shingles.tobytes()), 1 << 64)
    return (high >> 64 - bits) - (1 << 63), low - (1 << 63)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _STEP)
    return x[:n] | np.uint64(1), x[n:]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """One unsigned 64-bit integer per chunk; its low ``width`` bytes are the chunk's symbols."""
    least = np.full(len(a), ~np.uint64(0))
    for i in range(0, len(shingles), 1024):
        y = shingles[i : i + 1024, None] * a
        y += b
        np.minimum(least, y.min(axis=0), out=least)
    symbols = (_mix(least) >> np.uint64(56)).astype(np.uint8).reshape(-1, width)
    out = np.zeros((len(symbols), 8), np.uint8)
    out[:, :width] = symbols
    return out.view("<u8")[:, 0]


def signatures(docs: DataFrame, plan: Plan, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k, h, n, i1, i2, c0, c1, ...``: id, hash of the text, set size, set id and the signature's chunks, a row per input row."""
    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    names = [f"c{i}" for i in range(plan.chunks)]

    def run(batches):
        hashes = _WordHashes()
        a, b = permutations(plan.chunks * plan.width)
        for batch in batches:
            for part in slices(batch):
                n, ids, sig = [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, plan.words, hashes)
                    n.append(len(s))
                    ids.append(set_id(s, plan.id_bits))
                    sig.append(signature(s, a, b, plan.width))
                chunks = np.array(sig, np.uint64).reshape(-1, plan.chunks).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), *(pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1)), *(pa.array(chunks[:, i].copy()) for i in range(plan.chunks))], names=["k", "h", "n", "i1", "i2", *names])

    kind = dict(slim.dtypes)["k"]
    return slim.mapInArrow(run, f"k {kind}, h long, n long, i1 long, i2 long, " + ", ".join(f"{c} long" for c in names))


def keys(sig: np.ndarray, plan: Plan) -> np.ndarray:
    """For each row of chunks, the keys: for each chunk and each of its symbols, a hash of the chunk without that symbol."""
    out = np.empty((len(sig), plan.chunks * plan.width), np.uint64)
    for i in range(plan.chunks):
        for j in range(plan.width):
            at = i * plan.width + j
            out[:, at] = _mix((sig[:, i] & ~np.uint64(0xFF << 8 * j)) + np.uint64((at + 1) * int(_STEP) % (1 << 64)))
    return out


def tied(cid: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For each class the least class that it shares keys with, directly or through others, among these classes."""
    n, width = found.shape
    order = np.argsort(found, axis=None)
    owner, flat = order // width, found.reshape(-1)[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    many = np.repeat(np.diff(np.append(starts, len(flat))) > 1, np.diff(np.append(starts, len(flat))))
    owner, flat = owner[many], flat[many]
    least = cid.copy()
    if not len(flat):
        return least
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    sizes = np.diff(np.append(starts, len(flat)))
    while True:
        after = least.copy()
        np.minimum.at(after, owner, np.repeat(np.minimum.reduceat(least[owner], starts), sizes))
        if (after == least).all():
            return least
        least = after


def spread(classes: DataFrame, plan: Plan) -> DataFrame:
    """``key, lead, others``: the keys of the classes of each Arrow batch, once a batch, under the least class that shares them there.

    ``others`` are the classes that stand behind ``lead`` in that batch; they go
    along with one of its keys.
    """
    names = [f"c{i}" for i in range(plan.chunks)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4096):
                cid = part.column("cid").to_numpy()
                found = keys(np.column_stack([part.column(c).to_numpy() for c in names]).view(np.uint64), plan)
                lead = tied(cid, found)
                key = found.view(np.int64).reshape(-1)
                first = np.unique(key, return_index=True)[1]
                key, owner = key[first], lead[first // found.shape[1]]
                behind: dict[int, list[int]] = {}
                for member, of in zip(cid[cid != lead].tolist(), lead[cid != lead].tolist(), strict=True):
                    behind.setdefault(of, []).append(member)
                others: list[list[int]] = [[]] * len(key)
                where = dict(zip(owner.tolist(), range(len(key)), strict=True)) if behind else {}
                for of, members in behind.items():
                    others[where[of]] = members
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner), pa.array(others, pa.list_(pa.int64()))], names=["key", "lead", "others"])

    return classes.select("cid", *names).mapInArrow(run, "key long, lead long, others array<long>")


def families(classes: DataFrame, plan: Plan) -> DataFrame:
    """``v, root``: classes that share a key, directly or through others. All that stands behind a key is tied to the key's least class."""
    rows = spread(classes, plan).repartition("key")
    least = rows.groupBy("key").agg(F.min("lead").alias("least"), F.count(F.lit(1)).alias("m"), F.sum(F.size("others")).alias("tied"))
    joined = rows.join(least.where("m > 1 or tied > 0").select("key", "least"), "key").where("lead <> least or size(others) > 0")
    edges = F.concat(F.array(F.struct(F.col("lead").alias("a"), F.col("least").alias("b"))), F.transform("others", lambda x: F.struct(x.alias("a"), F.col("lead").alias("b"))))
    return connected(joined.select(F.explode(edges).alias("e")).select("e.a", "e.b"))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Jaccard similarity of two sorted sets, compared exactly."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def link(plan: Plan, cid: list[int], sig: np.ndarray, sets: list[np.ndarray], comp: list[int], left: int | None = None) -> list[tuple[int, int]]:
    """Links that connect all members whose sets are similar and whose signatures share a key.

    ``comp`` says what is connected already. With ``left``, only pairs of one of the
    first ``left`` members with one of the others are looked at.
    """
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := parent.get(v, v)) != v:
            parent[v] = parent.get(p, p)
            v = parent[v]
        return v

    n = len(cid)
    size = np.array([len(s) for s in sets], np.int64)
    # In order of size, the members that can be similar to one are a slice.
    first, second = (np.arange(n),) * 2 if left is None else (np.arange(left), np.arange(left, n))
    second = second[np.argsort(size[second], kind="stable")]
    first = second if left is None else first
    ordered, chunks, names = size[second], np.ascontiguousarray(sig[second]).view(np.uint64), np.array(comp)
    other = names[second]
    found: list[tuple[int, int]] = []
    pairs, held = [], 0
    for place, i in enumerate(first.tolist()):
        low = place + 1 if left is None else int(np.searchsorted(100 * ordered, plan.percent * size[i]))
        high = int(np.searchsorted(plan.percent * ordered, 100 * size[i], "right"))
        differ = _differing(chunks[low:high], sig[i].view(np.uint64))
        near = np.flatnonzero(((differ & (differ - np.uint64(1))) == 0).any(axis=1) & (other[low:high] != names[i]))
        if len(near):
            pairs.append(np.column_stack([np.bitwise_count(differ[near]).sum(axis=1, dtype=np.int64), np.full(len(near), i), second[low + near]]))
            held += len(near)
        if held > 200_000:
            _confirm(pairs, plan, cid, sets, comp, find, parent, found)
            pairs, held = [], 0
    _confirm(pairs, plan, cid, sets, comp, find, parent, found)
    return found


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Chunks of which the top bit of each byte is set where the bytes differ."""
    d = x ^ y
    return (((d & _LOW_BITS) + _LOW_BITS) | d) & _TOP_BITS


def _confirm(pairs, plan, cid, sets, comp, find, parent, found) -> None:
    if not pairs:
        return
    every = np.concatenate(pairs)
    for _, i, j in every[np.argsort(every[:, 0], kind="stable")].tolist():
        a, b = find(comp[i]), find(comp[j])
        if a != b and similar(sets[i], sets[j], plan.percent):
            parent[a] = b
            found.append((cid[i], cid[j]))


def _block_linker(plan: Plan):
    """For one block, or two that meet: members on side 1, if any, are compared with those on side 0 only."""

    def run(table: pa.Table) -> pa.Table:
        seen: dict[tuple[int, int], int] = {}
        side, cids = table.column("side").to_pylist(), table.column("cid").to_pylist()
        for i, key in enumerate(zip(side, cids, strict=True)):
            seen.setdefault(key, i)
        order = sorted(seen.values(), key=lambda i: (side[i], cids[i]))
        table = table.take(pa.array(order, pa.int64()))
        cid, comp = table.column("cid").to_pylist(), table.column("comp").to_pylist()
        sig = np.column_stack([table.column(f"c{i}").to_numpy() for i in range(plan.chunks)]).astype(np.int64) if cid else np.empty((0, plan.chunks), np.int64)
        sets = [np.frombuffer(s, "<u8") for s in table.column("shingles").to_pylist()]
        left = table.column("side").to_pylist().count(0) if any(side) else None
        links = link(plan, cid, sig, sets, comp, left)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


#: Bits of the filter of family texts: at least so many a text, and no more in all (64 MB).
_BITS_EACH, _MOST_BITS = 16, 1 << 29
_BLOCK_BITS = 1 << 16


def text_filter(hashes: DataFrame, label: str) -> tuple[str, int]:
    """A bitmap in which the texts with these hashes (``h``) have their bit, published under a name; and its number of bits.

    Tasks make it block by block; its size is bounded whatever the number of texts,
    and a bit that another text shares only lets that text through.
    """
    wanted = min(_MOST_BITS, max(_BLOCK_BITS, _BITS_EACH * hashes.count()))
    bits = 1 << (wanted - 1).bit_length()

    def block(table: pa.Table) -> pa.Table:
        flags = np.zeros(_BLOCK_BITS, np.uint8)
        flags[table.column("slot").to_numpy() % _BLOCK_BITS] = 1
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    slots = hashes.select(F.pmod("h", F.lit(bits)).alias("slot")).distinct().withColumn("block", F.floor(F.col("slot") / _BLOCK_BITS))
    out = bytearray(bits // 8)
    for r in slots.groupBy("block").applyInArrow(block, "block long, bits binary").toLocalIterator():
        out[r.block * _BLOCK_BITS // 8 : (r.block + 1) * _BLOCK_BITS // 8] = r.bits
    return publish(hashes.sparkSession, bytes(out), label), bits


def passes_filter(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    slot = np.mod(hashes, bits)
    return (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0


def _member_sets(docs: DataFrame, classes: DataFrame, family: DataFrame, plan: Plan, text_col: str) -> DataFrame:
    """The members of families with their full sets, made again from one text of each class.

    Texts are found by their hashes, not by ids, which may be null or repeated; a
    task sends a text once, however many copies of it there are, and only if a
    bitmap of the wanted hashes lets it through, so other texts stay where they are.
    """
    names = [f"c{i}" for i in range(plan.chunks)]
    chosen = stash(classes.join(family, classes.cid == family.v).select(F.col("best.h").alias("h"), "cid", "i1", "i2", "root", *names), "chosen")
    name, bits = text_filter(chosen.select("h"), "family-texts")
    slim = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))

    def once(batches):
        seen: set[int] = set()
        bitmap = np.fromfile(published(name), np.uint8)
        for batch in batches:
            at = np.flatnonzero(passes_filter(bitmap, bits, batch.column(0).to_numpy())).tolist()
            hashes = batch.column(0).take(pa.array(at, pa.int64())).to_pylist()
            new = [i for i, h in zip(at, hashes, strict=True) if h not in seen and not seen.add(h)]
            if len(seen) > _CACHE:
                seen.clear()
            yield batch.take(pa.array(new, pa.int64()))

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t, plan.words, hashes) for t in part.column("t").to_pylist()]
                same = [set_id(s, plan.id_bits) == c for s, c in zip(sets, zip(*(part.column(c).to_pylist() for c in ("i1", "i2")), strict=True), strict=True)]
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("root", "cid", *names)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["root", "cid", *names, "shingles"])
                yield out.filter(pa.array(same, pa.bool_()))

    texts = slim.mapInArrow(once, "h long, t string").join(chosen, "h")
    return texts.mapInArrow(run, "root long, cid long, " + ", ".join(f"{c} long" for c in names) + ", shingles binary")


def _with_plan(members: DataFrame, plans: DataFrame, how: str) -> DataFrame:
    """The members with the row of their family; the members of one family are dealt into parts for this."""
    parts = parts_of(members)
    part = F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("int")
    copies = plans.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return members.withColumn("part", part).join(copies, ["root", "part"], how).drop("part")


def _blocks(bytes_: Column, plan: Plan) -> Column:
    return F.ceil(bytes_ / plan.block_bytes).cast("int")


def _dealt(rows: DataFrame, *names: str) -> DataFrame:
    """Blocks as one column of their own: rows that lie by family are not taken to lie by block."""
    return rows.withColumn("deal", F.xxhash64("root", *names)).groupBy("deal")


def class_links(docs: DataFrame, classes: DataFrame, plan: Plan, *, text_col: str = "text") -> DataFrame:
    """Confirmed links ``a, b`` between classes, enough to connect all that similarity connects."""
    family = stash(families(classes, plan), "family")
    members = stash(_member_sets(docs, classes, family, plan, text_col), "members")
    large = stash(members.groupBy("root").agg(_blocks(F.sum(F.length("shingles") + 128), plan).alias("blocks")).where("blocks > 1"), "large")
    dealt = _with_plan(members, large, "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "side": F.lit(0), "comp": F.col("cid")})
    schema, run = "a long, b long", _block_linker(plan)

    def block(salt: str):
        return F.pmod(F.xxhash64("cid", F.lit(salt)), F.col("blocks")).cast("int")

    links = _dealt(dealt.withColumn("block", block("one")), "block").applyInArrow(run, schema)
    again = _dealt(dealt.where("blocks > 1").withColumn("block", block("two")), "block").applyInArrow(run, schema)
    some = large.isEmpty()
    links = stash(links if some else links.unionByName(again), "links")
    if some:
        unstash(family, members, large)
        return links

    met = _dealt(_meetings(members, large, connected(links), plan), "x", "y").applyInArrow(run, schema)
    every = stash(links.unionByName(met), "links")
    unstash(family, members, large, links)
    return every


def _meetings(members: DataFrame, large: DataFrame, comps: DataFrame, plan: Plan) -> DataFrame:
    """In families of several blocks: blocks of members outside the largest component (side 0) against every block (side 1)."""
    named = _with_plan(members, large, "inner").join(comps.select(F.col("v").alias("cid"), F.col("root").alias("comp")), "cid", "left")
    named = named.withColumn("comp", F.coalesce("comp", "cid"))
    sizes = named.groupBy("root", "comp", "blocks").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("shingles") + 128).alias("bytes"))
    main = sizes.groupBy("root", "blocks").agg(F.max(F.struct("m", "comp", "bytes")).alias("main"), F.sum("bytes").alias("bytes"))
    plans = stash(main.select("root", "blocks", F.col("main.comp").alias("main"), _blocks(F.col("bytes") - F.col("main.bytes"), plan).alias("outside")).where("outside > 0"), "meetings")
    every = _with_plan(named.drop("blocks"), plans, "inner")
    x = F.pmod(F.xxhash64("cid", F.lit("x")), F.col("outside")).cast("int")
    y = F.pmod(F.xxhash64("cid", F.lit("y")), F.col("blocks")).cast("int")
    first = every.where("comp <> main").withColumns({"side": F.lit(0), "x": x, "y": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    second = every.withColumns({"side": F.lit(1), "y": y, "x": F.explode(F.sequence(F.lit(0), F.col("outside") - 1))})
    return first.unionByName(second)


def _judged(docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """``k, h, n, rep, best`` for every input row; ``rep`` and ``best`` are the first rows ``(no_id, k, h)`` of its class and its component, null without shingles."""
    each = stash(signatures(docs, plan, id_col=id_col, text_col=text_col), "signatures")
    row = F.struct(F.col("k").isNull().alias("no_id"), "k", "h")
    chunks = [F.first(f"c{i}").alias(f"c{i}") for i in range(plan.chunks)]
    # A class is a set of 128 bits. Its number in links is the first half, or, where another set has that too, a hash of both.
    sets = each.where("n > 0").groupBy("i1", "i2").agg(F.min(row).alias("best"), *chunks)
    first = F.row_number().over(W.partitionBy("i1").orderBy("i2")) == 1
    classes = stash(sets.withColumn("cid", F.when(first, F.col("i1")).otherwise(F.xxhash64("i1", "i2"))), "classes")
    links = class_links(docs, classes, plan, text_col=text_col)
    comps = connected(links).select(F.col("v").alias("cid"), "root")
    rooted = classes.select("cid", "i1", "i2", F.col("best").alias("rep")).join(comps, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = stash(with_least(rooted, "root", "rep", "best").select("i1", "i2", "rep", "best"), "named")
    unstash(classes, links, comps)
    some = each.where("n > 0").select("k", "h", "n", "i1", "i2").join(named, ["i1", "i2"]).select("k", "h", "n", "rep", "best")
    none = F.lit(None).cast(named.schema["best"].dataType)
    return some.unionByName(each.where("n = 0").select("k", "h", "n", none.alias("rep"), none.alias("best")))


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008  frozen
    """One row per input row: ``id_col, n_shingles, class_id, component_id, kept``.

    Documents are linked where 100 times the intersection of their shingle sets is
    at least ``percent`` times the union; ``component_id`` is the least id reachable.
    Null texts and texts without words have no shingles, are linked with nothing and
    kept. Every row is judged by its own text, also where ids repeat or are null:
    rows of one id may be in several components. The component of rows without
    ids has a null id, and of its texts one is kept. Rows alike in id and text are
    judged alike. Very long texts are hashed whole. An empty input gives no rows.
    Other columns are not read.
    """
    rows = _judged(docs, plan, id_col, text_col)
    alone = F.col("best").isNull()
    chosen = F.col("k").eqNullSafe(F.col("best.k")) & (F.col("k").isNotNull() | (F.col("h") == F.col("best.h")))
    return rows.select(
        F.col("k").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(alone, F.col("k")).otherwise(F.col("rep.k")).alias("class_id"),
        F.when(alone, F.col("k")).otherwise(F.col("best.k")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(chosen).alias("kept"),
    )


def keep(docs: DataFrame, plan: Plan, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when one row of each component does.

    The row with the least id stays, a null id coming last and the least hash of the
    text deciding among equal ids; of rows alike in id and text one stays. So a text
    goes only if a copy or near copy of it stays, whatever the ids are. Rows without
    shingles (null, empty and blank texts) all stay. An empty input gives no rows.
    """
    rows = stash(_judged(docs, plan, id_col, text_col).select("k", "h", "n", "best").where("n > 0"), "verdicts")
    stays = F.col("k").eqNullSafe(F.col("best.k")) & (F.col("h") == F.col("best.h"))
    gone = rows.where(~stays).select("k", "h").distinct()
    repeated = stash(rows.where(stays).groupBy("k", "h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k", "h"), "repeated")
    name = "__h"
    while name in docs.columns:
        name += "_"
    hashed = docs.withColumn(name, F.xxhash64(text_col))

    def of(names: DataFrame):
        names = names.select(F.col("k").alias("k_" + name), F.col("h").alias("g_" + name))
        return names, hashed[id_col].eqNullSafe(names["k_" + name]) & (hashed[name] == names["g_" + name])

    left = hashed.join(*of(gone), "left_anti")
    if not repeated.isEmpty():
        several = left.join(*of(repeated), "left_semi").dropDuplicates([id_col, text_col])
        left = left.join(*of(repeated), "left_anti").unionByName(several)
    return left.drop(name)
