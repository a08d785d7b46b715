"""LM scoring by masked pseudo-likelihood.

A small network predicts a token from the two tokens before and the two after it:
the sum of one embedding per position, a tanh, and a softmax in two levels (a class
of tokens, then the token within it). A document's score is the sum over its tokens
of the log-probability of each given both sides.

Tokens are lower-cased words: the most frequent ones of the whole corpus, counted
by Spark, and hash buckets for the others. A word in a bucket is scored by the
bucket's probability given both sides times the word's share of the bucket by the
counts of the whole corpus, so every word has a probability of its own. Shares of
the words of a bounded lexicon go along with the network; those of all others come
from a join with the counts. Training masks a share of the positions
of every document each round, so that every position is a target in some round. Each
partition trains its own copy of the network on its rows; the copies are averaged,
weighted by masked tokens, in three steps of bounded fan-in on the executors, and
the average starts the next round. The driver only ever holds
one network and the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, buffers, most_frequent, row_groups, slices, stash, unstash, values

OFFSETS = (-2, -1, 1, 2)
#: Floats of the network that travel in one row, and copies that are averaged at once.
_FLOATS, _FAN = 1 << 14, 64
#: Distinct words that a task counts before it hands them on.
_COUNTED = 500_000


@dataclass(frozen=True)
class Shape:
    """``classes`` squared is the vocabulary: token 0 pads, ``buckets`` tokens stand for rarer words. Positions are dealt into ``mask`` parts; the rounds share them out, or go over them again if there are more rounds. ``lexicon`` bounds memory: counts of further words are joined."""

    classes: int = 32
    buckets: int = 63
    width: int = 24
    mask: int = 8
    rounds: int = 2
    rate: float = 0.1
    batch: int = 8192
    lexicon: int = 131_072

    @property
    def vocabulary(self) -> int:
        return self.classes**2

    @property
    def frequent(self) -> int:
        return self.vocabulary - self.buckets - 1

    def parts(self) -> dict[str, tuple[int, ...]]:
        v, c, d = self.vocabulary, self.classes, self.width
        return {"embed": (len(OFFSETS), v, d), "bias": (d,), "to_class": (d, c), "class_bias": (c,), "to_word": (c, d, c), "word_bias": (c, c)}

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, dims in self.parts().items():
            n = int(np.prod(dims))
            out[name] = flat[at : at + n].reshape(dims)
            at += n
        return out

    def initial(self) -> np.ndarray:
        size = sum(int(np.prod(d)) for d in self.parts().values())
        return (np.random.default_rng(7).standard_normal(size) * 0.05).astype(np.float32)


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct lower-cased words of a text column, the place among them of each word in order, and the number of words per text."""
    blob, at = buffers(pc.utf8_lower(column))
    if not len(blob):
        return pa.array([], pa.binary()), np.empty(0, np.int64), np.zeros(len(at) - 1, np.int64)
    letter = np.ones(256, bool)
    letter[list(SPACE_BYTES)] = False
    letter = letter[blob]
    begins = np.zeros(len(blob) + 1, bool)
    begins[at] = True
    begins[1:-1] |= ~letter[:-1]
    starts = np.flatnonzero(begins[:-1] & letter)
    # Without white space the words lie end to end.
    place = np.concatenate(([0], np.cumsum(letter, dtype=np.int32)))
    coded = values(blob[letter], np.append(place[starts], place[-1]), pa.binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(starts, at))


#: The table of the reflected polynomial of CRC-32.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def crc32s(words: pa.Array) -> np.ndarray:
    """CRC-32 of each word; all words advance together, a byte at a time."""
    blob, at = buffers(words)
    lengths = np.diff(at)
    crc = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    live, depth = np.argsort(-lengths, kind="stable"), 0
    while len(live := live[: np.searchsorted(-lengths[live], -depth, "left")]):
        now = crc[live]
        crc[live] = _CRC[(now ^ blob[at[live] + depth]) & 0xFF] ^ now >> 8
        depth += 1
    return crc ^ np.uint32(0xFFFFFFFF)


class Tokens:
    """Words to token numbers: frequent words first, in order of frequency, then buckets."""

    def __init__(self, frequent: list[bytes], shape: Shape):
        self.first, self.buckets = shape.frequent + 1, shape.buckets
        self.known = pa.array(frequent, pa.binary())

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The token of each word."""
        at = pc.index_in(words, value_set=self.known)
        ids = pc.fill_null(at, -1).to_numpy().astype(np.int64) + 1
        rest = np.flatnonzero(ids == 0)
        ids[rest] = self.bucket(words.take(pa.array(rest)))
        return ids

    def bucket(self, words: pa.Array) -> np.ndarray:
        return self.first + crc32s(words).astype(np.int64) % self.buckets


class Rare(NamedTuple):
    """What tells the words of a bucket apart. A word seen n times has the share (n + 1/2) / ``total`` of its bucket.

    ``total`` is, for a bucket of T words seen N times, N + T + 1: as much is left
    for words that were never seen as if there were T + 2 of them. ``lexicon`` and
    ``seen`` are the most frequent words in buckets and their counts, ``counts`` has
    all words.
    """

    lexicon: list[bytes]
    seen: list[int]
    total: np.ndarray
    counts: DataFrame


class Reader:
    """Texts to token numbers, the sums of the logarithms of shares as far as they are known here, and words whose counts are not."""

    def __init__(self, frequent: list[bytes], lexicon: list[bytes], seen: list[int], total: np.ndarray, shape: Shape):
        self.tokens, self.log_total = Tokens(frequent, shape), np.log(total)
        self.lexicon, self.log_seen = pa.array(lexicon, pa.binary()), np.log(np.array(seen, float) + 0.5)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """The tokens of all texts, their number per text, and per text the sum and the other words."""
        words, index, count = words_of(column)
        token = self.tokens.numbers(words)
        rare = token >= self.tokens.first
        share = np.where(rare, -self.log_total[np.where(rare, token - self.tokens.first, 0)], 0.0)
        at = pc.fill_null(pc.index_in(words, value_set=self.lexicon), -1).to_numpy()
        share[at >= 0] += self.log_seen[at[at >= 0]]
        unknown = (rare & (at < 0))[index]
        ends = np.concatenate(([0], np.cumsum(count)))
        sums = np.concatenate(([0.0], np.cumsum(share[index])))[ends]
        left = np.concatenate(([0], np.cumsum(unknown)))[ends]
        others = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.take(pa.array(index[unknown])))
        return token[index], count, np.diff(sums), others


def windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one line with two pads between them, and the places of their tokens."""
    pad = np.zeros(2, np.int64)
    line = np.concatenate([pad, *(x for i in ids for x in (i, pad))])
    real = np.zeros(len(line), bool)
    at = 2
    for i in ids:
        real[at : at + len(i)] = True
        at += len(i) + 2
    return line, np.flatnonzero(real)


def hidden(p: dict[str, np.ndarray], line: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = p["embed"][0].take(line[at + OFFSETS[0]], axis=0)
    for j in range(1, len(OFFSETS)):
        h += p["embed"][j].take(line[at + OFFSETS[j]], axis=0)
    h += p["bias"]
    return np.tanh(h, out=h)


def _order(x: np.ndarray, below: int) -> np.ndarray:
    """A stable order of whole numbers; short ones are sorted by their digits."""
    return np.argsort(x.astype(np.uint16) if below <= 1 << 16 else x, kind="stable")


def _by_class(group: np.ndarray, classes: int) -> tuple[np.ndarray, list[int]]:
    """An order in which each class is a slice, and the slices' bounds."""
    order = _order(group, classes)
    return order, np.searchsorted(group[order], np.arange(classes + 1)).tolist()


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each column, in place; a row is a class, so that sums and maxima run over whole rows at once."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def _log_chance(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of each column at one row of it."""
    x -= x.max(axis=0)
    own = x[target, np.arange(len(target))]
    return own - np.log(np.exp(x, out=x).sum(axis=0))


def _logits(h: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    x = weight.T @ h.T
    x += bias[:, None]
    return x


def log_probabilities(p: dict[str, np.ndarray], shape: Shape, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-probability of the token at each place, given its neighbours on both sides."""
    out = np.empty(len(at), np.float32)
    c = shape.classes
    for start in range(0, len(at), 32_768):
        where = at[start : start + 32_768]
        order, bounds = _by_class(line[where] // c, c)
        where = where[order]
        h, target = hidden(p, line, where), line[where]
        logs = _log_chance(_logits(h, p["to_class"], p["class_bias"]), target // c)
        for k in range(c):
            rows = slice(bounds[k], bounds[k + 1])
            if bounds[k] < bounds[k + 1]:
                logs[rows] += _log_chance(_logits(h[rows], p["to_word"][k], p["word_bias"][k]), target[rows] % c)
        out[start + order] = logs
    return out


def gradient(p: dict[str, np.ndarray], shape: Shape, line: np.ndarray, at: np.ndarray, out: dict[str, np.ndarray]) -> None:
    """Put the mean gradient of the negative log-probability into ``out``."""
    n, c = len(at), shape.classes
    order, bounds = _by_class(line[at] // c, c)
    at = at[order]
    h, target = hidden(p, line, at), line[at]
    g = _softmax(_logits(h, p["to_class"], p["class_bias"]))
    g[target // c, np.arange(n)] -= 1
    g /= n
    out["to_class"][:] = (g @ h).T
    out["class_bias"][:] = g.sum(axis=1)
    dh = g.T @ p["to_class"].T
    out["to_word"][:] = 0
    out["word_bias"][:] = 0
    for k in range(c):
        if bounds[k] < bounds[k + 1]:
            rows = slice(bounds[k], bounds[k + 1])
            g = _softmax(_logits(h[rows], p["to_word"][k], p["word_bias"][k]))
            g[target[rows] % c, np.arange(g.shape[1])] -= 1
            g /= n
            out["to_word"][k] = (g @ h[rows]).T
            out["word_bias"][k] = g.sum(axis=1)
            dh[rows] += g.T @ p["to_word"][k].T
    dh *= 1 - h * h
    out["bias"][:] = dh.sum(axis=0)
    out["embed"][:] = 0
    for j, offset in enumerate(OFFSETS):
        near = line[at + offset]
        order = _order(near, shape.vocabulary)
        starts = np.flatnonzero(np.diff(near[order], prepend=-1))
        out["embed"][j][near[order][starts]] = np.add.reduceat(dh.take(order, axis=0), starts, axis=0)


class Trainer:
    """Adaptive-rate descent over batches of masked positions; one per partition and round."""

    def __init__(self, flat: np.ndarray, shape: Shape, round_: int):
        self.flat, self.shape, self.round = flat.copy(), shape, round_
        self.step, self.seen = np.zeros_like(flat), np.full_like(flat, 1e-8)
        self.p, self.g = shape.split(self.flat), shape.split(self.step)
        self.tokens = 0
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids):
            self.held.append(ids)
            self.waiting += len(ids)
        if self.waiting >= self.shape.batch * min(self.shape.mask, self.shape.rounds):
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        line, at = windows(self.held)
        self.held, self.waiting = [], 0
        # Which positions are masked depends on the round, the place in the batch and the token alone.
        key = (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line[at].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
        at = at[key % np.uint64(self.shape.mask) % np.uint64(self.shape.rounds) == self.round % self.shape.mask]
        for start in range(0, len(at), self.shape.batch):
            part = at[start : start + self.shape.batch]
            gradient(self.p, self.shape, line, part, self.g)
            self.seen += self.step * self.step
            self.flat -= self.shape.rate * self.step / np.sqrt(self.seen)
            self.tokens += len(part)


def count_words(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``word, n`` over all texts; tasks add up before they hand on."""

    def run(batches):
        held: list[pa.Table] = []
        rows = 0

        def counted():
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for start, stop in row_groups(batch.column(0)):
                words, index, _ = words_of(batch.column(0).slice(start, stop - start))
                n = np.bincount(index, minlength=len(words))
                # White space stands among the distinct words, but nowhere as a word.
                held.append(pa.table({"word": words, "n": pa.array(n, pa.int64())}).filter(pa.array(n > 0)))
                rows += held[-1].num_rows
                if rows > 2 * _COUNTED:
                    held = [counted()]
                    rows = held[0].num_rows
                    if rows > _COUNTED:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from counted().to_batches()

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "word binary, n long")
    return stash(rows.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(counts: DataFrame, shape: Shape) -> tuple[list[bytes], Rare]:
    """The most frequent words, most frequent first, and what tells the others apart."""
    rows = most_frequent(counts, shape.frequent + shape.lexicon).orderBy(F.desc("n"), "word").collect()
    words, rest = [bytes(r.word) for r in rows[: shape.frequent]], rows[shape.frequent :]
    total = np.ones(shape.buckets)
    for r in counts.groupBy((F.crc32("word") % shape.buckets).alias("b")).agg((F.sum("n") + F.count(F.lit(1))).alias("m")).collect():
        total[r.b] += r.m
    for r, bucket in zip(rows[: shape.frequent], (crc32s(pa.array(words, pa.binary())) % shape.buckets).tolist(), strict=True):
        total[bucket] -= r.n + 1
    return words, Rare([bytes(r.word) for r in rest], [r.n for r in rest], total, counts)


def encoded(docs: DataFrame, words: list[bytes], rare: Rare, shape: Shape, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, k, ids, shares, words`` for every input row, written once for all passes over the tokens.

    ``ids`` are packed unsigned 16-bit token numbers, ``shares`` the sum of the
    logarithms of the shares that the bounded lexicon knows and ``words`` the others.
    """
    if shape.vocabulary > 1 << 16:
        raise ValueError("token numbers have 16 bits")
    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    lexicon, seen, total, _ = rare

    def run(batches):
        read, row = Reader(words, lexicon, seen, total, shape), TaskContext.get().partitionId() << 40
        for batch in batches:
            for start, stop in row_groups(batch.column(1)):
                part = batch.slice(start, stop - start)
                ids, count, shares, others = read(part.column(1))
                packed = values(ids.astype(np.uint16).view(np.uint8), 2 * np.concatenate(([0], np.cumsum(count))), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(part)), pa.int64()), part.column(0), packed, pa.array(shares), others], names=["row", "k", "ids", "shares", "words"])
                row += len(part)

    kind = dict(slim.dtypes)["k"]
    return stash(slim.mapInArrow(run, f"row long, k {kind}, ids binary, shares double, words array<binary>"), "tokens")


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64) for x in column]


def fit(rows: DataFrame, shape: Shape) -> np.ndarray:
    """The network's parameters, trained on the tokens of every row of :func:`encoded`."""
    flat = shape.initial()
    for round_ in range(shape.rounds):

        def run(batches, flat=flat, round_=round_):
            trainer = Trainer(flat, shape, round_)
            for batch in batches:
                for part in slices(batch):
                    for ids in _unpacked(part.column(0)):
                        trainer.add(ids)
            trainer.flush()
            if trainer.tokens:
                blocks = [trainer.flat[i : i + _FLOATS].tobytes() for i in range(0, len(trainer.flat), _FLOATS)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([float(trainer.tokens)] * len(blocks)), pa.array(blocks, pa.binary())], names=["block", "weight", "values"])

        schema = "block int, part int, weight double, values binary"
        copies = rows.select("ids").mapInArrow(run, "block int, weight double, values binary").withColumn("part", F.spark_partition_id())
        # A group of each step averages at most _FAN copies of one block, as long as there are no more than _FAN cubed partitions.
        for parts in (_FAN * _FAN, _FAN, 1):
            copies = copies.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("block", "part").applyInArrow(_average, schema)
        found = copies.orderBy("block").collect()
        if found:
            flat = np.concatenate([np.frombuffer(r["values"], np.float32) for r in found])
    return flat


def train(docs: DataFrame, shape: Shape = Shape(), *, text_col: str = "text") -> tuple[list[bytes], np.ndarray, Rare]:  # noqa: B008  frozen
    """The vocabulary, the network's parameters, trained on every text, and what tells words in buckets apart."""
    words, rare = vocabulary(count_words(docs, text_col=text_col), shape)
    rows = encoded(docs, words, rare, shape, id_col=text_col, text_col=text_col)
    flat = fit(rows, shape)
    unstash(rows)
    return words, flat, rare


def _average(table: pa.Table) -> pa.Table:
    weights = np.array(table.column("weight").to_pylist())
    # In order of content, since rows of a group arrive in any order.
    rows = sorted(zip(weights.tolist(), table.column("values").to_pylist(), strict=True))
    total, out = float(weights.sum()), 0.0
    for w, raw in rows:
        out = out + np.frombuffer(raw, np.float32).astype(np.float64) * (w / total)
    first = {c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("block", "part")}
    return pa.table({**first, "weight": [total], "values": pa.array([out.astype(np.float32).tobytes()], pa.binary())})


def score_encoded(rows: DataFrame, flat: np.ndarray, counts: DataFrame, shape: Shape, *, id_col: str = "doc_id") -> DataFrame:
    """The scores of the rows of :func:`encoded`, as :func:`score` returns them."""

    def run(batches):
        p = shape.split(flat)
        for batch in batches:
            for part in slices(batch):
                ids = _unpacked(part.column(2))
                n = np.array([len(i) for i in ids], np.int64)
                line, at = windows(ids)
                logs = np.bincount(np.repeat(np.arange(len(ids)), n), weights=log_probabilities(p, shape, line, at), minlength=len(ids)) + part.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(logs)], names=["row", "k", "n_tokens", "logs"])

    kind = dict(rows.dtypes)["k"]
    known = rows.select("row", "k", "ids", "shares").mapInArrow(run, f"row long, k {kind}, n_tokens long, logs double")
    # A word outside the lexicon was seen as often as the counts say, or never.
    share = F.log(F.coalesce(F.col("n"), F.lit(0)) + 0.5)
    joined = rows.select("row", F.explode("words").alias("word")).join(counts, "word", "left").groupBy("row").agg(F.sum(share).alias("joined"))
    both = F.col("logs") + F.coalesce(F.col("joined"), F.lit(0.0))
    return known.join(joined, "row", "left").select(F.col("k").alias(id_col), "n_tokens", both.alias("log_likelihood"), (both / F.greatest(F.col("n_tokens"), F.lit(1))).alias("mean_log_likelihood"))


def score(docs: DataFrame, words: list[bytes], flat: np.ndarray, rare: Rare, shape: Shape = Shape(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008  frozen
    """One row per input row: ``id_col, n_tokens, log_likelihood, mean_log_likelihood``.

    Whole texts are scored. Null texts and texts without words have no tokens, a sum
    and a mean of 0. Repeated rows, also of one id or of a null id, are scored each.
    Very long texts are scored whole. An empty table gives no rows, and a network
    trained on one scores with its first weights. Other columns are not read.
    """
    return score_encoded(encoded(docs, words, rare, shape, id_col=id_col, text_col=text_col), flat, rare.counts, shape, id_col=id_col)


def train_and_score(docs: DataFrame, shape: Shape = Shape(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008  frozen
    """:func:`score` of the texts on which the network is trained, which are cut into tokens once for both."""
    words, rare = vocabulary(count_words(docs, text_col=text_col), shape)
    rows = encoded(docs, words, rare, shape, id_col=id_col, text_col=text_col)
    return score_encoded(rows, fit(rows, shape), rare.counts, shape, id_col=id_col)
