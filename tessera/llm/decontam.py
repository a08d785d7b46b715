"""Benchmark decontamination: BM25 retrieval of test items for every training passage.

Test items are the indexed documents; every training text is cut into overlapping
passages, and each passage is a query. Scores are BM25 with each item's weights
divided by their sum, so a passage that holds all of an item's terms scores 1 and
one threshold fits all items.

Two bounds spare most of the work. Terms are parted into common and telling ones
such that common terms alone carry no item to the threshold. For a whole batch at
once, the postings of the telling terms are added up per half passage and item; a
passage is dropped if for no item its halves' sums and the item's common terms
reach the threshold. The others go through block-max WAND over postings in blocks,
which returns every item above the threshold. Hits are then verified: the passage
must hold the item's five-word shingles, and of its question and of its answer
each.

Weights come from all items of a block. Items are then parted by length, in powers of
two, each part with an index of its own and passages as long as its items ask for; so
a long item does not lengthen the passages of short ones.
"""

from __future__ import annotations

import heapq
import pickle
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import publish, published, slices

K1, B = 1.2, 0.75
#: ASCII characters other than letters and digits separate terms.
_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Postings whose bounds are added up at a time, and bytes of items of one index.
_POSTINGS, _BLOCK_BYTES = 4_000_000, 64 << 20
_UNSPACED = regex.compile(r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}]")
_IN_TERM = regex.compile(r"[\p{L}\p{M}\p{N}]")


class _Parts(dict):
    """What a character becomes before a text is split: itself, a space, or a term of its own in scripts that set no spaces."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = f" {c} " if _UNSPACED.match(c) else c if _IN_TERM.match(c) else " "
        return self[code]


_PARTS = _Parts()


def terms(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, marks and digits of any script; a character of a script without spaces is a term."""
    if not text:
        return []
    if text.isascii():
        return text.lower().encode().translate(_TERMS).split()
    return text.lower().translate(_PARTS).encode().split()


def shingles(words: list[bytes], q: int) -> set[tuple[bytes, ...]]:
    q = min(q, len(words))
    return {tuple(words[i : i + q]) for i in range(len(words) - q + 1)} if q else set()


@dataclass(frozen=True)
class Settings:
    """``threshold`` bounds the retrieval; the overlaps are shares of an item's, a question's and an answer's shingles."""

    threshold: float = 0.5
    shingle: int = 5
    overlap: float = 0.8
    part_overlap: float = 0.5
    answer_share: float = 1 / 3
    posting_block: int = 32


@dataclass
class Item:
    item_id: object
    question: list[bytes]
    answer: list[bytes]
    whole: set = field(default_factory=set)
    parts: tuple = ()


def make_item(item_id, text: str | None, settings: Settings) -> Item | None:
    """A text's last third is its answer and the rest its question; a text without terms makes no item."""
    words = terms(text)
    if not words:
        return None
    cut = len(words) - max(1, round(len(words) * settings.answer_share)) if len(words) > 1 else 0
    item = Item(item_id, words[:cut], words[cut:])
    item.whole = shingles(words, settings.shingle)
    # A part's shingles may reach over the cut, so that a part of a few words still has shingles of full length.
    reach = settings.shingle - 1
    item.parts = (shingles(words[: cut + reach] if cut else [], settings.shingle), shingles(words[max(0, cut - reach) :], settings.shingle))
    return item


def bm25_weights(items: list[Item]) -> list[dict[bytes, float]]:
    """For each item the share of its BM25 weight that each of its terms has."""
    counts = [Counter(i.question + i.answer) for i in items]
    lengths = [sum(c.values()) for c in counts]
    mean = sum(lengths) / max(1, len(lengths))
    df = Counter(t for c in counts for t in c)
    idf = {t: float(np.log(1 + (len(items) - n + 0.5) / (n + 0.5))) for t, n in df.items()}
    weights = [{t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean)) for t, n in c.items()} for c, size in zip(counts, lengths, strict=True)]
    return [{t: x / total for t, x in w.items()} for w in weights for total in (sum(w.values()),)]


class BlockMaxIndex:
    """An inverted index whose postings keep, per term and per block of postings, the greatest weight."""

    def __init__(self, items: list[Item], settings: Settings, weights: list[dict[bytes, float]] | None = None):
        self.items, self.settings = items, settings
        self.weights = bm25_weights(items) if weights is None else weights
        self.number = {t: i for i, t in enumerate(sorted({t for w in self.weights for t in w}))}
        self.ids: list[list[int]] = [[] for _ in self.number]
        self.gains: list[list[float]] = [[] for _ in self.number]
        for n, w in enumerate(self.weights):
            for t, x in w.items():
                self.ids[self.number[t]].append(n)
                self.gains[self.number[t]].append(x)
        size = settings.posting_block
        self.block_max = [[max(g[i : i + size]) for i in range(0, len(g), size)] for g in self.gains]
        self.most = np.array([max(g) for g in self.gains])
        self._part_terms()

    def _part_terms(self) -> None:
        """Take terms as common, most frequent first, while no item's common terms come near the threshold."""
        limit = 0.7 * self.settings.threshold
        mass = np.zeros(len(self.items))
        self.telling = np.ones(len(self.number), bool)
        for t in sorted(range(len(self.ids)), key=lambda t: (-len(self.ids[t]), t)):
            ids, gains = self.ids[t], np.array(self.gains[t])
            if (mass[ids] + gains > limit).any():
                continue
            mass[ids] += gains
            self.telling[t] = False
        self.common_mass = mass
        telling = np.flatnonzero(self.telling).tolist()
        self.telling_number = np.full(len(self.number) + 1, -1, np.int64)
        self.telling_number[telling] = np.arange(len(telling))
        self.starts = np.concatenate(([0], np.cumsum([len(self.ids[t]) for t in telling]))).astype(np.int64)
        self.flat_ids = np.array([i for t in telling for i in self.ids[t]], np.int64)
        self.flat_gains = np.array([g for t in telling for g in self.gains[t]])

    def retrieve(self, query: list[int]) -> list[tuple[int, float]]:
        """Every item whose score for the distinct terms of ``query`` reaches the threshold: block-max WAND."""
        limit, size, end = self.settings.threshold - 1e-9, self.settings.posting_block, len(self.items)
        # By the next item of each term; only the terms up to the pivot are taken off and put back.
        cursors = [(self.ids[t][0], t, 0) for t in query]
        heapq.heapify(cursors)
        found = []
        while cursors:
            bound, ahead = 0.0, []
            while cursors and bound < limit:
                ahead.append(heapq.heappop(cursors))
                bound += self.most[ahead[-1][1]]
            if bound < limit:
                break
            item = ahead[-1][0]
            while cursors and cursors[0][0] == item:
                ahead.append(heapq.heappop(cursors))
            upper, until = 0.0, cursors[0][0] if cursors else end
            for _, t, at in ahead:
                at = bisect_left(self.ids[t], item, at)
                if at < len(self.ids[t]):
                    block = at // size
                    upper += self.block_max[t][block]
                    last = self.ids[t][min((block + 1) * size, len(self.ids[t])) - 1]
                    until = min(until, last + 1)
            if upper >= limit:
                score = 0.0
                for _, t, at in ahead:
                    at = bisect_left(self.ids[t], item, at)
                    if at < len(self.ids[t]) and self.ids[t][at] == item:
                        score += self.gains[t][at]
                if score >= limit:
                    found.append((item, score))
                until = item + 1
            until = max(until, item + 1)
            for _, t, at in ahead:
                at = bisect_left(self.ids[t], until, at)
                if at < len(self.ids[t]):
                    heapq.heappush(cursors, (self.ids[t][at], t, at))
        return found

    def verify(self, n: int, passage: list[bytes], held: dict[int, set] | None = None) -> tuple[float, float, float]:
        """Shares of the item's, its question's and its answer's shingles that stand in the passage; an empty question counts as held.

        ``held`` keeps the passage's shingles by their length, for its next item.
        """
        item, held = self.items[n], {} if held is None else held
        q = min(self.settings.shingle, len(item.question) + len(item.answer))
        if q not in held:
            held[q] = shingles(passage, q)
        have = held[q]
        share = [len(s & have) / len(s) if s else 1.0 for s in (item.whole, *item.parts)]
        return share[0], share[1], share[2]

    def hits(self, texts: list[list[bytes]]) -> list[list[tuple[int, float, float, float, int]]]:
        """For each text, as terms, its verified items: (item, best score, question overlap, answer overlap, first word of the passage)."""
        out: list[list] = [[] for _ in texts]
        half = max(32, max((len(i.question) + len(i.answer) for i in self.items), default=0))
        held: list[tuple[int, list[bytes], np.ndarray]] = []
        waiting = 0
        for n, words in enumerate(texts):
            if words:
                get = self.number.get
                held.append((n, words, np.fromiter((get(w, -1) for w in words), np.int64, len(words))))
                waiting += len(words)
            if waiting > 200_000 or n == len(texts) - 1:
                self._scan(held, half, out)
                held, waiting = [], 0
        return out

    def _passages(self, half: np.ndarray, term: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Marks each half passage with which a passage begins that some item's bound lets through.

        Halves are taken in order, with about ``_POSTINGS`` postings at a time; the half
        after them is looked at with them, and begins the next turn.
        """
        out = np.zeros(len(last), bool)
        ends = np.cumsum(self.starts[term + 1] - self.starts[term])
        a = 0
        while a < len(half):
            before = int(ends[a - 1]) if a else 0
            b = max(int(np.searchsorted(ends, before + _POSTINGS, "right")), int(np.searchsorted(half, half[a], "right")))
            b = len(half) if b >= len(half) else int(np.searchsorted(half, half[b - 1], "right"))
            with_next = len(half) if b >= len(half) else int(np.searchsorted(half, half[b], "right"))
            out |= self._bounded(half[a:with_next], term[a:with_next], last)
            a = b
        return out

    def _bounded(self, half: np.ndarray, term: np.ndarray, last: np.ndarray) -> np.ndarray:
        counts = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(counts)
        posting = np.repeat(self.starts[term] - (ends - counts), counts) + np.arange(int(counts.sum()))
        code = np.repeat(half, counts) * len(self.items) + self.flat_ids[posting]
        pairs, slot = np.unique(code, return_inverse=True)
        sums = np.bincount(slot, weights=self.flat_gains[posting], minlength=len(pairs))
        where = pairs // len(self.items)
        after = np.searchsorted(pairs, pairs + len(self.items))
        after = np.minimum(after, max(0, len(pairs) - 1))
        joined = (pairs[after] == pairs + len(self.items)) & ~last[where] if len(pairs) else np.zeros(0, bool)
        need = self.settings.threshold - self.common_mass[pairs % len(self.items)] - 1e-9
        out = np.zeros(len(last), bool)
        out[where[sums + np.where(joined, sums[after] if len(pairs) else 0.0, 0.0) >= need]] = True
        # An item may have its telling terms in the second half only; that half is then looked at with the one before it.
        alone = where[sums >= need]
        before = alone[alone > 0] - 1
        out[before[~last[before]]] = True
        return out

    def _scan(self, held, half: int, out: list[list]) -> None:
        """Passages are two neighbouring half passages; the bound of a passage is the sum of its halves' bounds."""
        if not held:
            return
        halves = [-(-len(w) // half) for _, w, _ in held]
        first = np.concatenate(([0], np.cumsum(halves)))
        last = np.zeros(int(first[-1]), bool)
        last[first[1:] - 1] = True
        width = len(self.starts) - 1
        codes = []
        for (_, _, ids), start in zip(held, first.tolist(), strict=False):
            t = self.telling_number[ids]
            at = np.flatnonzero(t >= 0)
            codes.append((start + at // half) * width + t[at])
        distinct = np.unique(np.concatenate(codes))
        passed = self._passages(distinct // max(1, width), distinct % max(1, width), last)
        for (n, words, ids), start, count in zip(held, first.tolist(), halves, strict=False):
            best: dict[int, tuple] = {}
            for p in np.flatnonzero(passed[start : start + count]).tolist():
                span = ids[p * half : (p + 2) * half]
                shingled: dict[int, set] = {}
                for item, score in self.retrieve(np.unique(span[span >= 0]).tolist()):
                    # Sums of the same weights in another order are equal.
                    score = round(score, 9)
                    whole, question, answer = self.verify(item, words[p * half : (p + 2) * half], shingled)
                    good = whole >= self.settings.overlap and min(question, answer) >= self.settings.part_overlap
                    if good and (item not in best or score > best[item][1]):
                        best[item] = (item, score, question, answer, p * half)
            out[n] = [best[i] for i in sorted(best)]


#: Items of up to so many terms share an index; beyond, an index for each doubling.
_SHORT = 64


class ItemIndex:
    """All items of a block: weights in common, an index for each class of lengths."""

    def __init__(self, items: list[Item], settings: Settings):
        weights = bm25_weights(items)
        classes: dict[int, list[int]] = {}
        for i, item in enumerate(items):
            size = len(item.question) + len(item.answer)
            classes.setdefault(max(0, (-(-size // _SHORT) - 1).bit_length()), []).append(i)
        self.parts = [BlockMaxIndex([items[i] for i in own], settings, [weights[i] for i in own]) for _, own in sorted(classes.items())]

    def hits(self, texts: list[str | None]) -> list[list[tuple[object, float, float, float, int]]]:
        """For each text its verified items, by their ids, as :meth:`BlockMaxIndex.hits` gives them; a text is cut into terms once."""
        cut = [terms(t) for t in texts]
        out: list[list] = [[] for _ in texts]
        for part in self.parts:
            for found, hits in zip(out, part.hits(cut), strict=True):
                found += [(part.items[h[0]].item_id, *h[1:]) for h in hits]
        return out


def item_blocks(items: DataFrame, *, id_col: str, text_col: str, block_items: int):
    """The items in blocks of about ``block_items`` and at most about ``_BLOCK_BYTES`` of text, dealt by a hash; each block is an index of its own and a pass over the texts.

    A block is written to the shared folder and forgotten, so the driver holds one
    at a time; what is given on is the name under which tasks find it.
    """
    slim = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    sizes = slim.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("bytes")).first()
    blocks = max(-(-sizes.n // block_items), -(-(sizes.bytes or 0) // _BLOCK_BYTES)) if sizes.n else 0
    for b in range(blocks):
        rows = slim.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        yield publish(items.sparkSession, pickle.dumps([(r.i, r.t) for r in rows]), "items")


_OPEN: dict[tuple, ItemIndex | None] = {}


def open_index(name: str, settings: Settings) -> ItemIndex | None:
    """The index of a block in this worker process, made once; None if no item has terms."""
    if (name, settings) not in _OPEN:
        _OPEN.clear()
        with open(published(name), "rb") as f:
            made = [x for i, t in pickle.load(f) if (x := make_item(i, t, settings))]  # noqa: S301  written by item_blocks
        _OPEN[name, settings] = ItemIndex(made, settings) if made else None
    return _OPEN[name, settings]


def contaminated(docs: DataFrame, items: DataFrame, *, settings: Settings = Settings(), block_items: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:  # noqa: B008  frozen
    """One row per document and test item it holds: ``id_col, item_id, score, question_overlap, answer_overlap, first_word``.

    Whole texts are searched, however long. Null and empty texts and items give
    nothing; an empty benchmark or corpus gives no rows. Rows, also of one id or of a
    null id, are reported each; equal items count as one. Of several passages with one
    item the best counts, and the first among equals. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind, item_kind = dict(slim.dtypes)["k"], dict(items.dtypes)[item_id_col]
    schema = f"k {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double, first_word long"
    arrow_kind = to_arrow_type(items.schema[item_id_col].dataType)
    found = None
    for block in item_blocks(items, id_col=item_id_col, text_col=item_text_col, block_items=block_items):

        def run(batches, block=block):
            index = open_index(block, settings)
            for batch in batches if index else ():
                for part in slices(batch):
                    rows = [(i, *h) for i, hits in enumerate(index.hits(part.column(1).to_pylist())) for h in hits]
                    keys = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                    yield pa.RecordBatch.from_arrays([keys, pa.array(cols[1], arrow_kind), *(pa.array(cols[i], pa.float64()) for i in (2, 3, 4)), pa.array(cols[5], pa.int64())], names=["k", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        hits = slim.mapInArrow(run, schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("k", id_col)


def keep(docs: DataFrame, items: DataFrame, *, settings: Settings = Settings(), block_items: int = 20_000, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:  # noqa: B008  frozen
    """The rows of ``docs``, with all their columns, that hold no test item; judged row by row, without a join.

    Whole texts are searched. Null and empty texts hold nothing and stay; rows of one
    id are judged each by its text; an empty benchmark keeps all. An empty table
    gives no rows.
    """
    at = docs.columns.index(text_col)
    for block in item_blocks(items, id_col=item_id_col, text_col=item_text_col, block_items=block_items):

        def run(batches, block=block):
            index = open_index(block, settings)
            for batch in batches:
                for part in slices(batch):
                    yield part.filter(pa.array([not h for h in index.hits(part.column(at).to_pylist())], pa.bool_())) if index else part

        docs = docs.mapInArrow(run, docs.schema)
    return docs
