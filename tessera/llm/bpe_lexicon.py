"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words of the corpus are counted, the most frequent are compiled into an
acyclic automaton that shares prefixes and suffixes. Its arcs carry numbers whose
sum along a word is the word's rank among the lexicon's words, and the rank leads
to the word's token ids. The automaton, the ids, the merges and the tokens' bytes
are one file of flat arrays in the shared folder; Spark hands it to every
executor, whose Python workers map it into memory. Words that the lexicon lacks are
merged exactly, so the lexicon's size changes the speed and never the ids.

Texts stay Arrow buffers: a class for every byte tells where the pieces of
byte-level pre-tokenisation begin, Arrow finds the distinct pieces of a few
megabytes of text, and those go through the automaton together, one byte of all
pieces at a time. No text or word becomes a Python object.
"""

from __future__ import annotations

import functools
import heapq
import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GROUP_BYTES, buffers, most_frequent, publish, published, row_groups, values

#: Fixed value: the pattern of byte-level pre-tokenisation, whose pieces :func:`piece_starts` finds.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes of code points. ``_UNSURE`` are those that Unicode versions may class differently; texts with them are split by the library.
_LETTER, _NUMBER, _OTHER, _BLANK, _WHITE, _UNSURE = range(6)
#: Distinct words that a task counts before it hands them on.
_COUNTED = 500_000


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    codes = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = "".join(map(chr, codes.tolist()))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+"), (_UNSURE, r"\p{Cn}+")):
        for m in regex.finditer(pattern, every):
            out[codes[m.start() : m.end()]] = kind
    out[ord(" ")] = _BLANK
    return out


def byte_classes(blob: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to."""
    table = classes()
    out = table[:256][blob]
    lead = np.flatnonzero(blob >= 0xC0)
    if len(lead):
        first = blob[lead].astype(np.int64)
        more = 1 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x3F >> more)
        for k in (1, 2, 3):
            some = more >= k
            code[some] = code[some] << 6 | blob[lead[some] + k] & 0x3F
        for k in range(4):
            some = more >= k
            out[lead[some] + k] = table[code[some]]
    return out


def piece_starts(blob: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern begin in texts that lie end to end; text ``i`` is ``blob[at[i]:at[i + 1]]``."""
    n = len(blob)
    if not n:
        return np.empty(0, np.int64)
    kind = byte_classes(blob)
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    white = (kind == _BLANK) | (kind == _WHITE)
    cut = begins[:n].copy()
    # A piece begins where the class changes, but not within white space, and not behind a blank, which goes with what follows it.
    cut[1:] |= (kind[1:] != kind[:-1]) & ~(white[1:] & white[:-1]) & (kind[:-1] != _BLANK)
    # The last character of white space in front of something is parted from the rest.
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~begins[1:n])
    for _ in range(3):
        last = last - (blob[last] & 0xC0 == 0x80)
    cut[last] = True
    # An apostrophe that begins a piece takes the letters of a contraction with it.
    quote = np.flatnonzero((blob[:-1] == ord("'")) & cut[: n - 1] & (kind[1:] == _LETTER) & ~begins[1:n])
    one = blob[quote + 1]
    two = np.where(begins[quote + 2], 0, blob[np.minimum(quote + 2, n - 1)])
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    quote, size = quote[short | long], np.where(short, 2, 3)[short | long]
    cut[quote + 1] = False
    cut[(quote + size)[quote + size < n]] = True
    unsure = np.flatnonzero(kind == _UNSURE)
    for i in np.unique(np.searchsorted(at, unsure, "right") - 1).tolist() if len(unsure) else []:
        cut[at[i] : at[i + 1]] = False
        cut[at[i] + _library_starts(blob[at[i] : at[i + 1]].tobytes().decode())] = True
    return np.flatnonzero(cut)


def _library_starts(text: str) -> np.ndarray:
    from tokenizers.pre_tokenizers import ByteLevel

    sizes = [len(text[a:b].encode()) for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
    return np.cumsum([0, *sizes[:-1]])


def groups(blob: np.ndarray, at: np.ndarray):
    """Texts in groups of about ``GROUP_BYTES``, longer ones cut before white space, where a piece begins whatever follows: where a group's parts begin and end, and the number of texts that end with each part."""
    start = 0
    while start < len(at) - 1:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + GROUP_BYTES, "right")) - 1)
        if stop > start + 1 or at[stop] - at[start] <= GROUP_BYTES:
            yield at[start : stop + 1], np.ones(stop - start, np.int64)
        else:
            low, high = int(at[start]), int(at[stop])
            white = classes()[:128] == _WHITE
            white[ord(" ")] = True
            while low < high:
                # ASCII white space behind something else; what stands between two such places is never cut.
                end, window = high, low + GROUP_BYTES
                while window < high:
                    near = blob[window - 1 : window + GROUP_BYTES]
                    is_white = white[near & 0x7F] & (near < 0x80)
                    found = np.flatnonzero(is_white[1:] & ~is_white[:-1] & (near[:-1] < 0x80))
                    if len(found):
                        end = window + int(found[0])
                        break
                    window += GROUP_BYTES
                yield np.array([low, end]), np.array([int(end == high)])
                low = end
        start = stop


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in printable}
    rest = (b for b in range(256) if b not in set(printable))
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Exact BPE over token ids: the pair of lowest rank is merged first, leftmost among equals."""

    #: Longer words go through a heap, so that their cost does not grow with the square of their length.
    LONG = 48
    _NONE = np.int64(1 << 60)

    def __init__(self, byte_ids: np.ndarray, pairs: np.ndarray, merged: np.ndarray):
        self.byte_ids, self.merged = np.asarray(byte_ids, np.int64), np.asarray(merged, np.int64)
        self.rank_at = np.argsort(pairs, kind="stable")
        self.sorted = np.asarray(pairs, np.int64)[self.rank_at]
        self._rank: dict[int, tuple[int, int]] | None = None
        #: Ranks of the pairs of single bytes, with which every word begins.
        self.first = self.ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
        return np.where(self.sorted[at] == key, self.rank_at[at], self._NONE)

    def encode(self, blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one word's behind the other's, and their numbers. Words of one length are merged side by side, one merge a round."""
        place = np.cumsum(lengths) - lengths
        room = np.zeros(int(lengths.sum()), np.uint32)
        count = np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            size = int(lengths[group[0]])
            if size > self.LONG:
                for i in group.tolist():
                    ids = self.merge_long(blob[starts[i] : starts[i] + size].tobytes())
                    room[place[i] : place[i] + len(ids)] = ids
                    count[i] = len(ids)
            elif size:
                raw = blob[starts[group][:, None] + np.arange(size)]
                rank = self.first[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]
                self._side_by_side(self.byte_ids[raw], rank, group, place, room, count)
        return room[np.repeat(place - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))], count

    def _side_by_side(self, ids: np.ndarray, rank: np.ndarray, rows: np.ndarray, place: np.ndarray, room: np.ndarray, count: np.ndarray) -> None:
        while True:
            n, width = ids.shape
            best = rank.min(axis=1) if width > 1 else np.full(n, self._NONE)
            going = best < self._NONE
            done = rows[~going]
            room[place[done][:, None] + np.arange(width)] = ids[~going]
            count[done] = width
            if not going.any():
                return
            ids, rank, rows, best = ids[going], rank[going], rows[going], best[going]
            at, line = rank.argmin(axis=1), np.arange(len(rows))
            ids[line, at] = self.merged[best]
            cols = np.arange(width - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            cols = np.arange(width - 2)
            rank = np.take_along_axis(rank, cols + (cols > at[:, None]), axis=1)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < width - 2)
            rank[right, at[right]] = self.ranks(ids[right, at[right]], ids[right, at[right] + 1])

    def merge_long(self, word: bytes) -> list[int]:
        if self._rank is None:
            self._rank = {k: (r, m) for k, r, m in zip(self.sorted.tolist(), self.rank_at.tolist(), self.merged[self.rank_at].tolist(), strict=True)}
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        rank, n = self._rank, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank[k][0], i, i + 1, rank[k][1], k) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, j, merged, key = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and ids[i] << 32 | ids[j] == key):
                continue
            ids[i], alive[j], after[i] = merged, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (k := ids[a] << 32 | ids[b]) in rank:
                    r, m = rank[k]
                    heapq.heappush(heap, (r, a, b, m, k))
        return [x for x, live in zip(ids, alive, strict=True) if live]


def load_tokenizer(path: str) -> dict:
    """The parts of a byte-level BPE file: token bytes by id, merges as id pairs, and the added token, if any."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
    added = [(t["content"], t["id"]) for t in spec.get("added_tokens") or []]
    tokens = [b""] * (max([*vocab.values(), *(i for _, i in added)]) + 1)
    for token, i in vocab.items():
        tokens[i] = bytes(alphabet[c] for c in token)
    for token, i in added:
        tokens[i] = token.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return {
        "tokens": tokens,
        "byte_ids": [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])],
        "pairs": np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64),
        "merged": np.array([vocab[a + b] for a, b in pairs], np.int64),
        "added": added,
    }


def compile_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, as arrays.

    ``arcs`` ascends and holds state * 256 + byte; ``to`` and ``out`` are the arcs'
    targets and outputs; ``final`` marks states. Words are added in order, and the
    states of the last word that can't change any more are replaced by equal ones.
    """
    register: dict[tuple, int] = {}
    children: list[list[tuple[int, int]]] = [[]]
    final = [False]
    path = [0]
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            key = (final[state], tuple(children[state]))
            same = register.setdefault(key, state)
            if same != state:
                children[path[-1]][-1] = (children[path[-1]][-1][0], same)

    for word in words:
        common = 0
        for a, b in zip(word, last):  # noqa: B905  the shorter word ends it
            if a != b:
                break
            common += 1
        settle(common)
        for byte in word[common:]:
            children.append([])
            final.append(False)
            children[path[-1]].append((byte, len(children) - 1))
            path.append(len(children) - 1)
        final[path[-1]] = True
        last = word
    settle(0)

    number, order, below = {0: 0}, [0], {}
    for state in order:
        for _, child in children[state]:
            if child not in number:
                number[child] = len(order)
                order.append(child)
    pending = [(0, False)]
    while pending:
        state, done = pending.pop()
        if done:
            below[state] = final[state] + sum(below[c] for _, c in children[state])
        elif state not in below:
            pending.append((state, True))
            pending += [(c, False) for _, c in children[state] if c not in below]
    arcs, to, out = [], [], []
    for state in order:
        passed = int(final[state])
        for byte, child in children[state]:
            arcs.append(number[state] * 256 + byte)
            to.append(number[child])
            out.append(passed)
            passed += below[child]
    return {"arcs": np.array(arcs, np.int64), "to": np.array(to, np.int64), "out": np.array(out, np.int64), "final": np.array([final[s] for s in order], np.uint8)}


def rank_words(auto: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """Each word's rank in the automaton, or -1."""
    return walk(auto, *buffers(pa.array(words, pa.binary())))


def walk(auto: dict[str, np.ndarray], blob: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ranks of words that lie end to end; all words advance together, a byte at a time."""
    lengths = np.diff(at)
    found = np.full(len(lengths), -1, np.int64)
    arcs = auto["arcs"]
    if not len(lengths) or not len(arcs):
        return found
    live, state, total, depth = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while len(live):
        ends = lengths[live] == depth
        if ends.any():
            here = live[ends]
            good = auto["final"][state[ends]] == 1
            found[here[good]] = total[ends][good]
            live, state, total = live[~ends], state[~ends], total[~ends]
            if not len(live):
                break
        key = state * 256 + blob[at[live] + depth]
        arc = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
        on = arcs[arc] == key
        live, arc = live[on], arc[on]
        state, total = auto["to"][arc], total[on] + auto["out"][arc]
        depth += 1
    return found


def pack(arrays: dict[str, np.ndarray], extra: dict) -> bytes:
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [at, len(a), a.dtype.str]
        body.append(raw + b"\0" * (-len(raw) % 8))
        at += len(body[-1])
    meta = json.dumps({"arrays": head, "extra": extra}).encode()
    meta += b" " * (-len(meta) % 8)
    return struct.pack("<q", len(meta)) + meta + b"".join(body)


class Lexicon:
    """A packed lexicon mapped into memory."""

    def __init__(self, path: str):
        # Plain views of the map: a memmap makes an object with a state of its own for every slice.
        raw = np.asarray(np.memmap(path, np.uint8, "r")).view(np.ndarray)
        size = struct.unpack("<q", raw[:8].tobytes())[0]
        meta = json.loads(raw[8 : 8 + size].tobytes())
        a = {}
        for name, (at, n, kind) in meta["arrays"].items():
            at += 8 + size
            a[name] = raw[at : at + n * np.dtype(kind).itemsize].view(kind)
        self.auto, self.id_at, self.ids = {k: a[k] for k in ("arcs", "to", "out", "final")}, a["id_at"], a["ids"]
        self.token_at, self.token_bytes = np.array(a["token_at"]), np.array(a["token_bytes"])
        self.merges = Merges(a["byte_ids"], a["pairs"], a["merged"])
        self.added = {t: i for t, i in meta["extra"]["added"]}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=lambda t: -len(t))) + ")") if self.added else None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text's behind the other's, and where each text's begin and end."""
        blob, at = buffers(texts)
        if self.split is not None:
            held = functools.reduce(pc.or_, (pc.match_substring(pc.fill_null(texts, ""), t) for t in self.added))
            if pc.any(held).as_py():
                return self._encode_with_added(texts)
        ids, sizes, waiting = [], [], 0
        for bounds, texts_ended in groups(blob, at):
            some, count = self._encode_group(blob[bounds[0] : bounds[-1]], bounds - bounds[0])
            ids.append(some)
            for n, ended in ((count, None),) if texts_ended.all() else zip(count[:, None], texts_ended.tolist(), strict=True):
                if ended is None:
                    sizes.append(n)
                else:
                    waiting += int(n[0])
                    if ended:
                        sizes.append(np.array([waiting]))
                        waiting = 0
        return (np.concatenate(ids) if ids else np.empty(0, np.uint32)), np.concatenate(([0], np.cumsum(np.concatenate(sizes) if sizes else []))).astype(np.int64)

    def _encode_group(self, blob: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie end to end, and their number per text."""
        if not len(blob):
            return np.empty(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        starts = piece_starts(blob, at)
        coded = values(blob, np.append(starts, len(blob)), pa.binary()).dictionary_encode()
        words, word_at = buffers(coded.dictionary)
        rank = walk(self.auto, words, word_at)
        unseen, seen = np.flatnonzero(rank < 0), np.flatnonzero(rank >= 0)
        merged, count = self.merges.encode(words, word_at[unseen], word_at[unseen + 1] - word_at[unseen])
        pool = np.concatenate([merged, self.ids])
        begin, size = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        begin[unseen], size[unseen] = np.cumsum(count) - count, count
        first = self.id_at[rank[seen]]
        begin[seen], size[seen] = first + len(merged), self.id_at[rank[seen] + 1] - first
        index = coded.indices.to_numpy()
        each = size[index]
        ends = np.concatenate(([0], np.cumsum(each)))
        ids = pool[np.repeat(begin[index] - ends[:-1], each) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.searchsorted(starts, at)])

    def _encode_with_added(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same where added tokens stand in the texts: what lies between them is encoded as if it were texts of its own."""
        parts = [self.split.split(t) if t else [""] for t in texts.to_pylist()]
        flat = [p for text in parts for p in text]
        plain = [n % 2 == 0 for text in parts for n in range(len(text))]
        # Plain parts hold no added token, so they take the common way.
        ids, at = self.encode(pa.array([p if ok else "" for p, ok in zip(flat, plain, strict=True)], pa.string()))
        pieces = [ids[at[i] : at[i + 1]] if ok else np.array([self.added[p]], np.uint32) for i, (p, ok) in enumerate(zip(flat, plain, strict=True))]
        ends = np.cumsum([0, *map(len, pieces)])[np.cumsum([0, *map(len, parts)])]
        return np.concatenate(pieces).astype(np.uint32), ends

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of ids that lie end to end: the tokens' bytes are gathered for all texts at once."""
        begin = self.token_at[ids]
        lengths = self.token_at[ids.astype(np.int64) + 1] - begin
        ends = np.concatenate(([0], np.cumsum(lengths)))
        out = values(self.token_bytes[np.repeat(begin - ends[:-1], lengths) + np.arange(ends[-1])], ends[at], pa.binary())
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([v.decode("utf-8", "replace") for v in out.to_pylist()], pa.string())


def count_words(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``word, n`` over all texts. Workers count as they read, so a frequent word crosses the shuffle once per flush."""

    def run(batches):
        held: list[pa.Table] = []
        rows = 0

        def counted():
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            blob, at = buffers(batch.column(0))
            for bounds, _ in groups(blob, at):
                part = blob[bounds[0] : bounds[-1]]
                if not len(part):
                    continue
                counts = values(part, np.append(piece_starts(part, bounds - bounds[0]), len(part)), pa.binary()).value_counts()
                held.append(pa.table({"word": counts.field(0).cast(pa.string()), "n": counts.field(1)}))
                rows += len(counts)
                if rows > 2 * _COUNTED:
                    held = [counted()]
                    rows = held[0].num_rows
                    if rows > _COUNTED:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from counted().to_batches()

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(counts: DataFrame, tokenizer_path: str, *, words: int = 150_000) -> str:
    """Compile at most ``words`` of the most frequent words and return the name under which executors find the file.

    The driver holds that many words, whatever the corpus; further words are merged
    where they occur.
    """
    spark = counts.sparkSession
    spec = load_tokenizer(tokenizer_path)
    lexicon = sorted(r.word.encode() for r in most_frequent(counts.where("word <> ''"), words).collect())
    blob, at = buffers(pa.array(lexicon, pa.binary()))
    ids, count = Merges(spec["byte_ids"], spec["pairs"], spec["merged"]).encode(blob, at[:-1], np.diff(at))
    arrays = compile_automaton(lexicon) | {
        "id_at": np.concatenate(([0], np.cumsum(count))),
        "ids": ids,
        "token_at": np.cumsum([0, *map(len, spec["tokens"])]),
        "token_bytes": np.frombuffer(b"".join(spec["tokens"]), np.uint8),
        "byte_ids": np.array(spec["byte_ids"], np.int64),
        "pairs": spec["pairs"],
        "merged": spec["merged"],
    }
    return publish(spark, pack(arrays, {"added": spec["added"]}), "lexicon")


_OPEN: dict[str, Lexicon] = {}


def open_lexicon(name: str) -> Lexicon:
    """The lexicon of this worker process, mapped once."""
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = Lexicon(published(name))
    return _OPEN[name]


def encode_decode(docs: DataFrame, lexicon: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``ids`` (packed little-endian unsigned 32-bit) and ``decoded``, the text those ids decode to.

    Whole texts are encoded, long ones in parts of a few megabytes that are cut where
    a piece begins. Null and empty texts have no ids and decode to the empty text.
    Repeated rows, also of one id or of a null id, are encoded each. An empty table
    gives no rows. Other columns are not read.
    """

    def run(batches):
        lex = open_lexicon(lexicon)
        for batch in batches:
            # Ids and decoded texts are held for one group of texts, or one long text, at a time.
            for start, stop in row_groups(batch.column(1)):
                part = batch.slice(start, stop - start)
                ids, at = lex.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), values(ids.view(np.uint8), 4 * at, pa.binary()), lex.decode(ids, at)], names=["k", "ids", "decoded"])

    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = dict(slim.dtypes)["k"]
    return slim.mapInArrow(run, f"k {kind}, ids binary, decoded string").withColumnRenamed("k", id_col)


def digests(encoded: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ids and decoded texts, for comparing tokenisations without moving them."""
    return encoded.select(
        id_col,
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
