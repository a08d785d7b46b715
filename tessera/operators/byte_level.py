"""Where the tokens of byte-level BPE begin, found by the distinct pieces of many texts.

Byte-level pre-tokenisation cuts a text into pieces, and the tokens of a piece do not
depend on what stands around it. Texts lie end to end as an array of code points, whose
classes tell where pieces begin; Arrow finds the distinct ones, and the ``tokenizers``
library is asked only for pieces that this worker does not know yet. A text that its
tokens do not give back is an error here too: pieces are checked when they are new.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points that are cut together; longer texts are cut into parts where a piece begins whatever follows.
_PART = 1 << 21
#: Pieces of at most so many bytes are remembered, about so many of them; then those are forgotten that were not met again.
_LONGEST, _MOST = 64, 1 << 18
#: Pieces that the library is given at a time.
_ASKED = 1 << 13
_OTHER, _LETTER, _NUMBER, _WHITE, _BLANK, _UNKNOWN = range(6)
#: White space behind something else; what this calls white space includes all that the library does.
_SAFE = re.compile(r"(?<=\S)[ \n]")


def fits(tokenizer) -> bool:
    """Whether pieces and their tokens are those of plain byte-level BPE, so that a piece has the same tokens in every text."""
    spec = json.loads(tokenizer.to_str())
    cut, model = spec["pre_tokenizer"] or {}, spec["model"]
    return (
        (model["type"], cut.get("type"), (spec["decoder"] or {}).get("type")) == ("BPE", "ByteLevel", "ByteLevel")
        and (spec["normalizer"], spec["post_processor"]) == (None, None)
        and not (cut["add_prefix_space"] or model["dropout"])
        and cut.get("use_regex", True)
        and tokenizer.encode_special_tokens
        and all(t["special"] for t in spec["added_tokens"])
    )


def parts(text: str):
    """``low, part`` of a text: the whole, or parts of about ``_PART`` characters, cut in front of white space behind something else."""
    low = 0
    while len(text) - low > _PART and (m := _SAFE.search(text, low + _PART)):
        yield low, text[low : m.start()]
        low = m.start()
    yield low, text[low:]


class Pieces:
    """A tokenizer of the library, which answers as ``plain`` does and finds the tokens of many texts at once by :meth:`begins`."""

    def __init__(self, tokenizer, plain):
        self.tokenizer, self.plain = tokenizer, plain
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        self.kinds[ord(" ")] = _BLANK
        #: The pieces remembered, whether they were met again, their numbers of tokens, and where those begin in each.
        self.held, self.met = pa.array([], pa.large_string()), np.empty(0, bool)
        self.size, self.pool = np.empty(0, np.int64), np.empty(0, np.int32)

    def __call__(self, texts: list[str]) -> list[tuple[list[int], str]]:
        return self.plain(texts)

    def begins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first characters of the tokens of all texts, one text's behind the other's, and where each text's begin and end."""
        firsts, count = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
        row, low, held, size = [], [], [], 0

        def flush():
            first, n = self._group(held)
            firsts.append((first + np.repeat(low, n)).astype(np.int32))
            np.add.at(count, row, n)
            row.clear(), low.clear(), held.clear()

        for i, text in enumerate(texts):
            for a, part in parts(text):
                row.append(i), low.append(a), held.append(part)
                size += len(part)
                if size >= _PART:
                    flush()
                    size = 0
        if held:
            flush()
        return np.concatenate(firsts), np.concatenate(([0], np.cumsum(count)))

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that are taken together, and the number of tokens of each."""
        at = np.cumsum([0, *map(len, texts)])
        whole = "".join(texts)
        if not whole:
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = self._piece_starts(codes, at)
        place = np.append(starts, len(codes))
        if not whole.isascii():
            width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
            place = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))[place]
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(place.astype(np.int64)), pa.py_buffer(whole.encode())).dictionary_encode()
        begin, size, pool = self._known(pieces.dictionary)
        which = pieces.indices.to_numpy()
        each = size[which]
        ends = np.concatenate(([0], np.cumsum(each)))
        count = np.diff(ends[np.searchsorted(starts, at)])
        first = pool[np.repeat(begin[which] - ends[:-1], each) + np.arange(ends[-1])] + np.repeat(starts, each)
        return first - np.repeat(at[:-1], count), count

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        kind = self.kinds[codes]
        if (new := np.unique(codes[kind == _UNKNOWN])).size:
            from tokenizers import Regex
            from tokenizers.pre_tokenizers import Split

            text = "".join(map(chr, new.tolist()))
            self.kinds[new] = _OTHER
            for of, pattern in ((_LETTER, r"\P{L}"), (_NUMBER, r"\P{N}"), (_WHITE, r"\S")):
                for _, (a, b) in Split(Regex(pattern), "removed").pre_tokenize_str(text):
                    self.kinds[new[a:b]] = of
            kind = self.kinds[codes]
        return kind

    def _piece_starts(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pieces of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` begin."""
        n, kind = len(codes), self._classes(codes)
        begins = np.zeros(n + 1, bool)
        begins[at] = True
        cut, white = begins[:n].copy(), kind >= _WHITE
        # A piece begins where the class changes, but not within white space, and not behind a blank, which goes with what follows it.
        cut[1:] |= (kind[1:] != kind[:-1]) & ~(white[1:] & white[:-1]) & (kind[:-1] != _BLANK)
        # The last of white space in front of something is parted from the rest.
        cut[:-1] |= white[:-1] & ~white[1:] & ~begins[1:n]
        # An apostrophe that begins a piece takes the letters of a contraction with it.
        quote = np.flatnonzero((codes[:-1] == ord("'")) & cut[:-1] & (kind[1:] == _LETTER) & ~begins[1:n])
        one, two = codes[quote + 1], np.where(begins[quote + 2], 0, codes[np.minimum(quote + 2, n - 1)])
        short = np.isin(one, [*map(ord, "stmd")])
        long = np.isin(one, [*map(ord, "rv")]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(short, 2, 3)[short | long]
        quote = quote[short | long]
        cut[quote + 1] = False
        cut[(quote + size)[quote + size < n]] = True
        return np.flatnonzero(cut)

    def _known(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in the pool the first characters of each piece's tokens are, how many, and the pool."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.held), -1).to_numpy().astype(np.int64)
        asked = np.flatnonzero(at < 0)
        new = pieces.take(pa.array(asked))
        told = [self._ask(new.slice(i, _ASKED).to_pylist()) for i in range(0, len(new), _ASKED)]
        self.met[at[at >= 0]] = True
        at[asked] = len(self.size) + np.arange(len(asked))
        self.held, self.met = pa.concat_arrays([self.held, new]), np.concatenate([self.met, np.zeros(len(new), bool)])
        self.size, self.pool = np.concatenate([self.size, *(n for n, _ in told)]), np.concatenate([self.pool, *(first for _, first in told)])
        out = (np.cumsum(self.size) - self.size)[at], self.size[at], self.pool
        keep = pc.binary_length(self.held).to_numpy() <= _LONGEST
        if keep.sum() > _MOST:
            keep &= self.met
            # Where most were met again, all are forgotten, so that room is not made anew for every group.
            keep &= keep.sum() <= _MOST // 2
            self.met[:] = False
        if not keep.all():
            self.pool = self.pool[np.repeat(keep, self.size)]
            self.held, self.met, self.size = self.held.filter(pa.array(keep)), self.met[keep], self.size[keep]
        return out

    def _ask(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of each piece, and the first characters of all, as counted in the piece."""
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        if self.tokenizer.decode(found.ids, skip_special_tokens=False) != "".join(pieces):
            raise ValueError("the tokens of a text decode to another text")
        return np.bincount(found.word_ids, minlength=len(pieces)), np.array([a for a, _ in found.offsets], np.int32)
