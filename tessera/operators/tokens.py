"""Tokens of a chosen tokenizer, with the characters at which they begin.

A tokenizer is handed in as a maker: something to call without arguments that travels
to the executors and is called there, once a worker if makers of one kind are equal. What it makes takes a batch
of texts and gives, for each, the first character of every token and the text that the
tokens decode to. A text whose tokens decode to another one is an error. Tokens of
bytes may begin inside a character; they then share its place, so a cut at a token
never parts one. A tokenizer may have a method ``begins`` besides, which gives the first
characters for many texts in arrays (:mod:`.byte_level`).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_level, intervals

Tokenizer = Callable[[list[str]], list[tuple[list[int], str]]]
Maker = Callable[[], Tokenizer]

_WORD = re.compile(r"[ \t\n\r]*[^ \t\n\r]+(?:[ \t\n\r]+\Z)?|[ \t\n\r]+\Z")


@dataclass(frozen=True)
class Words:
    """Runs of other than white space, each with the white space before it, the last also with what follows."""

    def __call__(self) -> Tokenizer:
        return lambda texts: [([m.start() for m in _WORD.finditer(t)], "".join(_WORD.findall(t))) for t in texts]


@dataclass(frozen=True)
class FromFile:
    """A tokenizer file of the ``tokenizers`` library, without special tokens."""

    path: str

    def __call__(self) -> Tokenizer:
        from tokenizers import Tokenizer as Library

        tokenizer = Library.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True

        def run(texts: list[str]) -> list[tuple[list[int], str]]:
            found = tokenizer.encode_batch(texts, add_special_tokens=False)
            return [([a for a, _ in x.offsets], tokenizer.decode(x.ids, skip_special_tokens=False)) for x in found]

        return byte_level.Pieces(tokenizer, run) if byte_level.fits(tokenizer) else run


@dataclass(frozen=True)
class FromRanks:
    """A file of byte sequences and ranks, as ``tiktoken`` reads it, and the pattern that cuts texts into pieces."""

    path: str
    pattern: str

    def __call__(self) -> Tokenizer:
        import tiktoken

        with open(self.path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

        def run(texts: list[str]) -> list[tuple[list[int], str]]:
            return [encoding.decode_with_offsets(ids)[::-1] for ids in encoding.encode_ordinary_batch(texts)]

        return run


@lru_cache(maxsize=8)
def made(maker: Maker) -> Tokenizer:
    """What ``maker`` makes; equal makers are called once in a process."""
    return maker()


def starts(tokenizer: Tokenizer, texts: list[str]) -> list[list[int]]:
    """The first characters of the tokens of each text; a text that does not come back from its tokens is an error."""
    out = []
    for text, (first, decoded) in zip(texts, tokenizer(texts), strict=True):
        if decoded != text:
            raise ValueError("the tokens of a text decode to another text")
        out.append(first)
    return out


def counts(tokenizer: Tokenizer, texts: list[str]) -> list[int]:
    return [len(x) for x in starts(tokenizer, texts)]


def begins(tokenizer: Tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What ``starts`` gives, one text's behind the other's, and where each text's begin and end."""
    if hasattr(tokenizer, "begins"):
        return tokenizer.begins(texts)
    found = starts(tokenizer, texts)
    at = np.cumsum([0, *map(len, found)])
    return np.fromiter((x for first in found for x in first), np.int32, int(at[-1])), at


#: Bytes of text that are cut at a time.
_BYTES = 2 << 20


def _slices(batch: pa.RecordBatch, text_col: int | str):
    """Rows of about ``_BYTES`` of text, a longer text alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _per_text(rows: DataFrame, maker: Maker, text_col: str, name: str, kind: str, kept: list[str]) -> DataFrame:
    place, kinds = rows.columns.index(text_col), dict(rows.dtypes)

    def run(batches):
        tokenizer = made(maker)
        for batch in batches:
            for part in _slices(batch, place):
                texts = part.column(place).to_pylist()
                missing = np.array([t is None for t in texts])
                first, at = begins(tokenizer, [t for t in texts if t is not None])
                n = np.zeros(len(texts), np.int32)
                n[~missing] = np.diff(at)
                if kind == "int":
                    column = pa.array(n, mask=missing)
                else:
                    column = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(first), mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, column], names=[*kept, name])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in [*((c, kinds[c]) for c in kept), (name, kind)]))


def with_starts(rows: DataFrame, maker: Maker, *, text_col: str = "text", name: str = "starts") -> DataFrame:
    """The rows with the first characters of the tokens of each text; null for a null text."""
    return _per_text(rows, maker, text_col, name, "array<int>", rows.columns)


def with_counts(rows: DataFrame, maker: Maker, *, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """The rows with the number of tokens of each text; null for a null text."""
    return _per_text(rows, maker, text_col, name, "int", rows.columns)


def windows(rows: DataFrame, maker: Maker, size: int, step: int, *by: str, text_col: str = "text") -> DataFrame:
    """``*by, window_no, token_start, token_end, start, stop``: windows of ``size`` tokens, ``step`` apart, and the characters they cover.

    A window is made while the one before it did not reach the end. Windows without
    a character of their own are left out, and numbers run on without them.
    """
    if size <= 0 or not 0 < step <= size:
        raise ValueError("a window has tokens and is not stepped over")
    slim = rows.select(*by, F.col(text_col).alias("__text"), F.char_length(text_col).alias("__chars"))
    cut = _per_text(slim, maker, "__text", "__starts", "array<int>", [*by, "__chars"])
    n, first, whole = F.size("__starts"), F.col("__starts"), F.col("__chars")

    def span(token_start):
        token_end = F.least(token_start + size, n)
        stop = F.when(token_end < n, F.element_at(first, F.least(token_end + 1, n))).otherwise(whole)
        return F.struct(token_start.alias("token_start"), token_end.alias("token_end"), F.element_at(first, token_start + 1).alias("start"), stop.alias("stop"))

    spans = F.transform(intervals.token_windows(F.greatest(n, F.lit(0)), size, step), lambda i: span(i.cast("int")))
    kept = F.filter(spans, lambda s: s["start"] < s["stop"])
    return cut.select(*by, F.posexplode(kept).alias("window_no", "w")).select(*by, "window_no", "w.*")


def trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    """The span without white space at its ends."""
    part = text[start:stop]
    left = len(part) - len(part.lstrip())
    return (start, start) if left == len(part) else (start + left, stop - (len(part) - len(part.rstrip())))


def pieces(tokenizer: Tokenizer, text: str, most: int) -> list[tuple[int, int, int]]:
    """``start, stop, n_tokens`` of pieces of at most ``most`` tokens each, as even as can be, without white space at their ends.

    What is left is shared out anew before each piece. A piece may have more tokens
    on its own than it had within the text; it then gives up tokens at its end, down
    to one. Pieces of white space alone are left out.
    """
    first = starts(tokenizer, [text])[0]
    ends = [*first[1:], len(text)]
    out, at = [], 0
    while at < len(first):
        left = len(first) - at
        to = at + -(-left // -(-left // most))
        while True:
            start, stop = trimmed(text, first[at], ends[to - 1])
            n = counts(tokenizer, [text[start:stop]])[0]
            if n <= most or to == at + 1:
                break
            to -= 1
        if start < stop:
            out.append((start, stop, n))
        at = to
    return out


def split_oversize(rows: DataFrame, maker: Maker, most: int, *by: str) -> DataFrame:
    """``*by, start, stop, text, n_tokens``: rows with ``start, text`` whose text has more than ``most`` tokens, in pieces; the others as they are."""
    kinds = dict(rows.dtypes)
    slim = rows.select(*by, F.col("start").cast("long").alias("start"), "text")

    def run(batches):
        tokenizer = made(maker)
        for batch in batches:
            for part in _slices(batch, "text"):
                texts, first = part.column("text").to_pylist(), part.column("start").to_pylist()
                row, spans, found = [], [], []
                for i, (text, n) in enumerate(zip(texts, np.diff(begins(tokenizer, texts)[1]).tolist(), strict=True)):
                    for start, stop, m in [(0, len(text), n)] if n <= most else pieces(tokenizer, text, most):
                        row.append(i)
                        spans.append((first[i] + start, first[i] + stop, m))
                        found.append(text[start:stop])
                start, stop, n = np.array(spans, np.int64).reshape(-1, 3).T
                kept = part.select(list(by)).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(start), pa.array(stop), pa.array(found, pa.string()), pa.array(n.astype(np.int32))], names=[*by, "start", "stop", "text", "n_tokens"])

    return slim.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", start long, stop long, text string, n_tokens int")
