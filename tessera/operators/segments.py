"""Semantic segmentation: boundary scores, breakpoints and bounded groups.

The merging of groups is a fixpoint whose steps depend on each other, so a document's
groups go through one Python call; a document bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals


def by_document(rows: DataFrame, order: str, of: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``of`` makes of whole documents (``doc``): it gets the rows of one or more, each in the order of ``order``, and where each begins and the last ends.

    Rows are dealt by document and stream through their tasks in order; a task holds
    a batch of rows, or a document where that is more.
    """

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        doc = table.column("doc").to_numpy()
        return of(table, np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)])))

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            if held and held[-1].column("doc")[-1].as_py() != doc[0]:
                yield whole(held)
                held = []
            turns = np.flatnonzero(doc[1:] != doc[:-1])
            cut = int(turns[-1]) + 1 if len(turns) else 0
            if cut:
                yield whole([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield whole(held)

    return rows.where("doc is not null").repartition("doc").sortWithinPartitions("doc", order).mapInArrow(run, schema)


def scores_between(x: np.ndarray, width: int) -> np.ndarray:
    """For each place but the first: cosine of the mean of up to ``width`` rows before it and that of as many from it on; 0 without length."""
    total = np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)])
    n = len(x)
    at = np.arange(1, n)
    left = (total[at] - total[np.maximum(0, at - width)]) / np.minimum(at, width)[:, None]
    right = (total[np.minimum(n, at + width)] - total[at]) / np.minimum(n - at, width)[:, None]
    lengths = np.sqrt((left**2).sum(axis=1) * (right**2).sum(axis=1))
    return np.divide((left * right).sum(axis=1), lengths, out=np.zeros(n - 1), where=lengths > 0)


def boundary_scores(vectors: DataFrame, width: int) -> DataFrame:
    """``doc, place, score``: cosine of the mean of up to ``width`` vectors before a place and the mean of as many from it on; 0 without length."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        score = scores_between(np.array(frame.embedding.tolist(), float), width)
        return pd.DataFrame({"doc": frame.doc.iloc[0], "place": frame.place.to_numpy()[1:], "score": score})

    return vectors.select("doc", "place", "embedding").groupBy("doc").applyInPandas(run, "doc long, place long, score double")


def groups_from_breaks(places: DataFrame, scores: DataFrame, percentile: float) -> DataFrame:
    """``doc, place, group_no``: a new group begins where the score is below the document's percentile."""
    limits = scores.groupBy("doc").agg(F.percentile("score", percentile).alias("limit"))
    cuts = scores.join(limits, "doc").select("doc", "place", F.when(F.round("score", 9) < F.round("limit", 9), 1).otherwise(0).alias("cut"))
    marked = places.join(cuts, ["doc", "place"], "left").fillna({"cut": 0})
    return marked.select("doc", "place", F.sum("cut").over(W.partitionBy("doc").orderBy("place")).alias("group_no"))


def bound_groups(units: DataFrame, least: int, most: int) -> DataFrame:
    """``doc, place, group_no`` after groups under ``least`` tokens joined a neighbour and those over ``most`` were split at their weakest place.

    ``units`` has ``doc, place, group_no, tokens, score``; the score of a place is that
    of the boundary before it. The first group that is too small joins the side whose
    boundary scores higher, the left one among equals, if the sum stays within
    ``most``; when none can, groups that are too large are split until they fit or
    have one unit.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        score, group = frame.score.fillna(-1.0).to_numpy(), frame.group_no.to_numpy()
        held = np.concatenate(([0], np.cumsum(frame.tokens.to_numpy() + 1)))
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(frame)]
        bounds = large_split(small_merged(bounds, held, score, least, most), held, score, most)
        number = np.searchsorted(bounds[1:], np.arange(len(frame)), side="right")
        return pd.DataFrame({"doc": frame.doc.iloc[0], "place": frame.place.to_numpy(), "group_no": number})

    return units.groupBy("doc").applyInPandas(run, "doc long, place long, group_no long")


def sized_groups(units: DataFrame, width: int, percentile: float, least: int, most: int) -> DataFrame:
    """``doc, group_no, n_units, n_tokens, first_place``: the groups of :func:`bound_groups` over those of :func:`groups_from_breaks`, from units ``doc, place, tokens, embedding``.

    Units are dealt once and their documents stream through the tasks; a group's size
    counts one token between its units.
    """

    def of(table: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
        place, tokens = (table.column(n).to_numpy() for n in ("place", "tokens"))
        vectors = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(place), -1)
        found = []
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            score = np.concatenate(([-1.0], scores_between(vectors[a:b], width)))
            held = np.concatenate(([0], np.cumsum(tokens[a:b] + 1)))
            bounds = [0, *breaks(score[1:], percentile), int(b - a)]
            bounds = np.array(large_split(small_merged(bounds, held, score, least, most), held, score, most))
            found.append(np.stack((np.full(len(bounds) - 1, a), np.arange(len(bounds) - 1), np.diff(bounds), np.diff(held[bounds]) - 1, place[a + bounds[:-1]])))
        doc, number, n, size, first = np.concatenate(found, axis=1)
        columns = {"doc": table.column("doc").combine_chunks().take(pa.array(doc)), "group_no": pa.array(number), "n_units": pa.array(n), "n_tokens": pa.array(size), "first_place": pa.array(first)}
        return pa.RecordBatch.from_pydict(columns)

    rows = units.select("doc", "place", F.col("tokens").cast("long").alias("tokens"), F.col("embedding").cast("array<double>").alias("embedding"))
    return by_document(rows, "place", of, "doc long, group_no long, n_units long, n_tokens long, first_place long")


def breaks(score: np.ndarray, percentile: float) -> list[int]:
    """Places where a group begins, for the scores of the places but the first: those below the percentile, interpolated as Spark does; scores are compared at nine digits."""
    if not len(score):
        return []
    at = (len(score) - 1) * percentile
    low, high = int(np.floor(at)), int(np.ceil(at))
    ends = np.partition(score, (low, high))
    limit = ends[low] if low == high or ends[low] == ends[high] else (high - at) * ends[low] + (at - low) * ends[high]
    return (1 + np.flatnonzero(np.round(score, 9) < np.round(limit, 9))).tolist()


def small_merged(bounds: list[int], held: np.ndarray, score: np.ndarray, least: int, most: int | None = None) -> list[int]:
    """Group bounds after groups of under ``least`` tokens joined a neighbour, the first such group first.

    Of the two boundaries of a group the one with the higher score goes, the left
    one among equals. With ``most``, only sums of up to so many tokens are allowed,
    and groups without an allowed neighbour stay. ``held`` are running sums of tokens,
    one more for each unit, so a group's size counts one token between its units.
    """
    held, score = held.tolist(), score.tolist()
    done, a, i = [], bounds[0], 1
    # What lies before ``a`` stays: no group there is small and has an allowed neighbour, and sums only grow.
    while i < len(bounds):
        b = bounds[i]
        if held[b] - held[a] - 1 < least:
            left = bool(done) and (most is None or held[b] - held[done[-1]] - 1 <= most)
            right = i + 1 < len(bounds) and (most is None or held[bounds[i + 1]] - held[a] - 1 <= most)
            if left and (not right or score[a] >= score[b]):
                a = done.pop()
                continue
            if right:
                i += 1
                continue
        done.append(a)
        a, i = b, i + 1
    return [*done, bounds[-1]]


def large_split(bounds: list[int], held: np.ndarray, score: np.ndarray, most: int) -> list[int]:
    """Group bounds after groups of over ``most`` tokens were parted at their weakest boundary, the first among equals, until they fit or have one unit."""
    todo, done = list(zip(bounds, bounds[1:], strict=False)), [bounds[-1]]
    while todo:
        a, b = todo.pop()
        if held[b] - held[a] - 1 <= most or b - a == 1:
            done.append(a)
        else:
            cut = a + 1 + int(np.argmin(score[a + 1 : b]))
            todo += [(a, cut), (cut, b)]
    return sorted(done)


def merge_small(units: DataFrame, least: int) -> DataFrame:
    """``doc, place, group_no`` after every group under ``least`` tokens joined a neighbour, the first such group first.

    Of a group's two boundaries the one with the higher score goes, the left one
    among equals; the first and the last group have one boundary each, which goes
    whatever its score. A single group stays. ``units`` is as for :func:`bound_groups`.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        score, group = frame.score.fillna(-1.0).to_numpy(), frame.group_no.to_numpy()
        held = np.concatenate(([0], np.cumsum(frame.tokens.to_numpy() + 1)))
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(frame)]
        bounds = small_merged(bounds, held, score, least)
        number = np.searchsorted(bounds[1:], np.arange(len(frame)), side="right")
        return pd.DataFrame({"doc": frame.doc.iloc[0], "place": frame.place.to_numpy(), "group_no": number})

    return units.groupBy("doc").applyInPandas(run, "doc long, place long, group_no long")


#: Most words of a fragment, and the marks that close a sentence.
FRAGMENT_WORDS, CLOSING = 8, ".;:!?"


def is_fragment(text: str) -> bool:
    """Whether a text, or every line of it, is too short to stand alone: few words and no closing mark, or marks only."""
    lines = [line.strip() for line in text.splitlines() if line.strip()] or [""]
    return all(not any(map(str.isalnum, line)) or (len(line.split()) <= FRAGMENT_WORDS and line[-1] not in CLOSING) for line in lines)


def merge_fragments(sentences: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc, start, stop, units``: sentences of which fragments joined the next one, or else the one before, that shares a unit with them.

    ``sentences`` has ``doc, start, stop, units``, ``texts`` has ``doc, text``. A joined
    sentence is the text from the first one's start to the last one's stop and has
    the units of both; it may be a fragment again, so passes go on until one joins
    nothing. A document's sentences are one row beside its text, which comes once;
    a document bounds what a task holds.
    """
    packed = sentences.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "units"))).alias("rows"))
    lists = packed.select("doc", *(F.col(f"rows.{n}").alias(n) for n in ("start", "stop", "units")))

    def of(text: str, start: np.ndarray, stop: np.ndarray, units: list) -> list[tuple[int, int, list]]:
        return joined(text, list(zip(start.tolist(), stop.tolist(), units, strict=True)))

    def run(batches):
        for batch in batches:
            first, last, units = (batch.column(n) for n in ("start", "stop", "units"))
            each = (of(text.as_py(), *(x[i].values.to_numpy() for x in (first, last)), units[i].as_py()) for i, text in enumerate(batch.column("text")))
            yield _sentence_batch(batch.column("doc"), list(each))

    return lists.join(texts, "doc").select("doc", "text", F.col("start").cast("array<long>"), F.col("stop").cast("array<long>"), "units").mapInArrow(run, "doc long, start long, stop long, units array<long>")


def document_sentences(docs: DataFrame, units: DataFrame, pattern: str) -> DataFrame:
    """``doc, start, stop, units, text``: what ``pattern`` matches in ``doc, text`` and overlaps a unit (``doc, unit, start, stop``), fragments joined as by :func:`merge_fragments`.

    A document is one row from its text to its sentences: Spark finds the lengths of
    what matches and of what lies between, and brings the units beside them; sums of
    the lengths give the places.
    """
    lengths = intervals.match_lengths(docs.select("doc", "text"), "text", pattern, "doc", "text")
    own = units.where("stop > start").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*(F.col(n).cast("long").alias(n) for n in ("start", "stop", "unit"))))).alias("units"))
    beside = own.select("doc", *(F.col(f"units.{n}").alias(f"unit_{n}") for n in ("start", "stop", "unit")))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _DOCUMENTS):
                batch = whole.slice(at, _DOCUMENTS)
                columns = [batch.column(n) for n in ("gaps", "found", "kept", "unit_start", "unit_stop", "unit_unit")]
                texts, found = batch.column("text").to_pylist(), []
                for i, text in enumerate(texts):
                    gaps, raw, kept, *unit = (x[i].values.to_numpy() for x in columns)
                    start = np.cumsum(gaps[: len(raw)] + raw) - raw
                    found.append(joined(text, _overlapping(start, start + kept, *unit)))
                yield _sentence_batch(batch.column("doc"), found, texts)

    return lengths.join(beside, "doc").mapInArrow(run, "doc long, start long, stop long, units array<long>, text string")


#: Documents whose sentences are found at a time.
_DOCUMENTS = 256


def _overlapping(start: np.ndarray, stop: np.ndarray, unit_start: np.ndarray, unit_stop: np.ndarray, unit: np.ndarray) -> list[tuple[int, int, list]]:
    """The spans that overlap a unit, with the numbers of the units; units are in order of their starts."""
    reach = np.maximum.accumulate(unit_stop)
    apart = bool((reach == unit_stop).all())
    low, high = np.searchsorted(reach, start, "right").tolist(), np.searchsorted(unit_start, stop, "left").tolist()
    numbers, out = unit.tolist(), []
    for a, b, i, j in zip(start.tolist(), stop.tolist(), low, high, strict=True):
        if a < b and i < j:
            met = numbers[i:j] if apart else [numbers[n] for n in range(i, j) if unit_stop[n] > a]
            if met:
                out.append((a, b, sorted(met) if len(met) > 1 else met))
    return out


def _sentence_batch(docs: pa.Array, found: list[list[tuple[int, int, list]]], texts: list[str] | None = None) -> pa.RecordBatch:
    rows = [row for rows in found for row in rows]
    doc = docs.take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64()))
    columns = {"doc": doc, "start": pa.array([x[0] for x in rows], pa.int64()), "stop": pa.array([x[1] for x in rows], pa.int64()), "units": pa.array([x[2] for x in rows], pa.list_(pa.int64()))}
    if texts is not None:
        columns["text"] = pa.array([text[a:b] for text, rows in zip(texts, found, strict=True) for a, b, _ in rows], pa.string())
    return pa.RecordBatch.from_pydict(columns)


def joined(text: str, rows: list[tuple[int, int, list]]) -> list[tuple[int, int, list]]:
    """The sentences ``start, stop, units`` of a text, in order, after fragments joined their neighbours."""
    known: dict[tuple[int, int], bool] = {}

    def fragment(row: tuple[int, int, list]) -> bool:
        span = row[:2]
        if span not in known:
            known[span] = is_fragment(text[span[0] : span[1]])
        return known[span]

    size = None
    while size != len(rows):
        size, rows = len(rows), _joined_once(rows, fragment)
    return rows


def _joined_once(rows: list[tuple[int, int, list]], fragment: Callable[[tuple[int, int, list]], bool]) -> list[tuple[int, int, list]]:
    ahead, out = rows[::-1], []
    while ahead:
        row = ahead.pop()
        if fragment(row):
            if ahead and not set(row[2]).isdisjoint(ahead[-1][2]):
                row = _together(row, ahead.pop())
            elif out and not set(row[2]).isdisjoint(out[-1][2]):
                row = _together(out.pop(), row)
        out.append(row)
    return out


def _together(a: tuple[int, int, list], b: tuple[int, int, list]) -> tuple[int, int, list]:
    return a[0], b[1], a[2] if a[2] == b[2] else [*a[2], *(u for u in b[2] if u not in a[2])]
