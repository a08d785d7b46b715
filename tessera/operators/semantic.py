"""Chunks of texts cut where the meaning turns: sentences, vectors, boundaries, bounded groups, spans and units.

Every step is a Spark job over all documents: sentences come from expressions beside
the units of their document, vectors from one call an Arrow batch over distinct
texts. Grouping is a fixpoint within a document, which bounds what a task holds; it is
found in one pass over the document's groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals, models, segments, tokens
from .segments import large_split, small_merged


def chunk_bounds(vectors: np.ndarray, held: np.ndarray, percentile: float, least: int, most: int, window: int) -> list[int]:
    """Where the chunks of one document begin, and the number of its segments.

    A chunk begins where the score between segments is below the document's
    percentile; small ones merge, large ones are split, and small ones merge where the
    sum stays in bounds. Scores are compared at nine digits.
    """
    score = np.concatenate(([-1.0], segments.scores_between(vectors, window)))
    cuts = []
    if len(vectors) > 1:
        limit = np.round(np.percentile(score[1:], 100 * percentile), 9)
        cuts = (1 + np.flatnonzero(np.round(score[1:], 9) < limit)).tolist()
    bounds = small_merged([0, *cuts, len(vectors)], held, score, least)
    return small_merged(large_split(bounds, held, score, most), held, score, least, most)


def chunk_spans(placed: DataFrame, percentile: float, least: int, most: int, window: int) -> DataFrame:
    """``doc, chunk_no, start, stop, n_sentences`` from segments ``doc, start, stop, tokens, embedding``; documents stream through their tasks in order."""

    def of(table: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
        start, stop, tokens = (table.column(n).to_numpy() for n in ("start", "stop", "tokens"))
        vectors = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(start), -1)
        found, number, doc = [], [], []
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            held = np.concatenate(([0], np.cumsum(tokens[a:b] + 1)))
            bounds = a + np.array(chunk_bounds(vectors[a:b], held, percentile, least, most, window))
            found.append(np.stack((bounds[:-1], bounds[1:])))
            number.append(np.arange(len(bounds) - 1))
            doc.append(np.repeat(a, len(bounds) - 1))
        first, last = np.concatenate(found, axis=1)
        columns = {"doc": table.column("doc").combine_chunks().take(pa.array(np.concatenate(doc))), "chunk_no": pa.array(np.concatenate(number))}
        return pa.RecordBatch.from_pydict(columns | {"start": pa.array(start[first]), "stop": pa.array(stop[last - 1]), "n_sentences": pa.array(last - first)})

    rows = placed.select("doc", "start", "stop", "tokens", F.col("embedding").cast("array<double>").alias("embedding"))
    return segments.by_document(rows, "start", of, "doc long, chunk_no long, start long, stop long, n_sentences long")


def sentence_segments(docs: DataFrame, units: DataFrame, maker: tokens.Maker, most: int, pattern: str) -> DataFrame:
    """``doc, start, stop, text, tokens``: sentences that overlap a unit, fragments joined to related neighbours, those of over ``most`` tokens in pieces."""
    merged = segments.document_sentences(docs, units, pattern).select("doc", "start", "text")
    parts = tokens.split_oversize(merged, maker, most, "doc")
    return parts.select("doc", "start", "stop", "text", F.col("n_tokens").cast("long").alias("tokens"))


def chunks(
    docs: DataFrame, units: DataFrame, embedder: models.Embedder, maker: tokens.Maker, *, percentile: float = 0.5, least: int = 64, most: int = 256, window: int = 3, pattern: str = r"[^\s.!?][^\n.!?]*[.!?]*"
) -> DataFrame:
    """``doc, chunk_no, start, stop, text, n_tokens, n_sentences, units``: chunks of ``doc, text`` with the units (``doc, unit, start, stop``) they overlap, in order.

    A chunk's text is its span of the document's text and ``n_tokens`` the tokens of
    that. Sentences that overlap no unit belong to no chunk of their own. Documents
    that are null, empty or without units have no chunks.
    """
    docs = docs.where("text is not null")
    parts = sentence_segments(docs, units, maker, most, pattern)
    hashed = parts.withColumn("text_sha256", F.sha2("text", 256))
    no_cache = docs.sparkSession.createDataFrame([], "text_sha256 string")
    vectors = models.embed_missing(parts, no_cache, embedder)
    spans = chunk_spans(hashed.join(vectors, "text_sha256"), percentile, least, most, window)
    met = intervals.overlapping(spans, units.select("doc", "unit", "start", "stop"), "doc").groupBy("doc", "chunk_no").agg(F.array_sort(F.collect_set("unit")).alias("units"))
    text = F.substring("text", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    cut = spans.join(met, ["doc", "chunk_no"]).join(docs.select("doc", "text"), "doc").withColumn("text", text)
    return tokens.with_counts(cut, maker).select("doc", "chunk_no", "start", "stop", "text", F.col("n_tokens").cast("long").alias("n_tokens"), "n_sentences", "units")
