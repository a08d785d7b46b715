"""Language identification by nearest centroid.

A text is a vector of hashed letter trigrams, weighted by logarithmic frequency
and inverse document frequency and normalised. Each language has several
centroids from spherical k-means, since a language's texts form more than one
cloud. A text gets the language of the centroid with the greatest cosine; it is
rejected if it lies farther from that centroid than training texts of the
language do. The longer a text, the nearer it is to its centroid, and the more its
hashed trigrams also collide with those of any language; so the bound depends on
the number of different trigrams, and windows of training texts tell it for short
texts.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import publish, published, slices, stash, unstash

DIM_BITS = 12
DIM = 1 << DIM_BITS
UNKNOWN = "und"
#: Bytes of a text that are turned into trigrams at a time.
_BLOCK = 1 << 20
#: ASCII bytes other than letters become spaces; bytes of longer characters stay.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


#: Words of the windows of training texts from which floors of shorter texts are taken.
_WINDOWS = (3, 5, 10, 20, 50, 100, 200, 500, 1000)
#: Steps of the number of different trigrams: half powers of two. A step needs so many windows for a floor of its own.
_STEPS, _LEAST = 2 * DIM_BITS + 1, 20
#: Languages that are few enough to be sent to every task.
_LANGUAGES = 10_000
#: Centroids that the driver and a task hold at once, 16 kB each.
_CENTROIDS = 4096
#: No cosine below this is accepted: collisions alone bring short texts of any script this far.
_NEVER = 0.05


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigram_counts(text: str | None) -> np.ndarray:
    """Hashed counts of the trigrams of the lower-cased text; those with two spaces in a row are left out."""
    out = np.zeros(DIM, np.float32)
    raw = b" " + (text or "").lower().encode().translate(_LETTERS) + b" "
    for start in range(0, len(raw) - 2, _BLOCK):
        b = np.frombuffer(raw, np.uint8, min(_BLOCK + 2, len(raw) - start), start).astype(np.uint32)
        code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        blank = b == 32
        code = code[~(blank[1:-1] & (blank[:-2] | blank[2:]))]
        out += np.bincount(code * np.uint32(2654435761) >> np.uint32(32 - DIM_BITS), minlength=DIM)
    return out


def unit_vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, and the step of each text's number of different trigrams."""
    counts = np.stack([trigram_counts(t) for t in texts])
    step = np.floor(2 * np.log2(np.maximum((counts > 0).sum(axis=1), 1))).astype(int)
    x = np.log1p(counts) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32), step


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and members' nearest centroids. Seeds are spread over the rows' closeness to the mean, so the result depends on the rows alone."""
    order = np.argsort(x @ x.mean(axis=0), kind="stable")
    k = min(k, len(x))
    seeds = order[[(2 * j + 1) * len(x) // (2 * k) for j in range(k)]]
    c = x[seeds]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(axis=1)


def floors(texts: list[str], idf: np.ndarray, centroids: np.ndarray, slack: float, outlying: float) -> np.ndarray:
    """By step: ``slack`` times the cosine that all but ``outlying`` of training texts and of windows cut from them exceed.

    A step is taken together with the next on either side. One with too few windows takes the floor of the next lower step, and those
    below the first take the least floor.
    """
    words = [t.split() for t in texts]
    cosines, steps = [], []
    for n in (*_WINDOWS, 0):
        # The windows begin at different shares of the texts.
        cut = [" ".join(w[(at := (len(w) - n) * (i % 5) // 4) : at + n]) if n else texts[i] for i, w in enumerate(words) if len(w) >= n]
        cut = [t for t in cut if has_letter(t)]
        for start in range(0, len(cut), 200):
            x, step = unit_vectors(cut[start : start + 200], idf)
            cosines.append((x @ centroids.T).max(axis=1))
            steps.append(step)
    if not cosines:
        return np.full(_STEPS, _NEVER)
    cosine, step = np.concatenate(cosines), np.concatenate(steps)
    near = [cosine[abs(step - s) <= 1] for s in range(_STEPS)]
    own = [slack * float(np.quantile(c, outlying)) if len(c) >= _LEAST else None for c in near]
    last = min((f for f in own if f is not None), default=slack * float(np.quantile(cosine, outlying)))
    out = np.array([last := last if f is None else f for f in own])
    return np.maximum(out, _NEVER)


class Model:
    """Nearest centroids over blocks of them; ties go to the first in order of language."""

    idf: np.ndarray

    def blocks(self):
        """Centroids, their languages and their floors, block by block."""
        raise NotImplementedError

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lettered = np.array([has_letter(t) for t in texts], bool)
        x, step = unit_vectors(texts, self.idf)
        best, floor, langs = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.full(len(texts), UNKNOWN, object)
        for centroids, names, floors in self.blocks():
            cosine = x @ centroids.T
            at = cosine.argmax(axis=1)
            own = cosine[np.arange(len(texts)), at].astype(float)
            better = own > best
            best[better], floor[better], langs[better] = own[better], floors[at, step][better], np.array(names, object)[at][better]
        score = np.clip(best, 0.0, 1.0)
        return np.where(lettered, langs, UNKNOWN).tolist(), np.where(lettered, score, 0.0).tolist(), ((score < floor) | ~lettered).tolist()


@dataclass
class CentroidModel(Model):
    """``floor`` is, by centroid and step of different trigrams, the least cosine that is not rejected."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floor: np.ndarray

    def blocks(self):
        yield self.centroids, self.langs, self.floor


@dataclass
class PublishedModel(Model):
    """Centroids of very many languages, in blocks that lie in the shared folder; a task reads one at a time."""

    idf: np.ndarray
    names: list[str]

    def blocks(self):
        for name in self.names:
            with open(published(name), "rb") as file:
                block = pickle.load(file)  # noqa: S301  written by fit
            yield block.centroids, block.langs, block.floor


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 600, clusters: int = 4, slack: float = 0.5, outlying: float = 0.01) -> Model | None:
    """Fit on at most ``per_lang`` labelled rows of each language, taken by a hash of the id.

    The bound is on the rows that a classifier is fitted on; k-means runs in one
    task per language, over at most that many rows. Rows without a language, a
    text or an id teach nothing; rows of one id teach once, by the least text.
    Long texts are read whole. None if no row teaches anything.
    """
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).where("lang is not null and t is not null and k is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = stash(sizes.select("lang", F.least(F.lit(1.0), F.lit(1.5 * per_lang) / F.col("n")).alias("share")), "langid-shares")
    # Few languages are the rule; a column of very many values is joined by a shuffle.
    picked = rows.join(F.broadcast(share) if share.count() <= _LANGUAGES else share, "lang").where(F.pmod(F.xxhash64("k", F.lit("langid")), F.lit(1 << 30)) <= F.col("share") * F.lit(1 << 30))
    once = picked.groupBy("lang", "k").agg(F.min("t").alias("t"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("k"), "k"))
    sample = stash(once.withColumn("nth", nth).where(F.col("nth") <= per_lang).select("lang", "t"), "langid-sample")

    def document_frequency(batches):
        total, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column("t").to_pylist():
                total += trigram_counts(text) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "df"])

    unstash(share)
    parts = sample.coalesce(8).mapInArrow(document_frequency, "n long, df array<long>").collect()
    n = sum(r.n for r in parts)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + np.sum([r.df for r in parts], axis=0))) + 1e-3

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(frame.t)
        c, _ = spherical_kmeans(unit_vectors(texts, idf)[0], clusters)
        floor = floors(texts, idf, c, slack, outlying).tolist()
        return pd.DataFrame({"lang": frame.lang.iloc[0], "j": range(len(c)), "centroid": [row.astype("<f4").tobytes() for row in c], "floor": [floor] * len(c)})

    found = stash(sample.groupBy("lang").applyInPandas(cluster, "lang string, j int, centroid binary, floor array<double>").orderBy("lang", "j"), "centroids")
    names, held = [], []

    def block() -> CentroidModel:
        return CentroidModel(idf, np.stack([np.frombuffer(r.centroid, "<f4") for r in held]), [r.lang for r in held], np.array([r.floor for r in held]))

    # The driver holds one block; few languages are one, and go along with the tasks.
    for r in found.orderBy("lang", "j").toLocalIterator():
        if len(held) == _CENTROIDS:
            names.append(publish(docs.sparkSession, pickle.dumps(block()), "centroids"))
            held = []
        held.append(r)
    unstash(sample, found)
    if not names:
        return block()
    return PublishedModel(idf, [*names, publish(docs.sparkSession, pickle.dumps(block()), "centroids")])


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, lang_pred, score, rejected``.

    Whole texts are read. Null texts and texts without a letter are ``und`` with
    score 0 and rejected, and so is every row if there is no model. Ties go to
    the first language in order of name. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    if model is None:
        return slim.select(F.col("k").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                langs, scores, far = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], names=["k", "lang_pred", "score", "rejected"])

    kind = dict(slim.dtypes)["k"]
    return slim.mapInArrow(run, f"k {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("k", id_col)


def keep(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected; judged row by row, without a join.

    Null texts and texts without a letter are rejected; very long texts are read
    whole; repeated rows are judged each, whatever their ids. Without a model, and of
    an empty table, nothing stays.
    """
    if model is None:
        return docs.where(F.lit(False))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                far = model.predict(part.column(at).to_pylist())[2]
                yield part.filter(pa.array([not f for f in far], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
