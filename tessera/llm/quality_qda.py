"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of the text. Class
covariances are shrunk towards their pooled diagonal, which keeps classes with
constant statistics invertible. A document's score is the logistic of the
difference of the two log-densities; the densities come from Mahalanobis
distances through the Cholesky factors' inverses, made once on the driver.

Fitting needs sums and sums of products only, so Spark adds them up over all
labelled rows and the driver sees one row per class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .quality_rules import SYMBOLS, UPPER, repeated_positions

FEATURES = ("length", "word_chars", "symbols", "bangs", "capitals", "digits", "repeats", "stutters", "variety", "twin_lines", "line_words", "marks")

_DIGITS = b"0123456789"
_MARKS = b".,;:?\"'()-"


def features(text: str | None) -> tuple[float, ...]:
    """The statistics of one whole text; a null text counts as an empty one, for which all are zero."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    chars = sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line.strip()]

    def per_100(chosen: bytes, of: int) -> float:
        return 100.0 * (len(raw) - len(raw.translate(None, chosen))) / of

    return (
        np.log1p(n),
        np.log(chars / n),
        np.log1p(per_100(SYMBOLS, n)),
        np.log1p(100.0 * raw.count(b"!") / n),
        np.log1p(per_100(UPPER, chars)),
        np.log1p(per_100(_DIGITS, chars)),
        (repeated_positions(ids) / n) ** 0.5,
        (float((ids[1:] == ids[:-1]).sum()) / n) ** 0.5,
        np.log1p(len(seen)) - np.log1p(n),
        (1 - len(set(lines)) / len(lines)) ** 0.5,
        np.log1p(n / len(lines)),
        np.log1p(per_100(_MARKS, n)),
    )


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and one double column per statistic, a row per input row.

    Null and empty texts, and texts without words, measure 0 throughout; very long
    texts are measured whole. Repeated rows are measured each. An empty table gives
    no rows. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = np.array([features(t) for t in part.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], names=["k", *FEATURES])

    kind = dict(slim.dtypes)["k"]
    return slim.mapInArrow(run, f"k {kind}, " + ", ".join(f"{f} double" for f in FEATURES)).withColumnRenamed("k", id_col)


@dataclass
class Discriminant:
    """Per class (0, 1): mean, inverse Cholesky factor, log-determinant; ``offset`` is the log prior ratio."""

    means: list[np.ndarray]
    inverse: list[np.ndarray]
    log_det: list[float]
    offset: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        log = [-0.5 * ((((x - m) @ f.T) ** 2).sum(axis=1) + d) for m, f, d in zip(self.means, self.inverse, self.log_det, strict=True)]
        return 1.0 / (1.0 + np.exp(-np.clip(log[1] - log[0] + self.offset, -60.0, 60.0)))


def from_sums(counts: list[int], sums: list[np.ndarray], products: list[np.ndarray], *, shrink: float = 0.1, ridge: float = 1e-3) -> Discriminant | None:
    """The discriminant of two classes' counts, sums and sums of products; None if a class has no row."""
    if min(counts) == 0:
        return None
    means = [s / n for s, n in zip(sums, counts, strict=True)]
    cov = [p / n - np.outer(m, m) for p, n, m in zip(products, counts, means, strict=True)]
    pooled = sum(n * np.diag(c) for n, c in zip(counts, cov, strict=True)) / sum(counts)
    shrunk = [(1 - shrink) * c + np.diag(shrink * np.maximum(pooled, 0) + ridge) for c in cov]
    factors = [np.linalg.cholesky(c) for c in shrunk]
    inverse = [np.linalg.inv(f) for f in factors]
    return Discriminant(means, inverse, [2 * float(np.log(np.diag(f)).sum()) for f in factors], float(np.log(counts[1] / counts[0])))


def fit(rows: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant | None:
    """Fit on every row of ``rows`` (from :func:`measured`) that ``labels`` marks.

    Null labels are left out, and so are ids whose labels disagree. Rows of one id
    all count.
    """
    marks = labels.select(F.col(id_col), F.col(label_col).alias("y")).where(f"y in (0, 1) and {id_col} is not null")
    marks = marks.groupBy(id_col).agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select(id_col, "y")
    d = len(FEATURES)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in upper]
    found = {r.y: r for r in rows.join(marks, id_col).groupBy("y").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    if set(found) != {0, 1}:
        return None
    square = []
    for y in (0, 1):
        m = np.zeros((d, d))
        for i, j in upper:
            m[i, j] = m[j, i] = found[y][f"p{i}_{j}"]
        square.append(m)
    return from_sums([found[y].n for y in (0, 1)], [np.array([found[y][f"s{i}"] for i in range(d)]) for y in (0, 1)], square)


def score(rows: DataFrame, model: Discriminant | None, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col, score`` for every row of :func:`measured`; 0.5 throughout if no model could be fitted.

    Every row is scored, also rows of one id, of a null id and of texts without words.
    An empty table gives no rows.
    """
    if model is None:
        return rows.select(id_col, F.lit(0.5).alias("score"))
    slim = rows.select(F.col(id_col).alias("k"), *FEATURES)

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(model.scores(x))], names=["k", "score"])

    kind = dict(slim.dtypes)["k"]
    return slim.mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", id_col)
