"""Contexts packed from ranked chunks, by the tokens of the text they make together.

A query's candidates are a bounded pool; its fold is one group of a grouped call. The
state is the rendered context itself, since tokens of joined texts do not add up.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens

OVER, CLOSER = "context_budget", "volume_target_closest_prefix"
SEPARATOR = "\n\n"


def body(references: Column, document: Column, answers: Column, text: Column) -> Column:
    """What a passage shows behind its number."""
    return F.concat(F.lit("Reference: "), F.array_join(references, ", "), F.lit("\nDocument: "), document.cast("string"), F.lit("\nAnswer unit: "), F.array_join(answers, ", "), F.lit("\n"), text)


def fold(bodies: list[str], count, budget: int | None, target: int | None = None, least: int = 0) -> tuple[list[int], list[tuple[int, str]], list[str], int]:
    """Which candidates go in, which stay out and why, the passages, and the tokens of the context.

    A candidate that would break the budget is passed over and later ones are still
    tried. With a target, and ``least`` passages in, packing ends once the target is
    reached; a last passage that would end farther from it than the context already
    is stays out.
    """
    taken: list[int] = []
    out: list[tuple[int, str]] = []
    passages: list[str] = []
    size = 0
    for i, text in enumerate(bodies):
        passage = f"[{len(taken) + 1}] {text}"
        grown = count(SEPARATOR.join([*passages, passage]))
        if budget is not None and grown > budget:
            out.append((i, OVER))
            continue
        full = target is not None and len(taken) >= least and grown >= target
        if full and abs(size - target) < abs(grown - target):
            out.append((i, CLOSER))
            break
        passages.append(passage)
        taken.append(i)
        size = grown
        if target is not None and len(taken) >= least and size >= target:
            break
    return taken, out, passages, size


def assemble(candidates: DataFrame, maker: tokens.Maker, *, key: str = "query_id", budget: int | None = None, targets: DataFrame | None = None, least: int = 0, tolerance: float | None = None) -> DataFrame:
    """One row a query: ``included`` and ``excluded`` candidates in order, the context and its tokens.

    ``candidates`` has ``key, place, chunk_id`` (a string) and ``body``; of a chunk
    that comes twice the first place counts. ``targets`` (``key, target``) turns on
    matching of volume: then ``volume_delta``, ``volume_error`` and ``volume_met``
    (an error of up to ``tolerance``) are not null. Queries without a target have none.
    """
    if targets is not None and tolerance is None:
        raise ValueError("a volume target needs a tolerance")
    first = F.row_number().over(W.partitionBy(key, "chunk_id").orderBy("place"))
    rows = candidates.select(key, "place", F.col("chunk_id").cast("string").alias("chunk_id"), "body").withColumn("__n", first).where("__n = 1").drop("__n")
    rows = rows.withColumn("target", F.lit(None).cast("long")) if targets is None else rows.join(targets.select(key, F.col("target").cast("long").alias("target")), key, "left")
    kind = dict(rows.dtypes)[key]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", "chunk_id"])
        tokenizer = tokens.made(maker)
        target = None if pd.isna(frame.target.iloc[0]) else int(frame.target.iloc[0])
        names = frame.chunk_id.tolist()
        taken, out, passages, size = fold(frame.body.tolist(), lambda t: tokens.counts(tokenizer, [t])[0], budget, target, least)
        row = {
            key: frame[key].iloc[0], "n_candidates": len(names), "included": [names[i] for i in taken], "excluded": [{"chunk_id": names[i], "reason": why} for i, why in out],
            "n_tokens": size, "context": SEPARATOR.join(passages), "volume_delta": None, "volume_error": None, "volume_met": None,
        }
        if target is not None:
            error = abs(size - target) / target if target else 0.0
            row |= {"volume_delta": size - target, "volume_error": error, "volume_met": error <= tolerance}
        return pd.DataFrame([row])

    schema = f"{key} {kind}, n_candidates long, included array<string>, excluded array<struct<chunk_id: string, reason: string>>, n_tokens long, context string, volume_delta long, volume_error double, volume_met boolean"
    return rows.groupBy(key).applyInPandas(run, schema)
