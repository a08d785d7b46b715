"""A training-data pipeline of five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and
returns a DataFrame; all but the last return the columns of ``documents``. A
runner writes each result as Parquet and reads it as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe_lexicon, decontam, langid, near_dedup, quality_rules
from tessera.llm.common import prepare, release, stash, table, written
from tessera.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those far from every language of the input.

    Null, empty and blank texts go; documents without a language or id teach nothing
    and are judged like others, as are repeated rows. Without any label all go.
    """
    prepare(spark)
    return langid.keep(docs, langid.fit(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail a rule of the current policy.

    Null, empty and blank texts fail the rule of no words. Repeated rows are judged each.
    """
    prepare(spark)
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group linked by five-word shingles at 0.8.

    A null id comes last; of rows alike in id and text one stays; texts without words all stay.
    """
    prepare(spark)
    return near_dedup.keep(docs, near_dedup.Plan.near(words=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold an item of ``benchmark``.

    Null and empty texts hold none and stay; an empty benchmark keeps all.
    """
    prepare(spark)
    return decontam.keep(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes it again and returns counts and digests, a row a document; a null text counts as empty."""
    prepare(spark)
    lexicon = bpe_lexicon.build_lexicon(bpe_lexicon.count_words(docs), tokenizer_path())
    return bpe_lexicon.digests(bpe_lexicon.encode_decode(docs, lexicon))


STAGES = [
    ("language ID", language),
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: SQL cannot express the learned stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Once a stage's documents are written, what it and the stage before have written goes; what the result reads goes with ``common.release``."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, since=before, kept=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
