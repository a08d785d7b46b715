"""How far each source of a language strays from the others, term by term.

Plain relational steps: regexp matches are exploded and counted by language, source
and term; the terms that enough documents of a language hold are its vocabulary;
groups are crossed with the vocabulary of their language, so that a term which a
group lacks counts as zero; a self-join on language and term puts the shares of two
sources side by side, and their differences are summed and ranked.

Counting is combined before the shuffle, so a source with most of the rows is no
task of its own. A language's vocabulary meets its groups in parts by term, as many
as there are shuffle partitions, since one language may hold most terms. The
self-join has as many rows a key as a language has sources. Shares are whole
numbers, divided as decimals, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash

#: Fixed value: runs of ASCII letters and of all characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What each count is raised by, and the whole that shares are parts of.
RAISED, WHOLE = 5, 1_000_000_000
RESULT = ("lang", "source", "part", "item", "value", "rank")


def lowered(text: Column) -> Column:
    """The text with only A-Z in lower case; where it is all ASCII, ``lower`` does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents. Each document sends its terms and, behind them, its distinct terms."""
    terms = docs.select("lang", "source", F.regexp_extract_all(lowered(F.col("text")), F.lit(TERM), F.lit(0)).alias("terms"))
    each = terms.select("lang", "source", F.size("terms").alias("m"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("pos", "term"))
    occurs = (F.col("pos") < F.col("m")).cast("long")
    return each.groupBy("lang", "source", "term").agg(F.sum(occurs).alias("n"), F.sum(1 - occurs).alias("docs"))


def vocabulary(counts: DataFrame, min_docs: int) -> DataFrame:
    """The rows of ``counts`` whose term at least ``min_docs`` documents of the language hold, with the language's ``total`` and the row's number ``nth`` of its term."""
    whole = W.partitionBy("lang", "term")
    known = counts.select("lang", "source", "term", "n", F.sum("docs").over(whole).alias("held"), F.sum("n").over(whole).alias("total"), F.row_number().over(whole.orderBy("source")).alias("nth"))
    return known.where(F.col("held") >= min_docs).drop("held")


def share(n: str, total: str, size: str) -> Column:
    """``1 + floor(WHOLE * (n + RAISED) / (total + RAISED * size))`` in whole numbers."""
    return F.expr(f"1 + (cast({WHOLE} as decimal(10,0)) * cast({n} + {RAISED} as decimal(20,0))) div cast({total} + {RAISED} * {size} as decimal(20,0))")


def divergence(docs: DataFrame, *, min_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``, by ``lang`` and ``source`` of ``docs``.

    Part ``pair``: ``item`` is each other source of the language, ``value`` the sum of
    the absolute differences of both sources' shares over the language's vocabulary.
    Part ``term``: ``item`` is each term of the vocabulary that the group holds and
    whose share exceeds the language's, ``value`` how far, down to rank ``top``.
    Ranks start at 1 in each group and part, by falling value, then by item in the
    order of UTF-8 bytes.

    Null texts, languages and sources count as empty strings. Texts without terms
    add a group but no counts; a language without vocabulary has pairs of value 0.
    Repeated rows count each. Very long texts are read whole. An empty input gives
    no rows. Other columns are not read.
    """
    blank = F.lit("")
    slim = docs.select(*(F.coalesce(F.col(c), blank).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    known = stash(vocabulary(term_counts(slim), min_docs), "vocabulary")
    words = known.where("nth = 1").select("lang", "term", "total")
    sizes = words.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("total").alias("lang_n"))
    held = known.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = stash(slim.select("lang", "source").distinct().join(held, ["lang", "source"], "left").fillna(0, "group_n"), "groups")

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = words.withColumn("deal", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    beside = groups.join(sizes, "lang").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    grid = dealt.join(beside, ["lang", "deal"]).drop("deal").join(known.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").fillna(0, "n")
    cells = stash(grid.select("lang", "source", "term", "n", share("n", "group_n", "size").alias("p"), share("total", "lang_n", "size").alias("q")), "shares")

    a = cells.select("lang", "term", F.col("source").alias("source"), F.col("p").alias("pa"))
    b = cells.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("pb"))
    sums = a.join(b, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other").agg(F.sum(F.abs(F.col("pa") - F.col("pb"))).alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    names = groups.select("lang", "source")
    pairs = names.join(names.withColumnRenamed("source", "other"), "lang").where("source <> other").join(both, ["lang", "source", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    terms = cells.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top)).select(*RESULT)


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL, over ``documents``."""
    of = f"1 + (CAST({WHOLE} AS HUGEINT) * ({{0}} + {RAISED})) // ({{1}} + {RAISED} * v)"
    return rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS ts FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) q GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) q GROUP BY ALL HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
w AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS gn, count(*) OVER (PARTITION BY lang, source) AS v,
    sum(n) OVER (PARTITION BY lang, term) AS t, sum(n) OVER (PARTITION BY lang) AS ln FROM cell),
s AS (SELECT lang, source, term, n, {of.format("n", "gn")} AS p, {of.format("t", "ln")} AS q FROM w),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) q WHERE part = 'pair' OR rank <= 50"""
