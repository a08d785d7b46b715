"""Offsets, windows, segmentation and chunk statistics over ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, ordering, segments, vectors
from .registry import Registry, read

R = Registry()
SIZE, STEP = 64, 48

BLOCKS_SQL = """b AS (SELECT doc_id, unnest(ls) AS block, generate_subscripts(ls, 1) - 1 AS block_no FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents) q),
o AS (SELECT doc_id, block_no, block, CAST(coalesce(sum(length(block) + 2) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM b)"""


@R.add(f"WITH {BLOCKS_SQL} SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, concat(doc_id, '.', block_no) AS unit_id, start, CAST(start + length(block) AS BIGINT) AS stop FROM o")
def unit_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = intervals.block_offsets(read(spark, sf_dir, "documents"), "text", "doc_id")
    return o.select("doc_id", "block_no", F.concat_ws(".", F.col("doc_id").cast("string"), F.col("block_no").cast("string")).alias("unit_id"), "start", "stop")


@R.add(
    f"""WITH {BLOCKS_SQL}, e AS (SELECT doc_id, max(start + length(block)) AS n FROM o GROUP BY 1), w AS (SELECT doc_id, unnest(generate_series(0, (n - 1) // 400)) AS window_no FROM e)
SELECT doc_id, window_no, count(*) AS n_units, CAST(sum(least(start + length(block), window_no * 400 + 500) - greatest(start, window_no * 400)) AS BIGINT) AS n_chars FROM w JOIN o USING (doc_id)
WHERE start < window_no * 400 + 500 AND window_no * 400 < start + length(block) GROUP BY ALL"""
)
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 500 characters, 400 apart, with the units they overlap."""
    o = intervals.block_offsets(read(spark, sf_dir, "documents"), "text", "doc_id")
    met = o.select("doc_id", "start", "stop", F.explode(intervals.overlapping_windows("start", "stop", 500, 400)).alias("window_no"))
    part = F.least(F.col("stop"), F.col("window_no") * 400 + 500) - F.greatest(F.col("start"), F.col("window_no") * 400)
    return met.groupBy("doc_id", "window_no").agg(F.count(F.lit(1)).alias("n_units"), F.sum(part).alias("n_chars"))


TOKENS = r"[^\x20\x09-\x0D]+"
WINDOWS_SQL = f"""t AS (SELECT doc_id, source, regexp_extract_all(text, '{TOKENS}') AS w FROM documents),
win AS (SELECT doc_id, source, w, unnest(generate_series(0, greatest(0, ceil((len(w) - {SIZE}) / {STEP})::BIGINT))) * {STEP} AS token_start FROM t WHERE len(w) > 0),
ch AS (SELECT doc_id, source, token_start, least(token_start + {SIZE}, len(w)) AS token_end, array_to_string(list_slice(w, token_start + 1, token_start + {SIZE}), ' ') AS chunk FROM win)"""


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_extract_all("text", F.lit(TOKENS), 0).alias("w"))
    rows = words.select("doc_id", "source", "w", F.explode(intervals.token_windows(F.size("w"), SIZE, STEP)).alias("token_start"))
    return rows.select("doc_id", "source", "token_start", F.least(F.col("token_start") + SIZE, F.size("w")).alias("token_end"), F.array_join(F.slice("w", F.col("token_start") + 1, SIZE), " ").alias("chunk"))


@R.add(f"WITH {WINDOWS_SQL} SELECT doc_id, CAST(token_start AS INTEGER) AS token_start, CAST(token_end AS INTEGER) AS token_end, md5(chunk) AS chunk_md5 FROM ch")
def fixed_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(spark, sf_dir).select("doc_id", "token_start", "token_end", F.md5("chunk").alias("chunk_md5"))


@R.add(
    f"""WITH {WINDOWS_SQL}, s AS (SELECT source, token_end - token_start AS n, doc_id FROM ch)
SELECT source, count(*) AS n_chunks, round(count(*) / count(DISTINCT doc_id), 6) AS per_document, CAST(min(n) AS INTEGER) AS lowest, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95, CAST(max(n) AS INTEGER) AS highest, round(avg(n), 6) AS mean FROM s GROUP BY 1"""
)
def chunk_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windowed(spark, sf_dir).select("source", "doc_id", (F.col("token_end") - F.col("token_start")).alias("n"))
    q = s.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("docs"), F.min("n").alias("lowest"), F.max("n").alias("highest"), F.avg("n").alias("m")
    )
    q = ordering.beside(q, ordering.quantiles(s, "n", {"median": 0.5, "p95": 0.95}, "source"), "source", how="left")
    return q.select("source", "n_chunks", F.round(F.col("n_chunks") / F.col("docs"), 6).alias("per_document"), "lowest", "median", "p95", "highest", F.round("m", 6).alias("mean"))


@R.add(
    """WITH s AS (SELECT l_orderkey, l_partkey % 100 AS start, l_partkey % 100 + l_quantity::BIGINT AS stop FROM lineitem),
m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY l_orderkey ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m), e AS (SELECT l_orderkey, island, max(stop) - min(start) AS n FROM i GROUP BY ALL)
SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS covered, count(*) AS islands, CASE WHEN sum(n) = 0 THEN 'zero' WHEN sum(n) / 150.0 <= 0.5 THEN 'up_to_half' WHEN sum(n) / 150.0 < 1 THEN 'over_half' ELSE 'full' END AS band FROM e GROUP BY 1"""
)
def merged_interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import coverage_band

    s = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 100).alias("start"), (F.col("l_partkey") % 100 + F.col("l_quantity").cast("long")).alias("stop"))
    return intervals.merged_length(s, "l_orderkey").withColumn("band", coverage_band(F.col("covered") / 150.0))


def placed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in documents of fifty."""
    return read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("doc"), F.col("vec_id").alias("place"), "embedding")


BOUNDARY_SQL = """d AS (SELECT vec_id // 50 AS doc, vec_id AS place, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
f AS (SELECT doc, place, dim, avg(x) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l, avg(x) OVER (o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS r FROM d WINDOW o AS (PARTITION BY doc, dim ORDER BY place)),
sc AS (SELECT doc, place, sum(l * r) / sqrt(sum(l * l) * sum(r * r)) AS score FROM f WHERE l IS NOT NULL GROUP BY ALL)"""


@R.add(f"WITH {BOUNDARY_SQL} SELECT doc, place, round(score, 6) AS score FROM sc")
def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.boundary_scores(placed_vectors(spark, sf_dir), 3).withColumn("score", F.round("score", 6))


GROUPS_SQL = f"""{BOUNDARY_SQL}, l AS (SELECT doc, quantile_cont(score, 0.3) AS lim FROM sc GROUP BY 1), c AS (SELECT doc, place, (round(score, 9) < round(lim, 9))::INT AS cut FROM sc JOIN l USING (doc)),
g AS (SELECT doc, place, CAST(sum(coalesce(cut, 0)) OVER (PARTITION BY doc ORDER BY place) AS BIGINT) AS group_no FROM (SELECT vec_id // 50 AS doc, vec_id AS place FROM embeddings) p LEFT JOIN c USING (doc, place))"""


@R.add(f"WITH {GROUPS_SQL} SELECT doc, place, group_no FROM g")
def percentile_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = placed_vectors(spark, sf_dir)
    return segments.groups_from_breaks(places.select("doc", "place"), segments.boundary_scores(places, 3), 0.3)


@R.add()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of percentile breakpoints, merged and split to between 60 and 200 tokens, with their size.

    A vector stands for the text of its number. Texts of more than 200 tokens are cut
    into near-equal pieces first, which share the text's vector.
    """
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r]+"), F.lit(0))).cast("long")
    # Counted in a step of its own: within the pieces' expression every piece would count its text's tokens again.
    counted = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), size.alias("n"))
    texts = counted.select("place", F.posexplode(intervals.even_pieces(F.col("n"), 200)).alias("piece", "p"))
    pieces = texts.select("place", "piece", (F.col("p.last") - F.col("p.first")).alias("tokens"))
    places = placed_vectors(spark, sf_dir).join(pieces, "place", "left").fillna({"piece": 0, "tokens": 0})
    places = places.withColumn("place", F.col("place") * 1_000_000 + F.col("piece"))
    return segments.sized_groups(places, 3, 0.3, 60, 200)


SENTENCE = r"[^.!?\n]+[.!?]*"


@R.add(
    f"""WITH s AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '{SENTENCE}'))) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars, count(CASE WHEN NOT regexp_matches(s, '[.!?]$') AND len(string_split(s, ' ')) <= 8 THEN 1 END) AS n_fragments FROM s WHERE s <> '' GROUP BY 1"""
)
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-cut sentences; a fragment has at most eight words and no closing mark."""
    s = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(SENTENCE), 0)).alias("s")).select("doc_id", F.trim("s").alias("s")).where("s <> ''")
    fragment = ~F.col("s").rlike("[.!?]$") & (F.size(F.split("s", " ")) <= 8)
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"), F.count_if(fragment).alias("n_fragments"))


@R.add(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id, round(coalesce(list_inner_product(a.e, b.e) / nullif(sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)), 0), 0), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1"""
)
def neighbour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(vectors.cosine("embedding", "after"), 6).alias("similarity"))


QUERIES, ORACLE_SQL = R.queries, R.sql
