"""Chunk builders over real texts: sentences with their places, units they overlap, and hierarchical chunks with their context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals, models, packing, segments, semantic, tokens
from .registry import Registry, read

R = Registry()
SENTENCE = r"[^\s.!?][^\n.!?]*[.!?]*"
MOST = 12


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.match_spans(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", SENTENCE, "doc_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units: the non-empty lines of a text, where they stand in it."""
    return intervals.match_spans(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", r"[^\n]+", "doc_id").select("doc_id", F.col("place").alias("unit"), "start", "stop")


def spans_sql(name: str, pattern: str) -> str:
    return f"""{name}_r AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gs FROM documents WHERE text IS NOT NULL),
{name}_e AS (SELECT doc_id, unnest(ms) AS raw, unnest(gs[1:len(ms)]) AS gap, generate_subscripts(ms, 1) - 1 AS place FROM {name}_r),
{name}_p AS (SELECT *, coalesce(sum(length(raw) + length(gap)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS start, regexp_replace(raw, '\\s+$', '') AS t FROM {name}_e),
{name} AS (SELECT doc_id, place, t AS raw, start::BIGINT AS start, (start + length(t))::BIGINT AS stop FROM {name}_p)"""


@R.add(f"WITH {spans_sql('s', SENTENCE)} SELECT doc_id, place::INT AS place, start, stop, sha256(raw) AS text_sha256 FROM s")
def sentence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the whole texts with their half-open places."""
    return sentences(spark, sf_dir).select("doc_id", "place", "start", "stop", F.sha2("raw", 256).alias("text_sha256"))


@R.add(
    f"""WITH {spans_sql('s', SENTENCE)}, {spans_sql('u', '[^' + chr(92) + 'n]+')}
SELECT s.doc_id, s.place::INT AS place, count(*) AS n_units, min(u.place)::INT AS first_unit, max(u.place)::INT AS last_unit, sum(least(s.stop, u.stop) - greatest(s.start, u.start))::BIGINT AS n_chars
FROM s JOIN u ON s.doc_id = u.doc_id AND s.start < u.stop AND u.start < s.stop GROUP BY ALL"""
)
def chunk_unit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of any lengths against units of any lengths: the units that each sentence overlaps."""
    pairs = intervals.overlapping(sentences(spark, sf_dir).select("doc_id", "place", "start", "stop"), lines(spark, sf_dir), "doc_id")
    shared = F.least("stop", "other_stop") - F.greatest("start", "other_start")
    return pairs.groupBy("doc_id", "place").agg(F.count(F.lit(1)).alias("n_units"), F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"), F.sum(shared).alias("n_chars"))


@R.add(
    f"""WITH {spans_sql('s', SENTENCE)}, w AS (SELECT doc_id, place, regexp_extract_all(raw, '[^ \\t\\n\\r]+') AS ws FROM s), n AS (SELECT *, len(ws) AS c, greatest(CEIL(len(ws) / {MOST}.0)::BIGINT, 1) AS n FROM w),
p AS (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM n), b AS (SELECT *, i * (c // n) + least(i, c % n) AS first, (i + 1) * (c // n) + least(i + 1, c % n) AS last FROM p)
SELECT doc_id, place::INT AS place, i::BIGINT AS piece, (last - first)::BIGINT AS n_tokens, sha256(array_to_string(ws[first + 1:last], ' ')) AS text_sha256 FROM b WHERE c > {MOST}"""
)
def oversize_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of more tokens than a chunk may have, cut into near-equal pieces."""
    words = F.regexp_extract_all("raw", F.lit(r"[^ \t\n\r]+"), F.lit(0))
    rows = sentences(spark, sf_dir).select("doc_id", "place", words.alias("ws")).where(F.size("ws") > MOST)
    pieces = rows.select("doc_id", "place", "ws", F.posexplode(intervals.even_pieces(F.size("ws").cast("long"), MOST)).alias("piece", "p"))
    size = F.col("p.last") - F.col("p.first")
    text = F.array_join(F.slice("ws", (F.col("p.first") + 1).cast("int"), size.cast("int")), " ")
    return pieces.select("doc_id", "place", F.col("piece").cast("long").alias("piece"), size.alias("n_tokens"), F.sha2(text, 256).alias("text_sha256"))


@R.add()
def merged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences after fragments joined a neighbour of the same unit."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return segments.document_sentences(docs, lines(spark, sf_dir).withColumnRenamed("doc_id", "doc"), SENTENCE).select("doc", "start", "stop", "units")


@R.add()
def merged_small_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile groups of which none stays under 60 tokens unless it is alone; tokens are those of the texts."""
    from . import chunking

    places = chunking.placed_vectors(spark, sf_dir)
    scores = segments.boundary_scores(places, 3)
    grouped = segments.groups_from_breaks(places.select("doc", "place"), scores, 0.3).join(scores, ["doc", "place"], "left")
    tokens = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r]+"), F.lit(0))).alias("tokens"))
    return segments.merge_small(grouped.join(tokens, "place", "left").fillna({"tokens": 0}), 60)


#: Two acts: nations are articles, customers their paragraphs and regions the chapters; suppliers are recitals.
@R.add(
    r"""WITH c AS (SELECT 'paragraph' AS level, c_nationkey AS n, c_custkey AS k, c_name AS name FROM customer WHERE c_nationkey % 3 <> 0),
l AS (SELECT level, concat('T Art. ', n, '.', k) AS unit, concat('hier_article_T_Art_', n) AS parent, concat_ws(' > ', concat('T Chap. ', r_regionkey, ': ', r_name), concat('T Art. ', n, ': ', n_name), concat('T Art. ', n, '.', k)) AS crumbs, name AS text FROM c JOIN nation ON n_nationkey = n JOIN region ON r_regionkey = n_regionkey
 UNION ALL SELECT 'article', concat('T Art. ', n_nationkey), NULL, concat_ws(' > ', concat('T Chap. ', r_regionkey, ': ', r_name), concat('T Art. ', n_nationkey, ': ', n_name)), n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey NOT IN (SELECT n FROM c)
 UNION ALL SELECT 'recital', concat('T Rec. ', s_suppkey), NULL, concat('T Rec. ', s_suppkey), s_name FROM supplier)
SELECT concat('hier_paragraph_', trim(regexp_replace(unit, '[^0-9A-Za-z]+', '_', 'g'), '_')) AS chunk_id, level, unit AS source_unit, CASE WHEN level = 'paragraph' THEN regexp_replace(unit, '\.[0-9]+$', '') ELSE unit END AS answer_unit, parent AS parent_chunk_id, text,
 concat(crumbs, chr(10), chr(10), text) AS embedding_text FROM l"""
)
def hierarchical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a unit tree as chunks: paragraphs, articles without any, and recitals, with parents, answer units and the path as context."""
    n, r, c, s = (read(spark, sf_dir, t) for t in ("nation", "region", "customer", "supplier"))
    chapter = F.concat(F.lit("T Chap. "), "r_regionkey", F.lit(": "), "r_name")
    article = F.concat(F.lit("T Art. "), "n_nationkey")
    articles = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", article.alias("article"), F.col("n_name").alias("title"), F.concat_ws(" > ", chapter, F.concat(article, F.lit(": "), "n_name")).alias("path"))
    children = c.where("c_nationkey % 3 <> 0").select("c_nationkey", "c_custkey", "c_name")
    own = F.concat_ws(".", "article", "c_custkey")
    paragraphs = children.join(articles, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("paragraph").alias("level"), own.alias("unit"), F.col("article").alias("answer_unit"), F.concat_ws(" > ", "path", own).alias("path"), F.col("c_name").alias("text"))
    alone = articles.join(children, F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").select(F.lit("article").alias("level"), F.col("article").alias("unit"), F.col("article").alias("answer_unit"), "path", F.col("title").alias("text"))
    label = F.concat(F.lit("T Rec. "), "s_suppkey")
    recitals = s.select(F.lit("recital").alias("level"), label.alias("unit"), label.alias("answer_unit"), label.alias("path"), F.col("s_name").alias("text"))
    every = paragraphs.unionByName(alone).unionByName(recitals)
    parent = F.when(F.col("level") == "paragraph", T.chunk_id(F.lit("hier_article"), F.col("answer_unit")))
    return every.select(T.chunk_id(F.lit("hier_paragraph"), F.col("unit")).alias("chunk_id"), "level", F.col("unit").alias("source_unit"), "answer_unit", parent.alias("parent_chunk_id"), "text", F.concat("path", F.lit("\n\n"), "text").alias("embedding_text"))


def byte_bpe() -> tokens.Maker:
    import public_tokenizers

    return tokens.FromFile(public_tokenizers.path("byte_bpe_50k.json"))


@R.add()
def bpe_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 256 byte-pair tokens, 206 apart, with the characters they cover."""
    return tokens.windows(read(spark, sf_dir, "documents"), byte_bpe(), 256, 206, "doc_id")


@R.add()
def semantic_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole documents cut where the vectors of sentences turn; units are lines, tokens are words."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    units = lines(spark, sf_dir).withColumnRenamed("doc_id", "doc")
    return semantic.chunks(docs, units, models.hash_embedder(), tokens.Words(), percentile=0.3, least=60, most=200, pattern=SENTENCE)


#: Conditions of the packed contexts: name -> budget, target and least number of passages.
PACKED: dict[str, tuple[int | None, int | None, int]] = {"capped": (1500, None, 0), "matched": (None, 1000, 2)}
POOL, TOLERANCE = 50, 0.1


@R.add(
    f"""WITH RECURSIVE b AS (SELECT source, doc_id, concat('Reference: ', doc_id, chr(10), 'Document: ', lang, chr(10), 'Answer unit: ', doc_id // 2, chr(10), text) AS body FROM documents WHERE text IS NOT NULL),
c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, 1 + len(regexp_extract_all(body, '[^ \t\n\r]+')) AS w FROM b QUALIFY n <= {POOL}),
conds(condition, budget, target, least) AS (VALUES {", ".join(f"('{n}', {b or 'NULL::INT'}, {t or 'NULL::INT'}, {m})" for n, (b, t, m) in PACKED.items())}),
p AS (SELECT condition, source, budget, target, least, 0 AS n, 0::BIGINT AS size, 0 AS k, '' AS taken, '' AS left_out, false AS done FROM conds, (SELECT DISTINCT source FROM c) s
 UNION ALL
 SELECT condition, source, budget, target, least, n + 1, CASE WHEN act = 'take' THEN size + w ELSE size END, k + (act = 'take')::INT, CASE WHEN act = 'take' THEN concat(taken, CASE WHEN taken = '' THEN '' ELSE ';' END, doc_id) ELSE taken END,
  CASE WHEN act = 'take' THEN left_out ELSE concat(left_out, CASE WHEN left_out = '' THEN '' ELSE ';' END, doc_id, ':', act) END, act = '{packing.CLOSER}' OR (act = 'take' AND target IS NOT NULL AND k + 1 >= least AND size + w >= target)
 FROM (SELECT p.*, c.w, c.doc_id, CASE WHEN budget IS NOT NULL AND size + w > budget THEN '{packing.OVER}' WHEN target IS NOT NULL AND k >= least AND size + w >= target AND abs(size - target) < abs(size + w - target) THEN '{packing.CLOSER}' ELSE 'take' END AS act
   FROM p JOIN c ON c.source = p.source AND c.n = p.n + 1 WHERE NOT done) q),
e AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY condition, source ORDER BY n DESC) = 1)
SELECT condition, source, size AS n_tokens, taken AS included, left_out AS excluded, size - target AS volume_delta, round(abs(size - target) / target, 6) AS volume_error, abs(size - target) / target <= {TOLERANCE} AS volume_met FROM e"""
)
def assembled_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of a source's first documents: under a budget of tokens, and matched to a volume."""
    d = read(spark, sf_dir, "documents").where("text is not null").withColumn("place", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where(F.col("place") <= POOL)
    body = packing.body(F.array(F.col("doc_id").cast("string")), F.col("lang"), F.array(F.expr("doc_id div 2").cast("string")), F.col("text"))
    rows = d.select("source", "place", F.col("doc_id").alias("chunk_id"), body.alias("body"))
    out = None
    for name, (budget, target, least) in PACKED.items():
        targets = None if target is None else rows.select("source", F.lit(target).alias("target")).distinct()
        found = packing.assemble(rows, tokens.Words(), key="source", budget=budget, targets=targets, least=least, tolerance=TOLERANCE)
        excluded = F.array_join(F.transform("excluded", lambda x: F.concat_ws(":", x["chunk_id"], x["reason"])), ";")
        found = found.select(F.lit(name).alias("condition"), "source", "n_tokens", F.array_join("included", ";").alias("included"), excluded.alias("excluded"), "volume_delta", F.round("volume_error", 6).alias("volume_error"), "volume_met")
        out = found if out is None else out.unionByName(found)
    return out


QUERIES, ORACLE_SQL = R.queries, R.sql
