"""Normalisation, resolution, coverage, design checks and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals, ordering, segments, stats, vectors
from . import chunking, retrieval
from .registry import Registry, read

R = Registry()


@R.add(
    """SELECT o_orderkey, regexp_extract(replace(concat(o_orderkey % 90, ' (', o_orderstatus, ') .2'), ' ', ''), '^[^.(]+') AS number, regexp_matches(sha1(o_orderpriority), '^[0-9a-f]{40}$') AS is_commit,
 greatest(0.0, least(1.0, o_totalprice / 200000)) AS bounded, CASE WHEN o_totalprice / 500000 < 0.5 THEN 'low' WHEN o_totalprice / 500000 < 0.8 THEN 'mid' ELSE 'high' END AS band,
 CAST((o_orderkey + o_custkey) // 2 AS BIGINT) AS center, CASE WHEN o_custkey % 40 < 20 THEN 'exploratory' ELSE 'confirmatory' END AS power_decision FROM orders"""
)
def scalar_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(" ("), "o_orderstatus", F.lit(") .2"))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.regexp_extract(F.regexp_replace(raw, r"\s+", ""), r"^[^.(]+", 0).alias("number"), F.sha1(F.col("o_orderpriority").cast("binary")).rlike("^[0-9a-f]{40}$").alias("is_commit"),
        T.bounded(F.col("o_totalprice") / 200000).alias("bounded"), T.band(F.least(F.lit(1.0), F.col("o_totalprice") / 500000)).alias("band"),
        F.expr("(o_orderkey + o_custkey) div 2").alias("center"), F.when(F.col("o_custkey") % 40 < 20, "exploratory").otherwise("confirmatory").alias("power_decision"),
    )


@R.add(
    """WITH known AS (SELECT DISTINCT p_size::BIGINT AS unit FROM part), r AS (SELECT p_partkey, p_size::BIGINT AS a, p_size + p_partkey % 60 AS b FROM part),
e AS (SELECT p_partkey, unnest(CASE WHEN b - a <= 50 THEN generate_series(a, b) ELSE [a, b] END) AS unit, b - a <= 50 AS expanded FROM r)
SELECT p_partkey, expanded, count(DISTINCT unit) AS n_targets, min(unit) AS first_target, max(unit) AS last_target FROM e SEMI JOIN known USING (unit) GROUP BY ALL"""
)
def range_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ranges of up to fifty as their members, longer ones as their ends; only units that exist.

    What ranges of one key share counts in the first of them, so each range stands for
    a span of its own; units are looked up once for equal spans, not for every row.
    """
    known = read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("unit")).distinct()
    r = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("a"), (F.col("p_size") + F.col("p_partkey") % 60).cast("long").alias("b"))
    short = F.col("b") - F.col("a") <= 50
    span = lambda lo, hi: F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    spans = r.select("p_partkey", short.alias("expanded"), F.explode(F.when(short, F.array(span("a", "b"))).otherwise(F.array(span("a", "a"), span("b", "b")))).alias("s")).select("p_partkey", "expanded", "s.*")
    reach = F.max("hi").over(W.partitionBy("p_partkey", "expanded").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1))
    own = spans.withColumn("lo", F.greatest("lo", reach + 1)).where("lo <= hi")
    units = own.select("lo", "hi").distinct().withColumn("unit", F.explode(F.sequence("lo", "hi"))).join(known, "unit", "left_semi")
    met = units.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("first"), F.max("unit").alias("last"))
    return own.join(met, ["lo", "hi"]).groupBy("p_partkey", "expanded").agg(F.sum("n").alias("n_targets"), F.min("first").alias("first_target"), F.max("last").alias("last_target"))


@R.add(
    """WITH u AS (SELECT DISTINCT label % 6 AS doc, vec_id // 7 AS unit FROM embeddings), one AS (SELECT unit, min(doc) AS doc FROM u GROUP BY 1 HAVING count(*) = 1)
SELECT p_partkey, p_size::BIGINT AS number, one.doc AS document_code, CASE WHEN one.doc IS NOT NULL THEN concat(one.doc, ' Art. ', p_size) END AS unit_id FROM part LEFT JOIN one ON one.unit = p_size"""
)
def citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A citation without a document gets the only document that has its unit, or none."""
    u = read(spark, sf_dir, "embeddings").select((F.col("label") % 6).alias("doc"), F.expr("vec_id div 7").alias("unit")).distinct()
    one = u.groupBy("unit").agg(F.min("doc").alias("document_code"), F.count(F.lit(1)).alias("m")).where("m = 1").select(F.col("unit").alias("number"), "document_code")
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("number"))
    unit = F.when(F.col("document_code").isNotNull(), F.concat(F.col("document_code").cast("string"), F.lit(" Art. "), F.col("number").cast("string")))
    return p.join(one, "number", "left").select("p_partkey", "number", "document_code", unit.alias("unit_id"))


@R.add("SELECT conv_id, concat('q_', lpad(row_number() OVER (ORDER BY conv_id)::VARCHAR, 6, '0')) AS query_id, count(*) AS n_turns, count(*) > 4 AS is_long FROM conversations GROUP BY conv_id")
def built_query_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    return ordering.numbered(c, "conv_id").select("conv_id", F.concat(F.lit("q_"), F.lpad(F.col("row").cast("string"), 6, "0")).alias("query_id"), "n_turns", (F.col("n_turns") > 4).alias("is_long"))


@R.add("SELECT user_id, count(DISTINCT event_type) AS n_conditions, count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events) AS complete, count(*) AS n FROM events GROUP BY 1")
def paired_set_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    total = e.agg(F.count_distinct("event_type")).first()[0]
    per = e.groupBy("user_id").agg(F.count_distinct("event_type").alias("n_conditions"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("complete", F.col("n_conditions") == total)


@R.add(
    """SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS "view", round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase FROM events GROUP BY 1
HAVING count(DISTINCT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type END) = 3"""
)
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.round(F.avg("value"), 6))
    return p.dropna()


@R.add(
    f"""WITH {chunking.WINDOWS_SQL}, s AS (SELECT source, count(*) AS n_chunks, avg(token_end - token_start) AS mean_tokens FROM ch GROUP BY 1), q AS (SELECT source, avg(quality) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, n_chunks, round(mean_tokens, 6) AS mean_tokens, round(quality, 6) AS quality FROM s JOIN q USING (source)"""
)
def quality_by_chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = chunking.windowed(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(F.col("token_end") - F.col("token_start")), 6).alias("mean_tokens"))
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    return s.join(d.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("quality")), "source")


def unit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each unit that included windows of 500 characters, 800 apart, hold."""
    o = intervals.block_offsets(read(spark, sf_dir, "documents"), "text", "doc_id")
    met = o.select("doc_id", "block_no", "start", "stop", F.explode_outer(intervals.overlapping_windows("start", "stop", 500, 800)).alias("w"))
    part = F.greatest(F.lit(0), F.least(F.col("stop"), F.col("w") * 800 + 500) - F.greatest(F.col("start"), F.col("w") * 800))
    return met.groupBy("doc_id", "block_no", "start", "stop").agg((F.coalesce(F.sum(part), F.lit(0)) / (F.col("stop") - F.col("start"))).alias("share"))


UNIT_COVERAGE_SQL = f"""{chunking.BLOCKS_SQL}, sp AS (SELECT doc_id, block_no, start, start + length(block) AS stop FROM o),
cov AS (SELECT doc_id, block_no, list_sum([greatest(0, least(stop, w * 800 + 500) - greatest(start, w * 800)) FOR w IN generate_series(start // 800, stop // 800)]) / (stop - start) AS share FROM sp)"""


@R.add(f"WITH {UNIT_COVERAGE_SQL} SELECT doc_id, count(*) AS n_units, round(avg(share), 6) AS coverage FROM cov GROUP BY 1")
def gold_span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_coverage(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.round(F.avg("share"), 6).alias("coverage"))


BANDS_SQL = "CASE WHEN coverage = 0 THEN 'zero' WHEN coverage <= 0.5 THEN 'up_to_half' WHEN coverage < 1 THEN 'over_half' ELSE 'full' END"


@R.add(
    f"""WITH {UNIT_COVERAGE_SQL}, p AS (SELECT doc_id, round(avg(share), 6) AS coverage FROM cov GROUP BY 1), j AS (SELECT coverage, quality::DOUBLE AS q FROM p JOIN labels USING (doc_id)),
r AS (SELECT rank() OVER (ORDER BY coverage) + (count(*) OVER (PARTITION BY coverage) - 1) / 2 AS rx, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 AS ry FROM j)
SELECT {BANDS_SQL} AS band, count(*) AS n, round(avg(q), 6) AS value FROM j GROUP BY 1 UNION ALL SELECT 'spearman_all', count(*), round(corr(rx, ry), 6) FROM r"""
)
def coverage_band_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = gold_span_coverage(spark, sf_dir).select("doc_id", "coverage")
    j = p.join(read(spark, sf_dir, "labels"), "doc_id").select("coverage", F.col("quality").cast("double").alias("q"), F.lit("spearman_all").alias("band"))
    bands = j.groupBy(T.coverage_band(F.col("coverage")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("q"), 6).alias("value"))
    return bands.unionByName(stats.spearman(j, "coverage", "q", "band").select("band", "n", F.round("rho", 6).alias("value")))


@R.add(
    """WITH m AS (SELECT source, median(n_chars) AS mid FROM documents GROUP BY 1)
SELECT source, doc_id, n_chars FROM documents JOIN m USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, abs(n_chars - mid), doc_id) = 1"""
)
def anchor_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the document nearest the median length, English ones before others."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "lang")
    m = d.groupBy("source").agg(F.median("n_chars").alias("mid"))
    rank = F.struct(F.when(F.col("lang") == "en", 0).otherwise(1), F.abs(F.col("n_chars") - F.col("mid")), "doc_id")
    best = d.join(m, "source").groupBy("source").agg(F.min_by(F.struct("doc_id", "n_chars"), rank).alias("b"))
    return best.select("source", "b.doc_id", "b.n_chars")


@R.add("SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY md5(concat('7|', doc_id)), doc_id) AS INTEGER) AS place FROM documents")
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffled place per source. Digests are dealt by their first two digits, so a source with most rows is ordered in 256 parts."""
    digest = F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string")))
    d = read(spark, sf_dir, "documents").select("source", "doc_id", digest.alias("h")).withColumn("part", F.substring("h", 1, 2))
    before = F.sum("m").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = d.groupBy("source", "part").agg(F.count(F.lit(1)).alias("m")).select("source", "part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("source", "part").orderBy("h", "doc_id"))
    return d.withColumn("inside", inside).join(starts, ["source", "part"]).select("source", "doc_id", (F.col("start") + F.col("inside")).cast("int").alias("place"))


@R.add(
    """WITH l AS (SELECT l_returnflag AS strategy, unnest(['quantity', 'price', 'discount']) AS measure, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM lineitem)
SELECT strategy, measure, count(*) AS n, round(sum(v), 2) AS total, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_cont(v, 0.95), 6) AS p95, min(v) AS lowest, max(v) AS highest FROM l GROUP BY ALL"""
)
def strategy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("strategy"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    long = r.unpivot("strategy", ["quantity", "price", "discount"], "measure", "v")
    q = long.groupBy("strategy", "measure").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("lowest"), F.max("v").alias("highest"))
    q = ordering.beside(q, ordering.quantiles(long, "v", {"median": 0.5, "p95": 0.95}, "strategy", "measure"), "strategy", "measure", how="left")
    return q.select("strategy", "measure", "n", "total", "mean", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "lowest", "highest")


@R.add(
    """WITH stored AS (SELECT doc_id, sha256(CASE WHEN quality = 0 THEN upper(text) ELSE text END) AS h FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN s.h IS NULL THEN 'missing' WHEN s.h <> sha256(text) THEN 'stale' ELSE 'current' END AS state FROM documents LEFT JOIN stored s USING (doc_id)"""
)
def staleness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against stored digests (here: labelled ones, those of low quality changed)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    stored = F.when(F.col("quality").isNotNull(), F.sha2(F.when(F.col("quality") == 0, F.upper("text")).otherwise(F.col("text")), 256))
    return d.select("doc_id", F.when(stored.isNull(), "missing").when(stored != F.sha2("text", 256), "stale").otherwise("current").alias("state"))


@R.add(
    """WITH r AS (SELECT doc_id, (quality * 7 + toxic) / 20.0 AS score, CASE WHEN quality = 1 THEN 'agree' WHEN toxic = 1 THEN 'unsure' ELSE 'bad' END AS choice FROM labels)
SELECT doc_id, round(score, 6)::DOUBLE AS score, abs(score * 10 - round(score * 10)) < 1e-9 AND choice IN ('agree', 'unsure') AS valid FROM r"""
)
def review_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on a grid of tenths and choices from a fixed list."""
    r = read(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") * 7 + F.col("toxic")) / 20.0).alias("score"), F.when(F.col("quality") == 1, "agree").when(F.col("toxic") == 1, "unsure").otherwise("bad").alias("choice"))
    on_grid = F.abs(F.col("score") * 10 - F.round(F.col("score") * 10)) < 1e-9
    return r.select("doc_id", F.round("score", 6).alias("score"), (on_grid & F.col("choice").isin("agree", "unsure")).alias("valid"))


@R.add(
    f"""WITH {chunking.BOUNDARY_SQL}, b AS (SELECT e.vec_id AS place, e.label <> p.label AS at_unit FROM embeddings e JOIN embeddings p ON p.vec_id = e.vec_id - 1)
SELECT at_unit, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.3), 6) AS threshold FROM sc JOIN b USING (place) GROUP BY 1"""
)
def boundary_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary scores where a unit begins and elsewhere."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    before = e.select((F.col("vec_id") + 1).alias("place"), F.col("label").alias("before"))
    starts = e.join(before, F.col("vec_id") == F.col("place")).select("place", (F.col("label") != F.col("before")).alias("at_unit"))
    scores = segments.boundary_scores(chunking.placed_vectors(spark, sf_dir), 3)
    met = scores.join(starts, "place")
    means = met.groupBy("at_unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))
    return ordering.beside(means, ordering.quantiles(met, "score", {"t": 0.3}, "at_unit"), "at_unit", how="left").select("at_unit", "n", "mean", F.round("t", 6).alias("threshold"))


@R.add(
    f"""WITH {retrieval.ranked_sql()}, {retrieval.GOLD_SQL}, e AS (SELECT DISTINCT vec_id // 2 AS source, label AS target FROM embeddings),
f AS (SELECT DISTINCT r.query_id, g.unit FROM ranked r JOIN e ON e.source = r.unit JOIN gold g ON g.query_id = r.query_id AND g.unit = e.target)
SELECT query_id, count(f.unit) AS n_reached, count(DISTINCT gold.unit) >= 2 AND count(f.unit) >= 1 AS eligible FROM gold LEFT JOIN f USING (query_id, unit) GROUP BY 1"""
)
def retrieval_conditioned_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of two or more gold units, one of which a retrieved chunk's citation reaches."""
    edges = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("unit"), F.col("label").cast("long").alias("target")).distinct()
    reached = retrieval.with_unit(retrieval.search(spark, sf_dir)).join(edges, "unit").select("query_id", F.col("target").alias("unit")).distinct().withColumn("hit", F.lit(1))
    g = retrieval.gold(spark, sf_dir).join(reached, ["query_id", "unit"], "left").groupBy("query_id").agg(F.count("hit").alias("n_reached"), F.count(F.lit(1)).alias("n"))
    return g.select("query_id", "n_reached", ((F.col("n") >= 2) & (F.col("n_reached") >= 1)).alias("eligible"))


@R.add(
    """SELECT lang, source, CASE WHEN grouping(lang) + grouping(source) = 2 THEN 'macro' WHEN grouping(source) = 1 THEN 'lang' ELSE 'source' END AS level, count(*) AS n, round(avg(n_chars), 6) AS mean, CAST(min(n_chars) AS BIGINT) AS lowest, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.95) AS p95, CAST(max(n_chars) AS BIGINT) AS highest
FROM documents GROUP BY GROUPING SETS ((), (lang), (source))"""
)
def context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("lang", "source", "n_chars")
    none = F.lit(None).cast("string")
    levels = [F.struct(F.lit(n).alias("level"), a.alias("lang"), b.alias("source")) for n, a, b in (("macro", none, none), ("lang", F.col("lang"), none), ("source", none, F.col("source")))]
    each, keys = d.select(F.explode(F.array(*levels)).alias("g"), "n_chars").select("g.*", "n_chars"), ("level", "lang", "source")
    q = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.min("n_chars").alias("lowest"), F.max("n_chars").alias("highest"))
    return ordering.beside(q, ordering.quantiles(each, "n_chars", {"median": 0.5, "p95": 0.95}, *keys), *keys, how="left").select("lang", "source", "level", "n", "mean", "lowest", "median", "p95", "highest")


@R.add(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l FROM v)
SELECT vec_id, list_max([abs(x - x / l) FOR x IN e]) < 1e-6 AS is_unit FROM n"""
)
def index_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether stored vectors equal their normalised form to a millionth."""
    n = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", vectors.normalized("embedding").alias("u"))
    return n.select("vec_id", (F.expr("array_max(zip_with(embedding, u, (a, b) -> abs(cast(a AS double) - b)))") < 1e-6).alias("is_unit"))


QUERIES, ORACLE_SQL = R.queries, R.sql
