"""Exact search over ``embeddings`` and its scores.

Roles: a vector is a chunk of document ``label % 6`` that answers unit
``vec_id div 2``; every fiftieth vector is also a query, whose gold is the ten least
units that share their label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ordering, ranking, vectors
from .registry import Registry, read

R = Registry()
K = 10
#: Search scopes: name -> the document codes searched (empty: all; None: the query's own).
SCOPES: dict[str, tuple[int, ...] | None] = {"all": (), "fixed": (0, 1, 2), "target": None}


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("label") % 6).alias("document_code"), "embedding", "label")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id").withColumn("allowed", F.lit(None).cast("array<int>"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = chunks(spark, sf_dir).select("label", F.expr("chunk_id div 2").alias("unit")).distinct()
    least = units.withColumn("n", F.row_number().over(W.partitionBy("label").orderBy("unit"))).where("n <= 10")
    return queries(spark, sf_dir).join(least, "label").select("query_id", "unit")


def search(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return vectors.top_k(chunks(spark, sf_dir), queries(spark, sf_dir), k)


def with_unit(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("unit", F.expr("chunk_id div 2"))


def ranked_sql(k: int = K, dims: int = 64) -> str:
    part = f"list_slice(embedding, 1, {dims})::DOUBLE[]"
    return f"""
v AS (SELECT vec_id, label, label % 6 AS doc, vec_id // 2 AS unit, {part} AS e, sqrt(list_inner_product({part}, {part})) AS n FROM embeddings),
ranked AS (SELECT query_id, chunk_id, unit, doc, qdoc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT q.vec_id AS query_id, q.doc AS qdoc, c.vec_id AS chunk_id, c.unit, c.doc, round(list_inner_product(q.e, c.e) / (q.n * c.n), 9) AS score
        FROM v q, v c WHERE q.vec_id % 50 = 0) s QUALIFY rank <= {k})"""


GOLD_SQL = """
gold AS (SELECT q.vec_id AS query_id, u.unit FROM embeddings q
  JOIN (SELECT label, unit, row_number() OVER (PARTITION BY label ORDER BY unit) AS n FROM (SELECT DISTINCT label, vec_id // 2 AS unit FROM embeddings) d) u
  ON u.label = q.label AND u.n <= 10 WHERE q.vec_id % 50 = 0)"""
UNITS_SQL = """
units AS (SELECT query_id, unit, row_number() OVER (PARTITION BY query_id ORDER BY first, unit) AS unit_rank
  FROM (SELECT query_id, unit, min(rank) AS first FROM ranked GROUP BY ALL) f)"""


def metrics_sql(units: str, by: str = "query_id") -> str:
    return f"""
marked AS (SELECT u.*, (g.unit IS NOT NULL)::INT::DOUBLE AS hit, z.n_gold FROM {units} u LEFT JOIN gold g USING (query_id, unit)
  JOIN (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1) z USING (query_id)),
per AS (SELECT {by}, n_gold, count(*) AS n_units, sum(hit) AS hits, sum(CASE WHEN unit_rank <= n_gold THEN hit ELSE 0 END) AS early,
  min(CASE WHEN hit > 0 THEN unit_rank END) AS first, sum(hit / log2(unit_rank + 1)) AS dcg FROM marked GROUP BY {by}, n_gold),
metrics AS (SELECT {by}, n_gold, n_units, hits / n_units AS precision, hits / n_gold AS recall,
  CASE WHEN hits > 0 THEN 2 * (hits / n_units) * (hits / n_gold) / (hits / n_units + hits / n_gold) ELSE 0 END AS f1, early / n_gold AS r_precision,
  coalesce(1.0 / first, 0)::DOUBLE AS mrr, coalesce(dcg / list_sum([1 / log2(x + 1) FOR x IN generate_series(1, least(n_gold, n_units))]), 0) AS ndcg FROM per)"""


ROUND_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in ranking.METRICS)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *(F.round(m, 6).alias(m) for m in ranking.METRICS))


@R.add(f"WITH {ranked_sql()} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked")
def topk_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@R.add(f"WITH {ranked_sql()} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked")
def topk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with queries and chunks both dealt into blocks, as for many queries."""
    found = vectors.top_k(chunks(spark, sf_dir), queries(spark, sf_dir), K, held=0, strip=16)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def scoped(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """Queries by scope; a fixed scope admits only queries whose document it holds. One search serves all scopes: a query in a scope is a query of its own."""
    q = queries(spark, sf_dir)
    each = []
    for number, (scope, codes) in enumerate(SCOPES.items()):
        allowed, admitted = F.lit(None).cast("array<int>"), F.lit(True)
        if codes:
            allowed = F.array(*map(F.lit, codes))
            admitted = F.size(F.array_except(F.array("document_code"), allowed)) == 0
        elif codes is None:
            allowed = F.array("document_code")
        each.append(F.when(admitted, F.struct((F.col("query_id") * len(SCOPES) + number).alias("id"), F.lit(scope).alias("scope"), allowed.cast("array<bigint>").alias("allowed"))))
    asked = q.select("query_id", "embedding", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("s"))
    found = vectors.top_k(chunks(spark, sf_dir), asked.select(F.col("s.id").alias("query_id"), F.col("s.allowed").alias("allowed"), "embedding"), k)
    names = asked.select(F.col("s.id").alias("id"), F.col("query_id").alias("own"), F.col("s.scope").alias("scope"))
    return found.join(names, F.col("query_id") == F.col("id")).select(F.col("own").alias("query_id"), "chunk_id", "score", "rank", "scope")


SCOPED_SQL = """
v AS (SELECT vec_id, label, label % 6 AS doc, vec_id // 2 AS unit, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
scopes(scope) AS (VALUES ('all'), ('fixed'), ('target')),
sranked AS (SELECT scope, query_id, qdoc, chunk_id, unit, score, row_number() OVER (PARTITION BY scope, query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT scope, q.vec_id AS query_id, q.doc AS qdoc, c.vec_id AS chunk_id, c.unit, round(list_inner_product(q.e, c.e) / (q.n * c.n), 9) AS score
        FROM v q, v c, scopes WHERE q.vec_id % 50 = 0 AND CASE scope WHEN 'all' THEN true WHEN 'fixed' THEN q.doc < 3 AND c.doc < 3 ELSE c.doc = q.doc END) s QUALIFY rank <= 10),
sunits AS (SELECT scope, query_id, qdoc, unit, row_number() OVER (PARTITION BY scope, query_id ORDER BY first, unit) AS unit_rank
  FROM (SELECT scope, query_id, qdoc, unit, min(rank) AS first FROM sranked GROUP BY ALL) f)"""


@R.add(f"WITH {SCOPED_SQL} SELECT scope, query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM sranked")
def topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped(spark, sf_dir).select("scope", "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@R.add(f"WITH {ranked_sql(50)}, {ranked_sql(5).replace('v AS', 'v5 AS').replace('FROM v q, v c', 'FROM v5 q, v5 c').replace('ranked AS', 'short AS')} SELECT query_id, bool_and(l.chunk_id = s.chunk_id) AS same_prefix FROM short s JOIN ranked l USING (query_id, rank) GROUP BY 1")
def topk_extended_prefix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(k: int, name: str) -> DataFrame:
        return search(spark, sf_dir, k).groupBy("query_id").agg(F.expr("transform(array_sort(collect_list(struct(rank, chunk_id))), x -> x.chunk_id)").alias(name))

    return listed(50, "extended").join(listed(5, "base"), "query_id").select("query_id", (F.slice("extended", 1, 5) == F.col("base")).alias("same_prefix"))


@R.add(f"WITH {ranked_sql()}, {UNITS_SQL} SELECT query_id, unit, CAST(unit_rank AS INTEGER) AS unit_rank FROM units")
def ranked_answer_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked_units(with_unit(search(spark, sf_dir)), "query_id")


def query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ir_metrics(ranking.ranked_units(with_unit(search(spark, sf_dir)), "query_id"), gold(spark, sf_dir), "query_id")


PER_QUERY_SQL = f"WITH {ranked_sql()}, {GOLD_SQL}, {UNITS_SQL}, {metrics_sql('units')}"


@R.add(f"{PER_QUERY_SQL} SELECT query_id, n_gold, n_units, {ROUND_METRICS} FROM metrics")
def ir_metrics_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(query_metrics(spark, sf_dir), "query_id", "n_gold", "n_units")


@R.add(f"{PER_QUERY_SQL} SELECT count(*) AS n_queries, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ranking.METRICS) + " FROM metrics")
def ir_metrics_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_metrics(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(m), 6).alias(m) for m in ranking.METRICS))


@R.add(
    f"""WITH {ranked_sql()}, {GOLD_SQL},
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, unit) AS place FROM ranked QUALIFY place <= 5),
m AS (SELECT g.*, (o.unit IS NOT NULL)::INT::DOUBLE AS hit, n_gold FROM g LEFT JOIN gold o USING (query_id, unit) JOIN (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1) z USING (query_id)),
p AS (SELECT query_id, n_gold, count(*) AS n, sum(hit) AS hits, count(DISTINCT CASE WHEN hit > 0 THEN unit END) AS dh, sum(hit / log2(place + 1)) AS dcg FROM m GROUP BY ALL),
s AS (SELECT *, dh / least(5, n_gold) AS pr, hits / least(5, n) AS re FROM p)
SELECT query_id, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1,
 round(coalesce(dcg / list_sum([1 / log2(x + 1) FOR x IN generate_series(1, hits::BIGINT)]), 0), 6) AS ndcg FROM s"""
)
def ir_metrics_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.modified_metrics(with_unit(search(spark, sf_dir)), gold(spark, sf_dir), 5, "query_id")
    return found.select("query_id", *(F.round(m, 6).alias(m) for m in ("precision", "recall", "f1", "ndcg")))


@R.add(
    f"""WITH {SCOPED_SQL}, {GOLD_SQL}, {metrics_sql('sunits', 'scope, query_id, qdoc')}
SELECT scope, qdoc AS document_code, CASE WHEN grouping(scope) = 1 THEN 'overall' WHEN grouping(qdoc) = 1 THEN 'scope' ELSE 'document' END AS level, count(*) AS n_queries,
{", ".join(f"round(avg({m}), 6) AS {m}" for m in ranking.METRICS)} FROM metrics GROUP BY GROUPING SETS ((), (scope), (scope, qdoc))"""
)
def retrieval_summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries(spark, sf_dir).select("query_id", "document_code")
    units = ranking.ranked_units(with_unit(scoped(spark, sf_dir)), "scope", "query_id")
    scored = ranking.ir_metrics(units, gold(spark, sf_dir), "scope", "query_id").join(docs, "query_id")
    scope, document = F.col("scope"), F.col("document_code")
    grouped = scored.groupingSets([[], [scope], [scope, document]], scope, document)
    level = F.when(F.grouping("scope") == 1, "overall").when(F.grouping("document_code") == 1, "scope").otherwise("document")
    means = [F.round(F.avg(m), 6).alias(m) for m in ranking.METRICS]
    return grouped.agg(level.alias("level"), F.count(F.lit(1)).alias("n_queries"), *means)


ZERO_SQL = f"""z AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1), kept AS (SELECT * FROM units WHERE query_id % 100 = 0),
{metrics_sql('kept')}
SELECT z.query_id, z.n_gold, coalesce(n_units, 0) AS n_units, {", ".join(f"round(coalesce({m}, 0), 6) AS {m}" for m in ranking.METRICS)} FROM z LEFT JOIN metrics USING (query_id)"""


@R.add(f"WITH {ranked_sql()}, {GOLD_SQL}, {UNITS_SQL}, {ZERO_SQL}")
def ir_metrics_zero_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics where half of the queries retrieved nothing: they score 0 and are not left out."""
    units = ranking.ranked_units(with_unit(search(spark, sf_dir)), "query_id").where("query_id % 100 = 0")
    return rounded(ranking.ir_metrics(units, gold(spark, sf_dir), "query_id"), "query_id", "n_gold", "n_units")


KS = (1, 5, 10)


@R.add(
    f"""WITH {SCOPED_SQL}, {GOLD_SQL},
kranked AS (SELECT k, s.* FROM sranked s, (VALUES (1), (5), (10)) t(k) WHERE rank <= k),
kunits AS (SELECT scope, k, query_id, qdoc, unit, row_number() OVER (PARTITION BY scope, k, query_id ORDER BY first, unit) AS unit_rank FROM (SELECT scope, k, query_id, qdoc, unit, min(rank) AS first FROM kranked GROUP BY ALL) f),
{metrics_sql('kunits', 'scope, k, query_id, qdoc')},
t AS (SELECT m.*, label % 3 AS specificity, value / 1000 AS seconds FROM metrics m JOIN embeddings ON vec_id = query_id LEFT JOIN (SELECT event_id, value FROM events) e ON event_id = query_id AND query_id % 200 <> 0)
SELECT scope, k, specificity::BIGINT AS specificity, qdoc::BIGINT AS document_code, CASE WHEN grouping(specificity) = 0 THEN 'specificity' WHEN grouping(qdoc) = 0 THEN 'document' ELSE 'macro' END AS level, count(*) AS n_queries,
{", ".join(f"round(avg({m}), 6) AS {m}" for m in ranking.METRICS)}, count(seconds) AS n_timed, round(avg(seconds), 9) AS mean_seconds, round(median(seconds), 9) AS median_seconds, round(quantile_cont(seconds, 0.95), 9) AS p95_seconds, round(sum(seconds), 9) AS total_seconds
FROM t GROUP BY GROUPING SETS ((scope, k), (scope, k, specificity), (scope, k, qdoc))"""
)
def retrieval_summary_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and timings by scope and cut-off, in all, by specificity and by target document; groups without timings have none."""
    cut = with_unit(scoped(spark, sf_dir)).withColumn("k", F.explode(F.array(*map(F.lit, KS)))).where("rank <= k")
    scored = ranking.ir_metrics(ranking.ranked_units(cut, "scope", "k", "query_id"), gold(spark, sf_dir), "scope", "k", "query_id")
    facts = queries(spark, sf_dir).select("query_id", F.col("document_code").cast("long").alias("document_code"), (F.col("label") % 3).cast("long").alias("specificity"))
    timings = read(spark, sf_dir, "events").where("event_id % 200 <> 0").select(F.col("event_id").alias("query_id"), (F.col("value") / 1000).alias("seconds"))
    rows = scored.join(facts, "query_id").join(timings, "query_id", "left")
    scope, k, kind, document = (F.col(c) for c in ("scope", "k", "specificity", "document_code"))
    none = F.lit(None).cast("long")
    levels = [F.struct(F.lit(n).alias("level"), a.alias("specificity"), b.alias("document_code")) for n, a, b in (("macro", none, none), ("specificity", kind, none), ("document", none, document))]
    keys = ("scope", "k", "level", "specificity", "document_code")
    each = rows.select(scope, k, F.explode(F.array(*levels)).alias("g"), "seconds", *ranking.METRICS).select("scope", "k", "g.*", "seconds", *ranking.METRICS)
    sums = each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(m), 6).alias(m) for m in ranking.METRICS),
        F.count("seconds").alias("n_timed"), F.round(F.avg("seconds"), 9).alias("mean_seconds"), F.round(F.sum("seconds"), 9).alias("total_seconds"),
    )
    ends = ordering.quantiles(each, "seconds", {"median_seconds": 0.5, "p95_seconds": 0.95}, *keys)
    return ordering.beside(sums, ends, *keys, how="left").withColumns({c: F.round(c, 9) for c in ("median_seconds", "p95_seconds")})


@R.add(
    f"""WITH {ranked_sql()}, {GOLD_SQL}, {UNITS_SQL}, {metrics_sql("units")},
a AS (SELECT m.*, list_distinct([label % 6, (label * 5 + 1) % 6]) AS acts FROM metrics m JOIN embeddings ON vec_id = query_id)
SELECT document_code::BIGINT AS document_code, count(*) AS n_queries, {", ".join(f"round(avg({m}), 6) AS {m}" for m in ranking.METRICS)} FROM (SELECT *, unnest(acts) AS document_code FROM a) e GROUP BY 1"""
)
def retrieval_summary_by_target_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by target document; a query with several targets counts in each, one named twice once."""
    acts = queries(spark, sf_dir).select("query_id", F.array_distinct(F.array((F.col("label") % 6).cast("long"), ((F.col("label") * 5 + 1) % 6).cast("long"))).alias("acts"))
    each = query_metrics(spark, sf_dir).join(acts, "query_id").withColumn("document_code", F.explode("acts"))
    return each.groupBy("document_code").agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(m), 6).alias(m) for m in ranking.METRICS))


#: Stored rankings: an order is a query, its lines are ranks whose chunks answer one or two parts; gold are parts the order's customer stands for.
STORED_SQL = """ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem),
stored AS (SELECT l_orderkey AS query_id, rank, unnest(list_distinct([l_partkey % 50, l_suppkey % 50])) AS unit FROM ln),
gold AS (SELECT DISTINCT o_orderkey AS query_id, unnest([o_custkey % 50, (o_custkey + 7) % 50]) AS unit FROM orders)"""


@R.add(
    f"""WITH {STORED_SQL}, cut AS (SELECT k, s.* FROM stored s, (VALUES (1), (3), (5)) t(k) WHERE rank <= k),
fu AS (SELECT k, query_id, unit, row_number() OVER (PARTITION BY k, query_id ORDER BY first, unit) AS unit_rank FROM (SELECT k, query_id, unit, min(rank) AS first FROM cut GROUP BY ALL) m),
{metrics_sql("fu", "k, query_id")}
SELECT k, count(*) AS n_queries, {", ".join(f"round(avg({m}), 6) AS {m}" for m in ranking.METRICS)} FROM metrics GROUP BY 1"""
)
def rescored_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings as they were stored, scored anew at each cut-off without a search."""
    lines = read(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    stored = lines.select(F.col("l_orderkey").alias("query_id"), "rank", F.array_distinct(F.array(F.col("l_partkey") % 50, F.col("l_suppkey") % 50)).alias("units"))
    wanted = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.explode(F.array(F.col("o_custkey") % 50, (F.col("o_custkey") + 7) % 50)).alias("unit")).distinct()
    scored = ranking.rescored(stored, wanted, (1, 3, 5))
    return scored.groupBy("k").agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(m), 6).alias(m) for m in ranking.METRICS))


def cut_metrics(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    """Metrics under a configuration that keeps the first ``dims`` dimensions."""
    cut = F.slice("embedding", 1, dims).alias("embedding")
    c = chunks(spark, sf_dir).select("chunk_id", "document_code", cut)
    q = queries(spark, sf_dir).select("query_id", "allowed", cut)
    return ranking.ir_metrics(ranking.ranked_units(with_unit(vectors.top_k(c, q, K)), "query_id"), gold(spark, sf_dir), "query_id")


@R.add(
    f"""WITH {ranked_sql()}, {GOLD_SQL}, {UNITS_SQL}, {metrics_sql('units')}, short AS (
 WITH {ranked_sql(dims=16)}, {GOLD_SQL}, {UNITS_SQL}, {metrics_sql('units')} SELECT * FROM metrics)
SELECT query_id, round(metrics.f1 - short.f1, 6) AS f1_difference, round(metrics.recall - short.recall, 6) AS recall_difference FROM metrics JOIN short USING (query_id)"""
)
def paired_config_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = query_metrics(spark, sf_dir).alias("a"), cut_metrics(spark, sf_dir, 16).alias("b")
    return a.join(b, "query_id").select("query_id", F.round(F.col("a.f1") - F.col("b.f1"), 6).alias("f1_difference"), F.round(F.col("a.recall") - F.col("b.recall"), 6).alias("recall_difference"))


@R.add(
    f"""WITH {ranked_sql()}, {GOLD_SQL}, r AS (SELECT DISTINCT query_id, unit FROM ranked),
c AS (SELECT query_id, count(*) AS n_gold, count(r.unit) AS n_both, string_agg(CASE WHEN r.unit IS NULL THEN unit::VARCHAR END, ';' ORDER BY unit) AS missing FROM gold LEFT JOIN r USING (query_id, unit) GROUP BY 1),
e AS (SELECT query_id, count(*) AS n_units, string_agg(CASE WHEN gold.unit IS NULL THEN unit::VARCHAR END, ';' ORDER BY unit) AS extra FROM r LEFT JOIN gold USING (query_id, unit) GROUP BY 1)
SELECT query_id, round(n_both / n_units, 6) AS precision, round(n_both / n_gold, 6) AS recall, coalesce(missing, '') AS missing, coalesce(extra, '') AS extra FROM c JOIN e USING (query_id)"""
)
def context_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_unit(search(spark, sf_dir)).groupBy("query_id").agg(F.collect_set("unit").alias("have"))
    wanted = gold(spark, sf_dir).groupBy("query_id").agg(F.collect_set("unit").alias("want"))
    both = F.size(F.array_intersect("have", "want"))
    return found.join(wanted, "query_id").select(
        "query_id", F.round(both / F.size("have"), 6).alias("precision"), F.round(both / F.size("want"), 6).alias("recall"),
        F.array_join(F.array_sort(F.array_except("want", "have")), ";").alias("missing"), F.array_join(F.array_sort(F.array_except("have", "want")), ";").alias("extra"),
    )


@R.add(f"WITH {ranked_sql()}, {GOLD_SQL}, {UNITS_SQL}, {metrics_sql('units')} SELECT query_id, m AS metric, round(CASE m WHEN 'f1' THEN f1 WHEN 'recall' THEN recall WHEN 'mrr' THEN mrr END, 6) AS value FROM metrics, (VALUES ('f1'), ('recall'), ('mrr')) t(m)")
def retrieval_rows_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = query_metrics(spark, sf_dir).select("query_id", "f1", "recall", "mrr")
    return scored.unpivot("query_id", ["f1", "recall", "mrr"], "metric", "value").withColumn("value", F.round("value", 6))


@R.add(
    f"""WITH {ranked_sql()}, {GOLD_SQL}, {UNITS_SQL}, {metrics_sql('units')}
SELECT 'own' AS system, round(avg(precision), 6) AS precision, round(avg(f1), 6) AS f1 FROM metrics UNION ALL SELECT 'published', 0.688, 0.38"""
)
def external_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own means beside the anchor values 0.688 and 0.380 of the published system."""
    own = query_metrics(spark, sf_dir).agg(F.lit("own").alias("system"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("f1"), 6).alias("f1"))
    return own.unionByName(spark.createDataFrame([("published", 0.688, 0.38)], "system string, precision double, f1 double"))


#: What others published, by scope and cut-off; a measure that was not given is null.
ANCHORS = (("all", 10, 0.688, None, 0.38, 0.459, 0.713), ("target", 10, 0.726, None, 0.413, 0.506, 0.755), ("fixed", 5, 0.4517, 0.3758, 0.3805, None, None))
_MEASURES = ("precision", "recall", "f1", "ndcg", "mrr")


@R.add(
    f"""WITH {SCOPED_SQL}, {GOLD_SQL}, kranked AS (SELECT * FROM sranked WHERE rank <= CASE scope WHEN 'fixed' THEN 5 ELSE 10 END),
kunits AS (SELECT scope, query_id, unit, row_number() OVER (PARTITION BY scope, query_id ORDER BY first, unit) AS unit_rank FROM (SELECT scope, query_id, unit, min(rank) AS first FROM kranked GROUP BY ALL) f),
{metrics_sql('kunits', 'scope, query_id')}
SELECT 'own' AS system, scope, CASE scope WHEN 'fixed' THEN 5 ELSE 10 END AS k, count(*) AS n_queries, {", ".join(f"round(avg({m}), 6) AS {m}" for m in _MEASURES)} FROM metrics GROUP BY scope
UNION ALL SELECT 'published', * FROM (VALUES {", ".join(f"('{s}', {k}, NULL::BIGINT, " + ", ".join("NULL::DOUBLE" if x is None else f"{x}::DOUBLE" for x in rest) + ")" for s, k, *rest in ANCHORS)}) v(scope, k, n_queries, {", ".join(_MEASURES)})"""
)
def external_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own means of each scope at its cut-off beside all published anchors."""
    cut = F.when(F.col("scope") == "fixed", 5).otherwise(10)
    hits = with_unit(scoped(spark, sf_dir)).where(F.col("rank") <= cut)
    scored = ranking.ir_metrics(ranking.ranked_units(hits, "scope", "query_id"), gold(spark, sf_dir), "scope", "query_id")
    own = scored.groupBy("scope").agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(m), 6).alias(m) for m in _MEASURES))
    own = own.select(F.lit("own").alias("system"), "scope", cut.alias("k"), "n_queries", *_MEASURES)
    rows = [("published", s, k, None, *rest) for s, k, *rest in ANCHORS]
    return own.unionByName(spark.createDataFrame(rows, "system string, scope string, k int, n_queries long, " + ", ".join(f"{m} double" for m in _MEASURES)))


@R.add("SELECT count(*) AS n_vectors, max(len(embedding)) AS dimension, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm FROM (SELECT embedding, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) q")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.size("embedding").cast("long").alias("d"), vectors.norm("embedding").alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("n_vectors"), F.max("d").alias("dimension"), F.round(F.min("n"), 6).alias("min_norm"), F.round(F.max("n"), 6).alias("max_norm"))


@R.add(
    """WITH n AS (SELECT vec_id, [x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) FOR x IN embedding::DOUBLE[]] AS e FROM embeddings)
SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(e[1], 6) AS head FROM n"""
)
def normalized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "embeddings").select("vec_id", vectors.normalized("embedding").alias("e"))
    return n.select("vec_id", F.round(vectors.norm("e"), 6).alias("norm"), F.round(F.col("e")[0], 6).alias("head"))


QUERIES, ORACLE_SQL = R.queries, R.sql
