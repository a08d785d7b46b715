"""Answers, judge scores and reports: joins, rollups, gates and resumable updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, ordering
from .registry import Registry, read

R = Registry()


@R.add(
    """SELECT doc_id, quality, toxic, n_chars, quality = 0 OR toxic = 1 AS flagged, CASE WHEN quality + toxic = 0 THEN 'zero' WHEN quality + toxic = 1 THEN 'full' ELSE 'over' END AS band
FROM documents JOIN labels USING (doc_id)"""
)
def score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    total = F.col("quality") + F.col("toxic")
    return j.select("doc_id", "quality", "toxic", "n_chars", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("flagged"), F.when(total == 0, "zero").when(total == 1, "full").otherwise("over").alias("band"))


@R.add("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def missing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@R.add("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def audit_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@R.add(
    """SELECT coalesce(event_type, 'overall') AS condition, count(*) AS n, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, round(quantile_cont(value, 0.95), 6) AS p95_value, round(sum(value), 6) AS total_value
FROM events GROUP BY ROLLUP (event_type)"""
)
def condition_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "events").select(F.explode(F.array("event_type", F.lit("overall"))).alias("condition"), "value")
    sums = each.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.sum("value"), 6).alias("total_value"))
    ends = ordering.quantiles(each, "value", {"median_value": 0.5, "p95_value": 0.95}, "condition")
    return ordering.beside(sums, ends, "condition", how="left").select("condition", "n", "mean_value", F.round("median_value", 6).alias("median_value"), F.round("p95_value", 6).alias("p95_value"), "total_value")


@R.add(
    """SELECT role, coalesce(value, 'None') AS provider, count(*) AS n FROM (SELECT 'status' AS role, o_orderstatus AS value FROM orders UNION ALL SELECT 'priority', o_orderpriority FROM orders
 UNION ALL SELECT 'late', CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'yes' END FROM orders) q GROUP BY ALL"""
)
def provider_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, "yes").alias("late"))
    long = rows.selectExpr("stack(3, 'status', o_orderstatus, 'priority', o_orderpriority, 'late', late) AS (role, value)")
    return long.groupBy("role", F.coalesce("value", F.lit("None")).alias("provider")).agg(F.count(F.lit(1)).alias("n"))


@R.add(
    """WITH m AS (SELECT event_type, avg(value) AS v, avg(user_id % 10) AS u, avg(event_id % 3) AS e FROM events GROUP BY 1), b AS (SELECT * FROM m WHERE event_type = 'view')
SELECT m.event_type AS condition, round(m.v - b.v, 6) AS d_value, round(m.u - b.u, 6) AS d_user, round(m.e - b.e, 6) AS d_event, m.v > b.v AND m.u <= b.u AND m.e <= b.e AS triggered FROM m, b WHERE m.event_type <> 'view'"""
)
def anti_gaming_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("v"), F.avg(F.col("user_id") % 10).alias("u"), F.avg(F.col("event_id") % 3).alias("e"))
    # The baseline is one row.
    b = m.where("event_type = 'view'").select(F.col("v").alias("bv"), F.col("u").alias("bu"), F.col("e").alias("be"), F.lit("view").alias("base"))
    j = m.join(F.broadcast(b), F.col("event_type") != F.col("base"))
    return j.select(
        F.col("event_type").alias("condition"), F.round(F.col("v") - F.col("bv"), 6).alias("d_value"), F.round(F.col("u") - F.col("bu"), 6).alias("d_user"), F.round(F.col("e") - F.col("be"), 6).alias("d_event"),
        F.expr("v > bv AND u <= bu AND e <= be").alias("triggered"),
    )


@R.add(
    """WITH s AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL)
SELECT a.user_id, round(a.v + b.v + c.v, 6) AS latency FROM s a JOIN s b USING (user_id) JOIN s c USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'view' AND c.event_type = 'purchase'"""
)
def pipeline_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of three stages' times per query; a query without all three is left out. One shuffle: the stages are pivoted, not joined."""
    p = read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.avg("value"))
    return p.dropna().select("user_id", F.round(F.col("click") + F.col("view") + F.col("purchase"), 6).alias("latency"))


@R.add(
    """SELECT event_type AS condition, count(*) AS n, round(avg(quality), 6) AS mean_quality, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr,
 count(CASE WHEN toxic = 1 THEN 1 END) AS n_toxic FROM events JOIN labels ON user_id = doc_id GROUP BY 1"""
)
def answer_quality_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "events").join(read(spark, sf_dir, "labels"), F.col("user_id") == F.col("doc_id"))
    means = j.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("m"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
    q = ordering.beside(means, ordering.quantiles(j, "value", {"a": 0.25, "b": 0.75}, "event_type"), "event_type", how="left")
    return q.select(F.col("event_type").alias("condition"), "n", F.round("m", 6).alias("mean_quality"), F.round("a", 6).alias("q1"), F.round("b", 6).alias("q3"), F.round(F.col("b") - F.col("a"), 6).alias("iqr"), "n_toxic")


@R.add(
    """WITH h AS (SELECT sha256(text) AS h, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT DISTINCT sha256(text) AS h FROM documents SEMI JOIN labels USING (doc_id)), m AS (SELECT * FROM h ANTI JOIN c USING (h))
SELECT h AS text_sha256, first AS first_doc, n, (row_number() OVER (ORDER BY first) - 1) // 100 AS batch FROM m"""
)
def embedding_cache_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts that are not in the cache (here: those of labelled documents), in batches of a hundred."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    cached = rows.join(read(spark, sf_dir, "labels"), "doc_id", "left_semi").select("text_sha256").distinct()
    missing = rows.groupBy("text_sha256").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).join(cached, "text_sha256", "left_anti")
    return ordering.numbered(missing, "first_doc").select("text_sha256", "first_doc", "n", F.expr("(row - 1) div 100").alias("batch"))


@R.add(
    """WITH old AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' OR turn > 2), new AS (SELECT conv_id, turn, upper(role) AS text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, sha256(coalesce(n.text, o.text)) AS text_sha256, n.conv_id IS NOT NULL AS replaced FROM old o FULL JOIN new n USING (conv_id, turn)"""
)
def resume_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace old ones of the same key: one grouped pass in which the later version wins."""
    c = read(spark, sf_dir, "conversations")
    old = c.where("role = 'user' OR turn > 2").select("conv_id", "turn", "text", F.lit(0).alias("version"))
    new = c.where("role = 'assistant'").select("conv_id", "turn", F.upper("role").alias("text"), F.lit(1).alias("version"))
    last = old.unionByName(new).groupBy("conv_id", "turn").agg(F.max_by("text", "version").alias("text"), F.max("version").alias("version"))
    return last.select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"), (F.col("version") == 1).alias("replaced"))


@R.add("WITH c AS (SELECT event_type, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 20)) SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_queries, count(DISTINCT user_id) = 20 AS complete FROM c GROUP BY 1")
def pilot_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the first twenty query ids, and whether each condition has them all."""
    e = read(spark, sf_dir, "events").select("event_type", "user_id")
    pilot = e.select("user_id").distinct().orderBy("user_id").limit(20)
    kept = e.join(F.broadcast(pilot), "user_id", "left_semi")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_queries")).withColumn("complete", F.col("n_queries") == 20)


@R.add("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS total, arg_max(role, turn) AS last_role, count(*) AS n FROM conversations GROUP BY 1")
def usage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers are added over records, other values carried from the last."""
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("total"), F.max_by("role", "turn").alias("last_role"), F.count(F.lit(1)).alias("n"))


#: Usage records of a user: a number always, a truth value, a text and a number of its own in some.
USAGE_SQL = """concat('{"total": ', event_id % 90, CASE WHEN event_id % 3 = 0 THEN concat(', "cached": ', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END) ELSE '' END,
 CASE WHEN event_id % 4 = 0 THEN concat(', "model": "m', event_id % 7, '"') ELSE '' END, CASE WHEN event_id % 5 = 0 THEN concat(', "cost": ', event_id % 8, '.5') ELSE '' END, CASE WHEN event_id % 11 = 0 THEN ', "note": null' ELSE '' END, '}')"""


@R.add(
    f"""WITH u AS (SELECT user_id, event_id, {USAGE_SQL}::JSON AS j FROM events WHERE event_id % 13 <> 0), l AS (SELECT user_id, max(event_id) AS last FROM u GROUP BY 1),
e AS (SELECT user_id, event_id, unnest(json_keys(j)) AS name, j FROM u), v AS (SELECT user_id, event_id, name, json_type(j, '$.' || name) AS kind, j ->> ('$.' || name) AS x FROM e),
g AS (SELECT user_id, name, bool_or(kind IN ('BIGINT', 'UBIGINT', 'DOUBLE')) AS numeric, sum(CASE WHEN kind IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN x::DOUBLE WHEN x = 'true' THEN 1 ELSE 0 END) AS total, bool_or(event_id = last) AS in_last, max(CASE WHEN event_id = last THEN x END) AS carried FROM v JOIN l USING (user_id) GROUP BY ALL)
SELECT user_id, name, CASE WHEN numeric THEN round(total, 6) END AS total, CASE WHEN NOT numeric THEN carried END AS carried FROM g WHERE numeric OR in_last"""
)
def usage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of usage objects are added over a user's records; truth values, texts and nulls come from the last."""
    e = read(spark, sf_dir, "events").where("event_id % 13 <> 0").select("user_id", "event_id", F.expr(USAGE_SQL).alias("usage"))
    return checks.merged_usage(e, "user_id", "event_id", "usage").withColumn("total", F.round("total", 6))


@R.add(
    """SELECT doc_id, source, 'duplicate' AS problem FROM documents QUALIFY count(*) OVER (PARTITION BY md5(text), source) > 1
UNION ALL SELECT doc_id, source, 'too_short' FROM documents WHERE length(text) < 40 UNION ALL SELECT doc_id, source, 'length_mismatch' FROM documents WHERE length(text) <> n_chars"""
)
def corpus_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    groups = d.groupBy(F.md5("text").alias("h"), "source").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h", "source")
    duplicate = d.select("doc_id", "source", F.md5("text").alias("h")).join(groups, ["h", "source"], "left_semi").select("doc_id", "source", F.lit("duplicate").alias("problem"))
    short = d.where(F.length("text") < 40).select("doc_id", "source", F.lit("too_short").alias("problem"))
    wrong = d.where(F.length("text") != F.col("n_chars")).select("doc_id", "source", F.lit("length_mismatch").alias("problem"))
    return duplicate.unionByName(short).unionByName(wrong)


@R.add("SELECT lang, count(CASE WHEN source = 'src0' THEN 1 END) AS src0, count(CASE WHEN source = 'src1' THEN 1 END) AS src1, count(CASE WHEN source = 'src2' THEN 1 END) AS src2 FROM documents GROUP BY 1")
def unit_counts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "documents").groupBy("lang").pivot("source", ["src0", "src1", "src2"]).agg(F.count(F.lit(1)))
    return p.fillna(0)


@R.add("WITH m AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL) SELECT event_type, user_id, round(v, 6) AS mean_value FROM m QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY v DESC, user_id) = 1")
def best_per_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    best = m.groupBy("event_type").agg(F.max_by(F.struct("user_id", "v"), F.struct("v", -F.col("user_id"))).alias("b"))
    return best.select("event_type", "b.user_id", F.round("b.v", 6).alias("mean_value"))


@R.add("SELECT user_id FROM (SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase') q EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def query_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    both = e.where("event_type = 'view'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))
    return both.exceptAll(read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct())


QUERIES, ORACLE_SQL = R.queries, R.sql
