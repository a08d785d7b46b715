"""Validation gates, design checks, lookups and report rows as queries: each returns what it found, violations included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import checks, ordering, spots
from .registry import Registry, read

R = Registry()


@R.add("SELECT conv_id, role, turn, CAST(length(text) AS BIGINT) AS n_chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1")
def first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return checks.first_by_key(rows, ["turn", "text"], "conv_id", "role").select("conv_id", "role", "turn", F.length("text").cast("long").alias("n_chars"))


@R.add(
    """SELECT l_orderkey AS query_id, string_agg(DISTINCT l_partkey::VARCHAR, ';' ORDER BY l_partkey::VARCHAR) AS missing, count(DISTINCT l_partkey) AS n_missing
FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45) GROUP BY 1"""
)
def gold_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold units that no known unit resolves, by query."""
    refs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("p_partkey")).distinct()
    lost = checks.unresolved(refs, read(spark, sf_dir, "part").where("p_size < 45"), "p_partkey")
    return lost.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("p_partkey").cast("string"))), ";").alias("missing"), F.count(F.lit(1)).alias("n_missing"))


@R.add(
    """WITH e AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 17 <> 0), a AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN concat(text, '.') ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0)
SELECT doc_id, CASE WHEN e.doc_id IS NULL THEN 'unexpected' WHEN a.doc_id IS NULL THEN 'missing' WHEN e.h IS NOT DISTINCT FROM a.h THEN 'match' ELSE 'changed' END AS status FROM e FULL JOIN a USING (doc_id)"""
)
def snapshot_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot's digests against those of what is there: each side lacks some rows, and some texts changed."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    expected = d.where("doc_id % 17 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    actual = d.where("doc_id % 13 <> 0").select("doc_id", F.sha2(F.expr("CASE WHEN doc_id % 10 = 0 THEN concat(text, '.') ELSE text END"), 256).alias("h"))
    return checks.compared(expected, actual, "doc_id", "h")


@R.add(
    """WITH s AS (SELECT p_partkey, p_brand AS model, p_size AS dimension, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'text' ELSE 'embedding_text' END AS field FROM part)
SELECT p_partkey, coalesce(field, 'text') AS field, model = 'Brand#13' AND dimension >= 10 AND coalesce(field, 'text') = 'text' AS usable FROM s"""
)
def metadata_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored metadata against what is wanted; records from before a field existed have its default."""
    field = F.coalesce(F.expr("CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'text' ELSE 'embedding_text' END"), F.lit("text"))
    return read(spark, sf_dir, "part").select("p_partkey", field.alias("field"), ((F.col("p_brand") == "Brand#13") & (F.col("p_size") >= 10) & (field == "text")).alias("usable"))


@R.add("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_type ELSE p_name END AS text, p_size % 4 = 0 AS own FROM part")
def embedding_text_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that is embedded: a text of its own, or the chunk's where that is null or empty."""
    own = F.expr("CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN '' END")
    return read(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.nullif(own, F.lit("")), "p_name").alias("text"), F.coalesce(own != "", F.lit(False)).alias("own"))


@R.add(
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1), b AS (SELECT *, p95 / 10 AS steps FROM q)
SELECT event_type, n, round(p95, 6) AS p95, CAST((CASE WHEN abs(steps - floor(steps) - 0.5) < 1e-12 THEN 2 * round(steps / 2) ELSE round(steps) END) * 10 AS BIGINT) AS derived,
 (CASE WHEN abs(steps - floor(steps) - 0.5) < 1e-12 THEN 2 * round(steps / 2) ELSE round(steps) END) * 10 = 100 AS matches FROM b"""
)
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget that the data call for, in steps and halves to even, against the configured one."""
    events = read(spark, sf_dir, "events")
    q = ordering.beside(events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), ordering.quantiles(events, "value", {"p95": 0.95}, "event_type"), "event_type", how="left")
    derived = F.bround(F.col("p95") / 10, 0) * 10
    return q.select("event_type", "n", F.round("p95", 6).alias("p95"), derived.cast("long").alias("derived"), (derived == 100).alias("matches"))


@R.add(
    """WITH v AS (SELECT o_custkey % 20 AS condition, o_orderkey, abs(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey)) / avg(o_totalprice) OVER (PARTITION BY o_custkey) AS error FROM orders),
n AS (SELECT condition, count(*) AS n, count(CASE WHEN error > 0.5 THEN 1 END) AS outside, round(max(error), 6) AS max_error FROM v GROUP BY 1),
f AS (SELECT condition, string_agg(o_orderkey::VARCHAR, ';' ORDER BY o_orderkey) AS first FROM (SELECT * FROM v WHERE error > 0.5 QUALIFY row_number() OVER (PARTITION BY condition ORDER BY o_orderkey) <= 10) q GROUP BY 1)
SELECT condition, n, outside, max_error, coalesce(first, '') AS first_outside FROM n LEFT JOIN f USING (condition)"""
)
def volume_tolerance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose volume is not within tolerance of their customer's mean: their number, and the first ten by id as the report names them."""
    mean = F.avg("o_totalprice").over(W.partitionBy("o_custkey"))
    v = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("condition"), "o_orderkey", (F.abs(F.col("o_totalprice") - mean) / mean).alias("error"))
    outside = F.when(F.col("error") > 0.5, F.col("o_orderkey"))
    n = v.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count(outside).alias("outside"), F.round(F.max("error"), 6).alias("max_error"))
    place = F.row_number().over(W.partitionBy("condition").orderBy("o_orderkey"))
    named = v.where("error > 0.5").withColumn("place", place).where("place <= 10").groupBy("condition").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ";").alias("first"))
    return n.join(named, "condition", "left").select("condition", "n", "outside", "max_error", F.coalesce("first", F.lit("")).alias("first_outside"))


@R.add(
    r"""WITH m AS (SELECT conv_id, sum(len(regexp_extract_all(text, '[^ \t\n\r]+'))) AS prompt FROM conversations GROUP BY 1)
SELECT count(*) AS n_prompts, CAST(max(prompt) + 200 AS BIGINT) AS largest, max(prompt) + 200 <= 500 AS fits, count(CASE WHEN prompt + 200 > 500 THEN 1 END) AS n_over FROM m"""
)
def context_window_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest prompt and the output budget against the window."""
    tokens = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)))
    m = read(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sum(tokens) + 200).alias("needed"))
    return m.agg(F.count(F.lit(1)).alias("n_prompts"), F.max("needed").alias("largest"), (F.max("needed") <= 500).alias("fits"), F.count_if(F.col("needed") > 500).alias("n_over"))


FINISH_SQL = "CASE WHEN (conv_id + turn) % 9 = 0 THEN 'length' ELSE 'stop' END"


@R.add(f"SELECT conv_id, turn, {FINISH_SQL} AS finish_reason, trim(text) = '' AS blank FROM conversations WHERE role = 'assistant' AND ({FINISH_SQL} <> 'stop' OR trim(text) = '')")
def incomplete_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that were cut off or are blank."""
    rows = read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.expr(FINISH_SQL).alias("finish_reason"), (F.trim("text") == "").alias("blank"))
    return rows.where("finish_reason <> 'stop' OR blank")


DESIGN_SQL = "SELECT CASE l_linenumber WHEN 1 THEN 'fixed_size' WHEN 2 THEN 'semantic' ELSE 'other' END AS condition, l_orderkey AS query_id, l_quantity::INT AS budget, l_suppkey % 5 AS excluded FROM lineitem"


@R.add(
    f"""WITH r AS ({DESIGN_SQL}), g AS (SELECT condition, count(*) AS n, count(DISTINCT query_id) AS n_queries, count(CASE WHEN budget <> 25 THEN 1 END) AS wrong_budget, count(CASE WHEN excluded > 0 THEN 1 END) AS with_exclusions FROM r GROUP BY 1),
t AS (SELECT count(*) AS n FROM orders)
SELECT condition, g.n, n_queries, wrong_budget, with_exclusions, condition IN ('fixed_size', 'semantic') AS planned, g.n = n_queries AND n_queries = t.n AND wrong_budget = 0 AND with_exclusions = 0 AS valid FROM g, t"""
)
def design_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per condition, whether every query has one record of the planned design."""
    # One row.
    total = read(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("t"))
    r = read(spark, sf_dir, "lineitem").selectExpr("CASE l_linenumber WHEN 1 THEN 'fixed_size' WHEN 2 THEN 'semantic' ELSE 'other' END AS condition", "l_orderkey AS query_id", "cast(l_quantity AS int) AS budget", "l_suppkey % 5 AS excluded")
    g = r.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("n_queries"), F.count_if(F.col("budget") != 25).alias("wrong_budget"), F.count_if(F.col("excluded") > 0).alias("with_exclusions"))
    valid = (F.col("n") == F.col("n_queries")) & (F.col("n_queries") == F.col("t")) & (F.col("wrong_budget") == 0) & (F.col("with_exclusions") == 0)
    return g.join(F.broadcast(total), F.lit(True)).select("condition", "n", "n_queries", "wrong_budget", "with_exclusions", F.col("condition").isin("fixed_size", "semantic").alias("planned"), valid.alias("valid"))


@R.add(
    """WITH a AS (SELECT event_type AS strategy, user_id AS query_id, event_id % 2 AS model FROM events), s AS (SELECT strategy, count(DISTINCT query_id) AS n_queries, count(DISTINCT model) AS n_models, count(*) - count(DISTINCT query_id) AS n_repeated FROM a GROUP BY 1),
u AS (SELECT count(DISTINCT query_id) AS n FROM a)
SELECT strategy, n_queries, n_models, n_repeated, n_queries = u.n AS same_queries, n_models = 1 AS one_model FROM s, u"""
)
def comparison_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether strategies that are compared cover the same queries with one model; every strategy against the union of all."""
    a = read(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), F.col("user_id").alias("query_id"), (F.col("event_id") % 2).alias("model"))
    s = a.groupBy("strategy").agg(F.count_distinct("query_id").alias("n_queries"), F.count_distinct("model").alias("n_models"), F.count(F.lit(1)).alias("n"))
    # One row.
    u = a.agg(F.count_distinct("query_id").alias("u"))
    return s.join(F.broadcast(u), F.lit(True)).select("strategy", "n_queries", "n_models", (F.col("n") - F.col("n_queries")).alias("n_repeated"), (F.col("n_queries") == F.col("u")).alias("same_queries"), (F.col("n_models") == 1).alias("one_model"))


@R.add("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'confirmatory_allowed' WHEN 1 THEN 'exploratory_only' END AS decision, n_nationkey % 3 <> 0 AS triggered, CASE WHEN n_nationkey % 3 = 0 THEN 'confirmatory' ELSE 'exploratory' END AS family FROM nation")
def xref_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the exact decision opens the gate; a missing one, or any other, leaves contrasts exploratory."""
    decision = F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'confirmatory_allowed' WHEN 1 THEN 'exploratory_only' END")
    triggered = ~decision.eqNullSafe(F.lit("confirmatory_allowed"))
    return read(spark, sf_dir, "nation").select("n_nationkey", decision.alias("decision"), triggered.alias("triggered"), F.when(triggered, "exploratory").otherwise("confirmatory").alias("family"))


@R.add(
    """SELECT p_brand AS strategy, count(CASE WHEN p_size = 7 THEN 1 END) AS n_flagged, CASE WHEN count(CASE WHEN p_size = 7 THEN 1 END) = 1 THEN max(CASE WHEN p_size = 7 THEN p_partkey END) END AS chosen,
 coalesce(string_agg(CASE WHEN p_size = 7 THEN p_partkey::VARCHAR END, ';' ORDER BY p_partkey), '') AS flagged FROM part GROUP BY 1"""
)
def confirmatory_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one flagged configuration of each strategy; none or several are a violation and choose nothing."""
    flagged = F.when(F.col("p_size") == 7, F.col("p_partkey"))
    g = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("strategy")).agg(F.count(flagged).alias("n_flagged"), F.max(flagged).alias("most"), F.array_sort(F.collect_list(flagged)).alias("all"))
    return g.select("strategy", "n_flagged", F.when(F.col("n_flagged") == 1, F.col("most")).alias("chosen"), F.array_join(F.transform("all", lambda x: x.cast("string")), ";").alias("flagged"))


@R.add(
    """WITH s AS (SELECT l_orderkey, list(DISTINCT l_partkey % 40) AS a, list(DISTINCT l_suppkey % 40) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_has_any(a, b) AS related, array_to_string(list_sort(list_distinct(list_concat(a, b))), ';') AS every FROM s"""
)
def related_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two unit sets of a segment share a unit, and their union."""
    s = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 40).alias("a"), F.collect_set(F.col("l_suppkey") % 40).alias("b"))
    return s.select("l_orderkey", F.arrays_overlap("a", "b").alias("related"), F.array_join(F.array_sort(F.array_union("a", "b")), ";").alias("every"))


ORDER = ("purchase", "view", "absent")


@R.add("SELECT event_type, count(*) AS n, CAST(row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'absent' THEN 3 ELSE 4 END, event_type) AS INTEGER) AS place FROM events GROUP BY 1")
def named_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions in a fixed order, unknown ones behind."""
    g = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select("event_type", "n", F.row_number().over(W.orderBy(checks.named_order(F.col("event_type"), ORDER))).alias("place"))


@R.add(
    """WITH c AS (SELECT l_returnflag AS condition, l_discount AS p, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS r, l_suppkey % 4 AS extra FROM lineitem)
SELECT condition, round(avg(p), 6) AS mean_precision, round(avg(r), 6) AS mean_recall, count(r) AS n_recall, round(avg(CASE WHEN p + coalesce(r, 0) > 0 THEN 2 * p * coalesce(r, 0) / (p + coalesce(r, 0)) ELSE 0 END), 6) AS mean_f1, round(avg(extra), 6) AS mean_extra FROM c GROUP BY 1"""
)
def citation_coverage_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by condition; answers without gold have no recall and are left out of its mean only."""
    c = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("condition"), F.col("l_discount").alias("p"), F.when(F.col("l_linenumber") != 7, F.col("l_tax")).alias("r"), (F.col("l_suppkey") % 4).alias("extra"))
    r = F.coalesce("r", F.lit(0.0))
    f1 = F.when(F.col("p") + r > 0, 2 * F.col("p") * r / (F.col("p") + r)).otherwise(0.0)
    return c.groupBy("condition").agg(F.round(F.avg("p"), 6).alias("mean_precision"), F.round(F.avg("r"), 6).alias("mean_recall"), F.count("r").alias("n_recall"), F.round(F.avg(f1), 6).alias("mean_f1"), F.round(F.avg("extra"), 6).alias("mean_extra"))


@R.add(
    """WITH q AS (SELECT l_orderkey, count(DISTINCT l_partkey) >= 2 AS multi, max((l_quantity > 40)::INT) = 1 AS cited, list(DISTINCT l_suppkey % 3) AS acts FROM lineitem GROUP BY 1),
c AS (SELECT q.*, o_orderstatus AS specificity FROM q JOIN orders ON o_orderkey = l_orderkey WHERE multi AND cited)
SELECT 'specificity' AS grouping_name, specificity AS value, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'act', a::VARCHAR, count(*) FROM (SELECT unnest(acts) AS a FROM c) x GROUP BY ALL UNION ALL SELECT 'all', 'all', count(*) FROM c"""
)
def structural_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of several gold units of which one is cited, by specificity, by act (a query counts in each of its acts), and in all."""
    q = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("units"), F.max((F.col("l_quantity") > 40).cast("int")).alias("cited"), F.collect_set(F.col("l_suppkey") % 3).alias("acts"))
    c = q.where("units >= 2 AND cited = 1").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") == F.col("l_orderkey"))
    tags = F.concat(F.array(F.struct(F.lit("specificity").alias("g"), F.col("o_orderstatus").alias("v")), F.struct(F.lit("all").alias("g"), F.lit("all").alias("v"))), F.transform("acts", lambda a: F.struct(F.lit("act").alias("g"), a.cast("string").alias("v"))))
    return c.select(F.explode(tags).alias("t")).groupBy(F.col("t.g").alias("grouping_name"), F.col("t.v").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@R.add(
    """SELECT source AS condition_id, round(avg((quality = 0)::INT), 6) AS faithfulness_abstention_rate, round(avg((quality = 0 AND toxic = 1)::INT), 6) AS faithfulness_unjustified_rate, round(avg((toxic = 1)::INT), 6) AS correctness_abstention_rate,
 CAST(sum(n_chars) AS BIGINT) AS generation_total, round(avg(n_chars), 6) AS generation_mean, median(n_chars) AS generation_median, quantile_cont(n_chars, 0.95) AS generation_p95 FROM documents JOIN labels USING (doc_id) GROUP BY 1"""
)
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstention rates and efficiency of each condition, one flat row."""
    j = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")

    def rate(flag):
        return F.round(F.avg(flag.cast("int")), 6)

    efficiency = {"total": F.sum("n_chars"), "mean": F.round(F.avg("n_chars"), 6)}
    j = j.withColumnRenamed("source", "condition_id")
    rows = j.groupBy("condition_id").agg(
        rate(F.col("quality") == 0).alias("faithfulness_abstention_rate"), rate((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("faithfulness_unjustified_rate"), rate(F.col("toxic") == 1).alias("correctness_abstention_rate"),
        *(c.alias(f"generation_{n}") for n, c in efficiency.items()),
    )
    return ordering.beside(rows, ordering.quantiles(j, "n_chars", {"generation_median": 0.5, "generation_p95": 0.95}, "condition_id"), "condition_id", how="left")


@R.add(
    """SELECT d.doc_id AS query_id, quality, CAST(length(p.html) AS BIGINT) AS context_chars, l.doc_id IS NULL OR p.page_id IS NULL AS incomplete FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id"""
)
def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their contexts and retrievals; rows that lack one are marked, since a comparison must refuse them."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("has_label"))
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.length("html").cast("long").alias("context_chars"), F.lit(True).alias("has_page"))
    j = read(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").join(pages, "doc_id", "left")
    return j.select(F.col("doc_id").alias("query_id"), "quality", "context_chars", (F.col("has_label").isNull() | F.col("has_page").isNull()).alias("incomplete"))


@R.add(
    """WITH g AS (SELECT l_orderkey AS query_id, l_linenumber AS place, l_partkey FROM lineitem), k AS (SELECT p_partkey, p_name FROM part WHERE p_size < 45)
SELECT query_id, string_agg(concat('[G', place, '] ', l_partkey, chr(10), coalesce(p_name, '(not available)')), concat(chr(10), chr(10)) ORDER BY place, l_partkey::VARCHAR) AS text, count(*) - count(p_partkey) AS n_missing FROM g LEFT JOIN k ON p_partkey = l_partkey GROUP BY 1"""
)
def gold_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold units of a query as one text; a unit that is missing has a placeholder and is counted, which the strict form refuses."""
    g = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("place"), "l_partkey")
    j = g.join(read(spark, sf_dir, "part").where("p_size < 45").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"), "left")
    text = F.concat(F.lit("[G"), "place", F.lit("] "), "l_partkey", F.lit("\n"), F.coalesce("p_name", F.lit("(not available)")))
    missing = j.groupBy("query_id").agg((F.count(F.lit(1)) - F.count("p_partkey")).alias("n_missing"))
    return checks.numbered_list(j, "place", text, "query_id").join(missing, "query_id")


SPAN_SQL = "SELECT l_orderkey AS doc, l_linenumber AS chunk_id, l_partkey % 200 AS start, l_partkey % 200 + l_quantity::INT AS stop FROM lineitem"


@R.add(
    f"""WITH s AS ({SPAN_SQL}), w AS (SELECT o_orderkey AS doc, greatest(o_custkey % 200 - 30, 0) AS low, least(o_custkey % 200 + 30, 240) AS high, o_custkey % 200 AS center FROM orders),
v AS (SELECT *, start <= center AND center <= stop AS holds FROM s JOIN w USING (doc) WHERE start < high AND low < stop),
a AS (SELECT doc, chunk_id AS anchor FROM v WHERE holds QUALIFY row_number() OVER (PARTITION BY doc ORDER BY stop - start, chunk_id) = 1)
SELECT doc, chunk_id, round(100.0 * (greatest(start, low) - low) / (high - low), 6) AS left_percent, round(100.0 * (least(stop, high) - greatest(start, low)) / (high - low), 6) AS width_percent, coalesce(chunk_id = anchor, false) AS is_anchor FROM v LEFT JOIN a USING (doc)"""
)
def spot_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in a window of each document, where they lie in it, and the smallest one that holds the window's center."""
    s = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "l_linenumber AS chunk_id", "l_partkey % 200 AS start", "l_partkey % 200 + cast(l_quantity AS int) AS stop")
    w = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc", "greatest(o_custkey % 200 - 30, 0) AS low", "least(o_custkey % 200 + 30, 240) AS high", "o_custkey % 200 AS center")
    v = s.join(w, "doc").where("start < high AND low < stop")
    holds = F.when(F.col("center").between(F.col("start"), F.col("stop")), F.struct(F.col("stop") - F.col("start"), "chunk_id"))
    anchor = F.min(holds).over(W.partitionBy("doc"))["chunk_id"]
    left, size = F.greatest("start", "low"), F.col("high") - F.col("low")
    return v.select("doc", "chunk_id", F.round(100.0 * (left - F.col("low")) / size, 6).alias("left_percent"), F.round(100.0 * (F.least("stop", "high") - left) / size, 6).alias("width_percent"), F.coalesce(F.col("chunk_id") == anchor, F.lit(False)).alias("is_anchor"))


#: Characters on either side of the anchor's center.
RADIUS = 60
SPOT_SQL = f"""d AS (SELECT o_orderkey AS doc, 240 AS length FROM orders),
ln AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
b AS (SELECT l_orderkey AS doc, l_linenumber AS chunk_id, l_partkey % 200 AS start, l_partkey % 200 + l_quantity::INT AS stop, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 5 END AS parent FROM ln),
e AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS chunk_id, unnest([(l_linenumber * 3 + l_partkey) % 7 + 1, (l_linenumber + l_suppkey) % 9 + 1]) AS target FROM ln WHERE l_partkey % 4 = 0),
w AS (SELECT b.*, (start + stop) // 2 AS center, parent IS NOT NULL AS p, EXISTS (SELECT 1 FROM e WHERE e.doc = b.doc AND e.chunk_id = b.chunk_id) AS x FROM b),
an AS (SELECT doc, chunk_id AS anchor, center, CASE WHEN p AND x THEN 'parent_and_edges' WHEN x THEN 'edges' WHEN p THEN 'parent' ELSE 'any' END AS pool, greatest(center - {RADIUS}, 0) AS low, least(center + {RADIUS}, length) AS high
  FROM w JOIN d USING (doc) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN p AND x THEN 0 WHEN x THEN 1 WHEN p THEN 2 ELSE 3 END, abs(center - length // 2), chunk_id) = 1),
c AS (SELECT 'base' AS config, doc, chunk_id, start, stop FROM b UNION ALL SELECT 'article', doc, min(chunk_id), min(start), max(stop) FROM b GROUP BY doc, (chunk_id - 1) // 2),
v AS (SELECT c.*, anchor, pool, center, low, high FROM c JOIN an USING (doc) WHERE start < high AND low < stop),
h AS (SELECT config, doc, chunk_id AS holder FROM v WHERE start <= center AND center <= stop QUALIFY row_number() OVER (PARTITION BY config, doc ORDER BY stop - start, chunk_id) = 1)"""


@R.add(
    f"""WITH {SPOT_SQL} SELECT doc, anchor, pool, config, chunk_id, coalesce(chunk_id = holder, false) AS holds_center, round(100.0 * (greatest(start, low) - low) / (high - low), 3) AS left_percent, round(100.0 * (least(stop, high) - greatest(start, low)) / (high - low), 3) AS width_percent
FROM v LEFT JOIN h USING (config, doc)"""
)
def spot_check_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each document's anchor to its window, and the chunks of every configuration that are seen there."""
    docs, base, edges = _spot_tables(spark, sf_dir)
    seen = spots.tracks(_spot_chunks(base), spots.anchors(docs, base, edges, RADIUS))
    return seen.select("doc", "anchor", "pool", "config", "chunk_id", "holds_center", F.round("left_percent", 3).alias("left_percent"), F.round("width_percent", 3).alias("width_percent"))


@R.add(
    f"""WITH {SPOT_SQL} SELECT an.doc, an.anchor, b.parent, e.target, t.start < high AND low < t.stop AS in_window FROM an JOIN b ON b.doc = an.doc AND b.chunk_id = an.anchor JOIN e ON e.doc = an.doc AND e.chunk_id = an.anchor
JOIN c t ON t.config = 'base' AND t.doc = an.doc AND t.chunk_id = e.target"""
)
def spot_check_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchor's parent and what it cites, as far as it is a chunk, and whether that lies in the window."""
    docs, base, edges = _spot_tables(spark, sf_dir)
    return spots.cited(spots.anchors(docs, base, edges, RADIUS), base, edges, base)


def _spot_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = read(spark, sf_dir, "lineitem")
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("f")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "f.*")
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(240).alias("length"))
    base = lines.selectExpr("l_orderkey AS doc", "l_linenumber AS chunk_id", "l_partkey % 200 AS start", "l_partkey % 200 + cast(l_quantity AS int) AS stop", "CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 5 END AS parent")
    edges = lines.where("l_partkey % 4 = 0").selectExpr("l_orderkey AS doc", "l_linenumber AS chunk_id", "explode(array((l_linenumber * 3 + l_partkey) % 7 + 1, (l_linenumber + l_suppkey) % 9 + 1)) AS target")
    return docs, base, edges


def _spot_chunks(base: DataFrame) -> DataFrame:
    article = base.groupBy("doc", F.expr("(chunk_id - 1) div 2")).agg(F.min("chunk_id").alias("chunk_id"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return base.select(F.lit("base").alias("config"), "doc", "chunk_id", "start", "stop").unionByName(article.select(F.lit("article").alias("config"), "doc", "chunk_id", "start", "stop"))


@R.add(
    """WITH e AS (SELECT DISTINCT o_custkey AS source, l_partkey AS target FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT source, target, n_name AS parent, target BETWEEN source AND source + 200 AS in_window FROM e JOIN customer ON c_custkey = source JOIN nation ON n_nationkey = c_nationkey"""
)
def spot_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct targets of a unit with its parent, and whether they lie in the window."""
    e = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("source")).join(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("target")), F.col("l_orderkey") == F.col("o_orderkey")).select("source", "target").distinct()
    parents = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("source"), F.col("n_name").alias("parent"))
    return e.join(parents, "source").select("source", "target", "parent", F.col("target").between(F.col("source"), F.col("source") + 200).alias("in_window"))


@R.add(
    """WITH s(condition, strategy) AS (VALUES ('view', 'hierarchical'), ('purchase', 'semantic'), ('click', 'fixed_size'))
SELECT coalesce(strategy, 'unknown') AS strategy, count(*) AS n, count(DISTINCT event_type) AS n_conditions, strategy IS NULL AS violation FROM events LEFT JOIN s ON condition = event_type GROUP BY strategy"""
)
def strategy_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the strategy of their condition; a condition without one is a violation."""
    strategies = spark.createDataFrame([("view", "hierarchical"), ("purchase", "semantic"), ("click", "fixed_size")], "event_type string, strategy string")
    j = read(spark, sf_dir, "events").select("event_type").join(strategies, "event_type", "left")
    return j.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("n_conditions")).select(F.coalesce("strategy", F.lit("unknown")).alias("strategy"), "n", "n_conditions", F.col("strategy").isNull().alias("violation"))


def _escaped_sql(x: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{entity}')"
    return x


@R.add(f"SELECT page_id, sha256(concat({_escaped_sql('substr(html, 1, 40)')}, '<mark>', {_escaped_sql('substr(html, 41, 60)')}, '</mark>', {_escaped_sql('substr(html, 101)')})) AS excerpt_sha256 FROM pages")
def excerpt_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped text with a marked part."""
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(checks.highlighted(F.col("html"), F.lit(40), F.lit(100)), 256).alias("excerpt_sha256"))


@R.add(
    """SELECT p_partkey, concat('{"chunk_id":', p_partkey, CASE WHEN p_size % 3 = 0 THEN concat(',"rank":', p_size) ELSE '' END, CASE WHEN p_size % 2 = 0 THEN concat(',"parent":"', p_brand, '"') ELSE '' END, '}') AS summary, p_size AS chunk_size, p_brand AS chunk_brand FROM part"""
)
def optional_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record that has optional keys only where they have values, and columns under a prefix."""
    row = F.struct(F.col("p_partkey").alias("chunk_id"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("rank"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("parent"))
    return read(spark, sf_dir, "part").select("p_partkey", F.to_json(row).alias("summary"), *(F.col(f"p_{c}").alias(f"chunk_{c}") for c in ("size", "brand")))


@R.add("SELECT event_id, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 110 ELSE 200 - (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 180 END, 6) AS y FROM events WINDOW w AS (PARTITION BY event_type)")
def scaled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values scaled between the least and the greatest of their condition; the ends come from one small aggregate."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    ends = e.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return e.join(ends, "event_type").select("event_id", F.round(checks.scaled(F.col("value"), F.col("low"), F.col("high"), 20.0, 200.0), 6).alias("y"))


COST_SQL = "CASE p_size % 4 WHEN 0 THEN '0.25' WHEN 1 THEN 'none' WHEN 2 THEN NULL ELSE concat('1', p_size) END"


@R.add(f"SELECT p_partkey, TRY_CAST({COST_SQL} AS DOUBLE) AS cost, trim(p_name) AS answer_text, concat('gen_', lower(p_brand)) AS model, CAST(p_size * 3 AS BIGINT) AS total_tokens FROM part")
def answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer records from raw replies: trimmed text, one token total, and a cost only where it is a number."""
    usage = F.col("p_size").cast("long")
    return read(spark, sf_dir, "part").select("p_partkey", F.expr(f"try_cast({COST_SQL} AS double)").alias("cost"), F.trim("p_name").alias("answer_text"), F.concat(F.lit("gen_"), F.lower("p_brand")).alias("model"), (usage + usage * 2).alias("total_tokens"))


@R.add(
    """SELECT d.doc_id, concat(source, '|', CASE WHEN quality IS NULL THEN 'unscored' WHEN quality = 1 THEN 'high' ELSE 'low' END) AS stratum, coalesce(quality::VARCHAR, '') AS judge_score, '' AS manual_score, '' AS manual_notes FROM documents d LEFT JOIN labels USING (doc_id)"""
)
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide audit rows with empty columns for the reviewer."""
    j = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    band = F.when(F.col("quality").isNull(), "unscored").when(F.col("quality") == 1, "high").otherwise("low")
    return j.select("doc_id", F.concat_ws("|", "source", band).alias("stratum"), F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("judge_score"), F.lit("").alias("manual_score"), F.lit("").alias("manual_notes"))


@R.add("SELECT l_orderkey AS doc, count(*) AS n_spans, CAST(min(l_partkey) AS BIGINT) AS first_start FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1")
def unit_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by document; units without a start have none."""
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_linenumber") != 3, F.col("l_partkey")).alias("start"))
    return s.where("start IS NOT NULL").groupBy("doc").agg(F.count(F.lit(1)).alias("n_spans"), F.min("start").alias("first_start"))


@R.add(
    """WITH e AS (SELECT o_custkey AS source, l_partkey AS target FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT source, target, count(*) AS n FROM e GROUP BY ALL ORDER BY source, target LIMIT 20"""
)
def edge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty edges by id, as the validation report shows them."""
    e = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("source")).join(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("target")), F.col("l_orderkey") == F.col("o_orderkey"))
    return e.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")).orderBy("source", "target").limit(20)


QUERIES, ORACLE_SQL = R.queries, R.sql
