"""Unit trees, citation edges and token-budgeted contexts over the star schema and ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ordering
from .registry import Registry, read

R = Registry()


@R.add(
    """WITH RECURSIVE t AS (SELECT concat('r', r_regionkey) AS id, NULL AS parent FROM region UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM customer),
a AS (SELECT id AS unit_id, parent AS ancestor, 1 AS depth FROM t WHERE parent IS NOT NULL UNION ALL SELECT a.unit_id, t.parent, a.depth + 1 FROM a JOIN t ON t.id = a.ancestor WHERE t.parent IS NOT NULL)
SELECT unit_id, ancestor, depth FROM a"""
)
def tree_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with its ancestors."""
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return ancestors(r.unionByName(n).unionByName(c))


def ancestors(tree: DataFrame, deepest: int = 64) -> DataFrame:
    """``unit_id, ancestor, depth`` of a tree of any depth (``id, parent``): a join a level, until no row is added. A longer way up is an error, since it is a circle."""
    tree = tree.where("parent is not null").select("id", "parent")
    level = tree.select(F.col("id").alias("unit_id"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    out = level
    for depth in range(2, deepest + 1):
        level = level.join(tree, F.col("ancestor") == F.col("id")).select("unit_id", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"a unit has more than {deepest} ancestors")


@R.add("SELECT c_custkey, concat_ws(' > ', r_name, n_name, c_name) AS breadcrumb FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def tree_breadcrumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.select("c_custkey", F.concat_ws(" > ", "r_name", "n_name", "c_name").alias("breadcrumb"))


@R.add("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def leaf_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a child of one type: a pending order."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return read(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@R.add("SELECT n_nationkey, n_name, string_agg(c_custkey::VARCHAR, ';' ORDER BY c_custkey) AS children, count(*) AS n_children FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def parent_child_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_nationkey", "n_name").agg(F.array_join(F.array_sort(F.collect_list("c_custkey")), ";").alias("children"), F.count(F.lit(1)).alias("n_children"))


@R.add(
    """WITH base AS (SELECT o_orderkey AS query_id, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders),
own AS (SELECT query_id, query_id AS unit, rank, 0 AS prio FROM base), hop AS (SELECT DISTINCT query_id, l_partkey AS unit, rank, 1 AS prio FROM base JOIN lineitem ON l_orderkey = query_id JOIN part ON p_partkey = l_partkey),
par AS (SELECT query_id, 1000000 + o_custkey AS unit, rank, 2 AS prio FROM base JOIN orders ON o_orderkey = query_id), a AS (SELECT * FROM own UNION ALL SELECT * FROM hop UNION ALL SELECT * FROM par)
SELECT query_id, unit, CAST(min(prio) AS INTEGER) AS priority FROM a GROUP BY ALL"""
)
def xref_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base units, then units they cite, then parents; the first way a unit is reached counts."""
    base = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), "o_custkey")
    cited = base.join(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("query_id"))
    cited = cited.join(read(spark, sf_dir, "part").select("p_partkey"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    every = (
        base.select("query_id", F.col("query_id").alias("unit"), F.lit(0).alias("priority"))
        .unionByName(cited.select("query_id", F.col("l_partkey").alias("unit"), F.lit(1).alias("priority")))
        .unionByName(base.select("query_id", (F.col("o_custkey") + 1_000_000).alias("unit"), F.lit(2).alias("priority")))
    )
    return every.groupBy("query_id", "unit").agg(F.min("priority").alias("priority"))


@R.add("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = o_orderkey AND l_quantity > 40) AS has_incoming FROM orders")
def gold_incoming_xref(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("o_orderkey")).distinct().withColumn("has_incoming", F.lit(True))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(targets, "o_orderkey", "left").fillna({"has_incoming": False})


@R.add("SELECT n_name, count(DISTINCT o_custkey) AS n_sources, count(*) AS n_edges, count(CASE WHEN l_partkey % 5 = 0 THEN 1 END) AS n_external FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, o, li = (read(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem"))
    named = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    j = li.select("l_orderkey", "l_partkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(named, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("n_name").agg(F.count_distinct("o_custkey").alias("n_sources"), F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("l_partkey") % 5 == 0).alias("n_external"))


BUDGET, POOL = 4000, 50
CANDIDATES_SQL = f"c AS (SELECT source, doc_id, n_chars // 4 AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents QUALIFY n <= {POOL})"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty candidates of each source, in order; fifty is the pool of the packing itself."""
    n = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return read(spark, sf_dir, "documents").select("source", "doc_id", F.expr("n_chars div 4").alias("tokens"), n.alias("n")).where(F.col("n") <= POOL)


def pack(ordered: Column, budget: int) -> Column:
    """Greedy packing as a fold: a candidate that does not fit is passed over, later ones are still tried."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(state: Column, c: Column) -> Column:
        fits = state["used"] + c["tokens"] <= budget
        return F.struct(F.when(fits, state["used"] + c["tokens"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["taken"], F.array(c["doc_id"]))).otherwise(state["taken"]).alias("taken"))

    return F.aggregate(ordered, start, step)


@R.add(
    f"""WITH RECURSIVE {CANDIDATES_SQL}, p AS (SELECT source, n, CASE WHEN tokens <= {BUDGET} THEN tokens ELSE 0 END AS used, CASE WHEN tokens <= {BUDGET} THEN doc_id::VARCHAR ELSE '' END AS taken FROM c WHERE n = 1
 UNION ALL SELECT c.source, c.n, CASE WHEN p.used + c.tokens <= {BUDGET} THEN p.used + c.tokens ELSE p.used END, CASE WHEN p.used + c.tokens <= {BUDGET} THEN concat(p.taken, CASE WHEN p.taken = '' THEN '' ELSE ';' END, c.doc_id) ELSE p.taken END FROM p JOIN c ON c.source = p.source AND c.n = p.n + 1)
SELECT source, CAST(used AS BIGINT) AS used, taken FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC) = 1"""
)
def context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("n", "doc_id", "tokens")))
    packed = candidates(spark, sf_dir).groupBy("source").agg(ordered.alias("c")).select("source", pack(F.col("c"), BUDGET).alias("p"))
    return packed.select("source", F.col("p.used").alias("used"), F.array_join("p.taken", ";").alias("taken"))


@R.add(
    f"""WITH {CANDIDATES_SQL}, s AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY n) AS total FROM c)
SELECT source, n AS n_chunks, CAST(total AS BIGINT) AS total, round(abs(total - 3000) / 3000, 6) AS relative_error FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(total - 3000), n DESC) = 1"""
)
def volume_matched_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix of candidates whose volume is closest to 3000; a tie keeps the longer one."""
    total = F.sum("tokens").over(W.partitionBy("source").orderBy("n"))
    s = candidates(spark, sf_dir).withColumn("total", total).withColumn("off", F.abs(F.col("total") - 3000))
    best = s.groupBy("source").agg(F.min_by(F.struct("n", "total", "off"), F.struct("off", -F.col("n"))).alias("b"))
    return best.select("source", F.col("b.n").cast("long").alias("n_chunks"), F.col("b.total").alias("total"), F.round(F.col("b.off") / 3000, 6).alias("relative_error"))


@R.add("SELECT source, quantile_cont(n_chars, 0.95) AS p95, CAST(round_even(quantile_cont(n_chars, 0.95) / 500, 0) * 500 AS BIGINT) AS budget FROM documents GROUP BY 1")
def budget_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ordering.quantiles(read(spark, sf_dir, "documents"), "n_chars", {"p95": 0.95}, "source")
    return p.select("source", "p95", (F.bround(F.col("p95") / 500) * 500).cast("long").alias("budget"))


@R.add(
    """WITH m AS (SELECT lang, source, avg(n_chars) AS a FROM documents GROUP BY ALL), r AS (SELECT lang, source, abs(a - 2400) / 2400 AS e FROM m)
SELECT lang, round(max(e), 6) AS max_error, round(avg(e), 6) AS mean_error, coalesce(string_agg(CASE WHEN e > 0.5 THEN source END, ';' ORDER BY source), '') AS offenders FROM r GROUP BY 1"""
)
def volume_match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "documents").groupBy("lang", "source").agg((F.abs(F.avg("n_chars") - 2400) / 2400).alias("e"))
    return e.groupBy("lang").agg(F.round(F.max("e"), 6).alias("max_error"), F.round(F.avg("e"), 6).alias("mean_error"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("e") > 0.5, F.col("source")))), ";").alias("offenders"))


@R.add("SELECT source, string_agg(doc_id::VARCHAR, ';' ORDER BY doc_id) AS gold, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY 1")
def gold_reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a source's documents as one ordered list, as gold sets are stated."""
    d = read(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ";").alias("gold"), F.sum("n_chars").alias("total"))


QUERIES, ORACLE_SQL = R.queries, R.sql
