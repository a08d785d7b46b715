"""Paired statistics over ``events``: an event type is a condition, a user a query, the mean value of a user the score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, ordering, pvalues, sampling, stats
from .registry import Registry, read

R = Registry()
BASE = "view"

SCORES_SQL = "scores AS (SELECT event_type, user_id, round(avg(value), 6) AS score FROM events GROUP BY ALL)"
PAIRS_SQL = f"{SCORES_SQL}, pairs AS (SELECT a.event_type AS condition, a.user_id, a.score, b.score AS base, a.score - b.score AS d FROM scores a JOIN scores b USING (user_id) WHERE b.event_type = '{BASE}' AND a.event_type <> '{BASE}')"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("score"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    base = s.where(F.col("event_type") == BASE).select("user_id", F.col("score").alias("base"))
    joined = s.where(F.col("event_type") != BASE).join(base, "user_id")
    return joined.select(F.col("event_type").alias("condition"), "user_id", "score", "base", (F.col("score") - F.col("base")).alias("d"))


WILCOXON_SQL = f"""{PAIRS_SQL}, nz AS (SELECT condition, round(d, 12) AS d FROM pairs WHERE round(d, 12) <> 0),
r AS (SELECT condition, d, rank() OVER (PARTITION BY condition ORDER BY abs(d)) + (count(*) OVER (PARTITION BY condition, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY condition, abs(d)) AS t FROM nz),
w AS (SELECT condition, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS wm, sum(t * t - 1) AS ties FROM r GROUP BY 1),
wz AS (SELECT condition, n, wp, wm, (wp - wm) / (n * (n + 1) / 2) AS rb, (least(wp, wm) - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0) AS z FROM w)"""


@R.add(f"WITH {WILCOXON_SQL} SELECT condition, n, round(wp, 6) AS w_plus, round(wm, 6) AS w_minus, round(rb, 6) AS rank_biserial, round(z, 6) AS z FROM wz")
def wilcoxon_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.wilcoxon(pairs(spark, sf_dir), "d", "condition")
    return found.select("condition", "n", *(F.round(c, 6).alias(c) for c in ("w_plus", "w_minus", "rank_biserial", "z")))


FRIEDMAN_SQL = f"""{SCORES_SQL}, full_blocks AS (SELECT user_id FROM scores GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT event_type) FROM scores)),
r AS (SELECT event_type, rank() OVER (PARTITION BY user_id ORDER BY score) + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2 AS r, count(*) OVER (PARTITION BY user_id, score) AS t FROM scores SEMI JOIN full_blocks USING (user_id)),
c AS (SELECT event_type, sum(r) AS rj, count(*) AS n, sum(t * t - 1) AS ties FROM r GROUP BY 1), s AS (SELECT n, count(*) AS k, sum(rj * rj) AS sq, sum(ties) AS ties FROM c GROUP BY 1),
x AS (SELECT n, k, (12 / (n * k * (k + 1)) * sq - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS chi FROM s)"""


@R.add(f"WITH {FRIEDMAN_SQL} SELECT n, k, round(chi, 6) AS chi_squared, round(chi / (n * (k - 1)), 6) AS kendall_w FROM x")
def friedman(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.friedman(scores(spark, sf_dir), "user_id", "event_type", "score")
    return found.select("n", "k", F.round("chi_squared", 6).alias("chi_squared"), F.round("kendall_w", 6).alias("kendall_w"))


@R.add(
    f"""WITH {WILCOXON_SQL}, p AS (SELECT condition AS test, exp(-abs(z)) AS p FROM wz), s AS (SELECT test, p, (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) * p AS step FROM p)
SELECT test, round(p, 9) AS p, round(least(1.0, max(step) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM s"""
)
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjustment of one number per condition; exp(-|z|) stands for a p-value, since SQL lacks the error function."""
    found = stats.wilcoxon(pairs(spark, sf_dir), "d", "condition").select(F.col("condition").alias("test"), F.exp(-F.abs("z")).alias("p"))
    return stats.holm(found, "p").select("test", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


@R.add(
    """WITH j AS (SELECT lang, n_chars, quality + toxic * 0.5 AS q FROM documents JOIN labels USING (doc_id)),
r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS rx, rank() OVER (PARTITION BY lang ORDER BY q) + (count(*) OVER (PARTITION BY lang, q) - 1) / 2 AS ry FROM j)
SELECT lang, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1"""
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return stats.spearman(j.withColumn("q", F.col("quality") + F.col("toxic") * 0.5), "n_chars", "q", "lang").select("lang", "n", F.round("rho", 6).alias("rho"))


DRAWS = 10_000
#: Draw i of place j takes the row that a hash of both points to; a condition has less than one block of rows here.
DRAWN_SQL = f"""pl AS (SELECT condition, d, row_number() OVER (PARTITION BY condition ORDER BY user_id) - 1 AS place, count(*) OVER (PARTITION BY condition) AS n FROM pairs),
hd AS (SELECT draw, h FROM {bootstrap.mix_sql(f"(SELECT i AS draw, i AS h FROM range(1, {DRAWS} + 1) g(i))", "h")} q),
hp AS (SELECT condition, n, h FROM {bootstrap.mix_sql("(SELECT condition, n, place AS h FROM pl)", "h")} q),
dr AS (SELECT condition, draw, h % n AS place FROM {bootstrap.mix_sql("(SELECT hp.condition, hp.n, hd.draw, xor(hd.h, hp.h) AS h FROM hp, hd)", "h")} q),
me AS (SELECT condition, draw, round(avg(d), 9) AS mean FROM dr JOIN pl USING (condition, place) GROUP BY ALL),
ci AS (SELECT condition, list_sort(list(mean)) AS l FROM me GROUP BY 1)"""


@R.add(
    f"""WITH {PAIRS_SQL}, m AS (SELECT condition, count(*) AS n, avg(d) AS mean_d, median(d) AS median_d, avg(base) AS mean_base FROM pairs GROUP BY 1), {DRAWN_SQL}
SELECT condition, n, round(mean_d, 6) AS mean_difference, round(median_d, 6) AS median_difference, round(mean_d / nullif(mean_base, 0), 6) AS relative_difference, round(l[250], 6) AS ci_low, round(l[9750], 6) AS ci_high FROM m JOIN ci USING (condition)"""
)
def paired_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    means = p.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("m"), F.avg("base").alias("b"))
    middle = ordering.quantiles(p, "d", {"md": 0.5}, "condition")
    ci = bootstrap.interval(p, "user_id", "d", "condition", draws=DRAWS)
    return means.join(middle, "condition").join(ci, "condition").select(
        "condition", "n", F.round("m", 6).alias("mean_difference"), F.round("md", 6).alias("median_difference"), F.round(F.col("m") / F.nullif(F.col("b"), F.lit(0.0)), 6).alias("relative_difference"),
        F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"),
    )


BAND_SQL = "CASE WHEN score < 10 THEN 'low' WHEN score < 20 THEN 'mid' ELSE 'high' END"


@R.add(
    f"""WITH {SCORES_SQL}, b AS (SELECT event_type, user_id, concat(event_type, '|', {BAND_SQL}) AS stratum FROM scores), z AS (SELECT stratum, count(*) AS n FROM b GROUP BY 1),
e AS (SELECT stratum, n, n * 60 / sum(n) OVER () AS x, floor(n * 60 / sum(n) OVER ()) AS f FROM z),
s AS (SELECT stratum, f + CASE WHEN row_number() OVER (ORDER BY round(x - f, 9) DESC, n DESC, stratum DESC) <= 60 - sum(f) OVER () THEN 1 ELSE 0 END AS share FROM e)
SELECT b.stratum, user_id FROM b JOIN s USING (stratum) QUALIFY row_number() OVER (PARTITION BY b.stratum ORDER BY md5(concat('42|', b.stratum, '|', user_id)), user_id) <= share"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty rows over condition and band by largest remainder, picked by a seeded hash."""
    from pyspark.sql import Window as W

    b = scores(spark, sf_dir).select("user_id", F.concat_ws("|", "event_type", F.expr(BAND_SQL)).alias("stratum"))
    shares = stats.largest_remainder(b.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), "n", 60)
    place = F.row_number().over(W.partitionBy("stratum").orderBy(F.md5(F.concat_ws("|", F.lit("42"), "stratum", F.col("user_id").cast("string"))), "user_id"))
    return b.join(shares, "stratum").withColumn("place", place).where("place <= share").select("stratum", "user_id")


AUDIT_SIZE = 47


@R.add(
    f"""WITH {SCORES_SQL}, b AS (SELECT event_type AS condition, user_id, {BAND_SQL} AS band FROM scores), z AS (SELECT condition, band, count(*) AS n FROM b GROUP BY ALL),
c AS (SELECT condition, sum(n) AS n, sum(CASE WHEN band <> 'high' THEN n ELSE 0 END) AS rare FROM z GROUP BY 1),
r AS (SELECT *, {AUDIT_SIZE} * n / sum(n) OVER () AS raw FROM c), f AS (SELECT *, floor(raw) AS fl FROM r),
t AS (SELECT condition, fl + (row_number() OVER (ORDER BY raw - fl DESC, rare DESC, n DESC, condition DESC) <= {AUDIT_SIZE} - sum(fl) OVER ())::INT AS target FROM f),
g AS (SELECT z.*, target, count(*) OVER o AS bands, n - 1 AS free, sum(n - 1) OVER o AS all_free, row_number() OVER (PARTITION BY condition ORDER BY n, band) AS smallest FROM z JOIN t USING (condition) WINDOW o AS (PARTITION BY condition)),
h AS (SELECT *, CASE WHEN all_free > 0 THEN greatest(target - bands, 0) ELSE 0 END AS rest, CASE WHEN all_free > 0 THEN greatest(target - bands, 0) * free / all_free ELSE 0 END AS raw FROM g),
a AS (SELECT *, least(free, floor(raw)) AS added FROM h),
w AS (SELECT *, row_number() OVER (PARTITION BY condition, added < free ORDER BY raw - added DESC, free DESC, band DESC) AS place, rest - sum(added) OVER (PARTITION BY condition) AS remaining FROM a),
s AS (SELECT condition, band, CASE WHEN bands > target THEN (smallest <= target)::INT ELSE 1 + added + (added < free AND place <= remaining)::INT END AS share FROM w)
SELECT condition, band, user_id FROM b JOIN s USING (condition, band) QUALIFY row_number() OVER (PARTITION BY condition, band ORDER BY md5(concat('42|', condition, '|', user_id))) <= share"""
)
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to look at by hand: so many by condition, and of each band at least one."""
    b = scores(spark, sf_dir).select(F.col("event_type").alias("condition"), "user_id", F.expr(BAND_SQL).alias("band"))
    shares = sampling.allocation(b.groupBy("condition", "band").agg(F.count(F.lit(1)).alias("n")), AUDIT_SIZE)
    return sampling.picked(b, shares, F.concat_ws("|", F.lit("42"), "condition", F.col("user_id").cast("string")), "condition", "band").select("condition", "band", "user_id")


#: Contrasts that cite are confirmatory only where at least so many queries are eligible.
LEAST_ELIGIBLE = 20


@R.add(
    f"""WITH {WILCOXON_SQL}, e AS (SELECT event_type AS condition, count(DISTINCT user_id) AS n_eligible FROM events WHERE value > 90 GROUP BY 1),
f AS (SELECT wz.condition AS test, coalesce(n_eligible, 0) AS n_eligible, coalesce(n_eligible, 0) >= {LEAST_ELIGIBLE} AS allowed, exp(-abs(z)) AS p FROM wz LEFT JOIN e USING (condition)),
s AS (SELECT *, (count(*) OVER (PARTITION BY allowed) - row_number() OVER (PARTITION BY allowed ORDER BY p, test) + 1) * p AS step FROM f)
SELECT test, n_eligible, CASE WHEN allowed THEN 'confirmatory' ELSE 'exploratory' END AS family, round(p, 9) AS p,
 CASE WHEN allowed THEN round(least(1.0, max(step) OVER (PARTITION BY allowed ORDER BY p, test ROWS UNBOUNDED PRECEDING)), 9) END AS p_holm FROM s"""
)
def contrast_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrasts move from the confirmatory family to the exploratory one where too few queries are eligible; only the former are adjusted, among themselves."""
    found = stats.wilcoxon(pairs(spark, sf_dir), "d", "condition").select(F.col("condition").alias("test"), F.exp(-F.abs("z")).alias("p"))
    eligible = read(spark, sf_dir, "events").where("value > 90").groupBy(F.col("event_type").alias("test")).agg(F.count_distinct("user_id").alias("n_eligible"))
    tests = found.join(eligible, "test", "left").fillna(0, "n_eligible")
    return stats.families(tests, F.col("n_eligible") >= LEAST_ELIGIBLE, "p").select("test", "n_eligible", "family", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


@R.add("SELECT event_type, min(value) AS lowest, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS highest FROM events GROUP BY 1")
def boxplot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    ends = events.groupBy("event_type").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))
    return ends.join(ordering.quantiles(events, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "event_type"), "event_type").select("event_type", "lowest", "q1", "median", "q3", "highest")


@R.add(f"WITH {PAIRS_SQL} SELECT condition, count(CASE WHEN d > 0 THEN 1 END) AS better, count(CASE WHEN d < 0 THEN 1 END) AS worse, count(CASE WHEN d = 0 THEN 1 END) AS tied, round(median(d), 6) AS median_difference FROM pairs GROUP BY 1")
def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    counts = p.groupBy("condition").agg(F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"), F.count_if(F.col("d") == 0).alias("tied"))
    return counts.join(ordering.quantiles(p, "d", {"m": 0.5}, "condition"), "condition").select("condition", "better", "worse", "tied", F.round("m", 6).alias("median_difference"))


@R.add("SELECT event_type, bin, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM (SELECT event_type, CAST(floor(ln(greatest(value, 0.01)) * 2) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL) q")
def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    binned = read(spark, sf_dir, "events").groupBy("event_type", F.floor(F.ln(F.greatest("value", F.lit(0.01))) * 2).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return binned.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("event_type")), 6))


@R.add()
def contrast_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank tests with p-values, Holm within the family, and bootstrap intervals of the mean difference."""
    p = pairs(spark, sf_dir)
    tests = stats.holm(pvalues.signed_rank_tests(p, "d", "condition").withColumnRenamed("condition", "test"), "p")
    return tests.join(bootstrap.interval(p, "user_id", "d", "condition", draws=DRAWS).withColumnRenamed("condition", "test"), "test")


#: With five conditions the tail has four degrees of freedom, which is a finite sum.
@R.add(f"WITH {FRIEDMAN_SQL} SELECT n, k, round(chi, 6) AS chi_squared, round(chi / (n * (k - 1)), 6) AS kendall_w, round(exp(-chi / 2) * (1 + chi / 2), 9) AS p FROM x WHERE k = 5")
def omnibus_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pvalues.friedman_p(stats.friedman(scores(spark, sf_dir), "user_id", "event_type", "score"))
    return found.select("n", "k", F.round("chi_squared", 6).alias("chi_squared"), F.round("kendall_w", 6).alias("kendall_w"), F.round("p", 9).alias("p"))


QUERIES, ORACLE_SQL = R.queries, R.sql
