"""The contract queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_lexicon, decontam, divergence, langid, license_scan, near_dedup, prefix_trie, pseudo_lm, quality_qda, quality_rules, sharding, simhash, url_rules
from .common import crc_mod, stash, table

#: The url rules the contract states.
URL_RULES = [
    url_rules.Rule("allow", "org", "/"),
    url_rules.Rule("block", "example.org", "/es/"),
    url_rules.Rule("block", "example.org", "/en/1"),
    url_rules.Rule("allow", "com", "/fr/"),
    url_rules.Rule("block", "com", "/de/"),
]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages``: host, path, the longest rule that fits and its verdict. Null urls have an empty host and path; repeated rows are judged each."""
    return url_rules.match_rules(table(spark, sf_dir, "pages"), URL_RULES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they hold. Null and empty texts hold none; an empty benchmark gives no rows."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and a prediction for every document, learnt from labels of documents that are not held out. Null and empty texts are scored like others."""
    rows = stash(quality_qda.measured(table(spark, sf_dir, "documents")), "statistics")
    held_out = crc_mod("doc_id", 4) == 2
    model = quality_qda.fit(rows.where(~held_out), table(spark, sf_dir, "labels"))
    scored = quality_qda.score(rows, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of what they decode to. A null text counts as empty."""
    docs = table(spark, sf_dir, "documents")
    lexicon = bpe_lexicon.build_lexicon(bpe_lexicon.count_words(docs), tokenizer_path())
    return bpe_lexicon.digests(bpe_lexicon.encode_decode(docs, lexicon))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts of every document. Null and empty texts measure nothing and fail."""
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"), "fail_bits",
    )


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summed log-probability of every document under a network trained on all of them."""
    return pseudo_lm.train_and_score(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the license templates they hold. Null and empty texts hold none."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of texts alike at 0.85 of three-word shingles. Texts without words are linked with nothing."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Plan.near(words=3, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for every document, learnt from those that are not held out. Texts that are null or without a letter are ``und``."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    model = langid.fit(docs.where(~held_out))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of eight of near equal bytes, and its slot there. Null texts have no bytes and still a slot."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component. Texts without words share the fingerprint zero."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.Plan(words=4, bits=4))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language stray from each other and from the language. Null values count as empty strings."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations. Rows without a conversation id belong to none."""
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each rule of the contract's policy: documents it fails, documents it alone rejects, and documents kept without it."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")


def url_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages each rule decides."""
    return url_rules.rule_counts(op1_url_rules(spark, sf_dir))


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and bytes of each shard."""
    return sharding.shard_totals(op10_sharding(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_rules, op2_decontamination, op3_quality_qda, op4_bpe_lexicon, op5_quality_rules,
        op6_pseudo_likelihood, op7_license_scan, op8_near_dedup, op9_language_id, op10_sharding, op11_simhash, op12_source_divergence,
        op13_prefix_trie, quality_ablations, url_rule_counts, shard_sizes,
    )
}

#: The rules of op1 as rows, longest last.
_OP1_RULES = ", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op1_url_rules": rf"""
WITH u AS (
  SELECT page_id,
    CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(rhost, rpath, action) AS (VALUES {_OP1_RULES}),
m AS (
  SELECT s.page_id, s.host, s.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM s LEFT JOIN r ON (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m""",
    "op5_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, g.i, g.w FROM (SELECT doc_id, regexp_extract_all(t, '[^ 	-
]+') AS ws FROM d) q,
      LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) g),
tri AS (SELECT doc_id, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o] AS g, lead(w, 2) OVER o AS last FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri WHERE last IS NOT NULL) q WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS i FROM twice, (VALUES (0), (1), (2)) v(k)) q GROUP BY 1),
stut AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w) q WHERE w = p GROUP BY 1),
wc AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) q WHERE regexp_matches(line, '[^ 	-
]') GROUP BY 1),
m AS (SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(stut.n, 0) AS n_stutters,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_bangs
      FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN stut USING (doc_id)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
        + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (10 * word_chars < 20 * n_words)::INT + 32 * (10 * word_chars > 150 * n_words)::INT
        + 64 * (100 * n_upper > 40 * word_chars)::INT + 128 * (100 * n_bangs > 30 * n_words)::INT + 256 * (100 * n_stutters > 30 * n_words)::INT
        + 512 * (n_words < 1)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b""",
    "op7_license_scan": license_scan.oracle_sql(),
    "op12_source_divergence": divergence.oracle_sql(),
    "op13_prefix_trie": prefix_trie.oracle_sql(),
    "op8_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS g FROM (SELECT * FROM w WHERE len(ws) > 0) q, unnest(generate_series(1, greatest(1, len(ws) - 2))) u(i)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY 1),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS class_id FROM n),
r AS (SELECT s.* FROM s JOIN c USING (doc_id) WHERE doc_id = class_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * both_n >= 85 * (a.n + b.n - both_n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
t AS (SELECT doc_id AS x, doc_id AS y FROM c WHERE doc_id = class_id UNION SELECT t.x, e.y FROM t JOIN e ON e.x = t.y),
m AS (SELECT x AS class_id, min(y) AS component_id FROM t GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(m.component_id, d.doc_id) AS kept, coalesce(c.class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (class_id)""",
}

_RULE_ROWS = ", ".join(f"({b}, '{quality_rules.RULES[b][0]}')" for b in quality_rules.POLICIES["v1"])
ORACLE_SQL |= {
    "quality_ablations": f"""WITH e AS ({ORACLE_SQL["op5_quality_rules"]}), b AS (SELECT fail_bits & {quality_rules.mask_of("v1")} AS bits FROM e), r(bit, rule) AS (VALUES {_RULE_ROWS})
SELECT bit, rule, count(CASE WHEN bits & (1::BIGINT << bit) <> 0 THEN 1 END) AS n_failed, count(CASE WHEN bits = 1::BIGINT << bit THEN 1 END) AS n_only, count(CASE WHEN bits & ~(1::BIGINT << bit) = 0 THEN 1 END) AS n_kept_without FROM b, r GROUP BY ALL""",
    "url_rule_counts": f"SELECT rule, verdict, count(*) AS n_urls FROM ({ORACLE_SQL['op1_url_rules']}) q GROUP BY ALL",
    "shard_sizes": """WITH s AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size FROM documents),
c AS (SELECT size, (2 * coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size) * 8 // (2 * sum(size) OVER ()) AS shard FROM s)
SELECT CAST(least(shard, 7) AS INT) AS shard, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS n_bytes FROM c GROUP BY 1""",
}
