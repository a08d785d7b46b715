"""Scalar text operators, identifiers, citations, HTML and judge output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import Registry, read

R = Registry()
#: The white space of ``functions.text.SPACES`` in RE2's notation.
SPACES_SQL = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def clean_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACES_SQL}', ' ', 'g'))"


@R.add(f"SELECT doc_id, sha256({clean_sql('text')}) AS text_sha256, CAST(length({clean_sql('text')}) AS BIGINT) AS n_chars FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").cast("long").alias("n_chars"))


#: Labels made from part keys: articles with paragraphs, and recitals.
LABEL_SQL = "CASE WHEN p_partkey % 3 = 0 THEN concat('B Rec. ', p_size) WHEN p_partkey % 3 = 1 THEN concat('RI Art. ', p_size, '.', p_partkey % 7) ELSE concat('E Art. ', p_size, 'a') END"


@R.add(
    f"""WITH l AS (SELECT p_partkey, {LABEL_SQL} AS label FROM part), x AS (SELECT *, regexp_extract(label, '^([A-Z]+) (Art|Rec)\\. ([0-9A-Za-z.]+)$', 2) AS kind, regexp_extract(label, '^([A-Z]+) (Art|Rec)\\. ([0-9A-Za-z.]+)$', 3) AS number FROM l)
SELECT p_partkey, label, concat(split_part(label, ' ', 1), ' ', kind, '. ', CASE kind WHEN 'Art' THEN split_part(number, '.', 1) ELSE number END) AS answer_unit,
 split_part(label, ' ', 1) AS document_code, concat('cfg_', trim(regexp_replace(label, '[^0-9A-Za-z]+', '_', 'g'), '_')) AS chunk_id FROM x"""
)
def label_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr(LABEL_SQL)
    rows = read(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    return rows.select("p_partkey", "label", T.answer_unit(F.col("label")).alias("answer_unit"), T.source_document(F.col("label")).alias("document_code"), T.chunk_id(F.lit("cfg"), F.col("label")).alias("chunk_id"))


@R.add(
    """SELECT p_partkey, concat('[', p_size, '] Reference: ', p_name, chr(10), p_type) AS passage, trim(regexp_replace(concat_ws(' ', nullif(p_brand, ''), nullif(p_type, '')), '\\s+', ' ', 'g')) AS joined,
 concat(p_name, ': ', p_type) AS unit_label, array_to_string(list_filter([trim(x) FOR x IN string_split(concat(p_brand, ' , ,', p_type), ',')], lambda x: x <> ''), ';') AS items FROM part"""
)
def rendered_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        T.passage(F.col("p_size"), F.col("p_name"), F.col("p_type")).alias("passage"),
        T.joined(F.col("p_brand"), F.col("p_type")).alias("joined"),
        F.concat("p_name", F.lit(": "), "p_type").alias("unit_label"),
        F.array_join(T.csv_list(F.concat("p_brand", F.lit(" , ,"), "p_type")), ";").alias("items"),
    )


@R.add(
    """SELECT conv_id, turn, concat('{"role":"', role, '"}') AS head, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256,
 CASE WHEN starts_with(role, 'user') THEN 'question' WHEN starts_with(role, 'assistant') THEN 'answer' ELSE 'other' END AS kind FROM conversations"""
)
def rendered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.to_json(F.struct("role")).alias("head"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"),
        F.when(F.startswith("role", F.lit("user")), "question").when(F.startswith("role", F.lit("assistant")), "answer").otherwise("other").alias("kind"),
    )


#: A sentence with a list of articles, a single article, a paragraph and a recital.
CITING_SQL = "concat('See Articles ', p_size, ' and ', p_size + 1, ' or Article ', p_partkey % 9 + 1, '(2) and recital ', p_size % 11, CASE WHEN p_partkey % 4 = 0 THEN ' of Directive 2000/31' ELSE '' END)"
LIST, SINGLE, RECITAL, EXTERNAL = r"Articles ([0-9]+) and ([0-9]+)", r"Article ([0-9]+)", r"recital ([0-9]+)", r"(?:Directive|Convention|Treaty) [0-9]+"


@R.add(
    f"""WITH c AS (SELECT p_partkey, {CITING_SQL} AS t FROM part),
f AS (SELECT p_partkey, 1 AS ord, 'list' AS kind, regexp_extract(t, '{LIST}', 1) AS number FROM c UNION ALL SELECT p_partkey, 2, 'list', regexp_extract(t, '{LIST}', 2) FROM c
 UNION ALL SELECT p_partkey, 3, 'single', unnest(regexp_extract_all(t, '{SINGLE}', 1)) FROM c UNION ALL SELECT p_partkey, 4, 'recital', unnest(regexp_extract_all(t, '{RECITAL}', 1)) FROM c)
SELECT p_partkey, kind, number, concat('P ', CASE kind WHEN 'recital' THEN 'Rec. ' ELSE 'Art. ' END, number) AS unit FROM f"""
)
def citation_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists first, then singles outside them, then recitals."""
    t = F.col("t")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr(CITING_SQL).alias("t"))
    families = F.flatten(
        F.array(
            F.transform(F.array(F.regexp_extract(t, LIST, 1), F.regexp_extract(t, LIST, 2)), lambda n: F.struct(F.lit("list").alias("kind"), n.alias("number"))),
            F.transform(F.regexp_extract_all(t, F.lit(SINGLE), 1), lambda n: F.struct(F.lit("single").alias("kind"), n.alias("number"))),
            F.transform(F.regexp_extract_all(t, F.lit(RECITAL), 1), lambda n: F.struct(F.lit("recital").alias("kind"), n.alias("number"))),
        )
    )
    found = rows.select("p_partkey", F.explode(families).alias("f")).select("p_partkey", "f.kind", "f.number")
    return found.withColumn("unit", F.concat(F.lit("P "), F.when(F.col("kind") == "recital", "Rec. ").otherwise("Art. "), "number"))


@R.add(
    f"""WITH c AS (SELECT p_partkey, p_size, {CITING_SQL} AS t FROM part),
cited AS (SELECT DISTINCT p_partkey, n::INT AS n FROM (SELECT p_partkey, unnest(list_concat([regexp_extract(t, '{LIST}', 1), regexp_extract(t, '{LIST}', 2)], regexp_extract_all(t, '{SINGLE}', 1))) AS n FROM c) q),
g AS (SELECT p_partkey, unnest([p_size, p_size + 2]) AS n FROM part),
j AS (SELECT p_partkey, count(c.n) AS cited, count(g.n) AS gold, count(CASE WHEN c.n IS NOT NULL AND g.n IS NOT NULL THEN 1 END) AS n_both FROM cited c FULL JOIN g USING (p_partkey, n) GROUP BY 1)
SELECT p_partkey, round(n_both / cited, 6) AS precision, round(n_both / gold, 6) AS recall, round(CASE WHEN n_both > 0 THEN 2.0 * n_both / (cited + gold) ELSE 0 END, 6) AS f1, cited - n_both AS n_extra, gold - n_both AS n_missing FROM j"""
)
def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(CITING_SQL).alias("t"))
    numbers = F.concat(F.array(F.regexp_extract(t, LIST, 1), F.regexp_extract(t, LIST, 2)), F.regexp_extract_all(t, F.lit(SINGLE), 1))
    pairs = rows.select("p_partkey", F.array_distinct(numbers.cast("array<int>")).alias("cited"), F.expr("array(cast(p_size AS int), cast(p_size + 2 AS int))").alias("gold"))
    both, cited, gold = (x.cast("long") for x in (F.size(F.array_intersect("cited", "gold")), F.size("cited"), F.size("gold")))
    return pairs.select(
        "p_partkey", F.round(both / cited, 6).alias("precision"), F.round(both / gold, 6).alias("recall"),
        F.round(F.when(both > 0, 2.0 * both / (cited + gold)).otherwise(0.0), 6).alias("f1"), (cited - both).alias("n_extra"), (gold - both).alias("n_missing"),
    )


@R.add(
    f"""WITH c AS (SELECT p_partkey, p_size, p_partkey % 9 + 1 AS single, {CITING_SQL} AS t FROM part),
k AS (SELECT p_partkey, unnest([p_size, p_size + 1, single]) AS target, unnest(['list_expanded', 'list_expanded', 'single']) AS kind FROM c WHERE NOT regexp_matches(t, '{EXTERNAL}')),
s AS (SELECT p_partkey % 50 + 1 AS source, target, kind FROM k)
SELECT source::BIGINT AS source, target::BIGINT AS target, kind, count(*) AS n FROM s WHERE source <> target AND target <= 50 GROUP BY ALL"""
)
def xref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations as edges: texts that name another instrument are left out, self-references and unknown targets dropped, equal edges counted once each."""
    t = F.col("t")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr(CITING_SQL).alias("t")).where(~t.rlike(EXTERNAL))
    listed = F.transform(F.array(F.regexp_extract(t, LIST, 1), F.regexp_extract(t, LIST, 2)), lambda n: F.struct(n.cast("long").alias("target"), F.lit("list_expanded").alias("kind")))
    single = F.transform(F.regexp_extract_all(t, F.lit(SINGLE), 1), lambda n: F.struct(n.cast("long").alias("target"), F.lit("single").alias("kind")))
    found = rows.select((F.col("p_partkey") % 50 + 1).cast("long").alias("source"), F.explode(F.concat(listed, single)).alias("e")).select("source", "e.target", "e.kind")
    return found.where("source <> target and target <= 50").groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    r"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?is)<p\b[^>]*>.*?</p>')) AS p FROM pages),
c AS (SELECT page_id, regexp_extract(p, '(?is)^<p\b[^>]*class="([^"]*)"', 1) AS class, trim(regexp_replace(regexp_replace(p, '(?is)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS t FROM p)
SELECT page_id, class, count(*) AS n_paragraphs, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM c WHERE t <> '' GROUP BY ALL"""
)
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with their classes; what stands in scripts and styles is not text, and empty paragraphs are dropped."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<script\b.*?</script>", ""), r"(?is)<style\b.*?</style>", "")
    p = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(bare, F.lit(r"(?is)<p\b[^>]*>.*?</p>"), 0)).alias("p"))
    text = F.trim(F.regexp_replace(F.regexp_replace("p", r"(?is)<[^>]*>", ""), r"\s+", " "))
    kind = F.regexp_extract("p", r"(?is)^<p\b[^>]*class=\"([^\"]*)\"", 1)
    return p.select("page_id", kind.alias("class"), text.alias("t")).where("t <> ''").groupBy("page_id", "class").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.sum(F.length("t")).alias("n_chars"))


JUDGED_SQL = """CASE label % 4 WHEN 0 THEN concat('```json', chr(10), '{"score": 0.', label % 10, ', "abstains": false}', chr(10), '```') WHEN 1 THEN concat('Verdict: {"score": 0.5, "abstains": true, "justified": true} end')
 WHEN 2 THEN '{"score": "high"}' ELSE concat('no json ', label) END"""


@R.add(
    rf"""WITH j AS (SELECT vec_id, {JUDGED_SQL} AS raw FROM embeddings), o AS (SELECT vec_id, regexp_extract(raw, '(?s)\{{.*\}}') AS body FROM j),
p AS (SELECT vec_id, body <> '' AS found, CASE WHEN body <> '' THEN json_type(body, '$.score') END AS kind, CASE WHEN body <> '' THEN TRY_CAST(json_extract_string(body, '$.score') AS DOUBLE) END AS score,
 CASE WHEN body <> '' THEN json_extract_string(body, '$.abstains') END AS abstains FROM o)
SELECT vec_id, CASE WHEN NOT found THEN 'no_object' WHEN kind IS NULL OR kind = 'VARCHAR' THEN 'score_type' WHEN score < 0 OR score > 1 THEN 'score_range' WHEN abstains IS NULL THEN 'abstains_missing' ELSE 'ok' END AS verdict,
 CASE WHEN kind <> 'VARCHAR' THEN round(score, 6) END AS score FROM p"""
)
def judge_json_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object inside a judge's reply, with fences and prose around it, checked field by field."""
    body = F.regexp_extract("raw", r"(?s)\{.*\}", 0)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.expr(JUDGED_SQL.replace("chr(10)", "'\\n'")).alias("raw")).select("vec_id", F.try_parse_json(F.nullif(body, F.lit(""))).alias("v"))
    kind, score = F.schema_of_variant(F.try_variant_get("v", "$.score", "variant")), F.try_variant_get("v", "$.score", "double")
    fields = rows.select("vec_id", F.col("v").isNotNull().alias("found"), kind.alias("kind"), score.alias("score"), F.try_variant_get("v", "$.abstains", "boolean").alias("abstains"))
    verdict = (
        F.when(~F.col("found"), "no_object").when(F.col("kind").isNull() | (F.col("kind") == "STRING"), "score_type")
        .when((F.col("score") < 0) | (F.col("score") > 1), "score_range").when(F.col("abstains").isNull(), "abstains_missing").otherwise("ok")
    )
    return fields.select("vec_id", verdict.alias("verdict"), F.when(F.col("kind") != "STRING", F.round("score", 6)).alias("score"))


@R.add("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(DISTINCT json_extract_string(props, '$.k')) AS n_values FROM events GROUP BY 1")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON cells under a declared schema."""
    k = F.from_json("props", "k bigint")["k"].alias("k")
    rows = read(spark, sf_dir, "events").select("event_type", k)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.count_distinct("k").alias("n_values"))


QUERIES, ORACLE_SQL = R.queries, R.sql
