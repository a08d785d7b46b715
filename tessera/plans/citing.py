"""References and citations of every family, over sentences made from ``part`` rows.

A part is a paragraph of article ``p_size`` of document E or a recital of document
RI; articles have the sizes that occur, even ones have the paragraphs 1 and 2, and
recitals go to 30.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import references as X
from .registry import Registry, read

R = Registry()
CODES = ["B", "RII", "RI", "G", "E"]

UNIT_SQL = "CASE WHEN p_partkey % 3 = 0 THEN concat('RI Rec. ', p_size) ELSE concat('E Art. ', p_size, '.', p_partkey % 2 + 1) END"
TEXT_SQL = """concat('Pursuant to ', CASE p_partkey % 5 WHEN 0 THEN concat('Articles ', p_size, ' to ', p_size + p_partkey % 4) WHEN 1 THEN concat('Articles ', p_size, ', ', p_size + 2, '(1) and ', p_size % 7 + 1, 'a')
 WHEN 2 THEN concat('Article ', p_size + 1, '(2)(b)') WHEN 3 THEN concat('articles ', p_size + 1, ' or ', p_size + 3) ELSE 'the rules' END,
 CASE p_partkey % 7 WHEN 0 THEN ' of Directive 2000/31, which applies without prejudice to anything else that the Member States have laid down by way of law, regulation or practice' WHEN 1 THEN ' of this Regulation and the Treaty' ELSE ',' END,
 ' see also ', CASE p_partkey % 4 WHEN 0 THEN concat('recitals ', p_size % 20, ', ', p_size % 9, ' and ', p_size % 13) WHEN 1 THEN concat('Recital ', p_size) WHEN 2 THEN concat('paragraph ', p_partkey % 3 + 1, ' and Article ', p_size) ELSE concat('Article ', p_size % 11 + 1) END, '.')"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.expr(UNIT_SQL).alias("label"), F.expr(TEXT_SQL).alias("text")).withColumn("unit_id", F.concat_ws("|", "label", "p_partkey"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = read(spark, sf_dir, "part").select(F.col("p_size").alias("n")).distinct()
    ends = F.expr("concat(array(concat('E Art. ', n), concat('RI Art. ', n + 10)), CASE WHEN n % 2 = 0 THEN array(concat('E Art. ', n, '.1'), concat('E Art. ', n, '.2')) ELSE array() END, CASE WHEN n <= 30 THEN array(concat('RI Rec. ', n), concat('E Rec. ', n)) ELSE array() END)")
    return numbers.select(F.explode(ends).alias("unit_id"))


KNOWN_SQL = """known AS (SELECT unnest(list_concat([concat('E Art. ', n), concat('RI Art. ', n + 10)], CASE WHEN n % 2 = 0 THEN [concat('E Art. ', n, '.1'), concat('E Art. ', n, '.2')] ELSE [] END,
  CASE WHEN n <= 30 THEN [concat('RI Rec. ', n), concat('E Rec. ', n)] ELSE [] END)) AS unit_id FROM (SELECT DISTINCT p_size AS n FROM part) q)"""


def places_sql(name: str, text: str, pattern: str, source: str, keep: str) -> str:
    """The matches of a pattern with their places: what lies between matches and the matches, added up."""
    return f"""{name}_r AS (SELECT {keep}, regexp_extract_all({text}, '{pattern}') AS ms, regexp_split_to_array({text}, '{pattern}') AS gs FROM {source}),
{name} AS (SELECT {keep}, ms[i] AS raw, list_sum([length(g) FOR g IN gs[1:i]])::INT + coalesce(list_sum([length(m) FOR m IN ms[1:i - 1]]), 0)::INT AS start FROM {name}_r, unnest(generate_series(1, len(ms))) g(i) WHERE len(ms) > 0)"""


_FOUND = (
    ("rng", "range_expanded", X.RANGE, f"CASE WHEN regexp_extract(raw, '{X.RANGE}', 2)::INT - regexp_extract(raw, '{X.RANGE}', 1)::INT BETWEEN 0 AND {X.LONGEST_RANGE} THEN ['Art. ' || n FOR n IN generate_series(regexp_extract(raw, '{X.RANGE}', 1)::INT, regexp_extract(raw, '{X.RANGE}', 2)::INT)] ELSE [] END"),
    ("lst", "list_expanded", X.LIST, f"['Art. ' || replace(replace(x, '(', '.'), ')', '') FOR x IN regexp_extract_all(regexp_extract(raw, '{X.LIST}', 1), '(?i){X.LIST_ITEM}')]"),
    ("sgl", "single", X.SINGLE, f"['Art. ' || concat_ws('.', regexp_extract(raw, '{X.SINGLE}', 1), nullif(regexp_extract(raw, '{X.SINGLE}', 2), ''), nullif(regexp_extract(raw, '{X.SINGLE}', 3), ''))]"),
    ("rcs", "list_expanded", X.RECITALS, r"['Rec. ' || n FOR n IN regexp_extract_all(raw, '\d+')]"),
    ("rct", "recital", X.RECITAL, f"['Rec. ' || regexp_extract(raw, '{X.RECITAL}', 1)]"),
    ("rel", "relative_paragraph", X.PARAGRAPH, f"['.' || regexp_extract(raw, '{X.PARAGRAPH}', 1)]"),
)
CANDIDATES_SQL = f"""u AS (SELECT p_partkey, {UNIT_SQL} AS label, {TEXT_SQL} AS text FROM part),
{", ".join(places_sql(n, "text", p, "u" if n != "rel" else "(SELECT * FROM u WHERE contains(label, ' Art. '))", "p_partkey, label, text") for n, _, p, _ in _FOUND)},
every AS ({" UNION ALL ".join(f"SELECT p_partkey, label, text, '{k}' AS kind, raw, start, start + length(raw) AS stop, {t} AS targets FROM {n}" for n, k, _, t in _FOUND)}),
cand AS (SELECT p_partkey, label, kind, raw, start, stop, targets, NOT regexp_matches(substr(text, stop + 1, {X.OWN_AFTER}), '{X.OWN}')
  AND regexp_matches(substr(text, greatest(0, start - {X.BEFORE}) + 1, stop + {X.AFTER} - greatest(0, start - {X.BEFORE})), '{X.EXTERNAL}') AS external FROM every)"""


@R.add(f"WITH {CANDIDATES_SQL} SELECT p_partkey, kind, raw, start::INT AS start, stop::INT AS stop, array_to_string(targets, ';') AS targets, external FROM cand")
def xref_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six families of references with their places, and whether they are to another instrument."""
    found = X.candidates(_units(spark, sf_dir).withColumn("unit_id", F.concat("label", F.lit("|"), "p_partkey")))
    return found.select(F.split_part("unit_id", F.lit("|"), F.lit(2)).cast("long").alias("p_partkey"), "kind", "raw", "start", "stop", F.array_join("targets", ";").alias("targets"), "external")


NORMAL_SQL = r"regexp_replace({0}, '^([A-Z]+ Art\. [^.]+)\..*$', '\1')"


@R.add(
    f"""WITH {CANDIDATES_SQL}, {KNOWN_SQL},
d AS (SELECT label, kind, raw, start, stop, unnest(targets) AS e FROM cand WHERE NOT external),
n AS (SELECT label AS source, kind, raw, start, stop, {NORMAL_SQL.format('label')} AS own, CASE WHEN starts_with(e, '.') THEN {NORMAL_SQL.format('label')} || e ELSE split_part(label, ' ', 1) || ' ' || e END AS named FROM d),
t AS (SELECT n.*, CASE WHEN k.unit_id IS NOT NULL THEN named WHEN a.unit_id IS NOT NULL THEN a.unit_id END AS target FROM n LEFT JOIN known k ON k.unit_id = named LEFT JOIN known a ON a.unit_id = {NORMAL_SQL.format('named')}),
z AS (SELECT *, {NORMAL_SQL.format('target')} AS target_normalized FROM t WHERE target IS NOT NULL)
SELECT DISTINCT source, target, target_normalized, raw, kind FROM z WHERE target_normalized <> own
QUALIFY row_number() OVER (PARTITION BY source, target, raw ORDER BY start, stop, kind) = 1"""
)
def xref_resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates resolved to known units; units of one label count as one source."""
    units = _units(spark, sf_dir).select(F.col("label").alias("unit_id"), "text")
    return X.edges(X.candidates(units), _known(spark, sf_dir)).select("source", "target", "target_normalized", "raw", "kind")


@R.add(f"WITH {CANDIDATES_SQL} SELECT split_part(label, ' ', 1) AS document, external, kind, count(*) AS n, count(DISTINCT label) AS n_units FROM cand GROUP BY ALL")
def xref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.candidates(_units(spark, sf_dir).select(F.col("label").alias("unit_id"), "text"))
    return found.groupBy(F.split_part("unit_id", F.lit(" "), F.lit(1)).alias("document"), "external", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit_id").alias("n_units"))


ANSWER_SQL = """concat('As ', CASE p_partkey % 4 WHEN 0 THEN concat('E Art. ', p_size, '.1') WHEN 1 THEN concat('Arts. ', p_size, ', ', p_size + 1, '(2) and ', p_size % 5 + 1, 'a') WHEN 2 THEN concat('RI Recitals ', p_size % 9 + 1, ' or ', p_size) ELSE 'the act' END,
 ' says, ', CASE p_partkey % 3 WHEN 0 THEN concat('Article ', p_size, ' (3)') WHEN 1 THEN concat('rec ', p_size % 30) ELSE concat('Articles ', p_size, ' to ', p_size + 3) END, ' holds.')"""
ALLOWED_SQL = "CASE p_partkey % 2 WHEN 0 THEN {0}'E'{1} ELSE {0}'E', 'RI'{1} END"
_CODES = "|".join(CODES)
_MANY, _ONE = X.CITED_LIST.format(codes=_CODES), X.CITED.format(codes=_CODES)


@R.add(
    f"""WITH a AS (SELECT p_partkey, {ANSWER_SQL} AS text, {ALLOWED_SQL.format('[', ']')} AS allowed FROM part), {KNOWN_SQL},
{places_sql('m', 'text', _MANY, 'a', 'p_partkey, allowed, text')}, {places_sql('o', 'text', _ONE, 'a', 'p_partkey, allowed, text')},
b AS (SELECT p_partkey, allowed, raw AS outer_raw, start + length(raw) AS stop, regexp_extract(raw, '{_MANY}', 3) AS body FROM m),
{places_sql('i', 'body', X.CITED_NUMBER, 'b', 'p_partkey, allowed, outer_raw, stop, body')},
c AS (SELECT p_partkey, allowed, stop - length(body) + start AS place, trim(outer_raw) AS raw, regexp_extract(outer_raw, '{_MANY}', 1) AS doc, regexp_extract(outer_raw, '{_MANY}', 2) AS k, raw AS number FROM i
 UNION ALL SELECT p_partkey, allowed, start, trim(raw), regexp_extract(raw, '{_ONE}', 1), regexp_extract(raw, '{_ONE}', 2), regexp_extract(raw, '{_ONE}', 3) FROM o
 WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.p_partkey = o.p_partkey AND m.start <= o.start AND o.start + length(o.raw) <= m.start + length(m.raw))),
e AS (SELECT *, concat(CASE WHEN starts_with(lower(k), 'art') THEN 'Art. ' ELSE 'Rec. ' END, regexp_extract(regexp_replace(number, '\\s+', '', 'g'), '^([^.(]*)', 1)) AS e FROM c),
h AS (SELECT p_partkey, place, list(x) AS fits FROM (SELECT p_partkey, place, e, unnest(allowed) AS x FROM e) q JOIN known ON unit_id = x || ' ' || e GROUP BY ALL),
f AS (SELECT e.*, fits FROM e LEFT JOIN h USING (p_partkey, place)),
g AS (SELECT *, coalesce(nullif(doc, ''), CASE WHEN len(allowed) = 1 THEN allowed[1] WHEN len(fits) = 1 THEN fits[1] END) AS code FROM f)
SELECT p_partkey, place::INT AS place, raw, code || ' ' || e AS unit, doc = '' AND code IS NOT NULL AS inferred, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY place) AS INT) AS number FROM g"""
)
def legal_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of any length, single citations outside them, and the documents they are inferred to be of."""
    answers = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("answer_id"), F.expr(ANSWER_SQL).alias("text"), F.expr(ALLOWED_SQL.format("array(", ")")).alias("allowed"))
    found = X.citations(answers, CODES, _known(spark, sf_dir))
    return X.citation_order(found).withColumnRenamed("answer_id", "p_partkey").select("p_partkey", "place", "raw", "unit", "inferred", "number")


QUERIES, ORACLE_SQL = R.queries, R.sql
