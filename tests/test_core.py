"""Sources, sinks, models, streams and goldens of the core operators."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import checks, intervals, models, ranking, references, segments, stats, vectors
from tessera.sources import acts, readers, writers
from tessera.streaming import updates

ACT = b"""<akn xmlns="urn:x"><body><recital><num>(1)</num><p>First reason.</p></recital><chapter><num>Chapter I</num><heading>Scope</heading>
<section><article><num>Article 1</num><heading>Aim</heading><paragraph><num>1.</num><content>This act has: <list><item><num>(a)</num><p>one part</p></item><item><p>no mark</p></item></list></content></paragraph>
<paragraph><num>2.</num><content>See Article 2.</content></paragraph></article><article><num>Article 2</num><content>Alone.</content></article></section></chapter></body></akn>"""
PAGE = b"""<script>var t="</p>";</script><p class="norm">(1)</p><p class="norm">A reason</p><p class="title-article-norm">Article 4a</p><p class="title-article-norm">Title</p><p class="norm">1. First</p><p></p><p class="norm">(a) an item</p><p class="norm">2. Second</p><p class="norm">2. Again</p><p class="norm">free</p><p class="title-article-norm">Article 5</p>"""


def test_xml_act(spark, tmp_path):
    (tmp_path / "eidas.akn").write_bytes(ACT)
    units = {r.unit_id: r for r in acts.read_acts(spark, str(tmp_path), codes={"eidas": "E"}).collect()}
    assert list(units) == ["E Root", "E Rec. 1", "E Chap. I", "E Art. 1", "E Art. 1.1", "E Art. 1.1.a", "E Art. 1.2", "E Art. 2", "E Art. 2.2"]
    text = "Recital 1. First reason.\n\nArticle 1. Aim\n\n1. This act has: (a) one part no mark\n\n2. See Article 2.\n\nArticle 2.\n\n2. Alone."
    canonical = acts.read_canonical(spark, str(tmp_path), codes={"eidas": "E"}).first()
    assert (canonical.text, canonical.char_length) == (text, len(text))
    for u in units.values():
        there = " ".join(text[u.canonical_char_start : u.canonical_char_end].split())
        assert there == (u.text if u.unit_type != "subparagraph" else "one part")
        assert u.source_text_sha256 == canonical.source_text_sha256 and u.source_path == "eidas.akn"
    assert units["E Art. 1.1.a"].parent_unit_id == "E Art. 1.1" and units["E Art. 1.1.a"].text == "a one part"
    assert units["E Chap. I"].canonical_char_start == len("Recital 1. First reason.") and units["E Art. 1"].title == "Aim"


def test_xml_paragraphs_without_numbers_and_repeated_items():
    body = b"""<akn><chapter><heading>CHAPTER II Rules</heading><article><num>Article 3</num><paragraph><content>One <item><num>(a)</num><p>same</p></item> <item><num>(b)</num><p>same</p></item></content></paragraph>
<paragraph><content>Two</content></paragraph></article></chapter></akn>"""
    rows = {r[0]: r for r in acts.parse_xml("E", body).rows("h", "p")}
    assert list(rows) == ["E Root", "E Chap. II", "E Art. 3", "E Art. 3.1", "E Art. 3.1.a", "E Art. 3.1.b", "E Art. 3.2"]
    assert rows["E Art. 3.1.a"][7] < rows["E Art. 3.1.b"][7] and rows["E Art. 3.2"][5] == "2. Two"
    with pytest.raises(ValueError):
        acts.parse_xml("E", b"<akn><chapter><heading>Rules</heading></chapter></akn>")


def test_html_act(spark, tmp_path):
    (tmp_path / "warrant.html").write_bytes(PAGE)
    units = {r.unit_id: r for r in acts.read_acts(spark, str(tmp_path), html=True, codes={"warrant": "W"}).collect()}
    assert list(units) == ["W Root", "W Rec. 1", "W Art. 4a", "W Art. 4a.1", "W Art. 4a.1.a", "W Art. 4a.2", "W Art. 5"]
    assert units["W Art. 4a"].title == "Title" and units["W Art. 4a.1.a"].parent_unit_id == "W Art. 4a.1"
    text = acts.read_canonical(spark, str(tmp_path), html=True).first().text
    assert text == "Recital 1. A reason\n\nArticle 4a. Title\n\n1. First (a) an item 2. Second 2. Again free\n\nArticle 5."
    for u in units.values():
        assert " ".join(text[u.canonical_char_start : u.canonical_char_end].split()) == u.text
    (tmp_path / "E.akn").write_bytes(ACT)
    corpus = acts.read_corpus(spark, str(tmp_path / "*.akn"), str(tmp_path / "*.html"), codes={"warrant": "W"})
    assert {(r.document_code, r.document_order) for r in corpus.collect()} == {("E", 5), ("W", 6)}


def test_configurations_prompts_and_environments(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"models": {"name": "m", "top": 5}}')
    config = readers.read_config(spark, str(tmp_path / "c.json"))
    assert readers.config_value(config, "models", "top") == 5 and readers.config_value(config, "models", "seed", default=42) == 42
    with pytest.raises(ValueError, match="models.seed"):
        readers.config_value(config, "models", "seed")
    (tmp_path / "p.txt").write_text("System:\nBe exact.\n\nUser:\nQ: {question}\n")
    assert readers.read_prompt(spark, str(tmp_path / "p.txt")) == ("Be exact.", "Q: {question}")
    (tmp_path / "q.txt").write_text("User:\nx")
    with pytest.raises(ValueError):
        readers.read_prompt(spark, str(tmp_path / "q.txt"))
    assert readers.parse_env("# c\nA = '1'\nB=\"x=y\"\nnothing\nA=2\n") == {"A": "1", "B": "x=y"}
    (tmp_path / "x" / "b").mkdir(parents=True)
    (tmp_path / "x" / "a").mkdir()
    for d in "ba":
        (tmp_path / "x" / d / "hier.json").write_text(f'[{{"chunk_id": "{d}"}}]')
    assert [r.chunk_id for r in readers.read_first_named(spark, str(tmp_path / "x"), "hier.json", "chunk_id string").collect()] == ["a"]
    names = {r.name for r in readers.snapshot(spark, str(tmp_path / "x")).collect()}
    assert names == {"hier.json"}


def test_index_is_bound_to_its_manifest(spark, tmp_path):
    path = str(tmp_path / "i")
    chunks = spark.createDataFrame([("b", 0, [3.0, 4.0]), ("a", 1, [0.0, 2.0])], "chunk_id string, pos int, embedding array<float>")
    writers.write_flat_index(chunks, path, metadata={"model": "m"})
    assert [r.chunk_id for r in readers.read_flat_index(spark, path, {"model": "m", "embedding_text_field": "text"}).collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="made otherwise"):
        readers.read_flat_index(spark, path, {"model": "n"})
    chunks.limit(1).select("chunk_id", "pos", F.col("embedding").cast("array<double>").alias("embedding")).write.mode("overwrite").parquet(f"{path}/vectors")
    with pytest.raises(ValueError, match="not those"):
        readers.read_flat_index(spark, path, {"model": "m"})
    table = str(tmp_path / "configs")
    writers.write_configs(spark.createDataFrame([("1", "fs"), ("2", "hier")], "chunk_id string, config_id string"), table)
    assert [r.chunk_id for r in readers.read_configs(spark, table, "chunk_id string", ["hier"]).collect()] == ["2"]
    with pytest.raises(FileNotFoundError):
        readers.read_configs(spark, table, "chunk_id string", ["sem"])
    first, second = (spark.createDataFrame([("a", v), (v, v)], "k string, v string") for v in "xy")
    assert {tuple(r) for r in readers.last_by_key("k", first, second).collect()} == {("a", "y"), ("x", "x"), ("y", "y")}


def test_json_csv_and_literals(spark, tmp_path):
    got = readers.read_question_dict(spark, "question_dict = {'a': ['x'], 'b': ['y']}\nquestion_dict.update({'a': ['z'], 'c': 'w'})").orderBy("position").collect()
    assert [(r.question, r.answers) for r in got] == [("a", ["z"]), ("b", ["y"]), ("c", ["w"])]
    for name, body in (("bare", '[{"chunk_id": "1", "n": 2}]'), ("wrapped", '{"chunks": [{"chunk_id": "1", "n": 2}]}')):
        (tmp_path / f"{name}.json").write_text(body)
        assert [tuple(r) for r in readers.read_json_array(spark, str(tmp_path / f"{name}.json"), "chunk_id string, n int", wrapper="chunks").collect()] == [("1", 2)]
    (tmp_path / "cache.jsonl").write_text('{"h": "a", "v": 1}\nbroken\n{"h": "b", "v": 2}\n{"h": "a", "v": 3}\n')
    assert {(r.h, r.v) for r in readers.read_cache_lines(spark, str(tmp_path / "cache.jsonl"), "h", "h string, v int").collect()} == {("a", 3), ("b", 2)}
    (tmp_path / "audit.csv").write_text("audit_id,note\n1,a\n1,b\n")
    with pytest.raises(ValueError):
        readers.read_keyed_csv(spark, str(tmp_path / "audit.csv"), ["audit_id"], "audit_id")
    with pytest.raises(ValueError):
        readers.read_keyed_csv(spark, str(tmp_path / "audit.csv"), ["other"], "audit_id")


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.upsert(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k")
    writers.upsert(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    parts = str(tmp_path / "p")
    writers.overwrite_partitions(spark.createDataFrame([("x", 1), ("y", 2)], "condition_id string, n int"), parts, "condition_id")
    writers.overwrite_partitions(spark.createDataFrame([("y", 5)], "condition_id string, n int"), parts, "condition_id")
    assert {(r.condition_id, r.n) for r in spark.read.parquet(parts).collect()} == {("x", 1), ("y", 5)}
    stored = writers.write_flat_index(spark.createDataFrame([("a", 0, [3.0, 4.0])], "chunk_id string, pos int, embedding array<float>"), str(tmp_path / "i"))
    assert [round(x, 6) for x in stored.first().embedding] == [0.6, 0.8]
    with pytest.raises(ValueError):
        writers.write_flat_index(stored, path, kind="other")
    with pytest.raises(ValueError):
        writers.write_csv(stored.limit(0), path, ["chunk_id"], empty_is_error=True)


def test_models(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, text string")
    none = spark.createDataFrame([], "text_sha256 string, embedding array<double>")
    cache = models.embed_missing(rows, none, models.hash_embedder())
    assert cache.count() == 2 and models.embed_missing(rows, cache, models.hash_embedder()).count() == 0
    assert models.embedded(rows, cache).where("embedding is null").count() == 0
    schema = {"required": ["score"], "additionalProperties": False, "properties": {"score": {"type": "number", "minimum": 0, "maximum": 1, "multipleOf": 0.1}, "abstains": {"type": "boolean"}, "justified": {"type": ["boolean", "null"]}}}
    assert models.violations({"score": True, "x": 1}, schema) == ["unknown x", "type of score"]
    assert models.violations({"score": 0.25}, schema) == ["step of score"]

    def ask(prompt, fault):
        if prompt == "never":
            return "no"
        return '```json\n{"score": 0.3, "abstains": true, "justified": false}\n```' if fault else '{"score": 7}'

    answers = spark.createDataFrame([(1, "c", "once"), (2, "c", "never")], "query_id long, condition_id string, text string")
    got = {r.query_id: r for r in models.judge(answers, ask, schema).collect()}
    assert (got[1].score, got[1].attempts, got[1].justified) == (0.3, 2, False) and got[2].problem == "no object in the reply"
    with pytest.raises(ValueError):
        models.parse_object('{"a": NaN}')
    scores = answers.where("query_id = 1").drop("text").withColumn("model", F.lit("m"))
    have = answers.withColumn("model", F.lit("m"))
    assert [r.query_id for r in models.pending(have, scores, "model").collect()] == [2]
    with pytest.raises(Exception, match="stale"):
        models.pending(answers.withColumn("model", F.lit("n")), scores, "model").collect()


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "events"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string").coalesce(1).write.parquet(src)
    updates.upsert_stream(spark.readStream.schema("k int, v string").parquet(src), out, str(tmp_path / "cp"), "k").awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "c")}
    events = updates.read_events(spark, "/root/testdata/sf0.001/events.parquet".replace("events.parquet", "event*.parquet"))
    q = updates.windowed_totals(events, "1 day").writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("totals").agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_statistics(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, -2, 3, 3, 0, 5)], "d double")
    r = stats.wilcoxon(d, "d").first()
    assert (r.n, r.w_plus, r.w_minus) == (5, 13.0, 2.0) and r.rank_biserial == pytest.approx(11 / 15)
    h = stats.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double"), "p")
    assert {r.test: round(r.p_holm, 6) for r in h.collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    rows = [(b, c, float(b * 10 + c)) for b in range(4) for c in range(3)]
    f = stats.friedman(spark.createDataFrame(rows, "b int, c int, v double"), "b", "c", "v").first()
    assert f.chi_squared == pytest.approx(8) and f.kendall_w == pytest.approx(1)
    shares = stats.largest_remainder(spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "stratum string, n long"), "n", 7)
    assert {r.stratum: r.share for r in shares.collect()} == {"a": 4, "b": 2, "c": 1}


def test_metrics_and_search(spark):
    chunks = spark.createDataFrame([(0, "B", [1.0, 0.0]), (1, "G", [0.9, 0.1]), (2, "G", [0.0, 1.0])], "chunk_id long, document_code string, embedding array<float>")
    query = spark.createDataFrame([(7, ["G"], [1.0, 0.0])], "query_id long, allowed array<string>, embedding array<float>")
    assert [r.chunk_id for r in vectors.top_k(chunks, query, 2).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(Exception, match="without length"):
        vectors.top_k(chunks, query.withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>")), 2).collect()
    hits = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (1, 3, "c")], "query_id int, rank int, unit string")
    gold = spark.createDataFrame([(1, "b"), (1, "x")], "query_id int, unit string")
    m = ranking.ir_metrics(ranking.ranked_units(hits, "query_id"), gold, "query_id").first()
    assert (m.precision, m.recall, m.mrr, m.r_precision) == (pytest.approx(1 / 3), 0.5, 0.5, 0.5)


def test_windows_and_groups(spark):
    starts = {n: spark.range(1).select(intervals.token_windows(F.lit(n), 4, 3).alias("s")).first().s for n in (0, 1, 4, 5, 7, 8)}
    assert starts == {n: [i for i in range(0, n, 3) if i == 0 or i - 3 + 4 < n] for n in starts}
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 1, 2)], "k int, start int, stop int")
    assert tuple(intervals.merged_length(spans, "k").first())[1:] == (8, 2)
    rng = random.Random(3)
    rows = [(d, i, i // 3, rng.randint(3, 30), rng.random()) for d in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "doc long, place long, group_no long, tokens int, score double")
    out = segments.bound_groups(df, 30, 80).join(df.drop("group_no"), ["doc", "place"]).groupBy("doc", "group_no").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), (F.max("place") - F.min("place") + 1).alias("width")).collect()
    assert sum(r.n for r in out) == 120 and all(r.t + r.n - 1 <= 80 and r.n == r.width for r in out)


def test_fragments_join_neighbours_that_share_a_unit(spark):
    text = "Article 3\nThe rule holds for all cases here. Note\nalone. (a)\nfor goods and for services of any kind at all."
    spans = [(0, 9, [1]), (10, 44, [1, 2]), (45, 49, [2]), (50, 56, [3]), (57, 60, [4]), (61, len(text), [4])]
    rows = spark.createDataFrame([(7, a, b, u) for a, b, u in spans], "doc long, start long, stop long, units array<long>")
    got = segments.merge_fragments(rows, spark.createDataFrame([(7, text)], "doc long, text string")).orderBy("start").collect()
    assert [(r.start, r.stop, r.units) for r in got] == [(0, 49, [1, 2]), (50, 56, [3]), (57, len(text), [4])]


def test_small_groups_join_the_nearer_side_and_ends_are_forced(spark):
    rows = [(1, i, g, t, s) for i, (g, t, s) in enumerate([(0, 3, None), (1, 50, 0.9), (2, 4, 0.2), (3, 60, 0.6), (4, 5, 0.1)])]
    units = spark.createDataFrame(rows, "doc long, place long, group_no long, tokens long, score double")
    assert [r.group_no for r in segments.merge_small(units, 10).orderBy("place").collect()] == [0, 0, 1, 1, 1]
    alone = units.where("place = 0")
    assert [r.group_no for r in segments.merge_small(alone, 10).collect()] == [0]


def test_overlaps_and_pieces_against_brute_force(spark):
    rng = random.Random(4)
    left, right = ([(d, n, s, s + rng.randint(0, 90)) for n in range(60) for d in (1, 2) for s in [rng.randint(0, 500)]] for _ in range(2))
    schema = "doc long, {0} long, start long, stop long"
    found = intervals.overlapping(spark.createDataFrame(left, schema.format("a")), spark.createDataFrame(right, schema.format("b")), "doc", width=64)
    want = sorted((d, a, b) for d, a, s, e in left for f, b, t, g in right if d == f and s < g and t < e and s < e and t < g)
    assert sorted((r.doc, r.a, r.b) for r in found.collect()) == want
    for n, most in ((1, 5), (5, 5), (11, 5), (12, 5), (101, 7), (0, 3)):
        pieces = spark.range(1).select(intervals.even_pieces(F.lit(n).cast("long"), most).alias("p")).first().p
        sizes = [p["last"] - p["first"] for p in pieces]
        assert sum(sizes) == n and max(sizes) <= most and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_references_of_every_family(spark):
    texts = {
        "E Art. 5.1": "Articles 6 to 8 and Article 7(2)(a) apply; see paragraph 2 and recitals 3, 4 and 5.",
        "E Rec. 9": "Articles 1, 2(3) and 4a as well as recital 3; paragraph 1 is elsewhere.",
        "E Art. 6": "Article 7 of Directive 2000/31 and, far from that, nothing.",
        "E Art. 7": "Article 8 of this Regulation and of the Treaty.",
        "E Art. 8": "Articles 9 to 90 are too many, Article 8 is this one.",
    }
    units = spark.createDataFrame(list(texts.items()), "unit_id string, text string")
    found = references.candidates(units).collect()
    assert all(texts[r.unit_id][r.start : r.stop] == r.raw for r in found)
    assert {(r.raw, r.external) for r in found if r.unit_id in ("E Art. 6", "E Art. 7")} == {("Article 7", True), ("Article 8", False)}
    known = spark.createDataFrame([(f"E Art. {n}",) for n in (1, 2, 5, 6, 7, 8, 9)] + [("E Art. 5.2",), ("E Rec. 3",)], "unit_id string")
    edges = {(r.source, r.target, r.kind) for r in references.edges(references.candidates(units), known).collect()}
    assert edges == {
        ("E Art. 5.1", "E Art. 6", "range_expanded"), ("E Art. 5.1", "E Art. 7", "range_expanded"), ("E Art. 5.1", "E Art. 8", "range_expanded"), ("E Art. 5.1", "E Art. 7", "single"),
        ("E Art. 5.1", "E Rec. 3", "list_expanded"), ("E Rec. 9", "E Art. 1", "list_expanded"), ("E Rec. 9", "E Art. 2", "list_expanded"), ("E Rec. 9", "E Rec. 3", "recital"), ("E Art. 7", "E Art. 8", "single"),
    }
    answers = spark.createDataFrame([(1, "See Arts. 5, 6(1) and 7a, E Art. 9.2 or rec 3; Articles 1 to 4.", ["RI", "E"])], "answer_id long, text string, allowed array<string>")
    got = references.citation_order(references.citations(answers, ["RI", "E"], known)).orderBy("number").collect()
    assert [(r.unit, r.inferred) for r in got] == [("E Art. 5", True), ("E Art. 6", True), (None, False), ("E Art. 9", False), ("E Rec. 3", True)]


def test_gates(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    checks.require_none(rows.where("k > 5"), "unknown")
    with pytest.raises(ValueError, match="unknown"):
        checks.require_none(checks.unresolved(rows, rows.where("k = 1"), "k"), "unknown")
    one = spark.range(1).select(checks.highlighted(F.lit("a<b>&c"), F.lit(1), F.lit(4)).alias("h"), checks.scaled(F.lit(5.0), F.lit(5.0), F.lit(5.0), 0.0, 10.0).alias("y")).first()
    assert one.h == "a<mark>&lt;b&gt;</mark>&amp;c" and one.y == 5.0


def test_queries_without_hits_score_zero(spark):
    units = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, unit long, unit_rank int")
    gold = spark.createDataFrame([(1, 10), (2, 10)], "query_id long, unit long")
    got = {r.query_id: r for r in ranking.ir_metrics(units, gold, "query_id").collect()}
    assert got[1].recall == 1 and (got[2].precision, got[2].recall, got[2].f1, got[2].mrr, got[2].ndcg, got[2].n_units) == (0, 0, 0, 0, 0, 0)
    hits = units.withColumnRenamed("unit_rank", "rank")
    assert {r.query_id: r.recall for r in ranking.modified_metrics(hits, gold, 5, "query_id").collect()} == {1: 0.5, 2: 0.0}
