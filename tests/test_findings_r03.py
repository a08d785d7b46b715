"""One test for each finding of the third round: long documents, many groups, and what a task takes in."""

import random
import time

import numpy as np

from tessera.operators import segments, semantic


def test_many_small_groups_are_merged_in_one_pass():
    rng = np.random.default_rng(1)
    n = 60_000
    held, score = np.concatenate(([0], np.cumsum(rng.integers(1, 30, n) + 1))), rng.random(n)
    began = time.perf_counter()
    merged = semantic.small_merged(list(range(n + 1)), held, score, 60)
    bounded = semantic.small_merged(list(range(n + 1)), held, score, 60, 70)
    assert time.perf_counter() - began < 5
    assert (np.diff(held[merged]) - 1 >= 60).all()
    size = np.diff(held[bounded]) - 1
    assert (size <= 70).all() and all(size[i] >= 60 or size[i] + size[i + 1] + 1 > 70 for i in range(len(size) - 1))


def test_a_documents_text_is_not_repeated_for_its_sentences(spark):
    sentence = "Ten words that are not a fragment stand here now. "
    text = sentence * 20_000
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    units = spark.createDataFrame([(1, 0, 0, len(text))], "doc long, unit long, start long, stop long")
    got = segments.document_sentences(docs, units, r"[^\s.!?][^\n.!?]*[.!?]*").select("doc", "start", "stop", "units").collect()
    assert sorted(r.start for r in got) == [i * len(sentence) for i in range(20_000)]
    assert {(r.stop - r.start, tuple(r.units)) for r in got} == {(len(sentence) - 1, (0,))}
    rows = spark.createDataFrame([(1, r.start, r.stop, [0]) for r in got], "doc long, start long, stop long, units array<long>")
    assert sorted(segments.merge_fragments(rows, docs).collect()) == sorted(got)


def test_units_that_overlap_each_other_and_sentences_of_several():
    rng = random.Random(3)
    for _ in range(200):
        units = sorted((a := rng.randint(0, 40), a + rng.randint(1, 25), n) for n in range(rng.randint(0, 8)))
        spans = [(a := rng.randint(0, 60), a + rng.randint(0, 9)) for _ in range(12)]
        met = [(a, b, sorted(n for x, y, n in units if a < y and x < b)) for a, b in spans]
        got = segments._overlapping(*np.array(spans).T, *np.array(units, np.int64).reshape(-1, 3).T)
        assert got == [x for x in met if x[2] and x[0] < x[1]]


def test_rescored_rankings_make_one_row_a_unit_for_all_cuts(spark):
    from tessera.operators import ranking

    rng = random.Random(7)
    stored = [(q, r, [rng.randint(0, 9) for _ in range(rng.randint(0, 3))]) for q in range(60) for r in range(1, rng.randint(2, 9))]
    gold = sorted({(q, rng.randint(0, 9)) for q in range(10, 70) for _ in range(3)})
    s = spark.createDataFrame(stored, "query_id long, rank int, units array<long>").where("query_id != 5 or rank > 5").cache()
    g = spark.createDataFrame(gold, "query_id long, unit long")
    got = ranking.rescored(s, g, (1, 3, 5))
    assert "[1,3,5]" not in got._jdf.queryExecution().optimizedPlan().toString().replace(" ", "")
    for k in (1, 3, 5):
        hits = s.where(f"rank <= {k}").selectExpr("query_id", "rank", "explode(units) unit")
        plain = ranking.ir_metrics(ranking.ranked_units(hits, "query_id"), g, "query_id").join(s.select("query_id").distinct(), "query_id")
        rows = {r.query_id: [round(r[m], 9) for m in ("n_gold", "n_units", *ranking.METRICS)] for r in plain.collect()}
        assert rows and {r.query_id: [round(r[m], 9) for m in ("n_gold", "n_units", *ranking.METRICS)] for r in got.where(f"k = {k}").collect()} == rows


def test_ranges_are_not_listed_for_every_part(spark, tmp_path):
    from tessera.plans import audit

    rows = [(k, size) for k, size in ((1, 1), (1, 2), (61, 1), (55, 3), (55, 58), (58, 7), (119, 2), (30, 60), (None, 4), (2, None))]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    known, want = {size for _, size in rows}, {}
    for k, a in rows:
        if k is not None and a is not None:
            b = a + k % 60
            want.setdefault((k, b - a <= 50), set()).update((set(range(a, b + 1)) if b - a <= 50 else {a, b}) & known)
    out = audit.range_expansion(spark, str(tmp_path))
    got = {tuple(r) for r in out.collect() if r.p_partkey is not None}
    assert got == {(*key, len(u), min(u), max(u)) for key, u in want.items() if u}
    # Keys never meet single units: those are listed for distinct spans only.
    for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines():
        assert "Aggregate [p_partkey" not in line or "unit" not in line


def test_tokens_of_a_text_are_counted_once_for_all_its_pieces(spark):
    from tessera.plans import chunking

    out = chunking.semantic_chunks(spark, "/root/testdata/sf0.001")
    for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines():
        assert "Generate" not in line or "regexp_extract_all" not in line


def test_chunks_cross_the_shuffle_a_bounded_number_of_times(spark):
    from pyspark.sql import functions as F

    from tessera.operators import vectors

    rows = spark.range(3000).select(F.col("id").alias("chunk_id"), F.lit(0).alias("document_code"), F.array(*(F.sin((F.col("id") + 1) * (i + 1)) for i in range(4))).alias("embedding"))
    asked = rows.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("query_id"), F.lit(None).cast("array<int>").alias("allowed"), "embedding")
    grid = vectors.top_k(rows, asked, 3, held=0, strip=2, lanes=4).orderBy("query_id", "rank")
    got = grid.collect()
    assert got == vectors.top_k(rows, asked, 3).orderBy("query_id", "rank").collect() and len(got) == 3000
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert "least(" in plan


def test_distinct_pieces_are_tokenized_once_and_tokens_begin_where_the_library_says(spark, monkeypatch):
    import public_tokenizers as P
    from pyspark.sql import functions as F

    from tessera.operators import byte_level, tokens

    maker = tokens.FromFile(P.path("byte_bpe_50k.json"))
    tokenizer, asked = maker(), []
    ask = tokenizer._ask
    tokenizer._ask = lambda pieces: asked.extend(pieces) or ask(pieces)

    def check(texts):
        first, at = tokenizer.begins(texts)
        assert [first[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == tokens.starts(tokenizer, texts)

    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(500)]
    for _ in range(3):
        check([" ".join(rng.choices(words, k=400)) for _ in range(100)])
    assert len(asked) == len(set(asked)) <= 2 * len(words)
    bits = ["'", "s", "t", "re", "ll", "d", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "é", "é", "中", "\U0001f600", "1", "²", "!", "_", "<|endoftext|>", "͸", "​", "\x00", "'s", " '"]
    odd = lambda n: [*("".join(rng.choices(bits, k=rng.randint(0, n))) for _ in range(40)), "", "x" * 300]
    for _ in range(20):
        check(odd(30))
    check([])
    monkeypatch.setattr(byte_level, "_PART", 50)
    monkeypatch.setattr(byte_level, "_MOST", 60)
    monkeypatch.setattr(byte_level, "_LONGEST", 4)
    for _ in range(20):
        check(odd(300))
        assert len(tokenizer.held) <= 60
    plan = tokens.windows(spark.range(1).select("id", F.lit("a b").alias("text")), maker, 8, 5, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "__text" not in next(x for x in plan.splitlines() if "MapInArrow" in x).rsplit("[", 1)[1]


def test_only_plain_byte_level_files_are_cut_into_pieces():
    import public_tokenizers as P
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    from tessera.operators import byte_level

    def changed(change=lambda t: None):
        t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        change(t)
        return byte_level.fits(t)

    assert changed()
    assert not changed(lambda t: t.add_tokens(["word of its own"]))
    assert not changed(lambda t: setattr(t, "encode_special_tokens", False))
    assert not changed(lambda t: setattr(t, "normalizer", normalizers.NFC()))
    assert not changed(lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=True)))
    assert not changed(lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.Whitespace()))
    assert not byte_level.fits(Tokenizer.from_file(P.path("word_bpe_49k.json")))
