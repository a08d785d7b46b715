"""Collisions of set ids, wide Arrow offsets, items of very different lengths, and urls of odd tables."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bpe_lexicon, common, decontam, langid, near_dedup, pseudo_lm, queries, url_rules

from test_llm_operators import SCHEMA, brute_components, brute_rule, odd_rows, prose


@pytest.mark.parametrize("bits", [1, 3, 64])
def test_sets_whose_ids_collide_stay_apart(spark, bits):
    rng = random.Random(31)
    rows = []
    for _ in range(18):
        base = prose(rng, rng.randint(3, 90)).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plan = near_dedup.Plan(3, 85, 9, 8, id_bits=bits)
    want = brute_components(rows, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, plan).collect()} == want
    assert {r.doc_id for r in near_dedup.keep(docs, plan).collect()} == {d for d, (_, c) in want.items() if c == d}


def test_the_filter_lets_all_family_texts_through(spark):
    rng = np.random.default_rng(2)
    wanted, others = rng.integers(-(1 << 63), 1 << 63, 3000), rng.integers(-(1 << 63), 1 << 63, 20_000)
    name, bits = near_dedup.text_filter(spark.createDataFrame([(int(h),) for h in wanted], "h long"), "test-filter")
    bitmap = np.fromfile(common.published(name), np.uint8)
    assert len(bitmap) * 8 == bits and near_dedup.passes_filter(bitmap, bits, wanted).all()
    assert near_dedup.passes_filter(bitmap, bits, others).mean() < 0.1


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string(), pa.binary(), pa.large_binary()])
def test_buffers_of_either_offset_width(kind):
    texts = ["", "ab", None, "é", "xyz", None]
    column = pa.array([t if t is None or pa.types.is_string(kind) or pa.types.is_large_string(kind) else t.encode() for t in texts], kind)
    for a, b in ((0, 6), (1, 4), (3, 6), (2, 2)):
        blob, at = common.buffers(column.slice(a, b - a))
        assert [bytes(blob[x:y]).decode() for x, y in zip(at, at[1:], strict=False)] == [t or "" for t in texts[a:b]]
    with pytest.raises(TypeError):
        common.buffers(pa.array([1, 2]))
    with pytest.raises(OverflowError):
        common.values(np.zeros(1, np.uint8), np.array([0, 1 << 31]), pa.binary())


def test_results_do_not_depend_on_the_offset_width(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).repartition(2)

    def results():
        lexicon = bpe_lexicon.build_lexicon(bpe_lexicon.count_words(docs), queries.tokenizer_path())
        coded = Counter(tuple(r) for r in bpe_lexicon.digests(bpe_lexicon.encode_decode(docs, lexicon)).collect())
        scored = Counter((r.doc_id, *(round(x, 4) if isinstance(x, float) else x for x in tuple(r)[1:])) for r in pseudo_lm.train_and_score(docs).collect())
        return coded, scored

    narrow = results()
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        assert results() == narrow
    finally:
        spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "false")


def test_items_of_very_different_lengths(spark, monkeypatch):
    rng = random.Random(41)
    settings = decontam.Settings()
    words = [prose(rng, 1) + str(i) for i in range(4000)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([6, 20, 63, 64, 65, 128, 129, 700, 5000])]
    made = [decontam.make_item(i, t, settings) for i, t in items]
    index = decontam.ItemIndex(made, settings)
    assert [sorted(x.item_id for x in part.items) for part in index.parts] == [[0, 1, 2, 3], [4, 5], [6], [7], [8]]
    whole = {x.item_id: w for x, w in zip(made, decontam.bm25_weights(made), strict=True)}
    assert all(whole[x.item_id] == w for part in index.parts for x, w in zip(part.items, part.weights, strict=True))
    noise = [" ".join(rng.choices(words, k=300)) for _ in range(3)]
    texts = [f"{noise[0]} {t} {noise[1]}" for _, t in items] + noise
    once = [sorted(h[0] for h in found) for found in index.hits(texts)]
    assert once == [[i] for i in range(len(items))] + [[], [], []]
    monkeypatch.setattr(decontam, "_POSTINGS", 3)
    assert [sorted(h[0] for h in found) for found in index.hits(texts)] == once
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(i, i) for i in range(len(items))}


def test_one_long_item_does_not_slow_the_short_ones():
    rng = random.Random(42)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(30_000)]
    settings, text = decontam.Settings(), " ".join(rng.choices(words, k=20_000))
    short = [decontam.make_item(i, " ".join(rng.choices(words, k=30)), settings) for i in range(2000)]
    long = decontam.make_item(9999, " ".join(rng.choices(words, k=10_000)), settings)
    indexes = [decontam.ItemIndex(short, settings), decontam.ItemIndex([*short, long], settings)]
    took = []
    for index in indexes:
        began = time.perf_counter()
        assert index.hits([text]) == [[]]
        took.append(time.perf_counter() - began)
    assert took[1] < 2 * took[0] + 1


def test_passages_in_turns_are_those_of_one_turn(monkeypatch):
    rng = random.Random(43)
    settings = decontam.Settings()
    items = [decontam.make_item(i, prose(rng, rng.randint(8, 40)), settings) for i in range(60)]
    index = decontam.BlockMaxIndex(items, settings)
    texts = [decontam.terms(prose(rng, 30) + " " + " ".join(w.decode() for w in rng.choice(items).question) + " " + prose(rng, 200)) for _ in range(40)]
    whole = index.hits(texts)
    for most in (1, 17, 300):
        monkeypatch.setattr(decontam, "_POSTINGS", most)
        assert index.hits(texts) == whole


def test_url_rules_on_odd_rows(spark):
    long = "http://www.example.org/es/" + "x/" * 50_000
    urls = [None, "", " ", "x" * 40_000, long, long, "HTTP://A.EXAMPLE.ORG/es/", "http://é.org/é", "http://a\x00b.com/de/", "12 34 !!"]
    rows = [(i, u, "p", None) for i, u in enumerate(urls)] + [(3, "http://org/", "p", "clash"), (None, long, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, path string, verdict string").repartition(3)
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.match_rules(df, queries.URL_RULES).collect())
    assert got == Counter((i, *brute_rule(u, queries.URL_RULES)) for i, u, *_ in rows)
    assert url_rules.match_rules(df.limit(0), queries.URL_RULES).count() == 0


def test_languages_in_blocks_are_those_of_one_block(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = langid.fit(docs, per_lang=40)
    texts = [r.text for r in docs.limit(60).collect()] + [None, "", "123"]
    for most in (1, 3, 1000):
        monkeypatch.setattr(langid, "_CENTROIDS", most)
        model = langid.fit(docs, per_lang=40)
        assert isinstance(model, langid.PublishedModel if most < 1000 else langid.CentroidModel)
        got, want = model.predict(texts), whole.predict(texts)
        assert got[0] == want[0] and got[2] == want[2] and got[1] == pytest.approx(want[1], abs=1e-6)
        found = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()}
        assert found == {(r.doc_id, r.lang_pred) for r in langid.predict(docs, whole).collect()}


def test_the_pipeline_leaves_nothing_behind(spark, tmp_path):
    import corpus_pipeline

    shared = common.Path(common.shared_dir(spark))
    before = {p.name for p in shared.glob("*")} if shared.exists() else set()
    mark = common.written()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    kept = {p.name for p in shared.glob("tessera-*") if p.name not in before}
    assert len([n for n in kept if "near-dedup" in n or "language-ID" in n or "quality" in n]) == 0
    out.write.parquet(str(tmp_path / "out"))
    common.release(spark, since=mark)
    assert {p.name for p in shared.glob("*") if not p.name.startswith(".")} <= before
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_stages_on_repeated_rows_and_clashing_columns(spark):
    import corpus_pipeline

    rng = random.Random(51)
    text = prose(rng, 120)
    rows = [(i, prose(rng, 120), "en", "s", 9, "x", 1, 2) for i in range(30)] + [(7, text, "en", "s", 1, "a", 3, 4)] * 3 + [(None, text, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, k long, n_words long").repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stash(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "h", "k", "n_words"]
    assert sum(r.text == text for r in docs.collect()) <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == docs.count()
