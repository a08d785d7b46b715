"""Brute-force versions, round trips, held-out accuracy and odd inputs for the ten operators."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe_lexicon, common, components, decontam, langid, license_scan, near_dedup, pseudo_lm, quality_qda, quality_rules, queries, sharding, url_rules

SCHEMA = "doc_id long, text string, lang string, size int, n long"
SF = "/root/testdata/sf0.001"
SYLLABLES = "ba re ti lo mun ka pe sol da wi ga nor fe hu".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def odd_rows():
    """Null ids and texts, empty, blank and very long texts, repeats, and columns with clashing names."""
    long = prose(random.Random(1), 20_000)
    texts = [None, "", "  \n\t ", "one", "one two", "ONE two", "\u00e9\u00e8 \u4e2d\u6587 \u0660", long, long, "x" * 30_000, "a\x00b <|endoftext|> c", "12 34 !!"]
    return [(i, t, "en", i, -i) for i, t in enumerate(texts)] + [(3, "one", "en", 0, 0), (None, "one two three four", None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# op1


def brute_rule(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
    return host, path, best and best.text, best.action if best else "allow"


def test_url_rules_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["org", "example.org", "www.example.org", "xexample.org", "com", "a.com", "b.a.com", "EXAMPLE.ORG", "a..com", ".com", "com.", "net", ""]
    paths = ["", "/", "/es/", "/es/a", "/en/1", "/en/12", "/fr/", "/de/x", "/de", "/\u00e9", "/EN/1"]
    urls = [f"{s}{h}{p}{q}" for s, h, p, q in itertools.product(["http://", "x", "a://b://"], hosts, paths, ["", "?a=/es/", "#/de/"])] + [None, "", "://", "http:/org/"]
    rules = queries.URL_RULES + [url_rules.Rule("block", "a.com", "/en/"), url_rules.Rule("allow", "b.a.com", "/"), url_rules.Rule("block", "com", "/en/1"), url_rules.Rule("block", "www.example.org", "")]
    rng.shuffle(urls)
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for size in (5_000, 2):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.match_rules(df, rules, block_rules=size).collect()}
        assert got == {i: brute_rule(u, rules) for i, u in enumerate(urls)}
    assert url_rules.match_rules(df.limit(0), rules).count() == 0
    assert {r.rule for r in url_rules.match_rules(df, []).collect()} == {None}


# op2


def test_decontamination_retrieves_all_above_threshold():
    rng = random.Random(5)
    settings = decontam.Settings(posting_block=4)
    texts = [prose(rng, rng.randint(8, 40)) for _ in range(60)]
    index = decontam.BlockMaxIndex([decontam.make_item(i, t, settings) for i, t in enumerate(texts)], settings)
    names = sorted(index.number)
    for _ in range(200):
        source = decontam.terms(rng.choice(texts))
        words = set(rng.sample(source, k=max(1, int(len(source) * rng.random())))) | set(rng.choices(names, k=10))
        query = sorted(index.number[w] for w in words)
        scores = {i: sum(x for t, x in w.items() if t in words) for i, w in enumerate(index.weights)}
        got = dict(index.retrieve(query))
        assert got.keys() == {i for i, s in scores.items() if s >= settings.threshold - 1e-9}
        assert all(abs(s - scores[i]) < 1e-9 for i, s in got.items())


def test_decontamination_finds_planted_items(spark):
    rng = random.Random(6)
    items = [prose(rng, rng.randint(15, 59)) for _ in range(40)]
    rows, expected = [], set()
    for d in range(120):
        words = prose(rng, rng.randint(0, 400)).split()
        if d % 3 == 0:
            item = d % 40
            at = rng.randint(0, len(words))
            planted = items[item].split()
            words[at:at] = [w.upper() if d % 2 else w + "," for w in planted]
            expected.add((d, item))
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} >= expected
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, block_items=7).collect()}
    assert expected <= got
    shingled = [decontam.shingles(decontam.terms(t), 5) for t in items]
    for d, i in got - expected:
        have = decontam.shingles(decontam.terms(rows[d][1]), 5)
        assert len(have & shingled[i]) >= 0.8 * len(shingled[i])
    assert {r.doc_id for r in decontam.keep(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_terms_of_any_script(spark):
    assert decontam.terms("“What’s A_B” — café, naïve…") == [w.encode() for w in ("what", "s", "a", "b", "café", "naïve")]
    assert decontam.terms("水は abc度。") == [w.encode() for w in ("水", "は", "abc", "度")]
    assert decontam.terms("हिन्दी") == ["हिन्दी".encode()]
    ascii_text = "".join(map(chr, range(128))) + " Ab c"
    assert decontam.terms(ascii_text + " é") == [*decontam.terms(ascii_text), "é".encode()]
    short, han = "which gas do green plants take in when they make sugar", "中国最长的河流是哪一条长江"
    bench = spark.createDataFrame([(1, short), (2, han)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"He read “{short}”—and left"), (2, f"我们问你{han}吗请回答"), (3, "“green plants” 长江是河流")], "doc_id long, text string"
    )
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(1, 1), (2, 2)}
    assert [r.doc_id for r in decontam.keep(docs, bench).collect()] == [3]


def test_decontamination_against_brute_force(spark, odd, empty):
    rng = random.Random(61)
    settings = decontam.Settings()
    items = [(i, prose(rng, rng.randint(6, 50))) for i in range(30)] + [(30, "two words"), (31, None), (32, "...")]
    rows = []
    for d in range(90):
        words, planted = prose(rng, rng.randint(0, 250)).split(), items[d % 31][1].split()
        if d % 2:
            planted = [w if rng.random() > 0.03 * (d % 5) else "other" for w in planted][: len(planted) - d % 4]
            at = rng.randint(0, len(words))
            words[at:at] = planted
        rows.append((d, " ".join(words), "clash", 7))
    made = [x for i, t in items if (x := decontam.make_item(i, t, settings))]
    weights = decontam.BlockMaxIndex(made, settings).weights
    half = max(32, max(len(m.question) + len(m.answer) for m in made))

    def naive(text):
        words, best = decontam.terms(text), {}
        for p in range(-(-len(words) // half)):
            passage = words[p * half : (p + 2) * half]
            for item, w in zip(made, weights, strict=True):
                score = sum(x for t, x in w.items() if t in set(passage))
                q = min(5, len(item.question) + len(item.answer))
                have = decontam.shingles(passage, q)
                shares = [len(x & have) / len(x) if x else 1.0 for x in (item.whole, *item.parts)]
                if score >= settings.threshold - 1e-9 and shares[0] >= settings.overlap and min(shares[1:]) >= settings.part_overlap and score > best.get(item.item_id, (0,))[0] + 1e-12:
                    best[item.item_id] = (score, p * half)
        return best

    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, score int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.score, 6), r.first_word) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(d, i): (round(s, 6), at) for d, t, _, _ in rows for i, (s, at) in naive(t).items()} and len(got) > 10
    kept = decontam.keep(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, *_ in rows} - {d for d, _ in got}
    assert decontam.keep(odd, bench).count() >= odd.count() - 1 and decontam.contaminated(empty, bench).count() == 0 and decontam.keep(odd, bench.limit(0)).count() == odd.count()


# op3 and op9


def test_quality_features_and_scores_against_a_naive_version(spark, odd):
    rng = random.Random(17)
    texts = [" ".join(rng.choices(["Ab", "c!", "d9", "e,", "#f", "g\n", "h"], k=rng.randint(1, 90))) for _ in range(80)] + [r.text for r in odd.collect()]

    def naive(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        if not n:
            return [0.0] * 12
        raw = (text or "").encode()
        chars, lines = sum(len(w.encode()) for w in words), [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
        stutters = sum(a == b for a, b in zip(words, words[1:]))

        def count(pattern):
            return len(re.findall(pattern, text))

        return [
            math.log1p(n), math.log(chars / n), math.log1p(100 * count(r"[#*$%&|<>]") / n), math.log1p(100 * count("!") / n), math.log1p(100 * count("[A-Z]") / chars), math.log1p(100 * count("[0-9]") / chars),
            (brute_measures(text)[5] / n) ** 0.5, (stutters / n) ** 0.5, math.log1p(len(set(words))) - math.log1p(n), (1 - len(set(lines)) / len(lines)) ** 0.5, math.log1p(n / len(lines)), math.log1p(100 * count(r"[.,;:?\"'()-]") / n),
        ]

    for t in texts:
        assert quality_qda.features(t) == pytest.approx(naive(t))
    x = np.array([naive(t) for t in texts])
    y = [int(row[3] > np.median(x[:, 3])) for row in x]
    docs = spark.createDataFrame([(f"d{i}", t, 0) for i, t in enumerate(texts)], "doc_id string, text string, length int").repartition(3)
    labels = spark.createDataFrame([(f"d{i}", v) for i, v in enumerate(y)] + [("d1", 1 - y[1]), ("d2", None), (None, 1)], "doc_id string, quality int")
    rows = quality_qda.measured(docs)
    got = {r.doc_id: r.score for r in quality_qda.score(rows, quality_qda.fit(rows, labels)).collect()}
    used = [i for i in range(len(texts)) if i != 1]
    classes = [np.array([x[i] for i in used if y[i] == v]) for v in (0, 1)]
    pooled = sum(len(c) * c.var(axis=0) for c in classes) / len(used)
    logs = []
    for c in classes:
        cov = 0.9 * np.cov(c.T, bias=True) + np.diag(0.1 * pooled + 1e-3)
        d = x - c.mean(axis=0)
        logs.append(-0.5 * (np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]) + math.log(len(c)))
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -60, 60)))
    assert [got[f"d{i}"] for i in range(len(texts))] == pytest.approx(want.tolist(), abs=1e-6)


def test_language_is_that_of_the_nearest_centroid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    model = langid.fit(docs, per_lang=60)

    def bucket(trigram):
        code = int.from_bytes(trigram, "big")
        return (code * 2654435761 & 0xFFFFFFFF) >> 32 - langid.DIM_BITS

    def naive(text):
        raw = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b" "
        counts = Counter(bucket(raw[i : i + 3]) for i in range(len(raw) - 2) if b"  " not in raw[i : i + 3])
        vector = {j: math.log1p(n) * model.idf[j] for j, n in counts.items()}
        length = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(c[j]) for j, v in vector.items()) / length for c in model.centroids]
        best = max(range(len(cosines)), key=lambda i: (cosines[i], -i))
        return model.langs[best], cosines[best]

    texts = [r.text for r in docs.where("doc_id % 8 = 0").collect() if langid.has_letter(r.text)][:40]
    langs, scores, _ = model.predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        want = naive(text)
        assert lang == want[0] and score == pytest.approx(min(1.0, max(0.0, want[1])), abs=1e-4)


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in queries.op3_quality_qda(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    held = [(rows[d].predicted, q) for d, q in labels.items() if rows[d].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (500, 3)), rng.normal(1, 2, (300, 3))]
    m = quality_qda.from_sums([len(a) for a in x], [a.sum(axis=0) for a in x], [a.T @ a for a in x], shrink=0.0, ridge=0.0)
    point = rng.normal(0, 1, (20, 3))
    log = []
    for a in x:
        c, d = np.cov(a.T, bias=True), point - a.mean(axis=0)
        log.append(-0.5 * (np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d) + np.log(np.linalg.det(c))) + np.log(len(a)))
    assert np.allclose(m.scores(point), 1 / (1 + np.exp(log[0] - log[1])))
    assert quality_qda.from_sums([0, 3], [np.zeros(3)] * 2, [np.zeros((3, 3))] * 2) is None


def test_language_held_out(spark):
    rows = {r.doc_id: r for r in queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [(rows[d].lang_pred, g) for d, g in truth.items() if rows[d].held_out]
    assert len(rows) == 1000 and sum(p == g for p, g in held) / len(held) > 0.97


def test_language_rejects_what_is_far_and_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    other = spark.createDataFrame([(1, "\u0441\u043b\u043e\u0432\u043e \u0437\u0430 \u0441\u043b\u043e\u0432\u043e\u043c " * 30), (2, "\u4e2d\u6587" * 50), (3, "12 34")], "doc_id long, text string")
    assert {r.rejected for r in langid.predict(other, model).collect()} == {True}
    clean = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    assert langid.keep(docs, model).join(clean, "doc_id", "left_semi").count() == clean.count()


def test_language_rejects_foreign_text_of_any_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rng = random.Random(3)
    letters = {"cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3CA), "arabic": range(0x627, 0x64B), "cjk": range(0x4E00, 0x5E00), "polish": map(ord, "aąbcćdeęfghijklłmnoóprsśtuwyzż"), "latin": range(97, 123)}
    for name, codes in letters.items():
        chars = [chr(c) for c in codes]
        texts = [" ".join("".join(rng.choices(chars, k=rng.randint(2, 9))) for _ in range(n)) for n in (50, 100, 200, 500, 1000) for _ in range(8)]
        assert all(model.predict(texts)[2]), name
    clean = [r.text for r in docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id", "left_semi").collect()]
    assert not any(model.predict(clean)[2])
    for n in (10, 20, 50):
        short = [" ".join(t.split()[:n]) for t in clean]
        assert sum(model.predict(short)[2]) <= 0.01 * len(short), n


def test_language_and_quality_on_odd_rows(spark, odd, empty):
    model = langid.fit(odd.where("lang = 'en'"))
    got = [(r.lang_pred, r.score) for r in langid.predict(odd, model).collect()]
    assert len(got) == odd.count() and all(0 <= s <= 1 for _, s in got)
    assert sum(p == "und" for p, _ in got) == 4
    assert langid.fit(empty) is None and {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.keep(odd, model).columns == odd.columns
    rows = quality_qda.measured(odd)
    assert rows.count() == odd.count()
    assert quality_qda.fit(rows, spark.createDataFrame([(1, None), (2, 5)], "doc_id long, quality int")) is None
    assert {r.score for r in quality_qda.score(rows, None).collect()} == {0.5}


# op4


def test_bpe_matches_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    texts = [r.text for r in odd.collect()] + ["x\n \nb", " a  b", "a.\n b", "it's 'S I'll\u00a0 b", "\u0378\u0378a \x1c\x85", "9" * 500 + "\u00e9" * 300, "<|endoftext|><|endoftext|>"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text").toDF("doc_id", "text"))
    for words in (50, 50_000):
        lexicon = bpe_lexicon.build_lexicon(bpe_lexicon.count_words(docs), path, words=words)
        got = {r.doc_id: r for r in bpe_lexicon.digests(bpe_lexicon.encode_decode(docs, lexicon)).collect()}
        for r in docs.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            assert got[r.doc_id].n_tokens == len(ids)
            assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    lexicon = bpe_lexicon.build_lexicon(bpe_lexicon.count_words(empty), path)
    assert bpe_lexicon.encode_decode(empty, lexicon).count() == 0


def test_automaton_is_minimal_and_ranks_words():
    rng = random.Random(2)
    words = sorted({prose(rng, 1).encode() for _ in range(3000)})
    auto = bpe_lexicon.compile_automaton(words)
    assert (bpe_lexicon.rank_words(auto, words) == np.arange(len(words))).all()
    others = [w + b"q" for w in words] + [w[:-1] for w in words if w[:-1] not in set(words)] + [b""]
    assert (bpe_lexicon.rank_words(auto, others) == -1).all()

    small = words[:150]
    auto = bpe_lexicon.compile_automaton(small)
    suffixes = {frozenset(w[len(p) :] for w in small if w.startswith(p)) for p in {w[:i] for w in small for i in range(len(w) + 1)}}
    assert len(auto["final"]) == len(suffixes)


# op5


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_against_brute_force(spark, odd, empty):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["a", "b", "c#", "\u00e9$", "d\n", "e"], k=rng.randint(0, 60))) for _ in range(300)] + [r.text for r in odd.collect()]
    for t in texts:
        assert quality_rules.measure_text(t)[:6] == brute_measures(t)
    entries = quality_rules.ledger(odd)
    assert entries.count() == odd.count() and quality_rules.ledger(empty).count() == 0
    kept = entries.where(quality_rules.passes()).count()
    assert quality_rules.keep(odd).count() == kept and quality_rules.keep(odd).columns == odd.columns
    clash = odd.withColumnRenamed("n", "n_words").withColumnRenamed("size", "fail_bits")
    assert quality_rules.keep(clash).columns == clash.columns and quality_rules.keep(clash).count() == kept
    assert quality_rules.keep(empty).count() == 0 and sorted(r.text for r in quality_rules.keep(odd, "base").collect()) == sorted(t for t in [r.text for r in odd.collect()] if not any(eval(quality_rules.RULES[b][1], dict(zip(quality_rules.MEASURES, quality_rules.measure_text(t)))) for b in (0, 1)))
    for policy in ("v1", "v2"):
        bits = [r.fail_bits & quality_rules.mask_of(policy) for r in entries.collect()]
        for r in quality_rules.ablations(entries, policy).collect():
            flag = 1 << r.bit
            assert (r.n_failed, r.n_only) == (sum(b & flag > 0 for b in bits), sum(b == flag for b in bits))
            assert r.n_kept_without == sum(b & ~flag == 0 for b in bits)


# op6


@pytest.mark.parametrize("most", [0, 1, 7, 100, 205, 300])
def test_most_frequent_words_fill_every_place(spark, most):
    rows = [(f"top{i}", 5_000 + 900 * i) for i in range(5)] + [(f"w{i * 37 % 200:03}", 1_000 + i % 3) for i in range(200)] + [("last", 1)]
    counts = spark.createDataFrame(rows, "word string, n long").repartition(4)
    got = sorted((-r.n, r.word) for r in common.most_frequent(counts, most).collect())
    assert got == sorted((-n, w) for w, n in rows)[:most]


def test_gradient_against_differences():
    shape = pseudo_lm.Shape(classes=4, buckets=3, width=5)
    flat = shape.initial().astype(np.float64) * 10
    rng = np.random.default_rng(4)
    line, at = pseudo_lm.windows([rng.integers(1, 16, n) for n in (7, 1, 12)])
    step = np.zeros_like(flat)
    pseudo_lm.gradient(shape.split(flat), shape, line, at, shape.split(step))

    def loss(x):
        p = shape.split(x)
        h = pseudo_lm.hidden({k: v.copy() for k, v in p.items()}, line, at)
        total = 0.0
        for row, t in zip(h, line[at]):
            a, b = row @ p["to_class"] + p["class_bias"], row @ p["to_word"][t // 4] + p["word_bias"][t // 4]
            total -= a[t // 4] - np.log(np.exp(a).sum()) + b[t % 4] - np.log(np.exp(b).sum())
        return total / len(at)

    for i in rng.integers(0, len(flat), 60):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert math.isclose((loss(up) - loss(down)) / 2e-5, step[i], abs_tol=1e-6)
    assert math.isclose(-pseudo_lm.log_probabilities(shape.split(flat), shape, line, at).mean(), loss(flat), rel_tol=1e-5)


def test_pseudo_likelihood_learns(spark, odd, empty):
    rng = random.Random(8)
    cycle = "red green blue black white".split()
    rows = [(i, " ".join(cycle[(i + j) % 5] for j in range(300))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shape = pseudo_lm.Shape(classes=8, buckets=7, width=8, mask=2, rounds=6, batch=256)
    model = pseudo_lm.train(docs, shape)
    tests = spark.createDataFrame([(0, rows[0][1]), (1, " ".join(rng.choices(cycle, k=300)))], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_likelihood for r in pseudo_lm.score(tests, *model, shape).collect()}
    assert got[0] > -0.7 and got[1] < got[0] - 0.5
    scored = pseudo_lm.score(odd, *pseudo_lm.train(odd, shape), shape).collect()
    assert len(scored) == odd.count() and all((r.n_tokens == 0) == (r.log_likelihood == 0) for r in scored)
    assert pseudo_lm.score(empty, *pseudo_lm.train(empty, shape), shape).count() == 0


def test_pseudo_likelihood_against_a_naive_score(spark, odd):
    shape = pseudo_lm.Shape(classes=4, buckets=3, width=6, lexicon=5, rounds=2)
    words, flat, rare = pseudo_lm.train(odd.where("length(text) < 1000"), shape)
    p, counts = shape.split(flat.astype(float)), {bytes(r.word): r.n for r in rare.counts.collect()}

    def naive(text):
        tokens, total = [], 0.0
        for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").lower().encode()):
            if w in words:
                tokens.append(words.index(w) + 1)
                continue
            bucket = zlib.crc32(w) % 3
            tokens.append(shape.frequent + 1 + bucket)
            mates = [n for x, n in counts.items() if x not in words and zlib.crc32(x) % 3 == bucket]
            total += math.log((counts.get(w, 0) + 0.5) / (sum(mates) + len(mates) + 1))
        padded = [0, 0, *tokens, 0, 0]
        for i, t in enumerate(tokens, 2):
            h = np.tanh(sum(p["embed"][j][padded[i + o]] for j, o in enumerate(pseudo_lm.OFFSETS)) + p["bias"])
            a, b = h @ p["to_class"] + p["class_bias"], h @ p["to_word"][t // 4] + p["word_bias"][t // 4]
            total += a[t // 4] - np.log(np.exp(a).sum()) + b[t % 4] - np.log(np.exp(b).sum())
        return len(tokens), total

    got = sorted((r.n_tokens, r.log_likelihood) for r in pseudo_lm.score(odd, words, flat, rare, shape).collect())
    want = sorted(naive(r.text) for r in odd.collect())
    assert [n for n, _ in got] == [n for n, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-4)


@pytest.mark.parametrize("shape", [pseudo_lm.Shape(), pseudo_lm.Shape(mask=2, rounds=6), pseudo_lm.Shape(mask=8, rounds=3)])
def test_every_position_is_trained_on(monkeypatch, shape):
    targets = Counter()
    monkeypatch.setattr(pseudo_lm, "gradient", lambda p, shape, line, at, out: targets.update(at.tolist()))
    texts = [np.random.default_rng(i).integers(1, shape.vocabulary, 500) for i in range(10)]
    for round_ in range(shape.rounds):
        trainer = pseudo_lm.Trainer(shape.initial(), shape, round_)
        for ids in texts:
            trainer.add(ids)
        trainer.flush()
    assert set(targets) == set(pseudo_lm.windows(texts)[1].tolist())
    assert set(targets.values()) == {max(1, shape.rounds // shape.mask)}


@pytest.mark.parametrize("lexicon", [100, 0])
def test_words_in_one_bucket_have_their_own_probabilities(spark, lexicon):
    shape = pseudo_lm.Shape(classes=4, buckets=1, width=4, lexicon=lexicon)
    common = " ".join(f"w{i:02}" for i in range(shape.frequent))
    docs = spark.createDataFrame([(i, common + " real" * (i % 2) + " jnku" * (i == 3)) for i in range(40)] + [(40, common)], "doc_id long, text string").repartition(3)
    model = pseudo_lm.train(docs, shape)
    tests = spark.createDataFrame([(0, "w01 real w02"), (1, "w01 jnku w02"), (2, "w01 qzxv w02")], "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in pseudo_lm.score(tests, *model, shape).collect()}
    # All three share the bucket: seen 20 times, once and never.
    assert math.isclose(got[0] - got[1], math.log(20.5 / 1.5), abs_tol=1e-6)
    assert math.isclose(got[1] - got[2], math.log(1.5 / 0.5), abs_tol=1e-6)
    assert len(model[0]) == shape.frequent and model[2].total.tolist() == [21 + 2 + 1]


# op7


def test_license_scan_against_brute_force(spark, odd, empty):
    rng = random.Random(12)
    names = sorted(license_scan.TEMPLATES)
    rows = []
    for d in range(160):
        words = prose(rng, rng.randint(0, 120)).split()
        if d % 2:
            notice = license_scan.TEMPLATES[names[d % len(names)]].split()
            if d % 5 == 0:
                notice = notice[: int(len(notice) * 0.6)]
            at = rng.randint(0, len(words))
            words[at:at] = notice
        rows.append((d, " ".join(words)))

    def shingled(t, q=5):
        w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        return [tuple(w[i : i + q]) for i in range(len(w) - q + 1)]

    expected = {}
    for d, t in rows:
        for name, notice in license_scan.TEMPLATES.items():
            q = min(5, len(shingled(notice, 1)))
            s, want = shingled(t, q), set(shingled(notice, q))
            c = 1
            while c < len(want):
                c *= 2
            best = max((len(want & set(s[i : i + 2 * c])) / len(want) for i in range(0, max(len(s), 1), c)), default=0)
            if best >= 0.8:
                expected[d, name] = best
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.template_id): r.containment for r in license_scan.scan(docs).collect()}
    assert got == pytest.approx(expected) and len(expected) > 20
    assert {(r.doc_id, r.template_id) for r in license_scan.scan(docs, block_templates=3).collect()} == expected.keys()
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0 and license_scan.scan(docs, {}).count() == 0
    short = spark.createDataFrame([(1, "x all rights RESERVED. y"), (2, "all rights"), (3, "rights all reserved"), (4, None)], "doc_id long, text string")
    found = license_scan.scan(short, {"three": "All rights reserved.", "one": "rights", "none": "...", "MIT": license_scan.TEMPLATES["MIT"]}).collect()
    assert {(r.doc_id, r.template_id) for r in found} == {(1, "three"), (1, "one"), (2, "one"), (3, "one")}


def test_licenses_of_rows_that_share_an_id_do_not_mix(spark):
    full = license_scan.TEMPLATES["GPL-notice"]
    fragment, long = " ".join(full.split()[:14]), license_scan.TEMPLATES["MIT-grant"] + " and more " * 4000
    rows = [("a", full), ("a", fragment), (None, fragment), (None, full), ("b", fragment), ("c", long), ("c", long)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(k, t, 0, "x") for k, t in order], "doc_id string, text string, row long, template_id string").repartition(2)
        got = [(r.doc_id, r.template_id, r.containment) for r in license_scan.scan(docs).collect()]
        assert sorted(got, key=str) == sorted([("a", "GPL-notice", 1.0), (None, "GPL-notice", 1.0), ("c", "MIT-grant", 1.0)], key=str)


def test_license_texts_of_pages_length(spark):
    rng = random.Random(31)
    templates = {f"long-{i}": prose(rng, n) for i, n in enumerate((900, 1500, 300))}
    words = templates["long-0"].split()
    changed = [w if i % 150 else "other" for i, w in enumerate(words)]
    rows = [(0, prose(rng, 700) + " " + templates["long-0"] + " " + prose(rng, 300)), (1, " ".join(changed)), (2, " ".join(words[:600])), (3, prose(rng, 2000)), (4, templates["long-1"] + " " + templates["long-2"])]
    got = {(r.doc_id, r.template_id) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert got == {(0, "long-0"), (1, "long-0"), (4, "long-1"), (4, "long-2")}


# op8


def brute_components(rows, q, percent):
    def shingled(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + q]) for i in range(len(w) - q + 1)) if len(w) >= q else frozenset([tuple(w)] if w else [])

    sets = {d: shingled(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("plan", "q", "percent"), [(near_dedup.Plan.near(3, 85), 3, 85), (near_dedup.Plan.near(5, 80), 5, 80), (near_dedup.Plan(3, 85, 9, 8, block_bytes=6000), 3, 85)])
def test_near_duplicates_against_brute_force(spark, plan, q, percent):
    rng = random.Random(15)
    rows = []
    for _ in range(25):
        base = prose(rng, rng.randint(2, 150)).split()
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            rows.append((len(rows), " ".join(copy) if rng.random() < 0.8 else " ".join(copy).upper()))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (len(rows) + 3, "one two"), (len(rows) + 4, "ONE  two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, plan).collect()}
    want = brute_components(rows, q, percent)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (d == want[d][1]) for d, r in got.items())


def test_near_duplicates_on_odd_rows(spark, odd, empty):
    plan = near_dedup.Plan.near(5, 80)
    rows = near_dedup.near_duplicates(odd, plan).collect()
    assert len(rows) == odd.count() and all(r.kept for r in rows if r.n_shingles == 0)
    assert {r.kept for r in rows if r.doc_id == 8} == {False}
    assert near_dedup.near_duplicates(empty, plan).count() == 0
    kept = near_dedup.keep(odd, plan)
    assert kept.columns == odd.columns and 8 not in {r.doc_id for r in kept.collect()}


def near_rows():
    """Two texts under one id, null ids with near copies, an id with a copy of another's text, repeated rows."""
    rng = random.Random(21)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    return [("1", a), ("5", a + " end"), ("5", b), (None, a + " tail"), (None, c), (None, c + " more"), ("7", d), ("7", d), ("9", d + " last"), (None, e), (None, e), ("8", None), (None, "")]


def test_near_duplicates_judge_rows_by_their_texts_whatever_the_ids(spark):
    plan = near_dedup.Plan.near(5, 80)
    rows = near_rows()
    docs = spark.createDataFrame([(k, t, n, "x", "y") for n, (k, t) in enumerate(rows)], "doc_id string, text string, k long, h string, __h string").repartition(3)
    got = near_dedup.near_duplicates(docs, plan).collect()
    alike = [("1", "1", "1", True), ("5", "1", "1", False), ("5", "5", "5", True), (None, None, "1", False), (None, None, None, True), (None, None, None, False), ("7", "7", "7", True), ("7", "7", "7", True), ("9", "9", "7", False), (None, None, None, True), (None, None, None, True), ("8", "8", "8", True), (None, None, None, True)]
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter((k, c, kept) for k, _, c, kept in alike)
    kept = near_dedup.keep(docs, plan)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    named = dict(zip([n for n, _ in enumerate(rows)], [t for _, t in rows]))
    assert Counter(t for t in texts if t and t not in (named[4], named[5])) == Counter([named[0], named[2], named[6], named[9]])
    assert sum(t in (named[4], named[5]) for t in texts) == 1 and sum(not t for t in texts) == 2


def test_blocks_of_one_family_are_dealt_apart(spark):
    plan = near_dedup.Plan(3, 85, 9, 8, block_bytes=6000)
    columns = ["root", "cid", *(f"c{i}" for i in range(9))]
    members = spark.createDataFrame([(1, i, *range(9), b"x" * 1000) for i in range(50)], ", ".join(f"{c} long" for c in columns) + ", shingles binary")
    large = members.groupBy("root").agg(near_dedup._blocks(near_dedup.F.sum(near_dedup.F.length("shingles")), plan).alias("blocks"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = near_dedup._with_plan(members, large, "left").withColumn("block", near_dedup.F.pmod("cid", "blocks"))
        out = near_dedup._dealt(dealt, "block").applyInArrow(lambda t: t.select(["deal"]).slice(0, 1), "deal long")
        plan_text = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(deal" in plan_text and "hashpartitioning(root" in plan_text and "part" in plan_text.split("hashpartitioning(root")[1][:40]
        assert out.distinct().count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_classes_that_share_keys_are_tied():
    rng = np.random.default_rng(5)
    cid, found = rng.permutation(200), rng.integers(0, 900, (200, 6)).astype(np.uint64)
    parent = list(range(200))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, j in itertools.combinations(range(200), 2):
        if set(found[i]) & set(found[j]):
            parent[find(i)] = find(j)
    least = {}
    for i in range(200):
        least[find(i)] = min(least.get(find(i), 1000), int(cid[i]))
    assert near_dedup.tied(cid, found).tolist() == [least[find(i)] for i in range(200)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.v: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}


# op10


def test_shards(spark, odd, empty, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randrange(500), prose(rng, rng.randint(0, 60)) if rng.random() < 0.9 else "same") for _ in range(700)] + [(7, "same")] * 200 + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(sharding, "_COPIES", 64)
    got = sharding.shard_by_bytes(docs, shards=8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    sizes = Counter()
    for s in range(8):
        part = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in part) == list(range(len(part)))
        sizes[s] = sum(r.size for r in part)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    total, before = sum(r.size for r in got), 0
    for r in ordered:
        assert r.shard == min(7, (2 * before + r.size) * 8 // (2 * total))
        before += r.size
    named = spark.createDataFrame([(f"id{d % 40}", t) for d, t in rows if d is not None], "doc_id string, text string").repartition(5)
    strings = sorted(sharding.shard_by_bytes(named, shards=3).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in strings] == sorted(r.doc_id for r in strings) and len(strings) == named.count()
    assert len(sharding.shard_by_bytes(odd).collect()) == odd.count() and sharding.shard_by_bytes(empty).count() == 0


# pipeline


def test_pipeline_stages_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    given = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(3)
    a, b = prose(rng, 90), prose(rng, 90)
    kinds = {f.name: f.dataType for f in given.schema.fields}
    rows = [(None, a), (None, b), (5, prose(rng, 80)), (5, prose(rng, 80)), (7, None), (8, ""), (9, prose(rng, 30_000))]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    odd = odd.select(*(F.col(c).cast(kinds[c]).alias(c) if c in ("doc_id", "text") else F.lit(None).cast(kinds[c]).alias(c) for c in given.columns))
    for (name, stage), docs in itertools.product(pipeline.STAGES, (odd, given.limit(0))):
        out = stage(spark, docs, SF)
        n = out.count()
        assert n <= docs.count()
        if name == "MinHash near-dedup" and docs is odd:
            assert n == len(rows)
        if name not in ("BPE encoding and decoding",):
            assert out.columns == given.columns
    model = langid.fit(given)
    assert langid.keep(odd, model).where("text is null or text = ''").count() == 0
    assert {r.text for r in quality_rules.keep(odd).collect()} == {t for _, t in rows if t and not any(eval(rule, dict(zip(quality_rules.MEASURES, quality_rules.measure_text(t)))) for rule in (quality_rules.RULES[b][1] for b in quality_rules.POLICIES["v2"]))}


def test_pipeline_stages_match_their_operators(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    frames = [docs]
    for _, stage in pipeline.STAGES:
        frames.append(spark.createDataFrame(stage(spark, frames[-1], SF).toPandas()))
    kept = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert all(f.columns == columns for f in frames[1:-1])
    assert all(b <= a for a, b in zip(kept, kept[1:]))
    assert kept[2] == {d for d in kept[1] if not any(eval(rule, dict(zip(quality_rules.MEASURES, quality_rules.measure_text(before[d])))) for rule in (quality_rules.RULES[b][1] for b in quality_rules.POLICIES["v2"]))}
    groups = brute_components([(d, before[d]) for d in kept[2]], 5, 80)
    assert kept[3] == {d for d, (_, c) in groups.items() if d == c}
    items = [decontam.shingles(decontam.terms(r.text), 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d in kept[3] if any(len(s & decontam.shingles(decontam.terms(before[d]), 5)) >= 0.8 * len(s) for s in items)}
    assert kept[4] == kept[3] - held and kept[5] == kept[4]
