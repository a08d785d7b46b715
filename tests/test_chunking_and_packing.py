"""Tokenizers with offsets, semantic chunks from text to text, and packed contexts, each against a plain version."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models, packing, segments, semantic, tokens

P = pytest.importorskip("public_tokenizers")
BPE = tokens.FromFile(P.path("byte_bpe_50k.json"))
RANKS = tokens.FromRanks(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
PATTERN = r"[^\s.!?][^\n.!?]*[.!?]*"
SYLLABLES = "ba re ti lo mun ka pe sol da wi ga nor fe hu".split()


def word(rng):
    return "".join(rng.choices(SYLLABLES, k=rng.randint(1, 3)))


def text_of(rng, n):
    out = []
    for _ in range(n):
        out.append(word(rng) + rng.choice([" "] * 7 + [". ", ".\n", "\n", "! "]))
    return "".join(out)


TEXTS = ["", "one", "  two  words \n", "\n\t ", "é\U0001f600\U0001f600 中文です。 naïve", "a\x00b <|endoftext|> c", text_of(random.Random(1), 700), "x" * 3000]


@pytest.mark.parametrize("maker", [tokens.Words(), BPE, RANKS])
def test_tokens_begin_at_characters_and_give_the_text_back(spark, maker):
    tokenizer = tokens.made(maker)
    for text, first in zip(TEXTS, tokens.starts(tokenizer, TEXTS), strict=True):
        assert first == sorted(first) and (not first or first[0] == 0) and all(0 <= x <= len(text) for x in first)
        cuts = sorted({*first, len(text)})
        assert "".join(text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)) == text
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "k int, text string").withColumn("other", F.lit("x"))
    got = {r.k: r.n_tokens for r in tokens.with_counts(df, maker).collect()}
    assert got == {i: len(x) for i, x in enumerate(tokens.starts(tokenizer, TEXTS))} | {99: None}


def test_known_counts():
    assert tokens.counts(tokens.made(tokens.Words()), ["one two", "one  two ", " ", ""]) == [2, 2, 1, 0]
    bpe, ranks = tokens.made(BPE), tokens.made(tokens.FromRanks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    assert tokens.starts(bpe, ["Hello world, naïve café"]) == tokens.starts(ranks, ["Hello world, naïve café"])
    with pytest.raises(ValueError, match="another text"):
        tokens.starts(tokens.made(tokens.FromFile(P.path("word_bpe_49k.json"))), ["Upper Case  and blanks"])


@pytest.mark.parametrize(("size", "step"), [(1, 1), (8, 5), (64, 64)])
@pytest.mark.parametrize("maker", [BPE, RANKS])
def test_windows_against_a_plain_loop(spark, maker, size, step):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "k int, text string")
    got = sorted(tuple(r) for r in tokens.windows(df, maker, size, step, "k").collect())
    expected = []
    for k, (text, first) in enumerate(zip(TEXTS, tokens.starts(tokens.made(maker), TEXTS), strict=True)):
        n, number = len(first), 0
        for a in range(0, n, step):
            b = min(a + size, n)
            start, stop = first[a], first[b] if b < n else len(text)
            if start < stop:
                expected.append((k, number, a, b, start, stop))
                number += 1
            if b == n:
                break
    assert got == expected
    with pytest.raises(ValueError):
        tokens.windows(df, maker, 3, 4, "k")


@pytest.mark.parametrize("maker", [tokens.Words(), BPE, RANKS])
def test_oversize_texts_come_in_even_pieces(maker):
    tokenizer = tokens.made(maker)
    for text in TEXTS:
        for most in (1, 7, 100):
            n = tokens.counts(tokenizer, [text])[0]
            found = tokens.pieces(tokenizer, text, most)
            at = 0
            for start, stop, m in found:
                part = text[start:stop]
                assert part == part.strip() and part and not text[at:start].strip() and m == tokens.counts(tokenizer, [part])[0]
                assert m <= most or len(part) == 1 or most == 1
                at = stop
            assert not text[at:].strip()
            if maker == tokens.Words() and n > most and text.strip():
                assert len(found) == math.ceil(n / most) and max(m for *_, m in found) - min(m for *_, m in found) <= 1


def plain_groups(held, score, starts, least, most):
    """The three rules one after another, each started anew after every change."""
    n = len(score)
    size = lambda a, b: sum(held[a:b]) + b - a - 1
    groups = list(zip(starts, [*starts[1:], n], strict=True))
    while len(groups) > 1:
        small = [i for i, g in enumerate(groups) if size(*g) < least]
        if not small:
            break
        i = small[0]
        if i == 0:
            at = 0
        elif i == len(groups) - 1:
            at = i - 1
        else:
            at = i - 1 if score[groups[i][0]] >= score[groups[i][1]] else i
        groups[at : at + 2] = [(groups[at][0], groups[at + 1][1])]
    changed = True
    while changed:
        changed = False
        for i, (a, b) in enumerate(groups):
            if size(a, b) > most and b - a > 1:
                cut = min(range(a + 1, b), key=lambda x: score[x])
                groups[i : i + 1] = [(a, cut), (cut, b)]
                changed = True
                break
    while len(groups) > 1:
        for i, (a, b) in enumerate(groups):
            if size(a, b) >= least:
                continue
            sides = []
            if i > 0 and size(groups[i - 1][0], b) <= most:
                sides.append((score[a], 1, i - 1))
            if i + 1 < len(groups) and size(a, groups[i + 1][1]) <= most:
                sides.append((score[b], 0, i))
            if sides:
                at = max(sides)[2]
                groups[at : at + 2] = [(groups[at][0], groups[at + 1][1])]
                break
        else:
            break
    return groups


def test_groups_against_the_rules_one_by_one():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 25)
        held, score = [rng.randint(1, 40) for _ in range(n)], [-1.0] + [rng.choice([0.1, 0.5, 0.9, rng.random()]) for _ in range(n - 1)]
        starts = sorted({0, *rng.sample(range(n), rng.randint(0, n - 1))})
        least, most = rng.choice([(10, 40), (30, 60), (1, 15)])
        total, s = np.concatenate(([0], np.cumsum(np.array(held) + 1))), np.array(score)
        bounds = semantic.large_split(semantic.small_merged([*starts, n], total, s, least), total, s, most)
        bounds = semantic.small_merged(bounds, total, s, least, most)
        assert list(zip(bounds, bounds[1:], strict=False)) == plain_groups(held, score, starts, least, most)


def plain_chunks(text, embed, maker, percentile, least, most, window):
    tokenizer = tokens.made(maker)
    units = [(i, m.start(), m.end()) for i, m in enumerate(re.finditer(r"[^\n]+", text)) if m[0].rstrip()]
    units = [(i, a, a + len(text[a:b].rstrip())) for i, a, b in units]
    over = lambda a, b: [u for u, x, y in units if a < y and x < b]
    rows = [(m.start(), m.start() + len(m[0].rstrip())) for m in re.finditer(PATTERN, text)]
    rows = [(a, b, over(a, b)) for a, b in rows if over(a, b)]
    changed = True
    while changed:
        changed, out, i = False, [], 0
        while i < len(rows):
            a, b, u = rows[i]
            if segments.is_fragment(text[a:b]) and i + 1 < len(rows) and set(u) & set(rows[i + 1][2]):
                out.append((a, rows[i + 1][1], sorted({*u, *rows[i + 1][2]})))
                changed, i = True, i + 2
                continue
            if segments.is_fragment(text[a:b]) and out and set(u) & set(out[-1][2]):
                out[-1] = (out[-1][0], b, sorted({*u, *out[-1][2]}))
                changed = True
            else:
                out.append(rows[i])
            i += 1
        rows = out
    parts = []
    for a, b, _ in rows:
        n = tokens.counts(tokenizer, [text[a:b]])[0]
        parts += [(a, b, n)] if n <= most else [(a + x, a + y, m) for x, y, m in tokens.pieces(tokenizer, text[a:b], most)]
    if not parts:
        return []
    vectors = np.array(embed([text[a:b] for a, b, _ in parts]))
    score = [-1.0]
    for i in range(1, len(parts)):
        x, y = vectors[max(0, i - window) : i].mean(axis=0), vectors[i : i + window].mean(axis=0)
        score.append(float(x @ y / np.sqrt((x @ x) * (y @ y))))
    limit = np.percentile(score[1:], 100 * percentile) if len(parts) > 1 else 0
    starts = [0, *(i for i in range(1, len(parts)) if round(score[i], 9) < round(limit, 9))]
    groups = plain_groups([n for *_, n in parts], score, starts, least, most)
    return [(i, parts[a][0], parts[b - 1][1], text[parts[a][0] : parts[b - 1][1]], b - a, over(parts[a][0], parts[b - 1][1])) for i, (a, b) in enumerate(groups)]


@pytest.mark.parametrize("maker", [tokens.Words(), BPE])
def test_semantic_chunks_against_a_plain_chain(spark, maker):
    from tessera.operators import intervals

    rng = random.Random(6)
    texts = [text_of(rng, n) for n in (0, 1, 30, 200, 900)] + ["One. Two.\n\nThree words here", "\n \n", "é" + text_of(rng, 90) + "\U0001f600 end.", word(rng) * 400]
    df = spark.createDataFrame([*enumerate(texts), (50, None)], "doc long, text string").repartition(3)
    units = intervals.match_spans(df, "text", r"[^\n]+", "doc").select("doc", F.col("place").alias("unit"), "start", "stop")
    embed = models.hash_embedder()
    settings = {"percentile": 0.3, "least": 20, "most": 60, "window": 3}
    rows = semantic.chunks(df, units, embed, maker, **settings).collect()
    got = sorted((r.doc, r.chunk_no, r.start, r.stop, r.text, r.n_sentences, list(r.units)) for r in rows)
    expected = [(d, *c) for d, t in enumerate(texts) for c in plain_chunks(t, embed, maker, *settings.values())]
    assert got == expected
    tokenizer = tokens.made(maker)
    assert all(r.n_tokens == tokens.counts(tokenizer, [r.text])[0] for r in rows)
    for d, text in enumerate(texts):
        at = 0
        for _, _, start, stop, part, *_ in (c for c in got if c[0] == d):
            # Between chunks stands nothing but space and marks that open no sentence.
            assert part == text[start:stop] and start >= at and not re.search(r"\w", text[at:start])
            at = stop
        assert not re.search(r"\w", text[at:])


def plain_pack(bodies, count, budget, target, least):
    taken, out, context = [], [], ""
    for i, body in enumerate(bodies):
        grown = (context + "\n\n" if taken else "") + f"[{len(taken) + 1}] {body}"
        if budget is not None and count(grown) > budget:
            out.append((i, "context_budget"))
            continue
        enough = target is not None and len(taken) >= least
        if enough and count(grown) >= target and abs(count(context) - target) < abs(count(grown) - target):
            out.append((i, "volume_target_closest_prefix"))
            break
        taken.append(i)
        context = grown
        if target is not None and len(taken) >= least and count(context) >= target:
            break
    return taken, out, context


@pytest.mark.parametrize("maker", [tokens.Words(), BPE])
@pytest.mark.parametrize(("budget", "target", "least"), [(None, None, 0), (60, None, 0), (None, 50, 0), (None, 50, 3), (70, 40, 2), (0, None, 0), (None, 0, 0)])
def test_packing_against_a_plain_loop(spark, maker, budget, target, least):
    rng = random.Random(9)
    pools = {q: [text_of(rng, rng.randint(0, 30)) for _ in range(rng.randint(1, 12))] for q in range(8)}
    rows = [(q, i, f"c{i}", b) for q, bodies in pools.items() for i, b in enumerate(bodies)]
    again = [(q, i + 100, c, b) for q, i, c, b in rows if i % 3 == 0]
    df = spark.createDataFrame(rows + again, "query_id long, place int, chunk_id string, body string").repartition(3)
    targets = None if target is None else df.select("query_id", F.lit(target).alias("target")).distinct()
    tokenizer = tokens.made(maker)
    count = lambda t: tokens.counts(tokenizer, [t])[0]
    got = {r.query_id: r for r in packing.assemble(df, maker, budget=budget, targets=targets, least=least, tolerance=0.1).collect()}
    assert got.keys() == pools.keys()
    for q, bodies in pools.items():
        taken, out, context = plain_pack(bodies, count, budget, target, least)
        r = got[q]
        assert (list(r.included), [tuple(x) for x in r.excluded], r.context, r.n_tokens) == ([f"c{i}" for i in taken], [(f"c{i}", w) for i, w in out], context, count(context))
        assert r.n_candidates == len(bodies)
        if target is None:
            assert (r.volume_delta, r.volume_error, r.volume_met) == (None, None, None)
        else:
            error = abs(count(context) - target) / target if target else 0.0
            assert (r.volume_delta, r.volume_error, r.volume_met) == (count(context) - target, pytest.approx(error), error <= 0.1)


def test_a_target_needs_a_tolerance(spark):
    df = spark.createDataFrame([(1, 0, "c", "b")], "query_id long, place int, chunk_id string, body string")
    with pytest.raises(ValueError, match="tolerance"):
        packing.assemble(df, tokens.Words(), targets=df.select("query_id", F.lit(3).alias("target")))


def test_passages_show_where_they_come_from(spark):
    row = spark.range(1).select(packing.body(F.array(F.lit("A Art. 1.1"), F.lit("A Art. 1.2")), F.lit("A"), F.array(F.lit("A Art. 1")), F.lit("Text.")).alias("b")).first()
    assert row.b == "Reference: A Art. 1.1, A Art. 1.2\nDocument: A\nAnswer unit: A Art. 1\nText."
