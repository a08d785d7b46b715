"""Brute-force versions and odd inputs of SimHash near-duplicates, the divergence audit and the prefix trie."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import divergence, prefix_trie, simhash

SYLLABLES = "ba re ti lo mun ka pe sol da wi ga nor fe hu".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def odd_texts():
    long = prose(random.Random(1), 20_000)
    return [None, "", "  \n\t ", "one", "one two", "ONE two", "éè 中文 ٠ É", long, long, "x" * 30_000, "a\x00b <|endoftext|> c", "12 34 !!", "one two three four", "a b c d e f"]


# op11


def brute_fingerprint(text, q=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    grams = [" ".join(words[i : i + q]) for i in range(max(1, len(words) - q + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits):
    names = list(dict.fromkeys(values))
    root = {v: v for v in names}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, x in enumerate(names):
        for y in names[:i]:
            if (x ^ y).bit_count() <= bits:
                root[find(x)] = find(y)
    return {v: find(v) for v in names}


def brute_near(rows, bits=4):
    prints = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(prints, bits)
    least = {}
    for (k, _), f in zip(rows, prints, strict=True):
        if k is not None:
            least[comp[f]] = min(k, least.get(comp[f], k))
    return Counter((k, f"{f:016x}", least.get(comp[f])) for (k, _), f in zip(rows, prints, strict=True))


def near_rows(seed=7):
    rng = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(3, "one"), (None, "one"), (None, "never seen before"), (3, "one")]
    at = 100
    for _ in range(12):
        base = prose(rng, rng.randint(30, 150)).split()
        for _ in range(rng.randint(2, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            rows.append((at := at + 1, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [8192, 5])
def test_simhash_against_brute_force(spark, block):
    rows = near_rows()
    docs = spark.createDataFrame([(k, t, "clash", 0, 0) for k, t in rows], "doc_id long, text string, fp string, deal int, component_id int").repartition(3)
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs, simhash.Plan(block=block)).collect())
    assert got == brute_near(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [2, 4, 7])
@pytest.mark.parametrize("block", [8192, 40])
def test_links_connect_all_that_is_near(spark, bits, block):
    rng = random.Random(bits)
    values = set()
    for _ in range(60):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(rng.randint(0, 14)):
            for b in rng.sample(range(64), rng.randint(1, bits + 1)):
                v ^= 1 << b
            values.add(v)
    hub = rng.getrandbits(64)  # many share two whole segments: crowded keys with several components
    values |= {hub ^ rng.getrandbits(9) << 50 for _ in range(200)}
    values |= {hub ^ rng.getrandbits(9) << 3 for _ in range(200)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), simhash.Plan(bits=bits, block=block)).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= bits for r in links)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in links:
        root[find(r.a & mask)] = find(r.b & mask)
    brute = brute_components(values, bits)
    assert len({(find(v), brute[v]) for v in values}) == len(set(brute.values())) == len({find(v) for v in values})


def test_variants_meet_by_deleted_bits(spark):
    rng = random.Random(3)
    for bits in (2, 4, 6):
        plan = simhash.Plan(bits=bits)
        pairs = [(v := rng.getrandbits(63), v ^ sum(1 << b for b in rng.sample(range(63), bits))) for _ in range(40)]
        keys = spark.createDataFrame([(i, v) for i, p in enumerate(pairs) for v in p], "pair int, fp long").select("pair", "fp", simhash.variants(plan).alias("key"))
        met = keys.groupBy("pair", "key").agg(F.count_distinct("fp").alias("n")).where("n = 2").select("pair").distinct()
        assert met.count() == len(pairs)


def test_dense_runs_give_few_links():
    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 1 << 11, 3000))
    links = simhash.link_runs(np.zeros(len(fp), np.int64), fp, 4)
    assert len(links) == len(fp) - 1


# op12


def brute_divergence(rows, least=30, top=50):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(divergence.TERM, lower(text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - whole[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i + 1) for i, (t, v) in enumerate(items[:most])]
    return sorted(out)


def test_divergence_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(t, "en", "odd") for t in odd_texts()] + [("alone", None, None), ("alone", "", ""), (None, "xx", "a"), ("", "xx", "b"), ("w", "yy", "z")]
    for _ in range(400):
        words = prose(rng, rng.randint(0, 40)).split()
        rows.append((" ".join(rng.choice((w, w.upper(), w + "1" + w, "É" + w, w + "é")) for w in words), rng.choice(("en", "fr")), rng.choice(("s1", "s1", "s2", "é", "z"))))
    docs = spark.createDataFrame([(t, g, s, 1, "x") for t, g, s in rows], "text string, lang string, source string, n int, term string").repartition(5)
    for least, top in ((30, 50), (3, 4)):
        got = sorted(tuple(r) for r in divergence.divergence(docs, min_docs=least, top=top).collect())
        assert got == brute_divergence(rows, least, top)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_do_not_overflow(spark):
    big = 9 * 10**18
    row = spark.createDataFrame([(big // 2, big, 10**9)], "n long, t long, v long").select(divergence.share("n", "t", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (big // 2 + 5) // (big + 5 * 10**9)


# op13


def brute_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())
    )


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}


def rebuild(convs):
    out = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + ts[h:]
    return out


def talks():
    rng = random.Random(13)
    lines = [prose(rng, 3) for _ in range(3)] + ["", None, "é\U0001f600 x"]
    rows = []
    for c in [*range(0, 60), *range(100, 160), *range(250, 270), 1000]:
        deep = 400 if c in (7, 8) else rng.randint(1, 9)
        for turn in range(deep):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(("user", None)) if turn else "user", lines[0] if turn < 2 and rng.random() < 0.7 else rng.choice(lines) if deep < 400 else lines[0]))
    for c in range(300, 340):  # copies
        rows += [(c, t, "user", "same") for t in range(6)]
    rows += [(2000, 1, "user", "tie b"), (2000, 1, "user", "tie a"), (2000, 1, "user", "tie a"), (None, 0, "user", "no conversation"), (2001, 0, "user", "y" * 50_000)]
    return rows


def as_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("small", [20_000, 150, 0])
def test_trie_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "_IDS", 4)
    rows = [r for r in talks() if small or r[0] not in (7, 8)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, depth int").repartition(5)
    assert as_rows(prefix_trie.rebuilt_trie(df, small=small)) == brute_trie(rebuild(ordered(rows)))
    if small == 150:
        assert as_rows(prefix_trie.prefix_trie(df, small=small)) == brute_trie(ordered(rows))
        assert prefix_trie.rebuilt_trie(df.limit(0)).count() == 0
        assert prefix_trie.rebuilt_trie(df.where("conv_id is null")).count() == 0


def test_long_shared_openings_need_no_round_each(spark):
    rows = [(c, t, "user", f"{t}" if t < 300 else f"{t} {c}") for c in (1, 2) for t in range(320)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = as_rows(prefix_trie.prefix_trie(df))
    assert got == brute_trie(ordered(rows))


def test_copies_of_one_conversation_are_one_chain(spark):
    rows = [(c, t, "user", f"{t}") for c in range(1, 12) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert as_rows(prefix_trie.prefix_trie(df, small=0)) == brute_trie(ordered(rows))
