"""Ranks, quantiles, resampling and search without a group or a query set in one place, against plain loops."""

import math
import random
import statistics as plain
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bootstrap, ordering, pvalues, stats, vectors


def nasty(rng, n):
    kinds = [lambda: rng.uniform(-1, 1), lambda: rng.choice([0.0, -0.0, 1.0, -1.0]), lambda: rng.gauss(0, 1e12), lambda: rng.uniform(0.5, 0.5001), lambda: round(rng.gauss(0, 3), 1), lambda: rng.choice([1e-300, -1e-300, 5e-10, 1e300, -1e300, math.inf, -math.inf, 1e308])]
    return [rng.choice(kinds)() for _ in range(n)]


def average_ranks(values):
    order = sorted(values)
    first, many = {}, Counter(values)
    for i, v in enumerate(order):
        first.setdefault(v, i + 1)
    return [first[v] + (many[v] - 1) / 2 for v in values]


def test_ranks_against_plain_ranks(spark):
    rng = random.Random(1)
    groups = {"a": nasty(rng, 700), "b": [2.5] * 40, "c": [7.0], "d": [x / 7 for x in range(-300, 300)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None), ("a", math.nan)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {(r.g, r.v): (r.t, r.n, r.r) for r in ordering.ranked(ordering.counted(df, "x", "g"), "g").collect()}
    expected = {}
    for g, vs in groups.items():
        many = Counter(vs)
        expected |= {(g, v): (many[v], len(vs), r) for v, r in zip(vs, average_ranks(vs), strict=True)}
    assert got == expected
    alone = {r.v: r.r for r in ordering.ranked(ordering.counted(df.where("g = 'd'"), "x")).collect()}
    assert alone == dict(zip(groups["d"], average_ranks(groups["d"]), strict=True))


def test_quantiles_against_sorting(spark):
    rng = random.Random(2)
    groups = {"a": [v for v in nasty(rng, 501) if math.isfinite(v)], "b": [2.5] * 40, "c": [7.0], "d": [float(x) for x in range(10)], "e": [rng.uniform(10, 10.001) for _ in range(400)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("z", None)], "g string, x double").repartition(3)
    wanted = {"q0": 0.0, "q30": 0.3, "q50": 0.5, "q95": 0.95, "q100": 1.0}

    def exact(vs, q):
        vs, at = sorted(vs), q * (len(vs) - 1)
        low, high = math.floor(at), math.ceil(at)
        return vs[low] if vs[low] == vs[high] else (high - at) * vs[low] + (at - low) * vs[high]

    got = {r.g: tuple(r)[1:] for r in ordering.quantiles(df, "x", wanted, "g").collect()}
    assert got == {g: tuple(exact(vs, q) for q in wanted.values()) for g, vs in groups.items()}
    whole = [v for vs in groups.values() for v in vs]
    assert tuple(ordering.quantiles(df, "x", wanted).first()) == tuple(exact(whole, q) for q in wanted.values())
    assert tuple(ordering.quantiles(df.limit(0), "x", {"q": 0.5}).first()) == (None,)


def test_no_window_holds_a_group(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, x double")
    for found in (ordering.ranked(ordering.counted(df, "x", "g"), "g"), ordering.quantiles(df, "x", {"q": 0.5}, "g"), stats.wilcoxon(df, "x", "g"), stats.spearman(df.withColumn("y", F.col("x")), "x", "y", "g")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window" in line]
        # Values are put in order within a cell; by group alone only steps are, of which there is a bounded number.
        assert windows and all("cell#" in line for line in windows if " v#" in line or "size#" in line)


def signed_rank(differences):
    d = [x for x in (round(v, 12) for v in differences) if x != 0]
    ranks = average_ranks([abs(x) for x in d])
    return d, ranks, sum(r for r, x in zip(ranks, d, strict=True) if x > 0), sum(r for r, x in zip(ranks, d, strict=True) if x < 0)


def test_signed_rank_tests_against_all_signs(spark):
    rng = random.Random(5)
    groups = {f"g{n}": [rng.choice([-2, -1, 1, 2, 3, 0]) for _ in range(n)] for n in (1, 4, 9, 12)} | {"large": [rng.gauss(0.2, 1) for _ in range(80)], "tied": [rng.choice([-1.0, 1.0, 2.0]) for _ in range(60)], "zero": [0.0, 1e-13]}
    df = spark.createDataFrame([(g, i, float(v)) for g, vs in groups.items() for i, v in enumerate(vs)], "g string, k int, d double").repartition(3)
    got = {r.g: r for r in pvalues.signed_rank_tests(df, "d", "g").collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        d, ranks, plus, minus = signed_rank(vs)
        n, r = len(d), got[g]
        assert (r.n, r.w_plus, r.w_minus) == (n, plus, minus)
        if not n:
            assert (r.p, r.method) == (1.0, "none")
            continue
        assert r.rank_biserial == pytest.approx((plus - minus) / (n * (n + 1) / 2))
        if n <= 12:
            sums = [sum(x for i, x in enumerate(ranks) if bits >> i & 1) for bits in range(1 << n)]
            low, high = sum(s <= plus for s in sums), sum(s >= plus for s in sums)
            assert r.method == "exact" and r.p == pytest.approx(min(1, 2 * min(low, high) / len(sums)))
        else:
            ties = sum(t**3 - t for t in Counter(map(abs, d)).values())
            z = (min(plus, minus) - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
            assert r.method == "normal" and r.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_spearman_against_plain_correlation(spark):
    rng = random.Random(6)
    pairs = [(rng.choice("ab"), rng.randint(0, 9), round(rng.gauss(0, 1), 1)) for _ in range(300)] + [("c", 1, 2.0), ("c", 1, 3.0)]
    got = {r.g: (r.n, r.rho) for r in stats.spearman(spark.createDataFrame(pairs, "g string, x int, y double"), "x", "y", "g").collect()}
    for g in "ab":
        xs, ys = zip(*((x, y) for h, x, y in pairs if h == g), strict=True)
        assert got[g] == (len(xs), pytest.approx(plain.correlation(average_ranks(xs), average_ranks(ys))))
    assert got["c"] == (2, None)


def mixed(x):
    for _ in range(2):
        x = ((x >> 16) ^ x) * 0x45D9F3B % 2**32
    return (x >> 16) ^ x


def test_bootstrap_against_the_plain_loop(spark):
    rng = random.Random(7)
    groups = {"a": [rng.gauss(1, 2) for _ in range(37)], "b": [3.0], "c": [rng.random() for _ in range(150)]}
    df = spark.createDataFrame([(g, i * 3, v) for g, vs in groups.items() for i, v in enumerate(vs)] + [("a", 1, None)], "g string, k int, v double").repartition(4)
    got = {r.g: (r.ci_low, r.ci_high) for r in bootstrap.interval(df, "k", "v", "g", draws=400).collect()}
    for g, vs in groups.items():
        means = sorted(sum(vs[mixed(mixed(i) ^ mixed(j)) % len(vs)] for j in range(len(vs))) / len(vs) for i in range(1, 401))
        assert got[g] == (pytest.approx(means[9], abs=1e-8), pytest.approx(means[389], abs=1e-8))


def test_bootstrap_over_blocks(spark):
    rng = np.random.default_rng(8)
    values = rng.gamma(2.0, 3.0, 3000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k long, v double").repartition(3)
    # Ones in place of values count the picks: every draw picks as many as there are rows.
    counts = bootstrap.draw_sums(df.withColumn("v", F.lit(1.0)), "k", "v", draws=300, block=200).collect()
    assert len(counts) == 300 and all(r.total == r.n == 3000 for r in counts)
    r = bootstrap.interval(df, "k", "v", draws=2000, block=200).first()
    spread = values.std() / math.sqrt(3000)
    assert r.ci_low == pytest.approx(values.mean() - 1.96 * spread, abs=0.35 * spread) and r.ci_high == pytest.approx(values.mean() + 1.96 * spread, abs=0.35 * spread)
    assert bootstrap.interval(df, "k", "v", draws=2000, block=200).first() == r


def test_search_in_a_grid_and_by_broadcast_against_sorting(spark):
    rng = np.random.default_rng(9)
    stored = rng.normal(size=(600, 8)).round(2)
    stored[300:330] = stored[:30]  # equal vectors tie
    codes = rng.integers(0, 5, 600)
    asked = rng.normal(size=(70, 8)).round(2)
    scopes = [None, [0], [1, 2], [9]]
    chunks = spark.createDataFrame([(i, int(codes[i]), stored[i].tolist()) for i in range(600)], "chunk_id long, document_code int, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(1000 + i, scopes[i % 4], asked[i].tolist()) for i in range(70)], "query_id long, allowed array<int>, embedding array<double>").repartition(3)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scores = np.round(unit(asked) @ unit(stored).T, 9)
    expected = defaultdict(list)
    for i in range(70):
        inside = [j for j in range(600) if scopes[i % 4] is None or codes[j] in scopes[i % 4]]
        expected[1000 + i] = sorted(inside, key=lambda j: (-scores[i, j], j))[:7]
    for settings in ({}, {"held": 0, "strip": 16, "lanes": 3}, {"held": 0}):
        got = defaultdict(list)
        for r in vectors.top_k(chunks, queries, 7, **settings).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.chunk_id)
        assert {q: got[q] for q in expected} == expected
    jobs = []
    for n in (10, 70):
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        plan = vectors.top_k(chunks, queries.limit(n), 7, held=5, strip=4)._jdf.queryExecution().optimizedPlan().toString()
        jobs.append((len(plan.splitlines()), len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before)))
    assert jobs[0] == jobs[1]
    assert vectors.top_k(chunks, queries.limit(0), 7).count() == 0
    assert vectors.top_k(chunks.limit(0), queries, 7, held=0).count() == 0
