"""Audit allocation, spot checks, bucketed upserts and the generator, against plain versions and stubs."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import checks, models, ranking, sampling, spots, stats
from tessera.sources import writers
from tessera.streaming import updates


def plain_allocation(counts, size):
    by, rare = Counter(), Counter()
    for (c, b), n in counts.items():
        by[c] += n
        rare[c] += n * (b != "high")
    raw = {c: size * n / sum(by.values()) for c, n in by.items()}
    target = {c: int(x) for c, x in raw.items()}
    for c in sorted(by, key=lambda c: (raw[c] - target[c], rare[c], by[c], c), reverse=True)[: size - sum(target.values())]:
        target[c] += 1
    shares = {}
    for c in by:
        bands = {b: n for (d, b), n in counts.items() if d == c}
        if len(bands) > target[c]:
            chosen = sorted(bands, key=lambda b: (bands[b], b))[: target[c]]
            shares |= {(c, b): int(b in chosen) for b in bands}
            continue
        free, rest = {b: n - 1 for b, n in bands.items()}, target[c] - len(bands)
        got = dict.fromkeys(bands, 1)
        if rest > 0 and sum(free.values()):
            part = {b: rest * n / sum(free.values()) for b, n in free.items()}
            more = {b: min(free[b], int(x)) for b, x in part.items()}
            left = rest - sum(more.values())
            got = {b: 1 + more[b] for b in bands}
            for b in sorted(free, key=lambda b: (part[b] - more[b], free[b], b), reverse=True):
                if left and got[b] < bands[b]:
                    got[b] += 1
                    left -= 1
        shares |= {(c, b): n for b, n in got.items()}
    return shares


def test_allocation_against_a_plain_solver(spark):
    rng = random.Random(3)
    for _ in range(12):
        counts = {(c, b): rng.choice([1, 1, 2, 5, 30, 200]) for c in "abcdef" for b in ("high", "mid", "low", "zero") if rng.random() < 0.7}
        df = spark.createDataFrame([(c, b, n) for (c, b), n in counts.items()], "condition string, band string, n long")
        for size in (2, 7, 40, sum(counts.values())):
            got = {(r.condition, r.band): r.share for r in sampling.allocation(df, size).collect()}
            assert got == plain_allocation(counts, size)
            assert all(got[k] <= counts[k] for k in got) and (size > sum(counts.values()) or sum(got.values()) <= size)


def test_published_sample_keeps_each_middle_row(spark):
    rows = [(c, i, "high" if i < 10 else "mid") for c in ("x", "y", "z") for i in range(11)]
    df = spark.createDataFrame(rows, "condition string, query_id int, band string")
    shares = sampling.allocation(df.groupBy("condition", "band").agg(F.count(F.lit(1)).alias("n")), 6)
    got = sampling.picked(df, shares, F.concat_ws("|", "condition", F.col("query_id").cast("string")), "condition", "band").collect()
    assert len(got) == 6 and {(r.condition, r.query_id) for r in got if r.band == "mid"} == {(c, 10) for c in "xyz"}


def test_picks_are_the_least_digests(spark):
    import hashlib

    rows = [(s, i) for s, n in (("a", 900), ("b", 3), ("c", 50)) for i in range(n)]
    shares = {"a": 40, "b": 9, "c": 0}
    df = spark.createDataFrame(rows, "s string, k int").repartition(3)
    found = sampling.picked(df, spark.createDataFrame(list(shares.items()), "s string, share long"), F.col("k"), "s").collect()
    got = defaultdict(set)
    for r in found:
        got[r.s].add(r.k)
    for s, n in shares.items():
        own = sorted((k for t, k in rows if t == s), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
        assert got[s] == set(own[:n])


def test_families_move_and_adjust_apart(spark):
    df = spark.createDataFrame([("a", 0.01, 30), ("b", 0.04, 20), ("c", 0.001, 19), ("d", 0.5, None)], "test string, p double, n int")
    got = {r.test: (r.family, r.p_holm) for r in stats.families(df, F.col("n") >= 20, "p").collect()}
    assert got == {"a": ("confirmatory", 0.02), "b": ("confirmatory", 0.04), "c": ("exploratory", None), "d": ("exploratory", None)}


def test_stored_rankings_are_scored_at_each_cut(spark):
    stored = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["c"]), (2, 2, ["z"]), (3, 1, ["a"])], "query_id int, rank int, units array<string>")
    gold = spark.createDataFrame([(1, "c"), (2, "z")], "query_id int, unit string")
    got = {(r.query_id, r.k): (r.recall, round(r.precision, 6), round(r.mrr, 6)) for r in ranking.rescored(stored, gold, (1, 2)).collect()}
    assert got == {(1, 1): (0.0, 0.0, 0.0), (1, 2): (1.0, 0.333333, 0.333333), (2, 1): (0.0, 0.0, 0.0), (2, 2): (1.0, 1.0, 1.0)}


def test_anchors_come_from_the_first_pool(spark):
    docs = spark.createDataFrame([("p", 100), ("q", 100), ("r", 100), ("s", 100), ("t", 100)], "doc string, length int")
    chunks = spark.createDataFrame(
        [("p", 1, 0, 10, 7), ("p", 2, 40, 60, None), ("p", 3, 90, 99, 7), ("q", 1, 0, 10, None), ("q", 2, 45, 55, 3), ("r", 1, 0, 10, 3), ("r", 2, 45, 55, None), ("s", 2, 40, 60, None), ("s", 1, 41, 60, None)],
        "doc string, chunk_id int, start int, stop int, parent int",
    )
    edges = spark.createDataFrame([("p", 1, 3), ("p", 2, 1), ("p", 1, 3), ("p", 1, 9), ("q", 1, 2)], "doc string, chunk_id int, target int")
    found = spots.anchors(docs, chunks, edges, 20)
    assert {r.doc: (r.anchor, r.pool, r.low, r.high) for r in found.collect()} == {"p": (1, "parent_and_edges", 0, 25), "q": (1, "edges", 0, 25), "r": (1, "parent", 0, 25), "s": (1, "any", 30, 70)}
    seen = spots.tracks(chunks.select(F.lit("base").alias("config"), "doc", "chunk_id", "start", "stop"), found)
    assert {(r.doc, r.chunk_id): (r.holds_center, r.left_percent, r.width_percent) for r in seen.where("doc in ('p', 's')").collect()} == {("p", 1): (True, 0.0, 40.0), ("s", 1): (True, 27.5, 47.5), ("s", 2): (False, 25.0, 50.0)}
    assert [tuple(r) for r in spots.cited(found, chunks, edges, chunks).where("doc = 'p'").collect()] == [("p", 1, 7, 3, False)]


SCHEMA = "k int, v string"


def rows_of(spark, path):
    return {tuple(r) for r in writers.read_buckets(spark, path, SCHEMA).collect()}


def folders(spark, path):
    return json.loads(max((path / "_commits").glob("*.json")).read_text())["where"]


def test_bucketed_upsert_writes_only_its_buckets(spark, tmp_path):
    path = tmp_path / "t"
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert writers.read_buckets(spark, str(path), SCHEMA).count() == 0
    assert writers.upsert_buckets(spark, str(path), make([(i, "a") for i in range(200)]), "k", batch=0, buckets=8)
    first = folders(spark, path)
    assert len(first) == 8
    assert writers.upsert_buckets(spark, str(path), make([(5, "b"), (1000, "c")]), "k", batch=1)
    second = folders(spark, path)
    changed = {b for b in second if second[b] != first[b]}
    assert 1 <= len(changed) <= 2
    assert rows_of(spark, str(path)) == {(i, "a") for i in range(200) if i != 5} | {(5, "b"), (1000, "c")}
    assert not writers.upsert_buckets(spark, str(path), make([(5, "again")]), "k", batch=1)
    assert (5, "b") in rows_of(spark, str(path))
    with pytest.raises(Exception, match="more than one new row"):
        writers.upsert_buckets(spark, str(path), make([(5, "x"), (5, "y")]), "k", batch=2)
    with pytest.raises(ZeroDivisionError):
        writers.upsert_buckets(spark, str(path), make([(6, "lost")]), "k", batch=2, before_commit=lambda: 1 / 0)
    assert (6, "a") in rows_of(spark, str(path)) and folders(spark, path) == second
    assert writers.upsert_buckets(spark, str(path), make([(6, "found")]), "k", batch=2)
    assert (6, "found") in rows_of(spark, str(path)) and (6, "a") not in rows_of(spark, str(path))
    # Only what the last two commits name is left.
    kept = set(folders(spark, path).values()) | set(second.values())
    assert {p.name for p in path.glob("merge-*")} <= kept


def test_bucketed_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], SCHEMA).coalesce(1).write.parquet(src)
    run = lambda: updates.upsert_stream(spark.readStream.schema(SCHEMA).parquet(src), out, str(tmp_path / "cp"), "k", buckets=4).awaitTermination()
    run()
    spark.createDataFrame([(2, "d"), (3, "e")], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run()
    assert rows_of(spark, out) == {(1, "a"), (2, "d"), (3, "e")}


class Stub:
    """Refuses two parameters one after the other, is away once, and never answers one question."""

    def __init__(self):
        self.calls, self.away = [], True

    def __call__(self, messages, **params):
        self.calls.append(dict(params))
        text = messages[-1]["content"]
        if "max_tokens" in params:
            raise models.BadRequest("Unsupported parameter: 'max_tokens'")
        if "temperature" in params:
            raise models.BadRequest("Temperature is not supported")
        if self.away:
            self.away = False
            raise models.Unavailable("busy")
        if text == "never":
            raise models.Unavailable("still busy")
        if text == "refused":
            raise models.BadRequest("content")
        return {"answer_text": text.upper(), "finish_reason": "stop", "usage": {"total_tokens": len(text)}}


def test_generator_falls_back_and_stays_so():
    stub = Stub()
    g = models.Generator(stub, {"model": "m", "max_tokens": 9, "temperature": 0.0}, wait=lambda n: None)
    first = g.answer([{"role": "user", "content": "hi"}])
    assert first[:2] == ("HI", "stop") and json.loads(first[3]) == {"model": "m", "max_completion_tokens": 9} and first[4] == 4 and first[5] >= 0 and first[7] is None
    before = len(stub.calls)
    assert g.answer([{"role": "user", "content": "again"}])[4] == 1
    assert stub.calls[before:] == [{"model": "m", "max_completion_tokens": 9}]
    refused = g.answer([{"role": "user", "content": "refused"}])
    assert refused[0] is None and refused[4] == 1 and refused[7] == "content"
    never = g.answer([{"role": "user", "content": "never"}])
    assert never[0] is None and never[4] == 4 and never[7] == "still busy"


def test_generation_over_rows(spark):
    def ask(messages, **params):
        if "temperature" in params:
            raise models.BadRequest("no temperature here")
        if messages[0]["content"] == "bad":
            raise models.BadRequest("content")
        return {"answer_text": messages[0]["role"] + messages[0]["content"], "usage": {"total_tokens": 3}}

    rows = spark.createDataFrame([(1, "c", [("user", "x")]), (2, "c", [("user", "bad")])], "query_id int, condition_id string, messages array<struct<role: string, content: string>>")
    got = {r.query_id: r for r in models.generate(rows, ask, {"temperature": 1.0}, "query_id", "condition_id", wait=lambda n: None).collect()}
    assert (got[1].answer_text, got[1].usage, got[1].problem, got[1].condition_id) == ("userx", {"total_tokens": 3}, None, "c")
    assert (got[2].answer_text, got[2].problem, got[2].elapsed_seconds) == (None, "content", None)
    assert got[1].elapsed_seconds >= 0 and len(got[1].generated_at) == 20 and got[1].generated_at.endswith("Z")


def test_times_of_single_embeddings_and_of_queries(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, text string")
    got = {r.k: r for r in models.timed_embeddings(rows, models.hash_embedder(4)).collect()}
    assert len(got[1].embedding) == 4 and got[1].embedding_seconds >= 0 and (got[2].embedding, got[2].embedding_seconds) == (None, None)
    from datetime import UTC, datetime

    stamp = datetime.strptime(spark.range(1).select(models.utc_timestamp().alias("t")).first().t, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
    assert abs((datetime.now(UTC) - stamp).total_seconds()) < 120


def test_usage_adds_numbers_and_carries_the_last_of_others(spark):
    rows = [(1, 1, '{"total": 3, "cached": true, "model": "a", "flag": false, "odd": 2}'), (1, 2, '{"total": 4.5, "cached": false, "model": "b", "odd": true}'), (1, 3, None), (1, 4, "{"), (2, 1, '{"gone": "x", "n": 1}'), (2, 5, '{"kept": null, "n": null}')]
    found = checks.merged_usage(spark.createDataFrame(rows, "k int, at int, usage string"), "k", "at", "usage").collect()
    assert {(r.k, r.name): (r.total, r.carried) for r in found} == {(1, "total"): (7.5, None), (1, "cached"): (None, "false"), (1, "model"): (None, "b"), (1, "odd"): (3.0, None), (2, "n"): (1.0, None), (2, "kept"): (None, None)}


def test_a_report_is_one_indented_document(spark, tmp_path):
    path = tmp_path / "report"
    writers.write_json_document(spark.createDataFrame([(2, "b"), (1, None)], "k int, v string").coalesce(1), str(path))
    text = next(path.glob("part-*")).read_text()
    assert json.loads(text) == [{"k": 2, "v": "b"}, {"k": 1, "v": None}] and text.count("\n") > 5 and text.endswith("\n")
