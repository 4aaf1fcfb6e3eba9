"""Selection, containment, bootstrap lanes, breaker segments and retries
against plain versions."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillmark.operators import analytics as A
from quillmark.operators import chunking as C
from quillmark.operators import evaluation as E
from quillmark.streaming import logs as L


def test_elements_at_any_rank(spark, monkeypatch):
    monkeypatch.setattr(A, "RANKED_VALUES", 60)
    monkeypatch.setattr(A, "SELECTION_CELLS", 64)
    rng = random.Random(1)
    rows = [("skew", rng.random() ** 8) for _ in range(700)] + [("ties", float(rng.randrange(3))) for _ in range(400)] + [("one", 5.0), ("none", None), (None, 1.0), (None, 3.0)]
    rows += [("far", 1e300), ("far", -1e300)] + [("far", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, v double")
    held = defaultdict(list)
    for g, v in rows:
        if v is not None:
            held[g].append(v)
    want = [(g, r) for g, x in held.items() for r in {1, len(x), len(x) // 3 + 1, len(x) // 2 + 1}]
    got = {(r["g"], r["rank"]): r["v"] for r in A.elements_at(df, ["g"], "v", spark.createDataFrame(want, "g string, rank long")).collect()}
    assert got == {(g, r): sorted(held[g])[r - 1] for g, r in want}
    p = {r["g"]: r for r in A.exact_percentiles(df, ["g"], "v", (0.5, 0.95)).collect()}
    for g, x in held.items():
        assert p[g]["n"] == len(x) and abs(p[g]["p50"] - np.quantile(x, 0.5)) <= 1e-6 * max(1, abs(np.quantile(x, 0.5))) and abs(p[g]["p95"] - np.quantile(x, 0.95)) < 2e-6
    assert p["none"]["n"] == 0 and p["none"]["p50"] is None


def test_containment_equals_comparing_all(spark):
    rng = random.Random(2)
    words = ["al", "be", "ga", "de", "Om", "x"]
    texts = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.randrange(0, 14)))) for i in range(150)] + [(900, None), (901, "")]
    sought = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 7)))) for i in range(60)] + [(100, "a"), (101, " GA "), (102, None), (103, "l be g"), (104, "not there at all"), (105, "al"), (105, "de x")]
    t, s = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(sought, "sought_id long, phrase string")
    out = E.containment(t, s)
    want = {(i, j) for i, p in sought if p and p.strip(" ") for j, x in texts if x is not None and p.strip(" ").lower() in x.lower()}
    assert {tuple(r) for r in out.select("sought_id", "text_id").collect()} == want and out.count() == len(want)
    assert not E.containment(t, s.limit(0)).collect() and not E.containment(t.limit(0), s).collect()


def test_bootstrap_lanes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, 500)
    df = spark.createDataFrame([("a", i, float(v), float(v + 0.5)) for i, v in enumerate(x)] + [("b", 1000, 2.0, 2.0), (None, 1001, 4.0, 4.0), ("a", 1002, None, 1.0)], "g string, id long, v double, w double")
    got = {r["g"]: r for r in E.bootstrap(df, "g", "v", 800, key="id").collect()}
    low, high = E.bootstrap_mean(x, 800)
    assert abs(got["a"]["low"] - low) < 0.06 and abs(got["a"]["high"] - high) < 0.06
    assert 0 <= got["b"]["low"] <= got["b"]["high"] <= 2.0 and None in got
    again = {r["g"]: r for r in E.bootstrap(df.repartition(5), "g", "v", 800, key="id").collect()}
    assert abs(again["a"]["low"] - got["a"]["low"]) < 1e-9
    w = E.poisson_draws(np.arange(20_000), np.arange(8), 7)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04
    d = {r["g"]: r for r in E.bootstrap_delta(df, "g", "v", "w", 300, key="id").collect()}
    assert d["a"]["significant"] and abs(d["a"]["delta"] - 0.5) < 1e-9 and not d["b"]["significant"]


def plain_breaker(calls, failures=3, recovery=30.0):
    out, state = [], {}
    for p, t, ok in sorted(calls):
        name, state[p] = L.breaker_step(state.get(p, L.CLOSED), t, ok, failures, recovery)
        out.append((p, t, ok, name))
    return sorted(out)


def test_breaker_steps():
    s = [L.CLOSED]
    names = []
    for t, ok in ((0, False), (1, False), (2, False), (3, True), (32, False), (40, True), (63, True), (64, True)):
        name, state = L.breaker_step(s[-1], t, ok, 3, 30)
        s.append(state)
        names.append(name)
    assert names == ["closed", "closed", "closed", "open", "half_open", "open", "half_open", "closed"]


def test_breaker_over_segments(spark):
    rng = random.Random(4)
    calls = [("a", float(i * rng.choice([1, 1, 5])), rng.random() < 0.3) for i in range(900)] + [("b", float(i), False) for i in range(400)] + [("c", 1.0, True)]
    df = spark.createDataFrame(calls, "provider string, ts double, ok boolean").withColumn("ts", F.col("ts").cast("timestamp")).repartition(4)
    got = L.circuit_breaker(df).select("provider", F.col("ts").cast("double").alias("t"), "ok", "state")
    assert sorted(map(tuple, got.collect())) == plain_breaker(calls)
    assert not L.circuit_breaker(df.limit(0)).collect()


def test_breaker_stream(spark, tmp_path):
    calls = [("a", float(i), i % 7 == 0) for i in range(120)]
    for part in range(3):
        spark.createDataFrame(calls[40 * part : 40 * part + 40], "provider string, ts double, ok boolean").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{part}")
    schema, out = "provider string, ts timestamp, ok boolean", f"{tmp_path}/out"
    for part in range(3):
        s = L.breaker_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"))
        s.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(out).awaitTermination(120)
    got = spark.read.parquet(out).select("provider", F.col("ts").cast("double").alias("t"), "ok", "state")
    assert sorted(map(tuple, got.collect())) == plain_breaker(calls)


def test_retries_with_timers(spark, tmp_path):
    assert L.backoff("k", 1, 1.0, 30.0) < 2.0 <= L.backoff("k", 2, 2.0, 30.0) and L.backoff("k", 9, 1.0, 30.0) == 30.0
    schema = "request_id long, ok boolean, transient boolean"
    put = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    put([(1, True, False), (2, False, True), (3, False, False), (4, False, True)], 0)
    s = L.retries(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), most=2, base_s=0.05, most_s=0.2)
    q = s.writeStream.format("memory").queryName("retries_out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()

    def seen():
        return {tuple(r) for r in spark.table("retries_out").collect()}

    def wait(want):
        end = time.time() + 60
        while not want <= seen() and time.time() < end:
            time.sleep(0.3)
        assert want <= seen()

    try:
        wait({(1, 1, "done"), (3, 1, "dead"), (2, 2, "retry"), (4, 2, "retry")})
        put([(2, True, False), (4, False, True), (1, False, True)], 1)  # the last one is a replay of a settled request
        wait({(2, 2, "done"), (4, 2, "dead")})
        assert len(seen()) == 6
    finally:
        q.stop()


def test_unit_passes_nulls_and_unjudged_rows_score_nothing(spark):
    r = spark.createDataFrame([(1,), (2,), (3,)], "question_id long")
    v = spark.createDataFrame([(1, True, 1.5), (2, False, 0.5)], "question_id long, correct boolean, completeness double")
    assert {x["question_id"]: x["overall_score"] for x in E.judged(r, v).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_recursive_chunks_by_tokens(spark):
    words = C.counter("words")
    assert C.split_tokens("a b c", words, 3, 1) == ["a b c"]
    assert C.split_tokens("a b c d e", words, 2, 0) == ["a b", "c d", "e"]
    assert C.split_tokens("a b c d e", words, 3, 1) == ["a b c", "c d e"]
    # Paragraphs that fit stay whole; one that does not is cut at the next separators, then neighbours join.
    assert C.split_tokens("a b\n\nc d e f g\n\nh", words, 3, 0) == ["a b", "c d e", "f g\n\nh"]
    assert C.split_tokens("abcdef", len, 4, 2) == ["abcd", "cdef"]
    assert C.counter("approx")("12345678") == 2
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["aa ", "b", ". ", "\n", "\n\n", " c"]) for _ in range(rng.randrange(1, 80)))
        size = rng.randrange(1, 9)
        plain = C.split_tokens(text, words, size, 0)
        assert "".join("".join(plain).split()) == "".join(text.split()) or "." in text
        assert all(words(p) <= size + 1 for p in plain)
    docs = spark.createDataFrame([(1, "a b c d e", "s"), (2, " \n ", "s"), (3, None, "s")], "id long, content string, source_type string")
    got = [tuple(r) for r in C.recursive(docs, size=2, overlap=0).select("id", "content", "chunk_index").orderBy("id").collect()]
    assert got == [("1_chunk_0", "a b", 0), ("1_chunk_1", "c d", 1), ("1_chunk_2", "e", 2)]
    n = {r["id"]: (r["n_tokens"], r["q"]) for r in C.token_counts(C.token_counts(docs), kind="approx", out="q").collect()}
    assert n == {1: (5, 2), 2: (0, 0), 3: (0, 0)}
