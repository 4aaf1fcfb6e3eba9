"""The engine's own operators on small tables."""

from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark import catalog
from quillmark import schemas as S
from quillmark.functions import text as T
from quillmark.operators import analytics as A
from quillmark.operators import chunking as C
from quillmark.operators import dedup as D
from quillmark.operators import evaluation as E
from quillmark.operators import layout as L
from quillmark.operators import retrieval as R
from quillmark.plans import adapters as AD
from quillmark.plans import pipelines as P
from quillmark.sources import readers as RD
from quillmark.sources import writers as W
from quillmark.streaming import logs as G


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f("c").alias("x")).first()["x"]


def col(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# Text


def test_text_functions(spark):
    assert one(spark, "  A  b\tC ", T.tokens) == ["a", "b", "c"]
    assert one(spark, "a\n\n\n\nb \n", T.collapse_blank_lines) == "a\n\nb"
    assert one(spark, " what  is it ", T.clean_query) == "what is it?"
    assert one(spark, "tell me", T.clean_query) == "tell me"
    assert one(spark, "One. Two!  Three? four", T.sentences) == ["One.", "Two!", "Three?", "four"]
    assert one(spark, "x [CHUNK_002] [CHUNK_002] [CHUNK_010]", T.citations) == [1, 9]
    assert one(spark, "think\nFinal answer: 42", T.extract_answer) == "42"
    assert one(spark, "first\n\nlast", T.extract_answer) == "last"
    assert one(spark, "Therefore: b\n\nc\nAnswer: a\n\nrest", T.extract_answer) == "a"
    assert one(spark, "final answer: low case is none\n\nend ", T.extract_answer) == "end"
    assert one(spark, "what is it.", T.clean_query) == "what is it." and one(spark, "Island life", T.clean_query) == "Island life?"
    assert one(spark, "The  ANSWER [CHUNK_001]", T.vote_form) == "the answer "
    assert one(spark, "Table 12: x", T.caption).asDict() == {"kind": "table", "number": 12}
    assert one(spark, "<a & \"b\">", T.html_escape) == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, "<p>a<script>x<y</script></p><p>b&amp;c</p>", T.html_text) == "a\nb&c"
    assert one(spark, "x\n```python\ncode\n```", T.fenced_code) == "code\n"
    assert one(spark, "mail a@b.co 123-45-6789", T.pii_kinds) == ["email", "ssn"]
    assert one(spark, "not json [1, 2.5]", T.json_list) == [1.0, 2.5] and one(spark, "none", T.json_list) == []
    assert one(spark, "What is it?", T.intent)["label"] == "simple"
    assert one(spark, "Compare all of these things and explain the relationship between them in some detail", T.intent)["label"] == "complex"
    assert one(spark, "Compare this?", T.intent).asDict() == {"label": "complex", "method": "rule", "confidence": 0.5}
    assert one(spark, "trace " * 16, T.intent)["confidence"] == 0.9
    assert col(spark, T.chunk_label(F.lit(7))) == "CHUNK_007"
    assert col(spark, T.exact_match(F.lit("It is Paris."), F.lit(" paris "))) is True


def test_exact_match_of_letters_without_one_capital(spark, tmp_path):
    assert one(spark, "Straße ﬁ ᾳ", T.upper_each) == "STRAẞE ﬁ ᾼ" and one(spark, "plain é", T.upper_each) == "PLAIN É"
    assert one(spark, "ΟΔΟΣ İ", T.lower_each) == "οδοσ i"
    rows = [(2, 0, "xxgroße Straße"), (2, 1, "xxΟΔΟΣ ΟΔΟΣΑ ΟΔ"), (2, 2, "xx"), (1, 3, "xxgroße"), (2, 4, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = catalog.queries()["ev01_exact_match"](spark, str(tmp_path)).collect()
    assert {r["turn"]: r["answer_correct"] for r in found} == {0: True, 1: True, 2: False, 3: False, 4: None}


def test_error_rates(spark):
    assert col(spark, T.char_error_rate(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(3 / 7)
    for a, b, want in (("a b c", "a x c", 1 / 3), ("", "a b", 1.0), ("a b", "", 1.0), ("", "", 0.0), ("a c", "a b c", 1 / 3)):
        assert col(spark, T.word_error_rate(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_vectors_and_scores(spark):
    a, b, z = (F.array(*[F.lit(float(x)) for x in v]) for v in ((1, 0), (1, 1), (0, 0)))
    assert col(spark, T.cosine(a, b)) == pytest.approx(math.sqrt(0.5)) and col(spark, T.cosine(a, z)) == 0
    assert col(spark, T.int8(F.array(F.lit(0.5), F.lit(-1.5)))) == [64, -128]
    assert sum(col(spark, T.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))) == pytest.approx(1)
    days = lambda n: T.freshness(F.lit(dt.date(2024, 1, 1)), F.date_add(F.lit(dt.date(2024, 1, 1)), n))
    assert [col(spark, days(n)) for n in (0, 30, 105, 180, 181)] == [1, 1, 0.75, 0.5, 0.3]
    assert col(spark, T.sigmoid(T.logit(F.lit(0.3)))) == pytest.approx(0.3)
    token = T.share_token({"a": {"api_key": "s", "k": 5}})
    assert T.read_token(token) == {"a": {"k": 5}}


# Chunks


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t, "s") for i, t in enumerate(texts)], "id string, content string, source_type string")


def test_chunkers(spark):
    d = docs(spark, " ".join(map(str, range(10))), "  ", "a b")
    got = {r["id"]: r["content"] for r in C.fixed(d, 4, 1).collect()}
    assert got == {"d0_chunk_0": "0 1 2 3", "d0_chunk_1": "3 4 5 6", "d0_chunk_2": "6 7 8 9", "d0_chunk_3": "9", "d2_chunk_0": "a b"}
    s = C.sentence(docs(spark, "a b. c d e. f g h i j k. l."), 5).orderBy("chunk_index").collect()
    assert [r["content"] for r in s] == ["a b. c d e.", "f g h i j k.", "l."]
    assert C.whole(d).count() == 2
    assert [r["content"] for r in C.recursive(docs(spark, "one two. three four. five six."), 2, 0).orderBy("chunk_index").collect()] == ["one two", "three four", "five six."]
    v = spark.createDataFrame([("d", "s", i, f"s{i}.", x) for i, x in enumerate(([1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0]))], "id string, source_type string, seq int, sentence string, vec array<double>")
    assert [r["content"] for r in C.semantic(v).orderBy("chunk_index").collect()] == ["s0. s1.", "s2. s3."]
    o = C.offsets(docs(spark, "ab cd ab"), spark.createDataFrame([("d0", 0, "ab"), ("d0", 1, "ab")], "doc_id string, chunk_index int, content string"))
    assert [r["start"] for r in o.orderBy("chunk_index").collect()] in ([0, 0], [0, 6])
    b = C.boundary_diagnosis(spark.createDataFrame([("d", 0, "Done."), ("d", 1, "- item"), ("d", 2, "half of"), ("d", 3, "it.")], "doc_id string, chunk_index int, content string"))
    assert [(r["mid_clause"], r["mid_list"]) for r in b.orderBy("chunk_index").collect()] == [(False, False), (True, True), (True, False), (False, False)]


def test_block_export(spark):
    rows = [("d", 1, "heading", "A", "Title"), ("d", 2, "paragraph", "A", "x" * 40), ("d", 3, "table", "A", "t"), ("d", 4, "paragraph", "A", "y" * 40), ("d", 5, "paragraph", "B", "z")]
    out = C.export_blocks(spark.createDataFrame(rows, "doc_id string, seq int, block_type string, section string, text string"), 350, 500).orderBy("chunk_index").collect()
    assert [(r["kind"], r["section"]) for r in out] == [("text", "A"), ("table", "A"), ("text", "A"), ("text", "B")]
    assert out[0]["text"].startswith("Title\nx")


# Analytics


def results(spark):
    rows = []
    for q in range(40):
        for p, base in (("naive", 0.4), ("agentic", 0.6)):
            s = base + (q % 5) / 20
            rows.append((q, p, q % 4, "ab"[q % 2], q % 3, s, s > 0.5, 100.0 + q, f"2024-01-{1 + q % 2:02d}"))
    return spark.createDataFrame(rows, "question_id long, pipeline string, source_type int, category string, model_id int, overall_score double, answer_correct boolean, latency_ms double, run_id string")


def test_analytics(spark):
    r = results(spark)
    assert {x["pipeline"] for x in A.best_pipeline(r, "category").collect()} == {"agentic"}
    s = A.slice_consistency(r).collect()
    assert all(x["agrees"] for x in s) and len(s) == 7
    simpson = spark.createDataFrame([("a", "x", "A", 0.9)] * 1 + [("a", "x", "B", 0.8)] * 9 + [("b", "x", "A", 0.3)] * 9 + [("b", "x", "B", 0.2)] * 1, "source_type string, category string, pipeline string, overall_score double")
    assert not all(x["agrees"] for x in A.slice_consistency(simpson, least=1).collect())
    assert {x["slice"] for x in A.slice_consistency(simpson).collect()} == {"category=x", "all"}
    bins = A.calibration_bins(spark.createDataFrame([(0.05, False), (1.0, True), (0.95, True)], "p double, y boolean"), "p", "y")
    assert [x["n"] for x in bins.orderBy("bin").collect()] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 2]
    assert A.expected_calibration_error(bins).first()["ece"] == pytest.approx((0.05 + 2 * 0.025) / 3, abs=1e-6)
    k = spark.createDataFrame([(True, True), (False, False), (True, False)], "a boolean, b boolean")
    assert A.cohen_kappa(k, "a", "b").first()["kappa"] == pytest.approx(0.4)
    rho = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0)], "a double, b double")
    assert A.spearman(rho, "a", "b").first()["rho"] == 1.0
    v = A.majority_vote(spark.createDataFrame([(1, 0, "Yes"), (1, 1, "no"), (1, 2, "yes ")], "g int, seq int, t string"), "g", "t", "seq", T.vote_form("t"))
    assert tuple(v.first()) == (1, "Yes", 2)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {x["k"]: x["p_adjusted"] for x in A.benjamini_hochberg(p, "k", "p").collect()} == {"a": 0.03, "b": 0.04, "c": 0.04}
    assert A.stratified(r, ["pipeline"], 3, "question_id").count() == 6
    with pytest.raises(Exception, match="no questions"):
        A.completeness(r.limit(0), F.lit(True)).collect()


# Statistics


def test_significance(spark):
    same = spark.createDataFrame([(i, 0.5, 0.5) for i in range(10)], "q int, a double, b double")
    far = spark.createDataFrame([(i, 0.5, 0.9) for i in range(20)], "q int, a double, b double")
    assert E.wilcoxon(same)["p_value"] == 1 and E.wilcoxon(far)["p_value"] < 0.001
    r = E.compare(far, "x", "y")
    assert r["significant"] and r["practical"] and r["delta"] == pytest.approx(0.4) and "y is better" in r["verdict"]
    few = spark.createDataFrame([(i, 0.0, float(i + 1)) for i in range(5)], "q int, a double, b double")
    assert E.wilcoxon(few)["p_value"] == pytest.approx(2 / 32)
    with pytest.raises(ValueError):
        E.compare(same.limit(0), "x", "y")
    m = spark.createDataFrame([(True, False)] * 6 + [(False, True)], "a boolean, b boolean")
    assert E.mcnemar(m, "a", "b")["p_value"] == pytest.approx(2 * 8 / 128)
    low, high = E.bootstrap_mean([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])
    assert (low, high) == E.bootstrap_mean([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]) and low < 0.4 < high
    b = E.bootstrap(spark.createDataFrame([("g", float(i % 2)) for i in range(200)], "g string, v double"), "g", "v", 200).first()
    assert b["low"] < 0.5 < b["high"] and b["high"] - b["low"] < 0.25


def test_calibration_methods(spark):
    rng = np.random.default_rng(1)
    rows = [(float(p), bool(rng.random() < p**2)) for p in rng.random(400)]
    df = spark.createDataFrame(rows, "p double, y boolean")
    for method in ("platt", "isotonic", "temperature"):
        out = E.recalibrate(df, "p", "y", method)
        assert out.count() == 400 and out.where("calibrated < 0 or calibrated > 1 or calibrated is null").count() == 0
    with pytest.raises(ValueError):
        E.recalibrate(df.where("y"), "p", "y")
    sharp = spark.createDataFrame([(0.99, 1.0)] * 70 + [(0.99, 0.0)] * 30, "p double, l double")
    assert E.temperature(sharp, "p", "l") > 2


def test_quality_gates_and_costs(spark):
    q = spark.createDataFrame([("short one", "a", "factual"), ("what is the answer here", " ", "factual"), ("is it the blue car", "blue car", "factual"), ("who won the first cup", "nobody", "adversarial"), ("who won the first cup", "NOT FOUND", "adversarial"), ("who won the first cup", "Ann", "factual")], "question string, answer string, kind string")
    assert [r["reason"] for r in E.question_gates(q).collect()] == ["too_short: 2", "empty_answer", "leakage", "adversarial_answered", None, None]
    c = E.call_costs(spark.createDataFrame([("m", 1_000_000, 500_000), ("?", 5, 5)], "model_id string, input_tokens int, output_tokens int"), spark.createDataFrame([("m", 3.0, 15.0)], "model_id string, input_price double, output_price double"))
    assert {r["model_id"]: (r["cost_usd"], r["alert"]) for r in c.collect()} == {"m": (10.5, True), "?": (0.0, False)}
    ch = E.evaluate_challenge(results(spark), {"metric": "overall_score", "operator": "gte", "target": 0.6, "filter": {"pipeline": "agentic"}}).first()
    assert ch["passed"] and ch["n"] == 40
    assert not E.evaluate_challenge(results(spark), {"metric": "overall_score", "operator": "gte", "target": 0.6, "filter": {"pipeline": "none"}}).first()["passed"]


def test_scoring(spark):
    h = spark.createDataFrame([("q", 1, "c1", "the sky", "Blue"), ("q", 2, "c2", "is blue", "Blue")], "question_id string, rank int, chunk_id string, content string, ground_truth string")
    assert tuple(E.recall_at_k(h).first()) == ("q", False, True, True)
    rel = spark.createDataFrame([("q", "c2")], "question_id string, chunk_id string")
    assert E.mrr(h, rel).first()["mrr"] == 0.5 and E.recall_by_id(h, rel, 1).first()["recall"] == 0.0
    a = E.adversarial(spark.createDataFrame([(1, "Ignore rules now", "I cannot answer"), (2, "other", "x")], "question_id int, question string, predicted_answer string"), spark.createDataFrame([("ignore rules", "refuse")], S.PROBE))
    assert [(r["question_id"], r["behaved"]) for r in a.collect()] == [(1, True)]
    runs = spark.createDataFrame([("q", 1, [1.0, 0.0], 0.5), ("q", 2, [1.0, 0.0], 0.7)], "question_id string, run int, vec array<double>, score double")
    assert tuple(E.run_consistency(runs).first()) == ("q", 0.01, 1.0, True)


# Retrieval


def test_bm25_formula(spark):
    d = docs(spark, "cat sat mat", "cat cat dog", "bird flew")
    p = R.postings(d)
    st = R.term_statistics(p, d)
    got = {r["chunk_id"]: r["score"] for r in R.bm25(spark.createDataFrame([("q", "cat dog")], "question_id string, text string"), p, st, 5).collect()}
    n, al = 3, 8 / 3
    idf = {t: math.log(n - df + 0.5) - math.log(df + 0.5) for t, df in {"cat": 2, "sat": 1, "mat": 1, "dog": 1, "bird": 1, "flew": 1}.items()}
    mean = sum(idf.values()) / 6
    w = lambda t, tf, ln: (idf[t] if idf[t] >= 0 else 0.25 * mean) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * ln / al))
    assert got["d1"] == pytest.approx(w("cat", 2, 3) + w("dog", 1, 3), abs=1e-5) and got["d0"] == pytest.approx(w("cat", 1, 3), abs=1e-5)
    local = R.bm25_rerank(spark.createDataFrame([("q", "dog", "a", "dog dog"), ("q", "dog", "b", "cat"), ("q", "dog", "c", "bird")], "question_id string, text string, chunk_id string, content string"), 3)
    assert local.where("rank = 1").first()["chunk_id"] == "a"


def hits(spark, rows):
    return spark.createDataFrame(rows, "question_id string, rank int, chunk_id string, score double")


def test_fusion_caps_and_trust(spark):
    a, b = hits(spark, [("q", 1, "x", 0.9), ("q", 2, "y", 0.5)]), hits(spark, [("q", 1, "y", 7.0), ("q", 2, "z", 3.0)])
    assert [r["chunk_id"] for r in R.rrf([a, b], 3).orderBy("rank").collect()] == ["y", "x", "z"]
    w = {r["chunk_id"]: r["score"] for r in R.weighted(a, b, 3).collect()}
    assert w == {"x": 0.7, "y": 0.3, "z": 0.0}
    m = spark.createDataFrame([("x", "d"), ("y", "d"), ("z", "e")], "chunk_id string, doc_id string")
    h = hits(spark, [("q", 1, "x", 0.9), ("q", 2, "y", 0.8), ("q", 3, "z", 0.1)])
    assert [r["chunk_id"] for r in R.cap_per_document(h, m, 3, 1).orderBy("rank").collect()] == ["x", "z"]
    assert R.cap_if_many(h, m, 1, 1).count() == 1
    assert [r["trust"] for r in R.retrieval_trust(h).orderBy("rank").collect()] == [1.0, 0.875, 0.0]
    flat = hits(spark, [("q", 1, "x", 0.9), ("q", 2, "y", 0.9)])
    assert {r["trust"] for r in R.retrieval_trust(flat).collect()} == {0.0}
    assert R.confidence_gate(R.retrieval_trust(h), 0.9).first()["action"] == "fallback"
    full = h.withColumns({"text": F.lit("a b"), "content": F.lit("a"), "ingested_at": F.lit(dt.date(2024, 1, 1)), "source_type": F.lit("wiki")})
    t = R.composite_trust(full, F.lit(dt.date(2024, 1, 2)), {"wiki": 1.0}).orderBy("rank").first()["trust"]
    assert t == pytest.approx(0.4 + 0.2 + 0.2 * 0.5 + 0.2)
    j = R.judged_trust(h, spark.createDataFrame([("q", "scores: [0.2, 3]")], "question_id string, scores string"))
    assert [r["trust"] for r in j.orderBy("rank").collect()] == [0.2, 1.0, 0.0]


def test_dense_graph_cache_and_memory(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 2), ("c", [1.0, 1.0], 1)], "chunk_id string, vec array<double>, source_type int")
    q = spark.createDataFrame([("q", [1.0, 0.1])], "question_id string, qvec array<double>")
    assert [r["chunk_id"] for r in R.dense(q, v, 3).orderBy("rank").collect()] == ["a", "c", "b"]
    assert R.dense(q, v, 1, keep=F.col("source_type") == 2).first()["chunk_id"] == "b"
    assert R.dense(q, v, 1, keep=F.col("source_type") == 2, filter_after=True).count() == 0
    assert [r["chunk_id"] for r in R.quantised_dense(q, v, 3).orderBy("rank").collect()] == ["a", "c", "b"]
    ms = R.max_sim(spark.createDataFrame([("q", 0, [1.0, 0.0]), ("q", 1, [0.0, 1.0])], "question_id string, qpos int, qvec array<double>"), v, 1)
    assert tuple(ms.first())[2] == 2.0 if ms.columns[2] == "score" else ms.first()["score"] == 2.0
    m = R.entities(docs(spark, "Ann Lee met Bob", "Bob saw Paris", "nothing here"))
    e = R.entity_edges(m)
    c = R.graph_candidates(spark.createDataFrame([("q", "Ann Lee")], "question_id string, entity string"), e, m)
    assert {r["chunk_id"] for r in c.collect()} == {"d0", "d1"}
    cache = spark.createDataFrame([("k", [1.0, 0.0], "b", 5)], "cache_id string, vec array<double>, backend string, top_k int")
    qs = q.withColumns({"backend": F.lit("b"), "top_k": F.lit(5)})
    assert R.semantic_cache(qs, cache, 0.9).count() == 1 and R.semantic_cache(qs.withColumn("top_k", F.lit(3)), cache).count() == 0
    turns = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(5)], "conv_id int, turn int, role string, text string")
    assert R.memory_context(turns, 2).first()["context"] == "user: t3\nuser: t4"
    pi = R.page_index(spark.createDataFrame([("q", "cat dog")], "question_id string, text string"), C.whole(docs(spark, "cats and dogs", "a cat")), 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in pi] == [("d0", 0.9), ("d1", 0.5)]
    far = dt.datetime(2030, 1, 1)
    ex = R.exact_cache(spark.createDataFrame([("q", "t", "b", 5)], "question_id string, text string, backend string, top_k int"), spark.range(1).select(T.cache_key(F.lit("t"), F.lit("b"), F.lit("5")).alias("key"), F.lit("ans").alias("answer"), F.lit(far).alias("expires_at")), F.lit(dt.datetime(2024, 1, 1)))
    assert ex.first()["hit"]


# Dedup


def test_page_index_moves_no_postings(spark, monkeypatch):
    """The same rows by counts where documents lie and by joins, with documents
    of several chunks, ties, and question numbers of 32 bits."""
    texts = [("a", "cats and dogs, cats"), ("a", "more DOGS"), ("b", "a cat"), ("c", "a cat"), ("d", "none"), ("e", None), ("f", "catcat " * 3000)]
    chunks = spark.createDataFrame(texts, "doc_id string, content string")
    q = spark.createDataFrame([(1, "cat dog cat"), (2, "a"), (3, " "), (4, "none zz")], "question_id int, text string")
    monkeypatch.setattr(R, "PAGE_TOKENS", 4)
    near = R.page_index(q, chunks, 2)
    got = near.orderBy("question_id", "rank").collect()
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode(t" not in plan
    monkeypatch.setattr(R, "PAGE_TERMS", 1)
    assert R.page_index(q, chunks, 2).select(near.columns).orderBy("question_id", "rank").collect() == got
    assert [(r["question_id"], r["rank"], r["chunk_id"]) for r in got] == [(1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (2, 2, "c"), (4, 1, "d")]
    assert R.page_index(q.where("question_id = 3"), chunks, 2).count() == 0


def test_similar_pairs_and_greedy(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.sample(words, rng.randrange(3, 12))) for _ in range(60)]
    d = docs(spark, *texts)
    for t in (0.5, 0.8):
        want = set()
        for i in range(60):
            for j in range(60):
                a, b = set(texts[i].split()), set(texts[j].split())
                if f"d{i}" < f"d{j}" and len(a & b) / len(a | b) >= t:
                    want.add((f"d{i}", f"d{j}"))
        got = D.similar_pairs(d, t)
        assert {(r["a"], r["b"]) for r in got.collect()} == want
    p = spark.createDataFrame([("d0", "d1"), ("d1", "d2")], "a string, b string")
    kept = {r["id"] for r in D.greedy_keep(docs(spark, "a", "b", "c", "d"), p).collect()}
    assert kept == {"d0", "d2", "d3"}
    assert {r["id"] for r in D.exact(docs(spark, "a", "b", "a")).collect()} == {"d0", "d1"}


def test_equal_sets_are_compared_once(spark, monkeypatch):
    """30 copies of a text: no pair of sets is looked at, all pairs return; by
    source, those of no source with none, and by numbers of words."""
    seen = {}
    keep = D.written
    monkeypatch.setattr(D, "written", lambda df, name: seen.setdefault(name, keep(df, name)))
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(i, long, "s" if i else None) for i in range(31)] + [(50, long + " w0 w1 w2 w3", "s"), (51, long + " more", "s"), (52, long, "other")]
    got = D.near_documents(spark.createDataFrame(rows, "id long, content string, source_type string")).collect()
    assert seen["similar-pairs"].count() == 1
    ids = set(range(1, 31))
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in ids for b in ids | {51} if a < b} and len(got) == 465
    assert {r["similarity"] for r in got} == {1.0, round(40 / 41, 6)}


# Layout


def test_layout(spark):
    rows = []
    for y, text in ((10, "header"), (100, "one two"), (108, "three"), (150, "four")):
        for k, w in enumerate(text.split()):
            rows.append(("d", 1, w, 50.0 + 40 * k, 80.0 + 40 * k, float(y), float(y + 6), 1000.0, 600.0))
    words = spark.createDataFrame(rows, "doc_id string, page int, text string, x0 double, x1 double, top double, bottom double, height double, width double")
    body = L.crop(words)
    pars = L.paragraphs(L.lines(body))
    assert sorted(r["text"] for r in pars.collect()) == ["four", "one two three"]
    bs = L.blocks(pars)
    assert L.flat_text(bs).first()["text"] == "one two three\n\nfour"
    cap = spark.createDataFrame([("d", 1, "s", 1, "table", "t1", None), ("d", 1, "s", 2, "caption", "c1", None), ("d", 2, "s", 3, "caption", "c2", None), ("d", 2, "x", 4, "caption", "c3", "t9")], "doc_id string, page int, section string, seq int, block_type string, block_id string, table_id string")
    assert {r["block_id"]: r["caption_of"] for r in L.attach_captions(cap).collect()} == {"c1": "t1", "c2": "t1", "c3": "t9"}
    cells = spark.createDataFrame([("t", 0, 1, "b"), ("t", 0, 0, "a"), ("t", 1, 0, "1"), ("t", 1, 1, "2")], "table_id string, row int, col int, text string")
    assert L.cells_to_markdown(cells).first()["markdown"] == "| a | b |\n| --- | --- |\n| 1 | 2 |"


# Sources and sinks


def test_sources(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id":"1","question":"Q","answer":"A","source_type":"wiki, code"}\nnot json\n{"id":"2","text":"T","ground_truth":"G","source_type":"chat"}\n')
    q = RD.questions(spark, str(tmp_path / "q.jsonl"), ["code"]).collect()
    assert [(r["text"], r["ground_truth"]) for r in q] == [("Q", "A")]
    for s in ("wiki", "chat"):
        (tmp_path / "c" / s).mkdir(parents=True)
        (tmp_path / "c" / s / "x.txt").write_text(f"hello {s}\nworld")
    (tmp_path / "c" / "wiki" / "skip.bin").write_bytes(b"x")
    assert {(r["id"], r["source_type"]) for r in RD.corpus(spark, str(tmp_path / "c")).collect()} == {("wiki_x", "wiki"), ("chat_x", "chat")}
    (tmp_path / "t.csv").write_text("name,age\nAnn,3\nBob,\n")
    assert {r["content"] for r in RD.csv_rows(spark, str(tmp_path / "t.csv")).collect()} == {"name: Ann\nage: 3", "name: Bob"}
    up = tmp_path / "u"
    up.mkdir()
    (up / "a.html").write_text("<p>hi</p>")
    (up / "b.txt").write_text("plain")
    (up / "bad.docx").write_bytes(b"no zip")
    import zipfile

    with zipfile.ZipFile(up / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two &amp; 3</w:t></w:r></w:p></w:document>")
    assert {(r["id"], r["content"]) for r in RD.uploads(spark, str(up)).collect()} == {("a.html", "hi"), ("b.txt", "plain"), ("c.docx", "One\n\nTwo & 3")}
    assert RD.sql(spark, "SELECT :x AS v", x="' OR 1=1").first()["v"] == "' OR 1=1"
    assert RD.with_fallbacks(b"x", [lambda b: 1 / 0, lambda b: "", lambda b: "ok"]) == "ok"
    assert RD.placeholder_corpus(spark, 3).count() == 9
    u = RD.unknown_sources(spark.createDataFrame([("1", "s, none"), ("2", "all")], "id string, source_type string"), docs(spark, "x"))
    assert [r["source_type"] for r in u.collect()] == ["none"]


def test_table_writes(spark, tmp_path):
    t = W.Table(spark, f"file://{tmp_path}/t", "id string, v int")
    assert t.read().count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    t.upsert(rows(("a", 1), ("b", 2)), ["id"])
    t.upsert(rows(("b", 3), ("b", 4), ("c", 5)), ["id"], F.col("v"))
    assert {(r["id"], r["v"]) for r in t.read().collect()} == {("a", 1), ("b", 4), ("c", 5)}
    t.insert_missing(rows(("a", 9), ("d", 6)), ["id"])
    t.update(F.col("id") == "c", v=7)
    assert {(r["id"], r["v"]) for r in t.read().collect()} == {("a", 1), ("b", 4), ("c", 7), ("d", 6)}
    wider = W.Table(spark, f"file://{tmp_path}/t", "id string, v int, extra string")
    assert wider.read().where("extra is null").count() == 4
    done = spark.createDataFrame([("1", 0), ("2", 1), ("3", None)], "question_id string, is_error int")
    assert {r["id"] for r in W.pending(spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "id string"), done).collect()} == {"2", "4"}
    W.write_report(rows(("a", 1)), f"file://{tmp_path}/r", 1)
    with pytest.raises(Exception, match="exist"):
        W.write_report(rows(("a", 1)), f"file://{tmp_path}/r", 1)
    assert W.read_manifest(spark, f"file://{tmp_path}/none") is None
    W.write_index(rows(("a", 1)), rows(("b", 2)), {"chunk_count": 1, "corpus_hash": "h"}, f"file://{tmp_path}/i")
    m = W.read_manifest(spark, f"file://{tmp_path}/i")
    assert not W.is_stale(m, 1, "h") and W.is_stale(m, 2, "h") and W.is_stale(None, 1, "h")
    with pytest.raises(ValueError):
        W.export(spark.range(3), "csv", 2)
    assert "&lt;b&gt;" in W.export(spark.createDataFrame([("<b>",)], "x string"), "html")
    assert json.loads(W.export(rows(("a", 1)), "json")) == [{"id": "a", "v": 1}]
    assert "## By source" in W.experiment_report(results(spark), ["naive", "agentic"], {"k": 1})


# Streaming


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "user", "c")], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(src))
    s = G.session_memory(G.table_stream(spark, str(src), "conv_id long, turn long, role string, text string"), 2)
    q = s.writeStream.outputMode("update").format("memory").queryName("mem").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("mem").first()["context"] == "user: b\nuser: c"
    t0 = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([("p", t0 + dt.timedelta(seconds=s), ok) for s, ok in ((0, False), (1, False), (2, False), (3, True), (40, False), (41, True), (80, True), (81, True))], "provider string, ts timestamp, ok boolean")
    assert [r["state"] for r in G.circuit_breaker(calls).orderBy("ts").collect()] == ["closed", "closed", "closed", "open", "half_open", "open", "half_open", "closed"]
    t = W.Table(spark, f"file://{tmp_path}/sink", "conv_id long, turn long")
    st = G.table_stream(spark, str(src), "conv_id long, turn long, role string, text string").select("conv_id", "turn")
    q = st.writeStream.foreachBatch(G.upsert_sink(t, ["conv_id", "turn"])).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert t.read().count() == 3
    ev = spark.createDataFrame([(1, t0), (1, t0), (2, t0)], "user_id int, ts timestamp")
    assert {(r["user_id"], r["limited"]) for r in G.per_minute(ev, limit=1).collect()} == {(1, True), (2, False)}


# Plans


def test_pipelines(spark):
    d = docs(spark, "The cat sat on the mat.", "Dogs bark loudly.", "Birds fly south.").withColumn("doc_id", F.col("id"))
    p = R.postings(d)
    st = R.term_statistics(p, d)
    get = lambda q, k: R.bm25(q, p, st, k)
    qs = spark.createDataFrame([("q1", "cat mat"), ("q2", "dogs")], "question_id string, text string")
    out = P.naive(qs, get, d, AD.Extract(), P.overlay(P.Config(top_k=2), {"reranker": "cross_encoder"}))
    assert {r["question_id"] for r in out["answers"].collect()} == {"q1", "q2"}
    replay = AD.Replay(spark.createDataFrame([("q1", "It sat [CHUNK_001].")], "question_id string, answer string"))
    r = P.naive(qs, get, d, replay, P.Config(top_k=2))
    assert [(x["question_id"], x["chunk_id"]) for x in r["citations"].collect()] == [("q1", "d0")]
    sub = spark.createDataFrame([("q", 0, "cat"), ("q", 1, "dogs")], "question_id string, hop int, text string")
    assert {x["chunk_id"] for x in P.decompose(sub, get, 3).collect()} == {"d0", "d1"}
    v = spark.createDataFrame([("q", 0, "cat"), ("q", 1, "mat cat"), ("q", 9, "dogs")], "question_id string, variant int, text string")
    assert {x["chunk_id"] for x in P.fusion(v, get, 3).collect()} == {"d0"}
    think = lambda q, i: q.select("question_id", F.lit("Thought: t\nAction: \"cat\"" if i == 0 else "Answer: done").alias("reply"))
    answers, seen = P.react(qs, think, get, 2)
    assert {(x["answer"], x["rounds"]) for x in answers.collect()} == {("done", 2)} and seen.count() == 2
    assert one(spark, '{"score": 3, "needs_more": true}', P.parse_critique).asDict() == {"score": 1.0, "issues": [], "needs_more": True, "query": None}
    assert [r["total"] for r in P.cag(docs(spark, "x" * 40, "y" * 40, "z" * 40), 38).orderBy("id").collect()] == [10, 20, 30]
    with pytest.raises(ValueError):
        P.cag(docs(spark, "x" * 40, "y" * 40, "z" * 40), 37)
    talk = spark.createDataFrame([("c", i, "user", f"t{i}") for i in range(8)], "conv_id string, turn int, role string, text string")
    asked = talk.where("turn in (0, 6)").withColumn("question_id", F.col("turn")).drop("role")
    assert {r["turn"]: r["text"] for r in P.conversational(asked, talk, 2).collect()} == {0: "t0", 6: "user: t4\nuser: t5\nuser: t6"}
    assert P.declarative(d, {"filter": [["content", "contains", "CAT"]]}).count() == 1
    with pytest.raises(ValueError):
        P.declarative(d, {"filter": [["__import__", "eval", "x"]]})
    with pytest.raises(ValueError):
        AD.make("reranker", "nope")
    routed = P.adaptive(qs.withColumn("label", F.lit("odd")), "label", {"analytical": lambda x: x, "factual": lambda x: x})
    assert {x["route"] for x in routed.collect()} == {"factual"}
    assert one(spark, "no json", P.parse_query_type).asDict() == {"type": "factual", "confidence": 0.5}


def test_files_and_presets(spark, tmp_path):
    import hashlib

    (tmp_path / "fast.yaml").write_text("name: Fast one\ndescription: 'few chunks'\nindex:\n  backend: bm25\n")
    (tmp_path / "bare.yaml").write_text("index: x\n")
    (tmp_path / "note.txt").write_text("no preset")
    got = sorted(map(tuple, RD.presets(spark, str(tmp_path)).collect()))
    assert got == [("bare", "bare", ""), ("fast", "Fast one", "few chunks")]
    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki" / "long.txt").write_text("one\n\ntwo\nthree")
    assert [r["content"] for r in RD.corpus(spark, str(tmp_path)).where("source_type = 'wiki'").collect()] == ["one\n\ntwo\nthree"]
    hashes = {r["path"].rsplit("/", 1)[1]: r["file_hash"] for r in RD.file_hashes(spark, str(tmp_path)).collect()}
    assert hashes["note.txt"] == hashlib.sha256(b"no preset").hexdigest()[:16] and len(hashes) == 4


def test_reflection_and_variants(spark):
    qs = spark.createDataFrame([("a", "cat"), ("b", "nothing")], "question_id string, text string")
    get = lambda q, k: q.where("text like 'cat%'").select("question_id", F.lit(1).alias("rank"), F.lit("c").alias("chunk_id"), F.lit(1.0).alias("score"))
    gen = lambda q, hits: q.select("question_id", F.col("query").alias("answer"))
    wants = lambda a: a.select("question_id", F.lit('{"complete": false, "missing": "tails"}').alias("critique"))
    got = {r["question_id"]: (r["answer"], r["reflection_rounds"]) for r in P.reflection(qs, get, gen, wants, 2).collect()}
    assert got == {"a": ("cat specifically about: tails", 2), "b": (P.NOT_FOUND, 0)}
    assert one(spark, '{"variants": ["x", "y", "z"]}', lambda c: P.parse_variants(c, 2)) == ["x", "y"]
    assert one(spark, "no json", P.parse_variants) == []


def test_entry_registers_queries():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and e.FLAGSHIP in q and len(q) > 90


def test_index_registry(spark):
    d = docs(spark, "Ann saw the cat", "dogs bark", "Ann and birds").withColumn("doc_id", F.col("id")).withColumn("chunk_index", F.lit(0))
    v = d.select(F.col("id").alias("chunk_id"), R.stub_embedding("content").alias("vec"), "source_type")
    p = R.postings(d)
    m = R.entities(d)
    tables = {"vectors": v, "postings": p, "stats": R.term_statistics(p, d), "chunks": d, "mentions": m, "edges": R.entity_edges(m)}
    q = spark.createDataFrame([("q", "Ann cat")], "question_id string, text string").withColumn("qvec", R.stub_embedding("text"))
    for name, search in AD.INDEXES.items():
        if name != "colbert":
            assert search(q, tables, 2).where("rank = 1").first()["chunk_id"] == "d0", name
