"""The training-data operators against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmark.llm import common, components, fingerprint, langid, lines, mixing, packing, passages, pii, simhash, topk, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ko", "ri", "lu", "te", "so") for b in ("n", "ma", "ru", "x", "pi", "do", "vel")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    full = [(i, t, *(more or ("en", "s", len(t or "")))) for i, t, *more in rows]
    return spark.createDataFrame(full, DOC)


def odd_rows():
    return [(None, "some text here"), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, "é" * 5000), (6, "x " * 20000)]


# SimHash


def brute_fingerprint(text):
    raw = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    parent = {i: i for i in range(len(ids))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    rows = odd_rows()
    for k in range(8):
        base = prose(rng, 400)
        for c in range(6):
            words = base.split()
            words[rng.randrange(400)] = "zz%d" % rng.randrange(3)
            rows.append((100 * k + c + 10, " ".join(words)))
    got = simhash.near_groups(docs(spark, rows)).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fp"), "component_id").collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    comps = brute_components([i for i, _ in rows], fps)
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comps)), key=str)
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == want


def test_exploded_fingerprints_are_not_broadcast(spark, tmp_path):
    spark.range(3000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    found = simhash.links(spark.read.parquet(str(tmp_path / "fps")))
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_settled_plans_broadcast_little(spark, tmp_path):
    """Spark takes a table for as large as its files: here 0.4 MB, with 10
    million equal bytes and more in them."""
    wide = spark.range(100_000).select("id", F.repeat(F.lit("x"), 100).alias("same"))
    wide.write.parquet(str(tmp_path / "wide"))
    left, right = (spark.read.parquet(str(tmp_path / "wide")).withColumnRenamed("same", c) for c in "ab")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    assert "BroadcastHashJoin" in left.join(right, "id")._jdf.queryExecution().executedPlan().toString()
    assert common.settle(left.join(right, "id"), "joined").count() == 100_000
    assert [spark.conf.get(n, None) for n in names] == before
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = spark._jsparkSession.sharedState().statusStore().executionsList()
    said = [plans.apply(i).physicalPlanDescription() for i in range(plans.size())]
    said = [x for x in said if "quillmark-joined" in x and "Join" in x]
    assert said and not any("BroadcastHashJoin" in x for x in said)


def test_simhash_links_of_dense_cells(spark):
    rng = random.Random(2)
    values = set()
    for centre in (0, rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(60):
            v = centre
            for b in rng.sample(range(64), rng.randrange(4)):
                v ^= 1 << b
            values.add(v)
    fps = sorted(values)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    comp = {r[0]: r[1] for r in components.components(edges, "a", "b").collect()}
    root = [comp.get(s[0], s[0]) for s in signed]
    least = {r: min(s[0] for s, x in zip(signed, root) if x == r) for r in root}
    got = [least[r] for r in root]
    want = brute_components([s[0] for s in signed], fps)
    assert got == want


def test_keep_one_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    a, b = prose(rng, 300), prose(rng, 300)
    c, d = prose(rng, 300), prose(rng, 300)
    # 6 has two unrelated texts, one of them a copy of an earlier document's.
    rows = [(1, a), (2, a), (3, b), (3, b), (4, None), (5, ""), (None, a), (6, c), (6, b), (7, c), (None, d), (None, d)]
    df = docs(spark, rows).withColumns({"fp": F.lit(1), "root": F.lit("x"), "k": F.lit(2)})
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert kept == sorted([(1, a), (3, b), (4, None), (6, c), (None, d)], key=str)
    assert not simhash.keep_one(df.limit(0)).collect()


def shingle_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_similar(rows, least=0.8):
    """Rows that stay: the first of each group of similar texts."""
    texts = sorted({t or "" for _, t in rows})
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least:
                root[find(i)] = find(j)
    place, best = {t: find(i) for i, t in enumerate(texts)}, {}
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        best.setdefault(place[t or ""], k)
    return sorted(best.values(), key=str)


def test_keep_similar_equals_brute_force(spark):
    rng = random.Random(31)
    rows, base = [(None, None), (1, None), (2, ""), (3, " \t "), (4, "a b"), (4, "a b"), (5, "A  b"), (6, "a"), (None, "lone text of six words here"), (None, "x y z")], [prose(rng, 150) for _ in range(12)]
    for g, text in enumerate(base):
        for c in range(rng.choice([1, 2, 4, 12])):
            w = text.split()
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
            rows.append((100 * g + 20 + c, " ".join(w)))
    df = docs(spark, rows).withColumns({"fp": F.lit(1), "keys": F.lit("x"), "k": F.lit(2), "root": F.lit(3), "h": F.lit(4)})
    out = simhash.keep_similar(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == brute_similar(rows)
    assert not simhash.keep_similar(df.limit(0)).collect()


def test_similar_texts_that_share_a_common_block_are_all_found(spark, monkeypatch):
    """Shingles in many texts, most pairs of which are just not similar."""
    rng = random.Random(36)
    words = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    block, rows = words(200), []
    for i in range(40):
        own = words(28)
        for c in range(rng.choice([1, 2, 3])):
            new = list(own)
            if c:
                new[rng.choice([0, 5, 14, 22])] = f"new{c}"
            rows.append((10 * i + c, " ".join(block + new)))
    want = brute_similar(rows)
    assert 40 <= len(want) < len(rows)
    df = docs(spark, rows)
    assert sorted((r["doc_id"] for r in simhash.keep_similar(df).collect()), key=str) == want
    monkeypatch.setattr(simhash, "FREQUENT_TEXTS", 10**9)  # in order of hashes alone
    assert sorted((r["doc_id"] for r in simhash.keep_similar(df).collect()), key=str) == want


def test_texts_that_no_candidate_needs_stay_in_place(spark):
    rows = spark.range(200_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("th"))
    for n in (0, 1, 3_000):
        some = rows.where(F.col("k") % 7 == 3).limit(n).select(F.col("k").alias("of"), F.col("th").alias("h")).cache()
        left = simhash.perhaps_among(rows, "th", some, "h")
        assert left.columns == ["k", "th"]
        assert left.join(some, F.col("k") == F.col("of")).count() == n
        assert left.count() <= n + 5_000
    values = [0, 1, -1, 7, 8, 32767, 32768, 2**63 - 1, -(2**63)]  # the ends of bytes and buckets
    some = spark.createDataFrame([(v,) for v in values], "h long").cache()
    near = spark.createDataFrame([(v + d,) for v in values for d in (-1, 0, 1) if -(2**63) <= v + d < 2**63], "th long")
    got = {r["th"] for r in simhash.perhaps_among(near, "th", some, "h").collect()}
    places = {v % simhash.FILTER_LEAST for v in values}
    assert got == {r["th"] for r in near.collect() if r["th"] % simhash.FILTER_LEAST in places}
    # keep_similar asks it before it joins texts
    moved = []
    held, simhash.perhaps_among = simhash.perhaps_among, lambda *a: moved.append(a) or held(*a)
    try:
        text = " ".join(f"w{i}" for i in range(60))
        texts = [(1, text), (2, text + " end"), *((i, " ".join(f"x{i}y{j}" for j in range(60))) for i in range(3, 50))]
        kept = simhash.keep_similar(docs(spark, texts)).collect()
    finally:
        simhash.perhaps_among = held
    assert sorted(r["doc_id"] for r in kept) == [1, *range(3, 50)]
    rows, hashed, some, by = moved[0]
    assert rows.count() == 49 and held(rows, hashed, some, by).count() < 10


def test_similar_texts_are_found_at_every_band(spark):
    """Share of pairs linked, by five-word similarity, and none below 0.8."""
    rng = random.Random(32)
    rows, band = [], {}
    for i, edits in enumerate([1, 2, 4, 6, 8, 24] * 60):
        n = rng.choice([200, 400])
        w = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
        v, size = list(w), edits if n == 400 else max(1, edits // 2)
        for at in rng.sample(range(n // 5), size):
            v[5 * at + 2] = f"new{at}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        band[i] = jaccard(shingle_set(rows[-1][1]), shingle_set(rows[-2][1]))
    kept = {r["doc_id"] for r in simhash.keep_similar(docs(spark, rows)).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)):
        of = [i for i, j in band.items() if low <= j < high]
        assert len(of) >= 10 and sum(2 * i + 1 not in kept for i in of) >= 0.9 * len(of)
    assert all({2 * i, 2 * i + 1} <= kept for i, j in band.items() if j < 0.8)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert set(got) == {*range(41), *range(100, 130)}
    roots = [{got[i] for i in part} for part in (range(41), range(100, 130))]
    assert all(len(r) == 1 for r in roots) and roots[0] <= set(range(41)) and roots[1] <= set(range(100, 130))
    assert not components.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect()


# Packing


def test_best_fit_respects_every_capacity():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 500)
    for rule in ("norm", "dot"):
        bins, offsets = packing.best_fit(lengths, 100, 5, 9900, rule)
        for b in np.unique(bins):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert offsets[own].tolist() == (np.cumsum(lengths[own]) - lengths[own]).tolist()
            assert lengths[own].sum() <= 100 and len(own) <= 5 and (lengths[own] ** 2).sum() <= 9900
    bins, _ = packing.best_fit(lengths, 100)
    assert bins.max() + 1 <= np.ceil(lengths.sum() / 100) * 1.02 + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), 100)


def test_pack_documents_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = [*odd_rows(), (7, "Straße, ÀÉÎ don't <|endoftext|> 日本 1.5\r\nx")]
    got = packing.pack_documents(docs(spark, rows), max_tokens=512).collect()
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 512):
            part = np.array(ids[p : p + 512], "<u4")
            want.append((i, p // 512, p, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 512
    assert not packing.pack_documents(docs(spark, [])).collect()


# Top-k


def brute_topk(rows, factor=256, k=5):
    def clean(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    good = [(i, [int(np.floor(x * factor)) for x in v]) for i, v in rows if i is not None and clean(v)]
    out = []
    for q, v in good:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -x))) for n, (x, i) in enumerate(s[:k])]
    return out


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(400)]
    rows += [(400, None), (450, [1.0, None, 0.0, 0.0]), (500, [float("nan")] * 4), (550, [float("inf")] * 4), (None, [1.0] * 4), (600, [1.0, 2.0]), (650, [3.0, 1.0]), (700, [1e12] * 4), (701, [1e12] * 4)]
    rows += [(800 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]  # one vector that many rows have
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_topk(rows))
    assert not topk.top_k(df.limit(0), df.limit(0)).collect()


def test_topk_keeps_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [0.9, 0.0]), (0, [1.0, 0.0]), (3, [0.1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id = 0")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 3, 2, 58880), (0, 4, 2, 32768), (0, 5, 3, 6400)]


def test_blocks_are_pruned_on_clustered_data(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    m = np.repeat(centres, 60, axis=0) + 0.02 * rng.normal(size=(2400, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    report = {}
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), report=report).collect()
    assert sorted(map(tuple, got)) == sorted(brute_topk(rows))
    assert report["survivors"] <= 0.25 * report["pairs"]


def test_bounds_and_layout():
    rng = np.random.default_rng(6)
    m = rng.integers(-50, 50, (600, 8)).astype(float)
    cut = topk.halved(m, 16)
    assert sorted(np.concatenate(cut).tolist()) == list(range(600)) and max(map(len, cut)) <= 16
    ends = [np.array(x) for x in zip(*(topk._summary(m[r]) for r in cut), strict=True)]
    top = topk.bounds(m[:50], *ends)
    assert all((m[:50] @ m[r].T).max(axis=1).max() <= top[:, j].max() and ((m[:50] @ m[r].T).max(axis=1) <= top[:, j]).all() for j, r in enumerate(cut))


# Language


def test_language_model_is_a_distribution_and_separates():
    rng = random.Random(6)
    alphabets = {"x": "abcde", "y": "cdefg"}
    texts = {k: ["".join(rng.choice(a) if rng.random() > 0.2 else " " for _ in range(200)) for _ in range(12)] for k, a in alphabets.items()}
    m = langid.train(texts)
    gram = np.array([2, 3], np.uint64)
    total = np.zeros(2)
    for s in range(len(m.alphabet) + 2):
        total += np.exp(m._sum(np.array([*gram, s], np.uint64), 2))
    assert np.allclose(total, 1, atol=1e-3)
    assert m.predict("abab abba")[0] == "x" and m.predict("gfgf gg")[0] == "y"
    for t in (None, "", "123 !?", " "):
        assert m.predict(t)[:2] == ("und", 0.0)
    assert 0 <= m.predict("zzzz qqqq")[1] <= 1
    assert langid.train({}).predict("abc")[0] == "und"


def test_rejection_is_calibrated():
    rng = random.Random(26)
    own = {"one": WORDS, "two": ["".join(reversed(w)) + "ik" for w in WORDS]}
    text = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    m = langid.train({x: [text(x, rng.randrange(5, 150)) for _ in range(300)] for x in own})
    clean = [m.predict(text(x, rng.randrange(3, 200))) for x in own for _ in range(500)]
    assert sum(r[3] for r in clean) <= 0.01 * len(clean)

    def shuffled(t):
        return "".join(rng.sample(t, len(t)))

    junk = [m.predict(shuffled(text("one", n))) for n in range(20, 120)]
    unseen = [m.predict(" ".join(rng.choice(["qwyz", "jghtr", "vvoe", "ccmmi", "hhyy", "fgwe"]) for _ in range(n))) for n in range(10, 60)]
    assert sum(r[3] for r in junk) >= 0.98 * len(junk) and sum(r[3] for r in unseen) >= 0.98 * len(unseen)
    assert m.predict("bama")[3] is False and m.predict("12 34")[0] == "und"


def test_language_query_on_odd_rows(spark):
    rows = [(i, "abab aab " * 20, "x", "s", 1) for i in range(20)] + [(100 + i, "cdcd ddc " * 20, "y", "s", 1) for i in range(20)]
    rows += [(None, "abab", None, "s", 1), (1000, None, "x", "s", 1), (1001, "", "x", "s", 1), (1002, "77", None, None, 1)]
    df = spark.createDataFrame(rows, DOC)
    out = langid.identify(df, langid.fit(df)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r["lang_pred"] for r in out}
    assert by[3] == "x" and by[103] == "y" and by[1000] == by[1001] == by[1002] == "und"
    assert langid.keep_identified(df).count() == len(rows) - 3
    assert not langid.identify(df.limit(0), langid.fit(df.limit(0))).collect()


# Mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > epochs * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "b", "ü", "z", None, "B"]), 0) for i in range(300)]
    rows += [(300 + i, prose(rng, 5), "en", "tiny", 0) for i in range(3)] + [(400, None, "en", "empty", 0), (None, "a b c", "en", "a", 0)]
    out = mixing.mix(spark.createDataFrame(rows, DOC)).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = brute_targets(sizes)
    taken = {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(out) == len(rows)
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOC)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mixed_documents_hold_what_the_plan_takes(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 40)), "en", "abc"[i % 3], 5) for i in range(90)]
    df = spark.createDataFrame(rows, DOC)
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    got = {}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert got == {k: v for k, v in plan.items() if v}


# Fingerprints


def test_fingerprint_is_homomorphic(spark):
    rng = random.Random(9)
    p = [prose(rng, n) for n in (30, 1, 12, 30)]
    df = docs(spark, [(1, "\n".join(p)), (2, "\n".join(p[::-1])), (3, "\n".join(p[:3])), (4, p[3]), (5, "\n".join([*p, p[0]])), (6, None), (7, "")])
    v = fingerprint.vectors(df)
    fp = {r["doc_id"]: r["fp"] for r in v.collect()}
    assert fp[1] == fp[2] != fp[5] and fp[6] == fp[7]
    j = v.where("doc_id = 3").select(F.col("fp").alias("a")).join(v.where("doc_id = 4").select(F.col("fp").alias("b")))
    r = j.select(fingerprint.combine(F.col("a"), F.col("b")).alias("c"), fingerprint.combine(fingerprint.combine(F.col("a"), F.col("b")), F.col("b"), -1).alias("d"), F.col("a")).first()
    assert r["c"] == fp[1] and r["d"] == r["a"]


def test_edited_texts_and_neighbours(spark):
    rng = random.Random(10)
    rows = [(i * 7 % 101, prose(rng, rng.randrange(20, 120)) + "é") for i in range(60)] + [(200, None), (201, ""), (202, "ab"), (203, prose(rng, 50))]
    out = {r["doc_id"]: r for r in fingerprint.compare_edited(docs(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        e = t[: len(t) - third] + nxt[:third]
        r = out[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (e == t)
        if len(t) > 200:
            assert 0.35 < r["near_edited"] < 0.95 and r["near_next"] < 0.45
    assert not fingerprint.compare_edited(docs(spark, [])).collect()
    one = fingerprint.compare_edited(docs(spark, [(1, "abc def")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def brute_hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(4, "little") if isinstance(v, int) else v if isinstance(v, bytes) else v.encode(), h)
    return h


def brute_shingles(paragraph):
    w = re.findall(r"[^\x20\x09-\x0D]+", paragraph)
    return [brute_hash(2, a, b) for a, b in zip(w, w[1:])] if len(w) > 1 else [brute_hash(1, w[0])] if w else []


def brute_lanes(text):
    lanes, n = [0] * 128, 0
    words = [0] * fingerprint.WORDS
    for p in (text or "").split("\n"):
        d = hashlib.sha512(p.encode()).hexdigest()
        for i in range(fingerprint.WORDS // 2):
            x = brute_hash(100 + i, d)
            words[2 * i] += x & 0xFFFFFFFF
            words[2 * i + 1] += x >> 32
        for h in brute_shingles(p):
            n += 1
            g = brute_hash(3, (h - (1 << 64) if h >> 63 else h).to_bytes(8, "little", signed=True))
            for k, x in enumerate((h, g)):
                for i in range(32):
                    lanes[32 * k + i] += x >> i & 1
                    lanes[64 + 32 * k + i] += x >> (32 + i) & 1
    return [x % 2**32 for x in (*lanes, *words, n)]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * c - f[-1] for c in f[:128]] for f in (a, b))
    dot = lambda u, v: float(sum(p * q for p, q in zip(u, v)))
    both = dot(x, x) + dot(y, y)
    return max(0.0, min(1.0, 2 * dot(x, y) / both)) if both else 0.0


def test_op8_equals_brute_force_and_lanes_combine(spark):
    rng = random.Random(35)
    rows = [(i, "\n".join(prose(rng, rng.randrange(0, 90)) for _ in range(rng.randrange(1, 6)))) for i in range(40)] + [(90, None), (91, "\n\n"), (92, "one"), (93, " \t é x"), (94, "long " * 30_000)]
    out = {r["doc_id"]: r for r in fingerprint.compare_edited(docs(spark, rows)).collect()}
    order, near, true = sorted(rows, key=lambda r: -r[0]), [], []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        e = t[: len(t) - third] + nxt[:third]
        f, g, m = brute_lanes(t), brute_lanes(e), brute_lanes(nxt)
        r = out[i]
        sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
        assert r["lanes"] == f and r["fingerprint"] == sha(f) and r["edited_fingerprint"] == sha(g)
        assert abs(r["near_edited"] - brute_likeness(f, g)) < 1e-9 and abs(r["near_next"] - brute_likeness(f, m)) < 1e-9
        a, b = (Counter(h for p in x.split("\n") for h in brute_shingles(p)) for x in (t, e))
        if sum(a.values()) > 60 and i < 90:
            near.append(r["near_edited"])
            sq = lambda u, v: sum(n * v[h] for h, n in u.items())
            true.append(2 * sq(a, b) / (sq(a, a) + sq(b, b)))
    assert np.abs(np.array(near) - np.array(true)).mean() < 0.1 and max(abs(x - y) for x, y in zip(near, true)) < 0.35
    # A paragraph put in, then taken out, by the lanes of the query's rows.
    x, y = docs(spark, [(1, rows[0][1] + "\n" + rows[1][1])]), fingerprint.vectors(docs(spark, rows[:2]))
    a, b = (y.where(f"doc_id = {k}").select(F.col("fp").alias(f"f{k}")) for k in (0, 1))
    j = fingerprint.vectors(x).join(a).join(b).select("fp", fingerprint.combine(F.col("f0"), F.col("f1")).alias("sum"), fingerprint.combine(F.col("fp"), F.col("f1"), -1).alias("less"), "f0").first()
    assert j["sum"] == j["fp"] == brute_lanes(x.first()["text"]) and j["less"] == j["f0"] == out[0]["lanes"]


def test_repeated_ids_keep_their_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "x y z"), (None, "q r s"), (None, None)]
    assert fingerprint.compare_edited(docs(spark, rows)).count() == 5


def test_hot_and_null_ids_are_cut_into_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 10)
    rng = random.Random(25)
    rows = [(7, prose(rng, 9)) for _ in range(300)] + [(None, prose(rng, 9)) for _ in range(200)] + [(i, prose(rng, 9)) for i in range(400)]
    pairs, _ = fingerprint.with_next(docs(spark, rows))
    got = pairs.collect()
    assert len(got) == len(rows) and max(n for n in Counter(r["b"] for r in got).values()) <= 60
    signed = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["b"], -r["rn"])
    order = sorted(got, key=signed, reverse=True)
    assert all(a["next_text"] == b["text"] for a, b in zip(order, order[1:] + order[:1]))


# Personal data


def brute_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1]))
        if 12 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(11)
    parts = ["a@b.c", "x@y.zz.w_q@k.m", "@", "..@a.b", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111",
             "+1 (555) 123-4567", "+1", "+49.30.123456", "++12 34567890", "é😀", "12 ", "3", "-", ".", " ", "\n", "a%b+c@d-e.f-g.h", "9" * 25, "00000000000000"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "x", "\n"]) for _ in range(rng.randrange(1, 14)))) for i in range(300)]
    rows += odd_rows() + [(900, "7 " * 3000), (901, "1" * 20000), (902, "a@b.cd " * 700), (903, "+" * 5000)]
    df = docs(spark, rows)
    out = pii.find_spans(df, pii.learn(df)).select("doc_id", pii.joined({k: F.col(f"base_{k}") for k in pii.KINDS}).alias("s")).collect()
    want = sorted(((i, ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t))) for i, t in rows), key=str)
    assert sorted(((r[0], r[1]) for r in out), key=str) == want


def test_trees_as_sql_equal_trees_in_python(spark):
    from quillmark.llm import boosting

    rng = random.Random(12)
    counts = []
    for _ in range(120):
        code, n = rng.randrange(1 << 16), rng.randrange(1, 30)
        counts.append((code, n, rng.randrange(n + 1) if code >> 9 & 1 else 0))
    t = boosting.boost(counts, pii.FIELDS)
    got = spark.createDataFrame([(c[0],) for c in counts], "c int").select("c", t.column(F.col("c")).alias("m")).collect()
    assert all(abs(r["m"] - t.margin(r["c"])) < 1e-9 for r in got)
    good = [p for c, n, p in counts if c >> 9 & 1]
    assert good and np.mean([t.probability(c) for c, n, p in counts if not c >> 9 & 1]) < 0.2


def planted_texts(rng, n):
    """(text, added spans as texts, whether clean)."""
    out = []
    for i in range(n):
        d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        code = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        issued = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        what = [
            (f"phone +1 ({d(3)}) {d(3)}-{d(4)}", None), (f"token = \"{code}\"", code), (f"password={code[:18]}", code[:18]), (issued, issued),
            (f"write to {rng.choice(WORDS)}{d(2)} [at] {rng.choice(WORDS)} [dot] com", "mail"), (f"host {':'.join(code[j : j + 4] for j in range(0, 32, 4))}", "v6"),
            (f"call ({d(3)}) {d(3)}-{d(4)}", "phone"), (f"version {d(1)}.{d(1)} of 20{d(2)}", ""), (f"at {rng.randrange(24)}:{d(2)} on page {d(3)}", ""), (f"item {d(6)}", ""), (f"mail {rng.choice(WORDS)}@site{d(2)}.org", None),
        (f"and ({d(3)}) {d(3)}-{d(4)}", "phone") if i % 120 == 11 else ("and so on", ""),
        ][i % 12]
        out.append((f"{prose(rng, 8)} {what[0]} {prose(rng, 8)}", what[1]))
    return out


def test_added_spans_have_precision_and_recall(spark):
    rows = [(i, *x) for i, x in enumerate(planted_texts(random.Random(19), 1200))]
    df = docs(spark, [r[:2] for r in rows])
    found = pii.find_spans(df, pii.learn(df)).collect()
    spans = {r["doc_id"]: sum(len(r[f"added_{k}"]) for k in pii.ALL_KINDS) for r in found}
    want = {i for i, _, kind in rows if kind}
    clean = {i for i, _, kind in rows if kind == ""}
    caught = {i for i, n in spans.items() if n}
    assert len(caught & want) >= 0.9 * len(want), {k: sum(1 for i, _, x in rows if x == k and i in caught) for k in ("mail", "v6", "phone")}
    assert len(caught & clean) <= 0.02 * len(clean)
    exact = [(r, rows[r["doc_id"]]) for r in found if rows[r["doc_id"]][2] and len(rows[r["doc_id"]][2]) > 10]
    assert all([t[s["s"] : s["e"]] for s in r["added_secret"]] == [secret] for r, (_, t, secret) in exact if r["doc_id"] in caught)


def test_pii_on_long_texts_empty_tables_and_clashing_names(spark):
    rng = random.Random(20)
    long = " ".join(rng.choice(["+49 30 123 456 78", "a.b@c.org", "4111 1111 1111 1111", "10.0.0.1", "tel 030 1234567", "word"]) for _ in range(30_000))
    df = docs(spark, [(1, long), (2, None), (3, ""), (3, "x@y.org"), (None, "x@y.org")]).withColumns({"t": F.lit(1), "base_ip": F.lit("x")})
    start = time.monotonic()
    out = pii.find_spans(df, pii.learn(df)).collect()
    assert time.monotonic() - start < 60 and len(long) > 300_000
    assert sorted((str(r["doc_id"]), len(r["base_email"])) for r in out) == sorted([("1", long.count("@")), ("2", 0), ("3", 0), ("3", 1), ("None", 1)])
    none = docs(spark, [])
    assert not pii.find_spans(none, pii.learn(none)).collect()


def test_redaction(spark):
    df = spark.createDataFrame([("mail a@b.c now", [(5, 10)])], "t string, s array<struct<s:bigint,e:bigint>>")
    assert df.select(pii.redact(F.col("t"), F.col("s"))).first()[0] == "mail ***** now"


# Lines


def test_recurring_lines_go_but_their_first(spark):
    rng = random.Random(13)
    rows = []
    for i in range(12):
        common = "All rights reserved by the owner."
        numbered = f"Page {i} of {i + 40} printed on day {i}"
        worded = f"Posted to this public board by member {rng.choice(WORDS)}{rng.choice(WORDS)} on request of staff"
        rows.append((i, "\n".join([prose(rng, 15), common, numbered, worded, "Yes.", prose(rng, 12)])))
    rows += [(50, None), (51, ""), (None, "x y z\nx y z")]
    out = {r["doc_id"]: r for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["lines_dropped"] == 0
    for i in range(1, 12):
        own = rows[i][1].split("\n")
        assert out[i]["text"] == "\n".join([own[0], own[4], own[5]]), out[i]["text"]
        assert out[i]["n_chars"] == len(out[i]["text"])
    assert out[50]["text"] is None and out[50]["lines_total"] == 0 and out[51]["text"] == ""
    assert out[None]["text"] == "x y z\nx y z"
    assert not lines.dedup_lines(docs(spark, [])).collect()


def test_templates_stay_general_as_field_values_recur(spark):
    rng = random.Random(17)
    rows = [(i, f"{prose(rng, 15)}\nThread moved to this board {WORDS[i % 10]} by member {WORDS[i // 10 % 10]} on request") for i in range(200)]
    # A tenth of the leaf's documents have a template of their own.
    rows += [(200 + i, f"{prose(rng, 15)}\nThread moved to that archive x{WORDS[i % 11]} after vote x{WORDS[i // 3 + 11]} of staff") for i in range(20)]
    out = {r["doc_id"]: r["lines_dropped"] for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert out == {i: int(i not in (0, 200)) for i, _ in rows}


def test_short_recurring_lines_go(spark):
    rng = random.Random(18)
    board = "".join(chr(0x4E00 + 7 * i) for i in range(24))
    rows = []
    for i in range(25):
        some = [board] if i < 6 else []
        rows.append((i, "\n".join([prose(rng, 15), "Read more", *some, f"Posted by {WORDS[i]}{i % 3 * 'x'} in x{WORDS[i // 2]}", f"{i % 24}", prose(rng, 12)])))
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert out[0] == rows[0][1]
    for i in range(1, 25):
        own = rows[i][1].split("\n")
        assert out[i] == "\n".join([own[0], own[-2], own[-1]]), out[i]


def test_templates_of_one_document_stay(spark):
    listed = "\n".join(f"the total price of this item called {w} was rather high" for w in WORDS[:8])
    rows = [(1, listed), (2, listed.split("\n")[0]), *[(3 + i, prose(random.Random(i), 20)) for i in range(8)]]
    assert not any(r["lines_dropped"] for r in lines.dedup_lines(docs(spark, rows)).collect())
    # In five documents, if not by one wording, the template recurs.
    rows += [(20 + i, listed.split("\n")[i]) for i in range(3, 6)]
    out = {r["doc_id"]: r["lines_dropped"] for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert out[1] == 7 and out[2] == 1 and all(out[20 + i] == 1 for i in range(3, 6))


def test_line_dedup_of_long_texts(spark):
    rng = random.Random(21)
    own = [f"{WORDS[i % 42]} {prose(rng, 6)} {i}" if i % 2 else "this line is common to all of them" for i in range(60_000)]
    rows = [(i, "this line is common to all of them") for i in range(5)] + [(9, "\n".join(own))]
    start = time.monotonic()
    out = {r["doc_id"]: r for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert time.monotonic() - start < 60
    assert out[9]["lines_dropped"] >= 30_000 and out[0]["lines_dropped"] == 0 and out[4]["text"] == ""


def test_line_dedup_keeps_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(i, "one two three four", i, i, i, "x", i) for i in range(9)], "doc_id long, text string, g int, lk int, __th int, first string, lines_total int")
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "g", "lk", "__th", "first", "lines_total", "lines_dropped"]
    assert sum(r["lines_dropped"] for r in out.collect()) == 8


# WARC


def test_warc_round_trip(spark):
    big, other = "é" * 700, "<p>" + "x" * 1200
    rows = [(1, "http://a.example.org/x", big), (2, "http://b.example.org/y", big), (3, "http://a.example.org/x", other), (4, None, "small"), (5, "http://c.com/\r\nX: y", "small"), (6, "ftp://c.com:21/", None),
            (7, "http://a.example.org/x", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" + other), (8, "no url", big), (9, "http://é.org/ü", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "")]
        rev = len(raw) >= 1000 and i < max(same)
        assert tuple(got[i]) == (i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if rev else "response", max(same) if rev else None)
    assert not warc.round_trip(df.limit(0)).collect()


def test_warc_of_null_and_repeated_pages(spark):
    big = "y" * 1500
    rows = [(None, "http://a.b/", big), (5, "http://a.b/", big), (5, "http://a.b/", big), (3, None, big), (3, None, big), (4, "u", None)]
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    sha = hashlib.sha1(big.encode()).hexdigest()
    want = [(None, 1500, sha, "response", None), *[(5, 1500, sha, "response", None)] * 2, *[(3, 1500, sha, "revisit", 5)] * 2, (4, 0, hashlib.sha1(b"").hexdigest(), "response", None)]
    assert got == sorted(want, key=str)


def test_index_lookup_finds_all_and_only_the_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PART_CAPTURES", 40)
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 7)
    rows = [(i, f"http://h{i % 5}.example.com/{i % 50}", f"<b>{i}</b>") for i in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    a, x = f"file://{tmp_path}/warc", f"file://{tmp_path}/cdx"
    captures = warc.write_archives(df, a, 4000)
    cdx = warc.build_index(captures, x)
    keys = df.where("page_id % 3 = 0").select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    missing = spark.createDataFrame([("zzz",), ("",), (None,), ("com,example,h1)/ nope",)], "key string")
    got = warc.read_records(warc.lookup(keys.unionByName(missing), cdx)).collect()
    assert sorted((r["page_id"], r["payload"].decode()) for r in got) == [(i, h) for i, _, h in rows if i % 3 == 0]
    assert spark.createDataFrame([("http://a.B.org:80/x?y",)], "u string").select(warc.surt(F.col("u"))).first()[0] == "org,b,a:80)/x?y"
    # Archives that came without captures give the same ones.
    scanned = warc.scan_archives(spark, captures.select("path").distinct())
    assert sorted(map(tuple, scanned.collect())) == sorted(map(tuple, captures.collect()))


def test_range_reads_take_only_what_is_asked_for(spark, tmp_path):
    rng = random.Random(22)
    rows = [(i, f"http://h{i % 7}.org/{i}", prose(rng, 200)) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    captures = warc.write_archives(df, f"file://{tmp_path}/warc")
    cdx = warc.build_index(captures, f"file://{tmp_path}/cdx")
    keys = df.where("page_id % 100 = 7").select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    found = [tuple(r)[2:] for r in warc.lookup(keys, cdx).collect()]
    asked, total = sum(r[1] for r in warc.runs(found)), captures.agg(F.sum("length")).first()[0]
    assert len(found) == 4 and asked == sum(n for _, n in found) and asked < 0.02 * total
    assert sum(p.stat().st_size for p in (tmp_path / "warc").iterdir()) == total
    assert warc.runs([(10, 5), (0, 10), (20, 3)]) == [[0, 15, [(0, 10), (10, 5)]], [20, 3, [(20, 3)]]]


# Passages


def test_chains_equal_quadratic_dynamic_program():
    rng = random.Random(14)
    for _ in range(20):
        n = rng.randrange(1, 40)
        pos, ref = np.array(sorted(rng.randrange(60) for _ in range(n))), np.array([rng.randrange(60) for _ in range(n)])
        best = []
        for j in range(n):
            gains = [best[i] - 0.05 * (pos[j] - pos[i] + ref[j] - ref[i]) for i in range(n) if i < len(best) and pos[i] < pos[j] and ref[i] < ref[j]]
            best.append(5 + max([0, *gains]))
        got = passages.chains(pos, ref, max_gap=10**6)
        assert sorted(i for c in got for i in c) == list(range(n))
        c = got[0]
        score = 5 * len(c) - sum(0.05 * (pos[b] - pos[a] + ref[b] - ref[a]) for a, b in zip(c, c[1:]))
        assert abs(score - max(best)) < 1e-6
        assert all(pos[a] < pos[b] and ref[a] < ref[b] for a, b in zip(c, c[1:]))


def test_seeds_come_in_small_batches(monkeypatch):
    runs = []
    monkeypatch.setattr(passages, "map_arrow", lambda df, run, schema: runs.append(run))
    monkeypatch.setattr(passages, "SEED_ROWS", 1000)
    passages._seed_rows(None)
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=n)).encode() for n in (*[50] * 300, 0, 4, 5, 3000, 10)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    out = list(runs[0](iter([batch, batch.slice(0, 0), batch])))
    assert all(b.num_rows <= 1000 or len(set(b.column("doc_id").to_pylist())) == 1 for b in out)
    got = sorted((r["doc_id"], r["pos"], r["h"]) for b in out for r in b.to_pylist())
    want = sorted((i, int(x), int(y)) for i, t in enumerate(texts) for x, y in zip(*passages.seeds(passages.word_hashes(t)), strict=True))
    assert got == sorted(want * 2)


def test_chains_of_many_pairs_equal_those_of_each(monkeypatch):
    runs = []
    monkeypatch.setattr(passages, "map_arrow", lambda df, run, schema: runs.append(run))
    rng = np.random.default_rng(4)
    pairs = []
    for g in range(400):
        n = int(rng.integers(1, 9))
        pos = np.cumsum(rng.choice([1, 2, 5, 6, 40, 60, 61], n))
        ref = pos + (int(rng.integers(0, 90)) if g % 3 else rng.integers(0, 3, n) * 7)
        pairs.append((g, 1000 + g, [{"pos": int(a), "rpos": int(b)} for a, b in rng.permutation(np.stack([pos, ref], 1))]))
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("rpos", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], t) for i, t in enumerate((pa.int64(), pa.int64(), kind))], names=["doc_id", "ref_id", "hits"])
    for least in (1, 3):
        passages._chain_rows(None, least)
        got = sorted(tuple(map(str, r.values())) for b in runs[-1](iter([batch.slice(7), batch.slice(0, 7), batch.slice(0, 0)])) for r in b.to_pylist())
        again = sorted(tuple(map(str, r.values())) for b in runs[-1](iter([batch.take(pa.array(range(399, -1, -1)))])) for r in b.to_pylist())
        want = []
        for doc, ref, hits in pairs:
            p, q = (np.array(x) for x in zip(*sorted((h["pos"], h["rpos"]) for h in hits), strict=True))
            found = passages.chains(p, q)
            boxes = []
            for c in found:
                x, y = p[c], q[c]
                if len(c) < least or (len(c) == 1 and any(b[0] <= x[0] <= b[1] and b[2] <= y[0] <= b[3] for b in boxes)):
                    continue
                boxes.append((x[0], x[-1], y[0], y[-1]))
                same = [b - a <= passages.K and b - a == d - c_ for a, b, c_, d in zip(x, x[1:], y, y[1:], strict=False)]
                stay = [i for i in range(len(x)) if not (i and i < len(x) - 1 and same[i - 1] and same[i])]
                want.append((str(doc), str(ref), str(x[stay].tolist()), str(y[stay].tolist())))
        assert got == again == sorted(want)


def test_planted_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(15)
    vocab = [f"{a}{b}" for a in WORDS for b in WORDS]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    p1, p2 = text(60), text(80)
    fuzzy = list(p2)
    for i in range(5, 80, 16):
        fuzzy[i] = "other"
    del fuzzy[40]
    rows = [(1, text(100) + p1 + text(50)), (2, p1 + text(30)), (3, text(10) + p1), (4, text(90) + p2), (5, fuzzy + text(70)), (6, text(300)), (7, text(20)), (8, text(100)), (9, [])]
    rows = [(i, " ".join(t)) for i, t in rows] + [(10, None), (None, "x y z")]
    out = passages.repeated_passages(docs(spark, rows)).collect()
    pairs = {(r["doc_id"], r["ref_doc_id"]): r for r in out}
    assert {(2, 1), (3, 1), (5, 4)} == set(pairs)
    assert (pairs[2, 1]["start_word"], pairs[2, 1]["end_word"], pairs[2, 1]["ref_start_word"]) == (0, 60, 100) and pairs[2, 1]["similarity"] == 1
    assert pairs[5, 4]["similarity"] >= 0.8 and pairs[5, 4]["end_word"] - pairs[5, 4]["start_word"] >= 70
    assert not passages.repeated_passages(docs(spark, [])).collect()


def test_fuzzy_passages_with_few_equal_runs_are_found(spark):
    rng = random.Random(19)
    vocab = [f"{a}{b}" for a in WORDS for b in WORDS]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = []
    for k in range(40):
        p = text(55)
        changed = [f"new{k}" if i % 7 == 6 else w for i, w in enumerate(p)]
        rows += [(2 * k, text(40) + p + text(40)), (2 * k + 1, text(30) + changed + text(30))]
    # A seed of very many documents goes over the borders of partitions.
    rows += [(100 + i, text(20) + ["one", "two", "three", "four", "five"] + text(20)) for i in range(300)]
    out = passages.repeated_passages(docs(spark, [(i, " ".join(t)) for i, t in rows])).collect()
    assert sorted((r["doc_id"], r["ref_doc_id"]) for r in out) == [(2 * k + 1, 2 * k) for k in range(40)]


def test_fuzzy_passages_with_one_equal_run_of_five_are_found(spark):
    rng = random.Random(37)
    vocab = [f"{a}{b}" for a in WORDS for b in WORDS]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = []
    for k in range(30):
        p = text(44)
        changed = [f"new{k}" if i in (4, 9, 15, 20, 25, 30, 35) else w for i, w in enumerate(p)]
        rows += [(2 * k, text(40) + p[:40] + text(40)), (2 * k + 1, text(30) + changed[:40] + text(30))]
    out = passages.repeated_passages(docs(spark, [(i, " ".join(t)) for i, t in rows])).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in out} == {(2 * k + 1, 2 * k) for k in range(30)}


def test_every_seed_meets_its_first_occurrence_and_the_one_before(spark):
    rng = random.Random(20)
    rows = sorted({(rng.randrange(50), rng.randrange(30), rng.choice([3, 3, 3, rng.randrange(40)])) for _ in range(900)})
    first, before, want = {}, {}, []
    for d, p, h in rows:
        first.setdefault(h, (d, p))
        own = [first[h]] if first[h][0] != d else []
        if h % 2 and h in before and before[h][0] not in (d, first[h][0]):  # long seeds
            own.append(before[h])
        want += [(d, p, *x) for x in own]
        before[h] = (d, p)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    held = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        got = passages._hits(spark.createDataFrame(rows[::-1], "doc_id long, pos int, h long").repartition(9)).collect()
    finally:
        spark.conf.set(name, held)
    assert sorted(tuple(r)[:4] for r in got) == sorted(want)
    assert all(r["first_id"] is None or r["first_id"] < r["ref_id"] for r in got)


def test_passages_with_scattered_first_seeds_are_found(spark):
    rng = random.Random(23)
    vocab = [f"{a}{b}" for a in WORDS for b in WORDS]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, want = [], set()
    for k in range(20):
        p = text(60)
        # Earlier documents have slices of the passage, each too short to count.
        rows += [(1000 * k + i, text(40) + p[6 * i : 6 * i + 16] + text(40)) for i in range(9)]
        rows += [(1000 * k + 100, text(30) + p + text(30)), (1000 * k + 101, text(20) + p + text(20))]
        want.add((1000 * k + 101, 1000 * k + 100))
    out = passages.repeated_passages(docs(spark, [(i, " ".join(t)) for i, t in rows])).collect()
    found = {(r["doc_id"], r["ref_doc_id"]) for r in out}
    assert len(found & want) >= 0.95 * len(want) and not found - want


def test_exact_passages_with_slices_before_and_between_are_found(spark):
    rng = random.Random(33)
    vocab = [f"{a}{b}" for a in WORDS for b in WORDS]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, want = [], set()
    for k in range(30):
        p = text(60)
        slices = [p[12 * i : 12 * i + 12] for i in range(5)]
        rows += [(1000 * k + i, text(40) + x + text(40)) for i, x in enumerate(slices)]
        rows.append((1000 * k + 100, text(30) + p + text(30)))
        rows += [(1000 * k + 200 + i, text(40) + x + text(40)) for i, x in enumerate(slices)]
        rows.append((1000 * k + 300, text(20) + p + text(20)))
        want.add((1000 * k + 300, 1000 * k + 100))
    out = passages.repeated_passages(docs(spark, [(i, " ".join(t)) for i, t in rows])).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in out} == want
    assert all(r["end_word"] - r["start_word"] == 60 and r["similarity"] == 1 for r in out)


def test_an_equal_run_shares_a_long_seed():
    rng = np.random.default_rng(34)
    for _ in range(50):
        p = rng.integers(1, 1 << 60, passages.LONG_K + passages.WINDOW - 1).astype(np.uint64)
        a, b = (np.concatenate((rng.integers(1, 1 << 60, n).astype(np.uint64), p, rng.integers(1, 1 << 60, 50).astype(np.uint64))) for n in (3, 77))
        x, y = (set(passages.seeds(w)[1].tolist()) for w in (a, b))
        assert any(h & 1 for h in x & y)


def test_passages_of_repeated_keys_and_long_texts(spark):
    rng = random.Random(24)
    vocab = [f"{a}{b}" for a in WORDS for b in WORDS]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    p = text(60)
    rows = [(1, text(200_000) + p), (2, p + text(9)), (2, p + text(9)), (3, ["zz"]), (3, ["aa", *p])]
    rows = [(i, " ".join(t)) for i, t in rows]
    rows[2] = rows[1]
    df = docs(spark, rows).withColumns({"pos": F.lit(1), "h": F.lit("x"), "words": F.lit(None)})
    got = sorted((r["doc_id"], r["ref_doc_id"], r["start_word"], r["end_word"]) for r in passages.repeated_passages(df).collect())
    assert got == [(2, 1, 0, 60), (3, 1, 1, 61)]


def test_edit_distance_matches_plain_table():
    rng = np.random.default_rng(16)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(d[j + 1] + 1, new[j] + 1, d[j] + (x != y)))
            d = new
        assert passages._edits(a, b) == d[-1]


def test_workers_forget_the_words_of_other_operators(spark):
    class Held:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words to remember"])], names=["doc_id", "text"])

    def tasks(module):
        def run(batches):
            for b in batches:
                passages.word_hashes(b.column("text")[0].as_py().encode())
                yield b

        run.__module__ = module
        return common.map_arrow(Held(), run, None)

    own, other = tasks("quillmark.llm.passages"), tasks("quillmark.llm.langid")
    assert list(own(iter([batch]))) == [batch] and len(passages._words) >= 4
    list(own(iter([])))
    assert len(passages._words) >= 4
    packing._HELD["x"] = (1,)
    list(other(iter([])))
    assert not passages._words and not packing._HELD


def test_seeds_that_occur_once_are_not_sorted(monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_SEEDS", 700)
    rng = random.Random(41)
    ids = [0, -5, 1 << 50, 7, 300, 70_000, *range(1000, 1060)]
    texts = [" ".join(rng.choices("abcdefghijkl", k=n)).encode() for n in (200, 3, 0, 5, 70_000, 200, *[60] * 60)]
    texts[9] = texts[8]  # long seeds too
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    made = pa.Table.from_batches(passages._blocks(iter([batch, batch.slice(0, 0)])))
    assert {0, 1, 2} == set(made.column("kind").to_pylist())
    got = pa.Table.from_batches(passages._repeated(iter(made.sort_by("cell").to_batches())))
    every = [(int(h), int(p), i) for i, t in zip(ids, texts, strict=True) for p, h in zip(*passages.seeds(passages.word_hashes(t)), strict=True)]
    count = Counter(h for h, _, _ in every)
    assert sorted(zip(*(got.column(c).to_pylist() for c in ("h", "pos", "doc_id")), strict=True)) == sorted(r for r in every if count[r[0]] > 1)
    assert 0 < got.num_rows < len(every)
    # However often a hash occurs, its cell has it once from each block of seeds.
    same = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array([b"a b c d e"] * 400, pa.binary())], names=["doc_id", "text"])
    held = [r for b in passages._blocks(iter([same])) for r in b.to_pylist() if r["kind"] != passages.REPEATED]
    assert [len(r["hs"]) for r in held] == [5]


def test_signatures_reach_as_far_as_words():
    rng = np.random.default_rng(42)
    a = rng.integers(0, 1 << 32, 4000).astype("<u4")
    b = np.where(rng.random(4000) < 0.75, a, rng.integers(0, 1 << 32, 4000)).astype("<u4")
    i = rng.integers(200, 3800, 300)
    n = rng.integers(0, 150, 300)
    for step in (1, -1):
        want = [passages._stretch(a[x : x + m * step : step], b[x : x + m * step : step]) for x, m in zip(i, n, strict=True)]
        assert passages._reaches(a, i, b, i, n, step).tolist() == want
        assert (passages._reaches(a & 3, i, b & 3, i, n, step) >= want).all()
    assert passages._reaches(a, i[:2], b, i[:2], np.array([0, 0]), 1).tolist() == [0, 0]


def test_chains_too_short_over_signatures_are_dropped(spark):
    rng = random.Random(43)
    vocab = [f"{a}{b}" for a in WORDS for b in WORDS]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    short, long = text(12), text(45)
    texts = {1: text(70) + short + text(60) + long, 2: text(9) + short + text(100), 3: long + text(3)}
    d = spark.createDataFrame([(i, " ".join(t).encode()) for i, t in texts.items()], "doc_id long, text binary")
    rows = [(2, 1, [9, 16], [70, 77], 0, 128, 0, 192), (3, 1, [0, 40], [142, 182], 0, 128, 64, 320)]
    placed = spark.createDataFrame(rows, "doc_id long, ref_id long, pos array<int>, rpos array<int>, da int, db int, ra int, rb int")
    out = passages._promising(placed, passages._signatures(d), 40).collect()
    assert [tuple(r) for r in out] == [rows[1]]
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with common.shuffles_removed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before


def test_words_and_seeds_of_many_texts_equal_those_of_each():
    rng = random.Random(51)
    texts = [b"", b" ", b"  A  b ", b"\x0b\x0c\x1cq\x85r \xc2\xa0z", b"\xff\xfe A\r\nB\x00C", *[b"x" * n + b" " + b"\x00" * n for n in range(70)], b""]
    texts += [" ".join(rng.choices("abcd", k=n)).encode() for n in (3, 4, 5, 23, 24, 25, 38, 39, 40, 41, 500, 0)]
    w, sizes = passages.hashes_of_texts(texts)
    each = [passages.word_hashes(t) for t in texts]
    assert sizes.tolist() == [len(x) for x in each] and (w == np.concatenate(each)).all()
    own, pos, h = passages._seeds_of_texts(w, sizes)
    want = sorted((i, int(p), int(s)) for i, x in enumerate(each) for p, s in zip(*passages.seeds(x), strict=True))
    assert sorted(zip(own.tolist(), pos.tolist(), h.tolist(), strict=True)) == want
    assert not len(passages.hashes_of_texts([])[0]) and not len(passages._seeds_of_texts(*passages.hashes_of_texts([b"", b"a b"]))[2])


def _brute_chains(pos, ref, w, max_gap):
    order = sorted(range(len(pos)), key=lambda i: (pos[i], ref[i], i))
    score, parent = {}, {}
    for a, j in enumerate(order):
        best, near = 0, (0, 0, -1)
        for i in order[:a]:
            dp, dr = pos[j] - pos[i], ref[j] - ref[i]
            if dp > 0 and dr > 0:
                g = score[i] - dp - dr
                best = max(best, g)
                if max(dp, dr) <= max_gap and (g > near[0] or (g == near[0] > 0 and abs(dp - dr) <= near[1])):
                    near = g, abs(dp - dr), i
        score[j], parent[j] = w + best, near[2]
    used, out = set(), []
    for j in sorted(order, key=lambda i: -score[i]):
        chain = []
        while j >= 0 and j not in used:
            used.add(j)
            chain.append((pos[j], ref[j]))
            j = parent[j]
        if chain:
            out.append(chain[::-1])
    return out


def test_chains_by_runs_equal_those_match_by_match(monkeypatch):
    monkeypatch.setattr(passages, "PAIRS", 50)
    rng = np.random.default_rng(52)
    for turn in range(400):
        n = int(rng.integers(1, 60))
        near = np.cumsum(rng.choice([1, 1, 1, 1, 5, 6, 30, 55, 61], n))
        pos, ref = [
            (rng.integers(0, 80, n), rng.integers(0, 80, n)),
            (near, np.abs(near + np.cumsum(rng.choice([0] * 9 + [1, -3], n)))),
            (near // 3, np.where(rng.random(n) < 0.3, 7, near // 3 + 3)),
            (np.minimum(near, np.arange(n)), np.minimum(near, rng.permutation(n))),
        ][turn % 4]
        for max_gap in (3, 60):
            got = [list(zip(pos[c].tolist(), ref[c].tolist(), strict=True)) for c in passages.chains(pos, ref, max_gap=max_gap)]
            assert sorted(got) == sorted(_brute_chains(pos.tolist(), ref.tolist(), 100, max_gap))
    # Of equal gaps, the chain keeps to its diagonal: (18, 18), not (19, 18).
    pos, ref = np.array([16, 17, 18, 19, 20, 21]), np.array([16, 17, 18, 18, 20, 21])
    assert [18, 18] in np.stack([pos, ref], 1)[passages.chains(pos, ref)[0]].tolist()


def test_straight_chains_are_aligned_like_others(monkeypatch):
    runs = []
    monkeypatch.setattr(passages, "map_arrow", lambda df, run, schema: runs.append(run))
    monkeypatch.setattr(passages, "ALIGNED", 7)
    passages._aligned(None, 12, 0.8)
    rng = np.random.default_rng(53)
    rows, want = [], []
    for i in range(200):
        a = rng.integers(0, 1 << 32, 80).astype("<u4")
        b = np.where(rng.random(80) < rng.choice([0.7, 0.9, 1]), a, 7).astype("<u4")
        cut = int(rng.integers(0, 9))
        b = b[cut:]
        x = np.sort(rng.choice(np.arange(10, 70), int(rng.integers(1, 4)), replace=False))
        y = x - cut + (np.arange(len(x)) if i % 5 == 0 else 0)
        rows.append((i, 1000 + i, (x + 64).tolist(), (y + 128).tolist(), 64, 128, a.tobytes(), b.tobytes()))
        a0, a1, b0, b1, s = passages.align(a, b, list(zip(x.tolist(), y.tolist(), strict=True)))
        if min(a1 - a0, b1 - b0) >= 12 and s >= 0.8:
            want.append((i, 64 + a0, 64 + a1, 1000 + i, 128 + b0, 128 + b1, round(s, 6)))
    names = ["doc_id", "ref_id", "pos", "rpos", "da", "ra", "dw", "rw"]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
    got = [tuple(r.values()) for b in runs[0](iter([batch.slice(50), batch.slice(0, 50), batch.slice(0, 0)])) for r in b.to_pylist()]
    assert sorted(got) == sorted(want) and 20 < len(want) < 200


def test_seeds_are_linked_in_their_cells(monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_SEEDS", 700)
    monkeypatch.setattr(passages, "SEED_ROWS", 300)
    rng = random.Random(54)
    ids = [*range(1060, 1000, -1), 0, -5, 1 << 50, 7]
    texts = [" ".join(rng.choices("abcdefghijkl", k=n)).encode() for n in (*[60] * 60, 200, 5, 3000, 200)]
    texts[9] = texts[40] = texts[62]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    made = pa.Table.from_batches(passages._blocks(iter([batch])))
    got = pa.Table.from_batches(passages._repeated(iter(made.sort_by("cell").to_batches()), link=True)).to_pylist()
    places = {}
    for i, t in zip(ids, texts, strict=True):
        for p, h in zip(*(x.tolist() for x in passages.seeds(passages.word_hashes(t))), strict=True):
            places.setdefault(h, []).append((i, p))
    want = sorted((*x, *min(v)) for h, v in places.items() for x in v if h % 2 == 0 and x[0] != min(v)[0])
    rest, linked = {}, [(r["doc_id"], r["pos"], r["ref_id"], r["rpos"]) for r in got if r["ref_id"] is not None]
    for r in got:
        if r["ref_id"] is None:
            rest.setdefault(r["h"], []).append((r["doc_id"], r["pos"]))
    later = [(*x, *min(v)) for h, v in rest.items() for x in v if h % 2 == 0 and x[0] != min(v)[0]]
    assert sorted(linked + later) == want and linked and later
    assert {h: sorted(v) for h, v in rest.items() if h % 2} == {h: sorted(v) for h, v in places.items() if h % 2 and len(v) > 1}


def test_passages_inside_others_of_their_pair_go(spark):
    rng = random.Random(55)
    names = ["doc_id", "start_word", "end_word", "ref_doc_id", "ref_start_word", "ref_end_word", "similarity"]
    rows = []
    for _ in range(600):
        a, b, n, m = (rng.randrange(12) for _ in range(4))
        rows.append((rng.randrange(9), a, a + n, rng.randrange(3), b, b + m, rng.choice([0.8, 0.9, 1.0])))
    out = passages._widest(spark.createDataFrame(rows, "doc_id long, start_word long, end_word long, ref_doc_id long, ref_start_word long, ref_end_word long, similarity double"))

    def inside(x, y):
        size = [r[2] - r[1] + r[5] - r[4] for r in (x, y)]
        held = x[0] == y[0] and x[3] == y[3] and y[1] <= x[1] and y[2] >= x[2] and y[4] <= x[4] and y[5] >= x[5]
        return held and (size[1] > size[0] or y[6] > x[6])

    assert out.columns == names
    assert sorted(map(tuple, out.collect())) == sorted(x for x in set(rows) if not any(inside(x, y) for y in rows))
