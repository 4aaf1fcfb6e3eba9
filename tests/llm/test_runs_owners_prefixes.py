"""Periodic runs, exact duplicates and the prefix trie against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import owners, prefixes, queries, runs, scans

DOC = "doc_id long, text string, lang string, source string, n_chars long"
TURN = "conv_id long, turn long, role string, text string"


def write(df, path, table):
    df.write.mode("overwrite").parquet(f"file://{path}/{table}.parquet")
    return f"file://{path}"


# Runs


def brute_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, m = i, j - i + q
            if j - i >= q and m >= least and not any(all(w[x] == w[x + p] for x in range(s, s + m - p)) for p in range(1, q)):
                out.append((s, m, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng):
    k, n = rng.choice([1, 2, 3, 5, 40]), rng.randrange(0, 70)
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        u = [rng.randrange(k + 2) for _ in range(rng.randrange(1, 12))]
        at = rng.randrange(len(w) + 1)
        w = w[:at] + u * rng.randrange(1, 6) + u[: rng.randrange(len(u))] + w[at:]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        w = periodic(rng)
        assert sorted(runs.tandem_runs(w), key=lambda r: (r[0], r[2])) == brute_runs(w, 2)
        assert runs.runs_of([b"w%d" % x for x in w]) == brute_runs(w)


def test_stretches_hold_all_runs():
    rng = random.Random(6)
    words = [b"%d" % rng.randrange(900) for _ in range(4000)]
    words[1000:1000] = words[100:140] * 3
    words[3000:3000] = [b"x"] * 30
    found = runs.runs_of(words)
    assert {(m // 40, q) for _, m, q in found if q == 40} == {(3, 40)} and (30, 1) in {(m, q) for _, m, q in found}
    assert sum(b - a for a, b in runs.stretches(np.arange(5000))) == 0


def test_suffix_tree_and_blocks():
    rng = random.Random(7)
    for _ in range(200):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        tree = runs.SuffixTree(s)
        assert sorted(tree.leaves) == list(range(len(s) + 1))
        blocks, i = [], 0
        while i < len(s):
            m = max((m for m in range(len(s) - i + 1) if any(s[j : j + m] == s[i : i + m] for j in range(i))), default=0)
            blocks.append(i)
            i += max(1, m)
        assert tree.blocks() == [*blocks, len(s)]


def brute_op11(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {x for a, m, q in found for x in range(a + q, a + m)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rest = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *rest, sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None, "a b " * 9), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "é " * 30), (5, " x" * 3 + " y  z" * 8), (6, "a\x1cb c " * 7), (9, "a " * 500)]
    rows += [(i, " ".join(f"w{x}" for x in periodic(rng))) for i in range(10, 160)]
    rows += rows[20:24]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOC).withColumns({"runs": F.lit(1), "kept": F.lit("x"), "key": F.lit(2), "start": F.lit(3)})
    out = queries.op11_periodic_runs(spark, write(df, tmp_path, "documents"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted((brute_op11(*r) for r in rows), key=str)
    assert not queries.op11_periodic_runs(spark, write(df.limit(0), tmp_path, "documents")).collect()


def test_runs_of_a_very_long_text(spark):
    rng = random.Random(9)
    unit = [f"u{x}" for x in range(4000)]
    text = " ".join([f"r{rng.randrange(9000)}" for _ in range(60_000)] + unit * 5 + ["z"] * 20_000)
    (row,) = runs.collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == [(60_000, 20_000, 4000), (80_000, 20_000, 1)]
    assert len(row["kept"].split()) == 64_001


# Owners


def brute_owners(rows, largest):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        stays = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and stays, hashlib.sha256(t.encode()).hexdigest()))
            stays = stays and i != keep
    return sorted(out, key=str)


def copies(rng):
    rows = [(None, None), (None, ""), (1, ""), (2, None), (3, "same"), (3, "same"), (3, "same"), (None, "lone"), (None, "two"), (None, "two"), (4, "é" * 4000), (-4, "é" * 4000), (5, "é" * 4001)]
    base = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(60))) for _ in range(40)]
    return rows + [(10 + rng.randrange(200), rng.choice(base) + rng.choice(["", "x", "xy"])) for _ in range(600)] + [(1000 + i, "hot " * 50) for i in range(400)]


def test_owners_equal_brute_force(spark):
    rows = copies(random.Random(10))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"owner": F.lit(1), "size": F.lit("x"), "hash": F.lit(2), "kept": F.lit(0), "row": F.lit(0)})
    for keep in ("largest", "smallest"):
        got = owners.find_owners(df, keep=keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute_owners(rows, keep == "largest")
    assert not owners.find_owners(df.limit(0)).collect()


def test_owners_spill_by_subtree(spark):
    rows = copies(random.Random(11))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = owners.find_owners(df, keep="largest", trie_bytes=300).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_owners(rows, True)


def test_trie_holds_and_spills():
    rng, trie, want = random.Random(12), owners.Trie(), {}
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(500)]
    gone = {}
    for n, t in enumerate(texts):
        want[t] = min(want.get(t, n), n)
        if not trie.add(t, (n, 1, 1)):
            gone[t] = min(gone.get(t, n), n)
        if n in (200, 350):
            before = trie.size
            for t2, h in trie.spill():
                gone[t2] = min(gone.get(t2, h[0]), h[0])
            assert trie.size < before
    held = {t: h[0] for t, h in trie.texts_below()}
    assert not held.keys() & gone.keys() and held | gone == want
    labels = []
    stack = [trie.root]
    while stack:
        node = stack.pop()
        labels.append(node.label)
        assert node is trie.root or node.held or node.gone or len(node.kids) != 1  # compressed
        stack += node.kids.values()
    assert sum(map(len, labels)) >= trie.size


def test_op12_returns_all_rows(spark, tmp_path):
    rows = copies(random.Random(13))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    out = queries.op12_exact_dedup(spark, write(df, tmp_path, "documents"))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == brute_owners(rows, True)


# Scans and the trie


def test_running_states_cross_partitions(spark):
    rng = random.Random(14)
    rows = [(g, i, rng.randrange(9)) for g, n in ((1, 3), (2, 2000), (3, 1), (4, 700), (5, 2)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, i long, x long").repartition(4)
    out = scans.running(df, "g", ["i"], 0, lambda r: r["x"], lambda a, b: a + b, "before long, now long", lambda r, before, now: (before, now))
    sums, want = defaultdict(int), {}
    for g, i, x in sorted(rows):
        want[g, i] = (sums[g], sums[g] + x)
        sums[g] += x
    assert {(r["g"], r["i"]): (r["before"], r["now"]) for r in out.collect()} == want
    assert not scans.running(df.limit(0), "g", ["i"], 0, lambda r: r["x"], lambda a, b: a + b, "now long", lambda r, before, now: (now,)).collect()


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        c0 = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(c0, [])[:h] + turns[c][h:])
    members = defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    kids = defaultdict(set)
    for s in members:
        if s:
            kids[s[:-1]].add(s)
    out = []
    for s, m in members.items():
        below = [x for x in members if x[: len(s)] == s]
        ends = ",".join(str(c) for c in sorted(m) if built[c] == s)
        out.append((
            min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), sum(not kids[x] for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def talk(rng):
    rows = [(None, 0, "user", "none"), (7, None, None, None), (7, None, "user", "x"), (7, 3, "user", "b"), (7, 3, "user", "a"), (7, 3, "user", "a"), (300, 1, "user", "é😀"), (-5, 0, "a", "b"), (-100, 0, "a", "c"), (-101, 2, "a", None)]
    heads = [("system", "s"), ("user", "hello"), ("assistant", "well"), ("user", "go on"), ("assistant", "ok"), ("user", "bye")]
    for c in (*range(0, 12), *range(100, 130), *range(205, 215), *range(400, 460, 7)):
        n = rng.randrange(9)
        k = rng.randrange(n + 1)
        said = [heads[i % 6] if i < k else (rng.choice("ua"), rng.choice(["p", "qq", "rrr"])) for i in range(n)]
        rows += [(c, t, *s) for t, s in enumerate(said)]
    rows += [(500 + c, t, *heads[t]) for c in range(60) for t in range(4)]
    return [*rows, *((600, t, "u", "long") for t in range(90))]


def test_op13_equals_brute_force(spark, tmp_path):
    rows = talk(random.Random(15))
    df = spark.createDataFrame(rows, TURN).withColumns({"depth": F.lit(1), "key": F.lit("k"), "at": F.lit(3), "head": F.lit(0)})
    out = queries.op13_prefix_trie(spark, write(df.repartition(4), tmp_path, "conversations"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert out.columns == cols
    got, want = sorted(map(tuple, out.collect()), key=str), brute_trie(rows)
    assert got == want
    assert not queries.op13_prefix_trie(spark, write(df.limit(0), tmp_path, "conversations")).collect()


def test_ids_of_a_node_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 7)
    ids = random.Random(16).sample(range(-500, 5000), 400)
    df = spark.createDataFrame([(b"a", i) for i in ids[:390]] + [(b"b", i) for i in ids[390:]], "key binary, conv_id long").repartition(3)
    got = {bytes(r["key"]): r["ends_sha256"] for r in prefixes._ends(df).collect()}
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    assert got == {b"a": sha(ids[:390]), b"b": sha(ids[390:])}


def test_heavy_paths_are_few(spark):
    rows = spark.createDataFrame(talk(random.Random(17)), TURN)
    nodes = prefixes.heavy_paths(prefixes._chain(prefixes.branched(prefixes.turn_rows(rows))))
    by = {r["key"]: r for r in map(lambda r: r.asDict(), nodes.collect())}
    n = max(r["n_convs"] for r in by.values())
    assert max(r["level"] for r in by.values()) <= n.bit_length()
    for r in by.values():
        if r["depth"]:
            up = by[r["parent_key"]]
            light = r["key"] == r["head"]
            assert r["level"] == up["level"] + light and (light or r["head"] == up["head"])
            assert not light or 2 * r["n_convs"] <= up["n_convs"]
