"""The corpus pipeline against a brute-force version on a small table."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import mixing, packing

from .test_operators import DOC, brute_similar, brute_targets, prose


def table(rng):
    rows = []
    for i in range(80):
        lang = ("en", "fr")[i % 2]
        text = "\n".join(prose(rng, rng.randrange(30, 60)) for _ in range(3))
        if lang == "fr":
            text = text.replace("a", "é").replace("o", "ù")
        if i % 3 == 0:
            text += f"\nPrinted on page {i} by the owner"
        rows.append((i, text, lang, "ab"[i % 4 == 0], len(text)))
    for i in range(80, 84):
        rows.append((i, rows[i - 80][1], rows[i - 80][2], "c", rows[i - 80][4]))
    rows += [(90, None, None, "a", None), (91, "12 34", "en", "a", 5), (92, "", "fr", None, 0)]
    return rows


def brute(rows):
    """Documents after the filtering stages, mixed, cut into pieces."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    seen: dict[tuple, list] = {}
    for i, text, *_ in rows:
        for k, line in enumerate(text.split("\n")):
            t = tuple("<*>" if any(c.isdigit() for c in w) else w for w in line.split())
            if len(t) >= 3:
                seen.setdefault(t, []).append((i, k))
    gone = {p for v in seen.values() if len({i for i, _ in v}) >= 5 for p in sorted(v)[1:]}
    texts = {r[0]: "\n".join(x for k, x in enumerate(r[1].split("\n")) if (r[0], k) not in gone) for r in rows}
    ids = sorted(texts)
    stay = set(brute_similar([(i, texts[i]) for i in ids]))
    kept = [r for r in rows if r[0] in stay]
    size = {r[0]: len(texts[r[0]].split()) for r in kept}
    sources: dict = {}
    for r in kept:
        sources[r[3]] = sources.get(r[3], 0) + size[r[0]]
    goal = brute_targets(sources)
    out = []
    for s, total in sources.items():
        whole, rest = int(goal[s] // total), int(goal[s]) - int(goal[s] // total) * total
        place = lambda i: hashlib.md5(f"{mixing.SEED}:{i}:{hashlib.md5(texts[i].encode()).hexdigest()}".encode()).hexdigest()[:13]
        order = sorted((r[0] for r in kept if r[3] == s), key=lambda i: int(place(i), 16))
        for i in order:
            extra = max(0, min(size[i], rest))
            rest -= extra
            out += [(i, texts[i])] * (whole + (extra == size[i]))
            if 0 < extra < size[i]:
                words, at = texts[i].split(), 0
                for w in words[:extra]:
                    at = texts[i].index(w, at) + len(w)
                out.append((i, texts[i][:at]))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = table(random.Random(21))
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t in brute(rows):
        ids = [*tok.encode(t, add_special_tokens=False).ids, packing.END_ID]
        for p in range(0, len(ids), packing.MAX_TOKENS):
            part = np.array(ids[p : p + packing.MAX_TOKENS], "<u4")
            want.append((i, p // packing.MAX_TOKENS, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    df = spark.createDataFrame(table(random.Random(22)), DOC)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.schema.simpleString() == f"struct<{','.join(x.replace(' ', ':') for x in DOC.split(', '))}>".replace("long", "bigint")
    more = spark.createDataFrame(table(random.Random(22)), DOC).withColumns({"root": F.lit("x"), "h": F.lit(1), "__th": F.lit(2), "lk": F.lit(3)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide = stage(spark, more, str(tmp_path))
        assert wide.columns == more.columns and wide.where("root = 'x' and h = 1 and lk = 3").count() == wide.count() > 0
    empty = spark.createDataFrame([], DOC)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert not empty.collect()
        if "text" not in empty.columns:
            break
