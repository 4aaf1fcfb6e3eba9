"""Queries opN_<name> and the pipeline, each over its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, langid, lines, mixing, owners, packing, passages, pii, prefixes, runs, simhash, topk, warc
from .common import load


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(load(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "lines_total", "lines_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    held_out = F.coalesce(langid.fold() == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "lang_pred", "score", "bits_per_char", "rejected")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.learn(docs))
    base = {k: F.col(f"base_{k}") for k in pii.KINDS}
    every = {k: F.array_sort(F.concat(f"base_{k}", f"added_{k}")) if k in base else F.col(f"added_{k}") for k in pii.ALL_KINDS}
    added = [F.size(f"added_{k}").cast("long").alias(f"added_{k}") for k in pii.ALL_KINDS]
    return found.select(
        "doc_id",
        *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"),
        pii.joined(every).alias("spans"),
        sum((F.size(x) for x in every.values()), F.lit(0)).cast("long").alias("n_spans"),
        *added,
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return packing.pack_documents(docs, max_documents=packing.MAX_DOCUMENTS, max_attention=packing.MAX_ATTENTION)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(load(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(load(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(load(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def _repeating(key: int | None, words: list[bytes]) -> list[bytes]:
    """The words to search of a document: every tenth (by a hash of its id; not
    null ids) repeats a stretch from some word on."""
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.collapse_runs(load(spark, sf_dir, "documents"), edit=_repeating)
    # The longest run; of equal ones the first, then that of the least period.
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("m"), (-r["start"]).alias("a"), (-r["period"]).alias("q"))))
    lines_ = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = out.withColumn("top", top)
    m, q = F.col("top.m"), -F.col("top.q")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.a")).alias("start"),
        m.alias("length"),
        q.alias("period"),
        F.floor(F.lit(1000) * m / q).cast("long").alias("exponent_milli"),
        F.sha2(lines_.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owners.find_owners(load(spark, sf_dir, "documents"), keep="largest")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.branched_trie(load(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s
), c AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
    CAST(source_size * 2 AS DOUBLE) AS cap FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), f AS (
  SELECT arg_min(level, cap / w) AS lam FROM l WHERE cap >= level * w
), g AS (
  SELECT source, source_size, coalesce(least(cap, lam * w), cap) AS target FROM l, f
), k AS (
  SELECT source, h, doc_id, size, count(*) AS c FROM d GROUP BY ALL
), b AS (
  SELECT k.*, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS whole,
    coalesce(sum(k.size * k.c) OVER (PARTITION BY k.source ORDER BY h, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
), t AS (
  SELECT *, greatest(0, least(size * c, CAST(floor(target) AS BIGINT) - whole * source_size - before)) // c AS extra FROM b
)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(t.whole * d.size + t.extra AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source AND d.h = t.h AND d.doc_id IS NOT DISTINCT FROM t.doc_id AND d.size = t.size
"""

OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""

OP12_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

#: A CRC-32 is eight shifts a byte; a node is known by its whole sequence of turns.
OP13_SQL = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, c - c % 100 AS c0, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))) % 6 AS h
  FROM ids
), own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), built AS (
  SELECT crc.c, 0 AS part, o.i, o.role, o.text FROM crc JOIN own o ON o.c = crc.c0 AND o.i <= crc.h
  UNION ALL
  SELECT crc.c, 1 AS part, o.i, o.role, o.text FROM crc JOIN own o ON o.c = crc.c AND o.i > crc.h
), pos AS (
  SELECT c, row_number() OVER w AS d, text,
    sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, ',') OVER w) AS k
  FROM built WINDOW w AS (PARTITION BY c ORDER BY part, i)
), p AS (
  SELECT c, d, k, length(text) AS chars FROM pos
  UNION ALL SELECT c, 0, '', 0 FROM crc
), n AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY d, k
), e AS (
  SELECT p.c, p.d, p.k, n.conv_id, n.n_convs, n.chars, lag(n.conv_id) OVER w AS up, lag(p.k) OVER w AS up_k, lead(p.d) OVER w IS NULL AS last
  FROM p JOIN n ON p.d = n.d AND p.k = n.k WINDOW w AS (PARTITION BY p.c ORDER BY p.d)
), kids AS (
  SELECT d - 1 AS d, up_k AS k, count(DISTINCT k) AS n_children FROM e WHERE d > 0 GROUP BY 1, 2
), s AS (
  SELECT e.*, sum(CASE WHEN e.c = e.conv_id THEN (e.n_convs - 1) * e.chars ELSE 0 END) OVER w AS saved,
    sum(CASE WHEN e.c = e.conv_id AND kids.n_children IS NULL THEN 1 ELSE 0 END) OVER w AS leaves, kids.n_children
  FROM e LEFT JOIN kids ON e.d = kids.d AND e.k = kids.k
  WINDOW w AS (PARTITION BY e.c ORDER BY e.d DESC)
)
SELECT min(conv_id) AS conv_id, CAST(d AS BIGINT) AS depth, min(up) AS parent_conv_id, count(*) AS n_convs,
  coalesce(min(n_children), 0) AS n_children, CAST(sum(leaves) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
FROM s GROUP BY d, k
"""


def queries() -> dict:
    ops = (
        op1_line_dedup, op2_language_id, op3_warc, op4_pii, op5_best_fit_packing, op6_exact_topk, op7_source_mix, op8_fingerprint, op9_substring_dedup, op10_simhash,
        op11_periodic_runs, op12_exact_dedup, op13_prefix_trie,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op6_exact_topk": OP6_SQL, "op7_source_mix": OP7_SQL, "op12_exact_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL}
