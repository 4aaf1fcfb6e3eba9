"""Retrieval in long form: (question_id, rank, chunk_id, score) rows.

Postings and statistics are tables; queries are a table too, so one plan
answers all of them. Queries are small against the corpus and are sent to it
only when their size is known to be small; else Spark shuffles both sides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import ship, spread
from ..storage import written
from .analytics import top_per_group

#: Rows and bytes up to which a query table is sent to every task.
SMALL_ROWS = 10_000
SMALL_BYTES = 8 << 20


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcasting if a count of its rows and bytes (as JSON)
    shows it to be small."""
    some = df.limit(SMALL_ROWS + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b"))
    rows, size = some.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if rows <= SMALL_ROWS and size <= SMALL_BYTES else df


def ranked(scored: DataFrame, k: int, query: str = "question_id", key: str = "chunk_id") -> DataFrame:
    return top_per_group(scored, [query], [F.desc("score"), key], k)


# Sparse


def postings(chunks: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """term, chunk_id, tf, doc_len: one row per term of a chunk."""
    t = chunks.select(F.col(key).alias("chunk_id"), T.tokens(content).alias("t"))
    e = t.select("chunk_id", F.size("t").alias("doc_len"), F.explode("t").alias("term"))
    return e.groupBy("term", "chunk_id", "doc_len").agg(F.count("*").alias("tf"))


def term_statistics(posts: DataFrame, chunks: DataFrame, content: str = "content", epsilon: float = 0.25) -> DataFrame:
    """term, idf; idf = ln(N - df + 0.5) - ln(df + 0.5), negative values
    replaced by epsilon times the mean idf. Also n_docs and avg_len."""
    n = chunks.agg(F.count("*").alias("n_docs"), F.avg(F.size(T.tokens(content))).alias("avg_len"))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(n)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean_idf")).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean)).select("term", "df", "n_docs", "avg_len", idf.alias("idf"))


def bm25(queries: DataFrame, posts: DataFrame, stats: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, keep: DataFrame | None = None) -> DataFrame:
    """queries: question_id, text. keep: chunk_ids that may be retrieved, the
    filter comes before the limit."""
    q = queries.select("question_id", F.explode(T.tokens("text")).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qn"))
    p = posts.join(keep.select("chunk_id"), "chunk_id", "left_semi") if keep is not None else posts
    j = p.join(small(q.join(stats, "term")), "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    s = j.groupBy("question_id", "chunk_id").agg(F.round(F.sum(part * F.col("qn")), 6).alias("score"))
    return ranked(s, k)


def bm25_scan(queries: DataFrame, chunks: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, key: str = "id", content: str = "content") -> DataFrame:
    """bm25 of all queries without an index, in two passes over the texts: one
    for the vocabulary, one for the postings of the queries' terms, the only
    ones that are moved. For many searches build a sparse.SparseIndex."""
    t = spread(chunks.select(F.col(key).alias("chunk_id"), F.col(content).alias("content"))).select("chunk_id", T.tokens("content").alias("t"))
    one = t.select(F.size("t").alias("doc_len"), F.posexplode(F.array_distinct("t")).alias("pos", "term"))
    words = one.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("pos") == 0, F.col("doc_len"))).alias("first"))
    words, n = written(words, "vocabulary"), chunks.count()
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    total, mean = words.agg(F.sum("first"), F.avg(raw)).first()
    idf = F.when(raw < 0, F.lit(epsilon * (mean or 0.0))).otherwise(raw)
    q = queries.select("question_id", F.explode(T.tokens("text")).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qn"))
    q = small(written(q.join(words, "term").select("question_id", "term", (idf * F.col("qn")).alias("weight")), "query-weights"))
    tf = t.select("chunk_id", F.size("t").alias("doc_len"), F.explode("t").alias("term")).join(small(q.select("term").distinct()), "term", "left_semi")
    tf = tf.groupBy("chunk_id", "term", "doc_len").agg(F.count("*").alias("tf"))
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.lit((total or 0) / max(1, n))))
    return ranked(tf.join(q, "term").groupBy("question_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score")), k)


def bm25_rerank(candidates: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """candidates: question_id, text, chunk_id, content; the statistics are
    those of each question's candidates."""
    w = Window.partitionBy("question_id")
    c = candidates.select("question_id", "chunk_id", T.tokens("text").alias("q"), T.tokens("content").alias("t"))
    c = c.withColumn("n", F.count("*").over(w)).withColumn("avg_len", F.avg(F.size("t")).over(w)).withColumn("len", F.size("t"))
    e = c.select("question_id", "chunk_id", "q", "n", "avg_len", "len", F.explode("t").alias("term"))
    tf = e.groupBy("question_id", "chunk_id", "q", "n", "avg_len", "len", "term").agg(F.count("*").alias("tf"))
    tf = tf.withColumn("df", F.count("*").over(Window.partitionBy("question_id", "term")))
    tf = tf.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    terms = tf.dropDuplicates(["question_id", "term"]).groupBy("question_id").agg(F.avg("raw").alias("mean_idf"))
    tf = tf.join(terms, "question_id")
    idf = F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean_idf")).otherwise(F.col("raw"))
    times = F.size(F.filter("q", lambda x: x == F.col("term")))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))) * times
    return ranked(tf.groupBy("question_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score")), k)


# Dense


def dense(queries: DataFrame, vectors: DataFrame, k: int, score: str = "cosine", keep: Column | None = None, filter_after: bool = False) -> DataFrame:
    """Exact top-k by "cosine", "distance" (1 - d / 2) or "dot".

    queries: question_id, qvec; vectors: chunk_id, vec and more. keep is a
    predicate on vectors, before the ranking or, with filter_after, on the
    2 * k first rows (which may leave fewer than k).
    """
    v = vectors.where(keep) if keep is not None and not filter_after else vectors
    own = queries.select("question_id", "qvec")
    q = small(own)
    if q is own:
        return dense_tiles(own, v, k, score) if not filter_after else _filtered(dense_tiles(own, v, 2 * k, score), v, keep, k)
    cos = T.dot(F.col("vec"), F.col("qvec")) if score == "dot" else T.cosine(F.col("vec"), F.col("qvec"))
    s = v.join(q).withColumn("score", F.round(T.distance_score(cos) if score == "distance" else cos, 6))
    if filter_after and keep is not None:
        s = ranked(s, 2 * k).where(keep).drop("rank")
    return ranked(s, k).select("question_id", "rank", "chunk_id", "score")


def _filtered(hits: DataFrame, vectors: DataFrame, keep: Column | None, k: int) -> DataFrame:
    j = hits.drop("rank").join(vectors, "chunk_id")
    return ranked(j.where(keep) if keep is not None else j, k).select("question_id", "rank", "chunk_id", "score")


#: Queries of a tile: its matrix and its partial results stay in memory.
TILE_QUERIES = 4096
TILE_VECTORS = 8192


def dense_tiles(queries: DataFrame, vectors: DataFrame, k: int, score: str = "cosine", tile: int = TILE_QUERIES) -> DataFrame:
    """dense for more queries than can be sent to every task: matrix products
    of tiles of queries with blocks of vectors.

    Queries are dealt into tiles of bounded size. A task gets a block of
    vectors once per tile (the join is on the tile, not on pairs), and hands on
    the k best of the block for each query.
    """
    n = queries.count()
    tiles = max(1, math.ceil(n / tile))
    at = F.pmod(F.xxhash64("question_id"), F.lit(tiles)).cast("int")
    q = written(queries.select("question_id", F.col("qvec").cast("array<double>").alias("qvec"), at.alias("tile")), "tile-queries")
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((queries, "question_id"), (vectors, "chunk_id"))}
    ship(queries.sparkSession)
    # Tiles as rows of one packed matrix, blocks of vectors likewise; both sides meet on the tile.
    packed_q = q.groupBy("tile").agg(F.collect_list(F.struct("question_id", "qvec")).alias("qs"))
    block = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, math.ceil(vectors.count() / TILE_VECTORS)))).cast("int")
    packed_v = vectors.select("chunk_id", F.col("vec").cast("array<double>").alias("vec"), block.alias("block")).groupBy("block").agg(F.collect_list(F.struct("chunk_id", "vec")).alias("vs"))
    pairs = packed_v.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).join(packed_q, "tile").select("qs", "vs")

    def best(batches):
        for b in batches:
            for i in range(len(b)):
                qs, vs = b.column("qs")[i].values, b.column("vs")[i].values
                x, y = (np.array(s.field(f).to_pylist(), float) for s, f in ((qs, "qvec"), (vs, "vec")))
                if score != "dot":
                    x, y = (m / np.where((z := np.sqrt((m * m).sum(1, keepdims=True))) == 0, 1, z) for m in (x, y))
                s = x @ y.T
                s = np.round((1 + s) / 2 if score == "distance" else s, 6)
                m = min(k, s.shape[1])
                ids = vs.field("chunk_id")
                order = np.argsort(pc.sort_indices(ids).to_numpy())  # ties go by id
                top = np.lexsort((np.broadcast_to(order, s.shape), -s), axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays(
                    [qs.field("question_id").take(pa.array(np.repeat(np.arange(len(x)), m))), ids.take(pa.array(top.ravel())), pa.array(np.take_along_axis(s, top, 1).ravel())], names=["question_id", "chunk_id", "score"]
                )

    found = pairs.mapInArrow(best, f"question_id {kinds['question_id']}, chunk_id {kinds['chunk_id']}, score double")
    return ranked(found, k).select("question_id", "rank", "chunk_id", "score")


def quantised_dense(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Scores from int8 vectors."""
    q = queries.select("question_id", F.transform(T.int8(F.col("qvec")), lambda x: x.cast("double")).alias("qvec"))
    v = vectors.select("chunk_id", F.transform(T.int8(F.col("vec")), lambda x: x.cast("double")).alias("vec"))
    return dense(q, v, k)


def sane_vectors(vectors: DataFrame) -> DataFrame:
    """Number of vectors, how many have no length, and the dimensions seen."""
    n = T.norm(F.col("vec"))
    return vectors.agg(F.count("*").alias("n"), F.count_if(n == 0).alias("n_zero"), F.min(F.size("vec")).alias("min_dim"), F.max(F.size("vec")).alias("max_dim"))


class IVF:
    """Inverted lists by k-means: vectors carry their centroid, queries visit
    the nprobe nearest. Approximate; recall() measures it."""

    def __init__(self, lists: int = 16, nprobe: int = 4, seed: int = 42):
        self.lists, self.nprobe, self.seed = lists, nprobe, seed

    def build(self, vectors: DataFrame) -> DataFrame:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        v = vectors.withColumn("features", array_to_vector(F.col("vec")))
        self.model = KMeans(k=self.lists, seed=self.seed).fit(v)
        self.centres = [[float(x) for x in c] for c in self.model.clusterCenters()]
        return self.model.transform(v).withColumnRenamed("prediction", "list_id").drop("features")

    def search(self, queries: DataFrame, listed: DataFrame, k: int) -> DataFrame:
        spark = queries.sparkSession
        c = spark.createDataFrame(list(enumerate(self.centres)), "list_id int, centre array<double>")
        near = queries.join(F.broadcast(c)).withColumn("score", T.cosine(F.col("qvec"), F.col("centre")))
        probe = ranked(near, self.nprobe, key="list_id").select("question_id", "qvec", "list_id")
        s = listed.join(small(probe), "list_id").withColumn("score", F.round(T.cosine(F.col("vec"), F.col("qvec")), 6))
        return ranked(s, k).select("question_id", "rank", "chunk_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    hit = exact.join(found.select("question_id", "chunk_id").distinct().withColumn("hit", F.lit(1.0)), ["question_id", "chunk_id"], "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


def max_sim(query_tokens: DataFrame, chunk_tokens: DataFrame, k: int) -> DataFrame:
    """Late interaction: per query token the best dot product, summed.
    query_tokens: question_id, qpos, qvec; chunk_tokens: chunk_id, vec."""
    s = chunk_tokens.join(small(query_tokens)).groupBy("question_id", "chunk_id", "qpos").agg(F.max(T.dot(F.col("vec"), F.col("qvec"))).alias("m"))
    return ranked(s.groupBy("question_id", "chunk_id").agg(F.round(F.sum("m"), 6).alias("score")), k)


def stub_embedding(c, dim: int = 32, seed: int = 7) -> Column:
    """Hashing-trick vector of a text's tokens, length one."""
    slots = F.transform(T.tokens(c), lambda t: F.pmod(F.xxhash64(F.lit(seed), t), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    n = T.norm(counts)
    return F.transform(counts, lambda x: F.when(n == 0, 0.0).otherwise(x / n))


# Fusion


def rrf(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion by union and sum; no outer join."""
    u = lists[0].select("question_id", "chunk_id", "rank")
    for x in lists[1:]:
        u = u.unionByName(x.select("question_id", "chunk_id", "rank"))
    s = u.groupBy("question_id", "chunk_id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"))
    return ranked(s, k)


def weighted(dense_list: DataFrame, sparse_list: DataFrame, k: int, w_dense: float = 0.7, w_sparse: float = 0.3) -> DataFrame:
    """Min-max normalised scores, weighted; a flat list counts 0.5."""
    total = w_dense + w_sparse
    parts = []
    for df, w in ((dense_list, w_dense / total), (sparse_list, w_sparse / total)):
        win = Window.partitionBy("question_id")
        lo, hi = F.min("score").over(win), F.max("score").over(win)
        n = F.when(hi == lo, 0.5).otherwise((F.col("score") - lo) / F.when(hi == lo, 1).otherwise(hi - lo))
        parts.append(df.select("question_id", "chunk_id", (n * w).alias("part")))
    s = parts[0].unionByName(parts[1]).groupBy("question_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return ranked(s, k)


def legacy_hybrid(dense_list: DataFrame, sparse_list: DataFrame, keep: DataFrame, k: int) -> DataFrame:
    """Limit before filter: the first 2 * k fused rows, then the filter."""
    return ranked(rrf([dense_list, sparse_list], 2 * k).join(keep.select("chunk_id"), "chunk_id", "left_semi").drop("rank"), k)


def cap_per_document(hits: DataFrame, docs: DataFrame, k: int, per: int) -> DataFrame:
    """At most per chunks of a document, then the first k. docs: chunk_id, doc_id."""
    j = hits.join(docs.select("chunk_id", "doc_id"), "chunk_id")
    few = top_per_group(j.drop("rank"), ["question_id", "doc_id"], [F.desc("score"), "chunk_id"], per, "__r").drop("__r")
    return ranked(few, k).select("question_id", "rank", "chunk_id", "doc_id", "score")


def cap_if_many(hits: DataFrame, docs: DataFrame, k: int, per: int = 3) -> DataFrame:
    """The cap only for questions with more than 2 * k chunks."""
    n = hits.withColumn("n", F.count("*").over(Window.partitionBy("question_id")))
    many, few = n.where(F.col("n") > 2 * k).drop("n"), n.where(F.col("n") <= 2 * k).drop("n")
    return cap_per_document(many, docs, k, per).drop("doc_id").unionByName(ranked(few.drop("rank"), k).select("question_id", "rank", "chunk_id", "score"))


def rank_scores(hits: DataFrame, constant: int = 60) -> DataFrame:
    """Order-preserving rerank: score 1 / (constant + rank), old score kept."""
    return hits.withColumn("original_score", F.col("score")).withColumn("score", F.round(1 / (constant + F.col("rank")), 9))


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """Rerank by any score column (a model's, or word overlap as a stand-in)."""
    s = hits.withColumn("original_score", F.col("score")).withColumn("score", F.round(score, 6)).drop("rank")
    return ranked(s, k)


def first_seen(hits: DataFrame, order: list[str]) -> DataFrame:
    """One row per question and chunk, the first in the order."""
    return top_per_group(hits, ["question_id", "chunk_id"], order, 1, "__r").drop("__r")


def best_seen(hits: DataFrame) -> DataFrame:
    return hits.groupBy("question_id", "chunk_id").agg(F.max("score").alias("score"))


# Graph


ENTITY = r"\b[A-Z][\p{L}]+(?: [A-Z][\p{L}]+)*"


def entities(chunks: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """entity, chunk_id: capitalised phrases, once per chunk."""
    return chunks.select(F.col(key).alias("chunk_id"), F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(ENTITY), F.lit(0)))).alias("entity"))


def entity_edges(mentions: DataFrame, most: int | None = None) -> DataFrame:
    """src, dst, weight: entities that share a chunk, both directions. With
    most, only so many entities of a chunk, by name, are paired."""
    m = top_per_group(mentions, ["chunk_id"], ["entity"], most, "__r").drop("__r") if most else mentions
    a, b = m.withColumnRenamed("entity", "src"), m.withColumnRenamed("entity", "dst")
    return a.join(b, "chunk_id").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


#: Entities whose sketches a task holds before it hands them on.
SKETCHED_ENTITIES = 20_000


def heavy_edges(mentions: DataFrame, degree: int, spare: int = 8) -> DataFrame:
    """src, dst, weight: of each entity at most `degree` neighbours, the
    heaviest ones, with exact weights.

    Pairs are counted where a chunk's entities are together and are never
    moved: a task keeps for every entity the counters of spare * degree
    neighbours (the least make room for others, as in frequent-item sketches),
    sketches add up, and only the neighbours that they name are counted over
    all chunks. Sure to be named is whatever shares more than 1 in
    spare * degree of the entity's pairs; with fewer neighbours than counters
    all of them are.
    """
    most = max(1, spare * degree)
    per = mentions.groupBy("chunk_id").agg(F.collect_set("entity").alias("es")).select("es")

    def run(batches):
        held: dict[str, dict[str, int]] = {}

        def out():
            rows = [(e, f, n) for e, c in held.items() for f, n in c.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["src", "dst", "n"])

        for b in batches:
            for es in b.column("es").to_pylist():
                for e in es:
                    c = held.setdefault(e, {})
                    for f in es:
                        if f is not e:
                            c[f] = c.get(f, 0) + 1
                    if len(c) > most:  # the same is taken from all, what is used up falls away
                        cut = sorted(c.values(), reverse=True)[most]
                        held[e] = {f: n - cut for f, n in c.items() if n > cut}
                if len(held) > SKETCHED_ENTITIES:
                    yield out()
        if held:
            yield out()

    ship(mentions.sparkSession)
    named = per.mapInArrow(run, "src string, dst string, n long").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    named = written(top_per_group(named, ["src"], [F.desc("n"), "dst"], most, "r").select("src", "dst"), "heavy-named")
    m = mentions.select("chunk_id", "entity").distinct()
    pairs = named.join(m.withColumnRenamed("entity", "src"), "src").join(m.withColumnRenamed("entity", "dst"), ["chunk_id", "dst"])
    exact = pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return top_per_group(exact, ["src"], [F.desc("weight"), "dst"], degree, "r").drop("r")


def graph_candidates(query_entities: DataFrame, edges: DataFrame, mentions: DataFrame, cap: int = 10) -> DataFrame:
    """question_id, chunk_id of the entities and their heaviest neighbours."""
    n = query_entities.withColumnRenamed("entity", "src").join(edges, "src")
    n = top_per_group(n, ["question_id", "src"], [F.desc("weight"), "dst"], cap, "__r").select("question_id", F.col("dst").alias("entity"))
    return query_entities.select("question_id", "entity").unionByName(n).distinct().join(mentions, "entity").select("question_id", "chunk_id").distinct()


def graph_retrieve(queries: DataFrame, query_entities: DataFrame, edges: DataFrame, mentions: DataFrame, vectors: DataFrame, k: int, fallback: DataFrame) -> DataFrame:
    """Candidates by cosine; questions without any take the fallback list."""
    c = graph_candidates(query_entities, edges, mentions).join(vectors, "chunk_id").join(small(queries), "question_id")
    got = ranked(c.withColumn("score", F.round(T.cosine(F.col("vec"), F.col("qvec")), 6)), k).select("question_id", "rank", "chunk_id", "score")
    rest = fallback.join(got.select("question_id").distinct(), "question_id", "left_anti").where(F.col("rank") <= k)
    return got.unionByName(rest.select("question_id", "rank", "chunk_id", "score"))


#: Terms of questions up to which page_index sends them all to every task; and
#: numbers, tokens and terms that a task holds while it does.
PAGE_TERMS = 1 << 15
PAGE_CELLS = 1 << 21
PAGE_TOKENS = 1 << 18
PAGE_KNOWN = 1 << 18


def page_index(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Documents by matched share and frequency of the query's terms, repeated
    ones as often as they occur, as substrings: 0.7 * matched / terms + 0.3 * min(occurrences / words, 1).

    Terms hold no white space, so their places lie inside tokens. A document's
    counts are made where it lies, and a task hands on what can be among its k
    best for each question; only documents of several chunks are moved. More
    than PAGE_TERMS terms of questions go by joins with the vocabulary."""
    q = queries.select("question_id", T.tokens("text").alias("terms")).where(F.size("terms") > 0)
    e = q.select("question_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("q")).groupBy("question_id", "n_terms", "q").agg(F.count("*").alias("qn"))
    t = spread(chunks.select(F.col("doc_id").alias("chunk_id"), "content")).select("chunk_id", T.tokens("content").alias("t"))
    asked = e.limit(PAGE_TERMS + 1).collect()
    if len(asked) > PAGE_TERMS:
        s = _page_join(e, t)
    elif asked:
        s = _page_counts(asked, t, k, e.schema["question_id"].dataType)
    else:
        s = e.join(t.limit(0)).select("question_id", "chunk_id", "n_terms", F.col("qn").alias("matched"), F.col("qn").alias("freq"), F.col("qn").alias("words"))
    score = 0.7 * F.col("matched") / F.col("n_terms") + 0.3 * F.least(F.col("freq") / F.greatest("words", F.lit(1)), F.lit(1.0))
    return ranked(s.select("question_id", "chunk_id", F.round(score, 6).alias("score")), k)


def _page_join(e: DataFrame, t: DataFrame) -> DataFrame:
    posts = written(t.select("chunk_id", F.explode("t").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf")), "page-postings")
    words = t.groupBy("chunk_id").agg(F.sum(F.size("t")).alias("words"))
    sought = small(e.select("q").distinct())
    held = F.contains("term", "q")
    times = ((F.length("term") - F.length(F.replace("term", F.col("q"), F.lit("")))) / F.length("q")).cast("int")
    vocabulary = posts.select("term").distinct().join(sought, held).select("term", "q", times.alias("times"))
    found = posts.join(vocabulary, "term").groupBy("chunk_id", "q").agg(F.sum(F.col("tf") * F.col("times")).alias("freq"))
    return found.join(e, "q").groupBy("question_id", "chunk_id", "n_terms").agg(F.sum("qn").alias("matched"), F.sum(F.col("freq") * F.col("qn")).alias("freq")).join(words, "chunk_id")


def _page_counts(asked: list, t: DataFrame, k: int, kind: DataType) -> DataFrame:
    """question_id, chunk_id, n_terms, matched, freq, words of what can be among
    the k best of a question. asked: rows question_id, n_terms, q, qn."""
    sizes = t.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id")
    several = written(sizes, "page-several")
    if not several.isEmpty():
        alone = t.join(several, "chunk_id", "left_anti")
        t = alone.unionByName(t.join(several, "chunk_id").groupBy("chunk_id").agg(F.flatten(F.collect_list("t")).alias("t")))
    terms = {q: i for i, q in enumerate(sorted({r["q"] for r in asked}))}
    rows = sorted(asked, key=lambda r: (str(r["question_id"]), r["n_terms"]))
    starts = [i for i, r in enumerate(rows) if not i or (rows[i - 1]["question_id"], rows[i - 1]["n_terms"]) != (r["question_id"], r["n_terms"])]
    ids, n_terms = [rows[i]["question_id"] for i in starts], np.array([rows[i]["n_terms"] for i in starts])
    own, qn = np.array([terms[r["q"]] for r in rows]), np.array([r["qn"] for r in rows], float)
    # What terms begin with, with the number of the term that it is, if any.
    begun = {q[:j]: -1 for q in terms for j in range(1, len(q))} | terms
    sought = list(terms)
    most = max(1, PAGE_CELLS // len(rows))
    id_type, key = to_arrow_type(kind), t.schema["chunk_id"].dataType.simpleString()

    def run(batches):
        known: dict[str, tuple] = {}

        def held(term: str) -> tuple:
            found = known.get(term)
            if found is None:
                inside, n = set(), len(term)
                for i in range(n):
                    for j in range(i + 1, n + 1):
                        index = begun.get(term[i:j])
                        if index is None:
                            break
                        if index >= 0:
                            inside.add(index)
                if len(known) >= PAGE_KNOWN:
                    known.clear()
                found = known[term] = list(inside), [term.count(sought[x]) for x in inside]
            return found

        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < len(b):
                before = ends[at - 1] if at else 0
                to = max(at + 1, min(at + most, int(np.searchsorted(ends, before + PAGE_TOKENS, side="right"))))
                n, words = to - at, sizes[at:to]
                flat = b.column("t").slice(at, n).flatten().dictionary_encode()
                codes, vocabulary = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()
                pair, tf = np.unique(np.repeat(np.arange(n), words) * max(1, len(vocabulary)) + codes, return_counts=True)
                doc, code = np.divmod(pair, max(1, len(vocabulary)))
                each = [held(x) for x in vocabulary]
                many = np.array([len(x[0]) for x in each], np.int64)
                first = np.cumsum(many) - many
                which, times = (np.array([v for x in each for v in x[i]], np.int64) for i in (0, 1))
                reps = many[code]
                place = np.repeat(first[code] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
                cell = np.repeat(doc, reps) * len(terms) + which[place]
                f = np.bincount(cell, np.repeat(tf, reps) * times[place], n * len(terms)).reshape(n, -1)[:, own]
                matched, freq = (np.add.reduceat(x * qn, starts, axis=1) for x in (f > 0, f))
                score = np.where(matched > 0, 0.7 * matched / n_terms + 0.3 * np.minimum(freq / np.maximum(words, 1)[:, None], 1), -1)
                # What rounds to the same score as the k-th may come before it.
                least = np.partition(score, n - k, axis=0)[n - k] - 2e-6 if n > k else np.zeros(len(ids))
                i, j = np.nonzero((score >= least) & (matched > 0))
                cols = [pa.array([ids[x] for x in j], id_type), b.column("chunk_id").slice(at, n).take(pa.array(i)), pa.array(n_terms[j].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x.astype(np.int64)) for x in (matched[i, j], freq[i, j], words[i])]], names=["question_id", "chunk_id", "n_terms", "matched", "freq", "words"])
                at = to

    ship(t.sparkSession)
    return t.mapInArrow(run, f"question_id {kind.simpleString()}, chunk_id {key}, n_terms int, matched long, freq long, words long")


# Trust, cache, memory


def retrieval_trust(hits: DataFrame) -> DataFrame:
    """Min-max of the scores within a question; a flat list divides by 1."""
    w = Window.partitionBy("question_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("trust", F.round((F.col("score") - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo), 4))


def composite_trust(hits: DataFrame, as_of, tiers: dict[str, float]) -> DataFrame:
    """hits with text, content, ingested_at, source_type: 0.4 retrieval, 0.2
    each of freshness, word overlap and provenance."""
    r = retrieval_trust(hits)
    t = 0.4 * F.col("trust") + 0.2 * T.freshness(F.col("ingested_at"), as_of) + 0.2 * T.overlap_share("text", "content") + 0.2 * T.provenance("source_type", tiers)
    return r.withColumn("trust", F.round(t, 4))


def judged_trust(hits: DataFrame, judged: DataFrame) -> DataFrame:
    """judged: question_id, scores (a model's array by rank, as JSON text);
    where an entry is missing, retrieval trust."""
    j = retrieval_trust(hits).join(judged.select("question_id", T.json_list("scores").alias("s")), "question_id", "left")
    return j.withColumn("trust", F.round(T.unit(F.coalesce(F.get("s", F.col("rank") - 1), F.col("trust"))), 4)).drop("s")


def entailment_trust(hits: DataFrame, logits: str = "logits") -> DataFrame:
    """Third class of a model's logits; without logits, retrieval trust."""
    r = retrieval_trust(hits)
    return r.withColumn("trust", F.round(F.coalesce(F.element_at(T.softmax(F.col(logits)), 3), F.col("trust")), 4))


def confidence_gate(trusted: DataFrame, threshold: float) -> DataFrame:
    """Mean trust of each question and whether it falls back."""
    g = trusted.groupBy("question_id").agg(F.round(F.avg(F.coalesce("trust", F.lit(0.0))), 4).alias("avg_trust"))
    return g.withColumn("action", F.when(F.col("avg_trust") < threshold, "fallback").otherwise("answer"))


def exact_cache(queries: DataFrame, cache: DataFrame, as_of) -> DataFrame:
    """queries: question_id, text, backend, top_k. cache: key, answer,
    expires_at. hit and answer of each query."""
    q = queries.withColumn("key", T.cache_key("text", "backend", F.col("top_k").cast("string")))
    c = cache.where(F.col("expires_at") > as_of).select("key", "answer")
    return q.join(c, "key", "left").withColumn("hit", F.col("answer").isNotNull())


def semantic_cache(queries: DataFrame, cache: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Best cached query of the same backend and top_k by cosine, if near."""
    c = cache.select(F.col("cache_id"), "backend", "top_k", F.col("vec").alias("cvec"))
    j = queries.join(small(c), ["backend", "top_k"]).withColumn("score", F.round(T.cosine(F.col("qvec"), F.col("cvec")), 6))
    return ranked(j, 1, key="cache_id").where(F.col("score") >= threshold).select("question_id", "cache_id", "score")


def last_turns(turns: DataFrame, most: int, session: str = "conv_id", seq: str = "turn") -> DataFrame:
    return top_per_group(turns, [session], [F.desc(seq)], most, "back")


def memory_context(turns: DataFrame, most: int, session: str = "conv_id", seq: str = "turn") -> DataFrame:
    """One row per session: its last turns as lines, oldest first."""
    g = last_turns(turns, most, session, seq).groupBy(session).agg(F.array_sort(F.collect_list(F.struct(seq, "role", "text"))).alias("t"))
    return g.select(session, F.array_join(F.transform("t", lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n").alias("context"))


def no_cache(queries: DataFrame) -> DataFrame:
    """The cache that never hits: every query is a miss."""
    return queries.withColumns({"hit": F.lit(False), "chunks": F.lit(None).cast("array<string>")})


def context_before(turns: DataFrame, most: int, session: str = "conv_id", seq: str = "turn") -> DataFrame:
    """One row per turn: the session's last turns before it as lines, oldest
    first; null for the first turn."""
    w = Window.partitionBy(session).orderBy(seq).rowsBetween(-most, -1)
    said = F.collect_list(F.concat_ws(": ", "role", "text")).over(w)
    return turns.select(session, seq, F.when(F.size(said) > 0, F.array_join(said, "\n")).alias("context"))


def relevant_turns(turns: DataFrame, query: DataFrame, k: int = 3, session: str = "conv_id", seq: str = "turn") -> DataFrame:
    """The k turns of a session nearest to its query (session, qvec); sessions
    without vectors take the last k."""
    j = turns.join(query, session).withColumn("score", F.coalesce(F.round(T.cosine(F.col("vec"), F.col("qvec")), 6), F.lit(-1.0)))
    return top_per_group(j, [session], [F.desc("score"), F.desc(seq)], k)


def route_by_size(docs: DataFrame, window: int = 100_000, large: int = 10_000_000) -> DataFrame:
    """Corpus size decides: whole in the prompt, retrieval, or recursive."""
    n = F.sum(F.size(T.tokens("content")))
    return docs.agg(n.alias("tokens")).withColumn("route", F.when(F.col("tokens") <= 0.8 * window, "cag").when(F.col("tokens") <= large, "rag").otherwise("rlm"))
