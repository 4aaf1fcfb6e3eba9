"""Protocols for what is not relational: generators, embedders, rerankers.

Each takes and returns DataFrames, so that an implementation chooses its own
batching; the offline defaults replay tables or compute a stand-in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R


class Generator(Protocol):
    def generate(self, prompts: DataFrame) -> DataFrame:
        """prompts: question_id, prompt. Adds answer, input_tokens and
        output_tokens."""


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class Reranker(Protocol):
    def rerank(self, hits: DataFrame, k: int) -> DataFrame: ...


@dataclass(frozen=True)
class Replay:
    """Answers from a table (question_id, answer); questions without one get an
    empty answer."""

    answers: DataFrame

    def generate(self, prompts: DataFrame) -> DataFrame:
        j = prompts.join(self.answers.select("question_id", "answer"), "question_id", "left")
        j = j.withColumn("answer", F.coalesce("answer", F.lit("")))
        return j.withColumns({"input_tokens": T.approx_tokens("prompt"), "output_tokens": F.when(F.col("answer") == "", 0).otherwise(T.approx_tokens("answer"))})


@dataclass(frozen=True)
class Extract:
    """Stand-in that answers with the first sentence of the context."""

    def generate(self, prompts: DataFrame) -> DataFrame:
        a = F.coalesce(F.try_element_at(T.sentences(F.regexp_extract("prompt", r"(?s)Context:\n(.*?)\nQuestion:", 1)), F.lit(1)), F.lit(""))
        return prompts.withColumn("answer", a).withColumns({"input_tokens": T.approx_tokens("prompt"), "output_tokens": T.approx_tokens("answer")})


@dataclass(frozen=True)
class StubEmbedder:
    dim: int = 32

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, R.stub_embedding(text, self.dim))


@dataclass(frozen=True)
class Overlap:
    """Share of the query's words that a chunk has, in a model's place."""

    def rerank(self, hits: DataFrame, k: int) -> DataFrame:
        return R.rerank(hits, T.overlap_share("text", "content"), k)


class Bm25Rerank:
    def rerank(self, hits: DataFrame, k: int) -> DataFrame:
        return R.bm25_rerank(hits, k)


class RankScores:
    def rerank(self, hits: DataFrame, k: int) -> DataFrame:
        return R.rank_scores(hits).where(F.col("rank") <= k)


class Unchanged:
    def rerank(self, hits: DataFrame, k: int) -> DataFrame:
        return hits.where(F.col("rank") <= k)


REGISTRY: dict[str, dict[str, Callable]] = {
    "reranker": {"none": Unchanged, "bm25": Bm25Rerank, "reciprocal_rank": RankScores, "cross_encoder": Overlap, "monot5": Overlap},
    "embedder": {"stub": StubEmbedder},
    "generator": {"extract": Extract, "replay": Replay},
}


def make(slot: str, name: str, *args, **kw):
    try:
        return REGISTRY[slot][name](*args, **kw)
    except KeyError:
        raise ValueError(f"no {slot} named {name!r}; known: {sorted(REGISTRY.get(slot, {}))}") from None


def _dense(score: str, after: bool = False):
    def search(queries: DataFrame, tables: dict[str, DataFrame], k: int, keep=None) -> DataFrame:
        return R.dense(queries, tables["vectors"], k, score, keep, after)

    return search


def _sparse(queries: DataFrame, tables: dict[str, DataFrame], k: int, keep=None) -> DataFrame:
    allowed = tables["vectors"].where(keep) if keep is not None else None
    return R.bm25(queries, tables["postings"], tables["stats"], k, keep=allowed)


def _both(fuse):
    def search(queries: DataFrame, tables: dict[str, DataFrame], k: int, keep=None) -> DataFrame:
        return fuse(R.dense(queries, tables["vectors"], 3 * k, keep=keep), _sparse(queries, tables, 3 * k, keep), k)

    return search


#: What weaviate's own hybrid search gives vectors and words.
HYBRID_WEIGHTS = (0.75, 0.25)
#: Characters of a chunk that a vector store keeps, and stores that do not keep
#: a chunk's place in its document.
CONTENT_LIMITS = {"milvus": 65_000, "zilliz": 65_000, "pinecone": 40_000}
PLACELESS = ("milvus", "zilliz")


def store_search(name: str, queries: DataFrame, tables: dict[str, DataFrame], k: int, source_type: str | None = None) -> DataFrame:
    """Hits of a backend with the chunk as that store gives it back: content
    (cut at its limit), source_type, doc_id, chunk_index (0 where the store has
    none). A source type filters before the ranking, and where the backend
    over-fetches, after it. tables: as for INDEXES; chunks with chunk_id,
    doc_id, content, source_type, chunk_index. A missing score is 0."""
    keep = F.col("source_type") == source_type if source_type else None
    hits = INDEXES[name](queries, tables, k, keep).withColumn("score", F.coalesce("score", F.lit(0.0)))
    limit = CONTENT_LIMITS.get(name)
    content = F.substring("content", 1, limit) if limit else F.col("content")
    place = F.lit(0) if name in PLACELESS else F.coalesce(F.col("chunk_index").cast("int"), F.lit(0))
    held = tables["chunks"].select("chunk_id", "doc_id", content.alias("content"), "source_type", place.alias("chunk_index"))
    return hits.select("question_id", "rank", "chunk_id", "score").join(held, "chunk_id", "left").select("question_id", "rank", "chunk_id", "score", "doc_id", "content", "source_type", "chunk_index")


#: Index backends by name. queries: question_id, text, qvec; tables: vectors
#: (chunk_id, vec, source_type), postings, stats, chunks. The vector stores
#: differ in score and in whether the filter comes after the ranking.
INDEXES: dict[str, Callable] = {
    "bm25": _sparse, "chroma": _dense("distance"), "faiss": _dense("dot", after=True), "pgvector": _dense("cosine"), "milvus": _dense("cosine"),
    "zilliz": _dense("cosine"), "pinecone": _dense("cosine"), "weaviate": _both(lambda a, b, k: R.weighted(a, b, k, *HYBRID_WEIGHTS)), "qdrant": _dense("cosine"), "brute_dense": _dense("dot"),
    "hybrid_rrf": _both(lambda a, b, k: R.rrf([a, b], k)), "hybrid_weighted": _both(R.weighted),
    "hybrid": lambda q, t, k, keep=None: R.legacy_hybrid(R.dense(q, t["vectors"], 2 * k), _sparse(q, t, 2 * k), t["vectors"].where(keep) if keep is not None else t["vectors"], k),
    "pageindex": lambda q, t, k, keep=None: R.page_index(q, t["chunks"], k),
    "graph_rag": lambda q, t, k, keep=None: R.graph_retrieve(
        q, R.entities(q, "question_id", "text").withColumnRenamed("chunk_id", "question_id"), t["edges"], t["mentions"], t["vectors"], k, R.dense(q, t["vectors"], 3 * k)
    ),
    "colbert": lambda q, t, k, keep=None: R.max_sim(q.select("question_id", F.posexplode("qvecs").alias("qpos", "qvec")), t["token_vectors"], k),
}
