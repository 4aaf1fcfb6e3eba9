"""Stored sparse index: BM25 over postings with block maxima.

Documents are dealt into blocks by a hash of their key, blocks into segments of
bounded size. A row of the postings holds a term's documents of one block, and
beside them the largest frequency and the shortest document in the block. Rows
lie in directories by term bucket and are sorted by term, so a search opens the
buckets of its terms only; a task builds one bucket of one segment, so a word
that every document has is spread over segments.

A search bounds the score of each block from the narrow columns, scores the
most promising blocks of each question exactly, and then only those blocks
whose bound reaches the k-th score found.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship, spread
from ..storage import remove, scratch_path, written
from .analytics import top_per_group
from .retrieval import ranked, small

BLOCK_DOCS = 64
SEGMENT_DOCS = 1 << 20
BUCKETS = 16
#: Blocks of a question that are scored before the others are bounded off.
FIRST_BLOCKS = 8
#: Scores are rounded to six places: bounds must exceed by that.
SLACK = 1e-6


def _schemas(key: str) -> dict[str, str]:
    return {
        "postings": f"bucket int, term string, block int, max_tf int, min_len int, n int, tokens long, docs array<struct<chunk_id:{key},tf:int,doc_len:int>>",
        "terms": "bucket int, term string, df long, tokens long, raw double",
    }


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of sorted tokens (bucket, term, block, chunk_id, doc_len), a row
    per term and block. What the last row of a batch belongs to waits for the
    next batch."""

    def differs(column) -> np.ndarray:
        return pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)

    def rows(b: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        doc = np.flatnonzero(np.concatenate(([True], new | differs(b.column("chunk_id")))))
        first = np.concatenate(([True], new))[doc]
        row = np.flatnonzero(first)
        tf, size = np.diff(np.append(doc, len(b))).astype(np.int32), b.column("doc_len").to_numpy()[doc]
        docs = pa.StructArray.from_arrays([b.column("chunk_id").take(pa.array(doc)), pa.array(tf), pa.array(size)], names=["chunk_id", "tf", "doc_len"])
        at = pa.array(doc[row])
        return pa.RecordBatch.from_arrays(
            [
                b.column("bucket").take(at), b.column("term").take(at), b.column("block").take(at), pa.array(np.maximum.reduceat(tf, row)), pa.array(np.minimum.reduceat(size, row)),
                pa.array(np.diff(np.append(row, len(doc))).astype(np.int32)), pa.array(np.add.reduceat(tf.astype(np.int64), row)), pa.ListArray.from_arrays(pa.array(np.append(row, len(doc)).astype(np.int32)), docs),
            ],
            names=["bucket", "term", "block", "max_tf", "min_len", "n", "tokens", "docs"],
        )

    waiting = None
    for b in batches:
        if not len(b):
            continue
        if waiting is not None:
            b = pa.Table.from_batches([waiting, b]).combine_chunks().to_batches()[0]
        new = differs(b.column("term")) | differs(b.column("block"))
        last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        if last:
            yield rows(b.slice(0, last), new[: last - 1])
        waiting = b.slice(last)
    if waiting is not None:
        yield rows(waiting, differs(waiting.column("term")) | differs(waiting.column("block")))


@dataclass
class SparseIndex:
    """An index on disk. path holds postings/, terms/ and, written last,
    manifest/."""

    spark: SparkSession
    path: str
    n_docs: int
    avg_len: float
    mean_idf: float
    buckets: int
    schemas: dict[str, str]

    @classmethod
    def build(cls, chunks: DataFrame, path: str, key: str = "id", content: str = "content", buckets: int = BUCKETS, block_docs: int = BLOCK_DOCS) -> SparseIndex:
        spark, n = chunks.sparkSession, chunks.count()
        blocks = max(1, math.ceil(n / block_docs))
        segments = max(1, math.ceil(n / SEGMENT_DOCS))
        t = spread(chunks.select(F.col(key).alias("chunk_id"), F.col(content).alias("content"))).select("chunk_id", T.tokens("content").alias("t"))
        block = F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")
        t = t.select("chunk_id", block.alias("block"), F.size("t").alias("doc_len"), F.explode("t").alias("term"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        t = t.select(bucket.alias("bucket"), (F.col("block") * segments / blocks).cast("int").alias("segment"), "term", "block", "chunk_id", "doc_len")
        # One shuffle: a task has whole buckets of a segment, in order.
        place = ["bucket", "segment", "term", "block", "chunk_id"]
        rows = t.repartition(buckets * segments, "bucket", "segment").sortWithinPartitions(*place).drop("segment")
        schemas = _schemas(rows.schema["chunk_id"].dataType.simpleString())
        ship(spark)
        rows.mapInArrow(packed, schemas["postings"]).write.partitionBy("bucket").parquet(f"{path}/postings")
        narrow = spark.read.schema(schemas["postings"]).parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.sum("tokens").alias("tokens"))
        narrow = narrow.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        narrow.write.partitionBy("bucket").parquet(f"{path}/terms")
        total, mean = spark.read.schema(schemas["terms"]).parquet(f"{path}/terms").agg(F.sum("tokens"), F.avg("raw")).first()
        held = {"n_docs": n, "avg_len": (total or 0) / max(1, n), "mean_idf": mean or 0.0, "buckets": buckets, "schemas": schemas, "completed": True}
        spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.text(f"{path}/manifest")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SparseIndex:
        """An index without a manifest is not built: an error."""
        held = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        return cls(spark, path, held["n_docs"], held["avg_len"], held["mean_idf"], held["buckets"], held["schemas"])

    def read(self, table: str, buckets: list[int]) -> DataFrame:
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.path}/{table}").where(F.col("bucket").isin(buckets))

    def query_terms(self, queries: DataFrame, epsilon: float = 0.25) -> tuple[DataFrame, list[int]]:
        """question_id, bucket, term, weight (idf times occurrences), and the
        buckets that the terms lie in."""
        q = queries.select("question_id", F.explode(T.tokens("text")).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qn"))
        q = written(q.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")), "query-terms")
        buckets = [r[0] for r in q.select("bucket").distinct().collect()]
        # Negative values are replaced by a share of the mean, as elsewhere.
        idf = F.when(F.col("raw") < 0, F.lit(epsilon * self.mean_idf)).otherwise(F.col("raw"))
        terms = self.read("terms", buckets).select("term", idf.alias("idf"))
        q = q.join(terms, "term").select("question_id", "bucket", "term", (F.col("idf") * F.col("qn")).alias("weight"))
        return written(q, "query-weights"), buckets

    def search(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, keep: DataFrame | None = None) -> DataFrame:
        """question_id, rank, chunk_id, score of the k best; keep: chunk_ids
        that may be retrieved."""
        return self._search(queries, k, k1, b, keep)[0]

    def pruned(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """Pairs of question and block: all, and those scored exactly."""
        _, bounds, scored = self._search(queries, k, k1, b, None)
        return bounds.agg(F.count("*").alias("pairs")).join(scored.agg(F.count("*").alias("scored")))

    def _search(self, queries, k, k1, b, keep):
        def gain(tf, size):
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / self.avg_len))

        q, buckets = self.query_terms(queries)
        posts = self.read("postings", buckets)
        sent = small(q.drop("bucket"))

        def scores(pairs: DataFrame) -> DataFrame:
            rows = posts.join(sent, "term").join(small(pairs), ["question_id", "block"], "left_semi")
            rows = rows.select("question_id", "weight", F.inline("docs"))
            s = rows.select("question_id", "chunk_id", (F.col("weight") * gain(F.col("tf"), F.col("doc_len"))).alias("part"))
            if keep is not None:
                s = s.join(keep.select("chunk_id"), "chunk_id", "left_semi")
            return s.groupBy("question_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))

        most = posts.select("term", "block", "max_tf", "min_len").join(sent, "term")
        bound = F.sum(F.greatest(F.col("weight"), F.lit(0.0)) * gain(F.col("max_tf"), F.col("min_len"))).alias("bound")
        bounds = written(most.groupBy("question_id", "block").agg(bound), "block-bounds")
        first = top_per_group(bounds, ["question_id"], [F.desc("bound"), "block"], FIRST_BLOCKS, "r").select("question_id", "block")
        first = written(first, "first-blocks")
        got = written(ranked(scores(first), k), "first-hits")
        reach = got.where(F.col("rank") == k).select("question_id", F.col("score").alias("least"))
        rest = bounds.join(reach, "question_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
        rest = written(rest.select("question_id", "block").join(first, ["question_id", "block"], "left_anti"), "live-blocks")
        every = got.drop("rank").unionByName(scores(rest))
        return ranked(every, k), bounds, first.unionByName(rest)


def search_once(chunks: DataFrame, queries: DataFrame, k: int, **more) -> DataFrame:
    """Builds an index, searches it and deletes it."""
    path = scratch_path(chunks.sparkSession, "sparse-index")
    out = written(SparseIndex.build(chunks, path).search(queries, k, **more), "hits")
    remove(chunks.sparkSession, path)
    return out
