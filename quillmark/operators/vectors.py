"""Approximate vector indexes: product quantisation, a neighbour graph, and
candidates for late interaction.

Codebooks and centroids are learned from a bounded sample of vectors (a
parameter); every vector is indexed. Final scores are always exact cosines or
dot products of the stored vectors. Searches take a table of queries and answer
all of them in one plan, by joins on list, node or vector keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship
from ..storage import written
from .analytics import top_per_group
from .retrieval import ranked, small


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids of rows; empty clusters take far rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        at = d.argmin(1)
        n = np.bincount(at, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        far = np.argsort(-(d.min(1) + (x * x).sum(1)))
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], x[far[:k]])
    return c


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """chunk_id, vec of length one (zero vectors stay)."""
    n = F.col("n")
    held = vectors.select("chunk_id", F.col("vec").cast("array<double>").alias("vec"), T.norm(F.col("vec")).alias("n"))
    return held.select("chunk_id", F.transform("vec", lambda x: F.when(n == 0, x).otherwise(x / n)).alias("vec"))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def sampled(vectors: DataFrame, most: int, seed: int) -> DataFrame:
    """At most so many vectors, those of the least hashes of their ids."""
    return vectors.select("chunk_id", "vec").orderBy(F.xxhash64(F.lit(seed), "chunk_id"), "chunk_id").limit(most)


def _learn(rows: DataFrame, k: int, seed: int) -> dict[int, np.ndarray]:
    """part -> centroids of the vectors x of that part, one task a part. rows
    are of a bounded sample."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        c = lloyd(np.array(g["x"].tolist()), k, seed)
        return pd.DataFrame({"part": int(g["part"].iloc[0]), "c": [r.tolist() for r in c]})

    ship(rows.sparkSession)
    out: dict[int, list] = {}
    for r in rows.groupBy("part").applyInPandas(run, "part int, c array<double>").collect():
        out.setdefault(r["part"], []).append(r["c"])
    return {p: np.array(c) for p, c in out.items()}


def _sums(lut: str, codes: str, parts: int, size: int):
    total = F.lit(0.0)
    for j in range(parts):
        total = total + F.get(lut, F.get(codes, j) + j * size)
    return total


@dataclass
class ProductQuantised:
    """Inverted lists of product codes: a vector is its list's centroid plus,
    for each part of its dimensions, one of so many code words for the rest.
    Queries look scores up per code, and the best ones are scored exactly."""

    lists: int = 16
    nprobe: int = 12
    parts: int = 8
    words: int = 256
    refine: int = 20
    sample: int = 1 << 16
    seed: int = 42
    centres: np.ndarray = field(default=None, repr=False)
    books: list[np.ndarray] = field(default=None, repr=False)

    def build(self, vectors: DataFrame) -> DataFrame:
        """chunk_id, list_id, codes of every vector (chunk_id, vec)."""
        some = written(unit_vectors(sampled(vectors, self.sample, self.seed)).withColumnRenamed("vec", "x"), "pq-sample")
        self.centres = _learn(some.select(F.lit(0).alias("part"), "x"), self.lists, self.seed)[0]
        dim = self.centres.shape[1]
        cuts = np.linspace(0, dim, min(self.parts, dim) + 1).astype(int)
        self.cuts, centres = cuts, self.centres

        def rest(batches):
            for b in batches:
                x = _matrix(b.column("x"))
                r = x - centres[((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)]
                for j in range(len(cuts) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array([j] * len(r), pa.int32()), pa.array(r[:, cuts[j] : cuts[j + 1]].tolist(), pa.list_(pa.float64()))], names=["part", "x"])

        ship(vectors.sparkSession)
        found = _learn(some.select("x").mapInArrow(rest, "part int, x array<double>"), self.words, self.seed)
        self.books = books = [found[j] for j in range(len(cuts) - 1)]

        def encode(batches):
            for b in batches:
                x = unit_rows(_matrix(b.column("vec")))
                at = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
                r = x - centres[at]
                codes = np.stack([((c * c).sum(1) - 2 * r[:, cuts[j] : cuts[j + 1]] @ c.T).argmin(1) for j, c in enumerate(books)], axis=1)
                yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(at.astype(np.int32)), pa.array(codes.astype(np.int16).tolist(), pa.list_(pa.int16()))], names=["chunk_id", "list_id", "codes"])

        kind = vectors.schema["chunk_id"].dataType.simpleString()
        return vectors.select("chunk_id", "vec").mapInArrow(encode, f"chunk_id {kind}, list_id int, codes array<short>")

    def search(self, queries: DataFrame, codes: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
        """queries: question_id, qvec; codes as built; vectors: chunk_id, vec."""
        centres, books, cuts, size, nprobe = self.centres, self.books, self.cuts, max(map(len, self.books)), self.nprobe

        def tables(batches):
            for b in batches:
                q = unit_rows(_matrix(b.column("qvec")))
                s = q @ centres.T
                near = np.argsort(-s, axis=1)[:, :nprobe]
                lut = np.zeros((len(q), len(books), size))
                for j, c in enumerate(books):
                    lut[:, j, : len(c)] = q[:, cuts[j] : cuts[j + 1]] @ c.T
                probes = [[{"list_id": int(i), "base": float(s[r, i])} for i in near[r]] for r in range(len(q))]
                kind = pa.list_(pa.struct([("list_id", pa.int32()), ("base", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column("question_id"), pa.array(lut.reshape(len(q), -1).tolist(), pa.list_(pa.float64())), pa.array(probes, kind)], names=["question_id", "lut", "probes"])

        ship(queries.sparkSession)
        kind = queries.schema["question_id"].dataType.simpleString()
        t = queries.select("question_id", "qvec").mapInArrow(tables, f"question_id {kind}, lut array<double>, probes array<struct<list_id:int,base:double>>")
        probes = small(written(t.select("question_id", "lut", F.inline("probes")), "pq-probes"))
        s = codes.join(probes, "list_id").select("question_id", "chunk_id", (F.col("base") + _sums("lut", "codes", len(books), size)).alias("about"))
        short = top_per_group(s, ["question_id"], [F.desc("about"), "chunk_id"], self.refine * k, "r").select("question_id", "chunk_id")
        j = vectors.select("chunk_id", "vec").join(small(written(short, "pq-short")), "chunk_id").join(small(queries.select("question_id", "qvec")), "question_id")
        return ranked(j.select("question_id", "chunk_id", F.round(T.cosine(F.col("vec"), F.col("qvec")), 6).alias("score")), k)


@dataclass
class NeighbourGraph:
    """Graph of near vectors. It starts from blocks of vectors that lie next to
    each other along random directions, and improves in rounds: neighbours of
    one vector are held against each other. Every vector keeps `degree`
    neighbours and as many that name it, at most.

    A search walks all queries at once: each step opens the best unopened
    vectors of every query's beam and scores their neighbours."""

    degree: int = 16
    directions: int = 4
    block: int = 128
    rounds: int = 2
    beam: int = 96
    width: int = 12
    steps: int = 12
    entries: int = 32
    seed: int = 42

    def build(self, vectors: DataFrame) -> DataFrame:
        """src, dst, score (cosine)."""
        v = written(unit_vectors(vectors), "graph-vectors")
        degree, block = self.degree, self.block

        def blocks(batches):
            for part in batches:
                for a in range(0, len(part), block):
                    g = part.iloc[max(0, min(a, len(part) - block)) : a + block]
                    x, ids = np.array(g["vec"].tolist()), g["chunk_id"].to_numpy()
                    if len(g) < 2:
                        continue
                    s = x @ x.T
                    np.fill_diagonal(s, -2)
                    m = min(degree, len(g) - 1)
                    near = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    yield pd.DataFrame({"src": np.repeat(ids, m), "dst": ids[near.ravel()], "score": np.take_along_axis(s, near, 1).ravel()})

        ship(v.sparkSession)
        kind = vectors.schema["chunk_id"].dataType.simpleString()
        edges, dim = None, v.select(F.size("vec")).first()
        if dim is None:
            return v.select(F.col("chunk_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit(0.0).alias("score"))
        for i in range(self.directions):
            way = np.random.default_rng(self.seed + i).normal(size=dim[0]).tolist()
            at = T.dot(F.col("vec"), F.lit(way))
            found = v.withColumn("at", at).repartitionByRange("at", "chunk_id").sortWithinPartitions("at", "chunk_id").drop("at").mapInPandas(blocks, f"src {kind}, dst {kind}, score double")
            edges = found if edges is None else edges.unionByName(found)
        edges = self._best(edges)
        for _ in range(self.rounds):
            edges = self._best(edges.unionByName(self._joined(edges, v, kind)))
        return edges

    def _best(self, edges: DataFrame) -> DataFrame:
        one = edges.groupBy("src", "dst").agg(F.max("score").alias("score"))
        return written(top_per_group(one, ["src"], [F.desc("score"), "dst"], self.degree, "r").drop("r"), "graph-edges")

    def both_ways(self, edges: DataFrame) -> DataFrame:
        """Edges and, of those that lead to a vector, its `degree` best."""
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score")
        back = top_per_group(back, ["src"], [F.desc("score"), "dst"], self.degree, "r").drop("r")
        return edges.unionByName(back).groupBy("src", "dst").agg(F.max("score").alias("score"))

    def _joined(self, edges: DataFrame, v: DataFrame, kind: str) -> DataFrame:
        degree = self.degree
        held = self.both_ways(edges).join(v.select(F.col("chunk_id").alias("dst"), "vec"), "dst")
        groups = held.groupBy("src").agg(F.collect_list(F.struct("dst", "vec")).alias("n"))  # at most 2 * degree

        def run(batches):
            for b in batches:
                out = []
                for n in b.column("n").to_pylist():
                    ids, x = np.array([r["dst"] for r in n], dtype=object), np.array([r["vec"] for r in n])
                    if len(ids) < 2:
                        continue
                    s = x @ x.T
                    np.fill_diagonal(s, -2)
                    m = min(degree // 2, len(ids) - 1)
                    near = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    out.append((np.repeat(ids, m), ids[near.ravel()], np.take_along_axis(s, near, 1).ravel()))
                if out:
                    cols = [np.concatenate(c).tolist() for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.float64())], names=["src", "dst", "score"])

        return groups.select("n").mapInArrow(run, f"src {kind}, dst {kind}, score double")

    def search(self, queries: DataFrame, edges: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
        """queries: question_id, qvec; edges as built; vectors: chunk_id, vec."""
        q = written(queries.select("question_id", "qvec"), "graph-queries")
        graph = written(self.both_ways(edges).select(F.col("src").alias("chunk_id"), "dst"), "graph-both")
        v = vectors.select("chunk_id", "vec")

        def scored(pairs: DataFrame) -> DataFrame:
            j = v.join(pairs, "chunk_id").join(small(q), "question_id")
            return j.select("question_id", "chunk_id", T.cosine(F.col("vec"), F.col("qvec")).alias("score"))

        entries = [r[0] for r in sampled(vectors, self.entries, self.seed).select("chunk_id").collect()]
        kind = vectors.schema["chunk_id"].dataType
        start = q.select("question_id", F.explode(F.array(*[F.lit(e) for e in entries]).cast(f"array<{kind.simpleString()}>")).alias("chunk_id")) if entries else q.join(v.limit(0)).select("question_id", "chunk_id")
        beam = written(scored(start).withColumn("opened", F.lit(False)), "beam")
        for _ in range(self.steps):
            opens = top_per_group(beam.where("not opened"), ["question_id"], [F.desc("score"), "chunk_id"], self.width, "r").select("question_id", "chunk_id")
            opens = written(opens, "opened")
            if opens.isEmpty():
                break
            near = opens.join(graph, "chunk_id").select("question_id", F.col("dst").alias("chunk_id")).distinct()
            near = near.join(beam.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
            now = beam.join(opens.withColumn("now", F.lit(True)), ["question_id", "chunk_id"], "left")
            now = now.select("question_id", "chunk_id", "score", (F.col("opened") | F.coalesce("now", F.lit(False))).alias("opened"))
            every = now.unionByName(scored(near).withColumn("opened", F.lit(False)))
            beam = written(top_per_group(every, ["question_id"], [F.desc("score"), "chunk_id"], self.beam, "r").drop("r"), "beam")
        return ranked(beam.select("question_id", "chunk_id", F.round("score", 6).alias("score")), k)


@dataclass
class LateInteraction:
    """MaxSim over chunks that centroid lists propose: tokens lie in the list
    of their nearest centroid, a query token visits nprobe lists, and chunks
    are proposed by the sum over query tokens of the best centroid score.
    Proposed chunks are scored exactly; chunks without token vectors come from
    a sparse list, behind the others."""

    lists: int = 64
    nprobe: int = 32
    candidates: int = 160
    sample: int = 1 << 16
    seed: int = 42

    def build(self, chunk_tokens: DataFrame) -> DataFrame:
        """list_id, chunk_id pairs. chunk_tokens: chunk_id, vec, a row a token."""
        x = chunk_tokens.select(F.col("chunk_id").alias("id"), "vec").withColumn("chunk_id", F.xxhash64("id", F.to_json(F.struct("vec"))))
        some = written(sampled(x, self.sample, self.seed).select(F.lit(0).alias("part"), F.col("vec").cast("array<double>").alias("x")), "token-sample")
        self.centres = centres = _learn(some, self.lists, self.seed).get(0, np.zeros((1, 1)))
        kind = chunk_tokens.schema["chunk_id"].dataType.simpleString()

        def assign(batches):
            for b in batches:
                x = _matrix(b.column("vec"))
                yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1).astype(np.int32))], names=["chunk_id", "list_id"])

        return chunk_tokens.select("chunk_id", "vec").mapInArrow(assign, f"chunk_id {kind}, list_id int").distinct()

    def search(self, query_tokens: DataFrame, listed: DataFrame, chunk_tokens: DataFrame, k: int, fallback: DataFrame | None = None) -> DataFrame:
        """query_tokens: question_id, qpos, qvec. fallback: hits (question_id,
        rank, chunk_id, score) of a sparse search."""
        spark = query_tokens.sparkSession
        centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "list_id int, centre array<double>").agg(F.collect_list(F.struct("list_id", "centre")).alias("cs")).first()["cs"]
        lists = F.array(*[F.struct(F.lit(r["list_id"]).alias("list_id"), T.dot(F.col("qvec"), F.lit(r["centre"])).alias("s")) for r in centres])
        near = F.slice(F.array_sort(lists, lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).otherwise(a["list_id"] - b["list_id"])), 1, self.nprobe)
        probes = small(written(query_tokens.select("question_id", "qpos", F.inline(near)), "token-probes"))
        best = listed.join(probes, "list_id").groupBy("question_id", "chunk_id", "qpos").agg(F.max("s").alias("s"))
        about = best.groupBy("question_id", "chunk_id").agg(F.sum("s").alias("s"))
        proposed = written(top_per_group(about, ["question_id"], [F.desc("s"), "chunk_id"], self.candidates, "r").select("question_id", "chunk_id"), "proposed")
        j = chunk_tokens.join(small(proposed), "chunk_id").join(small(query_tokens), "question_id")
        m = j.groupBy("question_id", "chunk_id", "qpos").agg(F.max(T.dot(F.col("vec"), F.col("qvec"))).alias("m"))
        hits = ranked(m.groupBy("question_id", "chunk_id").agg(F.round(F.sum("m"), 6).alias("score")), k)
        if fallback is None:
            return hits
        bare = fallback.join(chunk_tokens.select("chunk_id").distinct(), "chunk_id", "left_anti")
        both = hits.withColumn("tier", F.lit(0)).unionByName(bare.withColumn("tier", F.lit(1)))
        return top_per_group(both.drop("rank"), ["question_id"], ["tier", F.desc("score"), "chunk_id"], k).select("question_id", "rank", "chunk_id", "score")
