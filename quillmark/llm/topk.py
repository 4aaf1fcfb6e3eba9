"""Exact top-k inner products by block-at-a-time pruning.

Dimensions are the terms. Candidates are laid out so that near vectors are
near in order (nearest pivot, then halved by the widest term) and cut into
blocks, each with a forward index (its rows) and the greatest and least value
of every term. For a query, a block's bound is the sum over the terms of weight
times the greatest (for negative weights: least) value, or, where that is
less, what the block's centre and radius allow.

A query is first scored against the blocks beside its own place in the layout:
the k-th best there is its threshold. Bounds are taken from block summaries
alone; only blocks whose bound reaches the threshold of some query of a chunk
are sent to that chunk, and are scored in order of their bounds until those
fall below the k-th best score so far. So data without any structure costs
what comparing the query set with all rows in blocks costs; what is pruned
never moves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, settle, ship

K = 5
BLOCK = 64
#: Candidates per range of the layout, queries per chunk, blocks per shard.
RANGE_ROWS = 8192
CHUNK_QUERIES = 4096
SHARD_BLOCKS = 256
#: The pivots, and the rows that they are fitted on.
PIVOTS = 64
SAMPLE_ROWS = 4096
_EXACT = 1 << 53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, x as double; null for vectors that
    are null or hold null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("double"))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), out)


def halved(m: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """Row numbers of m in blocks of at most block rows: parts are halved at
    the median of their widest term; equal rows stay in order."""
    out, todo = [], [np.arange(len(m))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            if len(rows):
                out.append(rows)
            continue
        part = m[rows]
        wide = int(np.argmax(part.std(axis=0))) if m.shape[1] else 0
        order = np.argsort(part[:, wide], kind="stable") if m.shape[1] else np.arange(len(rows))
        half = -(-len(rows) // 2 // block) * block
        todo += [rows[np.sort(order[half:])], rows[np.sort(order[:half])]]
    return out


def _whole(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b as they are if products of their rows are exact in doubles,
    else as Python integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < _EXACT:
        return a, b
    return tuple(np.array([[int(x) for x in r] for r in z], object).reshape(z.shape) for z in (a, b))


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds of the products of each query with the rows of each block,
    a little above for the sake of rounding."""
    terms = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    ball = q @ centre.T + np.linalg.norm(q, axis=1)[:, None] * radius[None, :]
    widest = np.maximum(np.abs(high), np.abs(low)).max(axis=1, initial=0)
    return np.minimum(terms, ball) + 1 + 1e-9 * np.abs(q).sum(axis=1)[:, None] * widest[None, :]


class Best:
    """The k best rows of each query so far, as sorted (-score, id), and floor,
    the score that a row has to reach."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.floor = np.full(len(q_ids), -np.inf) if floor is None else floor
        self.rows: list[list[tuple[int, int]]] = [[] for _ in q_ids]

    def add(self, who: np.ndarray, ids: np.ndarray, m: np.ndarray) -> None:
        """Scores the rows (ids, m) of a block for the queries numbered who; a
        query's own id is left out."""
        q, m = _whole(self.q[who], m)
        scores = q @ m.T
        for j in np.flatnonzero((scores.max(axis=1, initial=-np.inf) if scores.dtype != object else scores.max(axis=1)) >= self.floor[who]).tolist():
            i, row = int(who[j]), scores[j]
            pick = np.flatnonzero(row >= self.floor[i])
            own, best = self.q_ids[i], self.rows[i]
            best += [(-int(row[p]), int(ids[p])) for p in pick.tolist() if ids[p] != own]
            best.sort()
            del best[self.k :]
            if len(best) == self.k:
                self.floor[i] = max(self.floor[i], float(np.nextafter(float(-best[-1][0]), -np.inf)) if -best[-1][0] >= _EXACT else -best[-1][0])


def search_blocks(best: Best, blocks: list[tuple[np.ndarray, np.ndarray]], top: np.ndarray) -> None:
    """Scores blocks (ids, rows) for each query in order of its bounds top
    (queries x blocks), the first, the next two, the next four and so on, until
    the bounds are below the query's floor."""
    order = np.argsort(-top, axis=1, kind="stable")
    done, step = 0, 1
    while done < len(blocks):
        now = order[:, done : done + step]
        live = np.take_along_axis(top, now, axis=1) >= best.floor[:, None]
        if not live.any():
            return
        for b in np.unique(now[live]).tolist():
            best.add(np.flatnonzero(((now == b) & live).any(axis=1)), *blocks[b])
        done, step = done + step, 2 * step


def _pivots(rows: DataFrame, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """By length of the vectors: directions fitted by a few rounds of means on
    at most sample rows, the least by a hash of the id."""
    held = rows.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(sample).select("v").collect()
    by: dict[int, list] = {}
    for r in held:
        by.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for dim, vs in by.items():
        x = np.array(vs, float).reshape(len(vs), dim)
        p = x[:: max(1, len(x) // pivots)][:pivots]
        for _ in range(5):
            near = np.argmin((p * p).sum(axis=1) - 2 * (x @ p.T), axis=1)
            p = np.array([x[near == i].mean(axis=0) if (near == i).any() else p[i] for i in range(len(p))])
        out[dim] = p[np.argsort(p @ p[0])] if dim else p
    return out


def _place(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds dim, pivot and near (distance from the pivot)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            col = batch.column("v")
            dims = col.value_lengths().to_numpy(zero_copy_only=False)
            pivot, near = np.zeros(n, np.int32), np.zeros(n)
            vs = col.to_pylist()
            for d in np.unique(dims).tolist():
                p = pivots.get(d)
                at = np.flatnonzero(dims == d)
                if p is None or not d:
                    continue
                x = np.array([vs[i] for i in at.tolist()], float)
                dist = (p * p).sum(axis=1) - 2 * (x @ p.T)
                pivot[at] = np.argmin(dist, axis=1)
                near[at] = dist.min(axis=1) + (x * x).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims.astype(np.int32)), pa.array(pivot), pa.array(near)], names=[*batch.schema.names, "dim", "pivot", "near"])

    return map_arrow(rows, run, "id long, v array<double>, asked boolean, dim int, pivot int, near double")


_LAID = "part int, block int, dim int, ids array<long>, data binary, high array<double>, low array<double>, centre array<double>, radius double, query long, v array<double>, score double"


def _summary(x: np.ndarray) -> tuple:
    centre = x.mean(axis=0)
    return x.max(axis=0), x.min(axis=0), centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))


def _range_rows(part: int, dim: int, held: list[tuple], k: int, block: int):
    """held: (id, vector, whether a query). Rows of _LAID: blocks, and queries
    with their threshold from the two blocks that look best."""
    rows = [h for h in held if not h[2]]
    ids, m = np.array([h[0] for h in rows], np.int64), np.array([h[1] for h in rows], float).reshape(len(rows), dim)
    cut = halved(m, block)
    ends = [_summary(m[r]) for r in cut]
    for n, (r, (high, low, centre, radius)) in enumerate(zip(cut, ends, strict=True)):
        data = np.ascontiguousarray(m[r], "<f8").tobytes()
        yield (part, n, dim, ids[r].tolist(), data, high.tolist(), low.tolist(), centre.tolist(), radius, None, None, None)
    asked = [h for h in held if h[2]]
    if not asked:
        return
    q_ids, q = np.array([h[0] for h in asked], np.int64), np.array([h[1] for h in asked], float).reshape(len(asked), dim)
    best = Best(q_ids, q, k)
    if cut:
        first = np.argsort(-(q @ np.array([e[2] for e in ends]).T), axis=1, kind="stable")[:, :2]
        for n in np.unique(first).tolist():
            best.add(np.flatnonzero((first == n).any(axis=1)), ids[cut[n]], m[cut[n]])
    for h, floor in zip(asked, best.floor.tolist(), strict=True):
        yield (part, None, dim, None, None, None, None, None, None, h[0], h[1], None if floor == -np.inf else floor)


def _lay_out(placed: DataFrame, k: int, block: int) -> DataFrame:
    vector = pa.list_(pa.float64())
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), vector, vector, vector, pa.float64(), pa.int64(), vector, pa.float64()]
    names = [x.split()[0] for x in _LAID.split(", ")]

    def run(batches):
        part, dim, held, base = TaskContext.get().partitionId(), None, [], 0

        def flush():
            rows = list(_range_rows(part, dim, held, k, block))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            cols[1] = pa.array([None if r[1] is None else r[1] + base for r in rows], pa.int32())
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            for d, i, v, asked in zip(*(batch.column(c).to_pylist() for c in ("dim", "id", "v", "asked")), strict=True):
                if held and (d != dim or len(held) >= 2 * RANGE_ROWS):
                    yield flush()
                    base, held = base + len(held), []
                dim = d
                held.append((i, v, asked))
        if held:
            yield flush()

    ranges = max(1, math.ceil(placed.count() / RANGE_ROWS))
    keys = ("dim", "pivot", "near", "id")
    dealt = placed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    return map_arrow(dealt, run, _LAID)


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.array(col.to_list(), float).reshape(len(col), dim)


def top_k(
    df: DataFrame, queries: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = K, factor: int = 256, block: int = BLOCK, report: dict | None = None
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: per query its k best rows, ties
    to the smaller id.

    Vectors that are null or hold null or non-finite components, and rows with
    a null key, take no part; vectors of another length than the query's are
    no candidates; no row of the query's own key is a candidate of it. Rows
    that repeat a key and vector are rows of their own, as candidates and in
    the result; repeated queries count once. Scores outside the range of a
    long are cut to it. Empty tables give no rows. Of the rows with equal
    vectors only the k + 1 smallest keys, and of a row at most k copies, can
    be among the best; the others are left out before the search. report, if
    given, gets pairs and survivors: the numbers of (query, block) pairs and
    of those not pruned.
    """
    ship(df.sparkSession)

    def clean(d: DataFrame) -> DataFrame:
        d = d.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), factor).alias("v"))
        return d.where("id is not null and v is not null")

    same = Window.partitionBy("v").orderBy("id")
    rows = clean(df).groupBy("id", "v").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    rows = settle(rows.select("id", "v", F.explode(F.array_repeat(F.lit(False), F.least("n", F.lit(k)).cast("int"))).alias("asked")), "topk-rows")
    both = rows.unionByName(clean(queries).distinct().withColumn("asked", F.lit(True)))
    laid = settle(_lay_out(settle(_place(both, _pivots(rows, PIVOTS, SAMPLE_ROWS)), "topk-placed"), k, block), "topk-laid")
    found = laid.agg(F.count("block"), F.count("query"), F.max("part")).first()
    shards, chunks = max(1, math.ceil(found[0] / SHARD_BLOCKS)), max(1, math.ceil(found[1] / CHUNK_QUERIES))
    name = F.concat_ws("-", "part", "block")
    blocks = laid.where("block is not null").withColumn("name", name).withColumn("shard", F.pmod(F.xxhash64(F.lit(2), "name"), F.lit(shards).cast("long")))
    # Near queries are in one chunk, so that they have their blocks in common.
    chunk = F.floor(F.col("part") * F.lit(chunks) / F.lit((found[2] or 0) + 1)).cast("long")
    asked = laid.where("query is not null").select(chunk.alias("chunk"), "query", "v", F.col("dim").alias("dim"), "score")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    ends = blocks.select("shard", "name", "dim", "high", "low", "centre", "radius")
    ends = ends.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def alive(a_all: pd.DataFrame, b_all: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, a in a_all.groupby("dim"):
            b = b_all[b_all["dim"] == dim]
            if len(b):
                top = bounds(_matrix(a["v"], dim), *(_matrix(b[c], dim) for c in ("high", "low", "centre")), b["radius"].to_numpy())
                live = (top >= a["score"].fillna(-np.inf).to_numpy()[:, None]).sum(axis=0)
                out += [(int(a["chunk"].iloc[0]), b["name"].iloc[j], int(live[j])) for j in np.flatnonzero(live).tolist()]
        return pd.DataFrame(out, columns=["chunk", "name", "live"])

    summed = asked.withColumn("shard", each).groupBy("chunk", "shard").cogroup(ends.groupBy("chunk", "shard"))
    left = settle(summed.applyInPandas(alive, "chunk long, name string, live long"), "topk-alive")
    if report is not None:
        per = asked.groupBy("dim").agg(F.count("*").alias("q")).join(blocks.groupBy("dim").agg(F.count("*").alias("b")), "dim")
        report |= {"pairs": per.agg(F.sum(F.col("q") * F.col("b"))).first()[0] or 0, "survivors": left.agg(F.sum("live")).first()[0] or 0}
    data = left.join(blocks.select("name", "shard", "dim", "ids", "data"), "name")
    met = settle(left.join(blocks.select("name", "shard"), "name").select("chunk", "shard").distinct(), "topk-met")

    def search(a: pd.DataFrame, b_all: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, qs in a.groupby("dim"):
            b = b_all[b_all["dim"] == dim].sort_values("name")
            if not len(b):
                continue
            held = [(np.asarray(ids), np.frombuffer(raw, "<f8").reshape(len(ids), dim)) for ids, raw in zip(b["ids"], b["data"], strict=True)]
            best = Best(qs["query"].to_numpy(), _matrix(qs["v"], dim), k, qs["score"].fillna(-np.inf).to_numpy().copy())
            ends = [np.array(x) for x in zip(*(_summary(m) for _, m in held), strict=True)]
            search_blocks(best, held, bounds(best.q, *ends))
            out += [(int(i), v, max(_LEAST, min(_MOST, -s))) for i, own in zip(best.q_ids, best.rows, strict=True) for s, v in own]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    sent = asked.join(met, "chunk")
    hits = sent.groupBy("chunk", "shard").cogroup(data.groupBy("chunk", "shard")).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
