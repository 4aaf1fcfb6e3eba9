"""Prefix trie of conversations by heavy-path decomposition.

A node is a distinct sequence of first turns. Sequences are known by a chained
hash: turn digests are the digits of a number modulo a 255-bit prime, so the
hash of a prefix composes from those of its parts and a conversation of any
length can be worked out in pieces.

Every node with children has one heavy child, the one of the most conversations
(ties: of the smallest conversation). Heavy children continue their parent's
path, every other one heads a path of its own; it has at most half of its
parent's conversations, so a walk from the root crosses logarithmically many
paths. Sums over subtrees: paths without lower paths are summed first and
attached to the nodes they hang from, then those above, one round a level; at
the end one running sum along each path from its lower end gives every node its
subtree's total.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle
from .scans import running

PRIME = 2**255 - 19
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest(), "big") % PRIME
ROOT = bytes(32)
#: Turns of a conversation's head that others may begin with.
MOST_SHARED = 5
#: Conversations whose ids make one piece of a node's list.
PIECE = 4096


def _chained(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """(turns, power of the base, hash) of a sequence and what follows it."""
    return a[0] + b[0], a[1] * b[1] % PRIME, (a[2] * b[1] + b[2]) % PRIME


def _key(state: tuple[int, int, int]) -> bytes:
    return state[2].to_bytes(32, "big")


def turn_rows(df: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text), chars (code points of text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"), 256))
    rows = df.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def branched(turns: DataFrame) -> DataFrame:
    """Conversations rebuilt: conv_id, part, at, digest, chars in the order of
    (part, at), with one row (0, 0) without a digest for each conversation.

    Conversation c begins with the first h turns of c - c % 100, and goes on
    with its own after its first h; h = crc32(decimal c) % 6.
    """
    placed = running(
        turns, "conv_id", [F.col("turn").asc_nulls_first(), "digest"], 0, lambda r: 1, lambda a, b: a + b, "at long", lambda r, before, now: (now,), "turn-places"
    ).drop("turn")
    placed = settle(placed, "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    ids = placed.select("conv_id").distinct()
    lead = ids.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("from"))
    heads = placed.where((F.col("conv_id") % 100 == 0) & (F.col("at") <= MOST_SHARED))
    first = heads.groupBy(F.col("conv_id").alias("from")).agg(F.array_sort(F.collect_list(F.struct("at", "digest", "chars"))).alias("turns"))
    taken = F.filter(F.coalesce("turns", F.expr("array()").cast("array<struct<at:long,digest:binary,chars:long>>")), lambda t: t["at"] <= F.col("h"))
    empty = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars")))
    begun = lead.join(first, "from", "left").select("conv_id", F.explode(F.concat(empty, taken)).alias("t")).select("conv_id", F.lit(0).alias("part"), "t.*")
    return begun.unionByName(placed.where(F.col("at") > h).select("conv_id", F.lit(1).alias("part"), "at", "digest", "chars"))


def _chain(rows: DataFrame) -> DataFrame:
    """conv_id, depth, key, chars of every prefix, the empty one included."""

    def element(r):
        return (0, 1, 0) if r["digest"] is None else (1, BASE, int.from_bytes(r["digest"], "big") % PRIME)

    out = running(rows, "conv_id", ["part", "at"], (0, 1, 0), element, _chained, "depth long, key binary", lambda r, before, now: (now[0], _key(now)), "prefixes")
    return out.select("conv_id", "depth", "key", "chars")


def _ends(last: DataFrame) -> DataFrame:
    """key, ends_sha256: digest of the ids that end at a node, in order.

    The ids are sorted by range and packed into pieces; a node's digest reads
    its pieces in order and holds one at a time.
    """

    def pack(batches):
        key, ids = None, []

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "low", "ids"])

        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (k != key or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield piece()

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            keys, out = [], []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    if sha:
                        keys.append(key), out.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "ends_sha256"])

    pieces = map_arrow(last.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"), pack, "key binary, low long, ids string")
    return map_arrow(pieces.repartition("key").sortWithinPartitions("key", "low"), digest, "key binary, ends_sha256 string")


def heavy_paths(prefixes: DataFrame) -> DataFrame:
    """One row per node: key, depth, conv_id, n_convs, n_children, own_saved,
    own_leaf, level (light edges above it), head (key of its path's first
    node), parent_key, parent_head, parent_conv_id (null at the root).

    prefixes: conv_id, depth, key, chars of every prefix of every conversation.
    """
    nodes = prefixes.groupBy("key").agg(F.min("conv_id").alias("low"), F.count("*").alias("n_convs"))
    # Both sides are read back, so that a join on a key of very many rows can be split.
    pairs = prefixes.join(settle(nodes, "trie-counts"), "key")
    # A node's row is the one of its smallest conversation; its parent's key is in the row before.
    seen = running(
        settle(pairs, "trie-rows"), "conv_id", ["depth"], None, lambda r: (r["key"], r["low"]), lambda a, b: b or a, "parent_key binary, parent_conv_id long",
        lambda r, before, now: before or (None, None), "trie-parents",
    )
    seen = settle(seen, "trie-seen")
    owned = seen.where(F.col("conv_id") == F.col("low"))
    best = F.struct("n_convs", (-F.col("low")).alias("low"), "key")
    kids = owned.where("depth > 0").groupBy("parent_key").agg(F.max(best)["key"].alias("heavy"), F.count("*").alias("n_children"))
    kids = settle(kids, "trie-children")
    marked = seen.join(kids.select(F.col("heavy").alias("key"), F.lit(False).alias("light")), "key", "left")
    marked = marked.withColumn("light", F.coalesce("light", F.lit(True)))

    def element(r):
        return (int(r["depth"] > 0), r["key"]) if r["light"] else (0, None)

    out = running(
        marked, "conv_id", ["depth"], (0, None), element, lambda a, b: (a[0] + b[0], b[1] or a[1]), "level long, head binary, parent_head binary",
        lambda r, before, now: (*now, before[1]), "trie-paths",
    )
    own = out.where(F.col("conv_id") == F.col("low")).join(kids.select(F.col("parent_key").alias("key"), "n_children"), "key", "left")
    n = F.coalesce("n_children", F.lit(0).cast("long"))
    return own.select(
        "key", "depth", "conv_id", "n_convs", n.alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own_saved"), (n == 0).cast("long").alias("own_leaf"),
        "level", "head", "parent_key", "parent_head", "parent_conv_id",
    )


def subtree_sums(nodes: DataFrame, values: dict[str, str]) -> DataFrame:
    """nodes (of heavy_paths, written) with one column more per entry of
    values, name -> column: the sum of the column over the node's subtree."""
    sums = [F.sum(c).alias(f"__{i}") for i, c in enumerate(values.values())]
    names = [f"__{i}" for i in range(len(values))]
    paths = nodes.groupBy("head").agg(F.first("level").alias("level"), *sums)
    hang = nodes.where("key = head").select("head", "parent_key", "parent_head")
    paths = settle(paths.join(hang, "head"), "paths")
    deepest = paths.agg(F.max("level")).first()[0] or 0
    below, attached = None, None
    for level in range(deepest, 0, -1):
        now = paths.where(F.col("level") == level)
        if below is not None:
            to = below.groupBy(F.col("parent_head").alias("to")).agg(*[F.sum(n).alias(f"more{n}") for n in names])
            now = now.join(to, F.col("head") == F.col("to"), "left").select("head", "parent_key", "parent_head", *[(F.col(n) + F.coalesce(f"more{n}", F.lit(0))).alias(n) for n in names])
        below = settle(now.groupBy("parent_key", "parent_head").agg(*[F.sum(n).alias(n) for n in names]), f"paths-{level}")
        attached = below if attached is None else attached.unionByName(below)
    full = nodes
    if attached is not None:
        full = full.join(attached.select(F.col("parent_key").alias("key"), *names), "key", "left")
    full = full.select(*nodes.columns, *[(F.col(c) + (F.coalesce(n, F.lit(0)) if attached is not None else 0)).cast("long").alias(n) for n, c in zip(names, values.values(), strict=True)])
    zero = (0,) * len(names)
    out = running(
        full, "head", [F.desc("depth")], zero, lambda r: tuple(r[n] for n in names), lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)),
        ", ".join(f"{v} long" for v in values), lambda r, before, now: now, "path-sums",
    )
    return out.drop(*names)


def branched_trie(df: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of df's rebuilt conversations (see
    branched): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    df: conv_id, turn, role, text. Null roles and texts are empty; a null turn
    comes first, turns of equal number go by the digest of role and text, equal
    rows are turns of their own. Rows without a conv_id are no conversation. An
    empty table has no nodes, not even a root. Other columns do not matter.
    """
    prefixes = settle(_chain(settle(branched(turn_rows(df)), "branched")), "trie-prefixes")
    nodes = settle(heavy_paths(prefixes), "trie-nodes")
    sums = subtree_sums(nodes, {"n_leaves": "own_leaf", "saved_tokens": "own_saved"})
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "key"))["key"].alias("key"))
    out = sums.join(_ends(last), "key", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
