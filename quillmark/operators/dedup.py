"""Duplicate documents and questions."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship, spread
from ..storage import shuffles_removed, written
from .analytics import top_per_group


def normalise(docs: DataFrame) -> DataFrame:
    """Blank lines collapsed, with counts and a short version hash."""
    d = docs.withColumn("content", T.collapse_blank_lines("content"))
    return d.withColumns({"char_count": F.length("content"), "word_count": F.size(T.tokens("content")), "version": T.version8("content")})


def exact(docs: DataFrame, key: str = "id") -> DataFrame:
    """First document of each content."""
    d = docs.withColumn("__h", F.sha2("content", 256))
    return top_per_group(d, ["__h"], [key], 1, "__r").drop("__h", "__r")


#: Tokens of a block that come last in its order of tokens, as many documents
#: have them. They tell how fast the join is, not what it finds.
FREQUENT = 1 << 16


def similar_pairs(docs: DataFrame, threshold: float, key: str = "id", text: str = "content", block: list[str] | None = None) -> DataFrame:
    """Pairs a < b (within a block) with Jaccard of token sets at least the
    threshold, exactly. Equal sets of a block are one set until the end.
    Candidates share a token of both prefixes: with tokens in one order, sets
    that similar must meet in the first size - ceil(threshold * size) + 1, and
    have there what the rest cannot make up for. Texts stay where they are;
    hashes of the prefixes are moved, and the sets of candidates."""
    return _similar(docs, threshold, key, text, block or []).select("a", "b", "similarity")


def _similar(docs: DataFrame, threshold: float, key: str, text: str, block: list[str]) -> DataFrame:
    """similar_pairs with wa and wb, the numbers of tokens of both."""
    with shuffles_removed(docs.sparkSession):
        members, alike = _alike_sets(docs, threshold, key, text, block)
    x, y = (members.select(F.col("key").alias(c), F.col("wc").alias(f"w{c}"), F.col("node").alias(f"node{c}")) for c in "xy")
    across = alike.select(F.col("nodea").alias("nodex"), F.col("nodeb").alias("nodey"), "similarity").join(x, "nodex").join(y, "nodey")
    same = x.join(y.withColumnRenamed("nodey", "nodex"), "nodex").where("x < y").withColumn("similarity", F.lit(1.0))
    out = across.where("x <> y").select("x", "y", "wx", "wy", "similarity").unionByName(same.select("x", "y", "wx", "wy", "similarity").where(F.lit(threshold <= 1)))
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity", F.when(F.col("x") < F.col("y"), F.col("wx")).otherwise(F.col("wy")).alias("wa"), F.when(F.col("x") < F.col("y"), F.col("wy")).otherwise(F.col("wx")).alias("wb"))


def _alike_sets(docs: DataFrame, threshold: float, key: str, text: str, block: list[str]) -> tuple[DataFrame, DataFrame]:
    """key, wc, node (its set) of each text with tokens; and nodea, nodeb,
    similarity of different sets that are similar."""
    least = threshold - 5e-7  # what rounds to the threshold
    docs = docs.where(F.col(text).rlike(r"\S"))  # a filter on tokens would make them twice
    for c in block:
        docs = docs.where(F.col(c).isNotNull())
    own = F.sha2(F.to_json(F.array(F.lit(""), *[F.col(c).cast("string") for c in block])), 256)
    t = spread(docs.select(F.col(key).alias("key"), own.alias("block"), F.xxhash64(F.lit(3), *block).alias("seed"), F.col(text).alias("text"))).select("key", "block", "seed", T.tokens("text").alias("t"))
    d = t.select("key", "block", "seed", F.size("t").alias("wc"), F.sort_array(F.array_distinct("t")).alias("s"))
    # A set of a block: 128 bits of a digest; a token of a block: a hash.
    node = F.unhex(F.substring(F.sha2(F.concat_ws(" ", "block", F.array_join("s", " ")), 256), 1, 32))
    d = d.select("key", "wc", "s", node.alias("node"), F.transform("s", lambda x: F.xxhash64("seed", x)).alias("h"))
    often = d.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 2").orderBy(F.desc("c"), "h").limit(FREQUENT)
    often = np.array([r["h"] for r in often.collect()][::-1], np.int64)
    by = np.argsort(often)
    tokens, ranks = often[by], by + 1

    def prefixes(batches):
        for b in batches:
            n, out = pc.list_value_length(b.column("h")).to_numpy(zero_copy_only=False), []
            for x in b.column("h"):
                h = x.values.to_numpy(zero_copy_only=False)
                p = len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1
                rank = np.zeros(len(h), np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                    rank = np.where(tokens[at] == h, ranks[at], 0)
                out.append(h[np.lexsort((h, rank))[:p]])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("key", "wc", "node")], pa.array(n.astype(np.int32)), pa.array(out, pa.list_(pa.int64()))], names=["key", "wc", "node", "n", "first"])

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = written(d.select("key", "wc", "node", "h").mapInArrow(prefixes, f"key {kind}, wc int, node binary, n int, first array<long>"), "similar-rows")
    members = rows.select("key", "wc", "node")
    e = rows.dropDuplicates(["node"]).select("node", "n", F.size("first").alias("p"), F.explode("first").alias("h"))
    counts = e.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    index = written(e.hint("merge").join(counts, "h"), "similar-index")
    sides = [index.select("h", *[F.col(c).alias(c + x) for c in ("node", "n", "p")]) for x in "ab"]
    size = (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))
    both = sides[0].hint("merge").join(sides[1], "h").where((F.col("nodea") < F.col("nodeb")) & size)
    both = both.groupBy("nodea", "nodeb", "na", "nb", "pa", "pb").agg(F.count("*").alias("both"))
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - 1e-9)
    pairs = written(both.where(F.col("both") >= need - F.greatest(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))).select("nodea", "nodeb"), "similar-pairs")
    some = pairs.select(F.explode(F.array("nodea", "nodeb")).alias("node")).distinct().join(members.groupBy("node").agg(F.min("key").alias("key")), "node")
    sets = written(d.join(some, ["node", "key"], "left_semi").select("node", "s").dropDuplicates(["node"]), "similar-sets")
    left, right = (sets.select(F.col("node").alias(f"node{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    j = pairs.hint("merge").join(left, "nodea").hint("merge").join(right, "nodeb").select("nodea", "nodeb", F.round(T.jaccard(F.col("sa"), F.col("sb")), 6).alias("similarity"))
    return members, written(j.where(F.col("similarity") >= threshold), "similar-sets-alike")


def greedy_keep(docs: DataFrame, pairs: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """Documents that a greedy pass in ascending order keeps: a document goes
    if it is similar to one that was kept before it. Done in rounds: whoever
    has no undecided earlier neighbour is decided, until all are; only
    documents in pairs take part."""
    ends = pairs.select(F.col("a").alias(key)).unionByName(pairs.select(F.col("b").alias(key))).distinct()
    linked = docs.join(ends, key, "left_semi").select(key, F.struct(order if order is not None else F.col(key), F.col(key)).alias("pos"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pa, pb = linked.select(F.col(key).alias("a"), F.col("pos").alias("x")), linked.select(F.col(key).alias("b"), F.col("pos").alias("y"))
    edges = both.join(pa, "a").join(pb, "b").where("y < x").select(F.col("a").alias("later"), F.col("b").alias("earlier")).persist()
    state = linked.select(key).withColumn("kept", F.lit(None).cast("boolean"))
    for i in itertools.count(1):
        s = state.withColumnsRenamed({key: "earlier", "kept": "k"})
        near = edges.join(s, "earlier").groupBy(F.col("later").alias(key)).agg(F.bool_or(F.coalesce("k", F.lit(False))).alias("hit"), F.count_if(F.col("k").isNull()).alias("open"))
        new = state.join(near, key, "left")
        kept = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = new.select(key, kept.alias("kept"))
        state = state.checkpoint() if i % 8 == 0 and docs.sparkSession.sparkContext.getCheckpointDir() else state.persist()
        if not state.where("kept is null").limit(1).count():
            break
    gone = state.where("kept = false").select(key)
    return docs.join(gone, key, "left_anti")


def near_documents(docs: DataFrame, threshold: float = 0.85, band: float = 0.05, key: str = "id") -> DataFrame:
    """Near-duplicate pairs of the same source whose word counts differ by at
    most the band."""
    j = _similar(docs, threshold, key, "content", ["source_type"])
    near = F.abs(F.col("wa") - F.col("wb")) <= band * F.greatest("wa", "wb")
    return j.where(near & (F.col("similarity") > threshold)).select("a", "b", "similarity")
