"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint becomes sixteen counts, the set bits of each 4-bit
segment. The Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints, so a range join on a unit grid of the vectors
loses no link: two vectors at distance 2 or less share a grid point within one
unit step of both. Candidates from that join are held against the Manhattan
bound, then against the fingerprints themselves.

Grid points with many fingerprints are not paired off. Their fingerprints emit
the 65 values within one bit; two fingerprints are at most two bits apart
exactly if they share such a value, so linking each to the smallest holder of
the value gives the same components in linear space.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, settle, unsent
from .components import components
from .passages import word_hashes

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: Grid points with more fingerprints than this take the linear way.
PAIRED_CELL = 8
#: Fingerprints whose grid points one task makes.
TASK_FINGERPRINTS = 20_000


def fingerprint_bytes(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of UTF-8 text as a signed 64-bit integer; no words: 0."""
    parts = text.lower().split()  # bytes: A-Z only; splits on 0x20, 0x09-0x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    xx = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = np.array([xx(joined, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[: -words] + 1))
        spans = zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = np.fromiter((xx(joined[i:j], seed) for i, j in spans), np.uint64, len(parts) - words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        chunk = np.ascontiguousarray(hashes[at : at + 65536])
        bits = np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    on = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(on, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and ``fp`` (long). Null text counts as empty."""
    rows = df.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("__text"))
    schema = rows.drop("__text").schema.add("fp", "long")

    def run(batches):
        for batch in batches:
            out = [fingerprint_bytes(x) for x in batch.column("__text").to_pylist()]
            cols = [batch.column(k) for k in keep] + [pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "fp"])

    return map_arrow(rows, run, schema)


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def segment_counts(fp: Column) -> Column:
    """Set bits of each 4-bit segment, packed into the nibbles of a long."""

    def half(x: Column) -> Column:  # 32 bits in a long: nothing overflows
        pairs = x.bitwiseAND(_long(0x55555555)) + F.shiftright(x, 1).bitwiseAND(_long(0x55555555))
        return pairs.bitwiseAND(_long(0x33333333)) + F.shiftright(pairs, 2).bitwiseAND(_long(0x33333333))

    low, high = half(fp.bitwiseAND(_long(0xFFFFFFFF))), half(F.shiftrightunsigned(fp, 32))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _nibble(v: Column, i: int) -> Column:
    return F.shiftrightunsigned(v, 4 * i).bitwiseAND(F.lit(15).cast("long"))


def manhattan(v: Column, w: Column) -> Column:
    total = F.lit(0).cast("long")
    for i in range(16):
        total = total + F.abs(_nibble(v, i) - _nibble(w, i))
    return total


def _grid_points(v: Column) -> Column:
    points = [v]
    for i in range(16):
        step = _long(1 << (4 * i))
        points.append(F.when(_nibble(v, i) < 4, v + step))
        points.append(F.when(_nibble(v, i) > 0, v - step))
    return F.array_compact(F.array(*points))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect exactly
    those which a chain of links of at most MAX_BITS bits connects."""
    # The counts are a column of their own: named many times, worked out once.
    counted = fps.select("fp", segment_counts(F.col("fp")).alias("v"))
    cells = counted.select("fp", F.explode(_grid_points(F.col("v"))).alias("cell"))
    shared = cells.groupBy("cell").count().where("count > 1")
    held = settle(unsent(cells).join(shared, "cell").withColumn("v", segment_counts(F.col("fp"))), "simhash-cells")
    few = held.where(F.col("count") <= PAIRED_CELL)
    left = few.select("cell", F.col("fp").alias("a"), F.col("v").alias("va"))
    right = few.select("cell", F.col("fp").alias("b"), F.col("v").alias("vb"))
    near = (
        unsent(left).join(right, "cell")
        .where("a < b")
        .where(manhattan(F.col("va"), F.col("vb")) <= MAX_BITS)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        .select("a", "b")
    )
    many = held.where(F.col("count") > PAIRED_CELL).select("fp").distinct()
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(_long(1 << i)) for i in range(64)])
    values = many.select("fp", F.explode(ball).alias("value"))
    least = values.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = unsent(values).join(least, "value").where("a <> fp").select("a", F.col("fp").alias("b"))
    return near.unionByName(star)


def near_groups(df: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of df: key, keep columns, ``fp``, ``root`` (a fingerprint, the
    same for the rows of a component) and ``component_id``.

    component_id is the smallest key reachable over links of at most two
    differing bits, itself included. Null keys are never the smallest (a group
    of null keys only has a null component_id); repeated rows all return; an
    empty table gives an empty result.
    """
    rows = settle(fingerprints(df, text, (key, *keep)), "simhash-fp")
    fps = rows.groupBy("fp").agg(F.min(key).alias("low"), F.count("*").alias("n"))
    fps = settle(fps, "simhash-fps")
    # A fingerprint becomes 33 rows: few of them make a task's work.
    dealt = fps.select("fp").repartition(max(1, math.ceil(fps.count() / TASK_FINGERPRINTS)))
    comp = components(links(dealt), "a", "b")
    named = settle(fps.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-named")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = unsent(named.select("fp", "root")).join(lows, "root")
    return unsent(rows).join(ids, "fp")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df, exactly one of each near-duplicate group: the one of the
    smallest key, nulls last, of equal keys the one of the least text hash (null
    texts are empty). Groups go by row, so rows that repeat a key but not the
    text stay apart, and copies without a key go like any other. Columns of any
    names return as they came.
    """
    names = df.columns
    th = F.coalesce(F.xxhash64(F.lit(9), F.coalesce(F.col(text), F.lit(""))), F.lit(0).cast("long"))
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), th.alias("th"))
    held = near_groups(rows, "t", "k", ("th",)).groupBy("root", "k", "th").agg(F.count("*").alias("n"))
    best = held.groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "th", "n")).alias("b"))
    first = settle(best.select(F.col("b.k").alias("__k"), F.col("b.th").alias("__h"), F.col("b.n").alias("__n")), "simhash-first")
    kept = df.withColumn("__th", th).join(unsent(first), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__th") == F.col("__h")))
    several = kept.where("__n > 1").withColumn("__r", F.row_number().over(Window.partitionBy("__th", key).orderBy("__n"))).where("__r = 1")
    return kept.where("__n = 1").select(*names).unionByName(several.select(*names))


# Similar texts, beyond a few bits

SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Shingles in this many texts of a batch come late in the order of shingles,
#: and how many of them are told apart, a batch and in all. They tell how fast
#: the join is, not what it finds.
FREQUENT_TEXTS = 6
FREQUENT_BATCH = 16_384
FREQUENT = 65_536
#: Texts a Python worker takes out of an Arrow batch at once.
SLICE = 512
#: Bits of the map that keeps texts in place which no candidate needs (8 MiB at
#: most). They tell how many texts are moved, not what is found.
FILTER_BITS = 1 << 26
FILTER_LEAST = 1 << 15


def shingle_hashes(text: bytes, words: int = SIMILAR_WORDS) -> np.ndarray:
    """64-bit hashes of the word shingles; fewer words: of the whole sequence."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def sketch(h: np.ndarray) -> int:
    """SimHash of all shingles."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(np.ascontiguousarray(h[at : at + 4096]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(h)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _least(n, similarity: float):
    """Shingles that a set of n shares with any set as similar as that."""
    return np.ceil(similarity * n - 1e-9)


def _sketches(raw: DataFrame, words: int) -> DataFrame:
    """A row for each of raw (k, th, t): k, th, fp, d (digest of the set of
    shingles) and n (its size); and rows tok, c: shingles that many texts of a
    batch have."""
    names, kinds = ["k", "th", "fp", "d", "n", "tok", "c"], (pa.int64(),) * 7

    def run(batches):
        for batch in batches:
            sets = []
            for b in _slices([batch]):
                out = []
                for t in b.column("t").to_pylist():
                    h = shingle_hashes(t or b"", words)
                    s = np.unique(h)
                    sets.append(s)
                    out.append((sketch(h), xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63), len(s)))
                own = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("th"), *own, *[pa.nulls(len(out), pa.int64())] * 2], names=names)
            h, c = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
            most = np.flatnonzero(c >= FREQUENT_TEXTS)
            most = most[np.argsort(-c[most], kind="stable")[:FREQUENT_BATCH]]
            if len(most):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(most), t) for t in kinds[:5]], pa.array(h[most].view(np.int64)), pa.array(c[most].astype(np.int64))], names=names)

    return map_arrow(raw, run, "k long, th long, fp long, d long, n long, tok long, c long")


def _prefixes(raw: DataFrame, frequent: list[int], words: int, similarity: float) -> DataFrame:
    """d, n, p and the p first shingles of each set, in an order of all shingles:
    by hash, frequent ones (least first) after the others."""
    f = np.array(frequent, np.int64).view(np.uint64)
    by = np.argsort(f)
    held = raw.sparkSession.sparkContext.broadcast((f[by], by + 1))

    def run(batches):
        tokens, ranks = held.value
        for b in _slices(batches):
            ds, ns, first = [], [], []
            for t in b.column("t").to_pylist():
                s = np.unique(shingle_hashes(t or b"", words))
                ds.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
                ns.append(len(s))
                p = len(s) - int(_least(len(s), similarity)) + 1 if len(s) else 0
                if len(tokens) and len(s):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    rank = np.where(tokens[at] == s, ranks[at], 0)
                    if rank.any():
                        s = s[np.argsort(rank, kind="stable")]
                first.append(s[:p].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in first]))).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*first, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(ns, pa.int64()), own], names=["d", "n", "first"])

    return map_arrow(raw.select("t"), run, "d long, n long, first array<long>")


def _reach(n: str, m: str, p: str, q: str, similarity: float) -> Column:
    """Shingles that prefixes of p and q have in common, if sets of n and m are
    similar: what lies behind them is too little for the rest."""
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col(n) + F.col(m)) - 1e-9)
    return need - F.greatest(F.col(n) - F.col(p), F.col(m) - F.col(q))


def _fits(n: str, m: str, similarity: float) -> Column:
    """Whether sets of n and m can be similar at all."""
    return F.least(n, m) >= F.lit(similarity) * F.greatest(n, m) - 1e-9


def _alike(index: DataFrame, similarity: float) -> DataFrame:
    """Pairs of rows of index that have a shingle and fitting sizes."""
    sides = [index.select("h", *[F.col(c).alias(c + x) for c in index.columns if c != "h"]) for x in "ab"]
    return unsent(sides[0]).join(sides[1], "h").where((F.col("da") < F.col("db")) & _fits("na", "nb", similarity))


def prefix_index(prefixes: DataFrame) -> DataFrame:
    """d, n, p, hot, h, c: the shingles h that c > 1 sets have in their
    prefixes; hot: how many of a set's are in more than PAIRED_CELL."""
    one = settle(prefixes.dropDuplicates(["d"]).withColumn("p", F.size("first").cast("long")), "similar-first")
    rows = one.select("d", F.explode("first").alias("h"))
    counts = settle(rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "similar-counts")
    held = settle(unsent(rows).join(counts, "h"), "similar-held")
    hot = held.where(F.col("c") > PAIRED_CELL).groupBy("d").agg(F.count("*").alias("hot"))
    sizes = one.select("d", "n", "p").join(hot, "d", "left").select("d", "n", "p", F.coalesce("hot", F.lit(0)).alias("hot"))
    return settle(unsent(held).join(sizes, "d"), "similar-index")


def similar_candidates(nodes: DataFrame, index: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of sets d that may be similar: nodes: d, n, fp. Fingerprints
    within MAX_BITS by the grid join; sets with enough shingles of their
    prefixes in common, one of them at least in PAIRED_CELL prefixes or fewer;
    and the sets of a more frequent shingle with its first and last. What this
    leaves of the frequent ones is for across_candidates."""
    reps = settle(nodes.groupBy("fp").agg(F.min(F.struct("d", "n")).alias("c")).select("fp", "c.d", "c.n"), "similar-fps")
    dealt = reps.select("fp").repartition(max(1, math.ceil(reps.count() / TASK_FINGERPRINTS)))
    ends = [reps.select(F.col("fp").alias(x), F.col("d").alias(f"d{x}"), F.col("n").alias(f"n{x}")) for x in "ab"]
    pairs = links(dealt).join(ends[0], "a").join(ends[1], "b").select("da", "na", "db", "nb")
    pairs = pairs.unionByName(nodes.select("fp", F.col("d").alias("da"), F.col("n").alias("na")).join(ends[1].withColumnRenamed("b", "fp"), "fp").select("da", "na", "db", "nb"))
    pairs = pairs.where(_fits("na", "nb", similarity)).select("da", "db")
    few = _alike(index.where(F.col("c") <= PAIRED_CELL).drop("c"), similarity)
    few = few.groupBy(*[c + x for c in ("d", "n", "p", "hot") for x in "ab"]).agg(F.count("*").alias("both"))
    few = few.where(F.col("both") + F.least("hota", "hotb") >= _reach("na", "nb", "pa", "pb", similarity))
    many = index.where(F.col("c") > PAIRED_CELL).select("h", "d", "n", "p")
    ends = F.array(F.min(F.struct("d", "n", "p")), F.max(F.struct("d", "n", "p")))
    stars = many.groupBy("h").agg(ends.alias("ends")).select("h", F.explode(F.array_distinct("ends")).alias("e"))
    stars = stars.select("h", *[F.col(f"e.{c}").alias(f"{c}b") for c in ("d", "n", "p")])
    star = many.select("h", *[F.col(c).alias(f"{c}a") for c in ("d", "n", "p")]).join(stars, "h").where((F.col("da") != F.col("db")) & _fits("na", "nb", similarity))
    star = star.groupBy(*[c + x for c in ("d", "n", "p") for x in "ab"]).agg(F.count("*").alias("both")).where(F.col("both") >= _reach("na", "nb", "pa", "pb", similarity))
    pairs = pairs.unionByName(few.select("da", "db")).unionByName(star.select("da", "db"))
    return pairs.where("da <> db").select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b")).distinct()


def across_candidates(index: DataFrame, comp: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of sets that have shingles of more than PAIRED_CELL prefixes
    in common, enough of them to be similar, and are not in one component yet:
    comp: node, root. Shingles of one component only are left out."""
    many = index.where(F.col("c") > PAIRED_CELL).join(comp, F.col("d") == F.col("node"), "left")
    many = settle(many.select("h", "d", "n", "p", F.coalesce("root", "d").alias("root")), "similar-many")
    mixed = many.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    pairs = _alike(many.join(mixed, "h"), similarity).where("roota <> rootb")
    pairs = pairs.groupBy(*[c + x for c in ("d", "n", "p") for x in "ab"]).agg(F.count("*").alias("both"))
    # With a rarer shingle in common too, a pair was a candidate before.
    pairs = pairs.where(F.col("both") >= _reach("na", "nb", "pa", "pb", similarity))
    return pairs.select(F.col("da").alias("a"), F.col("db").alias("b"))


def perhaps_among(rows: DataFrame, hashed: str, wanted: DataFrame, by: str) -> DataFrame:
    """The rows whose long column hashed is among wanted's column by (of hashes,
    settled), and a few others: what follows moves these rows only. A bitmap of
    FILTER_BITS hashes at most is broadcast, 64 bits of it a hash while it lasts."""
    bits = min(FILTER_BITS, max(FILTER_LEAST, 64 << wanted.count().bit_length()))

    def place(c: str) -> Column:
        return F.pmod(F.col(c), F.lit(bits).cast("long"))

    full = F.bitmap_construct_agg(F.bitmap_bit_position(place(by))).alias("__map")
    maps = wanted.groupBy(F.bitmap_bucket_number(place(by)).alias("__bucket")).agg(full)
    j = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(hashed)) == F.col("__bucket"))
    at = F.bitmap_bit_position(place(hashed))
    byte = F.conv(F.hex(F.substring("__map", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return j.where(F.getbit(byte, at.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1).select(*rows.columns)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles have at least that Jaccard similarity.
    texts: d, t of the texts in pairs."""

    def sets(batches):
        for b in _slices(batches):
            out = [np.unique(shingle_hashes(t or b"", words)).tobytes() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(out, pa.binary())], names=["d", "s"])

    def compare(batches):
        for b in _slices(batches):
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                n, m = len(p), len(q)
                both = len(np.intersect1d(p, q, assume_unique=True)) if min(n, m) >= similarity * max(n, m) - 1e-9 else 0
                keep.append(both >= similarity * (n + m - both) - 1e-9 > 0)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    s = settle(map_arrow(texts, sets, "d long, s binary").dropDuplicates(["d"]), "similar-sets")
    sides = [s.select(F.col("d").alias(x), F.col("s").alias(f"s{x}")) for x in "ab"]
    return map_arrow(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb"), compare, "a long, b long")


def keep_similar(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df, exactly one of each group of similar texts: the one of
    the smallest key, nulls last, of equal keys the one of the least text hash.

    Texts are linked if the Jaccard similarity of their word shingles reaches
    similarity; a group is what links connect. Candidates come from SimHash of
    whole texts, joined within MAX_BITS through the popcount grid, and from an
    exact prefix join: two sets as similar as that share one of the first
    n - ceil(similarity * n) + 1 shingles of each, in any order of all
    shingles. Frequent shingles come last in it. Sets of a shingle that is in
    many prefixes are first held against two of them, then all those against
    each other that no links connect by then, so no link between groups is
    lost. Each candidate is checked on its shingles. Null texts are empty;
    texts without words are alike. Rows that repeat a key but not the text stay
    apart; of rows that repeat both one is kept. An empty table gives an empty
    result; columns of any names return as they came.
    """
    names = df.columns
    th = F.coalesce(F.xxhash64(F.lit(9), F.coalesce(F.col(text), F.lit(""))), F.lit(0).cast("long"))
    raw = df.select(F.col(key).cast("long").alias("k"), th.alias("th"), F.col(text).cast("binary").alias("t"))
    seen = settle(_sketches(raw, words), "similar-rows")
    rows = seen.where("d is not null").select("k", "th", "fp", "d", "n")
    frequent = seen.where("d is null").groupBy("tok").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "tok").limit(FREQUENT)
    frequent = [r["tok"] for r in frequent.collect()][::-1]
    index = prefix_index(_prefixes(raw, frequent, words, similarity))
    nodes = settle(rows.groupBy("d").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min(F.struct("th", "k")).alias("of")), "similar-nodes")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        some = pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct()
        some = settle(nodes.join(some, F.col("d") == F.col("x")).select("d", F.col("of.th").alias("h"), F.col("of.k").alias("of")), f"{name}-some")
        texts = perhaps_among(raw, "th", some, "h").join(some, (F.col("th") == F.col("h")) & F.col("k").eqNullSafe(F.col("of"))).select("d", "t")
        return settle(_verified(pairs, texts, words, similarity), f"{name}-links")

    found = verified(settle(similar_candidates(nodes, index, similarity), "similar-pairs"), "similar")
    comp = components(found, "a", "b")
    rest = settle(across_candidates(index, comp, similarity), "similar-across")
    if not rest.isEmpty():
        comp = components(found.unionByName(verified(rest, "similar-rest")), "a", "b")
    named = rows.join(comp, F.col("d") == F.col("node"), "left").select("th", "k", F.coalesce("root", "d").alias("root"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "th")).alias("b"))
    n = rows.groupBy("th", "k").agg(F.count("*").alias("__n"))
    first = best.select(F.col("b.k").alias("__k"), F.col("b.th").alias("__h"))
    first = settle(first.join(n, (F.col("__h") == F.col("th")) & F.col("__k").eqNullSafe(F.col("k"))).select("__k", "__h", "__n"), "similar-kept")
    kept = df.withColumn("__th", th).join(unsent(first), F.col(key).cast("long").eqNullSafe(F.col("__k")) & (F.col("__th") == F.col("__h")))
    several = kept.where("__n > 1").withColumn("__r", F.row_number().over(Window.partitionBy("__th", key).orderBy("__n"))).where("__r = 1")
    return kept.where("__n = 1").select(*names).unionByName(several.select(*names))
