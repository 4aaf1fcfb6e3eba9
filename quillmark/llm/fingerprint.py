"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph's vector has LANES counters: of the hashes of its shingles of
SHINGLE words (a shorter paragraph is one shingle), how many have the lane's
bit set; then WORDS words of 32 bits drawn from the SHA-512 digest of the whole
paragraph, and the number of shingles. Every lane is taken modulo 2**32, and a document's fingerprint is the
sum over its paragraphs. So equal multisets of paragraphs have equal
fingerprints in any order, and a paragraph is put in or taken out by adding or
subtracting its vector. With n shingles and c of them with a bit set, 2c - n is
a sum of random signs, one per shingle: dot products of two documents' sign
sums estimate how many shingles they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

LANES = 128
#: More than 16 make the generated aggregate too large to be compiled.
WORDS = 16
SHINGLE = 2
PARAGRAPH = r"\n"
#: Rows of documents per bucket when neighbours in order are sought, quantiles.
BUCKET_ROWS = 500
QUANTILES = 64
_BUCKETS = 1 << 31
_HASHES = ("__h", "__g")
_LOW = 0xFFFFFFFF
_PAIR = 0x0000000100000001  # two counters in one long


def _shingle_hashes(paragraph: Column) -> Column:
    words = F.split(paragraph, r"[\x20\x09-\x0D]+")
    words = F.filter(words, lambda w: w != "")
    short = F.array(F.xxhash64(F.lit(1), F.array_join(words, " ")))
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.xxhash64(F.lit(2), a, b))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < SHINGLE, short).otherwise(pairs)


def vectors(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and ``fp``, an array of longs below 2**32: LANES counters, WORDS
    words, the number of shingles. One row per different keys (rows that share
    keys add up); null texts are empty; a blank paragraph has no shingle."""
    rows = df.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), PARAGRAPH)).alias("__p"))
    hashed = rows.select(
        *keys, F.sha2(F.col("__p").cast("binary"), 512).alias("__d"), _shingle_hashes(F.col("__p")).alias("__s")
    )
    # The first row of a paragraph has no shingle: it stands for the paragraph.
    whole = hashed.select(*keys, "__d", F.explode(F.array_prepend("__s", F.lit(None).cast("long"))).alias("__h"))
    whole = whole.withColumn("__g", F.when(F.col("__h").isNotNull(), F.xxhash64(F.lit(3), "__h")))
    sums = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR))).alias(f"{h}{i}") for h in _HASHES for i in range(32)]
    first = F.col("__h").isNull()
    for i in range(WORDS // 2):
        d = F.xxhash64(F.lit(100 + i), "__d")
        sums += [F.sum(F.when(first, d.bitwiseAND(F.lit(_LOW)))).alias(f"__d{2 * i}"), F.sum(F.when(first, F.shiftrightunsigned(d, 32))).alias(f"__d{2 * i + 1}")]
    agg = whole.groupBy(*keys).agg(*sums, F.count("__h").alias("__n"))
    packed = [F.coalesce(F.col(f"{h}{i}"), F.lit(0).cast("long")) for h in _HASHES for i in range(32)]
    lanes = [x.bitwiseAND(F.lit(_LOW)) for x in packed] + [F.shiftrightunsigned(x, 32) for x in packed]
    lanes += [F.col(c).bitwiseAND(F.lit(_LOW)) for c in (f"__d{i}" for i in range(WORDS))]
    return agg.select(*keys, F.array(*lanes, F.col("__n").bitwiseAND(F.lit(_LOW))).alias("fp"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint after putting in (sign 1) or taking out (-1) the paragraphs
    of b."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y * F.lit(sign), F.lit(_LOW + 1)))


def _signs(fp: Column) -> Column:
    """Sign sums by lane."""
    n = F.element_at(fp, -1)
    return F.transform(F.slice(fp, 1, LANES), lambda x: x * 2 - n)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else twice the estimated shared part over the
    sum of both, between 0 and 1."""
    x, y = _signs(a), _signs(b)
    both = _dot(x, x) + _dot(y, y)
    value = F.when(both > 0, 2 * _dot(x, y) / both).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def digest(fp: Column) -> Column:
    """SHA-256 of the lanes, as hex: equal for equal fingerprints."""
    return F.sha2(F.array_join(fp.cast("array<string>"), ",").cast("binary"), 256)


def _bucket(df: DataFrame, key: str, th: str) -> Column:
    """Number of a row's bucket, monotone in (key, th): quantiles of all keys,
    each cut evenly; a key that holds a whole quantile, and null keys, are cut
    by the text hash th instead. Null keys come last in descending order, so
    they have the least numbers."""
    found = df.agg(
        F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"), F.min(key).alias("lo"), F.max(key).alias("hi"),
        F.percentile_approx(key, [i / QUANTILES for i in range(1, QUANTILES)], 10_000).alias("q"),
    ).first()
    share = (F.col(th) / F.lit(2.0**64)) + 0.5
    none = -(-(found["nulls"] or 0) // BUCKET_ROWS)
    lone = F.floor(share * F.lit(max(1, none))).cast("long") - F.lit(_BUCKETS)
    if found["lo"] is None:
        return lone
    q = found["q"] or []
    inner = max(1, -(-found["n"] // (BUCKET_ROWS * QUANTILES)))
    hot = {x: inner * (q.count(x) + 1) for x in q if q.count(x) > 1}
    edges = sorted({found["lo"], *q, *hot, *(x + 1 for x in hot), found["hi"] + 1})
    grid = F.array(*[F.lit(int(e)).cast("long") for e in edges])
    parts = F.array(*[F.lit(hot.get(e, inner)).cast("double") for e in edges])
    own = F.array(*[F.lit(e in hot) for e in edges])
    k = F.col(key)
    at = F.greatest(F.aggregate(grid, F.lit(0), lambda acc, e: acc + F.when(e <= k, 1).otherwise(0)), F.lit(1))
    lo, hi = F.element_at(grid, at), F.element_at(grid, F.least(at + 1, F.lit(len(edges))))
    within = F.when(F.element_at(own, at), share).otherwise((k - lo) / F.greatest(hi - lo, F.lit(1)))
    n = F.element_at(parts, at)
    sub = F.floor(F.least(within * n, n - 1)).cast("long")
    return F.when(k.isNull(), lone).otherwise(at.cast("long") * F.lit(_BUCKETS) + sub)


def with_next(df: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows b and rn (together unique), doc_id, text and next_text, the text of
    the following row in descending order of (key, text hash), nulls last;
    after the last comes the first. Buckets b are sorted apart, and the rows
    stay dealt by b: what works on buckets moves no text again.

    Besides, per bucket b the text that follows its last row (head_text).
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64(F.lit(17), "text"))
    rows = rows.withColumn("b", _bucket(rows, "doc_id", "th"))
    head = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("k"), "th", F.col("text").alias("t"))
    heads = settle(rows.groupBy("b").agg(F.max(head).alias("head")).select("b", F.col("head.t").alias("t")), "bucket-heads")
    turn = Window.orderBy(F.col("b").desc())
    after = heads.select("b", F.coalesce(F.lead("b").over(turn), F.max("b").over(Window.partitionBy(F.lit(1)))).alias("nb"))
    first = after.join(heads.select(F.col("b").alias("nb"), F.col("t").alias("head_text")), "nb").select(F.col("b").alias("hb"), "head_text")
    w = Window.partitionBy("b").orderBy(F.col("doc_id").desc_nulls_last(), F.col("th").desc(), F.col("text").desc())
    inside = rows.select("*", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next_text"))
    linked = inside.join(first, F.col("b") == F.col("hb"), "left")
    return linked.select("b", "rn", "doc_id", "text", F.coalesce("next_text", "head_text").alias("next_text")), first


def edited(text: Column, following: Column) -> Column:
    """text with its last third (rounded down, in code points) replaced by the
    first as many code points of following, or all of them."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def compare_edited(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, lanes (the fingerprint itself, see vectors: what
    combine adds to and takes from) of every row. Null texts are empty; a single row is
    its own next; rows that repeat an id are rows of their own."""
    pairs, first = with_next(df, text, key)
    keys = ("b", "rn", "doc_id", "n_chars", "edited_sha256")
    both = pairs.select(
        "b", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), F.col("text").alias("t0"), edited(F.col("text"), F.col("next_text")).alias("t1")
    )
    both = both.select("*", F.sha2(F.col("t1").cast("binary"), 256).alias("edited_sha256"))
    sides = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"t{k}").alias("t")) for k in (0, 1)])
    fps = vectors(both.select(*keys, F.explode(sides).alias("side")).select(*keys, "side.kind", "side.t"), "t", (*keys, "kind"))
    wide = fps.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("efp"))
    heads = vectors(first, "head_text", ("hb",)).select("hb", F.col("fp").alias("hfp"))
    following = F.lead("fp").over(Window.partitionBy("b").orderBy("rn"))
    joined = wide.withColumn("nfp", following).join(heads, F.col("b") == F.col("hb"), "left").withColumn("nfp", F.coalesce("nfp", "hfp"))
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("fp")).alias("fingerprint"), digest(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
        F.col("fp").alias("lanes"),
    )
