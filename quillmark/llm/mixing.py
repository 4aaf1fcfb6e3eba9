"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the mix in proportion to its weight, at most
``max_epochs`` times its own size. What a capped source cannot take goes to
the others by weight until no source is above its cap: target = min(cap,
level * weight), the level found from prefix sums over the sources in order of
cap / weight. A source's target becomes whole repetitions of all its documents
and a fraction: in a seeded order, documents are repeated once more until the
rest of the target is used up, the last of them in part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, unsent

WEIGHTS = (3, 1, 2)
MIX_SHARE = 1.5
MAX_EPOCHS = 2
SEED = 7
#: Rows that one bucket of the seeded order holds, about.
BUCKET_ROWS = 500
#: Buckets whose words are summed up first.
STRETCH = 4096
_TOP = 1 << 52
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(key: str, text: str, seed: int = SEED) -> Column:
    """52 bits of an MD5 of seed, key and text; nulls count as empty."""
    own = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    full = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), own)
    return F.conv(F.substring(F.md5(full.cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = MIX_SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: (source, source_size), one row per source. Adds target (double).

    Weights go round in order of the source names by code point, null last.
    The windows see one row per source.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    s = (
        sizes.withColumn("i", F.row_number().over(names) - 1)
        .withColumn("w", weight)
        .withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    )
    by = Window.orderBy(F.col("cap") / F.col("w"), "i")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(share)
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("free", F.col("cap") >= F.col("level") * F.col("w"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "i", "level"))).over(Window.partitionBy(F.lit(1)))
    return s.withColumn("lambda", level["level"]).select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("lambda") * F.col("w")), F.col("cap")).alias("target")
    )


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED, **how) -> DataFrame:
    """Per row: doc_id, h (its place in the seeded order), source, size,
    source_size, target, taken, whole, extra.

    Null texts have size 0; a source of size 0 has target 0. Rows that repeat
    key, text and source are one entry of the order, counted before anything is
    sorted; they take alike, so where the target ends in such an entry, fewer
    words than it has rows may be left over. An empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("doc_id"), seeded(key, text, seed).alias("h"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = settle(rows, "mix-sizes")
    entries = settle(rows.groupBy("source", "h", "doc_id", "size").agg(F.count("*").alias("copies")), "mix-entries")
    found = settle(entries.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n")), "mix-sources")
    n = found.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    e = entries.withColumn("bucket", F.floor(F.col("h") / F.lit(float(_TOP)) * buckets).cast("long"))
    # Words before a bucket: those of earlier stretches of buckets, and of
    # earlier buckets of its own stretch.
    bucket = e.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("held")).withColumn("stretch", F.floor(F.col("bucket") / STRETCH).cast("long"))
    bucket = settle(bucket, "mix-buckets")

    def before(held: str, order: str, *group: str) -> Column:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(held).over(w), F.lit(0))

    goal = targets(found.select("source", "source_size"), **how)
    long = bucket.groupBy("source", "stretch").agg(F.sum("held").alias("held")).select("source", "stretch", before("held", "stretch", "source").alias("ahead"))
    long = long.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(F.col("s.source").alias("l_source"), F.col("stretch").alias("l_stretch"), "ahead", "source_size", "target")
    near = bucket.select(F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), "stretch", before("held", "bucket", "source", "stretch").alias("before"))
    plan = near.join(long, F.col("p_source").eqNullSafe(F.col("l_source")) & (F.col("stretch") == F.col("l_stretch"))).drop("l_source", "l_stretch")
    e = e.withColumn("words", F.col("size") * F.col("copies"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = e.withColumn("within", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    placed = unsent(placed).join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = (F.floor("target") - whole * F.col("source_size")).cast("long")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), rest - F.col("ahead") - F.col("before") - F.col("within")))
    share = placed.select(
        F.col("source").alias("e_source"), F.col("h").alias("e_h"), F.col("doc_id").alias("e_doc"), F.col("size").alias("e_size"), "source_size", "target", whole.alias("whole"),
        F.floor(extra / F.col("copies")).cast("long").alias("extra"),
    )
    same = (F.col("h") == F.col("e_h")) & F.col("source").eqNullSafe(F.col("e_source")) & F.col("doc_id").eqNullSafe(F.col("e_doc")) & (F.col("size") == F.col("e_size"))
    return unsent(rows).join(share, same).select("doc_id", "h", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"), "whole", "extra")


def first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(words, 1, n.cast("int")), "")


def mixed_documents(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED, **how) -> DataFrame:
    """The mix itself: each row of df as often as the mix takes it whole, and
    its first words once more where the mix takes it in part. n_chars, where
    df has it, follows the text. Rows that repeat one another are taken alike."""
    names = df.columns
    plan = mix(df, text, source, key, seed, **how).groupBy("h", "source").agg(F.max("whole").alias("__mix_whole"), F.max("extra").alias("__mix_extra"), F.max("size").alias("__mix_size"))
    plan = plan.withColumnsRenamed({"h": "__mix_h", "source": "__mix_source"})
    joined = df.join(unsent(plan), (seeded(key, text, seed) == F.col("__mix_h")) & F.col(source).eqNullSafe(F.col("__mix_source")))
    full = F.col("__mix_whole") + F.when((F.col("__mix_extra") > 0) & (F.col("__mix_extra") == F.col("__mix_size")), 1).otherwise(0)
    part = (F.col("__mix_extra") > 0) & (F.col("__mix_extra") < F.col("__mix_size"))
    times = F.array_repeat(F.lit(False), full.cast("int"))
    rows = joined.withColumn("__mix_cut", F.explode(F.when(part, F.concat(times, F.array(F.lit(True)))).otherwise(times)))
    cut = F.when(F.col("__mix_cut"), first_words(F.col(text), F.col("__mix_extra"))).otherwise(F.col(text))
    rows = rows.withColumn(text, cut)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.col("__mix_cut"), F.length(text)).otherwise(F.col("n_chars")).cast(df.schema["n_chars"].dataType))
    return rows.select(*names)
