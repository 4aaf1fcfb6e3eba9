"""Chunkers: documents (id, content, source_type) to chunks in the chunk schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import map_pandas, ship, spread


def _chunks(df: DataFrame, index: Column, content: Column) -> DataFrame:
    return df.select(
        F.concat(F.col("id").cast("string"), F.lit("_chunk_"), index.cast("string")).alias("id"),
        F.col("id").cast("string").alias("doc_id"), content.alias("content"), "source_type", index.cast("int").alias("chunk_index"),
    )


def solid(docs: DataFrame) -> DataFrame:
    return docs.where(F.regexp_replace("content", r"\s", "") != "")


def whole(docs: DataFrame) -> DataFrame:
    return _chunks(solid(docs), F.lit(0), F.col("content"))


def fixed(docs: DataFrame, size: int = 200, overlap: int = 50) -> DataFrame:
    """Windows of size tokens, each size - overlap further on."""
    step = max(1, size - overlap)
    t = solid(docs).select("id", "source_type", F.filter(F.split("content", r"\s+"), lambda x: x != "").alias("t"))
    e = t.select("*", F.posexplode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(step))).alias("i", "at"))
    return _chunks(e, F.col("i"), F.array_join(F.slice("t", F.col("at") + 1, size), " "))


def fixed_count(n_tokens: Column, size: int = 200, overlap: int = 50) -> Column:
    step = max(1, size - overlap)
    return F.greatest(F.lit(1), F.ceil((n_tokens - overlap) / step))


def sentence(docs: DataFrame, budget: int = 200) -> DataFrame:
    """Sentences packed in order up to a token budget; a longer one stands
    alone. One fold over a document's sentences."""
    s = solid(docs).select("id", "source_type", T.sentences(T.strip("content")).alias("s"))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        n = F.size(T.tokens(x))
        full = (acc["n"] > 0) & (acc["n"] + n > budget)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] == 0), x).otherwise(F.concat(acc["cur"], F.lit(" "), x)).alias("cur"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    parts = F.aggregate("s", empty, step, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], a["cur"])).otherwise(a["done"]))
    e = s.select("id", "source_type", F.posexplode(parts).alias("i", "c"))
    return _chunks(e, F.col("i"), F.col("c"))


def semantic(sents: DataFrame, threshold: float = 0.7) -> DataFrame:
    """sents: id, source_type, seq, sentence, vec. A new chunk starts where a
    sentence's cosine with the one before is below the threshold."""
    w = Window.partitionBy("id").orderBy("seq")
    cos = T.cosine(F.col("vec"), F.lag("vec").over(w))
    s = sents.withColumn("new", F.when(cos < threshold, 1).otherwise(0))
    s = s.withColumn("i", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy("id", "source_type", "i").agg(F.array_sort(F.collect_list(F.struct("seq", "sentence"))).alias("p"))
    return _chunks(g, F.col("i"), F.array_join(F.transform("p", lambda x: x["sentence"]), " "))


# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


@lru_cache(maxsize=4)
def counter(kind: str) -> Callable[[str], int]:
    """Token counts: "words" (between white space), "approx" (a quarter of the
    characters), or the path of a tokenizer's JSON file."""
    if kind == "words":
        return lambda text: len(text.split())
    if kind == "approx":
        return lambda text: len(text) // 4
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(kind)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def token_counts(df: DataFrame, content: str = "content", kind: str = "words", out: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of a text; nulls have none. Only a
    tokenizer of a file leaves the JVM."""
    if kind in ("words", "approx"):
        n = F.size(T.tokens(content)) if kind == "words" else F.floor(F.length(content) / 4)
        return df.withColumn(out, F.coalesce(n, F.lit(0)).cast("int"))
    ship(df.sparkSession)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: counter(kind)(t) if t else 0)

    return df.withColumn(out, count(F.col(content)))


def split_tokens(text: str, count: Callable[[str], int], size: int, overlap: int, seps: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of about size tokens. A text that is too long is cut at the first
    separator; parts that are still too long are cut at the next ones (their
    pieces then stand in for them, empty parts fall away); neighbours are
    joined again while they fit. A piece opens with as many whole last parts
    of the piece before as overlap tokens hold. A part no separator can cut
    stands as it is, and what the overlap adds may exceed the size."""
    if not seps or count(text) <= size:
        return [text]
    sep, finer = seps[0], seps[1:]
    parts = text.split(sep) if sep else list(text)
    sizes = [count(p) for p in parts]
    if finer and any(n > size for n in sizes):
        parts = [x for p, n in zip(parts, sizes, strict=True) if p for x in (split_tokens(p, count, size, overlap, finer) if n > size else (p,))]
        sizes = [count(p) for p in parts]
    between, out, first, held = count(sep), [], 0, 0
    for i, n in enumerate(sizes):
        gap = between if i > first else 0
        if i > first and held + gap + n > size:
            out.append(sep.join(parts[first:i]))
            opened, first, held = first, i, 0
            while first > opened and held + sizes[first - 1] <= overlap:
                first -= 1
                held += sizes[first] + between
        held += n + gap
    return [*out, sep.join(parts[first:])] if parts else out


def recursive(docs: DataFrame, size: int = 200, overlap: int = 50, kind: str = "words", seps: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """split_tokens of each document; blank pieces keep their number but are
    no chunks."""

    def run(batches):
        for pdf in batches:
            rows = [(f"{i}_chunk_{k}", str(i), c, s, k) for i, t, s in zip(pdf["id"], pdf["content"], pdf["source_type"], strict=True) for k, c in enumerate(split_tokens(t, counter(kind), size, overlap, seps)) if c.strip()]
            yield pd.DataFrame(rows, columns=["id", "doc_id", "content", "source_type", "chunk_index"])

    rows = spread(solid(docs).select("id", "content", F.col("source_type").cast("string").alias("source_type")))
    return map_pandas(rows, run, "id string, doc_id string, content string, source_type string, chunk_index int")


def export_blocks(blocks: DataFrame, target: int = 350, most: int = 500) -> DataFrame:
    """Chunks of a document's blocks (doc_id, seq, block_type, section, text).

    Tables and captions stand alone, headings and new sections flush, and
    paragraphs fill up to target, never over most, approximate tokens. One
    fold per document over its ordered blocks.
    """
    b = blocks.select("doc_id", F.struct("seq", "block_type", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("text", F.lit("")).alias("text")).alias("b"))
    g = b.groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    kind = "array<struct<kind:string,section:string,text:string>>"
    empty = F.struct(F.array().cast(kind).alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit("").alias("section"))

    def step(acc: Column, x: Column) -> Column:
        n = T.approx_tokens(x["text"])
        alone = x["block_type"].isin("table", "caption")
        head = x["block_type"] == "heading"
        flush = (acc["n"] > 0) & (alone | head | (x["section"] != acc["section"]) | (acc["n"] >= target) | (acc["n"] + n > most))
        held = F.when(flush, F.array_append(acc["done"], F.struct(F.lit("text").alias("kind"), acc["section"].alias("section"), acc["cur"].alias("text")))).otherwise(acc["done"])
        done = F.when(alone, F.array_append(held, F.struct(x["block_type"].alias("kind"), x["section"].alias("section"), x["text"].alias("text")))).otherwise(held)
        fresh = flush | (acc["n"] == 0)
        cur = F.when(alone, F.when(fresh, "").otherwise(acc["cur"])).when(fresh, x["text"]).otherwise(F.concat(acc["cur"], F.lit("\n"), x["text"]))
        count = F.when(alone, F.when(fresh, 0).otherwise(acc["n"])).when(fresh, n).otherwise(acc["n"] + n)
        return F.struct(done.alias("done"), cur.alias("cur"), count.cast("int").alias("n"), x["section"].alias("section"))

    last = lambda a: F.when(a["n"] > 0, F.array_append(a["done"], F.struct(F.lit("text").alias("kind"), a["section"].alias("section"), a["cur"].alias("text")))).otherwise(a["done"])
    e = g.select("doc_id", F.posexplode(F.aggregate("bs", empty, step, last)).alias("chunk_index", "c"))
    return e.select("doc_id", "chunk_index", "c.kind", "c.section", "c.text")


def boundary_diagnosis(chunks: DataFrame) -> DataFrame:
    """Whether a chunk that another follows ends inside a sentence
    (mid_clause), and inside a list: its last line is an item, the first line
    of the next chunk is none (mid_list). Blank chunks have neither fault."""
    nxt = F.lead("content").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    own = F.regexp_replace("content", r"\s+$", "")
    c = chunks.withColumns({"__own": own, "__next": F.regexp_replace(nxt, r"^\s+", "")})
    live = F.col("__next").isNotNull() & (F.col("__own") != "")
    item = T.starts_list_item(F.substring_index("__own", "\n", -1)) & ~T.starts_list_item(F.substring_index("__next", "\n", 1))
    return c.withColumns({"mid_clause": live & ~T.ends_sentence("__own"), "mid_list": live & item}).drop("__own", "__next")


def offsets(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Start of each chunk's text by searching on from the chunk before."""
    c = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("cs"))
    j = docs.select(F.col("id").cast("string").alias("doc_id"), F.col("content").alias("__text")).join(c, "doc_id")
    init = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        p = F.call_function("locate", x["content"], F.col("__text"), acc["at"])
        return F.struct(F.greatest(acc["at"], p).cast("int").alias("at"), F.array_append(acc["found"], (p - 1).cast("int")).alias("found"))

    return j.select("doc_id", F.posexplode(F.aggregate("cs", init, step, lambda a: a["found"])).alias("chunk_index", "start"))
