"""Sources: every reader has an explicit schema and skips what it must."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as T
from ..operators.analytics import top_per_group
from ..session import map_pandas

TEXT_TYPES = ("txt", "md")
UPLOAD_TYPES = ("txt", "md", "pdf", "docx", "csv", "html", "htm")


def questions(spark: SparkSession, path: str, sources: list[str] | None = None, categories: list[str] | None = None, most: int | None = None) -> DataFrame:
    """JSON lines; text or question, ground_truth or answer; bad lines go."""
    q = spark.read.schema("id string, text string, question string, ground_truth string, answer string, source_type string, category string, difficulty string").option("mode", "DROPMALFORMED").json(path)
    q = q.select("id", F.coalesce("text", "question").alias("text"), F.coalesce("ground_truth", "answer").alias("ground_truth"), F.coalesce("source_type", F.lit("all")).alias("source_type"), F.coalesce("category", F.lit("single_doc")).alias("category"), "difficulty")
    q = q.where("text is not null")
    if sources:
        q = q.where(source_match("source_type", sources))
    if categories:
        q = q.where(F.col("category").isin(categories))
    return q.orderBy("id").limit(most) if most else q


def source_match(c: str, sources: list[str]):
    """Any comma part is listed, or the value is ``all``."""
    parts = F.transform(F.split(c, ","), lambda x: F.trim(x))
    return F.arrays_overlap(parts, F.array(*[F.lit(s) for s in sources])) | (F.col(c) == "all")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """<path>/<source_type>/*.txt|md, a document per file."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    f = F.col("_metadata.file_path")
    source, stem = F.regexp_extract(f, r"([^/]+)/[^/]+$", 1), F.regexp_extract(f, r"([^/]+)\.[^./]+$", 1)
    return t.select(F.concat_ws("_", source, stem).alias("id"), F.col("value").alias("content"), source.alias("source_type"), F.create_map(F.lit("size"), F.length("value").cast("string")).alias("metadata"))


def capped(df: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """At most so many rows of each kind (for slices of remote datasets)."""
    return top_per_group(df, [by], [key], most, "__r").drop("__r")


def csv_rows(spark: SparkSession, path: str, source_type: str = "csv") -> DataFrame:
    """A document per row, ``name: value`` lines of the values that are set."""
    d = spark.read.option("header", True).csv(path)
    parts = [F.when(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in d.columns]
    text = F.array_join(F.array_compact(F.array(*parts)), "\n")
    return d.select(F.substring(F.sha2(text, 256), 1, 16).alias("id"), text.alias("content"), F.lit(source_type).alias("source_type")).where("content <> ''")


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.option("pathGlobFilter", "*.{html,htm}").option("recursiveFileLookup", True).text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("id"), T.html_text("value").alias("content"), F.lit("html").alias("source_type"))


def docx_text(data: bytes) -> tuple[str, int]:
    """Paragraphs of a word-processing file, joined by blank lines, and their
    number. The file is a zip of XML."""
    import io
    import re
    import zipfile
    from xml.sax.saxutils import unescape

    xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8")
    out = []
    for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S):
        t = unescape("".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.S)), {"&quot;": '"', "&apos;": "'"})
        if t.strip():
            out.append(t)
    return "\n\n".join(out), len(out)


#: Adapters by extension: bytes to text. PDF and OCR engines are registered by
#: whoever has them.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"docx": lambda b: docx_text(b)[0]}


def uploads(spark: SparkSession, path: str, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Files of the known types below path; a file that its extractor fails on
    is left out, with its error in the metadata of no one else."""
    found = EXTRACTORS | (extractors or {})
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    b = b.withColumn("ext", ext).where(F.col("ext").isin(*UPLOAD_TYPES))
    plain = b.where(F.col("ext").isin("txt", "md", "csv")).select("path", "ext", F.col("content").cast("string").alias("content"))
    pages = b.where(F.col("ext").isin("html", "htm")).select("path", "ext", T.html_text(F.col("content").cast("string")).alias("content"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p, c, e in zip(pdf["path"], pdf["content"], pdf["ext"], strict=True):
                try:
                    rows.append((p, e, found[e](bytes(c))))
                except Exception:  # a file of its own that is broken
                    continue
            yield pd.DataFrame(rows, columns=["path", "ext", "content"])

    other = map_pandas(b.where(F.col("ext").isin(*found)).select("path", "content", "ext"), run, "path string, ext string, content string")
    u = plain.unionByName(pages).unionByName(other)
    return u.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("id"), "content", F.col("ext").alias("source_type")).where("trim(content) <> ''")


def with_fallbacks(data: bytes, order: list[Callable[[bytes], str]]) -> str:
    """First extractor of a chain that gives text."""
    for f in order:
        try:
            text = f(data)
        except Exception:
            continue
        if text and text.strip():
            return text
    return ""


def markdown_flags(c):
    return F.struct(F.contains(c, F.lit("|---")).alias("has_tables"), F.contains(c, F.lit("![")).alias("has_images"))


def user_questions(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """question, answer, source_type, category, id; incomplete rows go."""
    schema = "question string, answer string, source_type string, category string, id string"
    r = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    d = r.json(path) if kind == "json" else spark.read.option("header", True).option("enforceSchema", False).csv(path)
    for c in ("source_type", "category", "id"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string"))
    set_ = lambda c: F.nullif(F.trim(c), F.lit(""))
    d = d.select(set_("question").alias("text"), set_("answer").alias("ground_truth"), F.coalesce(set_("source_type"), F.lit("upload")).alias("source_type"), F.coalesce(set_("category"), F.lit("user")).alias("category"), set_("id").alias("id"))
    d = d.where("text is not null and ground_truth is not null")
    return d.withColumn("id", F.coalesce("id", F.concat(F.lit("user_"), F.substring(F.sha2("text", 256), 1, 12))))


def layers(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def corpus_switch(mode: str, bench: DataFrame, upload: DataFrame) -> DataFrame:
    if mode not in ("bench", "upload", "mixed"):
        raise ValueError(f"unknown corpus mode {mode!r}")
    return {"bench": bench, "upload": upload}.get(mode) if mode != "mixed" else layers([bench, upload])


#: Benchmark subsets to question categories.
SUBSET_CATEGORIES = {"hotpotqa": "multi_hop", "msmarco": "factual", "nq": "factual", "fiqa": "analytical"}


def benchmark_questions(df: DataFrame, per_subset: int = 250) -> DataFrame:
    """subset, query_id, text, answer as questions, capped per subset."""
    c = F.lit("factual")
    for k, v in SUBSET_CATEGORIES.items():
        c = F.when(F.col("subset") == k, v).otherwise(c)
    q = df.select("subset", F.concat_ws("_", "subset", "query_id").alias("id"), "text", F.col("answer").alias("ground_truth"), F.lit("all").alias("source_type"), c.alias("category"))
    return capped(q, "subset", "id", per_subset).drop("subset")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and the first 16 hex digits of the SHA-256 of each file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.substring(F.sha2("content", 256), 1, 16).alias("file_hash"))


def presets(spark: SparkSession, path: str) -> DataFrame:
    """id, name and description of the presets in a folder of YAML files with
    plain top-level values; the name defaults to the file's, the description
    to an empty text."""
    f = spark.read.option("pathGlobFilter", "*.yaml").text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def field(name: str):
        found = F.regexp_extract("value", rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
        return F.nullif(F.regexp_replace(found, "^[\"']|[\"']$", ""), F.lit(""))

    own = F.regexp_extract("file", r"([^/]+)\.yaml$", 1)
    return f.select(own.alias("id"), F.coalesce(field("name"), own).alias("name"), F.coalesce(field("description"), F.lit("")).alias("description"))


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.EVAL_RESULT).option("header", True).csv(path)


def with_recall_map(results: DataFrame) -> DataFrame:
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in ("1", "3", "5")]), F.array("recall_at_1", "recall_at_3", "recall_at_5"))
    return results.withColumn("recall_at_k", F.map_filter(m, lambda k, v: v.isNotNull())).drop("recall_at_1", "recall_at_3", "recall_at_5")


def flat_results(results: DataFrame) -> DataFrame:
    """Metadata keys with defaults as columns."""
    at = lambda k, d: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(d)).alias(k)
    return results.select("*", at("agentic_strategy", "none"), at("reranker", "none"), at("cache_mode", "off"), F.coalesce(F.try_element_at("metadata", F.lit("latency_ms")).try_cast("double"), F.lit(0.0)).alias("latency_ms")).drop("metadata")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.ANNOTATION).json(path)


def labelled_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.JUDGE_SAMPLE).json(path).where("human_correct is not null")


def probes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PROBE).json(path)


def challenges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CHALLENGE).option("multiLine", True).json(path)


def examples(spark: SparkSession, path: str, n: int | None = None, default: list[tuple] | None = None) -> DataFrame:
    e = spark.read.schema(S.EXAMPLE).option("mode", "DROPMALFORMED").json(path)
    if default and not e.limit(1).count():
        e = spark.createDataFrame(default, S.EXAMPLE)
    return e.limit(n) if n else e


def block_json(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a known type; others go."""
    known = ("paragraph", "heading", "table", "caption", "figure", "list")
    return spark.read.schema(S.BLOCK).option("multiLine", True).json(path).where(F.col("block_type").isin(*known))


def experiment_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Result files below path by experiment folder: rows and mean score."""
    r = spark.read.schema(S.EVAL_RESULT).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return r.select(name.alias("experiment"), "overall_score").groupBy("experiment").agg(F.count("*").alias("n"), F.round(F.avg("overall_score"), 6).alias("avg_score"))


def sql(spark: SparkSession, query: str, **args) -> DataFrame:
    """Named parameters are bound as values, never spliced into the text."""
    return spark.sql(query, args=args)


def placeholder_corpus(spark: SparkSession, per_source: int = 50, sources=("wiki", "code", "chat")) -> DataFrame:
    names = F.array(*[F.lit(s) for s in sources])
    d = spark.range(min(per_source, 50)).withColumn("source_type", F.explode(names))
    return d.select(F.format_string("%s_%03d", "source_type", "id").alias("id"), F.format_string("Placeholder document %d of %s.", "id", "source_type").alias("content"), "source_type")


def placeholder_questions(spark: SparkSession, n: int = 20) -> DataFrame:
    return spark.range(n).select(F.format_string("q%03d", "id").alias("id"), F.format_string("What does document %d hold?", "id").alias("text"), F.format_string("document %d", "id").alias("ground_truth"), F.lit("all").alias("source_type"), F.lit("single_doc").alias("category"))


def unknown_sources(questions_df: DataFrame, docs: DataFrame) -> DataFrame:
    """Questions whose sources no document has, all of them checked."""
    q = questions_df.where("source_type <> 'all'").select("id", F.explode(F.transform(F.split("source_type", ","), lambda x: F.trim(x))).alias("source_type"))
    return q.join(docs.select("source_type").distinct(), "source_type", "left_anti")
