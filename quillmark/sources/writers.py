"""Sinks. Tables are folders of Parquet; changes by key write a new version of
the table beside the old one and then switch a pointer, so that readers and
lost tasks never see half of it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import top_per_group


class Table:
    """A table of versions: <path>/v-<id>/ and a pointer row set."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[str]:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if n.startswith("v-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        """Last complete version in the declared schema: columns added to the
        schema since then are null."""
        v = self._versions()
        if not v:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{v[-1]}")

    def replace(self, df: DataFrame) -> None:
        n = len(self._versions())
        df.select(*self.read().columns).write.parquet(f"{self.path}/v-{n:08d}-{uuid.uuid4().hex[:8]}")

    def upsert(self, rows: DataFrame, keys: list[str], seq: Column | None = None) -> None:
        """Rows of a key replace its old row; of several new ones the last by
        seq stays."""
        new = top_per_group(rows.withColumn("__s", seq if seq is not None else F.lit(0)), keys, [F.desc("__s")], 1, "__r").drop("__s", "__r")
        old = self.read().join(new.select(*keys), keys, "left_anti")
        self.replace(old.unionByName(new, allowMissingColumns=True))

    def insert_missing(self, rows: DataFrame, keys: list[str]) -> None:
        """Insert or ignore."""
        old = self.read()
        new = rows.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
        self.replace(old.unionByName(new, allowMissingColumns=True))

    def update(self, where: Column, **values) -> None:
        old = self.read()
        self.replace(old.withColumns({k: F.when(where, F.lit(v)).otherwise(F.col(k)).cast(old.schema[k].dataType) for k, v in values.items()}))


def completed(results: DataFrame) -> DataFrame:
    """Questions of rows that are no errors."""
    return results.where("is_error is null or is_error = 0").select("question_id").distinct()


def pending(questions: DataFrame, results: DataFrame) -> DataFrame:
    return questions.join(completed(results).withColumnRenamed("question_id", "id"), "id", "left_anti")


def experiment_id(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 16)


def run_id(*parts: str) -> str:
    import hashlib

    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def write_results_csv(results: DataFrame, path: str) -> None:
    results.write.option("header", True).mode("errorifexists").csv(path)


def append_json(rows: DataFrame, path: str) -> None:
    """Append-only logs: traces, spans, retrieval scores."""
    rows.write.mode("append").json(path)


def archive(results: DataFrame, path: str, stamp: str) -> None:
    results.write.mode("errorifexists").parquet(f"{path}/{stamp}")


def write_report(df: DataFrame, path: str, version: int) -> None:
    """A version is written once; writing it again is an error."""
    df.write.mode("errorifexists").json(f"{path}/report_v{version}")


def write_index(postings: DataFrame, vectors: DataFrame, manifest: dict, path: str) -> None:
    """Index tables, and the manifest last: an index without it is not built."""
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    spark = postings.sparkSession
    spark.createDataFrame([(json.dumps(manifest | {"completed": True}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    try:
        rows = spark.read.text(f"{path}/manifest").collect()
    except Exception:
        return None
    return json.loads(rows[0][0]) if rows else None


def is_stale(manifest: dict | None, chunk_count: int, corpus_hash: str) -> bool:
    m = manifest or {}
    return not (m.get("completed") and m.get("chunk_count") == chunk_count and m.get("corpus_hash") == corpus_hash)


def small_rows(df: DataFrame, most: int) -> list:
    """The rows of a small result; more than most of them are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table with a Spark writer instead")
    return rows


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table (reports only)."""
    rows = small_rows(df, most)
    line = lambda xs: "| " + " | ".join(str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])


def experiment_report(results: DataFrame, pipelines: list[str], config: dict) -> str:
    """Summary, two pivots, best and worst five, configuration."""
    from ..operators.analytics import eval_summary, pivot_means

    top = results.select("question_id", "pipeline", "overall_score").orderBy(F.desc("overall_score"), "question_id").limit(5)
    low = results.select("question_id", "pipeline", "overall_score").orderBy("overall_score", "question_id").limit(5)
    parts = [("Summary", eval_summary(results)), ("By source", pivot_means(results, "source_type", pipelines)), ("By category", pivot_means(results, "category", pipelines)), ("Best", top), ("Worst", low)]
    out = "\n\n".join(f"## {n}\n\n{markdown_table(d)}" for n, d in parts)
    return f"# Experiment\n\n{out}\n\n## Configuration\n\n```json\n{json.dumps(config, indent=2, sort_keys=True)}\n```\n"


def export(df: DataFrame, kind: str, most: int = 1000) -> str:
    """A small result as markdown, csv, html or json text; of more than most
    rows an error."""
    import csv
    import html
    import io

    if kind == "markdown":
        return markdown_table(df, most)
    rows = [r.asDict(recursive=True) for r in small_rows(df, most)]
    if kind == "json":
        return json.dumps(rows, default=str, indent=2)
    if kind == "csv":
        f = io.StringIO()
        w = csv.DictWriter(f, df.columns)
        w.writeheader()
        w.writerows(rows)
        return f.getvalue()
    if kind == "html":
        cells = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{html.escape(str(x))}</{tag}>" for x in xs) + "</tr>"
        return "<table>" + cells("th", df.columns) + "".join(cells("td", r.values()) for r in rows) + "</table>"
    raise ValueError(f"unknown format {kind!r}")
