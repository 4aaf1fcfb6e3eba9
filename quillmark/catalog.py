"""Named queries over the star-schema tables, each with SQL of the same
meaning where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import views as V
from .functions import text as T
from .operators import analytics as A
from .operators import chunking as C
from .operators import dedup as D
from .operators import evaluation as E
from .operators import retrieval as R
from .operators import sparse as SP
from .operators import vectors as X
from .plans import adapters as AD
from .plans import pipelines as P
from .sources import readers as S
from .sources import writers as W
from .streaming import logs as L

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _ev(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(V.eval_results(spark, sf))


def _add(name: str, f: Query, sql: str | None = None) -> None:
    query(name, sql)(f)


# Aggregations, windows, joins over scored results

_add("wn01_leaderboard", _ev(A.leaderboard), f"""WITH {V.EV}, a AS (
  SELECT source_type, model_id, round(avg(overall_score), 6) AS avg_score, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY avg_score DESC, model_id) AS rn FROM a)
SELECT source_type, model_id, avg_score, n FROM r WHERE rn = 1""")
_add("ag01_model_scores", _ev(lambda d: d.groupBy("source_type", "model_id").agg(A.mean("overall_score").alias("avg_score"), F.count("*").alias("n")).where("n >= 3")),
     f"WITH {V.EV} SELECT source_type, model_id, round(avg(overall_score), 6) AS avg_score, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) >= 3")
_add("ag02_pipeline_comparison", _ev(A.pipeline_comparison), f"""WITH {V.EV} SELECT pipeline, round(avg(overall_score), 6) AS avg_score, round(avg(latency_ms), 6) AS avg_latency,
  round(avg(cost_usd), 6) AS avg_cost, count(*) AS n FROM ev GROUP BY 1 HAVING count(*) >= 5""")
_add("ag03_latency_percentiles", _ev(A.latency_percentiles), f"""WITH {V.EV} SELECT pipeline, round(quantile_cont(latency_ms, 0.5), 6) AS p50,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95, count(*) AS n FROM ev GROUP BY 1""")
_add("ag04_latency_percentiles_ranked", _ev(A.latency_percentiles_ranked), f"""WITH {V.EV}, r AS (SELECT pipeline, latency_ms,
  row_number() OVER (PARTITION BY pipeline ORDER BY latency_ms, question_id) AS rn, count(*) OVER (PARTITION BY pipeline) AS n FROM ev)
SELECT pipeline, max(CASE WHEN rn = greatest(1, CAST(floor(n * 0.5::DOUBLE) AS INTEGER)) THEN latency_ms END) AS p50,
  max(CASE WHEN rn = greatest(1, CAST(floor(n * 0.95::DOUBLE) AS INTEGER)) THEN latency_ms END) AS p95, max(n) AS n FROM r GROUP BY 1""")
_add("wn03_run_regression", _ev(A.run_regression), f"""WITH {V.EV}, m AS (SELECT run_id, round(avg(overall_score), 6) AS mean_score FROM ev GROUP BY 1)
SELECT run_id, mean_score, lag(mean_score) OVER (ORDER BY run_id) AS prev_score, round(mean_score - lag(mean_score) OVER (ORDER BY run_id), 6) AS delta FROM m""")
_add("ag05_run_means", _ev(lambda d: d.groupBy("run_id").agg(A.mean("overall_score").alias("mean_score"), F.count("*").alias("n"))),
     f"WITH {V.EV} SELECT run_id, round(avg(overall_score), 6) AS mean_score, count(*) AS n FROM ev GROUP BY 1")
_add("ag06_category_difficulty", _ev(A.category_difficulty), f"""WITH {V.EV} SELECT category, round(avg(overall_score), 6) AS avg_score,
  CAST(sum(CASE WHEN answer_correct THEN 1 ELSE 0 END) AS BIGINT) AS n_correct, count(*) AS n FROM ev GROUP BY 1""")
_add("ag07_cost_breakdown", lambda s, d: A.cost_breakdown(V.cost_records(s, d)), f"""WITH {V.COST} SELECT model_id, stage, round(sum(cost_usd), 2) AS total_cost,
  round(avg(cost_usd), 6) AS avg_cost, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, count(*) AS calls FROM cost GROUP BY 1, 2""")
_add("ag08_cost_summary", lambda s, d: A.cost_summary(V.cost_records(s, d)), f"""WITH {V.COST} SELECT stage, model_id, round(sum(cost_usd), 2) AS total_cost, count(*) AS calls,
  round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99
  FROM cost GROUP BY GROUPING SETS ((stage), (model_id), ())""")
_add("ag09_score_sets", _ev(A.score_cube), f"""WITH {V.EV}, e AS (SELECT CAST(category AS VARCHAR) AS category, pipeline, CAST(source_type AS VARCHAR) AS source_type, overall_score FROM ev)
SELECT category, pipeline, source_type, count(*) AS n, round(avg(overall_score), 6) AS avg_score FROM e GROUP BY GROUPING SETS ((category), (pipeline), (source_type))""")


_add("ag10_pivot_source", lambda s, d: A.pivot_means(V.eval_results(s, d), "source_type", ["click", "view"]), f"""WITH {V.EV} SELECT source_type,
  round(avg(CASE WHEN pipeline = 'click' THEN overall_score END), 6) AS click, round(avg(CASE WHEN pipeline = 'view' THEN overall_score END), 6) AS view FROM ev GROUP BY 1""")
_add("ag10_pivot_category", lambda s, d: A.pivot_means(V.eval_results(s, d), "category", ["click", "view"]), f"""WITH {V.EV} SELECT category,
  round(avg(CASE WHEN pipeline = 'click' THEN overall_score END), 6) AS click, round(avg(CASE WHEN pipeline = 'view' THEN overall_score END), 6) AS view FROM ev GROUP BY 1""")
_add("ag11_best_pipeline", _ev(lambda d: A.best_pipeline(d, "category")), f"""WITH {V.EV}, a AS (SELECT category, pipeline, round(avg(overall_score), 6) AS avg_score FROM ev GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY avg_score DESC, pipeline) AS rn FROM a) SELECT category, pipeline, avg_score FROM r WHERE rn = 1""")
_add("ag12_arena", lambda s, d: A.arena(V.eval_results(s, d), s.range(7).select(F.col("id").alias("model_id"))), f"""WITH {V.EV}, m AS (SELECT range AS model_id FROM range(7)),
a AS (SELECT model_id, round(avg(CASE WHEN answer_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS acc, round(avg(overall_score), 6) AS score, round(avg(latency_ms), 6) AS lat, count(*) AS n FROM ev GROUP BY 1)
SELECT m.model_id, coalesce(acc, 0.0::DOUBLE) AS accuracy, coalesce(score, 0.0::DOUBLE) AS avg_score, coalesce(lat, 0.0::DOUBLE) AS avg_latency, coalesce(n, 0) AS n FROM m LEFT JOIN a USING (model_id)""")
_add("ag13_arena_winners", _ev(A.arena_winners), f"""WITH {V.EV}, a AS (SELECT category, model_id, round(avg(overall_score), 6) AS avg_score FROM ev GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY avg_score DESC, model_id) AS rn FROM a) SELECT category, model_id, avg_score FROM r WHERE rn = 1""")
_add("ag14_recall_gaps", _ev(lambda d: A.recall_gaps(d, "answer_correct", 0.4, 5, True)), f"""WITH {V.EV} SELECT source_type, category,
  round(avg(CASE WHEN answer_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall, count(*) AS n FROM ev GROUP BY 1, 2
  HAVING count(*) >= 5 AND round(avg(CASE WHEN answer_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) < 0.4""")
_add("ag15_recall_matrix", _ev(lambda d: A.recall_gaps(d, "answer_correct", 0.4)), f"""WITH {V.EV}, m AS (SELECT source_type, category,
  round(avg(CASE WHEN answer_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall, count(*) AS n FROM ev GROUP BY 1, 2) SELECT *, recall < 0.4 AS gap FROM m""")


def _halves(d: DataFrame):
    return d.where("run_id >= '2024-01-16'"), d.where("run_id < '2024-01-16'")


_add("ag16_regression_trigger", _ev(lambda d: A.regression_trigger(*_halves(d))), f"""WITH {V.EV}, m AS (SELECT
  (SELECT round(avg(overall_score), 6) FROM ev WHERE run_id >= '2024-01-16') AS now_mean, (SELECT round(avg(overall_score), 6) FROM ev WHERE run_id < '2024-01-16') AS prev_mean)
SELECT now_mean, prev_mean, now_mean < prev_mean - 1e-9 AS regressed FROM m""")
_add("ag17_slice_consistency", _ev(A.slice_consistency), f"""WITH {V.EV}, g AS (
  SELECT 'source_type=' || source_type AS slice, pipeline, round(avg(overall_score), 6) AS s, count(*) AS n FROM ev GROUP BY source_type, pipeline
  UNION ALL SELECT 'category=' || category, pipeline, round(avg(overall_score), 6), count(*) FROM ev GROUP BY category, pipeline
  UNION ALL SELECT 'all', pipeline, round(avg(overall_score), 6), 3 FROM ev GROUP BY pipeline),
k AS (SELECT slice FROM g GROUP BY 1 HAVING min(n) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY s DESC, pipeline) AS rn FROM g JOIN k USING (slice)), w AS (SELECT slice, pipeline AS winner FROM r WHERE rn = 1)
SELECT slice, winner, (SELECT winner FROM w WHERE slice = 'all') AS agg_winner, winner = (SELECT winner FROM w WHERE slice = 'all') AS agrees FROM w""")


_BINS = f"""{V.EV}, b AS (SELECT least(CAST(floor(overall_score * 10) AS INTEGER), 9) AS bin, overall_score, answer_correct FROM ev),
g AS (SELECT bin, round(avg(overall_score), 6) AS predicted, round(avg(CASE WHEN answer_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy, count(*) AS n FROM b GROUP BY 1),
c AS (SELECT CAST(r.range AS INTEGER) AS bin, coalesce(predicted, 0.0::DOUBLE) AS predicted, coalesce(accuracy, 0.0::DOUBLE) AS accuracy, coalesce(n, 0) AS n FROM range(10) r LEFT JOIN g ON g.bin = r.range)"""
_add("ag18_calibration_bins", _ev(lambda d: A.calibration_bins(d, "overall_score", "answer_correct")), f"WITH {_BINS} SELECT * FROM c")
_add("ag19_calibration_error", _ev(lambda d: A.expected_calibration_error(A.calibration_bins(d, "overall_score", "answer_correct"))),
     f"WITH {_BINS} SELECT round(sum(n * abs(predicted - accuracy)) / greatest(sum(n), 1), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM c")
_add("ag20_reliability", _ev(lambda d: A.reliability(A.calibration_bins(d, "overall_score", "answer_correct"))), f"""WITH {_BINS} SELECT *,
  CASE WHEN predicted - accuracy > 0.05 THEN 'over' WHEN predicted - accuracy < -0.05 THEN 'under' ELSE 'ok' END AS kind FROM c WHERE n > 0""")


def _ab(d: DataFrame, a: str = "click", b: str = "view") -> DataFrame:
    m = d.groupBy("user_id", "pipeline").agg(F.avg("overall_score").alias("m"), F.bool_or("answer_correct").alias("ok"))
    x = m.where(F.col("pipeline") == a).select("user_id", F.col("m").alias("a"), F.col("ok").alias("ok_a"))
    return x.join(m.where(F.col("pipeline") == b).select("user_id", F.col("m").alias("b"), F.col("ok").alias("ok_b")), "user_id")


_AB = f"""{V.EV}, m AS (SELECT user_id, pipeline, avg(overall_score) AS m, bool_or(answer_correct) AS ok FROM ev GROUP BY 1, 2),
ab AS (SELECT x.user_id, x.m AS a, y.m AS b, x.ok AS ok_a, y.ok AS ok_b FROM m x JOIN m y ON x.user_id = y.user_id AND x.pipeline = 'click' AND y.pipeline = 'view')"""
_add("ag22_discordant", _ev(lambda d: E.discordant(_ab(d), "ok_a", "ok_b")), f"WITH {_AB} SELECT count(*) FILTER (ok_a AND NOT ok_b) AS b10, count(*) FILTER (NOT ok_a AND ok_b) AS b01, count(*) AS n FROM ab")
_add("ag23_effect_size", _ev(lambda d: E.effect_size(_ab(d))), f"""WITH {_AB} SELECT round(avg(b - a), 6) AS delta,
  round(CASE WHEN coalesce(stddev_samp(b - a), 0) > 1e-12 THEN avg(b - a) / stddev_samp(b - a) ELSE 0 END, 6) AS cohens_d, count(*) AS n FROM ab""")
_add("jn03_paired_results", _ev(lambda d: _ab(d).select("user_id", F.round(F.col("a") + 1e-9, 5).alias("a"), F.round(F.col("b") + 1e-9, 5).alias("b"))), f"WITH {_AB} SELECT user_id, round(a + 1e-9, 5) AS a, round(b + 1e-9, 5) AS b FROM ab")
_add("jn04_config_pairs", _ev(A.config_pairs), f"""WITH {V.EV}, m AS (SELECT user_id, pipeline, avg(overall_score) AS m FROM ev GROUP BY 1, 2)
SELECT x.pipeline AS config_a, y.pipeline AS config_b, round(avg(x.m), 6) AS mean_a, round(avg(y.m), 6) AS mean_b, round(avg(y.m - x.m), 6) AS delta, count(*) AS n
FROM m x JOIN m y ON x.user_id = y.user_id AND x.pipeline < y.pipeline GROUP BY 1, 2""")
_add("ag24_kappa", lambda s, d: A.cohen_kappa(V.load(s, d, "labels").join(V.load(s, d, "documents"), "doc_id").select((F.col("quality") == 1).alias("h"), (F.col("n_chars") > 1500).alias("j")), "h", "j"),
     """WITH x AS (SELECT quality = 1 AS h, n_chars > 1500 AS j FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (h AND j) AS n11, count(*) FILTER (h AND NOT j) AS n10, count(*) FILTER (NOT h AND j) AS n01, count(*) FILTER (NOT h AND NOT j) AS n00 FROM x),
p AS (SELECT *, CAST(n11 + n10 + n01 + n00 AS DOUBLE) AS n FROM c), q AS (SELECT *, (n11 + n00) / n AS po, ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n * n) AS pe FROM p)
SELECT n11, n10, n01, n00, round((po - pe) / (1 - pe), 6) AS kappa FROM q""")
_add("ag25_spearman", lambda s, d: A.spearman(V.load(s, d, "labels").join(V.load(s, d, "documents"), "doc_id").select(F.col("quality").cast("double").alias("q"), F.col("n_chars").cast("double").alias("c")), "q", "c"),
     """WITH x AS (SELECT CAST(quality AS DOUBLE) AS q, CAST(n_chars AS DOUBLE) AS c FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 AS a, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2 AS b FROM x)
SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""")
_add("ag26_flip_rate", _ev(lambda d: A.flip_rate(_ab(d), "ok_a", "ok_b")), f"WITH {_AB} SELECT round(avg(CASE WHEN ok_a <> ok_b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS flip_rate, count(*) AS n FROM ab")
_add("ag28_majority_vote", lambda s, d: A.majority_vote(V.load(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "role", "turn", T.vote_form("role")),
     r"""WITH v AS (SELECT conv_id, lower(role) AS norm, count(*) AS votes, arg_min(role, turn) AS answer, min(turn) AS turn
  FROM conversations GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY votes DESC, turn) AS rn FROM v) SELECT conv_id, answer, votes FROM r WHERE rn = 1""")
_add("ag31_source_counts", lambda s, d: V.documents(s, d).groupBy("source_type", "lang").agg(F.count("*").alias("n")), "SELECT source AS source_type, lang, count(*) AS n FROM documents GROUP BY 1, 2")
_add("ag34_cache_hit_rate", _ev(lambda d: d.agg(F.round(F.avg(A.flag(F.col("latency_ms") < 10)), 3).alias("hit_rate"))), f"WITH {V.EV} SELECT round(avg(CASE WHEN latency_ms < 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS hit_rate FROM ev")
_TOKENS = r"len(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda t: t <> ''))"
_add("ag35_corpus_totals", lambda s, d: V.documents(s, d).agg(F.count("*").alias("docs"), F.sum(F.size(T.tokens("content"))).alias("tokens"), F.sum(C.fixed_count(F.size(T.tokens("content")))).alias("chunks")),
     f"WITH t AS (SELECT {_TOKENS.format('text')} AS n FROM documents) SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(greatest(1, ceil((n - 50) / 150))) AS BIGINT) AS chunks FROM t")
_add("ag36_completeness", _ev(lambda d: A.completeness(d, F.col("overall_score") > 0.05)), f"""WITH {V.EV} SELECT count(*) FILTER (overall_score > 0.05) AS n_scored, count(*) AS n_total,
  round(count(*) FILTER (overall_score > 0.05) / count(*), 6) AS share, count(*) FILTER (overall_score > 0.05) / count(*) >= 0.9 AS complete FROM ev""")
_add("ag39_dominant_group", _ev(lambda d: A.dominant_group(d, "pipeline")), f"""WITH {V.EV}, g AS (SELECT pipeline, count(*) AS n, round(avg(overall_score), 6) AS s FROM ev GROUP BY 1)
SELECT (SELECT pipeline FROM g ORDER BY n DESC, pipeline DESC LIMIT 1) AS dominant, (SELECT pipeline FROM g ORDER BY s DESC, pipeline DESC LIMIT 1) AS best,
  (SELECT pipeline FROM g ORDER BY s, pipeline LIMIT 1) AS worst, round(max(s) - min(s), 6) AS gap, round(max(s) - min(s), 6) >= 0.1 AS notable FROM g""")
_add("ag42_corpus_hash", lambda s, d: A.corpus_hash(V.documents(s, d)), """SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || chr(31) || text), 1, 12)) AS HUGEINT)) AS VARCHAR) AS content_sum FROM documents""")
_add("ag43_recall_delta", _ev(lambda d: d.agg(A.mean(A.flag("answer_correct")).alias("base"), A.mean(A.flag(F.col("latency_ms") > 50)).alias("tuned")).withColumn("delta", F.round(F.col("tuned") - F.col("base"), 6))),
     f"""WITH {V.EV}, x AS (SELECT round(avg(CASE WHEN answer_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS base, round(avg(CASE WHEN latency_ms > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS tuned FROM ev)
SELECT base, tuned, round(tuned - base, 6) AS delta FROM x""")
_add("ag45_eval_summary", _ev(lambda e: A.eval_summary(e.withColumn("completeness", F.when(F.col("source_type") != 1, F.col("overall_score"))))), f"""WITH {V.EV} SELECT count(*) AS n, count(*) FILTER (answer_correct) AS correct, round(count(*) FILTER (answer_correct) / CAST(greatest(count(*), 1) AS DOUBLE), 3) AS accuracy,
  round(coalesce(avg(overall_score) FILTER (source_type <> 1), 0), 3) AS avg_completeness, round(coalesce(avg(overall_score), 0), 3) AS avg_score FROM ev""")
_add("ag40_prompt_lab", _ev(lambda e: e.groupBy("model_id").agg(A.mean(A.flag("answer_correct")).alias("accuracy"), A.mean("overall_score").alias("mean_score"), A.mean("latency_ms", 4).alias("mean_latency"))), f"""WITH {V.EV} SELECT model_id, round(avg(CASE WHEN answer_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy,
  round(avg(overall_score), 6) AS mean_score, round(avg(latency_ms), 4) AS mean_latency FROM ev GROUP BY 1""")
_add("fl16_failed_rows", _ev(lambda e: e.where(~F.col("answer_correct")).select("question_id", "pipeline")), f"WITH {V.EV} SELECT question_id, pipeline FROM ev WHERE NOT answer_correct")
_add("tk07_best_and_worst", _ev(lambda d: d.select("question_id", "overall_score", F.lit("best").alias("side")).orderBy(F.desc("overall_score"), "question_id").limit(5).unionByName(
    d.select("question_id", "overall_score", F.lit("worst").alias("side")).orderBy("overall_score", "question_id").limit(5)).withColumn("overall_score", F.round("overall_score", 6))),
    f"""WITH {V.EV}, b AS (SELECT question_id, overall_score, 'best' AS side FROM ev ORDER BY overall_score DESC, question_id LIMIT 5),
w AS (SELECT question_id, overall_score, 'worst' AS side FROM ev ORDER BY overall_score, question_id LIMIT 5)
SELECT question_id, round(overall_score, 6) AS overall_score, side FROM b UNION ALL SELECT question_id, round(overall_score, 6), side FROM w""")
_add("tk12_stratified_sample", _ev(lambda d: A.stratified(d.select("question_id", "pipeline"), ["pipeline"], 5, "question_id")), f"""WITH {V.EV}, r AS (SELECT question_id, pipeline,
  row_number() OVER (PARTITION BY pipeline ORDER BY md5('42:' || question_id), question_id) AS rn FROM ev) SELECT question_id, pipeline FROM r WHERE rn <= 5""")
_add("tk13_stratified_capped", _ev(lambda d: A.stratified(d.select("question_id", "source_type", "category", "answer_correct"), ["source_type", "category", "answer_correct"], 2, "question_id", 20)),
     f"""WITH {V.EV}, r AS (SELECT question_id, source_type, category, answer_correct, md5('42:' || question_id) AS h,
  row_number() OVER (PARTITION BY source_type, category, answer_correct ORDER BY md5('42:' || question_id), question_id) AS rn FROM ev)
SELECT question_id, source_type, category, answer_correct FROM r WHERE rn <= 2 ORDER BY h, question_id LIMIT 20""")
_add("tk11_strided_sample", lambda s, d: A.strided(V.load(s, d, "benchmark").select("item_id"), "item_id", 4, 5), "WITH r AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark) SELECT item_id FROM r WHERE i % 4 = 0 AND i < 20")
_add("tk15_latency_ranks", _ev(A.latency_ranks), f"WITH {V.EV}, a AS (SELECT model_id, round(avg(latency_ms), 6) AS avg_latency FROM ev GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY avg_latency, model_id) AS INTEGER) AS rank FROM a")
_add("wn14_average_ranks", _ev(lambda d: A.average_ranks(d.select("question_id", F.floor("latency_ms").alias("v"), "pipeline"), "v", "avg_rank", ["pipeline"])), f"""WITH {V.EV}, x AS (SELECT question_id, CAST(floor(latency_ms) AS BIGINT) AS v, pipeline FROM ev)
SELECT question_id, v, pipeline, rank() OVER (PARTITION BY pipeline ORDER BY v) + (count(*) OVER (PARTITION BY pipeline, v) - 1) / 2 AS avg_rank FROM x""")


def _pvalues(d: DataFrame) -> DataFrame:
    return d.groupBy("run_id").agg(F.round(F.avg("overall_score") / 10, 6).alias("p"))


_P = f"{V.EV}, p AS (SELECT run_id, round(avg(overall_score) / 10, 6) AS p FROM ev GROUP BY 1)"
_add("wn15_bh_fdr", _ev(lambda d: A.benjamini_hochberg(_pvalues(d), "run_id", "p")), f"""WITH {_P}, r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, run_id) AS rank FROM p),
a AS (SELECT run_id, p, min(least(1.0::DOUBLE, p * m / rank)) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS adj FROM r)
SELECT run_id, p, round(adj, 6) AS p_adjusted, adj < 0.05 AS significant FROM a""")
_add("sg06_bonferroni", _ev(lambda d: A.bonferroni(_pvalues(d), "run_id", "p")), f"WITH {_P} SELECT run_id, p, round(least(1.0::DOUBLE, p * count(*) OVER ()), 6) AS p_adjusted, least(1.0::DOUBLE, p * count(*) OVER ()) < 0.05 AS significant FROM p")
_add("jn01_runs_join", lambda s, d: V.eval_results(s, d).join(V.eval_results(s, d).select("run_id").distinct(), "run_id").groupBy("pipeline").agg(F.count("*").alias("n")),
     f"WITH {V.EV}, r AS (SELECT DISTINCT run_id FROM ev) SELECT pipeline, count(*) AS n FROM ev JOIN r USING (run_id) GROUP BY 1")
_add("jn02_questions_join", lambda s, d: V.load(s, d, "lineitem").join(V.load(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(A.mean("l_quantity").alias("avg_score"), F.count("*").alias("n")),
     "SELECT o_orderpriority, round(avg(l_quantity), 6) AS avg_score, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
_add("jn18_gap_documents", lambda s, d: V.documents(s, d).join(V.documents(s, d).groupBy("source_type").agg(F.avg(F.length("content")).alias("a")).where("a < 2200").select("source_type"), "source_type", "left_semi").groupBy("source_type").agg(F.count("*").alias("n")),
     "WITH g AS (SELECT source FROM documents GROUP BY 1 HAVING avg(length(text)) < 2200) SELECT source AS source_type, count(*) AS n FROM documents WHERE source IN (SELECT source FROM g) GROUP BY 1")
_add("jn19_unlabelled", lambda s, d: V.load(s, d, "documents").select("doc_id", "source").join(V.load(s, d, "labels").select("doc_id"), "doc_id", "left_anti"), "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
_add("fl08_uncertain_unlabelled", lambda s, d: V.eval_results(s, d).where(F.col("overall_score").between(0.3, 0.7)).select("question_id").join(V.load(s, d, "labels").select(F.col("doc_id").alias("question_id")), "question_id", "left_anti"),
     f"WITH {V.EV} SELECT question_id FROM ev WHERE overall_score BETWEEN 0.3 AND 0.7 AND question_id NOT IN (SELECT doc_id FROM labels)")
_add("cl01_challenge", _ev(lambda d: E.evaluate_challenge(d, {"metric": "overall_score", "operator": "gte", "target": 0.2, "filter": {"category": 1}, "constraint": {"metric": "latency_ms", "operator": "lt", "target": 200.0}})),
     f"WITH {V.EV} SELECT round(avg(overall_score), 6) AS value, count(*) AS n, coalesce(round(avg(overall_score), 6) >= 0.2, false) AND coalesce(round(avg(latency_ms), 6) < 200, false) AS passed FROM ev WHERE category = 1")
_add("co01_call_costs", lambda s, d: E.call_costs(V.cost_records(s, d).drop("cost_usd"), s.createDataFrame([("A", 3.0, 15.0), ("N", 0.25, 1.25)], "model_id string, input_price double, output_price double"), 0.0005).groupBy("model_id", "alert").agg(F.round(F.sum("cost_usd"), 6).alias("cost"), F.count("*").alias("n")),
     f"""WITH {V.COST}, p AS (SELECT * FROM (VALUES ('A', 3.0::DOUBLE, 15.0::DOUBLE), ('N', 0.25::DOUBLE, 1.25::DOUBLE)) t(model_id, i, o)),
c AS (SELECT cost.model_id, round((input_tokens * coalesce(i, 0) + output_tokens * coalesce(o, 0)) / 1000000, 9) AS c FROM cost LEFT JOIN p USING (model_id))
SELECT model_id, c > 0.0005 AS alert, round(sum(c), 6) AS cost, count(*) AS n FROM c GROUP BY 1, 2""")

# Text

_add("sf04_document_stats", lambda s, d: D.normalise(V.documents(s, d)).select("id", "char_count", "word_count", "version"), rf"""WITH t AS (SELECT doc_id AS id, regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS c FROM documents)
SELECT id, CAST(length(c) AS INTEGER) AS char_count, CAST({_TOKENS.format('c')} AS INTEGER) AS word_count, substr(sha256(c), 1, 8) AS version FROM t""")
_add("sf07_clean_query", lambda s, d: V.load(s, d, "conversations").select("conv_id", "turn", T.clean_query("text").alias("query")), r"""WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, substr(CASE WHEN t <> '' AND right(t, 1) NOT IN ('?', '.', '!') AND regexp_matches(lower(t), '^(what|how|why|when|where|who|which|is|are|do|does|can)') THEN t || '?' ELSE t END, 1, 512) AS query FROM t""")
_add("sf08_pii_kinds", lambda s, d: V.load(s, d, "documents").select("doc_id", F.array_join(T.pii_kinds("text"), ",").alias("kinds")).where("kinds <> ''"), "WITH k AS (SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in T.PII_PATTERNS.items()) + ") AS kinds FROM documents) SELECT * FROM k WHERE kinds <> ''")
_SENT = r"list_filter(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_add("sf09_sentences", lambda s, d: V.load(s, d, "documents").select("doc_id", T.sentences("text").alias("x")).select("doc_id", F.size("x").alias("n"), F.sha2(F.array_join("x", "|"), 256).alias("h")),
     f"WITH t AS (SELECT doc_id, {_SENT.format('text')} AS x FROM documents) SELECT doc_id, CAST(len(x) AS INTEGER) AS n, sha256(array_to_string(x, '|')) AS h FROM t")
_add("sf10_containment", lambda s, d: E.containment(V.load(s, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), V.load(s, d, "benchmark").select(F.col("item_id").alias("sought_id"), F.col("text").alias("phrase"))).groupBy(F.col("sought_id").alias("item_id")).agg(F.count("*").alias("n"), F.min("text_id").alias("first_doc")),
     "SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(trim(b.text))) WHERE trim(b.text) <> '' GROUP BY 1")
_add("sf12_error_rates", lambda s, d: E.error_rates(V.load(s, d, "benchmark").select("item_id", F.regexp_replace("text", " the ", " a ").alias("p"), F.col("text").alias("t")), "p", "t").select("item_id", "cer", "wer"))
_add("sf25_previews", lambda s, d: V.load(s, d, "documents").select("doc_id", F.substring("text", 1, 80).alias("preview"), T.approx_tokens("text").alias("tokens")), "SELECT doc_id, substr(text, 1, 80) AS preview, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents")
_add("sf30_intent", lambda s, d: V.load(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.intent("text").alias("i")).select("conv_id", "turn", "i.label", "i.method", "i.confidence"),
     rf"""WITH t AS (SELECT conv_id, turn, trim(lower(text)) AS t, {_TOKENS.format('text')} AS n FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, turn,
  CAST(n < 15 AS INTEGER) + CAST(NOT (contains(t, 'compare') OR contains(t, 'difference') OR contains(t, 'between') OR contains(t, 'changed') OR contains(t, 'conflict') OR contains(t, 'multiple') OR contains(t, 'across')
    OR contains(t, 'summarize') OR contains(t, 'when did') OR contains(t, 'why did') OR contains(t, 'trace') OR contains(t, 'history')) AS INTEGER) + CAST(t LIKE '%?' OR n <= 10 AS INTEGER) AS p FROM t)
SELECT conv_id, turn, CASE WHEN p = 3 THEN 'simple' ELSE 'complex' END AS label, 'rule' AS method, round(CASE p WHEN 3 THEN 0.9::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END, 6) AS confidence FROM f""")
_add("sf31_freshness", lambda s, d: V.load(s, d, "orders").select("o_orderkey", F.round(T.freshness(F.col("o_orderdate"), F.lit("1998-08-02").cast("date")), 6).alias("fresh")),
     """WITH t AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS d FROM orders)
SELECT o_orderkey, round(CASE WHEN d IS NULL THEN 0.5::DOUBLE WHEN d <= 30 THEN 1.0::DOUBLE WHEN d <= 180 THEN 1 - (d - 30) / 150 * 0.5::DOUBLE ELSE 0.3::DOUBLE END, 6) AS fresh FROM t""")
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_add("sf34_norms", lambda s, d: V.vectors(s, d).select("chunk_id", F.round(T.norm(F.col("vec")), 6).alias("norm")), "SELECT vec_id AS chunk_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
_add("sf36_int8", lambda s, d: V.vectors(s, d).select("chunk_id", F.aggregate(T.int8(F.col("vec")), F.lit(0), lambda a, x: a + x).alias("total"), F.aggregate(T.signs(F.col("vec")), F.lit(0), lambda a, x: a + x).alias("positive")),
     """SELECT vec_id AS chunk_id, CAST(list_sum(list_transform(embedding, lambda x: greatest(-128, least(127, CAST(round_even(CAST(x AS DOUBLE) * 127, 0) AS INTEGER))))) AS INTEGER) AS total,
  CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive FROM embeddings""")
_add("sc06_html_text", lambda s, d: V.load(s, d, "pages").select("page_id", F.length(T.html_text("html")).alias("n"), F.sha2(T.html_text("html"), 256).alias("h")), r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', chr(10), 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', chr(10), 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(t, '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM c)
SELECT page_id, CAST(length(t) AS INTEGER) AS n, sha256(t) AS h FROM d""")
_add("st05_exact_dedup", lambda s, d: D.exact(V.documents(s, d)).select("id"), "SELECT min(doc_id) AS id FROM documents GROUP BY sha256(text)")
_add("ch01_fixed_chunks", lambda s, d: C.fixed(V.documents(s, d)).select("id", F.sha2("content", 256).alias("h")), r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS t FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> ''),
e AS (SELECT doc_id, t, unnest(range(0, len(t), 150)) AS p0 FROM t)
SELECT doc_id || '_chunk_' || CAST(p0 / 150 AS INTEGER) AS id, sha256(array_to_string(t[p0 + 1 : p0 + 200], ' ')) AS h FROM e""")
_add("ch02_sentence_chunks", lambda s, d: C.sentence(V.documents(s, d)).select("id", F.size(T.tokens("content")).alias("n")), rf"""WITH RECURSIVE t AS (SELECT doc_id, {_SENT.format("regexp_replace(text, '^\\s+|\\s+$', '', 'g')")} AS x FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> ''),
s AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM t), n AS (SELECT doc_id, i, {_TOKENS.format('x')} AS n FROM s),
r AS (SELECT doc_id, i, 0 AS c, n AS acc FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, CASE WHEN r.acc > 0 AND r.acc + n.n > 200 THEN r.c + 1 ELSE r.c END, CASE WHEN r.acc > 0 AND r.acc + n.n > 200 THEN n.n ELSE r.acc + n.n END FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + 1)
SELECT doc_id || '_chunk_' || c AS id, CAST(max(acc) AS INTEGER) AS n FROM r GROUP BY doc_id, c""")
_add("ch05_recursive_chunks", lambda s, d: C.recursive(V.documents(s, d)).select("id", F.length("content").alias("n"), F.sha2("content", 256).alias("h")))
_add("sf29_token_counts", lambda s, d: C.token_counts(C.token_counts(V.documents(s, d)), kind="approx", out="n_approx").select("id", "n_tokens", "n_approx"), f"SELECT doc_id AS id, coalesce({_TOKENS.format('text')}, 0) AS n_tokens, CAST(coalesce(length(text) // 4, 0) AS INTEGER) AS n_approx FROM documents")
_add("ch06_whole_chunks", lambda s, d: C.whole(V.documents(s, d)).select("id", "doc_id", F.length("content").alias("n")), r"SELECT doc_id || '_chunk_0' AS id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(length(text) AS INTEGER) AS n FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> ''")
_add("ch09_boundaries", lambda s, d: C.boundary_diagnosis(C.fixed(V.documents(s, d))).groupBy("doc_id").agg(F.count_if("mid_clause").alias("mid_clause_splits"), F.count_if("mid_list").alias("mid_list_splits")), r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS t FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> ''),
e AS (SELECT doc_id, t, unnest(range(0, len(t), 150)) AS p0 FROM t), c AS (SELECT doc_id, p0, array_to_string(t[p0 + 1 : p0 + 200], ' ') AS own FROM e),
n AS (SELECT *, lead(own) OVER (PARTITION BY doc_id ORDER BY p0) AS next FROM c)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) FILTER (next IS NOT NULL AND NOT regexp_matches(own, '[.!?]["''\)\]]?\s*$')) AS mid_clause_splits,
  count(*) FILTER (next IS NOT NULL AND regexp_matches(own, '^\s*(\d+[.)]|[-*•])\s') AND NOT regexp_matches(next, '^\s*(\d+[.)]|[-*•])\s')) AS mid_list_splits FROM n GROUP BY 1""")
_add("sf18_code_presence", lambda s, d: V.load(s, d, "documents").select("doc_id", T.has_code("text").alias("has_code")), r"SELECT doc_id, regexp_matches(text, '`[^`]+`|\bdef\b|\bfunction\b|\bclass\b|[{};]|=>') AS has_code FROM documents")
_add("sf17_vote_form", lambda s, d: V.load(s, d, "conversations").select("conv_id", "turn", T.vote_form(F.concat(F.lit("  Re [ab-1]\n "), "text", F.lit(" [c_2]"))).alias("form")), r"SELECT conv_id, turn, regexp_replace(regexp_replace(lower('Re [ab-1]' || chr(10) || ' ' || text || ' [c_2]'), '\[[\w-]+\]', '', 'g'), '\s+', ' ', 'g') AS form FROM conversations")
_add("sf15_answers", lambda s, d: _replies(s, d).select("conv_id", "turn", T.extract_answer("reply").alias("answer")), r"""WITH r AS (SELECT conv_id, turn, text, turn % 5 AS k FROM conversations), w AS (SELECT *, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS t FROM r)
SELECT conv_id, turn, CASE k WHEN 0 THEN t WHEN 1 THEN 'so ' || t WHEN 2 THEN t || chr(10) || 'In conclusion: no' WHEN 3 THEN 'not ' || t ELSE t END AS answer FROM w""")
_add("sf26_failures", _ev(lambda e: e.select("question_id", T.failure_hypothesis(F.col("answer_correct"), F.when(F.col("source_type") == 1, 0.0).otherwise(F.col("overall_score"))).alias("cause")).groupBy("cause").agg(F.count("*").alias("n"))), f"""WITH {V.EV}, c AS (SELECT answer_correct, CASE WHEN source_type = 1 THEN 0.0::DOUBLE ELSE overall_score END AS c FROM ev)
SELECT CASE WHEN answer_correct THEN 'none' WHEN c >= 0.5 THEN 'generation' WHEN c > 0 THEN 'mixed' ELSE 'retrieval' END AS cause, count(*) AS n FROM c GROUP BY 1""")

# Retrieval


def _questions(s, d) -> DataFrame:
    return V.load(s, d, "benchmark").select((F.col("item_id") * 100).alias("question_id"), "text")


def _sparse(s, d, k: int = 3) -> DataFrame:
    return R.bm25_scan(_questions(s, d), V.documents(s, d), k)


_BM25 = f"""tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS t FROM documents),
post AS (SELECT term, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY 1, 2, 3),
nn AS (SELECT count(*) AS n, avg(len(t)) AS al FROM tok), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, al FROM df, nn), mi AS (SELECT avg(raw) AS m FROM raw),
st AS (SELECT term, al, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw, mi),
qt AS (SELECT item_id, term, count(*) AS qn FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS term FROM benchmark) GROUP BY 1, 2),
bs AS (SELECT item_id * 100 AS question_id, doc_id AS chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al)) * qn), 6) AS score FROM qt JOIN st USING (term) JOIN post USING (term) GROUP BY 1, 2),
sparse AS (SELECT question_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM bs)"""
_add("ix01_bm25", lambda s, d: SP.search_once(V.documents(s, d), _questions(s, d), 3), f"WITH {_BM25} SELECT * FROM sparse WHERE rank <= 3")


def _qvecs(s, d) -> DataFrame:
    return V.vectors(s, d).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("question_id"), F.col("vec").alias("qvec"))


_NORM = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
_COS = f"CASE WHEN {_NORM.format('q.embedding')} * {_NORM.format('v.embedding')} = 0 THEN 0 ELSE {_DOT.format('q.embedding', 'v.embedding')} / ({_NORM.format('q.embedding')} * {_NORM.format('v.embedding')}) END"


def _dense_sql(score: str = _COS, where: str = "true", k: int = 5) -> str:
    return f"""s AS (SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, round({score}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND {where}),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s)"""


_add("jn06_dense_topk", lambda s, d: R.dense(_qvecs(s, d), V.vectors(s, d), 5), f"WITH {_dense_sql()} SELECT * FROM dense WHERE rank <= 5")
_add("ix02_distance_score", lambda s, d: R.dense(_qvecs(s, d), V.vectors(s, d), 5, "distance"), f"WITH {_dense_sql(f'(1 + {_COS}) / 2')} SELECT * FROM dense WHERE rank <= 5")
_add("ix04_flat_dot", lambda s, d: R.dense(_qvecs(s, d), V.vectors(s, d), 5, "dot"), f"WITH {_dense_sql(_DOT.format('q.embedding', 'v.embedding'))} SELECT * FROM dense WHERE rank <= 5")
_add("ix06_filtered_topk", lambda s, d: R.dense(_qvecs(s, d), V.vectors(s, d), 5, keep=F.col("source_type") < 3), f"WITH {_dense_sql(where='v.label < 3')} SELECT * FROM dense WHERE rank <= 5")
_add("tk06_filter_after", lambda s, d: R.dense(_qvecs(s, d), V.vectors(s, d), 5, keep=F.col("source_type") < 3, filter_after=True), f"""WITH {_dense_sql()}, f AS (SELECT d.question_id, d.chunk_id, d.score,
  CAST(row_number() OVER (PARTITION BY d.question_id ORDER BY d.score DESC, d.chunk_id) AS INTEGER) AS rank FROM dense d JOIN embeddings e ON e.vec_id = d.chunk_id WHERE d.rank <= 10 AND e.label < 3) SELECT * FROM f WHERE rank <= 5""")


def _ivf(s, d):
    ivf = R.IVF(8, 4)
    listed = ivf.build(V.vectors(s, d))
    return R.recall(ivf.search(_qvecs(s, d), listed, 5), R.dense(_qvecs(s, d), V.vectors(s, d), 5))


_add("ix04_ivf_recall", _ivf)


def _recall_row(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Recall of an approximate search, and whether it reaches 0.9."""
    return R.recall(found, exact).withColumn("enough", F.col("recall") >= 0.9)


def _quantised(s, d):
    pq = X.ProductQuantised()
    return _recall_row(pq.search(_qvecs(s, d), pq.build(V.vectors(s, d)), V.vectors(s, d), 5), R.dense(_qvecs(s, d), V.vectors(s, d), 5))


def _neighbours(s, d):
    g = X.NeighbourGraph()
    return _recall_row(g.search(_qvecs(s, d), g.build(V.vectors(s, d)), V.vectors(s, d), 5), R.dense(_qvecs(s, d), V.vectors(s, d), 5))


_add("ix04_pq_recall", _quantised)
_add("ix04_graph_recall", _neighbours)


def _token_vectors(s, d) -> tuple[DataFrame, DataFrame]:
    """Three tokens a question, five a chunk."""
    v = V.vectors(s, d)
    q = v.where("chunk_id % 100 < 3").select((F.col("chunk_id") - F.col("chunk_id") % 100).alias("question_id"), (F.col("chunk_id") % 100).alias("qpos"), F.col("vec").alias("qvec"))
    return q, v.select(F.floor(F.col("chunk_id") / 5).alias("chunk_id"), "vec")


def _late(s, d):
    (q, t), li = _token_vectors(s, d), X.LateInteraction()
    return _recall_row(li.search(q, li.build(t), t, 3), R.max_sim(q, t, 3))


_add("ix18_late_recall", _late)


def _two_lists(s, d):
    return R.dense(_qvecs(s, d), V.vectors(s, d), 15), _sparse(s, d, 15)


_RRF = """u AS (SELECT question_id, chunk_id, rank FROM dense WHERE rank <= 15 UNION ALL SELECT question_id, chunk_id, rank FROM sparse WHERE rank <= 15),
f AS (SELECT question_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM f)"""
_add("ix12_hybrid_rrf", lambda s, d: R.rrf(list(_two_lists(s, d)), 5), f"WITH {_BM25}, {_dense_sql()}, {_RRF} SELECT * FROM fr WHERE rank <= 5")
_add("ix13_hybrid_weighted", lambda s, d: R.weighted(*_two_lists(s, d), 5), f"""WITH {_BM25}, {_dense_sql()},
a AS (SELECT question_id, chunk_id, score, min(score) OVER w AS lo, max(score) OVER w AS hi, 0.7::DOUBLE AS w FROM dense WHERE rank <= 15 WINDOW w AS (PARTITION BY question_id)),
b AS (SELECT question_id, chunk_id, score, min(score) OVER w AS lo, max(score) OVER w AS hi, 0.3::DOUBLE AS w FROM sparse WHERE rank <= 15 WINDOW w AS (PARTITION BY question_id)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT question_id, chunk_id, round(sum(CASE WHEN hi = lo THEN 0.5 ELSE (score - lo) / (hi - lo) END * w), 6) AS score FROM u GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= 5""")
_add("ix14_legacy_hybrid", lambda s, d: R.legacy_hybrid(*_two_lists(s, d), V.vectors(s, d).where("source_type < 5").select("chunk_id"), 5), f"""WITH {_BM25}, {_dense_sql()}, {_RRF},
k AS (SELECT f.question_id, f.chunk_id, f.score, CAST(row_number() OVER (PARTITION BY f.question_id ORDER BY f.score DESC, f.chunk_id) AS INTEGER) AS rank FROM fr f JOIN embeddings e ON e.vec_id = f.chunk_id AND e.label < 5 WHERE f.rank <= 10)
SELECT * FROM k WHERE rank <= 5""")
_add("wn06_document_cap", lambda s, d: R.cap_per_document(R.dense(_qvecs(s, d), V.vectors(s, d), 15), V.vectors(s, d).select("chunk_id", F.col("source_type").alias("doc_id")), 5, 2), f"""WITH {_dense_sql()},
c AS (SELECT question_id, chunk_id, score, label AS doc_id, row_number() OVER (PARTITION BY question_id, label ORDER BY score DESC, chunk_id) AS r FROM dense JOIN embeddings e ON e.vec_id = chunk_id WHERE rank <= 15),
k AS (SELECT question_id, chunk_id, doc_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM c WHERE r <= 2) SELECT * FROM k WHERE rank <= 5""")
_add("tr01_retrieval_trust", lambda s, d: R.retrieval_trust(R.dense(_qvecs(s, d), V.vectors(s, d), 5)), f"""WITH {_dense_sql()}, t AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM dense WHERE rank <= 5 WINDOW w AS (PARTITION BY question_id))
SELECT question_id, rank, chunk_id, score, round((score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 4) AS trust FROM t""")
_add("fl07_confidence_gate", lambda s, d: R.confidence_gate(R.retrieval_trust(R.dense(_qvecs(s, d), V.vectors(s, d), 5)), 0.4), f"""WITH {_dense_sql()}, t AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM dense WHERE rank <= 5 WINDOW w AS (PARTITION BY question_id)),
g AS (SELECT question_id, round(avg(round((score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 4)), 4) AS avg_trust FROM t GROUP BY 1) SELECT *, CASE WHEN avg_trust < 0.4 THEN 'fallback' ELSE 'answer' END AS action FROM g""")


def _recall(s, d):
    hits = _sparse(s, d, 5).join(V.documents(s, d).select(F.col("id").alias("chunk_id"), "content"), "chunk_id").join(_questions(s, d).withColumnRenamed("text", "ground_truth"), "question_id")
    return E.recall_at_k(hits)


_add("ev03_recall_at_k", _recall, f"""WITH {_BM25}, h AS (SELECT s.question_id, s.rank, contains(lower(d.text), lower(trim(b.text))) AS hit FROM sparse s JOIN documents d ON d.doc_id = s.chunk_id JOIN benchmark b ON b.item_id * 100 = s.question_id WHERE s.rank <= 5)
SELECT question_id, coalesce(bool_or(hit) FILTER (rank <= 1), false) AS recall_at_1, coalesce(bool_or(hit) FILTER (rank <= 3), false) AS recall_at_3, coalesce(bool_or(hit) FILTER (rank <= 5), false) AS recall_at_5 FROM h GROUP BY 1""")


def _relevant(s, d):
    v = V.vectors(s, d)
    return _qvecs(s, d).join(v.select(F.col("chunk_id").alias("question_id"), F.col("source_type").alias("l")), "question_id").join(v.select("chunk_id", "source_type"), F.col("l") == F.col("source_type")).where("chunk_id <> question_id").select("question_id", "chunk_id")


_REL = "rel AS (SELECT q.vec_id AS question_id, v.vec_id AS chunk_id FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)"
_add("ev10_recall_by_id", lambda s, d: E.recall_by_id(R.dense(_qvecs(s, d), V.vectors(s, d), 10), _relevant(s, d), 3), f"""WITH {_dense_sql()}, {_REL} SELECT d.question_id,
  max(CASE WHEN d.rank <= 3 AND r.chunk_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS recall FROM dense d LEFT JOIN rel r USING (question_id, chunk_id) WHERE d.rank <= 10 GROUP BY 1""")
_add("ev11_mrr", lambda s, d: E.mrr(R.dense(_qvecs(s, d), V.vectors(s, d), 10), _relevant(s, d)), f"""WITH {_dense_sql()}, {_REL} SELECT d.question_id, round(coalesce(1.0::DOUBLE / min(CASE WHEN r.chunk_id IS NOT NULL THEN d.rank END), 0), 6) AS mrr
  FROM dense d LEFT JOIN rel r USING (question_id, chunk_id) WHERE d.rank <= 10 GROUP BY 1""")
_add("em02_vector_check", lambda s, d: R.sane_vectors(V.vectors(s, d)), "SELECT count(*) AS n, count(*) FILTER (list_sum(list_transform(embedding, lambda x: abs(x))) = 0) AS n_zero, CAST(min(len(embedding)) AS INTEGER) AS min_dim, CAST(max(len(embedding)) AS INTEGER) AS max_dim FROM embeddings")
_add("me01_memory_context", lambda s, d: R.memory_context(V.load(s, d, "conversations"), 5), """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context FROM r WHERE back <= 5 GROUP BY 1""")
_add("wn12_last_turns", lambda s, d: R.last_turns(V.load(s, d, "conversations").select("conv_id", "turn"), 3), "WITH r AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back FROM conversations) SELECT * FROM r WHERE back <= 3")
_add("ca02_semantic_cache", lambda s, d: R.semantic_cache(_qvecs(s, d).withColumns({"backend": F.lit("b"), "top_k": F.lit(5)}), V.vectors(s, d).where("chunk_id % 100 <> 0").select(F.col("chunk_id").alias("cache_id"), "vec", F.lit("b").alias("backend"), F.lit(5).alias("top_k")), 0.3),
     f"WITH {_dense_sql(where='v.vec_id % 100 <> 0')} SELECT question_id, chunk_id AS cache_id, score FROM dense WHERE rank = 1 AND score >= 0.3")
_add("ix19_route", lambda s, d: R.route_by_size(V.documents(s, d)), f"WITH t AS (SELECT CAST(sum({_TOKENS.format('text')}) AS BIGINT) AS tokens FROM documents) SELECT tokens, CASE WHEN tokens <= 80000 THEN 'cag' WHEN tokens <= 10000000 THEN 'rag' ELSE 'rlm' END AS route FROM t")
_add("ix17_page_index", lambda s, d: R.page_index(_questions(s, d), C.whole(V.documents(s, d)), 3).select("question_id", "rank", "chunk_id", "score"), rf"""WITH q AS (SELECT item_id * 100 AS question_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS w FROM benchmark),
u AS (SELECT question_id, w, count(*) AS m, sum(count(*)) OVER (PARTITION BY question_id) AS n FROM q GROUP BY 1, 2), d AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, lower(text) AS t, {_TOKENS.format('text')} AS words FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> ''),
f AS (SELECT x.w, d.chunk_id, d.words, (length(t) - length(replace(t, x.w, ''))) // length(x.w) AS f FROM (SELECT DISTINCT w FROM u) x JOIN d ON contains(d.t, x.w)),
s AS (SELECT question_id, chunk_id, round(0.7::DOUBLE * sum(m) / max(n) + 0.3::DOUBLE * least(CAST(sum(f * m) AS DOUBLE) / max(words), 1), 6) AS score FROM u JOIN f USING (w) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) SELECT question_id, rank, chunk_id, score FROM r WHERE rank <= 3""")


def _graph(s, d):
    e = R.entity_edges(R.entities(V.documents(s, d)))
    return e.groupBy("src").agg(F.count("*").alias("neighbours"), F.sum("weight").alias("weight"))


_add("ix15_entity_edges", _graph, r"""WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?:^|[^\p{L}\p{M}\p{Nd}_])([A-Z]\p{L}+(?: [A-Z]\p{L}+)*)', 1))) AS e FROM documents),
p AS (SELECT a.e AS src, b.e AS dst, count(*) AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.e <> b.e GROUP BY 1, 2) SELECT src, count(*) AS neighbours, CAST(sum(weight) AS BIGINT) AS weight FROM p GROUP BY 1""")


def _stores(s, d):
    """The same search by three stores, over documents thirty times as long."""
    docs = V.documents(s, d).select(F.col("id").alias("chunk_id"), F.col("id").cast("string").alias("doc_id"), F.repeat("content", 30).alias("content"), F.col("source_type"), (F.col("id") % 4).alias("chunk_index"))
    v = V.vectors(s, d).drop("source_type").join(docs.select("chunk_id", "source_type"), "chunk_id")
    q, out = _qvecs(s, d), None
    for name in ("milvus", "pinecone", "qdrant"):
        h = AD.store_search(name, q, {"vectors": v, "chunks": docs}, 5, "src3").select(F.lit(name).alias("store"), "question_id", "rank", "chunk_id", "score", F.length("content").alias("kept"), "chunk_index", "source_type")
        out = h if out is None else out.unionByName(h)
    return out


_add("ix07_store_fields", _stores, f"""WITH {_dense_sql(where="EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = v.vec_id AND x.source = 'src3')")}
SELECT store, question_id, rank, chunk_id, score, CAST(least(30 * length(text), most) AS INTEGER) AS kept, CASE WHEN store = 'milvus' THEN 0 ELSE CAST(chunk_id % 4 AS INTEGER) END AS chunk_index, source AS source_type
FROM dense JOIN documents ON doc_id = chunk_id, (VALUES ('milvus', 65000), ('pinecone', 40000), ('qdrant', 1000000000)) AS stores(store, most) WHERE rank <= 5""")

_ENTITY = r"(?:^|[^\p{L}\p{M}\p{Nd}_])([A-Z]\p{L}+(?: [A-Z]\p{L}+)*)"


def _graph_hits(s, d):
    """Questions by the entities of their texts and by the vector of their id."""
    docs, v = V.documents(s, d), V.vectors(s, d)
    q = V.load(s, d, "benchmark").select(F.col("item_id").alias("question_id"), "text").join(v.select(F.col("chunk_id").alias("question_id"), F.col("vec").alias("qvec")), "question_id")
    m = R.entities(docs)
    own = R.entities(q, "question_id", "text").withColumnRenamed("chunk_id", "question_id")
    q = q.select("question_id", "qvec")
    return R.graph_retrieve(q, own, R.entity_edges(m), m, v, 5, R.dense(q, v, 5))


_add("ix16_graph_retrieve", _graph_hits, rf"""WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_ENTITY}', 1))) AS e FROM documents),
p AS (SELECT a.e AS src, b.e AS dst, count(*) AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.e <> b.e GROUP BY 1, 2),
qe AS (SELECT item_id AS q, unnest(list_distinct(regexp_extract_all(text, '{_ENTITY}', 1))) AS e FROM benchmark),
n AS (SELECT q, dst AS e FROM (SELECT q, dst, row_number() OVER (PARTITION BY q, e ORDER BY weight DESC, dst) AS r FROM qe JOIN p ON p.src = qe.e) WHERE r <= 10),
c AS (SELECT DISTINCT q, doc_id FROM (SELECT * FROM qe UNION SELECT * FROM n) JOIN m USING (e)),
s AS (SELECT b.item_id AS question_id, v.vec_id AS chunk_id, round({_COS}, 6) AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v),
g AS (SELECT s.*, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s JOIN c ON c.q = question_id AND c.doc_id = chunk_id),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s WHERE question_id NOT IN (SELECT question_id FROM g))
SELECT question_id, rank, chunk_id, score FROM g WHERE rank <= 5 UNION ALL SELECT question_id, rank, chunk_id, score FROM f WHERE rank <= 5""")


def _naive(s, d):
    docs = V.documents(s, d)
    chunks = docs.withColumn("doc_id", F.col("id"))
    out = P.naive(_questions(s, d), lambda q, k: R.bm25_scan(q, docs, k), chunks, AD.Extract(), P.Config(top_k=3, trust_threshold=0.1))
    return out["answers"].join(out["gate"], "question_id")


_add("pl01_naive", _naive)
_add("pl08_cag", lambda s, d: P.cag(V.documents(s, d), 1 << 40).select("id", "total"), "SELECT doc_id AS id, CAST(sum(greatest(1, length(text) // 4)) OVER (ORDER BY doc_id) AS BIGINT) AS total FROM documents")
_add("jn10_similar_questions", lambda s, d: D.similar_pairs(V.load(s, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content")), 0.9),
     r"""WITH t AS (SELECT conv_id * 1000 + turn AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> ''))) AS s FROM conversations WHERE role = 'user'),
j AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS n FROM t x JOIN t y ON x.id < y.id WHERE len(x.s) > 0 AND len(y.s) > 0)
SELECT a, b, round(CAST(i AS DOUBLE) / (n - i), 6) AS similarity FROM j WHERE round(CAST(i AS DOUBLE) / (n - i), 6) >= 0.9""")


def _near(s, d):
    docs = V.documents(s, d)
    return D.near_documents(docs)


_add("jn09_near_documents", _near, r"""WITH t AS (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS w FROM documents),
u AS (SELECT doc_id, source, len(w) AS wc, list_distinct(w) AS s FROM t),
j AS (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS n, x.wc AS wa, y.wc AS wb FROM u x JOIN u y ON x.source = y.source AND x.doc_id < y.doc_id WHERE abs(x.wc - y.wc) <= 0.05 * greatest(x.wc, y.wc))
SELECT a, b, round(CAST(i AS DOUBLE) / (n - i), 6) AS similarity FROM j WHERE round(CAST(i AS DOUBLE) / (n - i), 6) > 0.85""")
def _turn_pairs(s, d) -> DataFrame:
    """User turns as questions, the next turn as the answer."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return V.load(s, d, "conversations").withColumn("answer", nxt).where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


_add("qc01_question_gates", lambda s, d: E.question_gates(_turn_pairs(s, d).withColumn("kind", F.lit("factual"))).groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n")),
     rf"""WITH p AS (SELECT role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
t AS (SELECT text AS q, a, {_TOKENS.format('text')} AS n FROM p WHERE role = 'user'),
r AS (SELECT CASE WHEN n < 4 THEN 'too_short' WHEN trim(coalesce(a, '')) = '' THEN 'empty_answer' WHEN contains(lower(q), lower(trim(a))) THEN 'leakage' END AS reason FROM t) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
_add("sk04_upsert", lambda s, d: A.top_per_group(V.eval_results(s, d).select("user_id", "pipeline", "question_id", F.round("overall_score", 6).alias("score")), ["user_id", "pipeline"], [F.desc("question_id")]).drop("rank"),
     f"WITH {V.EV}, r AS (SELECT user_id, pipeline, question_id, round(overall_score, 6) AS score, row_number() OVER (PARTITION BY user_id, pipeline ORDER BY question_id DESC) AS rn FROM ev) SELECT user_id, pipeline, question_id, score FROM r WHERE rn = 1")
_add("sk08_experiment_ids", lambda s, d: V.load(s, d, "nation").select("n_name", W.experiment_id(F.col("n_name")).alias("id")), "SELECT n_name, substr(sha256(n_name), 1, 16) AS id FROM nation")
_add("sc16_subset_cap", lambda s, d: S.benchmark_questions(V.load(s, d, "documents").select(F.element_at(F.array(*[F.lit(x) for x in ("hotpotqa", "msmarco", "nq", "fiqa", "other")]), (F.col("doc_id") % 5 + 1).cast("int")).alias("subset"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("query_id"), F.col("source").alias("text"), F.col("lang").alias("answer")), 50), """WITH t AS (SELECT ['hotpotqa', 'msmarco', 'nq', 'fiqa', 'other'][doc_id % 5 + 1] AS subset, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS q, source, lang FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY q) AS rn FROM t)
SELECT subset || '_' || q AS id, source AS text, lang AS ground_truth, 'all' AS source_type, CASE subset WHEN 'hotpotqa' THEN 'multi_hop' WHEN 'fiqa' THEN 'analytical' ELSE 'factual' END AS category FROM r WHERE rn <= 50""")
_add("fl01_source_filter", lambda s, d: V.load(s, d, "documents").select("doc_id", F.concat_ws(", ", "source", "lang").alias("src")).where(S.source_match("src", ["src1", "fr"])), "SELECT doc_id, source || ', ' || lang AS src FROM documents WHERE source = 'src1' OR lang = 'fr'")
_add("st01_rate_limits", lambda s, d: L.per_minute(V.load(s, d, "events"), width="1 day", limit=3), """SELECT date_trunc('day', ts) AS window_start, user_id, count(*) AS n, count(*) > 3 AS limited FROM events GROUP BY 1, 2""")
_add("st02_tumbling", lambda s, d: L.windowed(V.load(s, d, "events"), "ts", "1 hour", None, "event_type", "value"), "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
_add("st03_circuit_breaker", lambda s, d: L.circuit_breaker(V.load(s, d, "events").select(F.col("event_type").alias("provider"), "ts", (F.col("value") > 30).alias("ok"))).groupBy("provider", "state").agg(F.count("*").alias("n")), """WITH RECURSIVE e AS (SELECT event_type AS provider, epoch_us(ts) / 1000000.0::DOUBLE AS t, value > 30 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY ts, value > 30) AS i FROM events),
r AS (SELECT provider, i, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS fails, -1.0::DOUBLE AS opened FROM e WHERE i = 1
  UNION ALL SELECT e.provider, e.i, s.state, CASE WHEN s.state = 'open' THEN r.fails WHEN e.ok THEN 0 ELSE r.fails + 1 END,
    CASE WHEN s.state = 'open' THEN r.opened WHEN e.ok THEN -1.0::DOUBLE WHEN s.state = 'half_open' OR r.fails + 1 >= 3 THEN e.t ELSE -1.0::DOUBLE END
  FROM r JOIN e ON e.provider = r.provider AND e.i = r.i + 1, LATERAL (SELECT CASE WHEN r.opened >= 0 AND e.t - r.opened >= 30 THEN 'half_open' WHEN r.opened >= 0 THEN 'open' ELSE 'closed' END AS state) s)
SELECT provider, state, count(*) AS n FROM r GROUP BY 1, 2""")
_add("sg01_bootstrap", _ev(lambda d: E.bootstrap(d, "pipeline", "overall_score", 200, key="question_id")))
_add("sg07_matrix", _ev(lambda d: E.pairwise_matrix(d, "user_id", "pipeline", "overall_score")))
_add("cb01_platt", _ev(lambda d: E.recalibrate(d.select("question_id", "overall_score", "answer_correct"), "overall_score", "answer_correct", "platt").select("question_id", F.round("calibrated", 4).alias("calibrated"))))
_add("cb02_isotonic", _ev(lambda d: E.recalibrate(d.select("question_id", "overall_score", "answer_correct"), "overall_score", "answer_correct", "isotonic").select("question_id", F.round("calibrated", 4).alias("calibrated"))))
_add("cb03_temperature", _ev(lambda d: E.recalibrate(d.select("question_id", "overall_score", "answer_correct"), "overall_score", "answer_correct", "temperature").select("question_id", F.round("calibrated", 4).alias("calibrated"))))
_add("vz01_projection", lambda s, d: E.projection(V.vectors(s, d)).select("chunk_id", F.round(F.abs("pc1"), 5).alias("pc1"), F.round(F.abs("pc2"), 5).alias("pc2")))

# Filters, set operations and further aggregates

_add("fl02_category_cap", lambda s, d: V.load(s, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority").orderBy("o_orderkey").limit(25),
     "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderkey LIMIT 25")
_add("fl04_optional_filter", lambda s, d: V.load(s, d, "documents").where(F.lit("src3").isNull() | (F.col("source") == "src3")).select("doc_id", "source"),
     "SELECT doc_id, source FROM documents WHERE ('src3' IS NULL OR source = 'src3')")
_add("fl05_completed", _ev(lambda d: W.completed(d.withColumn("is_error", F.when(F.col("latency_ms") > 200, 1).when(F.col("latency_ms") > 150, 0)))), f"WITH {V.EV} SELECT DISTINCT question_id FROM ev WHERE latency_ms <= 200")
_add("fl06_pending", lambda s, d: W.pending(V.load(s, d, "documents").select(F.col("doc_id").alias("id"), "source"), V.load(s, d, "labels").select(F.col("doc_id").alias("question_id"), F.col("toxic").alias("is_error"))),
     "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic IS NULL OR toxic = 0)")
_add("fl09_label_progress", lambda s, d: V.load(s, d, "documents").join(V.load(s, d, "labels"), "doc_id", "left").agg(F.count_if(F.col("quality").isNotNull()).alias("labelled"), F.count_if(F.col("quality").isNull()).alias("open"), F.min(F.when(F.col("quality").isNull(), F.col("doc_id"))).alias("next_id")),
     "SELECT count(quality) AS labelled, count(*) - count(quality) AS open, min(CASE WHEN quality IS NULL THEN doc_id END) AS next_id FROM documents LEFT JOIN labels USING (doc_id)")
_add("fl13_blank_documents", lambda s, d: C.solid(V.documents(s, d)).agg(F.count("*").alias("n")), r"SELECT count(*) AS n FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> ''")
_add("fl14_drop_nulls", lambda s, d: V.load(s, d, "documents").join(V.load(s, d, "labels"), "doc_id", "left").na.drop(subset=["quality"]).groupBy("quality").agg(F.count("*").alias("n"), A.mean("n_chars").alias("avg_chars")),
     "SELECT quality, count(*) AS n, round(avg(n_chars), 6) AS avg_chars FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1")
_add("fl15_unknown_sources", lambda s, d: S.unknown_sources(V.load(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("src"), "n_nationkey").alias("source_type")), V.documents(s, d)),
     "SELECT 'src' || n_nationkey AS source_type, n_nationkey AS id FROM nation WHERE 'src' || n_nationkey NOT IN (SELECT source FROM documents)")
_add("jn05_probe_match", lambda s, d: E.adversarial(V.load(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"), F.col("text").alias("predicted_answer")), s.createDataFrame([("the", "answer"), ("ing", "refuse"), ("qu", "flag_uncertainty")], "query string, expected_behavior string")).groupBy("probe", "behaved").agg(F.count("*").alias("n")),
     """WITH p(probe, want) AS (VALUES ('the', 'answer'), ('ing', 'refuse'), ('qu', 'flag_uncertainty')), j AS (SELECT c.conv_id, c.turn, lower(c.text) AS t, p.*, row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY probe) AS rn FROM conversations c JOIN p ON contains(lower(c.text), p.probe))
SELECT probe, CASE want WHEN 'refuse' THEN contains(t, 'not found') OR contains(t, 'cannot answer') OR contains(t, 'insufficient') OR contains(t, 'i don''t know')
  WHEN 'flag_uncertainty' THEN contains(t, 'not sure') OR contains(t, 'uncertain') OR contains(t, 'may not be') OR contains(t, 'insufficient') ELSE NOT contains(t, 'not found') END AS behaved, count(*) AS n FROM j WHERE rn = 1 GROUP BY 1, 2""")
_add("jn11_best_chunk", lambda s, d: E.training_pairs(_questions(s, d), V.documents(s, d), 1).select("question_id", "chunk_id", "shared"), r"""WITH q AS (SELECT DISTINCT item_id * 100 AS question_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS t FROM benchmark),
c AS (SELECT DISTINCT doc_id AS chunk_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS t FROM documents),
n AS (SELECT question_id, chunk_id, count(*) AS shared FROM q JOIN c USING (t) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY shared DESC, chunk_id) AS rn FROM n)
SELECT question_id, chunk_id, shared FROM r WHERE rn = 1""")
_add("jn12_answer_support", lambda s, d: E.answerable(_qvecs(s, d).join(V.vectors(s, d).select(F.col("chunk_id").alias("question_id"), "source_type"), "question_id").withColumnRenamed("qvec", "avec"), V.vectors(s, d).where("chunk_id % 100 <> 0")),
     f"WITH s AS (SELECT q.vec_id AS question_id, round(max({_COS}), 6) AS support FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0 AND v.vec_id % 100 <> 0 GROUP BY 1) SELECT question_id, support, support >= 0.3 AS answerable FROM s")
_add("ag27_average_trust", lambda s, d: R.retrieval_trust(R.dense(_qvecs(s, d), V.vectors(s, d), 5)).agg(F.round(F.avg("trust"), 4).alias("avg_trust")),
     f"WITH {_dense_sql()}, t AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM dense WHERE rank <= 5 WINDOW w AS (PARTITION BY question_id)) SELECT round(avg(round((score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 4)), 4) AS avg_trust FROM t")
_add("ag32_run_consistency", lambda s, d: E.run_consistency(V.vectors(s, d).select(F.col("source_type").alias("question_id"), F.col("chunk_id").alias("run"), "vec", F.get("vec", F.lit(0)).alias("score"))),
     f"""WITH p AS (SELECT q.label AS question_id, round(avg({_COS}), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id < v.vec_id GROUP BY 1),
v AS (SELECT label AS question_id, round(var_pop(CAST(embedding[1] AS DOUBLE)), 6) AS variance FROM embeddings GROUP BY 1) SELECT question_id, variance, similarity, variance < 0.05 AS reliable FROM v LEFT JOIN p USING (question_id)""")
_add("ag33_score_variance", _ev(lambda d: d.groupBy("pipeline").agg(F.round(F.var_pop("overall_score"), 6).alias("variance"))), f"WITH {V.EV} SELECT pipeline, round(var_pop(overall_score), 6) AS variance FROM ev GROUP BY 1")
_add("ag37_metric_means", _ev(lambda d: d.where(E.challenge_filter({"pipeline": "click"})).agg(A.mean("overall_score").alias("score"), A.mean("latency_ms").alias("latency"), A.mean(A.flag("answer_correct")).alias("accuracy"))),
     f"WITH {V.EV} SELECT round(avg(overall_score), 6) AS score, round(avg(latency_ms), 6) AS latency, round(avg(CASE WHEN answer_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM ev WHERE pipeline = 'click'")
_add("ag41_best_score", lambda s, d: R.dense(_qvecs(s, d), V.vectors(s, d), 5).groupBy("question_id").agg(F.max("score").alias("best")), f"WITH {_dense_sql()} SELECT question_id, max(score) AS best FROM dense WHERE rank <= 5 GROUP BY 1")
_add("ag46_baseline_delta", _ev(lambda d: A.regression_trigger(*_halves(d)).select(F.round(100 * (F.col("now_mean") - F.col("prev_mean")), 4).alias("points"))),
     f"WITH {V.EV} SELECT round(100 * ((SELECT round(avg(overall_score), 6) FROM ev WHERE run_id >= '2024-01-16') - (SELECT round(avg(overall_score), 6) FROM ev WHERE run_id < '2024-01-16')), 4) AS points")
_add("wn05_min_max", lambda s, d: R.dense(_qvecs(s, d), V.vectors(s, d), 5).withColumns({"lo": F.min("score").over(Window.partitionBy("question_id")), "hi": F.max("score").over(Window.partitionBy("question_id"))}),
     f"WITH {_dense_sql()} SELECT question_id, rank, chunk_id, score, min(score) OVER (PARTITION BY question_id) AS lo, max(score) OVER (PARTITION BY question_id) AS hi FROM dense WHERE rank <= 5")
_add("wn07_cap_if_many", lambda s, d: R.cap_if_many(R.dense(_qvecs(s, d), V.vectors(s, d), 15), V.vectors(s, d).select("chunk_id", F.col("source_type").alias("doc_id")), 5, 3), f"""WITH {_dense_sql()},
c AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id, label ORDER BY score DESC, chunk_id) AS r FROM dense JOIN embeddings e ON e.vec_id = chunk_id WHERE rank <= 15),
k AS (SELECT question_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM c WHERE r <= 3) SELECT * FROM k WHERE rank <= 5""")
_add("st02_first_seen", lambda s, d: R.first_seen(V.load(s, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_suppkey").alias("chunk_id"), F.col("l_linenumber").alias("hop")), ["hop"]),
     "SELECT l_orderkey AS question_id, l_suppkey AS chunk_id, min(l_linenumber) AS hop FROM lineitem GROUP BY 1, 2")
_add("st03_best_seen", lambda s, d: R.best_seen(V.load(s, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_suppkey").alias("chunk_id"), F.col("l_extendedprice").alias("score"))),
     "SELECT l_orderkey AS question_id, l_suppkey AS chunk_id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2")
_add("st04_shared_questions", _ev(lambda d: d.where("pipeline = 'click'").select("user_id").intersect(d.where("pipeline = 'view'").select("user_id"))), f"WITH {V.EV} SELECT user_id FROM ev WHERE pipeline = 'click' INTERSECT SELECT user_id FROM ev WHERE pipeline = 'view'")
_add("st06_token_overlap", lambda s, d: V.load(s, d, "documents").select("doc_id", F.round(T.overlap_share(F.col("source"), F.col("text")), 6).alias("src"), F.size(F.array_distinct(T.tokens("text"))).alias("kinds")),
     r"""WITH t AS (SELECT doc_id, lower(source) AS s, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS w FROM documents)
SELECT doc_id, CASE WHEN list_contains(w, s) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS src, CAST(len(w) AS INTEGER) AS kinds FROM t""")
_add("sf06_cache_keys", lambda s, d: V.load(s, d, "benchmark").select("item_id", T.cache_key("text", F.lit("bm25"), F.lit("5")).alias("key")), "SELECT item_id, sha256(text || '|bm25|5') AS key FROM benchmark")
_add("sf21_html_escape", lambda s, d: V.load(s, d, "pages").select("page_id", F.sha2(T.html_escape("html"), 256).alias("h")), "SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS h FROM pages")
_add("sf28_token_estimates", lambda s, d: V.documents(s, d).agg(F.sum(T.approx_tokens("content")).alias("tokens")), "SELECT CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM documents")
_add("sf32_provenance", lambda s, d: V.documents(s, d).select("id", T.provenance("source_type", {"src1": 1.0, "src2": 0.8, "src3": 0.6}).alias("tier")), "SELECT doc_id AS id, CASE source WHEN 'src1' THEN 1.0::DOUBLE WHEN 'src2' THEN 0.8::DOUBLE WHEN 'src3' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS tier FROM documents")
_add("sf38_logits", _ev(lambda d: d.select("question_id", F.round(T.logit(F.col("overall_score")), 6).alias("logit"))), f"WITH {V.EV} SELECT question_id, round(ln(greatest(1e-6, least(1 - 1e-6, overall_score)) / (1 - greatest(1e-6, least(1 - 1e-6, overall_score)))), 6) AS logit FROM ev")
_add("ix05_dense_by_source", lambda s, d: R.dense(_qvecs(s, d), V.vectors(s, d), 3, keep=F.col("source_type") == 1), f"""WITH s AS (SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, round({_COS}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.label = 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) SELECT question_id, rank, chunk_id, score FROM r WHERE rank <= 3""")
_add("ix18_max_sim", lambda s, d: R.max_sim(*_token_vectors(s, d), 3), f"""WITH m AS (SELECT q.vec_id - q.vec_id % 100 AS question_id, q.vec_id % 100 AS qpos, v.vec_id // 5 AS chunk_id, max({_DOT.format("q.embedding", "v.embedding")}) AS m FROM embeddings v, embeddings q WHERE q.vec_id % 100 < 3 GROUP BY 1, 2, 3),
t AS (SELECT question_id, chunk_id, round(sum(m), 6) AS score FROM m GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM t) SELECT question_id, rank, chunk_id, score FROM r WHERE rank <= 3""")
_add("qc03_synthetic_ids", lambda s, d: V.load(s, d, "benchmark").select("item_id", E.synthetic_id("text").alias("id")), "SELECT item_id, 'syn_' || substr(sha256(text), 1, 12) AS id FROM benchmark")
_add("qc04_synthesis_plan", lambda s, d: E.synthesis_plan(V.documents(s, d), ["factual", "adversarial"]).groupBy("kind").agg(F.count("*").alias("n")), r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n\s*\n|\n'), lambda x: length(trim(x)) >= 100) AS ps FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 50)),
n AS (SELECT least(5, len(list_filter(range(len(ps)), lambda i: i % greatest(1, len(ps) // 5) = 0))) AS n FROM d WHERE len(ps) > 0)
SELECT k AS kind, CAST(sum(n) AS BIGINT) AS n FROM n, (VALUES ('factual'), ('adversarial')) v(k) GROUP BY 1""")
_add("lp02_recommendations", _ev(lambda d: A.config_pairs(d).select("config_a", "config_b", E.recommendation(F.lit(2), F.col("delta"), F.when(F.abs("delta") > 0.01, 0.01).otherwise(0.5), F.lit(0.25), F.col("delta") > 0, F.lit("it loses a slice.")).alias("advice"))), f"""WITH {V.EV}, m AS (SELECT user_id, pipeline, avg(overall_score) AS m FROM ev GROUP BY 1, 2),
p AS (SELECT x.pipeline AS config_a, y.pipeline AS config_b, round(avg(y.m - x.m), 6) AS delta FROM m x JOIN m y ON x.user_id = y.user_id AND x.pipeline < y.pipeline GROUP BY 1, 2)
SELECT config_a, config_b, CASE WHEN abs(delta) <= 0.01 THEN 'Iteration 2: no significant improvement (p=0.500). Consider more training data or a different base embedding model.'
  WHEN delta <= 0 THEN printf('Iteration 2: significant on aggregate (delta=%+.3f, p=0.010) but it loses a slice. Do not deploy without reviewing per-slice detail.', delta)
  ELSE printf('Deploy iter_2 model — significant %+.3f on overall_score (p=0.010, effect_size=0.25).', delta) END AS advice FROM p""")
_add("pl02_decompose", lambda s, d: _over_documents(s, d, lambda q, get: P.decompose(q.select("question_id", F.posexplode(T.sentences("text")).alias("hop", "text")), get, 5)), rf"""WITH {_BM25}, sq AS (SELECT item_id, generate_subscripts(x, 1) - 1 AS hop, unnest(x) AS x FROM (SELECT item_id, {_SENT.format('text')} AS x FROM benchmark)),
st2 AS (SELECT item_id, hop, term, count(*) AS qn FROM (SELECT item_id, hop, unnest(list_filter(regexp_split_to_array(lower(x), '\s+'), lambda t: t <> '')) AS term FROM sq) GROUP BY 1, 2, 3),
sc AS (SELECT item_id, hop, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al)) * qn), 6) AS score FROM st2 JOIN st USING (term) JOIN post USING (term) GROUP BY 1, 2, 3),
h AS (SELECT *, row_number() OVER (PARTITION BY item_id, hop ORDER BY score DESC, doc_id) AS rk FROM sc), f AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY hop, rk) AS seen FROM h WHERE rk <= 5),
r AS (SELECT item_id * 100 AS question_id, doc_id AS chunk_id, score, CAST(hop AS INTEGER) AS hop, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f WHERE seen = 1) SELECT * FROM r WHERE rank <= 5""")
_add("pl07_fusion", lambda s, d: _over_documents(s, d, lambda q, get: P.fusion(q.select("question_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("variant"), "text"), get, 5)), f"""WITH {_BM25}, v AS (SELECT question_id, chunk_id, round(sum(2 / CAST(60 + rank AS DOUBLE)), 9) AS score, min(score) AS original_score FROM sparse WHERE rank <= 15 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM v) SELECT question_id, rank, chunk_id, score, original_score FROM r WHERE rank <= 5""")
_add("pl15_variants", lambda s, d: P.question_variants(_questions(s, d), _questions(s, d).select("question_id", F.when(F.col("question_id") % 300 == 0, "none").otherwise(F.format_string('{"variants": ["a %d", "b", "c", "d", "e"]}', "question_id")).alias("reply")), 3).select("question_id", "variant", F.sha2("text", 256).alias("h")),
     "WITH v AS (SELECT item_id * 100 AS q, CASE WHEN item_id % 3 = 0 THEN [text] ELSE [text, 'a ' || item_id * 100, 'b', 'c'] END AS v FROM benchmark) SELECT q AS question_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS variant, sha256(unnest(v)) AS h FROM v")
_add("pl06_reflection", lambda s, d: _reflect(s, d), f"""WITH {_BM25}, t AS (SELECT DISTINCT question_id, question_id // 100 % 3 AS k FROM sparse)
SELECT question_id, CASE k WHEN 2 THEN 'round 2' ELSE 'round 1' END AS answer, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS reflection_rounds FROM t""")
_add("ar01_arena_run", lambda s, d: _arena(s, d), """WITH q AS (SELECT item_id AS question_id, 'c' || item_id % 2 AS category, m.model AS model_id, m.k FROM benchmark, (VALUES ('groq/a', 2), ('ollama/b', 3)) m(model, k)),
r AS (SELECT *, question_id % k = 0 AS ok FROM q) SELECT model_id, count(*) AS n, count(*) FILTER (ok) AS correct, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM r GROUP BY 1""")
_add("ag30_difficulty", lambda s, d: E.difficulty_spread(V.load(s, d, "documents").select(F.when(F.col("doc_id") % 4 == 0, "too_short").alias("reason"), F.element_at(F.array(F.lit("easy"), F.lit("hard"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int")).alias("difficulty"))),
     "SELECT ['easy', 'hard', 'unspecified'][doc_id % 3 + 1] AS difficulty, count(*) AS n FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1")
_add("sf33_display_trust", lambda s, d: V.load(s, d, "documents").select("doc_id", F.element_at(F.array(*[F.lit(x) for x in ("confluence", "github", "jira", "slack", "other")]), (F.col("doc_id") % 5 + 1).cast("int")).alias("src"), "text").select("doc_id", F.round(T.display_trust("text", "src"), 6).alias("trust")),
     "SELECT doc_id, round(least(length(text) / 1000.0::DOUBLE, 1) * [1.0::DOUBLE, 0.9, 0.8, 0.6, 0.7][doc_id % 5 + 1], 6) AS trust FROM documents")
_add("sf39_distances", lambda s, d: V.load(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"), (F.col("o_custkey") * 3.0).alias("y")).withColumns({"u": F.lit(5.0), "v": F.lit(7.0)}).select("o_orderkey", F.round(T.distance("x", "y", "u", "v"), 3).alias("distance")),
     "SELECT o_orderkey, round(sqrt((o_totalprice - 5) * (o_totalprice - 5) + (o_custkey * 3.0::DOUBLE - 7) * (o_custkey * 3.0::DOUBLE - 7)), 3) AS distance FROM orders")
_add("sf44_pricing_keys", lambda s, d: V.load(s, d, "supplier").select("s_suppkey", F.element_at(F.array(*[F.lit(x) for x in ("groq", "ollama", "openai")]), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("p"), F.col("s_name").alias("m")).select("s_suppkey", T.pricing_key("p", "m").alias("key")),
     "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'groq/' || s_name WHEN 1 THEN 'ollama' ELSE s_name END AS key FROM supplier")
_add("ca03_no_cache", lambda s, d: R.no_cache(_questions(s, d)).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")), "SELECT 0 AS hits, count(*) AS misses FROM benchmark")
_add("pl14_conversational", lambda s, d: P.conversational(V.load(s, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "conv_id", "turn", "text"), V.load(s, d, "conversations")).select("question_id", "text"), """WITH t AS (SELECT *, array_to_string(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), chr(10)) AS c FROM conversations)
SELECT conv_id * 1000 + turn AS question_id, CASE WHEN coalesce(c, '') <> '' THEN c || chr(10) || 'user: ' || text ELSE text END AS text FROM t WHERE role = 'user'""")
_add("in02_routes", lambda s, d: P.adaptive(V.load(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 6 < 5, F.format_string('{"type": "%s", "confidence": 0.9}', F.element_at(F.array(*[F.lit(x) for x in (*P.ROUTES, "odd")]), (F.col("turn") % 6 + 1).cast("int")))).otherwise("no json").alias("reply")).withColumn("label", P.parse_query_type("reply")["type"]), "label", {r: (lambda q: q) for r in P.ROUTES}).groupBy("route").agg(F.count("*").alias("n")),
     "SELECT CASE turn % 6 WHEN 1 THEN 'analytical' WHEN 2 THEN 'generative' WHEN 3 THEN 'conversational' ELSE 'factual' END AS route, count(*) AS n FROM conversations GROUP BY 1")


# Scores, trust and caches over given tables


_TRUSTED = f"""{_dense_sql()}, t AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM dense WHERE rank <= 5 WINDOW w AS (PARTITION BY question_id)),
trusted AS (SELECT question_id, rank, chunk_id, score, round((score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 4) AS trust FROM t)"""


def _hits(s, d) -> DataFrame:
    return R.dense(_qvecs(s, d), V.vectors(s, d), 5)


_add("rk03_rank_scores", lambda s, d: R.rank_scores(_hits(s, d)), f"WITH {_dense_sql()} SELECT question_id, rank, chunk_id, round(1.0::DOUBLE / (60 + rank), 9) AS score, score AS original_score FROM dense WHERE rank <= 5")


def _cached(s, d) -> DataFrame:
    """Every second question is cached, every fourth of these too long ago."""
    q = V.load(s, d, "benchmark").select(F.col("item_id").alias("question_id"), "text", F.lit("bm25").alias("backend"), F.lit(5).alias("top_k"))
    old = F.when(F.col("question_id") % 4 == 0, "2024-01-01").otherwise("2026-01-01").cast("timestamp")
    cache = q.where("question_id % 2 = 0").select(T.cache_key("text", "backend", F.col("top_k").cast("string")).alias("key"), F.col("question_id").cast("string").alias("answer"), old.alias("expires_at"))
    return R.exact_cache(q, cache, F.lit("2025-01-01").cast("timestamp")).select("question_id", "key", "answer", "hit")


_add("ca01_exact_cache", _cached, """WITH q AS (SELECT item_id AS question_id, sha256(text || '|bm25|5') AS key FROM benchmark), c AS (SELECT key, CAST(question_id AS VARCHAR) AS answer FROM q WHERE question_id % 4 = 2)
SELECT question_id, key, answer, answer IS NOT NULL AS hit FROM q LEFT JOIN c USING (key)""")


def _answered(s, d) -> DataFrame:
    t = F.when(F.col("conv_id") % 2 == 0, T.upper_each(F.substring("text", 3, 12))).otherwise("no such words")
    return V.load(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("predicted_answer"), t.alias("ground_truth"))


_add("ev01_exact_match", lambda s, d: E.exact_match(_answered(s, d)).select("conv_id", "turn", "answer_correct", "completeness", "overall_score"), """WITH r AS (SELECT conv_id, turn, text, lower(trim(CASE WHEN conv_id % 2 = 0 THEN upper(substr(text, 3, 12)) ELSE 'no such words' END, ' ')) AS t FROM conversations),
h AS (SELECT conv_id, turn, contains(lower(text), t) AND t <> '' AS hit FROM r) SELECT conv_id, turn, hit AS answer_correct, CAST(hit AS INTEGER)::DOUBLE AS completeness, CAST(hit AS INTEGER)::DOUBLE AS overall_score FROM h""")
_add("ev02_judged", lambda s, d: E.judged(V.load(s, d, "events").select(F.col("event_id").alias("question_id")), V.load(s, d, "events").where("user_id % 3 <> 0").select(F.col("event_id").alias("question_id"), (F.col("value") > 50).alias("correct"), (F.col("value") / 200).alias("completeness"))).select("question_id", "overall_score"),
     """SELECT event_id AS question_id, CASE WHEN user_id % 3 <> 0 THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN value > 50 THEN value / 200 ELSE 0.0::DOUBLE END)), 6) ELSE 0.0::DOUBLE END AS overall_score FROM events""")
_add("ev06_metric_chain", lambda s, d: E.metric_chain(V.load(s, d, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, F.col("value")).alias("first"), F.when(F.col("user_id") % 2 == 0, -F.col("value")).alias("second")), ["first", "second"], "metric").select("event_id", "metric"),
     "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN value WHEN user_id % 2 = 0 THEN -value END AS metric FROM events")


def _steps(s, d) -> DataFrame:
    li = V.load(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("question_id"), (F.col("l_returnflag") == "R").alias("plan_ok"), (F.col("l_linenumber") % 3).alias("n_relevant"), (F.col("l_linenumber") % 4).alias("n_retrieved"), (F.col("l_discount") * 20).alias("critique"))


_add("ev07_step_scores", lambda s, d: E.step_scores(_steps(s, d)).groupBy("question_id").agg(F.sum("plan").alias("plan"), F.round(F.sum("retrieval"), 4).alias("retrieval"), F.round(F.sum("critique"), 4).alias("critique")), """SELECT l_orderkey AS question_id, sum(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS plan,
  round(sum(CASE WHEN l_linenumber % 4 = 0 THEN 0.0::DOUBLE ELSE round((l_linenumber % 3)::DOUBLE / (l_linenumber % 4), 6) END), 4) AS retrieval, round(sum(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(l_discount AS DOUBLE) * 20))), 4) AS critique FROM lineitem GROUP BY 1""")
_add("ev08_trajectory", lambda s, d: E.trajectory(_steps(s, d)), """WITH g AS (SELECT l_orderkey AS question_id, count(*) AS hops, count(*) FILTER (l_linenumber % 3 > 0) AS useful FROM lineitem GROUP BY 1)
SELECT question_id, hops, hops - useful AS wasted, round(useful::DOUBLE / hops, 6) AS efficiency FROM g""")


def _described(s, d) -> DataFrame:
    """Hits with words, dates and sources made from their ids."""
    h = _hits(s, d)
    words = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("w"), ((F.col("chunk_id") * i) % 7).cast("string")))
    day = F.when(F.col("chunk_id") % 5 > 0, F.date_sub(F.lit("2025-01-01").cast("date"), ((F.col("chunk_id") % 300)).cast("int")))
    return h.withColumns({"text": F.concat(F.lit("W0 w1 w"), (F.col("question_id") % 7).cast("string")), "content": F.array_join(words, " "), "ingested_at": day, "source_type": F.concat(F.lit("s"), (F.col("chunk_id") % 4).cast("string"))})


_add("tr02_composite_trust", lambda s, d: R.composite_trust(_described(s, d), F.lit("2025-01-01").cast("date"), {"s0": 1.0, "s1": 0.8, "s2": 0.6}).select("question_id", "rank", "chunk_id", F.round("trust", 3).alias("trust")), f"""WITH {_TRUSTED},
w AS (SELECT *, list_distinct(['w0', 'w1', 'w' || question_id % 7]) AS q, list_transform(range(1, 7), lambda i: 'w' || (chunk_id * i) % 7) AS c, CASE WHEN chunk_id % 5 > 0 THEN chunk_id % 300 END AS days FROM trusted)
SELECT question_id, rank, chunk_id, round(round(0.4 * trust + 0.2 * CASE WHEN days IS NULL THEN 0.5 WHEN days <= 30 THEN 1.0 WHEN days <= 180 THEN 1 - (days - 30) / 150.0::DOUBLE * 0.5 ELSE 0.3 END
  + 0.2 * len(list_intersect(q, c)) / len(q) + 0.2 * CASE chunk_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 0.5 END, 4), 3) AS trust FROM w""")


def _logits(s, d) -> DataFrame:
    v = V.vectors(s, d).select(F.col("chunk_id"), F.when(F.col("chunk_id") % 2 == 0, F.slice("vec", 1, 3)).alias("logits"))
    return R.entailment_trust(_hits(s, d).join(v, "chunk_id")).select("question_id", "rank", "chunk_id", "trust")


_add("tr03_entailment_trust", _logits, f"""WITH {_TRUSTED} SELECT question_id, rank, chunk_id, CASE WHEN chunk_id % 2 = 0
  THEN round(exp(CAST(e.embedding[3] AS DOUBLE)) / (exp(CAST(e.embedding[1] AS DOUBLE)) + exp(CAST(e.embedding[2] AS DOUBLE)) + exp(CAST(e.embedding[3] AS DOUBLE))), 4) ELSE trust END AS trust
FROM trusted JOIN embeddings e ON e.vec_id = chunk_id""")
_add("tr04_judged_trust", lambda s, d: R.judged_trust(_hits(s, d), _qvecs(s, d).where("question_id % 200 = 0").select("question_id", F.lit("scores: [0.25, 1.5, -1]").alias("scores"))).select("question_id", "rank", "chunk_id", "trust"), f"""WITH {_TRUSTED}
SELECT question_id, rank, chunk_id, CASE WHEN question_id % 200 = 0 AND rank <= 3 THEN CASE rank WHEN 1 THEN 0.25::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE trust END AS trust FROM trusted""")


def _reranked(s, d) -> DataFrame:
    """A conversation's first turn against its other turns."""
    c = V.load(s, d, "conversations")
    q = c.where("turn = 0").select(F.col("conv_id").alias("question_id"), "text")
    t = c.where("turn > 0").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("chunk_id"), F.col("text").alias("content"))
    return R.bm25_rerank(q.join(t, "question_id"), 3)


_add("rk02_bm25_rerank", _reranked, r"""WITH tok AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS t FROM conversations),
c AS (SELECT conv_id AS q, turn AS c, t, count(*) OVER w AS n, avg(len(t)) OVER w AS al FROM tok WHERE turn > 0 AND conv_id IN (SELECT conv_id FROM tok WHERE turn = 0) WINDOW w AS (PARTITION BY conv_id)),
tf AS (SELECT q, c, len, n, al, term, count(*) AS tf FROM (SELECT q, c, n, al, len(t) AS len, unnest(t) AS term FROM c) GROUP BY ALL),
df AS (SELECT q, term, min(n) AS n, count(*) AS df FROM tf GROUP BY 1, 2), raw AS (SELECT q, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df), mi AS (SELECT q, avg(raw) AS m FROM raw GROUP BY 1),
qt AS (SELECT q, term, count(*) AS qn FROM (SELECT conv_id AS q, unnest(t) AS term FROM tok WHERE turn = 0) GROUP BY 1, 2),
s AS (SELECT tf.q, tf.c, round(sum(CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al)) * coalesce(qn, 0)), 6) AS score FROM tf JOIN raw USING (q, term) JOIN mi USING (q) LEFT JOIN qt USING (q, term) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS INTEGER) AS rank FROM s) SELECT q AS question_id, rank, c AS chunk_id, score FROM r WHERE rank <= 3""".replace("\\\\", "\\"))


def _paired(s, d) -> DataFrame:
    """Two scores of an event, by type: is the mean difference inside its interval?"""
    e = V.load(s, d, "events").select("event_type", "event_id", (F.col("value") / 500).alias("a"), (F.col("value") / 500 + F.col("user_id") % 3 * 0.1).alias("b"))
    return E.bootstrap_delta(e, "event_type", samples=200, key="event_id").select("event_type", F.round("delta", 6).alias("delta"), "n", F.col("delta").between(F.col("low"), F.col("high")).alias("inside"), "significant")


_add("sg02_paired_delta", _paired, "SELECT event_type, round(avg((value / 500 + user_id % 3 * 0.1::DOUBLE) - value / 500), 6) AS delta, count(*) AS n, true AS inside, true AS significant FROM events GROUP BY 1")


def _replies(s, d) -> DataFrame:
    """Turns as replies with each of the answer markers, or none."""
    t = T.collapse_space("text")
    k = F.col("turn") % 5
    reply = (
        F.when(k == 0, F.concat(F.lit("thinking\n Answer: "), t, F.lit("\n\nmore\nAnswer: no")))
        .when(k == 1, F.concat(F.lit("a\nTherefore, so "), t))
        .when(k == 2, F.concat(F.lit("b\nFinal answer: "), t, F.lit("\nIn conclusion: no")))
        .when(k == 3, F.concat(F.lit("In conclusion, not "), t, F.lit("\n\nend")))
        .otherwise(F.concat(F.lit("answer: low\n\nsecond\n\n "), t, F.lit(" \n\n")))
    )
    return V.load(s, d, "conversations").select("conv_id", "turn", reply.alias("reply"))


def _reflect(s, d) -> DataFrame:
    """Reflection with stand-ins: a third of the questions is answered at
    once, a third lacks nothing that could be named, a third is asked again."""

    def critique(a):
        k = F.floor(F.col("question_id") / 100) % 3
        return a.select("question_id", F.when(k == 0, '{"complete": true}').when(k == 1, "{}").otherwise('{"complete": false, "missing": "the rest"}').alias("critique"))

    def generate(q, hits):
        return q.select("question_id", F.when(F.col("query") == F.col("text"), "round 1").otherwise("round 2").alias("answer"))

    return _over_documents(s, d, lambda q, get: P.reflection(q, get, generate, critique, 3))


def _arena(s, d) -> DataFrame:
    q = V.load(s, d, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(F.lit("c"), F.col("item_id") % 2).alias("category"))
    every = {"groq/a": 2, "ollama/b": 3}
    answer = lambda q, name: q.select("question_id", (F.col("question_id") % every[name]).cast("string").alias("predicted_answer"), F.lit(5.0).alias("latency_ms"))
    score = lambda r: r.withColumns({"answer_correct": F.col("predicted_answer") == "0", "overall_score": (F.col("predicted_answer") == "0").cast("double")})
    r = P.arena_run(q, [tuple(m.split("/")) for m in every], answer, score)["results"]
    return r.groupBy("model_id").agg(F.count("*").alias("n"), F.count_if("answer_correct").alias("correct"), A.mean(A.flag("answer_correct")).alias("accuracy"))


def _over_documents(s, d, f) -> DataFrame:
    docs = V.documents(s, d)
    return f(_questions(s, d), lambda q, k: R.bm25_scan(q, docs, k))
