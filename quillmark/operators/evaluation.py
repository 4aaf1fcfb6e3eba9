"""Scoring, significance, calibration, quality gates, cost and challenges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import ship, spread
from ..storage import written
from .analytics import average_ranks, benjamini_hochberg, flag, top_per_group
from .retrieval import small

#: Words of the grams that anchor a sought text, and below how many words it
#: has no whole words that are sure to be found as such.
ANCHOR_WORDS = 3
ANCHORED_WORDS = 3


def containment(texts: DataFrame, sought: DataFrame) -> DataFrame:
    """(sought_id, text_id) of the sought texts that stand in a text, upper and
    lower case alike. texts: text_id, text; sought: sought_id, phrase.

    All words of a sought text but the first and last are whole words of a text
    that holds it. So its rarest gram of up to ANCHOR_WORDS such words is its
    anchor; texts that have an anchor are candidates, and candidates are
    compared in full. Sought texts of fewer than ANCHORED_WORDS words are
    compared by words of the vocabulary that hold their longest word.
    """
    s = written(sought.select("sought_id", F.lower(F.trim("phrase")).alias("phrase")).where("phrase <> ''"), "sought")
    p = s.select("sought_id", "phrase", T.tokens("phrase").alias("w"))
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    many = p.where(F.size("w") >= ANCHORED_WORDS).select("sought_id", inner.alias("w"))
    t = spread(texts.select("text_id", F.lower("text").alias("text")))
    words = t.select("text_id", T.tokens("text").alias("w"))
    found = None
    for size in range(1, ANCHOR_WORDS + 1):
        last = size == ANCHOR_WORDS
        own = many.where(F.size("w") >= size if last else F.size("w") == size)
        grams = written(own.select("sought_id", F.explode(_grams("w", size)).alias("gram")).distinct(), f"grams-{size}")
        if grams.isEmpty():
            continue
        held = words.where(F.size("w") >= size).select("text_id", F.explode(F.array_distinct(_grams("w", size))).alias("gram"))
        held = written(held.join(small(grams.select("gram").distinct()), "gram", "left_semi"), f"held-{size}")
        n = held.groupBy("gram").agg(F.count("*").alias("n"))
        # A gram that no text has rules its sought text out.
        rare = grams.join(n, "gram", "left").groupBy("sought_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a"))
        pairs = held.join(rare.where("a.n > 0").select("sought_id", F.col("a.gram").alias("gram")), "gram").select("sought_id", "text_id")
        found = pairs if found is None else found.unionByName(pairs)
    few = written(p.where(F.size("w") < ANCHORED_WORDS).select("sought_id", F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"].alias("x")), "short")
    if not few.isEmpty():
        tokens = words.select("text_id", F.explode(F.array_distinct("w")).alias("token"))
        vocabulary = tokens.select("token").distinct().join(small(few), F.contains("token", "x")).select("token", "sought_id")
        pairs = tokens.join(vocabulary, "token").select("sought_id", "text_id")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return s.join(t.limit(0)).select("sought_id", "text_id")
    found = written(found.distinct(), "candidates")
    j = t.join(found, "text_id").join(small(s), "sought_id")
    return j.where(F.contains("text", "phrase")).select("sought_id", "text_id").distinct()


def _grams(words: str, size: int) -> Column:
    w = F.col(words)
    if size == 1:
        return w
    starts = F.sequence(F.lit(1), F.size(w) - size + 1)
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))


# Scoring


def exact_match(results: DataFrame) -> DataFrame:
    hit = T.exact_match("predicted_answer", "ground_truth")
    return results.withColumns({"answer_correct": hit, "completeness": flag(hit), "overall_score": flag(hit)})


def judged(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verdicts: question_id, correct, completeness of a judge; the score is
    their product, between 0 and 1, and 0 without a verdict."""
    j = results.join(verdicts, "question_id", "left")
    return j.withColumn("overall_score", F.round(F.coalesce(T.unit(flag("correct") * F.col("completeness")), F.lit(0.0)), 6))


def recall_at_k(hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """hits: question_id, rank, content, ground_truth."""
    has = F.contains(F.lower("content"), F.lower(F.trim("ground_truth")))
    return hits.groupBy("question_id").agg(*[F.coalesce(F.bool_or(F.when(F.col("rank") <= k, has)), F.lit(False)).alias(f"recall_at_{k}") for k in ks])


def recall_by_id(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    r = relevant.select("question_id", "chunk_id").withColumn("rel", F.lit(1.0))
    j = hits.join(r, ["question_id", "chunk_id"], "left")
    return j.groupBy("question_id").agg(F.max(F.when((F.col("rank") <= k) & F.col("rel").isNotNull(), 1.0).otherwise(0.0)).alias("recall"))


def mrr(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    r = relevant.select("question_id", "chunk_id").withColumn("rel", F.lit(1))
    j = hits.join(r, ["question_id", "chunk_id"], "left")
    return j.groupBy("question_id").agg(F.round(F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"))


def adversarial(results: DataFrame, probes: DataFrame) -> DataFrame:
    """Each result with the first probe (by its text) that its question holds;
    whether the answer behaves as the probe wants."""
    p = small(probes.select(F.col("query").alias("probe"), "expected_behavior"))
    j = results.join(p, F.contains(F.lower("question"), F.lower("probe")))
    j = top_per_group(j, ["question_id"], ["probe"], 1, "__r").drop("__r")
    refuses, unsure = T.any_phrase("predicted_answer", T.REFUSALS), T.any_phrase("predicted_answer", T.UNCERTAIN)
    found = ~F.contains(F.lower("predicted_answer"), F.lit("not found"))
    ok = F.when(F.col("expected_behavior") == "refuse", refuses).when(F.col("expected_behavior") == "flag_uncertainty", unsure).otherwise(found)
    return j.withColumn("behaved", ok)


def error_rates(df: DataFrame, prediction: str, truth: str) -> DataFrame:
    return df.withColumns({"cer": F.round(T.char_error_rate(prediction, truth), 6), "wer": F.round(T.word_error_rate(prediction, truth), 6)})


def metric_chain(results: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Later metrics fill only nulls."""
    return results.withColumn(out, F.coalesce(*columns))


def step_scores(steps: DataFrame) -> DataFrame:
    """steps: question_id, plan_ok, n_relevant, n_retrieved, critique."""
    return steps.select(
        "question_id", flag("plan_ok").alias("plan"), F.round(F.coalesce(F.try_divide("n_relevant", "n_retrieved"), F.lit(0.0)), 6).alias("retrieval"), T.unit(F.col("critique")).alias("critique")
    )


def trajectory(steps: DataFrame) -> DataFrame:
    """Efficiency: useful retrievals over all; the others are wasted."""
    g = steps.groupBy("question_id").agg(F.count("*").alias("hops"), F.count_if(F.col("n_relevant") > 0).alias("useful"))
    return g.select("question_id", "hops", (F.col("hops") - F.col("useful")).alias("wasted"), F.round(F.try_divide("useful", "hops"), 6).alias("efficiency"))


def run_consistency(runs: DataFrame, least_variance: float = 0.05) -> DataFrame:
    """runs: question_id, run, vec, score. Mean pairwise cosine of a question's
    runs and the population variance of their scores."""
    # The cosines of all pairs add up to half of |sum of unit vectors|^2 less the sum of their |.|^2.
    n = F.col("n")
    u = runs.select("question_id", "vec", T.norm(F.col("vec")).alias("n"))
    u = u.select("question_id", F.transform("vec", lambda x: F.when(n == 0, 0.0).otherwise(x / n)).alias("u"), (n > 0).cast("int").alias("unit"))
    g = u.groupBy("question_id").agg(Summarizer.sum(array_to_vector("u")).alias("s"), F.sum("unit").alias("units"), F.count("*").alias("m"))
    s = vector_to_array("s")
    similarity = (T.dot(F.col("a"), F.col("a")) - F.col("units")) / (F.col("m") * (F.col("m") - 1))
    cos = g.where("m > 1").select("question_id", "units", "m", s.alias("a")).select("question_id", F.round(similarity, 6).alias("similarity"))
    var = runs.groupBy("question_id").agg(F.round(F.var_pop("score"), 6).alias("variance"))
    return var.join(cos, "question_id", "left").withColumn("reliable", F.col("variance") < least_variance)


# Significance: p-values in closed form on sums that Spark makes


def bootstrap_mean(values: list[float] | np.ndarray, samples: int = 2000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of the mean; one value only: that value twice."""
    v = np.asarray(values, float)
    if len(v) == 0:
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    means = np.array([v[rng.integers(0, len(v), len(v))].mean() for _ in range(samples)])
    return float(np.quantile(means, alpha / 2)), float(np.quantile(means, 1 - alpha / 2))


_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Poisson(1) up to 7: beyond, less than one in 10^7.
_POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(8)]
_DRAWN = 1 << 21


def poisson_draws(ids: np.ndarray, samples: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) numbers, ids x samples, the same for the same pair."""
    x = ids.astype(np.uint64)[:, None] + (samples.astype(np.uint64)[None, :] + np.uint64(seed)) * np.uint64(_MIX[0])
    for shift, times in ((30, _MIX[1]), (27, _MIX[2])):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right")


def bootstrap(df: DataFrame, group: str, value: str, samples: int = 2000, seed: int = 42, key: str | None = None) -> DataFrame:
    """Interval by group from Poisson weights: each sample weighs every row by
    a hash-drawn Poisson(1) number. Rows are read once; a task keeps a sum and
    a weight per group and sample (the lanes of an array) for what it reads,
    and those are added up, so that no group is gathered and no row is
    repeated. With a key of the rows, reruns agree. Null values do not count."""
    ids = F.xxhash64(F.lit(seed), F.col(key)) if key else F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), ids.alias("id"))
    lanes = np.arange(samples)

    def run(batches):
        for b in batches:
            code = b.column("g").dictionary_encode()
            at = code.indices.fill_null(len(code.dictionary)).to_numpy()
            v, h = b.column("v").to_numpy(), b.column("id").to_numpy()
            sums, weights = np.zeros((len(code.dictionary) + 1, samples)), np.zeros((len(code.dictionary) + 1, samples))
            step = max(1, _DRAWN // samples)
            for i in range(0, len(v), step):
                w = poisson_draws(h[i : i + step], lanes, seed)
                for c in np.unique(at[i : i + step]):
                    own = at[i : i + step] == c
                    sums[c] += v[i : i + step][own] @ w[own]
                    weights[c] += w[own].sum(0)
            some = np.unique(at)
            names = code.dictionary.take(pa.array([None if c == len(code.dictionary) else int(c) for c in some], pa.int64()))
            yield pa.RecordBatch.from_arrays([names, pa.array(sums[some].tolist(), pa.list_(pa.float64())), pa.array(weights[some].tolist(), pa.list_(pa.float64()))], names=["g", "s", "w"])

    ship(df.sparkSession)
    kind = rows.schema["g"].dataType.simpleString()
    parts = rows.mapInArrow(run, f"g {kind}, s array<double>, w array<double>")
    lane = parts.select("g", F.posexplode(F.arrays_zip("s", "w")).alias("sample", "x"))
    m = lane.groupBy("g", "sample").agg((F.sum("x.s") / F.greatest(F.sum("x.w"), F.lit(1.0))).alias("m"))
    return m.groupBy(F.col("g").alias(group)).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def bootstrap_delta(pairs: DataFrame, group: str, a: str = "a", b: str = "b", samples: int = 2000, seed: int = 42, key: str | None = None) -> DataFrame:
    """Interval of the mean paired difference b - a; significant if it leaves
    out zero."""
    d = pairs.withColumn("__delta", F.col(b) - F.col(a))
    mean = d.groupBy(group).agg(F.avg("__delta").alias("delta"), F.count("__delta").alias("n"))
    out = bootstrap(d, group, "__delta", samples, seed, key)
    joined = mean.join(out, mean[group].eqNullSafe(out[group])).drop(out[group])
    return joined.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def _normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def wilcoxon(pairs: DataFrame, a: str = "a", b: str = "b") -> dict:
    """Signed-rank test, zero differences dropped, average ranks. Exact for up
    to 25 differences without ties, else normal with tie correction."""
    d = pairs.select((F.col(b) - F.col(a)).alias("d")).where("d <> 0")
    r = average_ranks(d.withColumn("ad", F.abs("d")), "ad", "r")
    s = r.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("plus"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("minus"), F.count_distinct("ad").alias("k"),
    ).first()
    n = s["n"]
    if n == 0:
        return {"n": 0, "statistic": 0.0, "p_value": 1.0}
    w = min(s["plus"], s["minus"])
    if n <= 25 and s["k"] == n:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for i in range(1, n + 1):
            for t in range(len(ways) - 1, i - 1, -1):
                ways[t] += ways[t - i]
        p = min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    else:
        ties = d.groupBy(F.abs("d").alias("ad")).count().agg(F.sum(F.pow("count", F.lit(3)) - F.col("count")).alias("t")).first()["t"]
        var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
        p = min(1.0, 2 * _normal_sf(abs(w - n * (n + 1) / 4) / math.sqrt(var))) if var > 0 else 1.0
    return {"n": n, "statistic": float(w), "p_value": p}


def mcnemar(pairs: DataFrame, a: str, b: str) -> dict:
    """Exact binomial for fewer than 25 discordant pairs, else chi-square with
    continuity correction."""
    r = pairs.agg(F.count_if(F.col(a) & ~F.col(b)).alias("b10"), F.count_if(~F.col(a) & F.col(b)).alias("b01")).first()
    n, low = r["b10"] + r["b01"], min(r["b10"], r["b01"])
    if n == 0:
        p = 1.0
    elif n < 25:
        p = min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n)
    else:
        p = math.erfc(math.sqrt((abs(r["b10"] - r["b01"]) - 1) ** 2 / n / 2))
    return {"b10": r["b10"], "b01": r["b01"], "p_value": p}


def discordant(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.agg(F.count_if(F.col(a) & ~F.col(b)).alias("b10"), F.count_if(~F.col(a) & F.col(b)).alias("b01"), F.count("*").alias("n"))


def effect_size(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Mean paired delta and Cohen's d; d is 0 without spread."""
    d = F.col(b) - F.col(a)
    sd = F.coalesce(F.stddev_samp(d), F.lit(0.0))
    return pairs.agg(F.round(F.avg(d), 6).alias("delta"), F.round(F.when(sd > 1e-12, F.avg(d) / F.when(sd > 1e-12, sd)).otherwise(0.0), 6).alias("cohens_d"), F.count("*").alias("n"))


def compare(pairs: DataFrame, name_a: str, name_b: str, alpha: float = 0.05, practical: float = 0.05, seed: int = 42) -> dict:
    """Significance report of two configurations from their pairs (a, b)."""
    e = effect_size(pairs).first()
    if not e["n"]:
        raise ValueError("no shared questions")
    w = wilcoxon(pairs)
    r = {"config_a": name_a, "config_b": name_b, "n": e["n"], "delta": e["delta"], "cohens_d": e["cohens_d"], "p_value": w["p_value"], "statistic": w["statistic"]}
    r["significant"] = r["p_value"] < alpha
    r["practical"] = abs(r["delta"]) > practical
    r["verdict"] = verdict(r)
    return r


def verdict(r: dict) -> str:
    if not r["significant"]:
        return f"no significant difference between {r['config_a']} and {r['config_b']}"
    better = r["config_b"] if r["delta"] > 0 else r["config_a"]
    return f"{better} is better by {abs(r['delta']):.3f}" + ("" if r["practical"] else ", too little to matter")


def pairwise_matrix(results: DataFrame, key: str, config: str, metric: str, alpha: float = 0.05) -> DataFrame:
    """All pairs of configurations with corrected p-values; the number of
    configurations is small, the sums are Spark's."""
    m = results.groupBy(key, config).agg(F.avg(metric).alias("m"))
    names = sorted(r[0] for r in m.select(config).distinct().collect())
    rows = []
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            p = m.where(F.col(config) == x).select(key, F.col("m").alias("a")).join(m.where(F.col(config) == y).select(key, F.col("m").alias("b")), key)
            if p.limit(1).count():
                rows.append({k: v for k, v in compare(p, str(x), str(y), alpha).items() if k in ("config_a", "config_b", "n", "delta", "p_value")})
    df = results.sparkSession.createDataFrame(rows, "config_a string, config_b string, delta double, n long, p_value double")
    df = df.withColumn("pair", F.concat_ws("|", "config_a", "config_b"))
    return df.join(benjamini_hochberg(df, "pair", "p_value", alpha).drop("p_value"), "pair").drop("pair")


# Calibration


def recalibrate(df: DataFrame, p: str, y: str, method: str = "platt") -> DataFrame:
    """df with ``calibrated``. platt: logistic regression on the score;
    isotonic; temperature: logits over the temperature of least loss."""
    classes = df.agg(F.count_distinct(y).alias("k")).first()["k"]
    if classes < 2:
        raise ValueError("both classes are needed")
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = df.withColumn("label", flag(y))
    if method == "platt":
        from pyspark.ml.classification import LogisticRegression

        n = d.count()
        f = d.withColumn("features", array_to_vector(F.array(F.col(p).cast("double"))))
        m = LogisticRegression(regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False).fit(f)
        out = m.transform(f).withColumn("calibrated", F.get(vector_to_array("probability"), F.lit(1)))
        return out.drop("features", "rawPrediction", "probability", "prediction", "label")
    if method == "isotonic":
        from pyspark.ml.regression import IsotonicRegression

        f = d.withColumn("features", F.col(p).cast("double"))
        m = IsotonicRegression().fit(f)
        return m.transform(f).withColumn("calibrated", T.unit(F.col("prediction"))).drop("features", "prediction", "label")
    t = temperature(d, p, "label")
    return d.withColumn("calibrated", T.sigmoid(T.logit(F.col(p)) / t)).drop("label")


def temperature(df: DataFrame, p: str, label: str, low: float = 0.05, high: float = 20.0) -> float:
    """Golden-section search on log temperature. Logits are counted in fine
    bins first, so that each step works on a bounded table on the driver."""
    z = F.round(T.logit(F.col(p)), 3)
    bins = [(float(r[0]), float(r[1]), r[2]) for r in df.groupBy(z.alias("z"), F.col(label).cast("double").alias("y")).count().collect()]

    def loss(logt: float) -> float:
        t = math.exp(logt)
        return sum(n * (math.log1p(math.exp(-abs(z / t))) + max(-z / t, 0) if y else math.log1p(math.exp(-abs(z / t))) + max(z / t, 0)) for z, y, n in bins)

    a, b, g = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    for _ in range(60):
        if loss(c) < loss(d):
            b, d = d, c
            c = b - g * (b - a)
        else:
            a, c = c, d
            d = a + g * (b - a)
    return math.exp((a + b) / 2)


# Gates, synthesis, improvement


def question_gates(questions: DataFrame, least_words: int = 4) -> DataFrame:
    """question, answer, kind: null reason if kept, else why it goes; the
    cheapest test first."""
    q, a = F.col("question"), F.col("answer")
    reason = (
        F.when(F.size(T.tokens("question")) < least_words, F.concat(F.lit("too_short: "), F.size(T.tokens("question")).cast("string")))
        .when(F.trim(F.coalesce(a, F.lit(""))) == "", "empty_answer")
        .when((F.col("kind") == "adversarial") & (F.upper(F.trim(a)) != "NOT FOUND"), "adversarial_answered")
        .when((F.col("kind") != "adversarial") & F.contains(F.lower(q), F.lower(F.trim(a))), "leakage")
    )
    return questions.withColumn("reason", reason)


def answerable(questions: DataFrame, paragraphs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Best cosine of an answer (question_id, source_type, avec) with a
    paragraph (source_type, vec) of its source."""
    j = questions.join(paragraphs, "source_type").groupBy("question_id").agg(F.round(F.max(T.cosine(F.col("avec"), F.col("vec"))), 6).alias("support"))
    return j.withColumn("answerable", F.col("support") >= threshold)


def synthetic_id(*parts) -> Column:
    return F.concat(F.lit("syn_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def rejection_reasons(gated: DataFrame) -> DataFrame:
    return gated.where("reason is not null").groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def difficulty_spread(gated: DataFrame) -> DataFrame:
    """Questions kept by the gates, by difficulty."""
    return gated.where("reason is null").groupBy(F.coalesce(F.nullif("difficulty", F.lit("")), F.lit("unspecified")).alias("difficulty")).agg(F.count("*").alias("n"))


def synthesis_plan(docs: DataFrame, kinds: list[str], most_docs: int = 50, most_paragraphs: int = 5, least_chars: int = 100) -> DataFrame:
    """doc, paragraph and kind of each question to be written: evenly strided
    paragraphs that are long enough."""
    d = docs.orderBy("id").limit(most_docs)
    p = F.filter(F.split("content", r"\n\s*\n|\n"), lambda x: F.length(F.trim(x)) >= least_chars)
    d = d.select("id", "source_type", p.alias("ps")).where(F.size("ps") > 0)
    step = F.greatest(F.lit(1), F.floor(F.size("ps") / most_paragraphs).cast("int"))
    picked = F.slice(F.filter("ps", lambda x, i: i % step == 0), 1, most_paragraphs)
    e = d.select("id", "source_type", F.posexplode(picked).alias("paragraph", "text"))
    e = e.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    return e.withColumn("question_id", synthetic_id(F.col("id").cast("string"), F.col("paragraph").cast("string"), "kind"))


def training_pairs(questions: DataFrame, chunks: DataFrame, negatives: int = 3, seed: int = 42) -> DataFrame:
    """Best overlapping chunk of each question by shared words, and hash-drawn
    other chunks as negatives."""
    q = questions.select("question_id", F.explode(F.array_distinct(T.tokens("text"))).alias("t"))
    c = chunks.select(F.col("id").alias("chunk_id"), F.explode(F.array_distinct(T.tokens("content"))).alias("t"))
    n = q.join(c, "t").groupBy("question_id", "chunk_id").agg(F.count("*").alias("shared"))
    best = top_per_group(n, ["question_id"], [F.desc("shared"), "chunk_id"], 1, "__r").drop("__r")
    # Chunks get numbers in a seeded order; a question draws a place in it and
    # takes the chunks from there on, so any chunk can be a negative.
    order = drawn_order(chunks.select(F.col("id").alias("negative_id")), "negative_id", seed)
    total = order.count()
    if total < 2:
        return best.withColumn("negative_id", F.lit(None).cast(order.schema["negative_id"].dataType)).limit(0)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(min(negatives, total - 1))), lambda i: F.pmod(F.xxhash64(F.lit(seed), "question_id") + i, F.lit(total)))
    neg = best.withColumn("place", F.explode(drawn)).join(order, "place").where("negative_id <> chunk_id")
    return top_per_group(neg, ["question_id"], ["place", "negative_id"], negatives, "__r").drop("place", "__r")


def drawn_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """key and place, from 0 in the order of a seeded hash: counts of hash
    buckets first, then places inside each."""
    h = df.select(key, F.xxhash64(F.lit(seed), key).alias("h")).withColumn("b", F.shiftright("h", 48))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    start = h.groupBy("b").agg(F.count("*").alias("n")).select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("b").orderBy("h", key))
    return h.withColumn("i", inside).join(start, "b").select(key, (F.col("start") + F.col("i") - 1).alias("place"))


# Formats of the advice after an improvement round.
NO_GAIN = "Iteration %d: no significant improvement (p=%.3f). Consider more training data or a different base embedding model."
UNEVEN_GAIN = "Iteration %d: significant on aggregate (delta=%+.3f, p=%.3f) but %s Do not deploy without reviewing per-slice detail."
DEPLOY = "Deploy iter_%d model — significant %+.3f on overall_score (p=%.3f, effect_size=%.2f)."


def recommendation(iteration: Column, delta: Column, p_value: Column, effect: Column, consistent: Column, warning: Column, alpha: float = 0.05) -> Column:
    """Advice: no significant change, significant but not in all slices (null
    where slices were not checked), or to be deployed."""
    return (
        F.when(p_value >= alpha, F.format_string(NO_GAIN, iteration, p_value))
        .when(~consistent, F.format_string(UNEVEN_GAIN, iteration, delta, p_value, warning))
        .otherwise(F.format_string(DEPLOY, iteration, delta, p_value, effect))
    )


def next_iteration(reports: DataFrame) -> DataFrame:
    return reports.agg((F.coalesce(F.max("iteration"), F.lit(0)) + 1).alias("iteration"))


def call_costs(calls: DataFrame, prices: DataFrame, alert: float = 1.0) -> DataFrame:
    """calls: model_id, input_tokens, output_tokens; prices per million tokens.
    A model without a price costs nothing."""
    p = small(prices.select("model_id", "input_price", "output_price"))
    j = calls.join(p, "model_id", "left")
    cost = (F.col("input_tokens") * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_price", F.lit(0.0))) / 1_000_000
    return j.withColumn("cost_usd", F.round(cost, 9)).withColumn("alert", F.col("cost_usd") > alert)


OPERATORS = {"gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "eq": lambda a, b: a == b}


def challenge_filter(spec: dict) -> Column:
    """Conjunction of equalities; has_code is a predicate on the question."""
    out = F.lit(True)
    for k, v in (spec or {}).items():
        out = out & ((T.has_code("question") == F.lit(bool(v))) if k == "has_code" else (F.col(k) == v))
    return out


def evaluate_challenge(results: DataFrame, challenge: dict) -> DataFrame:
    """One row: metric value, whether target and constraint are met."""

    def value(metric: str) -> Column:
        return F.round(F.avg(flag(metric) if metric == "answer_correct" else F.col(metric)), 6)

    c = challenge.get("constraint")
    rows = results.where(challenge_filter(challenge.get("filter") or {}))
    a = rows.agg(value(challenge["metric"]).alias("value"), F.count("*").alias("n"), *([value(c["metric"]).alias("side")] if c else []))
    met = F.coalesce(OPERATORS[challenge["operator"]](F.col("value"), challenge["target"]), F.lit(False))
    side = F.coalesce(OPERATORS[c["operator"]](F.col("side"), c["target"]), F.lit(False)) if c else F.lit(True)
    return a.select("value", "n", (met & side).alias("passed"))


def joint_projection(chunks: DataFrame, queries: DataFrame, k: int = 2, preview: int = 200) -> DataFrame:
    """Labelled points of chunks (chunk_id, source_type, content, vec) and
    queries (question_id, text, qvec), projected together: id, source_type,
    is_query, preview, trust_score, pc1..pck. Queries are trusted wholly."""
    text = lambda c: F.col(c).cast("string")
    c = chunks.select(text("chunk_id").alias("id"), text("source_type").alias("source_type"), F.lit(False).alias("is_query"), F.substring("content", 1, preview).alias("preview"), T.display_trust("content", "source_type").alias("trust_score"), "vec")
    q = queries.select(F.concat(F.lit("query_"), text("question_id")).alias("id"), F.lit("query").alias("source_type"), F.lit(True).alias("is_query"), F.col("text").alias("preview"), F.lit(1.0).alias("trust_score"), F.col("qvec").alias("vec"))
    return projection(c.unionByName(q), k).drop("vec")


def projection(vectors: DataFrame, k: int = 2) -> DataFrame:
    """Principal components of mean-centred vectors, as pc1..pck; signs are
    fixed by a positive sum of each component's first row."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.withColumn("__raw", array_to_vector("vec"))
    v = StandardScaler(withMean=True, withStd=False, inputCol="__raw", outputCol="__centred").fit(v).transform(v)
    out = PCA(k=k, inputCol="__centred", outputCol="__pc").fit(v).transform(v)
    a = vector_to_array("__pc")
    return out.select("*", *[F.get(a, F.lit(i)).alias(f"pc{i + 1}") for i in range(k)]).drop("__raw", "__centred", "__pc")


