"""Relational analytics over scored results: aggregations, windows, top-k."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written


def mean(c, places: int = 6) -> Column:
    return F.round(F.avg(c), places)


def flag(c) -> Column:
    return F.col(c).cast("int").cast("double") if isinstance(c, str) else c.cast("int").cast("double")


def top_per_group(df: DataFrame, group: list[str], order: list, k: int = 1, rank: str = "rank") -> DataFrame:
    """First k rows of each group; order must be unique. Plans as a group limit."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def leaderboard(results: DataFrame, least: int = 3) -> DataFrame:
    """Best model by source type: group, HAVING, row_number = 1."""
    avg = results.groupBy("source_type", "model_id").agg(mean("overall_score").alias("avg_score"), F.count("*").alias("n"))
    best = top_per_group(avg.where(F.col("n") >= least), ["source_type"], [F.col("avg_score").desc(), "model_id"])
    return best.drop("rank")


def pipeline_comparison(results: DataFrame, least: int = 5) -> DataFrame:
    return (
        results.groupBy("pipeline")
        .agg(mean("overall_score").alias("avg_score"), mean("latency_ms").alias("avg_latency"), mean("cost_usd").alias("avg_cost"), F.count("*").alias("n"))
        .where(F.col("n") >= least)
        .orderBy(F.desc("avg_score"), "pipeline")
    )


#: Rows of a group that may be ranked by their values at once, and cells a
#: round of the selection cuts a group into.
RANKED_VALUES = 4096
SELECTION_CELLS = 1024


def elements_at(df: DataFrame, group: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """group, rank, value: the elements of these ranks (from 1) in each group's
    values in order, nulls left out. wanted: group, rank.

    Distributed selection: the range of a group is cut into cells, of equal
    width in one round and of logarithmic width in the next, the counts of the cells show which ones hold wanted ranks, and only
    their rows go on to the next round, as groups of their own, until groups
    are small or of one value. Then counts by value are summed up. No task and
    no state holds a group.
    """
    keys = [f"__g{i}" for i in range(len(group))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(group, keys, strict=True)], F.col(value).cast("double").alias("__v"))
    want = wanted.select(*[F.col(c).alias(k) for c, k in zip(group, keys, strict=True)], F.col("rank").alias("__rank"), F.col("rank").cast("long").alias("__left"))
    rows, want, cell = rows.withColumn("__c", F.lit("")), want.withColumn("__c", F.lit("")), [*keys, "__c"]

    def same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        b = b.select(*[F.col(c).alias(f"__b{c}") if c in cell else F.col(c) for c in b.columns])
        on = [F.col(c).eqNullSafe(F.col(f"__b{c}")) for c in cell]
        return a.join(b, on, how).drop(*[f"__b{c}" for c in cell])

    for turn in itertools.count():
        span = written(rows.groupBy(*cell).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__n")), "selection-spans")
        if not (span.agg(F.max(F.when(F.col("__lo") < F.col("__hi"), F.col("__n")))).first()[0] or 0) > RANKED_VALUES:
            break
        share = (F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2)  # halves do not overflow
        share = F.log1p(share * 2.0**60) / math.log1p(2.0**60) if turn % 2 else share
        at = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor(share * SELECTION_CELLS), F.lit(SELECTION_CELLS - 1))).otherwise(0)
        placed = same(rows, F.broadcast(span)).withColumn("__at", at.cast("int")).drop("__lo", "__hi", "__n")
        n = placed.groupBy(*cell, "__at").agg(F.count("*").alias("__m"))
        n = n.withColumn("__before", F.sum("__m").over(Window.partitionBy(*cell).orderBy("__at")) - F.col("__m"))
        want = same(want, n).where((F.col("__left") > F.col("__before")) & (F.col("__left") <= F.col("__before") + F.col("__m")))
        deeper = F.concat_ws(".", "__c", "__at").alias("__c")
        want = written(want.select(*keys, "__rank", (F.col("__left") - F.col("__before")).alias("__left"), deeper), "selection-ranks")
        rows = written(same(placed.select(*keys, "__v", deeper), F.broadcast(want.select(*cell).distinct()), "left_semi"), "selection-rows")
    n = rows.groupBy(*cell, "__v").agg(F.count("*").alias("__m"))
    n = n.withColumn("__upto", F.sum("__m").over(Window.partitionBy(*cell).orderBy("__v")))
    out = same(want, n).where((F.col("__left") <= F.col("__upto")) & (F.col("__left") > F.col("__upto") - F.col("__m")))
    return out.select(*[F.col(k).alias(c) for c, k in zip(group, keys, strict=True)], F.col("__rank").alias("rank"), F.col("__v").alias(value))


def exact_percentiles(df: DataFrame, group: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """group, n (values that are not null) and p<point> of each: interpolated
    between the elements on both sides, by elements_at."""
    n = written(df.groupBy(*group).agg(F.count(value).alias("n")), "group-sizes")
    at = [F.lit(p) * (F.col("n") - 1) for p in points]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") + 1 for x in at for f in (F.floor, F.ceil)]))
    found = elements_at(df, group, value, n.where("n > 0").select(*group, F.explode(ranks).alias("rank")))
    held = F.map_from_entries(F.collect_list(F.struct("rank", value)))  # two entries a point
    keys = [f"__k{i}" for i in range(len(group))]
    e = found.groupBy(*[F.col(c).alias(k) for c, k in zip(group, keys, strict=True)]).agg(held.alias("__e"))
    j = n.join(e, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(group, keys, strict=True)], "left")

    def point(x: Column) -> Column:
        lo, hi = (F.element_at("__e", f(x).cast("long") + 1) for f in (F.floor, F.ceil))
        return F.round(lo + (hi - lo) * (x - F.floor(x)), 6)

    return j.select(*group, "n", *[point(x).alias(f"p{round(p * 100)}") for p, x in zip(points, at, strict=True)])


def latency_percentiles(results: DataFrame, points: tuple[float, ...] = (0.5, 0.95), accuracy: int | None = None) -> DataFrame:
    """Exact percentiles by pipeline and the number of its rows; with an
    accuracy, approximate ones of n / accuracy ranks at most, in one pass."""
    if accuracy:
        a = results.groupBy("pipeline").agg(F.percentile_approx("latency_ms", list(points), accuracy).alias("p"), F.count("*").alias("n"))
        return a.select("pipeline", *[F.round(F.element_at("p", i + 1), 6).alias(f"p{round(p * 100)}") for i, p in enumerate(points)], "n")
    p = exact_percentiles(results, ["pipeline"], "latency_ms", points).drop("n").withColumnRenamed("pipeline", "__pipeline")
    n = results.groupBy("pipeline").agg(F.count("*").alias("n"))
    return n.join(p, F.col("pipeline").eqNullSafe(F.col("__pipeline"))).drop("__pipeline")


def latency_percentiles_ranked(results: DataFrame, points: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The variant that takes the element at max(0, int(n * p) - 1) of the
    sorted list."""
    n = written(results.groupBy("pipeline").agg(F.count("latency_ms").alias("n")), "group-sizes")
    rank = {p: F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(p))).cast("long") for p in points}
    found = elements_at(results, ["pipeline"], "latency_ms", n.select("pipeline", F.explode(F.array_distinct(F.array(*rank.values()))).alias("rank")))
    j = n.join(found.withColumnRenamed("pipeline", "__p"), F.col("pipeline").eqNullSafe(F.col("__p")))
    return j.groupBy("pipeline").agg(*[F.max(F.when(F.col("rank") == r, F.col("latency_ms"))).alias(f"p{round(p * 100)}") for p, r in rank.items()], F.max("n").alias("n"))


def run_regression(results: DataFrame) -> DataFrame:
    """Mean score by run with the previous run's mean and the change."""
    runs = results.groupBy("run_id").agg(mean("overall_score").alias("mean_score"))
    w = Window.orderBy("run_id")
    prev = F.lag("mean_score").over(w)
    return runs.select("run_id", "mean_score", prev.alias("prev_score"), F.round(F.col("mean_score") - prev, 6).alias("delta"))


def category_difficulty(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(
        mean("overall_score").alias("avg_score"), F.sum(F.when(F.col("answer_correct"), 1).otherwise(0)).alias("n_correct"), F.count("*").alias("n")
    )


def cost_breakdown(costs: DataFrame) -> DataFrame:
    return costs.groupBy("model_id", "stage").agg(
        F.round(F.sum("cost_usd"), 2).alias("total_cost"), mean("cost_usd").alias("avg_cost"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count("*").alias("calls"),
    )


def cost_summary(costs: DataFrame, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Totals and exact percentiles by stage, by model and overall."""
    of = lambda name, stage, model: F.struct(F.lit(name).alias("set"), stage.alias("stage"), model.alias("model_id"))
    none = lambda c: F.lit(None).cast(costs.schema[c].dataType)
    sets = F.array(of("stage", F.col("stage"), none("model_id")), of("model", none("stage"), F.col("model_id")), of("all", none("stage"), none("model_id")))
    rows = costs.select(F.explode(sets).alias("s"), "cost_usd", "latency_ms").select("s.*", "cost_usd", "latency_ms")
    keys = ["set", "stage", "model_id"]
    total = rows.groupBy(*keys).agg(F.round(F.sum("cost_usd"), 2).alias("total_cost"), F.count("*").alias("calls"))
    p = exact_percentiles(rows, keys, "latency_ms", points).drop("n")
    p = p.select(*[F.col(c).alias(f"__{c}") for c in keys], *[f"p{round(x * 100)}" for x in points])
    return total.join(p, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]).drop("set", *[f"__{c}" for c in keys])


def score_cube(results: DataFrame, dims: tuple[str, ...] = ("category", "pipeline", "source_type")) -> DataFrame:
    """Count and mean by each dimension, one pass."""
    r = results.select(*[F.col(d).cast("string").alias(d) for d in dims], "overall_score")
    return r.groupingSets([[d] for d in dims], *dims).agg(F.count("*").alias("n"), mean("overall_score").alias("avg_score"))


def pivot_means(results: DataFrame, row: str, values: list[str], column: str = "pipeline") -> DataFrame:
    p = results.groupBy(row).pivot(column, values).agg(F.avg("overall_score"))
    return p.select(row, *[F.round(v, 6).alias(v) for v in values])


def best_pipeline(results: DataFrame, row: str) -> DataFrame:
    """Arg-max of a pivot row, taken before the pivot."""
    avg = results.groupBy(row, "pipeline").agg(mean("overall_score").alias("avg_score"))
    return top_per_group(avg, [row], [F.desc("avg_score"), "pipeline"]).drop("rank")


def arena(results: DataFrame, models: DataFrame) -> DataFrame:
    """Accuracy, mean score and latency of every model; without rows: 0."""
    a = results.groupBy("model_id").agg(mean(flag("answer_correct")).alias("acc"), mean("overall_score").alias("score"), mean("latency_ms").alias("lat"), F.count("*").alias("n"))
    j = models.join(a, "model_id", "left")
    return j.select("model_id", *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in (("acc", "accuracy"), ("score", "avg_score"), ("lat", "avg_latency"))], F.coalesce("n", F.lit(0)).alias("n"))


def arena_winners(results: DataFrame) -> DataFrame:
    avg = results.groupBy("category", "model_id").agg(mean("overall_score").alias("avg_score"))
    return top_per_group(avg, ["category"], [F.desc("avg_score"), "model_id"]).drop("rank")


def latency_ranks(results: DataFrame) -> DataFrame:
    a = results.groupBy("model_id").agg(mean("latency_ms").alias("avg_latency"))
    return a.withColumn("rank", F.row_number().over(Window.orderBy("avg_latency", "model_id")))


def recall_gaps(results: DataFrame, hit: str, threshold: float, least: int = 1, gaps_only: bool = False) -> DataFrame:
    """Recall by source type and category with a gap mark."""
    m = results.groupBy("source_type", "category").agg(mean(flag(hit)).alias("recall"), F.count("*").alias("n")).where(F.col("n") >= least)
    m = m.withColumn("gap", F.col("recall") < threshold)
    return m.where("gap").drop("gap") if gaps_only else m


def regression_trigger(now: DataFrame, before: DataFrame, metric: str = "overall_score") -> DataFrame:
    a = now.agg(mean(metric).alias("now_mean"))
    b = before.agg(mean(metric).alias("prev_mean"))
    return a.join(b).withColumn("regressed", F.col("now_mean") < F.col("prev_mean") - 1e-9)


def slice_consistency(results: DataFrame, config: str = "pipeline", least: int = 3) -> DataFrame:
    """Winner of every slice and overall; consistent if all agree. A slice in
    which some configuration has fewer than least rows is skipped."""
    r = results.select(F.col("source_type").cast("string").alias("s"), F.col("category").cast("string").alias("c"), config, "overall_score")
    g = r.groupingSets([["s", config], ["c", config], [config]], "s", "c", config).agg(mean("overall_score").alias("avg_score"), F.count("*").alias("n"))
    name = F.when(F.col("s").isNotNull(), F.concat(F.lit("source_type="), "s")).when(F.col("c").isNotNull(), F.concat(F.lit("category="), "c")).otherwise("all")
    g = g.withColumn("slice", name).withColumn("few", F.min("n").over(Window.partitionBy("slice")))
    won = top_per_group(g.where((F.col("few") >= least) | (F.col("slice") == "all")), ["slice"], [F.desc("avg_score"), config])
    agg = won.where("slice = 'all'").select(F.col(config).alias("agg_winner"))
    return won.select("slice", F.col(config).alias("winner")).join(F.broadcast(agg)).select("slice", "winner", "agg_winner", (F.col("winner") == F.col("agg_winner")).alias("agrees"))


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last closed; empty bins with zeros."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(b.alias("bin")).agg(mean(p).alias("predicted"), mean(flag(y)).alias("accuracy"), F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(g, "bin", "left").select("bin", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("predicted", "accuracy")], F.coalesce("n", F.lit(0)).alias("n"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("predicted") - F.col("accuracy"))
    return bins.agg(F.round(F.sum(gap) / F.greatest(F.sum("n"), F.lit(1)), 6).alias("ece"), F.sum("n").alias("n"))


def reliability(bins: DataFrame, gap: float = 0.05) -> DataFrame:
    d = F.col("predicted") - F.col("accuracy")
    return bins.where("n > 0").withColumn("kind", F.when(d > gap, "over").when(d < -gap, "under").otherwise("ok"))


def majority_vote(votes: DataFrame, group: str, text: str, seq: str, norm: Column) -> DataFrame:
    """Most frequent normalised text of a group; the first original of it."""
    v = votes.withColumn("norm", norm).groupBy(group, "norm").agg(F.count("*").alias("votes"), F.min(F.struct(seq, text)).alias("f"))
    v = v.select(group, "votes", F.col(f"f.{seq}").alias(seq), F.col(f"f.{text}").alias("answer"))
    return top_per_group(v, [group], [F.desc("votes"), seq]).select(group, "answer", "votes")


def eval_summary(results: DataFrame) -> DataFrame:
    """Number, right answers, accuracy and, where these columns are there, mean
    completeness and mean score over the rows that have them (none: 0)."""
    n = F.count("*")
    share = F.round(F.sum(flag("answer_correct")) / F.greatest(n, F.lit(1)), 3)
    means = {"completeness": "avg_completeness", "overall_score": "avg_score"}
    out = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 3).alias(name) for c, name in means.items() if c in results.columns]
    return results.agg(n.alias("n"), F.count_if("answer_correct").alias("correct"), F.coalesce(share, F.lit(0.0)).alias("accuracy"), *out)


def completeness(results: DataFrame, scored: Column, threshold: float = 0.9) -> DataFrame:
    """Share of scored rows; no row at all is an error when read."""
    n = F.count("*")
    a = results.agg(F.count_if(scored).alias("n_scored"), n.alias("n_total"))
    share = F.col("n_scored") / F.when(F.col("n_total") > 0, F.col("n_total")).otherwise(F.raise_error(F.lit("no questions")).cast("long"))
    return a.select("n_scored", "n_total", F.round(share, 6).alias("share"), (share >= threshold).alias("complete"))


def dominant_group(results: DataFrame, by: str) -> DataFrame:
    g = results.groupBy(by).agg(F.count("*").alias("n"), mean("overall_score").alias("avg_score"))
    return g.agg(
        F.max_by(by, F.struct("n", by)).alias("dominant"), F.max_by(by, F.struct("avg_score", by)).alias("best"),
        F.min_by(by, F.struct("avg_score", by)).alias("worst"), F.round(F.max("avg_score") - F.min("avg_score"), 6).alias("gap"),
    ).withColumn("notable", F.col("gap") >= 0.1)


def flip_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(mean(flag(F.col(a) != F.col(b))).alias("flip_rate"), F.count("*").alias("n"))


def corpus_hash(docs: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """Hash of all ids and texts, in no order: count and sum of row hashes."""
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.col(key).cast("string"), text).cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return docs.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("content_sum"))


def paired(results_a: DataFrame, results_b: DataFrame, key: str, metric: str) -> DataFrame:
    """Inner pairs on key, one row per key on both sides (the last wins)."""
    a, b = (r.groupBy(key).agg(F.max_by(metric, "question_id").alias(m)) for r, m in ((results_a, "a"), (results_b, "b")))
    return a.join(b, key)


def config_pairs(results: DataFrame, key: str = "user_id", config: str = "pipeline", metric: str = "overall_score") -> DataFrame:
    """All pairs of configurations over shared keys: mean of both, delta, n."""
    m = results.groupBy(key, config).agg(F.avg(metric).alias("m"))
    a, b = m.select(key, F.col(config).alias("config_a"), F.col("m").alias("a")), m.select(key, F.col(config).alias("config_b"), F.col("m").alias("b"))
    p = a.join(b, key).where("config_a < config_b")
    return p.groupBy("config_a", "config_b").agg(mean("a").alias("mean_a"), mean("b").alias("mean_b"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"), F.count("*").alias("n"))


def stratified(df: DataFrame, strata: list[str], per: int, key: str, cap: int | None = None, seed: int = 42) -> DataFrame:
    """per rows of each stratum in a hash order (cap: at most so many in all)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    s = top_per_group(df.withColumn("__h", h), strata, ["__h", key], per, "__r")
    return (s.orderBy("__h", key).limit(cap) if cap else s).drop("__h", "__r")


def strided(df: DataFrame, order: str, step: int, most: int) -> DataFrame:
    w = Window.orderBy(order)
    return df.withColumn("__i", F.row_number().over(w) - 1).where((F.col("__i") % step == 0) & (F.col("__i") < step * most)).drop("__i")


def benjamini_hochberg(p: DataFrame, key: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Step-up adjusted p-values: p * m / rank, smallest from the rank upward."""
    w = Window.orderBy(value, key)
    m = p.withColumn("m", F.count("*").over(Window.partitionBy(F.lit(1)))).withColumn("rank", F.row_number().over(w))
    raw = F.least(F.lit(1.0), F.col(value) * F.col("m") / F.col("rank"))
    adj = F.min(raw).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return m.select(key, value, F.round(adj, 6).alias("p_adjusted"), (adj < alpha).alias("significant"))


def bonferroni(p: DataFrame, key: str, value: str, alpha: float = 0.05) -> DataFrame:
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    adj = F.least(F.lit(1.0), F.col(value) * m)
    return p.select(key, value, F.round(adj, 6).alias("p_adjusted"), (adj < alpha).alias("significant"))


def average_ranks(df: DataFrame, value: str, out: str, group: list[str] | None = None) -> DataFrame:
    """Ranks with ties averaged, nulls first. Values are counted first; without
    a group, prefix sums go over stretches of values between quantiles, so no
    task sees all rows or all values."""
    keys = list(group or [])
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    if not keys:
        cuts = counts.agg(F.percentile_approx(value, [i / 64 for i in range(1, 64)], 10_000)).first()[0] or []
        part = sum((F.when(F.col(value) > c, 1).otherwise(0) for c in sorted(set(cuts))), F.when(F.col(value).isNull(), 0).otherwise(1))
        counts = counts.withColumn("__part", part)
        keys = ["__part"]
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if not group:
        ahead = F.sum("__m").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
        sums = counts.groupBy("__part").agg(F.sum("__n").alias("__m")).select("__part", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
        ranks = ranks.join(F.broadcast(sums), "__part").withColumn("__before", F.col("__before") + F.col("__ahead"))
    own = [F.col(k).alias(f"__k{i}") for i, k in enumerate([*(group or []), value])]
    ranks = ranks.select(*own, (F.col("__before") + (F.col("__n") + 1) / 2).alias(out))
    same = F.lit(True)
    for i, k in enumerate([*(group or []), value]):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(ranks, same).select(*df.columns, out)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    r = average_ranks(average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "__ra"), b, "__rb")
    c = F.corr("__ra", "__rb")
    return r.agg(F.round(F.when(F.count("*") < 2, 0.0).otherwise(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))), 6).alias("rho"), F.count("*").alias("n"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kappa of two booleans; if chance agreement is certain: 1 or 0."""
    x, y = F.col(a), F.col(b)
    c = df.where(x.isNotNull() & y.isNotNull()).agg(F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"))
    n = (F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")).cast("double")
    po = (F.col("n11") + F.col("n00")) / n
    pe = ((F.col("n11") + F.col("n10")) * (F.col("n11") + F.col("n01")) + (F.col("n01") + F.col("n00")) * (F.col("n10") + F.col("n00"))) / (n * n)
    k = F.when(n == 0, 0.0).when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return c.select("n11", "n10", "n01", "n00", F.round(k, 6).alias("kappa"))
