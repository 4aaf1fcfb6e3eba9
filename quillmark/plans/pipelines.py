"""Retrieval pipelines: every stage is a DataFrame; loops run on the driver
over whole question tables, never over questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.analytics import top_per_group
from . import adapters as A

Retrieve = Callable[[DataFrame, int], DataFrame]
FALLBACK = "I do not have enough reliable context to answer."


@dataclass(frozen=True)
class Config:
    chunker: str = "fixed"
    index: str = "bm25"
    reranker: str = "none"
    rerank: bool = False
    pipeline: str = "naive"
    top_k: int = 5
    trust_threshold: float = 0.0
    prompt: str = "zero_shot"
    hooks: dict[str, list[Callable]] = field(default_factory=dict)


def overlay(config: Config, preset: dict) -> Config:
    """Flat keys over a configuration; a reranker switches reranking on."""
    known = {k: v for k, v in preset.items() if k in Config.__dataclass_fields__}
    if known.get("reranker", "none") != "none":
        known["rerank"] = True
    return replace(config, **known)


def run_hooks(df: DataFrame, hooks: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for h in hooks:
        df = df.transform(h)
    return df


def context(hits: DataFrame) -> DataFrame:
    """One labelled context per question, in order of rank."""
    label = F.concat(F.lit("["), T.chunk_label(F.col("rank")), F.lit("] (source: "), F.coalesce(F.col("source_type").cast("string"), F.lit("unknown")), F.lit(")\n"), F.col("content"))
    g = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", label.alias("t")))).alias("c"))
    return g.select("question_id", F.array_join(F.transform("c", lambda x: x["t"]), "\n\n").alias("context"))


def prompt(style: str, question: Column, ctx: Column, shots: list[tuple[str, str]] = ()) -> Column:
    lead = {
        "zero_shot": "Answer from the context only and cite chunks.",
        "few_shot": "Answer like the examples.\n" + "\n".join(f"Q: {q}\nA: {a}" for q, a in shots),
        "cot": "Think step by step, then write 'Final answer:' and the answer.",
        "self_consistency": "Think step by step, then write 'Final answer:' and the answer.",
        "medprompt": "Reason from the nearest examples, then write 'Answer:' and the answer.\n" + "\n".join(f"Q: {q}\nA: {a}" for q, a in shots),
    }[style]
    return F.concat(F.lit(lead + "\nContext:\n"), ctx, F.lit("\nQuestion: "), question)


def cited(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Chunks that an answer cites by its 1-based labels; labels out of range
    cite nothing."""
    c = answers.select("question_id", F.explode(T.citations("answer")).alias("n")).where("n >= 0")
    return c.join(hits.select("question_id", (F.col("rank") - 1).alias("n"), "chunk_id"), ["question_id", "n"]).select("question_id", "chunk_id")


def naive(questions: DataFrame, retrieve: Retrieve, chunks: DataFrame, generator, config: Config = Config(), reranker=None) -> dict[str, DataFrame]:
    """questions: question_id, text. Intent, retrieval, rerank, trust, gate,
    prompt, answer; the tables of the run by name."""
    q = run_hooks(questions, config.hooks.get("query", []))
    q = q.withColumn("intent", T.intent("text"))
    wide = config.top_k * 3 if config.rerank else config.top_k
    hits = retrieve(q, wide).join(chunks.select(F.col("id").alias("chunk_id"), "doc_id", "content", "source_type"), "chunk_id").join(q.select("question_id", "text"), "question_id")
    if config.rerank:
        new = (reranker or A.make("reranker", config.reranker)).rerank(hits, config.top_k).select("question_id", "chunk_id", "rank", "score")
        hits = hits.drop("rank", "score").join(new, ["question_id", "chunk_id"])
    hits = run_hooks(hits, config.hooks.get("chunks", []))
    trusted = R.retrieval_trust(hits)
    gate = R.confidence_gate(trusted, config.trust_threshold)
    p = q.join(context(hits), "question_id", "left").join(gate, "question_id", "left")
    p = p.withColumn("prompt", prompt(config.prompt, F.col("text"), F.coalesce("context", F.lit(""))))
    asked = p.where(F.coalesce("action", F.lit("answer")) == "answer")
    answers = generator.generate(asked.select("question_id", "prompt"))
    rest = p.where(F.col("action") == "fallback").select("question_id", F.lit(FALLBACK).alias("answer"))
    final = answers.select("question_id", "answer").unionByName(rest)
    return {"hits": trusted, "gate": gate, "answers": final, "calls": answers, "citations": cited(final, hits)}


def decompose(sub: DataFrame, retrieve: Retrieve, k: int) -> DataFrame:
    """sub: question_id, hop, text. Retrieves for every sub-question, unites,
    keeps a chunk's first hop, trims."""
    s = sub.withColumn("__q", F.concat_ws("#", "question_id", "hop"))
    h = retrieve(s.select(F.col("__q").alias("question_id"), "text"), k).withColumnRenamed("question_id", "__q")
    h = h.join(s.select("__q", "question_id", "hop"), "__q").drop("__q")
    return R.ranked(R.first_seen(h, ["hop", "rank"]).drop("rank"), k)


def step_back(questions: DataFrame, background: DataFrame, retrieve: Retrieve, k: int) -> DataFrame:
    """The specific question's chunks first, then those of the general one."""
    a = retrieve(questions, k).withColumn("part", F.lit(0))
    b = retrieve(background, k).withColumn("part", F.lit(1))
    u = R.first_seen(a.unionByName(b), ["part", "rank"]).drop("score")
    return top_per_group(u.withColumnRenamed("rank", "__r"), ["question_id"], ["part", "__r", "chunk_id"], 2 * k).select("question_id", "rank", "chunk_id", "part")


def hyde(questions: DataFrame, hypothetical: DataFrame, embedder, vectors: DataFrame, k: int) -> DataFrame:
    """Dense retrieval by a hypothetical answer; without one, by the question."""
    q = questions.join(hypothetical.select("question_id", F.col("text").alias("hyp")), "question_id", "left")
    q = embedder.embed(q.withColumn("__t", F.coalesce("hyp", "text")), "__t", "qvec")
    return R.dense(q, vectors, k)


def parse_variants(c, most: int = 4) -> Column:
    """The variants of a model's JSON reply, at most so many; none if it is
    invalid."""
    j = F.from_json(c, "variants array<string>")
    return F.slice(F.coalesce(j["variants"], F.array().cast("array<string>")), 1, most)


def question_variants(questions: DataFrame, replies: DataFrame, most: int = 4) -> DataFrame:
    """question_id, variant, text: the question itself as variant 0, then what
    the model's replies (question_id, reply) offer."""
    r = questions.join(replies.select("question_id", parse_variants("reply", most).alias("v")), "question_id", "left")
    texts = F.concat(F.array("text"), F.coalesce("v", F.array().cast("array<string>")))
    return r.select("question_id", F.posexplode(texts).alias("variant", "text"))


def fusion(variants: DataFrame, retrieve: Retrieve, k: int, most: int = 5) -> DataFrame:
    """variants: question_id, variant, text; rank fusion over at most so many.
    original_score is a chunk's score in the first list that has it."""
    v = variants.where(F.col("variant") < most).withColumn("__q", F.concat_ws("#", "question_id", "variant"))
    h = retrieve(v.select(F.col("__q").alias("question_id"), "text"), 3 * k).withColumnRenamed("question_id", "__q")
    h = h.join(v.select("__q", "question_id", "variant"), "__q")
    first = h.groupBy("question_id", "chunk_id").agg(F.min_by("score", F.struct("variant", "rank")).alias("original_score"))
    return R.rrf([h], k).join(first, ["question_id", "chunk_id"])


def loop(questions: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int) -> DataFrame:
    """Iterative pipelines. step(open questions, round) gives question_id,
    answer, done; only questions that are not done go on. Rounds are few and
    bounded; a round's rows are of the questions that are open."""
    left, finished = questions, None
    for i in range(rounds):
        out = step(left, i).withColumn("rounds", F.lit(i + 1))
        over = out if i == rounds - 1 else out.where("done")
        finished = over if finished is None else finished.unionByName(over)
        left = left.join(out.where("done").select("question_id"), "question_id", "left_anti")
    return finished


# Fixed value: the answer of a question without any chunk.
NOT_FOUND = "NOT FOUND: No relevant information found in the corpus."


def reflection(questions: DataFrame, retrieve: Retrieve, generate, critique, k: int, rounds: int = 2) -> DataFrame:
    """question_id, answer, reflection_rounds. generate(questions, hits) gives
    question_id, answer; critique(answers) gives question_id, critique, a JSON
    text with complete and missing. While an answer is not complete and
    something is said to be missing, the question is asked again about that."""
    left, out = questions.select("question_id", "text", F.col("text").alias("query")), None
    for i in range(rounds):
        left = left.persist()  # each round is worked out once
        hits = retrieve(left.select("question_id", F.col("query").alias("text")), k).persist()
        some = left.join(hits.select("question_id").distinct(), "question_id", "left_semi")
        none = left.join(hits.select("question_id").distinct(), "question_id", "left_anti").select("question_id", F.lit(NOT_FOUND).alias("answer"), F.lit(i).alias("reflection_rounds"))
        answers = generate(some, hits)
        c = F.from_json("critique", "complete boolean, missing string")
        said = answers.join(critique(answers).select("question_id", c.alias("c")), "question_id", "left").join(some, "question_id")
        complete, missing = F.coalesce("c.complete", F.lit(False)), F.nullif("c.missing", F.lit(""))
        again = ~complete & missing.isNotNull() & F.lit(i < rounds - 1)
        ended = said.where(~again).select("question_id", "answer", F.when(complete, i).otherwise(i + 1).alias("reflection_rounds")).unionByName(none)
        out = ended if out is None else out.unionByName(ended)
        left = said.where(again).select("question_id", "text", F.concat("text", F.lit(" specifically about: "), missing).alias("query"))
    return out


def arena_run(questions: DataFrame, models: list[tuple[str, str]], answer: Callable[[DataFrame, str], DataFrame], score: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """All questions by all models (provider, model): answer(questions, name)
    gives question_id, predicted_answer, latency_ms; score adds answer_correct
    and overall_score. Results, leaderboard, winners by category, and how many
    questions each model failed on (no answer): the others go on."""
    from ..operators import analytics as AN

    results = failed = None
    for provider, model in models:
        name = f"{provider}/{model}"
        given = answer(questions, name)
        own = score(questions.join(given, "question_id")).withColumn("model_id", F.lit(name))
        lost = questions.join(given.select("question_id"), "question_id", "left_anti").groupBy(F.lit(name).alias("model_id")).agg(F.count("*").alias("failed"))
        results = own if results is None else results.unionByName(own)
        failed = lost if failed is None else failed.unionByName(lost)
    entered = questions.sparkSession.createDataFrame([(f"{p}/{m}",) for p, m in models], "model_id string")
    failures = entered.join(failed, "model_id", "left").withColumn("failed", F.coalesce("failed", F.lit(0).cast("long")))
    return {"results": results, "failures": failures, "leaderboard": AN.arena(results, entered), "winners": AN.arena_winners(results)}


def react(questions: DataFrame, think: Callable[[DataFrame, int], DataFrame], retrieve: Retrieve, k: int, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """think(questions, round) gives question_id, reply. Replies are parsed;
    actions retrieve, answers finish. Answers and all chunks seen."""
    seen: list[DataFrame] = []

    def step(open_: DataFrame, i: int) -> DataFrame:
        r = think(open_, i).select("question_id", parse_reply("reply").alias("p")).select("question_id", "p.*")
        seen.append(retrieve(r.where("action is not null").select("question_id", F.col("action").alias("text")), k).withColumn("hop", F.lit(i)))
        return r.select("question_id", "answer", F.col("answer").isNotNull().alias("done"))

    answers = loop(questions, step, rounds)
    u = seen[0]
    for s in seen[1:]:
        u = u.unionByName(s)
    return answers, R.first_seen(u, ["hop", "rank"])


def parse_reply(c) -> Column:
    """Last thought, action and answer of a reply, quotes stripped."""

    def last(name: str) -> Column:
        found = F.regexp_extract_all(c, F.lit(rf"(?im)^\s*{name}\s*:\s*(.+)$"), F.lit(1))
        value = F.regexp_replace(F.trim(F.try_element_at(found, F.lit(-1))), "^[\"']|[\"']$", "")
        return F.nullif(value, F.lit(""))

    return F.struct(last("thought").alias("thought"), last("action").alias("action"), last("answer").alias("answer"))


def observation(hits: DataFrame, most: int = 3, chars: int = 300) -> DataFrame:
    h = hits.where(F.col("rank") <= most)
    g = h.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("o"))
    return g.select("question_id", F.array_join(F.transform("o", lambda x: F.format_string("%d. %s", x["rank"], F.substring(x["content"], 1, chars))), "\n").alias("observation"))


def parse_critique(c) -> Column:
    """JSON critique with typed defaults, the score between 0 and 1."""
    j = F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), "score double, issues array<string>, needs_more boolean, query string")
    return F.struct(
        T.unit(F.coalesce(j["score"], F.lit(0.5))).alias("score"), F.coalesce(j["issues"], F.array().cast("array<string>")).alias("issues"),
        F.coalesce(j["needs_more"], F.lit(False)).alias("needs_more"), j["query"].alias("query"),
    )


def cag(docs: DataFrame, window: int, share: float = 0.8) -> DataFrame:
    """All documents, by id, with the tokens up to each. A corpus of more
    tokens than the share of the window is an error: it does not fit a cached
    context. Running sums come from buckets of the ids, so no task sees all
    documents."""
    n = docs.select("id", "content", T.approx_tokens("content").cast("long").alias("n")).withColumn("b", F.substring(F.lpad(F.col("id").cast("string"), 12, "0"), 1, 9))
    total = n.agg(F.sum("n")).first()[0] or 0
    if total > share * window:
        raise ValueError(f"corpus too large for a cached context: {total} tokens, {share:.0%} of {window} allowed")
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per = n.groupBy("b").agg(F.sum("n").alias("s")).select("b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("prior"))
    upto = Window.partitionBy("b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return n.join(per, "b").withColumn("total", F.col("prior") + F.sum("n").over(upto)).select("id", "content", "total")


FILTERS: dict[str, Callable[[str, object], Column]] = {
    "eq": lambda c, v: F.col(c) == v, "contains": lambda c, v: F.contains(F.lower(c), F.lower(F.lit(v))), "matches": lambda c, v: F.col(c).rlike(v),
    "longer": lambda c, v: F.length(c) > v, "in": lambda c, v: F.col(c).isin(v),
}


def declarative(df: DataFrame, spec: dict) -> DataFrame:
    """Filter, group and limit as data, in place of generated code:
    {"filter": [[column, operator, value]], "group": [..], "limit": n}."""
    for c, op, v in spec.get("filter", []):
        if c not in df.columns or op not in FILTERS:
            raise ValueError(f"unknown filter {c} {op}")
        df = df.where(FILTERS[op](c, v))
    if spec.get("group"):
        df = df.groupBy(*spec["group"]).agg(F.count("*").alias("n"))
    return df.limit(int(spec["limit"])) if spec.get("limit") else df


def problems(state: DataFrame) -> DataFrame:
    """Agent states with the rules they break."""
    rules = [
        (F.trim(F.coalesce("query", F.lit(""))) == "", "empty query"), (F.size(F.coalesce("plan", F.array().cast("array<string>"))) == 0, "no plan"),
        (F.coalesce("n_chunks", F.lit(0)) == 0, "no chunks"), (F.trim(F.coalesce("answer", F.lit(""))) == "", "no answer"), (F.col("iteration") > 2, "too many iterations"),
    ]
    return state.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in rules])))


def agent_graph(questions: DataFrame, classify, plan, retrieve: Retrieve, synthesize, critique, k: int, revisions: int = 2) -> DataFrame:
    """classify, plan, retrieve, synthesize, validate, critique and, at most
    ``revisions`` times, again for questions whose critique wants more."""
    q = classify(questions)

    def step(open_: DataFrame, i: int) -> DataFrame:
        p = plan(open_)
        a = synthesize(p, decompose(p.select("question_id", "hop", "text"), retrieve, k))
        c = critique(a).select("question_id", "answer", parse_critique("critique").alias("c"))
        return c.select("question_id", "answer", (~F.col("c.needs_more")).alias("done"))

    return loop(q, step, revisions + 1)


# Types of questions; the first is taken where none is known.
ROUTES = ("factual", "analytical", "generative", "conversational")


def parse_query_type(c) -> Column:
    """struct<type, confidence> of a model's JSON reply, with defaults."""
    j = F.from_json(c, "type string, confidence double")
    return F.struct(F.coalesce(j["type"], F.lit(ROUTES[0])).alias("type"), F.coalesce(j["confidence"], F.lit(0.5)).alias("confidence"))


def adaptive(questions: DataFrame, label: str, routes: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Splits by a label, answers each part its own way, unites; labels that
    are unknown or have no way go the factual way."""
    known = [r for r in ROUTES if r in routes]
    out = None
    for r in known:
        take = F.col(label) == r
        if r == ROUTES[0]:
            take = take | ~F.coalesce(F.col(label).isin(known), F.lit(False))
        part = routes[r](questions.where(take)).withColumn("route", F.lit(r))
        out = part if out is None else out.unionByName(part)
    return out


def hybrid_intent(questions: DataFrame, model_labels: DataFrame, sure: float = 0.8) -> DataFrame:
    """The rule's label where it is sure, else the model's."""
    q = questions.withColumn("i", T.intent("text")).join(model_labels.select("question_id", F.col("label").alias("m")), "question_id", "left")
    use = F.col("i.confidence") >= sure
    return q.select("question_id", "text", F.when(use, F.col("i.label")).otherwise(F.coalesce("m", F.col("i.label"))).alias("label"), F.when(use, "rule").otherwise("model").alias("method"))


def conversational(questions: DataFrame, turns: DataFrame, most: int = 5) -> DataFrame:
    """Questions (question_id, conv_id, turn, text), which are turns
    themselves, with the turns before them in front; the question itself stays
    in ``original``."""
    m = R.context_before(turns, most)
    q = questions.join(m, ["conv_id", "turn"], "left")
    return q.withColumn("original", F.col("text")).withColumn("text", F.when(F.col("context").isNotNull(), F.concat("context", F.lit("\nuser: "), "text")).otherwise(F.col("text"))).drop("context")


def improvement_round(results_now: DataFrame, results_before: DataFrame, gaps: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """Data steps of an improvement round: the trigger, and the documents of
    the sources with gaps, from which new questions are to be made."""
    from ..operators.analytics import regression_trigger

    g = gaps.select(F.col("source_type")).distinct()
    return {"trigger": regression_trigger(results_now, results_before), "material": docs.join(R.small(g), "source_type", "left_semi")}
