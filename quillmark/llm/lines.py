"""Line dedup by a log-template tree, in SQL functions only.

A line's words with digits in them become ``<*>``. The tree has a fixed depth:
number of tokens, then the first DEPTH tokens (SHORT_DEPTH of lines of fewer
than LONG_TOKENS); its leaves hold the lines. In a leaf, a token's level is how
often the leaf's lines are to be halved to be as few as those with the token at
that place (of a document, lines that are the same count once). The template of
level L keeps the tokens of level L or less, any other becomes ``<*>``; so what
counts as constant follows the size of the leaf. A template needs MIN_CONSTANT
of its tokens constant, or, in lines of fewer than LONG_TOKENS, SHORT_CONSTANT
of them up to level SHORT_LEVEL. Lines of fewer than GENERAL_TOKENS tokens are
their own templates; of one or two tokens they must hold a letter or sign
besides the masked words to be masked at all. A template that MIN_DOCS
different documents have is recurring (of lines of one or two tokens and fewer
than BRIEF_CHARS characters, one that BRIEF_FACTOR times as many have, since
any prose repeats such); a line belongs to the recurring template of the least
level that it has. All lines of it but the very first (by document, then line)
are dropped, so that no text vanishes from the corpus altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, unsent

DEPTH = 3
SHORT_DEPTH = 2
MIN_DOCS = 5
BRIEF_TOKENS = 2
BRIEF_CHARS = 16
BRIEF_FACTOR = 4
GENERAL_TOKENS = 4
LONG_TOKENS = 8
MIN_CONSTANT = 0.75
SHORT_CONSTANT = 0.6
SHORT_LEVEL = 2
WILD = "<*>"
_BLANKS = " \t\n\x0b\x0c\r"
_SPACE = r"[\x20\x09-\x0D]+"
#: A word with a digit, from its first character on.
_VARIABLE = r"(?<![^\x20\x09-\x0D])[^0-9\x20\x09-\x0D]*+[0-9][^\x20\x09-\x0D]*+"
#: Behind the levels of general templates: the line itself.
_EXACT_LEVEL = 99


def masked_tokens(line: Column) -> Column:
    """Tokens of a line, variable fields replaced; null for a blank line."""
    line = F.btrim(line, F.lit(_BLANKS))
    tokens = F.split(F.when(line.rlike("[0-9]"), F.regexp_replace(line, _VARIABLE, WILD)).otherwise(line), _SPACE)
    bare = (F.size(tokens) <= BRIEF_TOKENS) & (F.element_at(tokens, 1) == WILD) & (F.element_at(tokens, -1) == WILD)
    return F.when(line != "", F.when(bare, F.split(line, _SPACE)).otherwise(tokens))


def _enough(n: Column, c: Column, level: Column) -> Column:
    """Whether the tokens c make a template of n tokens, at a level."""
    short = (n < LONG_TOKENS) & (F.size(c) >= SHORT_CONSTANT * n) & (level <= F.lit(SHORT_LEVEL))
    return (F.size(c) >= MIN_CONSTANT * n) | short


def parsed(docs: DataFrame) -> DataFrame:
    """docs: doc_id, th, text. One row per line with tokens: doc_id, th,
    line_no, n, brief, leaf, lk (hash of the masked line)."""
    t = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    t = t.select("doc_id", "th", "line_no", masked_tokens(F.col("line")).alias("t")).where("t is not null")
    n = F.size("t")
    brief = (n <= BRIEF_TOKENS) & (F.length(F.array_join(F.slice("t", 1, BRIEF_TOKENS), " ")) < BRIEF_CHARS)
    depth = F.when(n < LONG_TOKENS, SHORT_DEPTH).otherwise(DEPTH)
    return t.select(
        "doc_id", "th", "line_no", n.alias("n"), brief.alias("brief"), F.xxhash64(n, F.slice("t", F.lit(1), depth)).alias("leaf"), F.xxhash64(F.lit(5), "t").alias("lk")
    )


def templates(lines: DataFrame, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lk, g, first: the recurring template (a hash) of each kind of line that
    has one, and where the template comes first (doc_id, th, line_no)."""
    at = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "line_no"))
    each = lines.groupBy("lk", "doc_id", "th").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.first("brief").alias("brief"), F.min("line_no").alias("line_no"))
    kinds = settle(each.groupBy("lk").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.first("brief").alias("brief"), F.count("*").alias("docs"), at.alias("at")), "line-kinds")
    wide = kinds.where(F.col("n") >= GENERAL_TOKENS)
    busy = wide.groupBy("leaf").agg(F.sum("docs").alias("of"), F.count("*").alias("k")).where((F.col("of") >= min_docs) & (F.col("k") > 1)).select("leaf", "of")
    # The tokens of one line of each kind, where it comes first.
    want = F.struct("lk", "leaf", "docs", "of", "at", "n")
    per = wide.join(busy, "leaf").groupBy(F.col("at.doc_id").alias("cd"), F.col("at.th").alias("ct")).agg(F.collect_list(want).alias("want"))
    here = docs.join(per, F.col("doc_id").eqNullSafe(F.col("cd")) & (F.col("th") == F.col("ct")))
    picked = F.transform(F.array(F.split("text", "\n")), lambda p: F.transform("want", lambda w: F.struct(w.alias("w"), F.get(p, w["at"]["line_no"]).alias("line"))))
    t = here.select(F.explode(F.element_at(picked, 1)).alias("r")).select("r.w.*", masked_tokens(F.col("r.line")).alias("t")).dropDuplicates(["lk"])
    t = t.select("lk", "leaf", "docs", "of", "at", "n", F.posexplode("t").alias("p", "tok"))
    flat = settle(t, "line-tokens")
    # A token of fewer lines is in no recurring template.
    constant = flat.groupBy("leaf", "p", "tok").agg(F.sum("docs").alias("d"), F.first("of").alias("of")).where(F.col("d") >= min_docs)
    constant = constant.select("leaf", "p", "tok", F.floor(F.log2(F.col("of") / F.col("d"))).cast("int").alias("level"))
    c = F.array_sort(F.collect_list(F.struct("p", "tok", "level")))
    lk = unsent(flat).join(constant, ["leaf", "p", "tok"]).groupBy("lk").agg(F.first("leaf").alias("leaf"), F.first("docs").alias("docs"), F.first("n").alias("n"), F.first("at").alias("at"), c.alias("c"))
    lk = lk.where(_enough(F.col("n"), F.col("c"), F.lit(0))).withColumn("level", F.explode(F.array_distinct("c.level")))
    lk = lk.withColumn("c", F.filter("c", lambda x: x["level"] <= F.col("level"))).where(_enough(F.col("n"), F.col("c"), F.col("level")))
    lk = settle(lk.select("lk", "docs", "level", "at", F.xxhash64(F.lit(6), "leaf", "level", "c").alias("g")), "line-candidates")
    exact = kinds.where(F.col("docs") >= F.when(F.col("brief"), BRIEF_FACTOR * min_docs).otherwise(min_docs))
    exact = exact.select("lk", F.struct(F.lit(_EXACT_LEVEL).alias("level"), F.col("lk").alias("g"), "at").alias("of"))
    general = lk.join(recurring(lk, lines, min_docs), "g").select("lk", F.struct("level", "g", "at").alias("of"))
    # The lines of one template have the templates of lower levels in common.
    named = general.unionByName(exact).groupBy("lk").agg(F.min("of").alias("of")).select("lk", "of.g", "of.at")
    firsts = named.groupBy("g").agg(F.min("at").alias("first"))
    return settle(named.join(firsts, "g").select("lk", "g", "first"), "line-templates")


def recurring(candidates: DataFrame, lines: DataFrame, min_docs: int) -> DataFrame:
    """g of the candidates (lk, docs, g) that min_docs different documents have.

    Where one kind of line has as many documents, it is plain; else each kind
    has fewer, and their documents are told apart.
    """
    sums = candidates.groupBy("g").agg(F.sum("docs").alias("d"), F.max("docs").alias("m")).where(F.col("d") >= min_docs)
    sums = settle(sums, "line-sums")
    unsure = candidates.join(sums.where(F.col("m") < min_docs).select("g"), "g").select("lk", "g")
    seen = lines.select("lk", "doc_id", "th").join(unsure, "lk").groupBy("g", "doc_id", "th").agg(F.lit(1).alias("one"))
    told = seen.groupBy("g").agg(F.count("*").alias("d")).where(F.col("d") >= min_docs)
    return sums.where(F.col("m") >= min_docs).select("g").unionByName(told.select("g"))


def drops(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = True) -> DataFrame:
    """cd, ct (doc_id and text hash), dropped (how many lines go) and gone, of
    each line up to the last of these whether it goes."""
    lines = settle(parsed(docs), "lines")
    # The place that stays comes with the kind of line, so that a common line
    # is never gathered by its template.
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("line_no") == F.col("first.line_no"))
    marked = unsent(lines).join(templates(lines, docs, min_docs), "lk").where(~first if keep_first else F.lit(True))
    found = marked.groupBy(F.col("doc_id").alias("cd"), F.col("th").alias("ct")).agg(F.array_sort(F.collect_set("line_no")).alias("at"))
    before = F.concat(F.array(F.lit(-1)), F.slice("at", 1, F.size("at") - 1))
    gone = F.flatten(F.zip_with(before, F.col("at"), lambda a, b: F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True)))))
    return found.select("cd", "ct", F.size("at").alias("dropped"), gone.alias("gone"))


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS, keep_first: bool = True) -> DataFrame:
    """The rows of df with the recurring lines taken out of text, and columns
    lines_total and lines_dropped (int; these replace columns of such names). A
    null text stays null with 0 lines; a document may end up with an empty text
    but is never removed. Rows that repeat key and text are treated alike.
    n_chars, where df has it, follows the text. Work and memory are linear in
    a text's lines.
    """
    names = [c for c in df.columns if c not in ("lines_total", "lines_dropped")]
    hashed = df.select(*names, F.coalesce(F.xxhash64(F.col(text)), F.lit(0).cast("long")).alias("__line_hash"))
    docs = hashed.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col("__line_hash").alias("th"), F.col(text).alias("text"))
    gone = drops(docs, min_docs, keep_first).withColumnsRenamed({"cd": "__line_doc", "ct": "__line_text", "dropped": "__line_dropped", "gone": "__line_gone"})
    j = hashed.join(unsent(gone), F.col(key).eqNullSafe(F.col("__line_doc")) & (F.col("__line_hash") == F.col("__line_text")), "left")
    parts = F.split(F.col(text), "\n")
    left = F.filter(parts, lambda x, i: ~F.coalesce(F.get("__line_gone", i), F.lit(False)))
    new = F.when(F.col("__line_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    changed = {text: new}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("__line_gone").isNull(), F.col("n_chars")).otherwise(F.length(new).cast(df.schema["n_chars"].dataType))
    total = F.when(F.col(text).isNull(), 0).otherwise(F.size(parts))
    dropped = F.coalesce("__line_dropped", F.lit(0))
    return j.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in names], total.alias("lines_total"), dropped.alias("lines_dropped"))
