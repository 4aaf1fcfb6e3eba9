"""Personal data by candidate spans and boosted trees, in SQL functions only.

Base spans follow fixed patterns and checks. Besides, high-recall generators
propose candidates of five kinds (secrets are the fifth); those of different
kinds may overlap. A candidate's format and context become a code of bit
fields. A check that no field of the code shows says which candidates are
positive: of mail addresses the domain, of IP addresses the values of their
parts, of cards the Luhn digit, of phones the country prefix or a word such as
tel before them, of secrets the
issuer's prefix or the name that they are assigned to. So the trees learn, from
counts of codes over all documents, what data of a kind look like, and find
them where the check has nothing to hold on to: national phone numbers, dotted
cards, IPv6, spelled-out mail addresses, bare keys. Half of the documents give
the trees and half the thresholds, one per kind, above which at least
PRECISION of the candidates are positive. Candidates are taken from the text
with its base spans blanked, so what is added touches no base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, boost

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
PRECISION = 0.9
LEAST_SEEN = 5
_CLASS = r"[A-Za-z0-9._%+-]"
#: A match starts where no character of the run stands before it, or where the
#: last match ended: the same matches as without, in linear time.
EMAIL = rf"(?:(?<!{_CLASS})|\G){_CLASS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_NAME = r"[^\s<>\"'(),;:@\[\]{}\x00]"
_AT = r"(?:@|\x20?[\[({]at[\])}]\x20?)"
_DOT = r"(?:\.|\x20?[\[({]dot[\])}]\x20?)"
WIDE = {
    "email": rf"(?<!{_NAME}){_NAME}{{1,64}}+{_AT}(?:[\p{{L}}0-9-]{{1,63}}+{_DOT}){{1,8}}[\p{{L}}0-9-]{{2,63}}",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]++(?:\.[0-9]++){2,}+|[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._-]{0,3}[0-9]{4}){2}[\x20._-]{0,3}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+|00)?[\x20]?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[\x20./-]{1,2}(?:\([0-9]{1,5}\)|[0-9]{2,5})){1,5}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+_-])[A-Za-z0-9_-]{16,}+",
}
NEEDED = {"email": "@|[\\[({]at[\\])}]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{0,4}:", "card": "[0-9]{4}", "phone": r"[0-9)][\x20./-]{1,2}[(0-9]", "secret": "[A-Za-z0-9_-]{16}"}
NAMED = {
    "email": r"(?i)(?:mail|contact|write|address)[^\n]{0,12}$",
    "ip": r"(?i)(?:\bip|addr|host|server|gateway|dns)[^\n]{0,12}$",
    "card": r"(?i)(?:card|visa|master|amex|pay)[^\n]{0,12}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|contact)[^\n]{0,12}$",
    "secret": r"(?i)(?:bearer|auth|login|aws|github|ssh)[^\n]{0,12}$",
}
#: What marks a secret: the name that it is assigned to, or an issuer's prefix.
ASSIGNED = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[\"']?[\x20]{0,2}[:=][\x20]{0,2}[\"']?$"
ISSUED = r"^(?:A[KS]IA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35})$"
FIELDS = {
    "size": (0, 3), "sep": (3, 3), "paren": (6, 1), "named": (7, 1), "before": (8, 1), "after": (9, 1), "mix": (10, 3), "spread": (13, 2), "parts": (15, 3),
}
CONTEXT_CHARS = 32
_COUNTRY = r"^(?:\+|00)[0-9]{1,3}[\x20-]?"
_STEP = 256
_SPAN = "array<struct<s:bigint,e:bigint>>"
_BLANK = "\u0000"


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _prefix(lens: Column) -> Column:
    """Exclusive prefix sums of an array of longs, in two levels so that long
    arrays are not copied for each element."""
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")

    def scan(xs: Column) -> Column:
        return F.aggregate(
            xs,
            F.struct(zero.alias("sum"), none.alias("at")),
            lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["at"], acc["sum"]).alias("at")),
        )

    def join(blocks: Column) -> Column:
        offsets = scan(F.transform(blocks, lambda b: b["sum"]))["at"]
        return F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(b["at"], lambda a: a + o)))

    def cut(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(_STEP))
        return _let(F.transform(starts, lambda s: scan(F.slice(xs, s, _STEP))), join)

    return _let(lens, cut)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s: start, e: end, m: match, g: text since the last match,
    h: text up to the next>>, in code points; leftmost, non-overlapping."""

    def spans(f: Column, g: Column) -> Column:
        n = F.size(f)
        rows = F.zip_with(f, F.slice(g, 1, n), lambda m, x: F.struct(m.alias("m"), x.alias("g"), F.length(m).alias("k"), (F.length(m) + F.length(x)).cast("long").alias("n")))
        rows = F.zip_with(rows, F.slice(g, 2, n), lambda r, h: F.struct(r["m"].alias("m"), r["g"].alias("g"), r["k"].alias("k"), r["n"].alias("n"), h.alias("h")))

        def placed(r: Column) -> Column:
            def row(x: Column, a: Column) -> Column:
                return F.struct((a + x["n"] - x["k"]).alias("s"), (a + x["n"]).alias("e"), x["m"].alias("m"), x["g"].alias("g"), x["h"].alias("h"))

            return F.zip_with(r, _prefix(F.transform(r, lambda x: x["n"])), row)

        return F.when(n > 0, _let(rows, placed)).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,m:string,g:string,h:string>>"))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"), F.split(text, pattern, -1).alias("g"))
    return _let(found, lambda x: spans(x["f"], x["g"]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    xs = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    one = F.transform(xs, lambda x, i: x.cast("int") * (1 + i % 2))
    return F.aggregate(one, F.lit(0), lambda acc, x: acc + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def octets_ok(m: Column) -> Column:
    """All dotted parts at most 255, leading zeros aside."""
    return F.forall(
        F.split(m, r"\."),
        lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255),
    )


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets_ok(m)
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    return n.between(9, 15)


def _needed(text: Column, kind: str) -> Column:
    return {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+"))}[kind]


def base_spans(text: Column, kind: str) -> Column:
    kept = F.filter(matches(text, BASE[kind]), lambda x: _valid(kind, x["m"]))
    spans = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return F.when(_needed(text, kind), spans).otherwise(F.array().cast(_SPAN))


def blanked(text: Column) -> Column:
    """text with the characters of its base spans replaced by _BLANK."""

    def cover(kind: str):
        def filled(x: Column) -> Column:
            parts = F.zip_with(F.slice(x["g"], 1, F.size(x["f"])), x["f"], lambda g, m: F.concat(g, F.when(_valid(kind, m), F.repeat(F.lit(_BLANK), F.length(m))).otherwise(m)))
            return F.concat(F.array_join(parts, ""), F.element_at(x["g"], -1))

        def one(t: Column) -> Column:
            found = F.struct(F.regexp_extract_all(t, F.lit(BASE[kind]), F.lit(0)).alias("f"), F.split(t, BASE[kind], -1).alias("g"))
            return F.when(_needed(t, kind), _let(found, filled)).otherwise(t)

        return one

    for kind in KINDS:
        text = _let(text, cover(kind))
    return text


def _bucket(n: Column, *edges: int) -> Column:
    return sum((F.when(n >= k, 1).otherwise(0) for k in edges), F.lit(0))


def _code(kind: str, x: Column) -> Column:
    """The code of a candidate: nothing in it tells what the kind's check asks."""
    m, before = x["m"], F.right(x["g"], F.lit(CONTEXT_CHARS))
    if kind == "phone":
        m = F.regexp_replace(m, _COUNTRY, "")
    d = _digits(m)
    size = _bucket(F.length(m), 20, 24, 32, 40, 48, 64) if kind == "secret" else _bucket(F.length(m), 8, 10, 12, 14, 17, 20, 24)
    seps = {"email": r"[\[({]", "ip": ":", "card": r"[._]|[\x20-]{2}", "phone": r"[0-9]\.[0-9]", "secret": "_"}[kind]
    sep = F.when(m.rlike(seps), 1).otherwise(0) + F.when(F.contains(m, F.lit(" ")), 2).otherwise(0) + F.when(F.contains(m, F.lit("-")), 4).otherwise(0)
    mix = F.when(m.rlike("[0-9]"), 1).otherwise(0) + F.when(m.rlike("[a-z]"), 2).otherwise(0) + F.when(m.rlike("[A-Z]"), 4).otherwise(0)
    hexed = F.when(m.rlike("^[0-9a-f]+$") | m.rlike("^[0-9A-F]+$"), 1).otherwise(0)
    spread = hexed + F.when(F.length(d) * 5 >= F.length(m), 2).otherwise(0) if kind == "secret" else _bucket(F.length(d), 7, 10, 13)
    parts = F.size(F.split(F.substring(m, 1, 256), r"[^\p{L}0-9]+")) if kind != "secret" else F.lit(0)
    values = {
        "size": size, "sep": sep, "paren": F.contains(m, F.lit("(")), "named": F.lit(0) if kind == "phone" else before.rlike(NAMED[kind]), "before": before.rlike(r"[\p{L}0-9./-]$"),
        "after": x["h"].rlike(r"^[\p{L}0-9/-]"), "mix": mix, "spread": spread, "parts": F.least(parts, F.lit(7)),
    }
    total = F.lit(0)
    for name, (low, _) in FIELDS.items():
        total = total + F.shiftleft(values[name].cast("int"), low)
    return total


def _checked(kind: str, x: Column) -> Column:
    """Whether a candidate passes the check of its kind."""
    m = x["m"]
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(m, r"(?i)\x20?[\[({]at[\])}]\x20?", "@"), r"(?i)\x20?[\[({]dot[\])}]\x20?", ".")
        return plain.rlike(r"^[^@]+@(?:[\p{L}0-9](?:[\p{L}0-9-]*[\p{L}0-9])?\.)+\p{L}{2,}$")
    if kind == "ip":
        v6 = ~F.contains(m, F.lit(".")) & (m.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | m.rlike("^[^:].*[0-9A-Fa-f]::[0-9A-Fa-f]"))
        return v6 | ((F.size(F.split(m, r"\.")) == 4) & octets_ok(m))
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(7, 15) & (m.rlike(_COUNTRY) | F.right(x["g"], F.lit(CONTEXT_CHARS)).rlike(NAMED[kind]))
    return F.right(x["g"], F.lit(CONTEXT_CHARS)).rlike(ASSIGNED) | m.rlike(ISSUED)


def candidates(text: Column, kind: str) -> Column:
    """array<struct<s, e, code, hit>> of a kind's generator."""
    found = matches(text, WIDE[kind])
    if kind == "phone":
        found = F.filter(found, lambda x: F.length(_digits(x["m"])).between(7, 15))
    if kind == "secret":
        found = F.filter(found, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    out = F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _code(kind, x).alias("code"), _checked(kind, x).cast("int").alias("hit")))
    return F.when(text.rlike(NEEDED[kind]), out).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,code:int,hit:int>>"))


def learn(df: DataFrame, text: str = "text", key: str = "doc_id") -> dict[str, tuple[Trees, float]]:
    """By kind, the trees and the least margin that selects a candidate
    (infinite where no margin is right often enough)."""
    t = df.select(F.coalesce(F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(2)), F.lit(0)).alias("half"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def seen(i: int, kind: str) -> Column:
        return F.transform(candidates(F.col("t"), kind), lambda c: F.struct(F.lit(i).alias("kind"), c["code"].alias("code"), c["hit"].alias("hit")))

    rows = [seen(i, kind) for i, kind in enumerate(ALL_KINDS)]
    flat = t.select("half", F.explode(F.concat(*rows)).alias("r")).select("half", "r.kind", "r.code", "r.hit")
    counts = flat.groupBy("half", "kind", "code").agg(F.count("*").alias("n"), F.sum("hit").alias("p"))
    counts = sorted(tuple(r) for r in counts.collect())  # bounded by the width of the code
    out = {}
    for i, kind in enumerate(ALL_KINDS):
        trees = boost([r[2:] for r in counts if r[:2] == (0, i)], FIELDS)
        own = sorted(((round(trees.margin(c), 9), n, p) for half, j, c, n, p in counts if (half, j) == (1, i)), reverse=True)
        n = p = 0
        cut = float("inf")
        for at, (m, n1, p1) in enumerate(own):
            n, p = n + n1, p + p1
            last = at + 1 == len(own) or own[at + 1][0] < m  # equal margins stand or fall together
            if last and n >= LEAST_SEEN and p >= PRECISION * n and p1 > 0 and m > 0:
                cut = m
        out[kind] = (trees, cut)
    return out


def find_spans(df: DataFrame, model: dict[str, tuple[Trees, float]], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, base_<kind> and added_<kind> arrays of (s, e), by start;
    null texts are empty. Columns of any other name may be there."""
    t = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("__t"))
    keys = [f"__k{i}" for i in range(len(keep))]
    some = F.col("__t").rlike("[0-9@]|[\\[({]at[\\])}]")
    none = F.array().cast(_SPAN)
    t = t.select(*keys, some.alias("__any"), F.when(some, blanked(F.col("__t"))).alias("__b"), *[F.when(some, base_spans(F.col("__t"), k)).otherwise(none).alias(f"base_{k}") for k in KINDS])

    def added(kind: str) -> Column:
        trees, cut = model[kind]
        if cut == float("inf"):
            return none
        chosen = F.filter(candidates(F.col("__b"), kind), lambda c: trees.column(c["code"]) >= cut - 1e-6)
        return F.when(F.col("__any"), F.transform(chosen, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))).otherwise(none)

    named = [F.col(f"__k{i}").alias(k) for i, k in enumerate(keep)]
    return t.select(*named, *[f"base_{k}" for k in KINDS], *[added(k).alias(f"added_{k}") for k in ALL_KINDS])


def _named(arr: Column, i: int, kind: str) -> Column:
    return F.transform(arr, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(kind).alias("k")))


def joined(spans: dict[str, Column]) -> Column:
    """kind:start:end of all spans by start, then kind as listed."""
    rows = [_named(arr, i, kind) for i, (kind, arr) in enumerate(spans.items())]
    ordered = F.array_sort(F.concat(*rows))
    return F.array_join(F.transform(ordered, lambda r: F.concat_ws(":", r["k"], r["s"].cast("string"), r["e"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """text with each (s, e) of spans, in order of start, replaced by ``*`` of
    the same length; overlaps are harmless."""
    return F.aggregate(
        spans, text, lambda t, x: F.overlay(t, F.repeat(F.lit("*"), (x["e"] - x["s"]).cast("int")), (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int"))
    )
