"""Language identification by interpolated Kneser-Ney character models.

One 4-gram model per language, held for all languages together as sorted
arrays of n-gram hashes with a row of log probabilities (one column per
language), looked up by binary search. A text goes to the language with the
lowest cross-entropy per character; of equal ones to the first in order of
name. A text is rejected if its cross-entropy is above the language's cut for
texts of its length, in the middle between what texts of the language reach
(runs of held-back labelled texts, by a normal tail of FALSE_REJECTION, and the
highest whole held-back text) and what text of none does (the same runs with
their symbols shuffled, least of all languages, lowest 1 %). So texts with
foreign passages, keys or license lines stay. Texts of fewer than LENGTHS[0]
symbols are too short to be rejected.

The models learn from a bounded sample: about DOCS_PER_LANG labelled documents
per language of at most MAX_SAMPLE_CHARS characters each and about TOTAL_CHARS
in all, chosen by a hash of the id. Of more than 2**BITS - 2 letters the most
frequent are told apart. Everything else works on whole texts of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_arrow

ORDER = 4
BITS = 15
DOCS_PER_LANG = 400
MAX_SAMPLE_DOCS = 8000
MAX_SAMPLE_CHARS = 1 << 18
TOTAL_CHARS = 16 << 20
#: Share of a language's texts that may be rejected, its and the shuffled
#: runs' place in a normal tail, symbols from which a cut holds, runs for each.
FALSE_REJECTION = 0.001
TAIL = 3.0902
SHUFFLED_TAIL = 2.3263
LENGTHS = (24, 96, 384, 1536)
RUNS = 300
DISCOUNT = 0.75
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << BITS) - 1)
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Per code point: its lower-case letter's code point, 0 for non-letters."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _TABLE.append(table)
    return _TABLE[0]


def symbols(text: str) -> np.ndarray:
    """Lower-case letters as code points; each run of other characters is one
    0, one 0 also opens and closes a text. Without letters: empty."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _letters()[cps]
    if not s.any():
        return s[:0]
    s = np.concatenate(([0], s, [0])).astype(np.uint32)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


@dataclass
class Model:
    langs: list[str]
    alphabet: np.ndarray  # code points of the symbols 1..; 0 is not a letter
    keys: list[np.ndarray]  # by order, sorted hashes of n-grams
    logp: list[np.ndarray]  # by order, (n-grams, languages)
    ctx_keys: list[np.ndarray]  # by order of the context
    ctx_logg: list[np.ndarray]
    floor: np.ndarray  # log probability of a symbol that no text has
    scale: float = 1.0
    cut: np.ndarray | None = None  # (languages, LENGTHS)

    def encode(self, s: np.ndarray) -> np.ndarray:
        """1: not a letter, 0: a letter unknown to the models, 2..: letters."""
        table = self.__dict__.get("table")
        if table is None:
            table = (_letters() == 0).astype(np.uint64)
            table[self.alphabet] = np.arange(2, len(self.alphabet) + 2, dtype=np.uint64)
            self.__dict__["table"] = table
        return table[s]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def entropy(self, s: np.ndarray) -> np.ndarray:
        """Cross-entropy per symbol, by language."""
        ids = self.encode(s)
        total = np.zeros(len(self.langs))
        step = 1 << 16
        for i in range(0, len(ids), step):
            part = ids[max(0, i - ORDER + 1) : i + step]
            total += self._sum(part, i - max(0, i - ORDER + 1))
        return -total / max(1, len(ids))

    def _sum(self, ids: np.ndarray, skip: int) -> np.ndarray:
        padded = np.concatenate((np.ones(ORDER - 1, np.uint64), ids))
        gram = np.zeros(len(ids), np.uint64)
        for k in range(ORDER):
            gram = (gram << np.uint64(BITS)) | padded[k : k + len(ids)]
        gram = gram[skip:]
        total = np.zeros(len(self.langs))
        for n in range(ORDER, 0, -1):
            if not len(gram):
                break
            at, hit = _find(self.keys[n], gram)
            total += self.logp[n][at[hit]].sum(axis=0, dtype=np.float64)
            gram = gram[~hit]
            if n > 1:
                at, seen = _find(self.ctx_keys[n - 1], gram >> np.uint64(BITS))
                total += self.ctx_logg[n - 1][at[seen]].sum(axis=0, dtype=np.float64)
                gram &= np.uint64((1 << (BITS * (n - 1))) - 1)
            else:
                total += len(gram) * self.floor
        return total

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, score, bits per character, rejected."""
        s = symbols(text or "")
        if not len(s) or not self.langs:
            return UNKNOWN, 0.0, None, True
        h = self.entropy(s)
        best = int(np.argmin(h))
        z = np.exp(np.maximum(-self.scale * (h - h[best]), -700))
        return self.langs[best], float(1 / z.sum()), float(h[best] / np.log(2)), self.rejects(best, float(h[best]), len(s))

    def rejects(self, lang: int, entropy: float, n: int) -> bool:
        at = int(np.searchsorted(LENGTHS, n, side="right")) - 1
        return self.cut is not None and at >= 0 and entropy > self.cut[lang, at]


def _hash(gram: np.ndarray) -> np.ndarray:
    return gram * _MIX  # odd factor: one to one modulo 2**64


def _find(keys: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = _hash(gram)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return at, (keys[at] == h if len(keys) else np.zeros(len(h), bool))


def _counts(ids: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) for n = 1..ORDER; below ORDER the counts are numbers
    of different preceding symbols."""
    grams = []
    for x in ids:
        padded = np.concatenate((np.ones(ORDER - 1, np.uint64), x))
        g = np.zeros(len(x), np.uint64)
        for k in range(ORDER):
            g = (g << np.uint64(BITS)) | padded[k : k + len(x)]
        grams.append(g)
    found = [np.unique(np.concatenate(grams), return_counts=True)]
    for n in range(ORDER - 1, 0, -1):
        found.append(np.unique(found[-1][0] & np.uint64((1 << (BITS * n)) - 1), return_counts=True))
    return [(np.zeros(0, np.uint64), np.zeros(0, np.int64)), *found[::-1]]


def train(texts: dict[str, list[str]]) -> Model:
    """texts: by language; every fourth text is held back for calibration."""
    langs = sorted(x for x in texts if any(len(symbols(t)) for t in texts[x]))
    syms = {x: [s for t in texts[x] if len(s := symbols(t))] for x in langs}
    back = {x: syms[x][3::4] or syms[x] for x in langs}
    fit = {x: [s for i, s in enumerate(syms[x]) if i % 4 != 3] for x in langs}
    letters, seen = np.unique(np.concatenate([s for x in langs for s in fit[x]]), return_counts=True) if langs else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    common = np.argsort(-seen[letters > 0], kind="stable")[: (1 << BITS) - 2]
    letters = np.sort(letters[letters > 0][common])
    v = len(letters) + 2
    m = Model(langs, letters, [], [], [], [], np.full(len(langs), -np.log(v)))
    by = {x: _counts([m.encode(s) for s in fit[x]]) for x in langs}
    below: tuple[np.ndarray, np.ndarray] | None = None
    m.keys, m.logp, m.ctx_keys, m.ctx_logg = ([np.zeros(0, np.uint64)] for _ in range(4))
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([by[x][n][0] for x in langs])) if langs else np.zeros(0, np.uint64)
        ctx = union >> np.uint64(BITS)
        contexts = np.unique(ctx)
        prob, back_off = np.zeros((len(union), len(langs))), np.ones((len(contexts), len(langs)))
        for k, x in enumerate(langs):
            g, c = by[x][n]
            own, inv = np.unique(g >> np.uint64(BITS), return_inverse=True)
            total, kinds = np.bincount(inv, c, len(own)), np.bincount(inv, minlength=len(own))
            back_off[np.searchsorted(contexts, own), k] = DISCOUNT * kinds / total
            prob[np.searchsorted(union, g), k] = np.maximum(c - DISCOUNT, 0) / total[inv]
        if below is None:
            m.floor = np.log(back_off[0] / v) if len(contexts) else m.floor
            lower = np.full((len(union), len(langs)), 1 / v)
        else:
            lower = below[1][np.searchsorted(below[0], union & np.uint64((1 << (BITS * (n - 1))) - 1))]
        if len(union):
            prob = prob + back_off[np.searchsorted(contexts, ctx)] * lower
        below = (union, prob)
        order = np.argsort(_hash(union))
        m.keys.append(_hash(union)[order])
        m.logp.append(np.log(prob[order]).astype(np.float32))
        if n > 1:
            order = np.argsort(_hash(contexts))
            m.ctx_keys.append(_hash(contexts)[order])
            m.ctx_logg.append(np.log(back_off[order]).astype(np.float32))
    _calibrate(m, back)
    return m


def _calibrate(m: Model, back: dict[str, list[np.ndarray]]) -> None:
    """Scale of the score by likelihood; cuts by language and length."""
    rows = [(k, m.entropy(s), len(s)) for k, x in enumerate(m.langs) for s in back[x]]
    if not rows:
        return
    h = np.array([r[1] for r in rows])
    y = np.array([r[0] for r in rows])

    def loss(scale: float) -> float:
        z = -scale * h
        z -= z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))

    m.scale = min((float(2.0**p) for p in np.arange(-2, 7, 0.5)), key=loss)
    m.cut = np.full((len(m.langs), len(LENGTHS)), np.inf)
    rng = np.random.default_rng(11)
    for k, x in enumerate(m.langs):
        own = np.array([(r[1][k], r[2]) for r in rows if r[0] == k])
        for j, n in enumerate(LENGTHS):
            runs = [s[i : i + n] for s in back[x] for i in range(0, len(s) - n + 1, n)]
            runs = runs[:: max(1, len(runs) // RUNS)]
            if len(runs) >= 8:
                some = np.array([m.entropy(r)[k] for r in runs])
                mixed = np.array([m.entropy(rng.permutation(r)).min() for r in runs])
                top = max(some.mean() + TAIL * some.std(), own[own[:, 1] >= n, 0].max(initial=0.0))
                m.cut[k, j] = max(top, (top + mixed.mean() - SHUFFLED_TAIL * mixed.std()) / 2)


def fold(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", seed: int = 7) -> Model:
    """Model from labelled rows outside fold 0; without any, one that answers
    ``und``."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(key) != 0))
    rows = rows.where(F.length(text) <= MAX_SAMPLE_CHARS)
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy(lang).agg(F.count("*"), F.sum(F.length(text))).collect()}
    each = min(DOCS_PER_LANG, max(1, MAX_SAMPLE_DOCS // max(1, len(counts))))
    share = F.lit(0)
    for x, (n, chars) in counts.items():
        part = min(1.0, each / n, TOTAL_CHARS / len(counts) / max(1, chars))
        share = F.when(F.col(lang) == x, int(part * 1_000_000)).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < share)
    texts: dict[str, list[str]] = {}
    for r in sorted(chosen.select(lang, key, text).collect(), key=lambda r: (r[0], str(r[1]), r[2])):
        texts.setdefault(r[0], []).append(r[2])
    model = train(texts)
    texts.clear()
    give_back()  # the driver goes on for long after this
    return model


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred, score, bits_per_char, rejected.

    Null texts and texts without letters are ``und``, score 0 and rejected.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("bits_per_char", "double"), ("rejected", "boolean")):
        schema = schema.add(name, kind)
    kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())

    def run(batches):
        m = held.value
        for batch in batches:
            out = [m.predict(x) for x in batch.column("__text").to_pylist()]
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *cols], names=schema.names)

    return map_arrow(rows, run, schema)


def keep_identified(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows of df that are not rejected, with all their columns."""
    names = df.columns
    model = fit(df, text, lang, key)
    held = df.sparkSession.sparkContext.broadcast(model)
    schema = df.schema

    def run(batches):
        m = held.value
        for batch in batches:
            flags = [not m.predict(x)[3] for x in batch.column(names.index(text)).to_pylist()]
            yield batch.filter(pa.array(flags, pa.bool_()))

    return map_arrow(df, run, schema)
