"""Vector best-fit packing of tokenised documents into sequences.

A bin has three residual capacities: tokens, documents, attention cost (the
sum of squared piece lengths). A piece goes, longest first, to the open bin
that can take it under all three and whose residual vector is best: by
``dot`` the largest weighted dot product of the piece's and the residual
vector among the bins that it would leave fullest in tokens, by ``norm`` the
smallest weighted norm of what is left over. Full-length pieces need no
search. Pieces are dealt by a hash into groups of about GROUP_PIECES, which
are packed apart from each other; a group leaves about one bin part-filled.

By default the limits on documents and attention cost are what the limit on
tokens implies (as many documents as tokens, the square of the tokens), so
that as few sequences as can be come out; smaller ones bind.
"""

from __future__ import annotations

import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_arrow, remembered, settle, ship

MAX_TOKENS = 4096
MAX_DOCUMENTS = 4096
MAX_ATTENTION = MAX_TOKENS * MAX_TOKENS
END_ID = 1
GROUP_PIECES = 10_000
#: Words whose ids a Python worker remembers.
REMEMBERED_WORDS = 600_000
REMEMBERED_CORES = 600_000
_HELD: dict[str, tuple] = {}
remembered(_HELD.clear)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordIds(dict):
    """Ids, as little-endian 32-bit bytes, of what lies between blanks.

    This tokenizer's pieces never span a blank or line feed, so a text's ids
    are those of its parts one after another. Runs of Latin letters with at
    most one point or comma behind go to the merge model straight away: there
    the normaliser only lower-cases, and the letters and the sign are pieces of
    their own. All else takes the tokenizer's whole way.
    """

    _plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)\Z")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.cores: dict[str, bytes] = {}
        self.letters = _byte_letters()
        super().__init__({"": b""})
        self.signs = {x: self._whole(x) if x else b"" for x in ("", ".", ",")}

    def _whole(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, core: str) -> bytes:
        ids = self.cores.get(core)
        if ids is None:
            mapped = core if core.isascii() else "".join(map(self.letters.__getitem__, core.encode()))
            found = [t.id for t in self.model.tokenize(mapped)]
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(self.cores) >= REMEMBERED_CORES:
                self.cores.clear()
            self.cores[core] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        m = self._plain.match(word) if len(word) <= 64 else None
        ids = self._core(m[1].lower()) + self.signs[m[2]] if m else self._whole(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
                self[""] = b""
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end; each
        different word of the texts is looked up once."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        ids = list(map(self.__getitem__, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[at]
        ends = np.cumsum(n)
        out = flat[np.repeat(first[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        words = np.asarray(parts.offsets.to_numpy(zero_copy_only=False))[1:] - parts.offsets[0].as_py()
        return out, np.concatenate(([0], ends))[words]


def _tokenizer(path: str) -> WordIds:
    if path not in _HELD:
        _HELD[path] = (WordIds(path),)
    return _HELD[path][0]


def _slices(batch: pa.RecordBatch, size: int = 4 << 20):
    """Row ranges of a batch of about size bytes of text."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    groups = np.cumsum(sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def pieces(
    df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row.

    A document is its token ids and end_id; a null or empty text is the end_id
    alone. Longer documents are cut every max_tokens ids.
    """
    path = tokenizer or default_tokenizer()
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = "long" if rows.schema["doc_id"].dataType.simpleString() == "bigint" else rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        words = _tokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * max_tokens
        for batch in batches:
            for part in _slices(batch):
                ids, ends = words.encode_all(part.column("text"))
                at, out, start = [], [], 0
                for i, e in enumerate(ends.tolist()):
                    own = ids[start:e].tobytes() + end
                    start = e
                    for p in range(0, len(own), step):
                        cut = own[p : p + step]
                        at.append(i)
                        out.append((p // step, p // 4, len(cut) // 4, zlib.crc32(cut)))
                cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                keys = part.column("doc_id").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *cols], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(rows, run, schema)


def best_fit(
    lengths: np.ndarray,
    max_tokens: int = MAX_TOKENS,
    max_documents: int = MAX_DOCUMENTS,
    max_attention: int = MAX_ATTENTION,
    rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.01, 0.05),
) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; lengths in any order.

    Raises ValueError for a piece that no empty bin can take.
    """
    n = len(lengths)
    cap = np.array([max_tokens, max_documents, max_attention], float)
    if n and (lengths.max() > max_tokens or int(lengths.max()) ** 2 > max_attention or max_documents < 1):
        raise ValueError("a piece is larger than an empty bin")
    w = np.array(weights)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if n else 0
    free = np.empty((max(1, n), 3))  # residuals of the open bins
    name = np.empty(max(1, n), np.int64)
    n_open = made = 0
    for i in order.tolist():
        length = int(lengths[i])
        item = np.array([length, 1, float(length) * length])
        pick = -1
        if n_open:
            r = free[:n_open]
            ok = (r[:, 0] >= length) & (r[:, 1] >= 1) & (r[:, 2] >= item[2])
            can = np.flatnonzero(ok)
            if len(can):
                left = (r[can] - item) / cap
                if rule == "dot":
                    full = can[left[:, 0] <= left[:, 0].min() + 1e-9]
                    pick = int(full[np.argmax((r[full] / cap) @ (w * item / cap))])
                else:
                    pick = int(can[np.argmin((left * left) @ w)])
        if pick < 0:
            pick = n_open
            free[pick] = cap
            name[pick] = made
            made += 1
            n_open += 1
        bins[i] = name[pick]
        offsets[i] = max_tokens - int(free[pick, 0])
        free[pick] -= item
        if free[pick, 0] < least or free[pick, 1] < 1:
            n_open -= 1
            free[pick], name[pick] = free[n_open], name[n_open]
    return bins, offsets


def pack(parts: DataFrame, max_tokens: int = MAX_TOKENS, **how) -> DataFrame:
    """parts: rows with doc_id, piece, length (as pieces() gives). Adds
    sequence_id (unique over all groups) and offset, gapless from 0.

    Of pieces of equal length and of bins that do equally well, the first in
    order goes first; rows that repeat one another are dealt to different
    groups. how: max_documents, max_attention, rule and weights of best_fit().
    """
    n = parts.count()
    groups = max(1, math.ceil(n / GROUP_PIECES))
    dealt = parts.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    schema = StructType([*parts.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    names = [f.name for f in schema]

    def run(group, pdf):
        bins, offsets = best_fit(pdf["length"].to_numpy(np.int64), max_tokens, **how)
        pdf = pdf.assign(sequence_id=(int(group[0]) << 32) | bins, offset=offsets)
        return pdf[names]

    ship(parts.sparkSession)
    return dealt.groupBy("__group").applyInPandas(run, schema)


def pack_documents(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, **how) -> DataFrame:
    """pieces() and pack() of whole documents; an empty table gives no rows.
    Rows that repeat an id are documents of their own."""
    return pack(settle(pieces(df, text, key, tokenizer, max_tokens), "pieces"), max_tokens, **how)


