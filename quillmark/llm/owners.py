"""Exact duplicates by Patricia tries.

Texts are dealt by length and content hash. A task keeps the texts it has seen
in a compressed radix trie over their bytes: inner nodes are shared beginnings,
a text ends in a terminal node, and the terminal holds the owner of all equal
texts (the smallest or largest identifier) and how often the text occurred.
So equality is that of whole byte strings, never of hashes alone.

Before texts are dealt out, each task puts its own share into such a trie and
hands on one row per different text, so a text that very many documents have
reaches its partition once per task. A trie that outgrows its bytes spills by
subtree: the texts of a large subtree, and all later ones that lead into it,
go to a next round, which deals them out over more partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle

#: Bytes of labels that a trie holds before it lets go of a part.
TRIE_BYTES = 48 << 20
#: Partitions of a spill round, in times those of the round before.
SPILL_SPREAD = 8

Held = tuple[int | None, int, int]  # owner, rows, rows of the owner's identifier


class _Node:
    __slots__ = ("label", "kids", "held", "gone")

    def __init__(self, label: bytes):
        self.label = label
        self.kids: dict[int, _Node] = {}
        self.held: Held | None = None
        self.gone = False  # this node's texts are a later round's


def _merged(a: Held | None, b: Held, largest: bool) -> Held:
    if a is None:
        return b
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2] + b[2]
    if a[0] is None or b[0] is None:
        win = b if a[0] is None else a
    else:
        win = a if (a[0] > b[0]) == largest else b
    return win[0], a[1] + b[1], win[2]


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the longest beginning of label that text has at a place."""
    lo, hi = 0, min(len(label), len(text) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if text.startswith(label[lo:mid], at + lo):
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """Compressed radix trie from texts to owners."""

    def __init__(self, largest: bool = False):
        self.largest, self.root, self.size, self.texts = largest, _Node(b""), 0, 0

    def add(self, text: bytes, held: Held) -> bool:
        """False if the text leads into a subtree that is gone."""
        node, at, n = self.root, 0, len(text)
        while True:
            if node.gone:
                return False
            if at == n:
                self.texts += node.held is None
                node.held = _merged(node.held, held, self.largest)
                return True
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = _Node(text[at:])
                self.size += n - at
                node, at = kid, n
                continue
            if text.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            k = _shared(kid.label, text, at)
            mid = node.kids[text[at]] = _Node(kid.label[:k])
            kid.label = kid.label[k:]
            mid.kids[kid.label[0]] = kid
            node, at = mid, at + k

    def texts_below(self, node: _Node | None = None, path: bytes = b"") -> Iterator[tuple[bytes, Held]]:
        stack = [(node or self.root, path)]
        while stack:
            node, path = stack.pop()
            if node.held is not None:
                yield path, node.held
            stack += [(kid, path + kid.label) for kid in node.kids.values()]

    def spill(self) -> Iterator[tuple[bytes, Held]]:
        """Lets the largest subtree of at most half the bytes go, or one text:
        yields its texts. Of the edge into it the first byte stays."""
        order, sizes, texts = [(self.root, None)], {}, {}
        for node, _ in order:
            order += [(kid, node) for kid in node.kids.values()]
        for node, above in reversed(order):
            sizes[node] = sizes.get(node, 0) + len(node.label)
            texts[node] = texts.get(node, 0) + (node.held is not None)
            if above is not None:
                sizes[above] = sizes.get(above, 0) + sizes[node]
                texts[above] = texts.get(above, 0) + texts[node]
        node, path = self.root, b""
        while kids := [kid for kid in node.kids.values() if texts[kid]]:
            node = max(kids, key=sizes.__getitem__)
            path += node.label
            if sizes[node] * 2 <= self.size:
                break
        found = list(self.texts_below(node, path))
        self.size -= sizes[node] - 1
        self.texts -= len(found)
        node.label, node.kids, node.held, node.gone = node.label[:1], {}, None, True
        yield from found


_NAMES = ["owner", "n_rows", "n_own", "text", "open"]
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
_OUT_BYTES = 8 << 20


def _tries(rows: DataFrame, largest: bool, most: int, whole: bool) -> DataFrame:
    """Texts merged by one trie a task: owner, n_rows, n_own, text, open.

    whole: equal texts are in one task, so a trie too large spills by subtree
    (rows with open = true), what stays is final, and of that only texts of
    several rows are returned. Else a trie too large is handed on and started
    anew, and all its rows are open.
    """

    def run(batches):
        trie, out, held = Trie(largest), [], 0

        def full(text, h, open_):
            nonlocal out, held
            out.append((*h, text, open_))
            held += len(text)
            if held > _OUT_BYTES:
                done, out, held = out, [], 0
                return [batch_of(done)]
            return ()

        def batch_of(done):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(_KINDS)], names=_NAMES)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("owner", "n_rows", "n_own")]
            for owner, n, own, text in zip(*cols, batch.column("text"), strict=True):
                text = text.as_py()
                if not trie.add(text, (owner, n, own)):
                    yield from full(text, (owner, n, own), True)
                while trie.size > most and trie.texts > 1:
                    gone = trie.spill() if whole else trie.texts_below()
                    if not whole:
                        trie = Trie(largest)
                    for t, h in gone:
                        yield from full(t, h, True)
        for t, h in trie.texts_below():
            if not whole or h[1] > 1:
                yield from full(t, h, not whole)
        if out:
            yield batch_of(out)

    return map_arrow(rows, run, "owner long, n_rows long, n_own long, text binary, open boolean")


def _keys(text: Column) -> list[Column]:
    """Length, content hash and digest of a text (binary)."""
    return [F.octet_length(text).alias("size"), F.xxhash64(text).alias("hash"), F.unhex(F.sha2(text, 256)).alias("sha256")]


def _raw(text: str) -> Column:
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def shared_texts(df: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """size (bytes), hash, sha256 (binary), owner, n_rows, n_own (rows of the
    owner's key) of every text that several rows have; see find_owners."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    largest, one = keep == "largest", F.lit(1).cast("long")
    rows = df.select(F.col(key).cast("long").alias("owner"), one.alias("n_rows"), one.alias("n_own"), _raw(text).alias("text"))
    dealt = lambda x, *n: x.select("*", *_keys(F.col("text"))[:2]).repartition(*n, "size", "hash")
    todo = dealt(_tries(rows, largest, trie_bytes, False))
    found, n = None, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        merged = _tries(todo, largest, trie_bytes, True).select("*", *_keys(F.col("text")))
        out = settle(merged.withColumn("text", F.when(F.col("open"), F.col("text"))), "owners")
        done = out.where("not open").drop("text", "open")
        found = done if found is None else found.unionByName(done)
        rest = out.where("open").select(*_NAMES)
        if rest.isEmpty():
            return found
        n *= SPILL_SPREAD
        todo = dealt(rest, n)


def find_owners(df: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Per row of df: key, ``keep_id``, ``group_size`` (rows with this text),
    ``kept`` and ``text_sha256`` (of the UTF-8 text, lower-case hex).

    Of the rows with equal texts the one of the smallest (or largest) key is
    kept, and keep_id is its key. Null texts count as empty. A null key loses
    against any other; a group of null keys only has a null keep_id. Of rows
    that repeat both key and text one is kept, no matter which. An empty table
    gives an empty result; other columns do not matter. Rows find their group
    by length, content hash and SHA-256 together.
    """
    at = ["size", "hash", "sha256"]
    groups = shared_texts(df, text, key, keep, trie_bytes)
    rows = df.select(F.col(key).alias("__id"), *_keys(_raw(text)))
    again = groups.where("n_own > 1").select(*at, "owner")
    if again.isEmpty():
        rows, groups = rows.withColumn("row", F.lit(0)), groups.withColumn("first", F.lit(0))
    else:
        rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "owner-rows")
        own = rows.join(again, at).where(F.col("__id").eqNullSafe(F.col("owner")))
        first = own.groupBy(*at).agg(F.min("row").alias("first"))
        groups = groups.join(first, at, "left")
    j = rows.join(groups, at, "left")
    alone = F.col("n_rows").isNull()
    first = F.col("first").isNull() | (F.col("first") == F.col("row"))
    return j.select(
        F.col("__id").alias(key),
        F.when(alone, F.col("__id")).otherwise(F.col("owner")).alias("keep_id"),
        F.coalesce("n_rows", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("__id").eqNullSafe(F.col("owner")) & first)).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )
