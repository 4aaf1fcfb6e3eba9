"""Periodic runs of words by the linear tandem-repeat method.

A run is a stretch of words with a smallest period q, at least twice as long as
q and at least MIN_LENGTH words, that no neighbouring word extends. Words are
numbered, and stretches that can hold a run are found first: all words of a run
lie in K-word grams that the same stretch has again, so words outside such
grams fall away until nothing changes. Each stretch that is left goes through
the method:

1. a suffix tree, and from it the Lempel-Ziv blocks;
2. at every block border, extensions forwards and backwards give squares that
   cover the leftmost occurrence of every square (only those of primitive roots
   are kept: rotations of a primitive root are primitive);
3. their ends are marked in the suffix tree, and suffix-link walks mark the
   rotations, which completes the vocabulary;
4. the leaves under a mark are its occurrences; occurrences of one period that
   start at consecutive words merge into a run.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MIN_LENGTH = 12
#: Half of MIN_LENGTH: both halves of a run share a gram of so many words.
K = MIN_LENGTH // 2
#: Distinct words a Python worker numbers before it starts anew (between documents).
REMEMBERED_WORDS = 400_000


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def stretches(ids: np.ndarray, k: int = K) -> list[tuple[int, int]]:
    """Disjoint stretches [a, b) of words outside which no run has a word."""
    n = len(ids)
    if n < 2 * k:
        return []
    h = np.zeros(n - k + 1, np.uint64)
    w = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        h = (h ^ w[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    found = [(0, n)]
    at, part = np.arange(len(h)), np.zeros(len(h), np.int64)
    while True:
        key = h[at] + part.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        if not same.any():
            return []
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + k, -1)
        # Grams of different parts do not meet: parts have other words between them.
        held = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False])).astype(np.int8)
        turn = np.flatnonzero(np.diff(held))
        new = [(int(a), int(b)) for a, b in zip(turn[::2], turn[1::2], strict=True) if b - a >= 2 * k]
        if new == found or not new:
            return new
        found = new
        at = np.concatenate([np.arange(a, b - k + 1) for a, b in new])
        part = np.concatenate([np.full(b - a - k + 1, i) for i, (a, b) in enumerate(new)])


class SuffixTree:
    """Suffix tree of a list of numbers and an end mark, built left to right.

    start, depth, parent, link: per node; the edge into v is the words
    s[first[v] + depth[parent[v]] : first[v] + depth[v]], first being the least
    suffix below v. leaves[low[v] : high[v]] are the suffixes below v.
    """

    def __init__(self, s: list[int]):
        self.s = s = [*s, -1]
        n = len(s)
        start, end, link, kids = [0], [0], [0], [{}]
        node, edge, length, left, waiting = 0, 0, 0, 0, -1
        for i, c in enumerate(s):
            waiting = -1
            left += 1
            while left:
                if not length:
                    edge = i
                kid = kids[node].get(s[edge])
                if kid is None:
                    kids[node][s[edge]] = len(start)
                    start.append(i), end.append(n), link.append(0), kids.append(None)
                    if waiting >= 0:
                        link[waiting] = node
                        waiting = -1
                else:
                    size = (end[kid] if end[kid] < i + 1 else i + 1) - start[kid]
                    if length >= size:
                        edge += size
                        length -= size
                        node = kid
                        continue
                    if s[start[kid] + length] == c:
                        length += 1
                        if waiting >= 0:
                            link[waiting] = node
                            waiting = -1
                        break
                    mid = len(start)
                    start.append(start[kid]), end.append(start[kid] + length), link.append(0)
                    kids.append({s[start[kid] + length]: kid, c: mid + 1})
                    kids[node][s[edge]] = mid
                    start.append(i), end.append(n), link.append(0), kids.append(None)
                    start[kid] += length
                    if waiting >= 0:
                        link[waiting] = mid
                    waiting = mid
                left -= 1
                if not node and length:
                    length -= 1
                    edge = i - left + 1
                elif node:
                    node = link[node]
        self.kids, self.link = kids, link
        size = len(start)
        self.parent, self.depth = parent, depth = [0] * size, [0] * size
        self.first, self.low, self.high = first, low, high = [n] * size, [0] * size, [0] * size
        self.leaves: list[int] = []
        order, stack = [], [0]
        while stack:
            v = stack.pop()
            order.append(v)
            low[v] = len(self.leaves)
            if kids[v] is None:
                first[v] = n - depth[v]
                self.leaves.append(first[v])
            else:
                for w in kids[v].values():
                    parent[w], depth[w] = v, depth[v] + end[w] - start[w]
                    stack.append(w)
        for v in reversed(order):
            if kids[v] is None:
                high[v] = low[v] + 1
            p = parent[v]
            if v:
                if high[v] > high[p]:
                    high[p] = high[v]
                if first[v] < first[p]:
                    first[p] = first[v]
        self.leaf = [0] * n
        for v in order:
            if kids[v] is None:
                self.leaf[first[v]] = v

    def blocks(self) -> list[int]:
        """Starts of the Lempel-Ziv blocks, and the length at the end: a block
        is the longest beginning of what is left that starts earlier as well
        (it may overlap), or one new word."""
        out, i, n = [], 0, len(self.s) - 1
        first, parent = self.first, self.parent
        while i < n:
            out.append(i)
            v = self.leaf[i]
            while first[v] == i and v:
                v = parent[v]
            i += max(1, self.depth[v])
        return [*out, n]


def _common(pattern: list[int], text: list[int]) -> list[int]:
    """How many words pattern and text[j:] have in common, for every j."""
    m = len(pattern)
    s = [*pattern, -2, *text]
    n = len(s)
    z = [0] * n
    a = b = 0
    for i in range(1, n):
        if i < b:
            k = z[i - a]
            if k < b - i:
                z[i] = k
                continue
            k = b - i
        else:
            k = 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z[m + 1 :]


def _primitive(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """(start, q) of the squares whose root is primitive; found: (q, start,
    reach of period q around the border: from, to), q ascending."""
    if len(found) < 2:
        return [(a, q) for q, a, _, _ in found]
    at = {q: (a, lo, hi) for q, a, lo, hi in found}
    most, out, whole = found[-1][0], [], set()
    for q, a, lo, hi in found:
        if q in whole:
            continue
        out.append((a, q))
        for m in range(2 * q, min(most, (hi - lo) // 2) + 1, q):
            if m in at and at[m][0] >= lo and at[m][0] + 2 * m <= hi:
                whole.add(m)
    return out


def covering(s: list[int], blocks: list[int]) -> dict[int, list[int]]:
    """start -> halves of squares with primitive roots that cover, by
    consecutive shifts to the right, the leftmost occurrence of every such
    square."""
    n, out = len(s), {}
    for b in range(len(blocks) - 1):
        h, h1 = blocks[b], blocks[b + 1]
        h2 = blocks[b + 2] if b + 2 < len(blocks) else h1
        most = h1 - h
        pairs = []
        if h1 < n:  # centre in the block, right end behind it
            ahead = _common(s[h1 : h1 + most], s[h : h1 + most])
            back = _common(s[h:h1][::-1], s[max(0, h - most) : h1][::-1])
            found = []
            for k in range(1, most + 1):
                k1, k2 = ahead[most - k], back[k] if k < len(back) else 0
                k1, k2 = min(k1, most), min(k2, most)
                if k1 > 0 and k1 + k2 >= k:
                    found.append((k, max(h1 - k - k2, h1 - 2 * k + 1), h1 - k - k2, h1 + k1))
            pairs += _primitive(found)
        most = min(h2 - h, n - h - 1)
        if h and most > 0:  # left end before the block
            ahead = _common(s[h : h + most], s[h + 1 : h + 2 * most])
            back = _common(s[max(0, h - most) : h][::-1], s[max(0, h - most) : h + most][::-1])
            found = []
            for k in range(1, most + 1):
                k1, k2 = ahead[k - 1] if k - 1 < len(ahead) else 0, back[most - k]
                if k1 > 0 and k2 > 0 and k1 + k2 >= k:
                    found.append((k, max(h - k2, h - k + 1), h - k2, h + k + k1))
            pairs += [(a, k) for a, k in _primitive(found) if a + k <= h1]
        for a, k in pairs:
            out.setdefault(a, []).append(k)
    return out


def _squares(tree: SuffixTree, cover: dict[int, list[int]]) -> set[tuple[int, int]]:
    """Marks (node, length): the squares end on the edges into these nodes."""
    s, kids, link, parent, depth, first = tree.s, tree.kids, tree.link, tree.parent, tree.depth, tree.first
    marked: set[tuple[int, int]] = set()
    for i, halves in cover.items():
        lengths = sorted({2 * k for k in halves})
        v = tree.leaf[i]
        while lengths and v and first[v] == i:
            top = depth[parent[v]]
            while lengths and lengths[-1] > top:
                marked.add((v, lengths.pop()))
            v = parent[v]
    for v, size in list(marked):
        while True:
            i, u = first[v], parent[v]
            w = link[u] if u else 0
            at = depth[w]
            while at < size - 1:  # down to the word behind the first
                w = kids[w][s[i + 1 + at]]
                at = depth[w]
            if at == size - 1:
                v = kids[w].get(s[i]) if kids[w] is not None else None
                if v is None:
                    break
            elif s[first[w] + size - 1] == s[i]:
                v = w
            else:
                break
            if (v, size) in marked:
                break
            marked.add((v, size))
    return marked


def tandem_runs(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal repetition in s, of any length
    from twice its period on."""
    tree = SuffixTree(s)
    marked = _squares(tree, covering(s, tree.blocks()))
    leaves, by = np.array(tree.leaves), {}
    for v, size in marked:
        by.setdefault(size // 2, []).append(leaves[tree.low[v] : tree.high[v]])
    out = []
    for q, parts in by.items():
        at = np.unique(np.concatenate(parts))
        cut = np.flatnonzero(np.diff(at) != 1)
        for a, b in zip(at[np.concatenate(([0], cut + 1))].tolist(), at[np.concatenate((cut, [len(at) - 1]))].tolist(), strict=True):
            out.append((a, b - a + 2 * q, q))
    return sorted(out)


_number = _Numbers()


def runs_of(words: list[bytes], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least min_length words, by
    start, then period."""
    if len(_number) > REMEMBERED_WORDS:
        _number.clear()
    ids = np.fromiter(map(_number.__getitem__, words), np.int64, len(words))
    out = []
    for a, b in stretches(ids, max(1, min_length // 2)):
        out += [(a + i, m, q) for i, m, q in tandem_runs(ids[a:b].tolist()) if m >= min_length]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that a run has after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for a, m, q in runs:
        edge[a + q] += 1
        edge[a + m] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def collapse_runs(df: DataFrame, text: str = "text", key: str = "doc_id", edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row of df: key, ``runs`` (array of start, length, period) and ``kept``
    (the words that stay, joined by one space).

    Words are split at ASCII white space, compared byte by byte. edit(key,
    words), where given, returns the words to search in place of a text's. Null
    texts have no words, as have empty ones; rows that repeat a key are each
    searched; an empty table gives an empty result. A row is searched by
    itself, so nothing is shuffled and other columns do not matter.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            keys, found, kept = batch.column("key").to_pylist(), [], []
            for k, t in zip(keys, batch.column("text"), strict=True):
                words = (t.as_py() or b"").split()
                if edit:
                    words = edit(k, words)
                r = runs_of(words)
                found.append([{"start": a, "length": m, "period": q} for a, m, q in r])
                kept.append(b" ".join(collapsed(words, r)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary())], names=["key", "runs", "kept"])

    out = map_arrow(rows, run, "key long, runs array<struct<start:long,length:long,period:long>>, kept binary")
    return out.select(F.col("key").alias(key), "runs", F.col("kept").cast("string").alias("kept"))

