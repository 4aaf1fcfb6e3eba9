"""Gradient-boosted trees over bit-field features, learned from counts.

A row is an integer code of a few bit fields; training sees each code once,
with how many rows have it and how many of those are positive. The number of
codes is bounded by the width of the code, whatever the number of rows. The
trees become one SQL expression of the code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Trees:
    base: float
    fields: dict[str, tuple[int, int]]  # name: (lowest bit, width)
    #: Each tree: (field, limit, (field, limit, low, high), (…)), low if <=.
    trees: list[tuple] = field(default_factory=list)

    def value(self, code: int, name: str) -> int:
        at, width = self.fields[name]
        return (code >> at) & ((1 << width) - 1)

    def margin(self, code: int) -> float:
        total = self.base
        for name, limit, low, high in self.trees:
            name, limit, low, high = low if self.value(code, name) <= limit else high
            total += low if self.value(code, name) <= limit else high
        return total

    def probability(self, code: int) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(code)))))

    def column(self, code: Column) -> Column:
        """The margin as an expression."""

        def at(name: str) -> Column:
            low, width = self.fields[name]
            return F.shiftright(code, low).bitwiseAND(F.lit((1 << width) - 1))

        total = F.lit(self.base)
        for name, limit, low, high in self.trees:
            sides = [F.when(at(s[0]) <= s[1], s[2]).otherwise(s[3]) for s in (low, high)]
            total = total + F.when(at(name) <= limit, sides[0]).otherwise(sides[1])
        return total


def _split(t: Trees, rows: list[tuple[int, float, float]]) -> tuple:
    """Best (field, limit, leaf, leaf) for (code, gradient, hessian) rows."""
    total_g, total_h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = lambda g, h: g / (h + 1.0)
    best = (0.0, next(iter(t.fields)), (1 << 16), leaf(total_g, total_h), leaf(total_g, total_h))
    for name in t.fields:
        sums: dict[int, list[float]] = {}
        for code, g, h in rows:
            s = sums.setdefault(t.value(code, name), [0.0, 0.0])
            s[0] += g
            s[1] += h
        g = h = 0.0
        for v in sorted(sums)[:-1]:
            g, h = g + sums[v][0], h + sums[v][1]
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            if gain > best[0] + 1e-9:
                best = (gain, name, v, leaf(g, h), leaf(total_g - g, total_h - h))
    return best[1:]


def boost(counts: list[tuple[int, float, float]], fields: dict[str, tuple[int, int]], rounds: int = 24, rate: float = 0.4) -> Trees:
    """counts: (code, rows, positives)."""
    n, pos = sum(c[1] for c in counts), sum(c[2] for c in counts)
    t = Trees(math.log((pos + 0.5) / (n - pos + 0.5)), fields)
    for _ in range(rounds if n else 0):
        rows = []
        for code, w, p in counts:
            q = t.probability(code)
            rows.append((code, p - w * q, w * q * (1 - q)))
        name, limit, _, _ = _split(t, rows)
        sides = [_split(t, [r for r in rows if (t.value(r[0], name) <= limit) == low]) for low in (True, False)]
        t.trees.append((name, limit, *((f, x, rate * a, rate * b) for f, x, a, b in sides)))
    return t
