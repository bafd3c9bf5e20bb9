"""Arbitration of one document's candidates in n log n steps.

Candidates are taken in falling priority, the equals together.  What is kept so far covers parts of the
text: a sorted list of disjoint stretches answers whether a candidate overlaps any of it, in two
searches.  A kept entity becomes 'fusion' when a candidate of another method and lower priority overlaps it: per
method, those not yet marked stand in an interval index, and leave it once found, so each is found once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

Entity = tuple[str, int, int, str, float, str, bool]  # type, start, end, value, score, method, valid


def _priority(e: Entity) -> tuple:
    return (bool(e[6]), e[2] - e[1], _rounded(e[4]))


def _rounded(x: float) -> float:
    """To six places, halves away from zero, as the SQL function rounds: a decimal of few places is its own."""
    if round(x, 6) == x:
        return x
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def deduplicated(found: list[Entity]) -> list[Entity]:
    """One entity for each (type, start, end), in order of first appearance."""
    best: dict[tuple, Entity] = {}
    for x in found:
        e = best.get(key := x[:3])
        if e is None:
            best[key] = x
        elif _priority(x) > _priority(e):
            best[key] = x
        elif _priority(x) == _priority(e) and e[5] != x[5]:
            best[key] = (*e[:4], max(e[4], x[4]), "fusion", e[6])
    return list(best.values())


class Cover:
    """Disjoint stretches; touching ones stay apart, as an empty interval between them overlaps neither."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def overlaps(self, a: int, b: int) -> bool:
        """Whether a stretch [s, e) has s < b and a < e."""
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a

    def add(self, a: int, b: int) -> None:
        lo = bisect_right(self.ends, a)
        hi = bisect_left(self.starts, b)
        if lo < hi:
            a, b = min(a, self.starts[lo]), max(b, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [a], [b]


class Intervals:
    """Intervals by start with the greatest end of every subtree; those found are taken out."""

    def __init__(self, items: list[tuple[int, int, int]]):
        self.items = sorted(items)  # (start, end, number)
        self.size = 1 << max(0, (len(items) - 1).bit_length())
        self.reach = [-1] * (2 * self.size)
        self.place = {n: k for k, (_, _, n) in enumerate(self.items)}

    def put(self, number: int) -> None:
        k = self.place[number]
        self._set(k, self.items[k][1])

    def _set(self, k: int, end: int) -> None:
        k += self.size
        self.reach[k] = end
        while k > 1:
            k //= 2
            self.reach[k] = max(self.reach[2 * k], self.reach[2 * k + 1])

    def take(self, a: int, b: int) -> list[int]:
        """Numbers of the intervals [s, e) with s < b and a < e, which leave the index."""
        before = bisect_left(self.items, (b,))
        out, todo = [], [(1, 0, self.size)]
        while todo:
            node, lo, hi = todo.pop()
            if lo >= before or self.reach[node] <= a:
                continue
            if hi - lo == 1:
                out.append(lo)
            else:
                mid = (lo + hi) // 2
                todo += [(2 * node, lo, mid), (2 * node + 1, mid, hi)]
        for k in out:
            self._set(k, -1)
        return [self.items[k][2] for k in out]


def arbitrated(found: list[Entity]) -> list[Entity]:
    """Kept entities in order of position."""
    keyed = sorted(((-int(p[0]), -p[1], -p[2], e[1], e[2], e[0]), e) for e in deduplicated(found) for p in (_priority(e),))
    ranked = [e for _, e in keyed]
    groups: list[list[int]] = []
    for k, (key, _) in enumerate(keyed):
        if groups and keyed[k - 1][0][:3] == key[:3]:
            groups[-1].append(k)
        else:
            groups.append([k])
    cover, kept = Cover(), set()
    for group in groups:
        fresh = [k for k in group if not cover.overlaps(*ranked[k][1:3])]
        for k in fresh:
            kept.add(k)
            cover.add(*ranked[k][1:3])
    methods = {e[5] for e in ranked}
    index = {m: Intervals([(*ranked[k][1:3], k) for k in kept if ranked[k][5] == m]) for m in methods}
    marked: set[int] = set()
    for group in groups:
        for k in group:
            if k not in kept:
                for m in methods - {ranked[k][5]}:
                    marked.update(index[m].take(*ranked[k][1:3]))
        for k in group:
            if k in kept:
                index[ranked[k][5]].put(k)
    placed = sorted(kept, key=lambda k: (ranked[k][1], ranked[k][2], k))
    return [(*ranked[k][:5], "fusion" if k in marked else ranked[k][5], ranked[k][6]) for k in placed]
