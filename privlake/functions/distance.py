"""Levenshtein distance of long texts, bit-parallel in a band around the diagonal.

Spark's own function fills a table of n x m cells.  Here a column of the table is one whole number, a bit a cell,
and only the cells that a distance of k can pass are in it: 2 k + 1.  k is doubled until
the distance fits, so texts that are alike cost little whatever their length, about n * d / 64 steps on machine words.

Two bounds come first, each in linear time: the characters that one text has more often than the other (below), and,
of texts of one length, the places where they differ (above).  Where they meet, as with misread characters, that is it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: First width of the band.
FIRST = 64
#: Columns between two cuts of the characters' places.
STRETCH = 1024
#: Length from which the band beats the table.
LONG = 600
#: Length up to which the table beats the bounds.
SHORT = 60


def bounded(a: str, b: str, k: int) -> int | None:
    """The distance if it is at most ``k``, else None."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > k:
        return None
    if not m:
        return n
    # bit i of a band stands for the row j - k + i of column j; rows are characters of a
    width = 2 * k + 1
    full = (1 << width) - 1
    places: dict[str, int] = {}
    at: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        at.setdefault(c, []).append(i)
    needed = set(b)
    for c in needed & at.keys():
        bits = bytearray((n + k) // 8 + 1)
        for i in at[c]:
            bits[(i + k) >> 3] |= 1 << ((i + k) & 7)
        places[c] = int.from_bytes(bits, "little")
    # vertical steps down the column: +1 everywhere below row 0
    up, down = full & ~((1 << k) - 1), 0
    distance = k  # of the band's last row, row k of column 0
    base, near = 0, {}  # the places around the columns at hand, cut out of the long numbers once in a while
    for j, c in enumerate(b):
        if j - base >= STRETCH:
            base, near = j, {}
        if (here := near.get(c)) is None:
            here = near[c] = (places.get(c, 0) >> base) & ((1 << (width + STRETCH)) - 1)
        match = (here >> (j - base)) & full
        d0 = ((((match & up) + up) & full) ^ up) | match | down
        hp = (down | ~(d0 | up)) & full
        hn = d0 & up
        # the last row of the new band lies one further down: a diagonal step
        distance += not d0 >> (width - 1) & 1
        x = d0 >> 1
        up = (hn | ~(x | hp)) & full
        down = x & hp
    # distance is that of row m + k, whose step from the row above is the last bit but one; the text ends at row n
    for i in range(width - 2, width - 2 - (m + k - n), -1):
        distance += (down >> i & 1) - (up >> i & 1)
    return distance if distance <= k else None


def _limits(x, y) -> tuple[int, int]:
    """Bounds of the distance of two texts as arrays of code points."""
    import numpy as np

    top = max(len(x), len(y))
    if len(x) == len(y):  # places that are equal count on both sides
        apart = x != y
        x, y = x[apart], y[apart]
        top = len(x)
    (u, n), (v, m) = (np.unique(z, return_counts=True) for z in (x, y))
    both = int(np.minimum(n[np.isin(u, v, assume_unique=True)], m[np.isin(v, u, assume_unique=True)]).sum())
    return max(len(x), len(y)) - both, top


def _trimmed(a: str, b: str) -> tuple:
    """Code points of both texts without what they begin and end with alike."""
    import numpy as np

    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4") for s in (a, b))
    n = min(len(x), len(y))
    apart = np.flatnonzero(x[:n] != y[:n])
    start = int(apart[0]) if len(apart) else n
    x, y, n = x[start:], y[start:], n - start
    apart = np.flatnonzero(x[len(x) - n :] != y[len(y) - n :])
    end = n - 1 - int(apart[-1]) if len(apart) else n
    return x[: len(x) - end], y[: len(y) - end]


def _told(a: str, b: str, most: int | None) -> int | None:
    """The distance, or -1 beyond ``most``; None where the bounds don't tell it and a table is cheaper than a band."""
    x, y = _trimmed(a, b)
    low, top = _limits(x, y)
    if most is not None and low > most:
        return -1
    if low == top:
        return low
    if min(len(a), len(b)) <= LONG:
        return None
    d = _banded(x, y, low, top if most is None else min(most, top))
    return -1 if d is None else d


def distance(a: str, b: str, most: int | None = None) -> int | None:
    """Levenshtein distance; None beyond ``most``."""
    x, y = _trimmed(a, b)
    low, top = _limits(x, y)
    if most is not None and low > most:
        return None
    return low if low == top else _banded(x, y, low, top if most is None else min(most, top))


def _banded(x, y, low: int, most: int) -> int | None:
    """The distance, which is ``low`` at least, if it is at most ``most``."""
    a, b = (z.tobytes().decode("utf-32-le", "surrogatepass") for z in (x, y))
    k = min(max(FIRST, low), most)
    while True:
        if (d := bounded(a, b, k)) is not None or k >= most:
            return d
        k = min(2 * k, most)


def levenshtein(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance, natively for short texts and in a band for long ones; null beyond ``most``."""
    known = F.udf(lambda x, y: None if x is None or y is None else _told(x, y, most), "int", useArrow=True)
    some = F.least(F.length(a), F.length(b)) > SHORT
    told = known(F.when(some, a), F.when(some, b))
    native = F.levenshtein(a, b)
    native = native if most is None else F.when(native <= most, native)
    return F.when(told >= 0, told).when(told.isNull(), native)
